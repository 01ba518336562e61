"""Reference counts across an edge: plain, by trailing windows, and as of each row's time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.catalog import Database, Edge
from weftline.functions.scalar import DAY, micros
from weftline.session import materialize

#: Parts that rows without a key are dealt to.
NULL_PARTS = 1024
#: A key with more rows to count is split over tasks.
MOST_ROWS = 1_000_000


def count_name(one: str, many: str, days: int | None = None) -> str:
    return f"{one}__refcount__{many}" + ("" if days is None else f"__{days}d")


def reference_counts(one: DataFrame, one_key: str, many: DataFrame, many_key: str, name: str, many_time: Column | None = None, at: Column | None = None, days: tuple[int, ...] = ()) -> DataFrame:
    """``one`` with the number of ``many`` rows per key, 0 for none; nulls are no keys.

    With ``days``, also the numbers of those later than ``at`` less so many
    days, in the same partial aggregation.
    """
    aggs = [F.count("*").alias(name)]
    aggs += [F.count(F.when(many_time > at - F.expr(f"INTERVAL {d} DAY"), 1)).alias(f"{name}__{d}d") for d in days]
    counts = many.where(F.col(many_key).isNotNull()).groupBy(F.col(many_key).alias("__k")).agg(*aggs)
    out = one.join(counts, one[one_key] == counts["__k"], "left").drop("__k")
    return out.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in [name, *[f"{name}__{d}d" for d in days]]})


def counts_as_of(one: DataFrame, one_key: str, one_time: Column, many: DataFrame, many_key: str, many_time: Column, name: str, days: tuple[int, ...] = (), most_rows: int = MOST_ROWS) -> DataFrame:
    """``one`` with the number of ``many`` rows of its key at or before its time, and within ``days`` before it.

    Keys of more than ``most_rows`` rows, of which there are few, are counted
    by ``counts_as_of_hot``; all others by one window.
    """
    sizes = many.where(F.col(many_key).isNotNull()).groupBy(F.col(many_key).alias("__hot")).agg(F.count("*").alias("__n"))
    hot = materialize(sizes.where(F.col("__n") > most_rows).select("__hot"), "hot")
    args = (many_key, many_time, name, days)
    if hot.isEmpty():
        return counts_by_window(one, one_key, one_time, many, *args)
    hot = F.broadcast(hot)  # a row for over ``most_rows`` rows
    split = lambda df, key, how: df.join(hot, df[key] == hot["__hot"], how)
    parts = [f(split(one, one_key, how), one_key, one_time, split(many, many_key, how), *args) for f, how in ((counts_as_of_hot, "left_semi"), (counts_by_window, "left_anti"))]
    return parts[0].unionByName(parts[1])


def counts_by_window(one: DataFrame, one_key: str, one_time: Column, many: DataFrame, many_key: str, many_time: Column, name: str, days: tuple[int, ...] = ()) -> DataFrame:
    """The same where no key is large.

    One window over both sides' rows instead of a range join: rows of a key
    are sorted once and each count is a running sum, so a key's work is linear
    in its rows and not in its pairs. The range frame includes equal times.
    Many rows without a time never count; one rows without a time or key get 0,
    and those without a key are dealt to tasks by their other columns.
    """
    cols = one.columns
    loose = F.when(F.col(one_key).isNull(), F.pmod(F.xxhash64(*[c for c, k in one.dtypes if not k.startswith("map")]), F.lit(NULL_PARTS))).otherwise(0)
    left = one.select(F.struct(*cols).alias("__row"), F.col(one_key).alias("__k"), loose.alias("__p"), micros(one, one_time).alias("__t"), F.lit(0).alias("__n"))
    right = many.select(F.lit(None).cast(left.schema["__row"].dataType).alias("__row"), F.col(many_key).alias("__k"), F.lit(0).alias("__p"), micros(many, many_time).alias("__t"), F.lit(1).alias("__n"))
    rows = left.union(right.where(F.col("__k").isNotNull() & F.col("__t").isNotNull()))
    by = Window.partitionBy("__k", "__p").orderBy("__t")
    sums = {name: F.sum("__n").over(by.rangeBetween(Window.unboundedPreceding, 0))}
    sums |= {f"{name}__{d}d": F.sum("__n").over(by.rangeBetween(-d * DAY + 1, 0)) for d in days}
    none = F.col("__k").isNull() | F.col("__t").isNull()
    out = rows.withColumns({c: F.when(none, 0).otherwise(F.coalesce(s, F.lit(0))).cast("long") for c, s in sums.items()})
    return out.where(F.col("__row").isNotNull()).select("__row.*", *sums)


def counts_as_of_hot(one: DataFrame, one_key: str, one_time: Column, many: DataFrame, many_key: str, many_time: Column, name: str, days: tuple[int, ...] = (), bucket_days: int = 30) -> DataFrame:
    """The same as ``counts_as_of`` where single keys hold a large share of the rows.

    A count within days is the difference of two running counts, so each row
    probes its time and the windows' starts. Running counts go within (key,
    bucket of time), which splits a key over tasks, and are offset by the
    totals of the key's earlier buckets, one small row each.
    """
    rows = materialize(one.withColumn("__id", F.monotonically_increasing_id()), "hot")
    t = micros(rows, one_time)
    probes = rows.select("__id", F.col(one_key).alias("__k"), F.posexplode(F.array(t, *[t - d * DAY for d in days])).alias("__i", "__t")).withColumn("__n", F.lit(0))
    hits = many.select(F.lit(None).cast("long").alias("__id"), F.col(many_key).alias("__k"), F.lit(None).cast("int").alias("__i"), micros(many, many_time).alias("__t"), F.lit(1).alias("__n"))
    every = probes.union(hits).where(F.col("__k").isNotNull() & F.col("__t").isNotNull()).withColumn("__b", F.floor(F.col("__t") / F.lit(bucket_days * DAY)))
    within = F.sum("__n").over(Window.partitionBy("__k", "__b").orderBy("__t").rangeBetween(Window.unboundedPreceding, 0))
    totals = every.groupBy(F.col("__k").alias("__tk"), F.col("__b").alias("__tb")).agg(F.sum("__n").alias("__s"))
    before = Window.partitionBy("__tk").orderBy("__tb").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("__tk", "__tb", F.coalesce(F.sum("__s").over(before), F.lit(0)).alias("__o"))
    at = every.withColumn("__c", within).where(F.col("__id").isNotNull()).join(totals, (F.col("__k") == F.col("__tk")) & (F.col("__b") == F.col("__tb")))
    run = lambda i: F.sum(F.when(F.col("__i") == i, F.col("__c") + F.col("__o")))
    sums = {name: run(0)} | {f"{name}__{d}d": run(0) - run(i) for i, d in enumerate(days, 1)}
    found = at.groupBy(F.col("__id").alias("__r")).agg(*[c.alias(k) for k, c in sums.items()])
    out = rows.join(found, F.col("__id") == F.col("__r"), "left").drop("__id", "__r")
    return out.withColumns({k: F.coalesce(F.col(k), F.lit(0)).cast("long") for k in sums})


def add_count_features(db: Database, edges: tuple[Edge, ...] | None = None) -> Database:
    """Every relation with counts of the rows that refer to it, one column per edge, from the relations as they were."""
    out = dict(db.tables)
    for e in db.edges if edges is None else edges:
        for one, key, many, ref, counts in ((e.target, e.target_col, e.source, e.source_col, e.type.from_many), (e.source, e.source_col, e.target, e.target_col, e.type.to_many)):
            if counts:
                r = out[one]
                out[one] = r.with_df(reference_counts(r.df, key, db.tables[many].df, ref, count_name(one, many)))
    return Database(out, db.edges)
