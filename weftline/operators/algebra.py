"""Relational algebra with the null rules of point-in-time analysis."""

from __future__ import annotations

from functools import reduce
from itertools import combinations
from operator import and_, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize

HOWS = {"left": "left", "right": "right", "inner": "inner", "outer": "full"}


def join(left: DataFrame, right: DataFrame, left_on: list[str], right_on: list[str], how: str = "left", drop_left: bool = False, drop_right: bool = False) -> DataFrame:
    """Equi-join on columns of disjoint names.

    A row whose keys are all null matches nothing. In a composite key that is
    null in part, nulls match nulls. Both are one hash-joinable condition.
    """
    both = set(left.columns) & set(right.columns)
    if both:
        raise ValueError(f"columns on both sides: {sorted(both)}")
    if len(left_on) == 1:
        on: Column = left[left_on[0]] == right[right_on[0]]
    else:
        on = reduce(and_, (left[a].eqNullSafe(right[b]) for a, b in zip(left_on, right_on)))
        on = on & reduce(or_, (left[a].isNotNull() for a in left_on))
    out = left.join(right, on, HOWS[how])
    return out.drop(*(left_on if drop_left else []), *(right_on if drop_right else []))


def filter_query(df: DataFrame, condition: str, **values) -> DataFrame:
    """Rows that meet an SQL condition with named parameters ``:name``; null counts as not met."""
    condition = condition.replace("{", "{{").replace("}", "}}")
    return df.sparkSession.sql(f"SELECT * FROM {{__rows}} WHERE {condition}", args=values, __rows=df)


def filter_in(df: DataFrame, column: str, wanted: DataFrame) -> DataFrame:
    """Rows whose value occurs in the first column of ``wanted``, as a semi-join: the list may be large."""
    key = wanted.columns[0]
    return df.join(wanted.select(F.col(key).alias("__wanted")), F.col(column) == F.col("__wanted"), "left_semi")


def visible(times: list[str], cutoff: Column, strict: bool = False) -> Column:
    """That every time column lies at or before the cutoff, or is null; always true for a null cutoff."""
    ok = [F.col(t).isNull() | (F.col(t) < cutoff if strict else F.col(t) <= cutoff) for t in times]
    return cutoff.isNull() | reduce(and_, ok, F.lit(True))


def cut_off(df: DataFrame, times: list[str], cutoff: Column) -> DataFrame:
    """Rows visible at a cutoff."""
    return df.where(visible(times, cutoff)) if times else df


def at_cutoffs(df: DataFrame, times: list[str], cutoffs: DataFrame, most_broadcast: int = 10_000) -> DataFrame:
    """Rows visible at each of a set of cutoffs (one column), with the cutoff as a column.

    One job for all points in time. The cutoffs are few by nature, which is
    checked before they are broadcast. Beyond that the join is by partitions of
    both sides; its result, each row at each later cutoff, is as large as it.
    """
    small = cutoffs.limit(most_broadcast + 1).count() <= most_broadcast
    name = cutoffs.columns[0]
    return df.join(F.broadcast(cutoffs) if small else cutoffs, visible(times, F.col(name)))


def effective_time(times: list[str]) -> Column:
    """The latest of a row's times, nulls aside."""
    return F.greatest(*times) if len(times) > 1 else F.col(times[0])


def normalize_names(df: DataFrame, table: str, sep: str = "__") -> DataFrame:
    """Every column as ``table__column``, once."""
    return df.withColumnsRenamed({c: f"{table}{sep}{c}" for c in df.columns if not c.startswith(f"{table}{sep}")})


def denormalize_names(df: DataFrame, table: str, sep: str = "__") -> DataFrame:
    """Column names without their table's prefix."""
    return df.withColumnsRenamed({c: c.removeprefix(f"{table}{sep}") for c in df.columns})


def row_slice(df: DataFrame, order: list[str], start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` of a total order; places come from ranges, so no task holds all rows before."""
    return numbered(df, order, "__at").where((F.col("__at") >= start) & (F.col("__at") < stop)).drop("__at")


def numbered(df: DataFrame, order: list, name: str) -> DataFrame:
    """Contiguous numbers from 0 in a total order, without moving all rows to one task.

    Rows are range-partitioned and sorted; their place within the partition
    and the partition come from one built-in id, and the sizes of the
    partitions before give the offset. The ranges are written first, as ids of
    a plan that runs twice need not agree.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__m", F.monotonically_increasing_id())
    ranged = materialize(ranged, "ranges").withColumn("__p", F.shiftright("__m", 33))
    sizes = ranged.groupBy(F.col("__p").alias("__q")).agg(F.count("*").alias("__n"))
    before = Window.orderBy("__q").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__q", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__o"))
    out = ranged.join(F.broadcast(offsets), F.col("__p") == F.col("__q"))  # one row per partition
    return out.withColumn(name, F.col("__o") + F.col("__m").bitwiseAND(F.lit((1 << 33) - 1))).drop("__m", "__p", "__q", "__o")


def union_splits(parts: dict[str, DataFrame], order: list[str], id_col: str = "__task_id") -> DataFrame:
    """Splits one after another, with a contiguous id first and the split as a column."""
    rows = None
    for name, df in parts.items():
        df = df.withColumn("split", F.lit(name))
        rows = df if rows is None else rows.unionByName(df)
    return number_splits(rows, list(parts), order, id_col)


def number_splits(rows: DataFrame, splits: list[str], order: list[str], id_col: str = "__task_id") -> DataFrame:
    """Rows with a column ``split`` in the order of ``splits`` and within them of ``order``, with a contiguous id first."""
    at = F.array_position(F.array(*[F.lit(s) for s in splits]), F.col("split"))
    out = numbered(rows.withColumn("__split_at", at), ["__split_at", *order], id_col).drop("__split_at")
    return out.select(id_col, *[c for c in out.columns if c != id_col])


def empty_like(df: DataFrame) -> DataFrame:
    """The schema of a plan without rows."""
    return df.sparkSession.createDataFrame([], df.schema)


def column_profile(df: DataFrame) -> DataFrame:
    """One row per column: non-null count, and whether it is constant or all null; one pass, one row to the driver at most."""
    cols = df.columns
    facts = df.agg(*[F.struct(F.count(c).alias("n"), (F.min(c) == F.max(c)).alias("same")).alias(c) for c in cols])
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c)["n"].alias("n_non_null"), F.coalesce(F.col(c)["same"], F.lit(True)).alias("is_constant")) for c in cols]))
    return facts.select(rows.alias("r")).select("r.*")


def drop_uninformative(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Without columns that are constant or all null."""
    constant = [r.column_name for r in column_profile(df).where("is_constant").collect()]
    return df.drop(*[c for c in constant if c not in keep])


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that occur more than once, with their counts."""
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def empirical_keys(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """For each set of columns: rows without nulls in it, distinct ones, and whether it is a key of those."""
    aggs = []
    for i, cols in enumerate(sets):
        whole = reduce(and_, (F.col(c).isNotNull() for c in cols))
        aggs += [F.count(F.when(whole, 1)).alias(f"n{i}"), F.count_distinct(F.when(whole, F.struct(*cols))).alias(f"d{i}")]
    row = F.explode(F.array(*[F.struct(F.lit(",".join(c)).alias("cols"), F.col(f"n{i}").alias("n_rows"), F.col(f"d{i}").alias("n_distinct")) for i, c in enumerate(sets)]))
    return df.agg(*aggs).select(row.alias("r")).select("r.*", (F.col("r.n_rows") == F.col("r.n_distinct")).alias("is_key"))


def discover_keys(df: DataFrame, columns: list[str], most: int = 3, error: float = 0.02) -> DataFrame:
    """The smallest sets of at most ``most`` columns that are keys of the rows without nulls in them: cols, n_rows.

    Level by level: sets that hold a key are left out, distinct counts by
    HyperLogLog rule out all others that are clearly none, in one pass a level,
    and only what is left is counted exactly. A set without rows is no key.
    """
    found: list[tuple[str, int]] = []
    keys: list[set[str]] = []
    for size in range(1, most + 1):
        sets = [c for c in combinations(columns, size) if not any(k <= set(c) for k in keys)]
        if not sets:
            break
        whole = lambda c: reduce(and_, (F.col(x).isNotNull() for x in c))
        one = lambda c: F.when(whole(c), F.xxhash64(*c))
        sketched = df.agg(*[x for i, c in enumerate(sets) for x in (F.count(F.when(whole(c), 1)).alias(f"n{i}"), F.approx_count_distinct(one(c), error).alias(f"d{i}"))]).first()
        left = [c for i, c in enumerate(sets) if sketched[f"n{i}"] and sketched[f"d{i}"] >= (1 - 5 * error) * sketched[f"n{i}"]]
        if left:
            for r in empirical_keys(df, [list(c) for c in left]).where("is_key").collect():  # a row a set
                found.append((r.cols, r.n_rows))
                keys.append(set(r.cols.split(",")))
    return df.sparkSession.createDataFrame(found, "cols string, n_rows long")
