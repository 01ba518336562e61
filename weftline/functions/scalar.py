"""Column functions: times, arrays, text heuristics, target transforms, probabilities."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY = 86_400_000_000
DAY_MICROS = float(DAY)


def micros(df: DataFrame, time: Column) -> Column:
    """Microseconds of a time of ``df``; of one without a zone by its calendar fields, so that no hour repeats or is missing."""
    if df.select(time).schema[0].dataType.typeName() != "timestamp_ntz":
        return F.unix_micros(time.cast("timestamp"))
    days = F.date_diff(time, F.lit("1970-01-01").cast("date")).cast("long")
    fields = F.hour(time) * 3_600_000_000 + F.minute(time).cast("long") * 60_000_000
    return days * DAY + fields + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def datetime_parts(time: Column, prefix: str, epoch: bool = True) -> dict[str, Column]:
    """Calendar components of a time, and its epoch seconds unless times are relative."""
    out = {"year": F.year(time), "month": F.month(time), "day": F.day(time), "hour": F.hour(time)}
    out = {f"{prefix}_{k}": c.cast("float") for k, c in out.items()}
    return out | ({f"{prefix}_total_seconds": (F.unix_micros(time.cast("timestamp")) / 1e6).cast("double")} if epoch else {})


def age_in_days(time: Column, reference: Column) -> Column:
    """Days from a time to a reference, as float."""
    return ((F.unix_micros(reference.cast("timestamp")) - F.unix_micros(time.cast("timestamp"))) / DAY_MICROS).cast("float")


def relative_days(df: DataFrame, times: list[str]) -> DataFrame:
    """Every time column as its age against the newest time of all of them."""
    newest = df.agg(F.max(F.greatest(*times) if len(times) > 1 else F.col(times[0])).alias("__newest"))
    out = df.crossJoin(F.broadcast(newest))  # a single row
    return out.withColumns({f"{t}_age": age_in_days(F.col(t), F.col("__newest")) for t in times}).drop("__newest")


def fixed_width(name: str, width: int) -> dict[str, Column]:
    """An array column as ``width`` columns, null beyond its end."""
    return {f"{name}__{i}": F.get(F.col(name), F.lit(i)).cast("float") for i in range(width)}


def prose_profile(df: DataFrame, column: str, sample: int | None = 10_000, order: str | None = None) -> DataFrame:
    """Of a string column's first ``sample`` non-null values, or of all: distinct ones, their mean number of words, and whether it is prose."""
    rows = df.where(F.col(column).isNotNull())
    if sample is not None:
        rows = (rows.orderBy(order) if order else rows).limit(sample)
    rows = rows.select(column).distinct()
    out = rows.agg(F.count("*").alias("n_unique"), F.avg(F.regexp_count(column, F.lit(r"\s+")) + 1).alias("mean_words"))
    return out.withColumn("is_prose", (F.col("n_unique") >= 20) & (F.coalesce(F.col("mean_words"), F.lit(0.0)) >= 4))


def log_target(x: Column) -> Column:
    """log(1 + x); raises where a target is negative."""
    return F.when(x < 0, F.raise_error(F.lit("targets below 0 have no log1p"))).otherwise(F.log1p(x))


def unlog_target(x: Column) -> Column:
    """The inverse of log_target, not below 0."""
    return F.greatest(F.expm1(x), F.lit(0.0))


def bind(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is worked out once, however often ``f`` and the lambdas in it use it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def total(x: Column) -> Column:
    """The sum of an array."""
    return F.aggregate(x, F.lit(0.0), lambda a, v: a + v)


def uniform(key: Column, seed: int = 0) -> Column:
    """A number in (0, 1): 52 bits of a hash of the key and the seed, so that seeds draw independently, on any partitioning."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string"))), 1, 13), 16, 10).cast("double")
    return (bits + F.lit(0.5)) / F.lit(float(1 << 52))


def recency_score(key: Column, age: Column, half_life: Column, seed: int = 0) -> Column:
    """A Gumbel draw less the log of an exponential decay: top-k of it is a weighted sample without replacement."""
    return -F.log(-F.log(uniform(key, seed))) - age / half_life * F.lit(0.6931471805599453)


def softmax(x: Column) -> Column:
    powers = lambda t: F.transform(t["x"], lambda v: F.exp(v - t["top"]))
    shares = lambda t: F.transform(t["e"], lambda v: v / t["all"])
    e = bind(F.struct(x.alias("x"), F.array_max(x).alias("top")), powers)
    return bind(e, lambda e: bind(F.struct(e.alias("e"), total(e).alias("all")), shares))


def mean_of(arrays: list[Column]) -> Column:
    sums = arrays[0]
    for a in arrays[1:]:
        sums = F.zip_with(sums, a, lambda x, y: x + y)
    return F.transform(sums, lambda v: v / len(arrays))


def ensemble_proba(probas: list[Column], logits: bool = True) -> Column:
    """Softmax of the mean log probabilities, or the mean probabilities."""
    return softmax(mean_of([F.transform(p, lambda v: F.log(v)) for p in probas])) if logits else mean_of(probas)


def argmax(x: Column) -> Column:
    """The first place of the largest element, from 0."""
    return (F.array_position(x, F.array_max(x)) - 1).cast("int")


def sanitize_label(x: Column) -> Column:
    return F.btrim(F.regexp_replace(x, "[^A-Za-z0-9._=-]+", "_"), F.lit("_"))


def binarize(x: Column, positive: str) -> Column:
    return (F.lower(F.trim(x)) == positive).cast("int")


def finite(x: Column) -> Column:
    """Infinities and NaN as null."""
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))), x)


def flatten_config(config: dict, prefix: str = "") -> dict[str, str]:
    """A nested configuration as dotted paths."""
    out: dict[str, str] = {}
    for k, v in config.items():
        out |= flatten_config(v, f"{prefix}{k}.") if isinstance(v, dict) else {f"{prefix}{k}": str(v)}
    return out


def config_diff(rows: DataFrame, run: str = "run", path: str = "path", value: str = "value", runs: int | None = None) -> DataFrame:
    """Paths whose values differ between runs or are missing in some, from a long table (run, path, value)."""
    total = rows.select(run).distinct().count() if runs is None else runs
    each = rows.groupBy(path).agg(F.count_distinct(value).alias("n_values"), F.count_distinct(run).alias("n_runs"))
    return each.where((F.col("n_values") > 1) | (F.col("n_runs") < total)).withColumn("incomplete", F.col("n_runs") < total)
