"""Sources and sinks: task databases, predictions, result files, run folders, traces."""

from __future__ import annotations

import contextlib
import re
import sqlite3

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from weftline.catalog import Database, Edge, Rel, Task
from weftline.operators.algebra import number_splits, union_splits

PREDICTION_COLUMNS = ["key", "cutoff_timestamp", "y_true", "y_pred", "task_type", "p_pred", "proba"]


def in_memory(spark: SparkSession, name: str, rows, schema, keys: tuple[str, ...] = (), times: tuple[str, ...] = ()) -> Rel:
    """A relation of rows at hand."""
    return Rel(name, spark.createDataFrame(rows, schema), keys, times)


def load_database(spark: SparkSession, folder: str, spec: dict[str, dict]) -> Database:
    """Parquet tables with declared keys, times and references: {table: {keys, times, refs: {column: (table, column)}}}."""
    tables = {n: Rel(n, spark.read.parquet(f"{folder}/{n}.parquet"), tuple(s.get("keys", ())), tuple(s.get("times", ()))) for n, s in spec.items()}
    edges = tuple(Edge(n, c, t, tc) for n, s in spec.items() for c, (t, tc) in s.get("refs", {}).items())
    return Database(tables, edges)


def load_task(db: Database, splits: dict[str, DataFrame] | DataFrame, entity: tuple[str, str, str], time: str, target: str, name: str = "task", kind: str = "binary", dry_run: bool = False) -> Task:
    """A task over a database: splits as one relation with ids, linked to its entity table.

    Splits come one by one or as rows with a column ``split``. A dry run keeps
    schemas and no rows, but for the evaluation splits.
    """
    column, table, key = entity
    if dry_run:
        db = Database({n: r.with_df(r.df.limit(0)) for n, r in db.tables.items()}, db.edges)
    if isinstance(splits, DataFrame):
        rows = number_splits(splits.where("split != 'train'") if dry_run else splits, ["train", "val", "test"], [column, time])
    else:
        rows = union_splits({n: d.limit(0) if dry_run and n == "train" else d for n, d in splits.items()}, [column, time])
    rel = Rel(name, rows, ("__task_id",), (time,))
    return Task(db.replace(rel, edges=(*db.edges, Edge(name, column, table, key))), name, column, time, target, kind)


def write_predictions(df: DataFrame, path: str, name: str, run_id: str, eval_mode: str) -> None:
    """A predictions file: run metadata as constant columns, then the fixed ones."""
    fixed = [c for c in PREDICTION_COLUMNS if c in df.columns]
    df.select(F.lit(name).alias("name"), F.lit(run_id).alias("id"), F.lit(eval_mode).alias("eval_mode"), *fixed).write.mode("overwrite").parquet(path)


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    """A predictions file; raises where its columns or constant metadata are off."""
    df = spark.read.parquet(path)
    want = ["name", "id", "eval_mode", *[c for c in PREDICTION_COLUMNS if c in df.columns]]
    if df.columns != want:
        raise ValueError(f"unexpected columns: {df.columns}")
    counts = df.agg(*[F.count_distinct(c) for c in want[:3]]).first()
    if any(n > 1 for n in counts):
        raise ValueError("metadata must be constant")
    return df


def read_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object per line, such as traces and dump indexes."""
    return spark.read.schema(schema).json(path)


def read_flow_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One YAML flow mapping per line, such as ``{name: a, y_pred: 0.5, proba: [0.1, 0.9]}``; fields of the schema, null where absent.

    Values are plain, in single or double quotes, or lists of numbers.
    """
    kinds = StructType.fromDDL(schema)
    value = r"""('(?:[^']|'')*'|"(?:[^"\\]|\\.)*"|\[[^\]]*\]|[^,{}\[\]]*)"""

    def field(name: str, kind) -> Column:
        found = F.trim(F.regexp_extract("value", rf"(?:^\s*\{{|,)\s*['\"]?{re.escape(name)}['\"]?:\s*{value}\s*(?=[,}}])", 1))
        if isinstance(kind, ArrayType):
            return F.from_json(F.nullif(found, F.lit("")), kind.simpleString())
        bare = F.when(found.startswith("'"), F.replace(F.substring(found, F.lit(2), F.length(found) - 2), F.lit("''"), F.lit("'")))
        bare = bare.when(found.startswith('"'), F.substring(found, F.lit(2), F.length(found) - 2)).otherwise(found)
        known = F.when((found == "") | found.isin("null", "~"), None).otherwise(bare)
        return known.cast(kind) if kind.typeName() in ("string", "boolean") else F.when(F.lower(known).isin(".nan", "nan"), F.lit("NaN")).otherwise(known).try_cast(kind)

    return spark.read.text(path).where(F.trim("value") != "").select(*[field(f.name, f.dataType).alias(f.name) for f in kinds])


def read_legacy_predictions(spark: SparkSession, path: str) -> DataFrame:
    """Predictions of the line format before Parquet, in today's columns; raises where a line isn't a prediction."""
    schema = "name string, id string, event string, eval_mode string, cutoff_timestamp string, key bigint, y_true double, y_pred double, task_type string, p_pred double, proba array<double>"
    rows = read_flow_lines(spark, path, schema)
    if not rows.where("event IS NULL OR event != 'prediction'").isEmpty():
        raise ValueError("a line is no prediction")
    return rows.select("name", "id", "eval_mode", *PREDICTION_COLUMNS)


def write_flow_lines(df: DataFrame, path: str) -> None:
    """A row per line as a flow mapping: JSON, which is YAML, with strings in double quotes."""
    df.select(F.to_json(F.struct(*df.columns))).write.mode("overwrite").text(path)


def read_sqlite(spark: SparkSession, paths: list[str], sql: str, schema: str, at_once: int = 10_000) -> DataFrame:
    """Rows of a query over SQLite files, a task for some files each, with the file as column ``path``.

    The files must lie where all executors can open them; they are opened
    read-only and stream in batches.
    """
    kinds = StructType.fromDDL(schema)
    arrow = to_arrow_schema(StructType([*kinds.fields, StructField("path", StringType())]))

    def run(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                with contextlib.closing(sqlite3.connect(f"file:{path}?mode=ro", uri=True)) as db:
                    found = db.execute(sql)
                    while rows := found.fetchmany(at_once):
                        columns = [*zip(*rows), [path] * len(rows)]
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return spark.createDataFrame([(p,) for p in paths], "path string").repartition(max(1, len(paths))).mapInArrow(run, f"{schema}, path string")


#: What a study's trials are, in the tables of the study storage format.
TRIALS_SQL = """SELECT t.number, t.state, t.datetime_start AS start, t.datetime_complete AS complete, v.value
FROM trials t JOIN studies s ON s.study_id = t.study_id LEFT JOIN trial_values v ON v.trial_id = t.trial_id AND v.objective = 0
WHERE s.study_name = '{study}'"""


def read_trials(spark: SparkSession, paths: list[str], study: str) -> DataFrame:
    """A study's trials from SQLite files: number, state, start, complete, duration_s (null while a trial runs), value, path."""
    rows = read_sqlite(spark, paths, TRIALS_SQL.format(study=study.replace("'", "''")), "number bigint, state string, start string, complete string, value double")
    times = {c: F.col(c).cast("timestamp_ntz") for c in ("start", "complete")}
    seconds = F.unix_micros(F.col("complete").cast("timestamp")) - F.unix_micros(F.col("start").cast("timestamp"))
    return rows.withColumns(times).withColumn("duration_s", seconds / 1e6)


def read_objects(spark: SparkSession, path: str, schema: str, required: list[str]) -> DataFrame:
    """One JSON object per file; raises where a required field is missing."""
    df = spark.read.schema(schema).option("multiLine", True).json(path)
    bad = [c for c in required if not df.where(F.col(c).isNull()).isEmpty()]
    if bad:
        raise ValueError(f"missing fields: {bad}")
    return df


def read_csv(spark: SparkSession, path: str, schema: str, sep: str = ",") -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("sep", sep).csv(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def expand_arrays(df: DataFrame, widths: dict[str, int]) -> DataFrame:
    """Array columns as ``name_0, name_1, ...`` for flat files."""
    return df.select(*[x for c in df.columns for x in ([F.get(c, F.lit(i)).alias(f"{c}_{i}") for i in range(widths[c])] if c in widths else [F.col(c)])])


def scan_runs(spark: SparkSession, root: str, schema: str) -> DataFrame:
    """Results of run folders ``root/stage/db_task/[variant]``, with the folders' parts as columns; ensemble members left out."""
    df = spark.read.schema(schema).option("recursiveFileLookup", True).option("pathGlobFilter", "results.json").json(root)
    df = df.withColumn("run_dir", F.regexp_extract("_metadata.file_path", r"^(.*)/results\.json$", 1)).where(~F.col("run_dir").contains("/member_"))
    pick = lambda k: F.nullif(F.regexp_extract("run_dir", rf"/{root.rstrip('/').rpartition('/')[2]}/([^/]+)/([^_/]+)_([^/]+)(?:/([^/]+))?$", k), F.lit(""))
    return df.withColumn("stage", pick(1)).withColumn("db", pick(2)).withColumn("task", pick(3)).withColumn("variant", pick(4))


def scan_durations(spark: SparkSession, path: str, label: str = "DURATION-full-program") -> DataFrame:
    """Seconds of a timed label in trace files, summed by file."""
    lines = spark.read.text(path).withColumn("file", F.col("_metadata.file_path"))
    secs = F.regexp_extract("value", rf"{label}.*duration_s:\s*([0-9.]+)", 1)
    return lines.where(secs != "").groupBy("file").agg(F.sum(secs.cast("double")).alias("duration_s"))


def feature_dump(train: DataFrame, evaluation: DataFrame, target: str) -> DataFrame:
    """Final features of both splits in one table, with ``__split`` and ``__target``."""
    mark = lambda d, s: d.withColumn("__split", F.lit(s)).withColumnRenamed(target, "__target")
    return mark(train, "train").unionByName(mark(evaluation, "eval"))
