"""Reading inference files: <root>/<dataset>/<model>/<run>.json, each a JSON array of problems."""

from __future__ import annotations

import logging
import os
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradeloom.functions import parse
from gradeloom.functions import text as X
from gradeloom.sources import arrays, workbooks
from gradeloom.sources.cache import SCHEMA, ReplyCache
from gradeloom.sources.documents import place
from gradeloom.sources.staging import stage

log = logging.getLogger(__name__)

REQUIRED = ["prediction", "answer"]
TEXT_FIELDS = {"question": "", "context": "", "solution": "", "modality": "text", "field": "", "subfield": ""}


def decoded(path: Column) -> Column:
    """A file's path as it is: Spark tells it with blanks and other signs as %XX (and a plus as it is)."""
    return F.coalesce(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), path)


#: Larger files are read in ranges, by many tasks.
SPLIT_BYTES = 128 << 20


def read_files(spark: SparkSession, paths: str | list[str], recursive: bool = False, split_bytes: int = SPLIT_BYTES, span: int = arrays.RANGE, piece: int = arrays.PIECE) -> DataFrame:
    """(path, modified, items array<variant>, readable, ...) of each file. A file that is no array is kept, as unreadable (S2); one without
    any byte is as good as not there.

    A file of up to split_bytes is a row, parsed by one task. A larger one is cut in pieces by many tasks (sources/arrays.py) and has a row a
    piece: first_idx is the number of its first element, has_points and has_id tell of the whole file.
    """
    options = {"pathGlobFilter": "*.json", "recursiveFileLookup": str(recursive).lower()}
    raw = spark.read.options(**options).text(paths, wholetext=True).select(decoded(F.col("_metadata.file_path")).alias("path"), F.col("_metadata.file_modification_time").alias("modified"), F.col("_metadata.file_size").alias("size"), "value")
    large = spark.read.format("binaryFile").options(**options).load(paths).filter(F.col("length") > split_bytes).select("path", "modificationTime", "length")
    split = _splits(large)
    items = (raw.filter(F.col("size") <= split_bytes) if split else raw).withColumn("items", F.from_json("value", "array<variant>"))
    none = [F.lit(0).cast("long").alias("first_idx"), F.lit(None).cast("boolean").alias("has_points"), F.lit(None).cast("boolean").alias("has_id")]
    whole = items.select("path", "modified", "items", F.col("items").isNotNull().alias("readable"), *none)
    if not split:
        return whole
    parsed = stage(arrays.pieces(spark, large, span, piece), "pieces").withColumn("items", F.from_json("body", "array<variant>"))
    told = parsed.groupBy("path").agg(F.bool_and(F.col("items").isNotNull()).alias("readable"), *[F.bool_or(_has(n)).alias(f"has_{n}") for n in ("points", "id")])
    # One row a large file.
    told = stage(told.join(large.select("path", F.col("modificationTime").alias("modified")), "path"), "large-files")
    own = parsed.filter("items is not null").select("path", "items", "first_idx").join(told.filter("readable"), "path").select("path", "modified", "items", "readable", "first_idx", "has_points", "has_id")
    broken = told.filter("not readable").select("path", "modified", F.lit(None).cast("array<variant>").alias("items"), "readable", F.lit(0).cast("long").alias("first_idx"), "has_points", "has_id")
    return whole.unionByName(own).unionByName(broken)


def _has(name: str) -> Column:
    return F.exists("items", lambda v: F.try_variant_get(v, f"$.{name}", "variant").isNotNull())


def _splits(large: DataFrame) -> bool:
    """Whether there are large files, and their store can be read by places."""
    first = large.first()
    if first is None:
        return False
    try:
        place(first["path"])
    except Exception as e:
        log.warning("large files are read by one task each: %s", e)
        return False
    return True


def keyed(files: DataFrame) -> DataFrame:
    """files with dataset, model and run_id from the path."""
    part = lambda k: F.regexp_extract("path", r"([^/]+)/([^/]+)/([^/]+)\.json$", k)
    return files.withColumns({"dataset": part(1), "model": part(2), "run_id": X.run_name(F.col("path"))})


def newest(files: DataFrame, keys: list[str]) -> DataFrame:
    """Of each group the file that was changed last, then the greatest path (Q1)."""
    best = files.groupBy(keys).agg(F.max(F.struct("modified", "path")).alias("b")).select(*keys, F.col("b.path").alias("path"))
    return files.join(best, [*keys, "path"], "left_semi")


def require_runs(files: DataFrame, what: str) -> DataFrame:
    """The files themselves, if one of them can be read."""
    if files.filter("readable").isEmpty():
        raise ValueError(f"no run of {what} can be read")
    return files


def problems(files: DataFrame, parallelism: int | None = None) -> DataFrame:
    """One row a problem with its place in the file, all fields normalised (P1, P4). Files that can't be read give none.

    points falls back to point only where no problem of the file has points (Q3). A file is read by one task, so rows are dealt
    out anew after the explode if parallelism is given.
    """
    told = {n: F.coalesce(F.col(f"has_{n}"), _has(n)) if f"has_{n}" in files.columns else _has(n) for n in ("points", "id")}
    rows = _elements(files, told["points"].alias("__points"), told["id"].alias("__id"))
    rows = rows.repartition(parallelism) if parallelism else rows
    get = lambda name: F.try_variant_get("v", f"$.{name}", "variant")
    text = lambda name, default=None: F.coalesce(F.nullif(parse.variant_text(get(name)), F.lit("NaN")), F.lit(default))
    key = F.concat_ws("/", "dataset", "model")
    points = F.when(F.col("__points"), parse.variant_points(get("points"))).when(get("point").isNotNull(), parse.variant_points(get("point"))).otherwise(F.array(F.lit(0.0)))
    return rows.select(
        "dataset", "model", "run_id", "path", "idx",
        F.when(F.col("__id"), F.coalesce(text("id"), F.lit("nan"))).otherwise(F.concat(key, F.lit("_"), (F.col("idx") + 1).cast("string"))).alias("question_id"),
        text("prediction").alias("prediction"), parse.variant_list(get("answer")).alias("answer"), *[X.strip(text(n, d)).alias(n) for n, d in TEXT_FIELDS.items()],
        F.when(get("answer_type").isNull(), F.array(F.lit("Open-End"))).otherwise(parse.variant_list(get("answer_type"))).alias("answer_type"), parse.variant_list(get("unit")).alias("unit"),
        points.alias("points"), get("marking").alias("marking"), parse.marking_sets(get("marking")).alias("sets"), parse.valid_marking_variant(get("marking")).alias("valid_marking"),
        F.when(get("prediction").isNull(), "no prediction").when(get("answer").isNull(), "no answer").when(points.isNull(), "points are no numbers").alias("error"),
    )


def _elements(files: DataFrame, *columns: Column) -> DataFrame:
    """A row an element with its number in its file; a piece's first element may be a later one.

    What is told of a whole file is a column before the explode: beside it, it would be told again for each element, and each would carry all items.
    """
    first = F.col("first_idx") if "first_idx" in files.columns else F.lit(0)
    told = files.filter("readable").select("path", "dataset", "model", "run_id", *columns, first.alias("__first"), "items")
    rows = told.select(*told.columns[:-1], F.posexplode("items").alias("__at", "v"))
    return rows.withColumn("idx", (F.col("__first") + F.col("__at")).cast("int")).drop("__first", "__at")


def samples(files: DataFrame) -> DataFrame:
    """P5: verifier samples: the first of the aliases of each field that says something; the rest is meta."""
    rows = _elements(files)
    pick = lambda *names: parse.first_said(*[F.nullif(parse.variant_text(F.try_variant_get("v", f"$.{n}", "variant")), F.lit("NaN")) for n in names])
    entries = F.try_variant_get("v", "$", "map<string,variant>")
    return rows.select(
        F.concat_ws("/", "dataset", "model").alias("dataset"), "run_id", "idx", X.strip(F.coalesce(pick(*ALIASES["id"]), F.lit(""))).alias("id"),
        *[(F.coalesce(pick(*names), F.lit("")) if name == "prediction" else pick(*names)).alias(name) for name, names in ALIASES.items() if name != "id"],
        F.transform_values(F.map_filter(entries, lambda k, _: ~k.isin([n for names in ALIASES.values() for n in names])), lambda _, v: parse.variant_text(v)).alias("meta"),
    )


#: The names a sample's fields go by.
ALIASES = {"id": ["id", "problem_id", "sample_id"], "question": ["question", "prompt", "instruction"], "context": ["context", "passage", "materials"], "prediction": ["prediction", "output", "final_answer", "answer_text"]}


def require(df: DataFrame, columns: list[str] = REQUIRED) -> DataFrame:
    """The frame itself, if it has the columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def from_rows(spark: SparkSession, rows: list[dict], schema: str, validate: bool = True) -> DataFrame:
    """A frame of dicts."""
    df = spark.createDataFrame(rows, schema)
    return require(df) if validate else df


def load(spark: SparkSession, path: str) -> DataFrame:
    """S3: JSON, workbook, Parquet or text, by the name's ending."""
    ending = Path(path).suffix.lower()
    if ending == ".json":
        return spark.read.option("multiLine", True).json(path)
    if ending == ".parquet":
        return spark.read.parquet(path)
    if ending == ".xlsx":
        return workbooks.read(spark, path)
    if ending == ".xls":
        import pandas as pd  # the older binary kind needs a library beside it

        return spark.createDataFrame(pd.read_excel(path))
    return spark.read.text(path)


def statistics_files(spark: SparkSession, root: str) -> DataFrame:
    """Every *multi_run_statistics.json below a folder."""
    reader = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*multi_run_statistics.json")
    return reader.text(root, wholetext=True).select(decoded(F.col("_metadata.file_path")).alias("path"), F.try_parse_json("value").alias("statistics"))


def read_cache(spark: SparkSession, path: str | None) -> DataFrame:
    """The cache, one row a key, or an empty table where there is none; one that cannot be read is an error, so no reply is paid for twice."""
    return ReplyCache(spark, path).read().select("namespace", "key", "value") if path else spark.createDataFrame([], SCHEMA)


def settings(path: str | None = None) -> dict[str, str]:
    """NAME=value lines of a file, with the environment above them."""
    found: dict[str, str] = {}
    if path and Path(path).exists():
        for line in Path(path).read_text().splitlines():
            name, eq, value = line.partition("=")
            if eq and not name.lstrip().startswith("#"):
                found[name.strip()] = value.strip().strip("\"'")
    return found | dict(os.environ)


def anchored(path: str, home: str) -> str:
    """A path below the working folder, or else below home; neither there is an error."""
    for base in (Path.cwd(), Path(home)):
        if (base / path).exists():
            return str(base / path)
    raise FileNotFoundError(path)
