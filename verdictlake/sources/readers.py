"""Sources: the problem catalogue, submission files, problem statements, and the reports themselves."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdictlake.sources import schemas

#: Files this small hold a header at most.
LEAST_BYTES = 50


def load_problem_list(spark: SparkSession, path: str, header_schema=schemas.PROBLEMS) -> DataFrame:
    """The catalogue with ``source_pos``, its order in the file: contests list problems by difficulty.

    ``path`` is one CSV file; the order is taken from the reader's position within it. Raises ValueError
    for anything else, as several files have no order among them.
    """
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(place).isFile():
        raise ValueError(f"{path} is not one file, so it has no order")
    rows = spark.read.schema(header_schema).option("header", True).option("enforceSchema", False).csv(path)
    return rows.withColumn("source_pos", F.monotonically_increasing_id())


def load_site_problems(spark: SparkSession, path: str, dataset: str) -> DataFrame:
    """The catalogue of one judge site; rows without a site are dropped."""
    return load_problem_list(spark, path).where(F.col("dataset") == dataset)


def existing(spark: SparkSession, paths: Iterable[str], least: int = LEAST_BYTES) -> list[str]:
    """Those paths that exist on their file system and hold more than ``least`` bytes; each folder is listed once."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    wanted: dict[str, list[str]] = {}
    for p in paths:
        wanted.setdefault(p.rpartition("/")[0], []).append(p)
    out = []
    for folder, members in wanted.items():
        place = jvm.org.apache.hadoop.fs.Path(folder or ".")
        fs = place.getFileSystem(conf)
        listed = fs.listStatus(place) if fs.exists(place) else []
        sizes = {f.getPath().getName(): f.getLen() for f in listed if f.isFile()}
        out += [p for p in members if sizes.get(p.rpartition("/")[2], least) > least]
    return out


def load_submissions(spark: SparkSession, folder: str, problem_ids: Iterable[str], columns: list[str] | None = None) -> DataFrame:
    """One scan over the submission files of the problems; missing and header-only files are passed over.

    Raises ValueError if no file is usable. ``columns`` prunes the scan. A file whose header names other
    columns, or the same in another order, fails the scan instead of being read by position.
    """
    wanted = list(problem_ids)
    paths = existing(spark, [f"{folder.rstrip('/')}/{p}.csv" for p in wanted])
    if not paths:
        raise ValueError(f"none of {len(wanted)} submission files is usable in {folder}")
    rows = spark.read.schema(schemas.SUBMISSIONS).option("header", True).option("enforceSchema", False).option("mode", "PERMISSIVE").csv(paths)
    return rows.select(*columns) if columns else rows


def corrupt_submissions(spark: SparkSession, folder: str, problem_ids: Iterable[str]) -> DataFrame:
    """(problem_id, n_rows, n_corrupt, checksum) of each usable file: rows that do not fit the schema, whose bad
    fields read as null, and a checksum of all that was read."""
    paths = existing(spark, [f"{folder.rstrip('/')}/{p}.csv" for p in problem_ids])
    if not paths:
        return spark.createDataFrame([], "problem_id string, n_rows long, n_corrupt long, checksum long")
    schema = T.StructType([*schemas.SUBMISSIONS.fields, T.StructField("_corrupt_record", T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").csv(paths)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    # every column is read, as only fields that are read are held against the schema
    seen = rows.select(name.alias("problem_id"), F.col("_corrupt_record").isNotNull().alias("bad"), F.xxhash64(*[c for c in rows.columns if c != "_corrupt_record"]).alias("all"))
    return seen.groupBy("problem_id").agg(F.count("*").alias("n_rows"), F.count_if("bad").alias("n_corrupt"), F.bit_xor("all").alias("checksum"))


def load_statements(spark: SparkSession, folder: str, problem_ids: Iterable[str]) -> DataFrame:
    """(problem_id, html) of the statements that exist, one file each."""
    paths = existing(spark, [f"{folder.rstrip('/')}/{p}.html" for p in problem_ids], least=-1)
    if not paths:
        return spark.createDataFrame([], "problem_id string, html string")
    rows = spark.read.text(paths, wholetext=True)
    return rows.select(F.regexp_replace(F.col("_metadata.file_name"), r"\.html$", "").alias("problem_id"), F.col("value").alias("html"))


def load_report(spark: SparkSession, path: str, schema) -> DataFrame:
    """A report written earlier."""
    return spark.read.schema(schema).option("header", True).csv(path)
