"""Identifiers and banned fields in written files, by zone; values are never shown."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import BANNED_FIELDS
from .ingest import exists, text_lines

CUSTOMER_ID = r"\bcus_[0-9a-f]{12}\b"
TEXTS, RECORDS = "*.{csv,json,jsonl,md,html,txt}", "*.{json,jsonl}"
#: Keys of JSON objects, nested ones as well; a key inside a text value has a backslash before its closing quote.
KEY = r'"([^"\\]+)"\s*:'
HITS = "zone string, file string, problem string, field string, n bigint"


def field_names(kind: T.DataType, of: str = "") -> list[str]:
    """Names of all fields, those inside structs, arrays and maps with the path to them."""
    if isinstance(kind, T.StructType):
        return [x for f in kind for name in [f"{of}{f.name}"] for x in (name, *field_names(f.dataType, f"{name}."))]
    if isinstance(kind, T.ArrayType):
        return field_names(kind.elementType, of)
    return field_names(kind.valueType, of) if isinstance(kind, T.MapType) else []


def is_banned(name: str) -> bool:
    return name.rsplit(".", 1)[-1].strip().lower() in BANNED_FIELDS


def counted(rows: DataFrame, zone: str, pattern: str) -> DataFrame:
    """Files whose lines (file, value) hold identifiers, with how many."""
    n = F.sum(F.regexp_count("value", F.lit(pattern))).cast("bigint")
    return rows.groupBy("file").agg(n.alias("n")).where("n > 0").select(F.lit(zone).alias("zone"), "file", F.lit("identifier").alias("problem"), F.lit(None).cast("string").alias("field"), "n")


def named(names: DataFrame, zone: str) -> DataFrame:
    """Banned ones of (file, field)."""
    found = names.where(F.lower(F.trim("field")).isin(*BANNED_FIELDS)).groupBy("file", "field").agg(F.count("*").alias("n"))
    return found.select(F.lit(zone).alias("zone"), "file", F.lit("banned field").alias("problem"), "field", "n")


def files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """Paths of the files below a folder, which are listed only."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder).select(F.col("path").alias("file"))


def scan_zone(spark: SparkSession, zone: str, folder: str, is_output: bool, pattern: str = CUSTOMER_ID) -> DataFrame:
    """``HITS`` of one folder with all that is below it."""
    none = spark.createDataFrame([], HITS)
    if not exists(spark, folder):
        return none
    parts = [none]
    lines = lambda glob: spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", glob).text(folder).select(F.col("_metadata.file_path").alias("file"), "value")
    if not files(spark, folder, "*.csv").isEmpty():
        header = text_lines(spark, folder).where("line = 1")
        parts.append(named(header.select("file", F.explode(F.transform(F.split("value", "[,;\\t|]"), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, '"', ""), "^\ufeff", "")))).alias("field")), zone))
    if not files(spark, folder, RECORDS).isEmpty():
        parts.append(named(lines(RECORDS).select("file", F.explode(F.regexp_extract_all("value", F.lit(KEY), 1)).alias("field")), zone))
    if is_output and not files(spark, folder, TEXTS).isEmpty():
        parts.append(counted(lines(TEXTS), zone, pattern))
    # a table is a folder with Parquet files, without the folders of its partitions; one footer of each is read here
    table = F.regexp_extract("file", r"^(.*?)(?:/[^/=]+=[^/]*)*/[^/]+$", 1)
    for r in files(spark, folder, "*.parquet").select(table.alias("table")).distinct().orderBy("table").collect():
        df = spark.read.parquet(r.table)
        names = [n for n in field_names(df.schema) if is_banned(n)]
        if names:
            parts.append(spark.createDataFrame([(zone, r.table, "banned field", n, 1) for n in names], HITS))
        if is_output:
            parts.append(counted(df.select(F.col("_metadata.file_path").alias("file"), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns))).alias("value")), zone, pattern))
    return reduce(DataFrame.unionByName, parts)


def scan_written(spark: SparkSession, zones: dict[str, tuple[str, bool]], pattern: str = CUSTOMER_ID, fail: bool = False) -> DataFrame:
    """``HITS`` over all zones: name -> (folder, whether it is an output). A zone whose folder isn't there has none.

    Banned fields must be nowhere: in no CSV header, no JSON key and no Parquet column, nested ones included. Full identifiers may lie in inputs but never in outputs, whose texts and
    Parquet rows are searched. With ``fail`` any hit is an error, which names files and fields only.
    """
    re.compile(pattern)
    found = reduce(DataFrame.unionByName, (scan_zone(spark, zone, folder, out, pattern) for zone, (folder, out) in zones.items()), spark.createDataFrame([], HITS))
    if fail and (hits := found.orderBy("zone", "file", "problem", "field").limit(20).collect()):
        raise ValueError("; ".join(f"{r.zone}: {r.file}: {r.problem} {r.field or ''}".strip() for r in hits))
    return found
