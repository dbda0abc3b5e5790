"""Partner files: landing, formats, checks, staging, quarantine, manifest."""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import incremental, quality
from .ledger import LEDGER, read_staged, stage_transactions


@dataclass(frozen=True)
class Format:
    """How a partner writes files: separator, timestamp pattern (None: ISO), and its names of columns by ours."""

    sep: str = ","
    timestamps: str | None = None
    names: dict[str, str] = field(default_factory=dict)


STANDARD = Format()
TIMES = ("auth_ts", "settle_ts")


def encode(df: DataFrame, fmt: Format) -> DataFrame:
    """Text columns under the partner's names and timestamp pattern."""
    as_text = {c: F.date_format(c, fmt.timestamps or "yyyy-MM-dd'T'HH:mm:ss") if c in TIMES else F.col(c).cast("string") for c in df.columns}
    return df.select(*(as_text[c].alias(fmt.names.get(c, c)) for c in df.columns))


def decode(raw: DataFrame, fmt: Format) -> DataFrame:
    """Our names and ISO timestamps; a timestamp that the pattern doesn't read stays as it is, for the contract to report."""
    ours = {theirs: c for c, theirs in fmt.names.items()}
    out = raw.withColumnsRenamed(ours)
    if fmt.timestamps:
        iso = lambda c: F.coalesce(F.date_format(F.try_to_timestamp(F.col(c), F.lit(fmt.timestamps)), "yyyy-MM-dd'T'HH:mm:ss"), F.col(c))
        out = out.withColumns({c: iso(c) for c in TIMES if c in out.columns})
    return out


def land(df: DataFrame, root: str, fmt: Format = STANDARD) -> None:
    """Files in the partner's format by psp and report date (settle date, else auth date), ordered by id."""
    date = F.coalesce(F.to_date("settle_ts"), F.to_date("auth_ts"))
    theirs = encode(df.select(*LEDGER.names, F.col("psp").alias("source"), date.alias("date")), fmt)
    id_name = fmt.names.get("transaction_id", "transaction_id")
    theirs.repartition("source", "date").sortWithinPartitions("source", "date", id_name).write.mode("append").partitionBy("source", "date").option("header", True).option("sep", fmt.sep).csv(root)


def listed(spark: SparkSession, root: str) -> DataFrame:
    """(file, modified, size) of every CSV file below a folder, without reading any. Files of zero bytes aren't listed: they count as not arrived yet."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(root)
    return found.select(F.col("path").alias("file"), F.col("modificationTime").alias("modified"), F.col("length").alias("size"))


def file_hashes(spark: SparkSession, root: str | list[str]) -> DataFrame:
    """(file, sha256) of every file below a folder, or of the named files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv")
    return found.load(root).select(F.col("path").alias("file"), F.sha2("content", 256).alias("sha256"))


def latest(manifest: DataFrame) -> DataFrame:
    """The last line of each file of the append-only manifest: that of the greatest load number."""
    nth = F.coalesce(F.col("nth"), F.lit(0)) if "nth" in manifest.columns else F.lit(0)
    line = F.max_by(F.struct(*(c for c in manifest.columns if c != "file")), nth).alias("_line")
    return manifest.groupBy("file").agg(line).select("file", "_line.*")


def new_files(found: DataFrame, manifest: DataFrame | None) -> DataFrame:
    """Files whose last line of the manifest hasn't this hash."""
    return found if manifest is None else found.join(latest(manifest).select("file", "sha256"), ["file", "sha256"], "left_anti")


def text_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, line, value): the lines of all files with their numbers, from 1 on.

    A file larger than a partition is read in pieces: lines are numbered within each piece, and pieces are moved by the lines of the pieces before them.
    """
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").text(paths)
    rows = raw.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_piece"), "value").withColumn("_id", F.monotonically_increasing_id())
    pieces = rows.groupBy("file", "_piece").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("file").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    moved = pieces.select("file", "_piece", (before - F.col("_first") + 1).alias("_move"))
    return rows.join(moved, ["file", "_piece"]).select("file", (F.col("_id") + F.col("_move")).alias("line"), "value")


def split_values(value: str, sep: str, most: int) -> Column:
    """The values of a CSV line (quotes are honoured), ``most`` of them; empty ones are null."""
    names = [f"c{i}" for i in range(most)]
    read = F.from_csv(F.col(value), ", ".join(f"{n} string" for n in names), {"sep": sep, "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"})
    return F.array(*(read[n] for n in names))


def headers_of(lines: DataFrame, fmt: Format = STANDARD) -> DataFrame:
    """(file, columns): each file's own header, trimmed and under our names. Files without a line have none."""
    first = lines.where("line = 1").withColumn("value", F.regexp_replace("value", "^\ufeff", ""))
    widest = first.agg(F.max(F.size(F.split("value", F.lit(f"\\Q{fmt.sep}\\E"))))).first()[0] or 1
    ours = F.create_map(*(F.lit(x) for theirs, c in {v: k for k, v in fmt.names.items()}.items() for x in (theirs, c))) if fmt.names else None
    name = (lambda x: F.coalesce(ours[F.trim(x)], F.trim(x))) if ours is not None else F.trim
    size = F.size(F.split("value", F.lit(f"\\Q{fmt.sep}\\E")))
    return first.select("file", F.transform(F.slice(split_values("value", fmt.sep, widest), F.lit(1), size), lambda x: F.coalesce(name(x), F.lit(""))).alias("columns"))


def read_files(spark: SparkSession, root: str | list[str], fmt: Format = STANDARD, headers: DataFrame | None = None) -> DataFrame:
    """All rows as text: the columns of the contract, with file, source, date, line (the header is line 1), ``columns`` (those of the file's own header) and ``extra``.

    Each file is read by its own header: columns may come in any order, one that a file lacks is null, and those that the contract lacks are in ``extra`` as (name, value).
    Files hold no line breaks inside values; blank lines are no rows. ``headers`` are those of ``headers_of``, if they are at hand.
    """
    lines = text_lines(spark, root)
    headers = headers_of(lines, fmt) if headers is None else headers
    widest = headers.agg(F.max(F.size("columns"))).first()[0] or 1
    found = lines.where((F.col("line") > 1) & (F.trim("value") != "")).join(headers, "file").withColumn("_v", split_values("value", fmt.sep, widest))
    at = lambda c: F.array_position("columns", F.lit(c)).cast("int")
    value = lambda c: F.when(at(c) > 0, F.get("_v", at(c) - 1))
    both = F.filter(F.zip_with("columns", "_v", lambda n, v: F.struct(n.alias("name"), v.alias("value"))), lambda x: x["name"].isNotNull() & ~x["name"].isin(*CONTRACT))
    rows = found.select(*(value(c).alias(c) for c in CONTRACT), both.alias("extra"), "file", "line", "columns")
    return decode(dated(rows), Format(fmt.sep, fmt.timestamps))


CONTRACT = {
    "transaction_id": {}, "customer_id": {}, "product_category": {}, "country": {"enum": ("MX", "CO", "AR", "CL")}, "currency": {"enum": ("MXN", "COP", "ARS", "CLP")}, "payer_currency": {"enum": ("MXN", "COP", "ARS", "CLP", "USD")},
    "is_cross_border": {"type": "bool"}, "psp": {"enum": ("PSP_A", "PSP_B", "PSP_C", "PSP_D", "PSP_E"), "same_as": "source"}, "status": {"enum": ("settled", "pending", "failed")}, "auth_ts": {"type": "timestamp"},
    "settle_ts": {"type": "timestamp", "nullable": True}, "authorized_amount": {"type": "int"}, "settled_amount": {"type": "int", "nullable": True}, "item_count": {"type": "int", "min": 1}, "risk_score": {"type": "float", "min": 0, "max": 1},
    "card_bin_country": {}, "merchant_id": {"nullable": True},
}


def header_faults(headers: DataFrame, contract: dict[str, dict] = CONTRACT, strict: bool = True) -> DataFrame:
    """(file, column, problem) from the headers of files: missing and banned columns, repeated ones, and with ``strict`` unexpected ones."""
    wanted, banned = F.array(*map(F.lit, contract)), F.array(*map(F.lit, sorted(quality.BANNED_FIELDS)))
    told = lambda names, problem: F.transform(names, lambda x: F.struct(x.alias("column"), F.lit(problem).alias("problem")))
    is_banned = lambda x: F.array_contains(banned, F.lower(x))
    own = F.filter("columns", lambda x: F.array_contains(wanted, x))
    again = F.filter(F.array_distinct(own), lambda x: F.size(F.filter(own, lambda y: y == x)) > 1)
    kinds = [told(F.array_except(wanted, "columns"), "missing"), told(F.filter("columns", is_banned), "banned"), told(again, "repeated")]
    if strict:
        kinds.append(told(F.filter(F.array_except("columns", wanted), lambda x: ~is_banned(x)), "unexpected"))
    return headers.select("file", F.explode(F.concat(*kinds)).alias("x")).select("file", "x.*")


def split_good(rows: DataFrame, contract: dict[str, dict] = CONTRACT, strict: bool = True, headers: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows of good files, rows of bad files without banned columns, reasons). ``headers`` (file, columns) are those of all files, also of files without rows."""
    if "columns" not in rows.columns:
        reasons = quality.contract_check(rows, contract)
    else:
        headers = rows.select("file", "columns").distinct() if headers is None else headers
        values = quality.contract_check(rows, contract)
        lacking = header_faults(headers, contract, strict)
        there = values.join(lacking.where("problem = 'missing'").select("file", "column"), ["file", "column"], "left_anti")
        reasons = there.unionByName(lacking, allowMissingColumns=True)
    bad = reasons.select("file").distinct()
    return rows.join(bad, "file", "left_anti"), quality.redact(rows.join(bad, "file", "left_semi")), reasons


def write_staged(good: DataFrame, root: str) -> None:
    """Typed rows by month, source and date of their file; a file delivered again replaces what it brought before."""
    typed = good.select(*(F.col(f.name).cast(f.dataType) for f in LEDGER), F.date_format("date", "yyyy-MM").alias("settle_month"), F.col("source").alias("file_psp"), F.col("date").alias("file_date"))
    typed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd").partitionBy("settle_month", "file_psp", "file_date").parquet(root)


def file_inventory(rows: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """(file, source, date, rows, settled, columns) of files as ``read_files`` gives them, each with its own columns; with ``headers`` also of files without rows."""
    n = rows.groupBy("file").agg(F.count("*").alias("rows"), F.count_if(F.lower(F.trim("status")) == "settled").alias("settled"))
    headers = rows.select("file", "columns").distinct() if headers is None else headers
    return dated(headers.join(n, "file", "left").na.fill(0, ["rows", "settled"])).select("file", "source", "date", "rows", "settled", "columns")


def in_range(files: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Files whose date lies in the range, both ends included and either end open; used to process them again."""
    return files.where(_inside(date_from, date_to))


def _inside(date_from: str | None, date_to: str | None) -> Column:
    day = F.col("date").cast("date")
    low = F.lit(True) if date_from is None else day >= F.lit(date_from).cast("date")
    high = F.lit(True) if date_to is None else day <= F.lit(date_to).cast("date")
    return low & high


def dated(found: DataFrame) -> DataFrame:
    """Files with their source and date, from the folders that they lie in."""
    part = lambda name: F.nullif(F.regexp_extract("file", f"/{name}=([^/]+)/", 1), F.lit(""))
    return found.withColumns({"source": part("source"), "date": part("date").cast("date")})


def write_quarantine(bad: DataFrame, reasons: DataFrame, root: str) -> None:
    """Rows of bad files (without banned columns) and the reasons, by source and date; a file delivered again replaces what it brought before."""
    rows = quality.redact(bad)
    if "extra" in rows.columns:
        hidden = F.array(*map(F.lit, sorted(quality.BANNED_FIELDS)))
        rows = rows.withColumn("extra", F.filter("extra", lambda x: ~F.array_contains(hidden, F.lower(x["name"]))))
    put = lambda df, name: df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source", "date").parquet(f"{root}/{name}")
    put(rows, "rows")
    put(dated(reasons), "reasons")


def cleared(spark: SparkSession, root: str, name: str, keys: DataFrame, source: str, date: str) -> None:
    """Empties the partitions of a stored table that ``keys`` (source, date) name, if there are any: a fixed file leaves quarantine, a bad one leaves the staged rows."""
    path = f"{root}/{name}" if name else root
    if not exists(spark, path):
        return
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(conf)
    for r in keys.select("source", F.col("date").cast("string").alias("date")).distinct().toLocalIterator():
        for found in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}{'' if name else '/settle_month=*'}/{source}={r.source}/{date}={r.date}")) or []:
            fs.delete(found.getPath(), True)


def exists(spark: SparkSession, path: str) -> bool:
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder)


def staged_folders(spark: SparkSession, root: str) -> DataFrame:
    """(source, date) of what is really stored below ``root``, from the names of its folders."""
    if not exists(spark, root):
        return spark.createDataFrame([], "source string, date date")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(root).select("path")
    part = lambda name: F.regexp_extract("path", f"/{name}=([^/]+)/", 1)
    return files.select(part("file_psp").alias("source"), part("file_date").cast("date").alias("date")).distinct()


def to_load(spark: SparkSession, landing: str, root: str, manifest: DataFrame, force: tuple[str | None, str | None] | None = None) -> DataFrame:
    """(file, modified, size, sha256, source, date) of the files to be processed, with all files of their source and date, whose rows share a stored part.

    Those whose hash isn't that of their last line of the manifest; those whose last line says staged although nothing is stored for them; those of forced
    dates. Only files whose time or size isn't that of their last line are read for their hash.
    """
    found, last = dated(listed(spark, landing)), latest(manifest)
    told = found.join(last.select("file", "sha256", "status", "rows", F.col("modified").alias("_modified"), F.col("size").alias("_size")), "file", "left")
    touched = ~(F.col("modified").eqNullSafe(F.col("_modified")) & F.col("size").eqNullSafe(F.col("_size")))
    told = told.withColumn("touched", touched)
    stored = staged_folders(spark, f"{root}/staged").withColumn("stored", F.lit(True))
    named = [r.file for r in told.where("touched").select("file").limit(MOST_FILES + 1).collect()]
    hashes = file_hashes(spark, named if len(named) <= MOST_FILES else landing).withColumnRenamed("sha256", "now") if named else spark.createDataFrame([], "file string, now string")
    base = told.join(hashes, "file", "left").join(stored, ["source", "date"], "left").withColumn("now", F.coalesce("now", "sha256"))
    lost = (F.col("status") == "staged") & (F.col("rows") > 0) & F.col("stored").isNull()
    due = F.col("status").isNull() | (F.col("now") != F.col("sha256")) | lost
    if force is not None:
        due = due | _inside(*force)
    keys = base.where(F.coalesce(due, F.lit(True))).select("source", "date").distinct()
    same = F.col("t.source").eqNullSafe(F.col("k.source")) & F.col("t.date").eqNullSafe(F.col("k.date"))
    return base.alias("t").join(keys.alias("k"), same, "left_semi").select("file", "modified", "size", F.col("now").alias("sha256"), "source", "date")


def load_landing(spark: SparkSession, landing: str, root: str, fmt: Format = STANDARD, contract: dict[str, dict] = CONTRACT, force: tuple[str | None, str | None] | None = None, strict: bool = True) -> DataFrame:
    """Stages new and changed files below ``root`` and returns what was done, the lines that the manifest got.

    The manifest is appended to only; a file's state is its last line, compared with what is stored (see ``to_load``). ``force`` (from, to) takes files of
    these dates again. Good files are staged and leave quarantine; bad ones are quarantined as a whole and their older good version leaves the staged rows. With
    ``strict`` a file with a column that the contract lacks is bad, else the column is left out and only reported. New parts are written before old ones go and the
    manifest comes last, so that a load that breaks off leaves no file without rows and is made again by the next one.
    """
    manifest, load = read_manifest(spark, root), uuid.uuid4().hex
    # what is due is written down: it depends on what is stored, which the load changes
    to_load(spark, landing, root, manifest, force).write.parquet(f"{root}/loads/{load}")
    todo = spark.read.parquet(f"{root}/loads/{load}")
    names = [r.file for r in todo.select("file").limit(MOST_FILES + 1).collect()]
    if not names:
        return spark.createDataFrame([], MANIFEST)
    paths = names if len(names) <= MOST_FILES else landing
    headers = headers_of(text_lines(spark, paths).join(todo.select("file"), "file", "left_semi"), fmt).persist()
    rows = read_files(spark, paths, fmt, headers).persist()
    good, bad, reasons = split_good(rows, contract, strict, headers)
    reasons = reasons.persist()
    faulty_files = reasons.select("file").distinct()
    keys = lambda df: df.select("source", "date").distinct().persist()
    fine, faulty = keys(todo.join(faulty_files, "file", "left_anti")), keys(todo.join(faulty_files, "file", "left_semi"))
    if not good.isEmpty():
        write_staged(good, f"{root}/staged")
    if not faulty.isEmpty():
        write_quarantine(bad, reasons, f"{root}/quarantine")
    cleared(spark, f"{root}/staged", "", faulty.subtract(good.select("source", "date")), "file_psp", "file_date")
    for name in ("rows", "reasons"):
        cleared(spark, f"{root}/quarantine", name, fine.subtract(faulty), "source", "date")
    nth = (manifest.agg(F.max("nth")).first()[0] or 0) + 1
    lines = manifest_lines(todo, rows, reasons, headers).withColumns({"load": F.lit(load), "nth": F.lit(nth).cast("bigint")})
    lines.select([c.split()[0] for c in MANIFEST.split(", ")]).write.mode("append").json(f"{root}/manifest")
    for held in (rows, headers, reasons, fine, faulty):  # the same folders are read anew the next time
        held.unpersist()
    return read_manifest(spark, root).where(F.col("nth") == nth)


#: Files that are read by name; beyond that the whole landing is read and the files are looked up.
MOST_FILES = 100_000
MANIFEST = "file string, sha256 string, modified timestamp, size bigint, source string, date date, rows bigint, settled bigint, columns array<string>, status string, target string, load string, nth bigint"


def read_manifest(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{root}/manifest") if exists(spark, f"{root}/manifest") else spark.createDataFrame([], MANIFEST)


def manifest_lines(files: DataFrame, rows: DataFrame, reasons: DataFrame, headers: DataFrame | None = None) -> DataFrame:
    """A line for each file: what it holds and where it went."""
    n = file_inventory(rows, headers).select("file", "rows", "settled", "columns")
    bad = reasons.select("file", F.lit(True).alias("bad")).distinct()
    told = files.join(n, "file", "left").join(bad, "file", "left").na.fill(0, ["rows", "settled"])
    state = F.when(F.col("bad"), "quarantined").otherwise("staged")
    return told.select(*files.columns, "rows", "settled", "columns", state.alias("status"), F.when(F.col("bad"), "quarantine").otherwise("staged").alias("target"))


def ingest_report(files: DataFrame, sources: list[str], as_of: str | None = None, most_days: int = 2, fail: bool = True, contract: dict[str, dict] = CONTRACT) -> DataFrame:
    """(nth, check_name, source, status, detail) in fixed order: freshness, volume and columns of each source, quarantine, and all together.

    ``files`` has a row for each file: source, date, settled, columns, status (the last lines of the manifest, or ``file_inventory`` with a status). ``as_of`` is the latest file date
    unless given; files after it don't count. Volume is that of settled rows, for each source from its first file up to that day. With ``fail`` a failed check is an error.
    """
    spark = files.sparkSession
    day = F.coalesce(F.lit(as_of).cast("date"), F.max("date"))
    as_of = str(files.agg(day).first()[0])
    files = files.where(F.col("date") <= F.lit(as_of).cast("date")).withColumn("psp", F.col("source")).persist()
    known = spark.createDataFrame([(s,) for s in sources], "psp string").union(files.select("psp")).where("psp is not null").distinct()
    fresh = quality.freshness(files, [r.psp for r in known.collect()], as_of, most_days)  # one row a source
    daily = files.groupBy("psp", F.col("date").alias("day")).agg(F.sum("settled").alias("n"))
    volume = quality.volume_check(quality.volume_flags(daily, "psp", upto=as_of), "psp")
    drift = quality.schema_drift(files.where("columns is not null").select("psp", "columns"), list(contract))
    held = quality.quarantine_check(files)
    listed_ = lambda c, word: F.when(F.size(c) > 0, F.concat(F.lit(word), F.array_join(c, ", ")))
    row = lambda nth, name, source, status, detail: (F.lit(nth).alias("nth"), F.lit(name).alias("check_name"), source.alias("source"), status.alias("status"), detail.alias("detail"))
    lines = [
        fresh.select(*row(1, "freshness", F.col("psp"), F.col("status"), F.coalesce(F.concat(F.lit("latest "), F.col("latest").cast("string")), F.lit("no file")))),
        volume.select(*row(2, "volume", F.col("psp"), F.col("status"), F.array_join(F.transform("days", lambda x: x.cast("string")), ", "))),
        known.join(files.select("psp").distinct(), "psp", "left_semi").join(drift, "psp", "left").select(*row(3, "columns", F.col("psp"), F.when(F.col("n_files") > 0, "WARN").otherwise("PASS"), F.concat_ws("; ", listed_("new", "new: "), listed_("missing", "missing: ")))),
        held.select(*row(4, "quarantine", F.lit("*"), F.col("status"), F.col("n_files").cast("string"))),
    ]
    told = reduce(DataFrame.unionByName, lines).collect()  # a few rows a source
    files.unpersist()
    total = next((x for x in ("FAIL", "WARN") if x in {r.status for r in told}), "PASS")
    if fail and total == "FAIL":
        raise ValueError(f"ingest checks failed: {sorted(f'{r.check_name} {r.source}' for r in told if r.status == 'FAIL')}")
    return spark.createDataFrame([*sorted(map(tuple, told)), (5, "overall", "*", total, as_of)], "nth int, check_name string, source string, status string, detail string")


def replay_range(spark: SparkSession, landing: str, root: str, date_from: str, date_to: str, as_of: str, build, prev_fact: DataFrame, fmt: Format = STANDARD, sources: list[str] | None = None, most_days: int = 2) -> DataFrame:
    """Loads the files of a range again, checks what has arrived up to its end (a failed check is an error), and brings the fact up to date from ``date_from`` on; ``build`` makes fact rows of staged rows.

    ``sources`` are those that must have files; without them, those that the manifest names.
    """
    load_landing(spark, landing, root, fmt, force=(date_from, date_to))
    ingest_report(latest(read_manifest(spark, root)), sources or [], date_to, most_days)
    staged = stage_transactions(read_staged(spark, f"{root}/staged"))
    return incremental.incremental_fact(staged, prev_fact, build, incremental.replay_lookback(date_from, as_of))


def append_manifest(files: DataFrame, rows: DataFrame, reasons: DataFrame, path: str) -> None:
    manifest_lines(files, rows, reasons).write.mode("append").json(path)
