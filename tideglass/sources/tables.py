"""Reading and writing of the files and tables that the engine's state lives in."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from tideglass.session import cut
from tideglass.sources.versions import VersionedTable


def _fs(spark: SparkSession, path: str) -> tuple:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def read_json(spark: SparkSession, path: str, default: object = None) -> object:
    """A small JSON file, whole; ``default`` where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return default
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def write_json(spark: SparkSession, path: str, value: object) -> None:
    """A small value as JSON with sorted keys and a line end, put in place when it is complete."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, path + ".tmp")
    text = json.dumps(value, ensure_ascii=False, sort_keys=True, indent=2, default=lambda o: sorted(o) if isinstance(o, set | frozenset) else o.isoformat()) + "\n"
    out = fs.create(tmp, True)
    out.write(bytearray(text.encode()))
    out.close()
    jvm = spark.sparkContext._jvm
    kinds = jvm.org.apache.hadoop.fs.Options.Rename
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    # (one step, so that a reader finds the old file or the new one)
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.makeQualified(p).toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(fs.makeQualified(tmp), fs.makeQualified(p), over)


def read_jsonl(spark: SparkSession, path: str, schema: str, corrupt: str | None = None) -> DataFrame:
    """Rows of JSON lines; a folder that isn't there has none. Lines that can't be read are left out, or kept in a column named ``corrupt``."""
    try:
        if corrupt:
            return spark.read.schema(f"{schema}, {corrupt} string").option("columnNameOfCorruptRecord", corrupt).json(path)
        return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema + (f", {corrupt} string" if corrupt else ""))


def write_jsonl(df: DataFrame, path: str) -> int:
    """Lines with sorted keys and all nulls; the number of lines."""
    seen = Observation()
    df.select(canonical_json(df).alias("value")).observe(seen, F.count(F.lit(1)).alias("n")).write.mode("overwrite").text(path)
    return seen.get["n"]


def _sorted(column: Column, kind: DataType) -> Column:
    """A value with the fields of all its structs in alphabetical order."""
    if isinstance(kind, StructType):
        fields = [_sorted(column[f.name], f.dataType).alias(f.name) for f in sorted(kind.fields, key=lambda f: f.name)]
        return F.when(column.isNotNull(), F.struct(*fields)) if fields else column
    if isinstance(kind, ArrayType) and isinstance(kind.elementType, StructType | ArrayType):
        return F.transform(column, lambda x: _sorted(x, kind.elementType))
    return column


def canonical_json(df: DataFrame) -> Column:
    """A row as JSON with keys in alphabetical order on all levels, nulls included."""
    return F.to_json(F.struct(*[_sorted(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in sorted(df.schema.fields, key=lambda f: f.name)]), {"ignoreNullFields": "false"})


@F.arrow_udf(StringType())
def _cp932(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    """Spark reads no Japanese Windows code page."""
    for contents in batches:
        yield pa.array([None if c is None else bytes(c).decode("cp932", "replace") for c in contents.to_pylist()], pa.string())


def read_holidays(spark: SparkSession, path: str) -> DataFrame:
    """day, name of the published holiday list: comma-separated, in the Japanese Windows code page. The heading and lines without a day are left out; a list without a holiday is an error."""
    text = spark.read.format("binaryFile").load(path).select(F.explode(F.split(_cp932(F.col("content")), r"\r?\n")).alias("line"))
    parts = F.split("line", ",")
    day = F.regexp_replace(F.trim(parts[0]), "-", "/")
    rows = text.filter((F.size(parts) >= 2) & day.rlike(r"^\d{4}/\d{1,2}/\d{1,2}$")).select(F.try_to_date(day, "yyyy/M/d").alias("day"), F.trim(parts[1]).alias("name")).filter("day IS NOT NULL")
    rows = rows.groupBy("day").agg(F.last("name").alias("name"))
    if rows.isEmpty():
        raise ValueError(f"{path} has no holidays")
    return rows


# How a page or its header names its character set; names that servers give without knowing.
META, HEADER = rb"""<meta[^>]+charset\s*=\s*["']?\s*([A-Za-z0-9_\-]+)""", r"""charset\s*=\s*["']?\s*([A-Za-z0-9_\-]+)"""
WEAK = {"iso8859-1", "cp1252", "ascii"}
#: Tried in this order where nothing is named.
TRIED = ("utf-8", "iso2022_jp", "cp932", "euc_jp")


def _decoded(content: bytes, content_type: str | None, first: str | None) -> tuple[str, str]:
    import codecs
    import re

    from tideglass.functions.forms import CHARSETS

    if content.startswith(codecs.BOM_UTF8):
        return content[3:].decode("utf-8", "replace"), "utf-8"
    meta, header = re.search(META, content[:8192], re.I), re.search(HEADER, content_type or "", re.I)
    named = [first, meta and meta[1].decode("ascii", "ignore"), header and header[1]]
    for name in [*(CHARSETS.get(n.lower()) for n in named if n), *TRIED]:
        if name and name not in WEAK:
            try:
                return content.decode(name), name
            except (UnicodeDecodeError, LookupError):
                continue
    return content.decode("utf-8", "replace"), "utf-8"


@F.arrow_udf(StructType([StructField("text", StringType()), StructField("encoding", StringType())]))
def decode_html(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    """text and encoding of the bytes of a page, its content type, and the encoding that was stored with it (or NULL).

    A byte order mark decides, then the stored name, the page's own, the header's, then what the bytes can be; else UTF-8 with replacements.
    """
    for contents, types, stored in batches:
        got = [_decoded(bytes(c or b""), t, s) for c, t, s in zip(contents.to_pylist(), types.to_pylist(), stored.to_pylist(), strict=True)]
        yield pa.StructArray.from_arrays([pa.array([t for t, _ in got], pa.string()), pa.array([e for _, e in got], pa.string())], ["text", "encoding"])


def read_raw(spark: SparkSession, path: str) -> DataFrame:
    """source_id, url, content, content_type, encoding, content_hash, fetched_at and text of stored pages."""
    rows = spark.read.parquet(path)
    stored = F.when(F.col("encoding") != "binary", F.col("encoding"))
    return rows.withColumn("text", decode_html(F.col("content"), F.col("content_type"), stored)["text"])


def matches_state(states: DataFrame, raw: DataFrame) -> DataFrame:
    """states (source_id, url, content_hash) with current: whether the stored page is the one that the state tells of. Without a stored page or a hash it isn't."""
    kept = raw.groupBy("source_id", "url").agg(F.max_by("content_hash", "fetched_at").alias("_stored"))
    return states.join(kept, ["source_id", "url"], "left").withColumn("current", F.coalesce(F.col("_stored") == F.col("content_hash"), F.lit(False))).drop("_stored")


def read_facts(spark: SparkSession, path: str, grain: str, since: str | None = None, version: int | None = None) -> DataFrame:
    """Facts of a grain, with their grain and month, from a table with versions; only the months from ``since`` on are opened."""
    wanted = lambda v: v["grain"] == grain and (since is None or (v["month"] or "") >= since[:7])
    rows = VersionedTable(spark, path).read(version, wanted)
    return rows if since is None else rows.filter(F.col("day") >= F.lit(since).cast("date"))


def write_facts(df: DataFrame, path: str, grain: str, replace_days: list[str] = ()) -> int:
    """Put facts (day and further columns) into the table of ``read_facts`` in place of all rows of ``replace_days``, whether or not there are new rows of these days; the number of the new version.

    Only months that have such days or new rows are written again; a month that is left without rows goes. Facts of other days stay. Until all is written, and if it never is, readers see the table as it was.
    """
    table = VersionedTable(df.sparkSession, path)
    fresh = cut(df.withColumn("grain", F.lit(grain)).withColumn("month", F.date_format("day", "yyyy-MM")))
    months = {d[:7] for d in replace_days} | {r.month for r in fresh.select("month").distinct().collect()}  # (a few; a day comes in one month)
    touched = lambda v: v["grain"] == grain and v["month"] in months

    def make(last: dict) -> tuple:
        rows = fresh
        if any(touched(p["values"]) for p in last["parts"]):
            kept = table.read(last["version"], touched).filter(~F.col("day").cast("string").isin(list(replace_days)))
            rows = fresh.unionByName(kept, allowMissingColumns=True)
        return rows, touched

    return table.change(make, ["grain", "month"])


def upsert_by_key(df: DataFrame, path: str, keys: list[str], order: Column | None = None) -> int:
    """Rows in place of those with the same keys in the versioned table at ``path``, which is made where it isn't there; state counts of a day, url states and the like are kept so. Of new rows with the same keys the last by ``order`` counts."""
    return VersionedTable(df.sparkSession, path).upsert(df, keys, order)


def load_ledger(spark: SparkSession, path: str, layout: str = "") -> tuple[DataFrame, bool]:
    """path, fingerprint, lastmod of the pages of the last build, and whether fingerprints have to be learnt anew, as the layout is another one than then. A ledger without a layout is never learnt anew."""
    table = VersionedTable(spark, path)
    stored = table.manifest()["info"].get("layout", "")
    return table.read(schema="path string, fingerprint string, lastmod date"), bool(layout and stored and layout != stored)


def save_ledger(built: DataFrame, path: str, layout: str = "") -> int:
    """The pages of a build (as ``crawl.ledger`` gives them) as the next version of the ledger; pages that weren't built are no longer in it."""
    return VersionedTable(built.sparkSession, path).write(built.select("path", "fingerprint", "lastmod"), info={"layout": layout})


def layout_key(spark: SparkSession, folders: list[str], version: int = 1) -> str:
    """One digest of all files of some folders, by their order and names: it changes with each change of what pages look like, or of how fingerprints are made (``version``). Folders that aren't there count as empty.

    Each file is digested where it is read; only names and digests come together.
    """
    parts = None
    for i, folder in enumerate(folders):
        fs, p = _fs(spark, folder)
        if not fs.exists(p):
            continue
        base = fs.makeQualified(p).toUri().getPath().rstrip("/") + "/"
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
        name = F.substring_index("path", base, -1)
        some = files.select(F.lit(i).alias("n"), name.alias("name"), F.sha2("content", 256).alias("digest"))
        parts = some if parts is None else parts.unionByName(some)
    if parts is None:
        lines = ""
    else:
        each = F.transform(F.array_sort(F.collect_list(F.struct("n", "name", "digest"))), lambda f: F.concat_ws(" ", f["n"], f["digest"], f["name"]))
        lines = parts.agg(F.sha2(F.array_join(each, "\n"), 256).alias("d")).first().d
    return "sha256:" + hashlib.sha256(f"v{version}\n{lines}".encode()).hexdigest()


def read_records(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Records of JSON lines by id; rows without an id are left out."""
    return read_jsonl(spark, path, schema).filter("record_id IS NOT NULL AND record_id <> ''").orderBy("record_id")


def save_records(df: DataFrame, path: str) -> int:
    """Records as the lines that ``read_records`` reads, by id, with the records of the last line of an id; the number of lines. Complete before the old lines go."""
    once = df.filter("record_id IS NOT NULL AND record_id <> ''").groupBy("record_id").agg(F.max_by(F.struct(*(F.col(f"`{c}`") for c in df.columns)), F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)))).alias("_r"))
    return write_jsonl(once.select("_r.*").orderBy("record_id"), path)


def read_assets(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """The registered pictures, one for each id (that of the last line), and the lines that couldn't be read."""
    rows = read_jsonl(spark, path, schema, "_broken")
    # (a path that isn't there has no files to tell of)
    place = F.struct("_metadata.file_modification_time", "_metadata.file_path", F.monotonically_increasing_id()) if rows.inputFiles() else F.lit(0)
    rows = rows.select("*", place.alias("_at"))
    good = rows.filter("_broken IS NULL AND asset_id IS NOT NULL").groupBy("asset_id").agg(F.max_by(F.struct("*"), "_at").alias("_last"))
    return good.select("_last.*").drop("_broken", "_at"), rows.filter("_broken IS NOT NULL OR asset_id IS NULL").select("_broken")


def add_assets(df: DataFrame, path: str) -> None:
    """Further pictures behind those that are registered; the last of an id counts when they are read."""
    df.select(canonical_json(df).alias("value")).write.mode("append").text(path)


def append_report(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def latest_report(spark: SparkSession, path: str, service: str) -> DataFrame:
    """The report of a service that began last; no row where there is none."""
    rows = spark.read.parquet(path).filter(F.col("service") == service)
    last = rows.agg(F.max("started_at").alias("started_at"))
    return rows.join(F.broadcast(last), "started_at").limit(1)


def append_log(df: DataFrame, path: str) -> None:
    """Log entries as JSON lines after those that are there."""
    df.select(canonical_json(df).alias("value")).write.mode("append").text(path)


def sitemap_urls(sitemaps: DataFrame, body: str = "body") -> DataFrame:
    """url of each page that sitemaps name, once."""
    return sitemaps.select(F.explode(F.regexp_extract_all(body, F.lit(r"<loc>\s*([^<\s]+)\s*</loc>"), F.lit(1))).alias("url")).distinct()


def read_eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """case, html, expected (JSON) of a folder with one folder for each case; cases without both files are left out."""
    of = lambda name: spark.read.text(f"{path}/*/{name}", wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -2).alias("case"), "value")
    try:
        pages, expected = of("page.html"), of("expected.json")
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "case string, html string, expected string")
    return pages.withColumnRenamed("value", "html").join(expected.withColumnRenamed("value", "expected"), "case")


def snapshot(rows: DataFrame, path: str, digits: int = 4) -> int:
    """Rows as canonical JSON lines with decimals rounded; the number of lines."""
    rounded = rows.select(*(F.round(c, digits).alias(c) if k in ("double", "float") else F.col(c) for c, k in rows.dtypes))
    return write_jsonl(rounded.coalesce(1), path)
