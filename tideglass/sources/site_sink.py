"""A site as a sink: a data source that writes each row as a file of its own.

``df.write.format("site_files")`` takes rows of path and body. Each task writes its share of the pages into a folder beside the site, a page complete under another name before it has its own, so that a
task that runs twice or dies does no harm. When all tasks are done that folder becomes the site in one step, and what was there goes; when the job is given up, only the folder goes, and the site is as it was.
A file may also come in pieces, one after the other in one task, which holds one batch of them at a time. ``spark.read.format("site_files")`` gives path, size and digest of the files of a site, read a megabyte at a time.

Paths go through Arrow's file systems, so that a local path, one of a mounted share and addresses that Arrow knows (hdfs, s3, gs) will do; all nodes must reach it.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from tideglass.session import prepare

FORMAT = "site_files"
#: Pages of a map of a site at most, as the protocol has it; maps of larger sites are cut into parts of about so many pages.
MAP_PAGES, PART_PAGES = 50_000, 40_000
#: Files and bytes that a task reads at most (or one larger file), and bytes of a file that it holds.
READ_FILES, READ_BYTES, CHUNK = 2_000, 64_000_000, 1 << 20


def _place(path: str) -> tuple[fs.FileSystem, str]:
    found, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return found, inner.rstrip("/")


def _inside(path: str | None) -> str:
    """A path below the site; one that leaves it, or is none, is an error."""
    parts = (path or "").split("/")
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in parts) or "\\" in path:
        raise ValueError(f"{path!r} is no path of a file in the site")
    return path


@dataclass
class Written(WriterCommitMessage):
    files: int
    bytes: int


class SiteWriter(DataSourceArrowWriter):
    def __init__(self, path: str, job: str):
        """On the driver, before any task: the folder of the job is made here and nowhere else, so that a task which is still running when the job is given up can't bring it back."""
        self.path, self.job = path, job
        files, _, staging = self._staging()
        files.create_dir(staging, recursive=True)

    def _staging(self) -> tuple[fs.FileSystem, str, str]:
        files, site = _place(self.path)
        return files, site, f"{site}.{self.job}.new"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, _, staging = self._staging()
        n = size = 0
        made = {staging}
        last = out = draft = target = None  # the file whose pieces are coming

        def done() -> None:
            if out is not None:
                out.close()
                files.move(draft, target)

        try:
            for batch in iterator:
                pieces = batch.column("piece").to_pylist() if "piece" in batch.schema.names else [False] * batch.num_rows
                for path, body, piece in zip(batch.column("path").to_pylist(), batch.column("body").to_pylist(), pieces, strict=True):
                    data = body if isinstance(body, bytes) else (body or "").encode()
                    size += len(data)
                    if piece and path == last:
                        out.write(data)
                        continue
                    done()
                    last = out = None
                    target = f"{staging}/{_inside(path)}"
                    parent = target.rpartition("/")[0]
                    if parent not in made:
                        for depth in range(staging.count("/") + 1, parent.count("/") + 1):
                            level = "/".join(parent.split("/")[: depth + 1])
                            if level not in made:
                                files.create_dir(level, recursive=False)
                                made.add(level)
                    draft = f"{parent}/.{uuid.uuid4().hex}"
                    out = files.open_output_stream(draft)
                    out.write(data)
                    n, last = n + 1, path if piece else None
            done()
        except BaseException:
            if out is not None and not out.closed:
                out.close()
            raise
        return Written(n, size)

    def commit(self, messages: list[Written | None]) -> None:
        files, site, staging = self._staging()
        old = f"{site}.{self.job}.old"
        had = files.get_file_info(site).type != fs.FileType.NotFound
        if had:
            files.move(site, old)
        files.move(staging, site)
        if had:
            files.delete_dir(old)

    def abort(self, messages: list[Written | None]) -> None:
        files, site, staging = self._staging()
        if files.get_file_info(staging).type != fs.FileType.NotFound:
            # (moved first: tasks that are still writing find their folder gone, and can't put files into what is being deleted)
            gone = f"{site}.{self.job}.gone"
            files.move(staging, gone)
            files.delete_dir(gone)


@dataclass
class Share(InputPartition):
    paths: list[str]


class SiteReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[Share]:
        files, site = _place(self.path)
        shares, size = [Share([])], 0
        for info in files.get_file_info(fs.FileSelector(site, recursive=True)):
            if info.type == fs.FileType.File:
                if shares[-1].paths and (len(shares[-1].paths) >= READ_FILES or size + info.size > READ_BYTES):
                    shares.append(Share([]))
                    size = 0
                shares[-1].paths.append(info.path[len(site) + 1 :])
                size += info.size
        return shares

    def read(self, partition: Share) -> Iterator[tuple[str, int, str]]:
        files, site = _place(self.path)
        for path in partition.paths:
            digest, size = hashlib.sha256(), 0
            with files.open_input_stream(f"{site}/{path}") as body:
                while chunk := body.read(CHUNK):
                    digest.update(chunk)
                    size += len(chunk)
            yield path, size, digest.hexdigest()


class SiteFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, bytes long, sha256 string"

    def reader(self, schema: StructType) -> SiteReader:
        return SiteReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> SiteWriter:
        if not {"path", "body"} <= set(schema.names):
            raise ValueError("a site is made of path and body")
        return SiteWriter(self.options["path"], uuid.uuid4().hex)


class DuplicatePaths(ValueError):
    """Two rows want to be the same file."""


def write_site(files: DataFrame, path: str, pieces: DataFrame | None = None) -> None:
    """Rows of path and body (text or bytes) as the whole site at ``path``. Two rows with one path are an error before anything is written.

    pieces: path, piece, body of files that are put together, in the order of piece, by the task that writes them.
    """
    spark = prepare(files.sparkSession)
    whole = files.select("path", "body", F.lit(False).alias("piece"))
    paths, again = files.select("path"), None
    if pieces is not None:
        placed = pieces.select("path", "piece", F.col("body").cast(files.schema["body"].dataType).alias("body")).repartition("path").sortWithinPartitions("path", "piece")
        whole = whole.unionByName(placed.withColumn("piece", F.lit(True)))
        paths, again = paths.unionByName(pieces.select("path").distinct()), pieces.groupBy("path", "piece").agg(F.count("*").alias("n"))
    twice = paths.groupBy("path").agg(F.count("*").alias("n"))
    twice = (twice if again is None else twice.unionByName(again.select("path", "n"))).filter("n > 1").select("path").limit(5).collect()
    if twice:
        raise DuplicatePaths(", ".join(str(r.path) for r in twice))
    spark.dataSource.register(SiteFiles)
    whole.write.format(FORMAT).option("path", path).mode("append").save()


def read_site(spark: SparkSession, path: str) -> DataFrame:
    """path, bytes, sha256 of all files of the site at ``path``."""
    prepare(spark).dataSource.register(SiteFiles)
    return spark.read.format(FORMAT).option("path", path).load()


def _map_head(xhtml: bool) -> str:
    space = ' xmlns:xhtml="http://www.w3.org/1999/xhtml"' if xhtml else ""
    return f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"{space}>\n'


def map_pieces(entries: DataFrame, xhtml: bool) -> DataFrame:
    """path, piece, body: sitemap.xml as one file of any size, for ``write_site``, from path and row of its pages; a piece for each page, in the order of their paths."""
    ends = entries.sparkSession.createDataFrame([("0", _map_head(xhtml)), ("2", "</urlset>\n")], "piece string, body string")
    # (a map without pages has an empty line)
    rows = entries.select(F.concat(F.lit("1"), "path").alias("piece"), F.concat("row", F.lit("\n")).alias("body")) if not entries.isEmpty() else entries.sparkSession.createDataFrame([("1", "\n")], ends.schema)
    return ends.unionByName(rows).select(F.lit("sitemap.xml").alias("path"), "piece", "body")


def map_files(entries: DataFrame, base: str, xhtml: bool, pages: int | None = None) -> DataFrame:
    """path, body of the map of a site, from path and row of its pages (``site.sitemap_rows``): sitemap.xml, or for more than MAP_PAGES pages its parts and sitemap.xml as their index.

    Pages are dealt to parts by their paths, each part is put together by one task, and none grows with the site.
    """
    n = entries.count() if pages is None else pages
    parts = 1 if n <= MAP_PAGES else -(-n // PART_PAGES)
    head = _map_head(xhtml)
    part = F.pmod(F.xxhash64("path"), F.lit(parts)).cast("int")
    rows = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("path", "row"))), lambda r: r["row"]), "\n")
    made = entries.groupBy(part.alias("part")).agg(F.concat(F.lit(head), rows, F.lit("\n</urlset>\n")).alias("body"))
    if parts == 1:
        empty = entries.sparkSession.createDataFrame([(f"{head}\n</urlset>\n",)], "body string")
        whole = made.select("body") if n else empty
        return whole.select(F.lit("sitemap.xml").alias("path"), "body")
    name = F.format_string("sitemap-%05d.xml", F.col("part"))
    lines = "".join(f"  <sitemap><loc>{base}/sitemap-{i:05d}.xml</loc></sitemap>\n" for i in range(parts))
    index = f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex xmlns="http://www.sitemaps.org/schemas/sitemap/0.9">\n{lines}</sitemapindex>\n'
    each = entries.sparkSession.range(parts).select(F.col("id").cast("int").alias("part")).join(made, "part", "left").select(name.alias("path"), F.coalesce("body", F.lit(f"{head}\n</urlset>\n")).alias("body"))
    return each.unionByName(entries.sparkSession.createDataFrame([("sitemap.xml", index)], "path string, body string"))


def fixed_files(spark: SparkSession, base: str, redirects: list[tuple[str, str, int]] = ()) -> DataFrame:
    """path, body of the rules for robots, redirects and headers."""
    headers = "/*\n  X-Content-Type-Options: nosniff\n  Referrer-Policy: strict-origin-when-cross-origin\n  X-Frame-Options: SAMEORIGIN\n"
    rows = [("robots.txt", f"User-agent: *\nAllow: /\nSitemap: {base}/sitemap.xml\n"), ("_redirects", "".join(f"{a} {b} {code}\n" for a, b, code in redirects)), ("_headers", headers)]
    return spark.createDataFrame(rows, "path string, body string")


def index_files(rows: DataFrame, part: Column, order: list[str]) -> DataFrame:
    """path, body of a search index: a JSON array for each part, in the order of some columns, without the column of the part."""
    ranked = rows.withColumn("_part", part).withColumn("_n", F.row_number().over(Window.partitionBy("_part").orderBy(*order)))
    each = ranked.groupBy("_part").agg(F.array_sort(F.collect_list(F.struct("_n", F.to_json(F.struct(*rows.columns)).alias("j")))).alias("all"))
    return each.select(F.concat(F.lit("search/"), F.col("_part"), F.lit(".json")).alias("path"), F.concat(F.lit("["), F.array_join(F.transform("all", lambda r: r["j"]), ","), F.lit("]\n")).alias("body"))
