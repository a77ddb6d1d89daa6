"""Tables with versions: a table is what its newest manifest says.

A version is a small JSON file that names folders of rows, each with the values by which it can be left out of a read. Rows are written first, into a folder that nothing names yet; then the manifest of
the next version is put in place in one step, which fails if another writer was there first. So a writer that dies leaves the table as it was, a reader goes on with the version that it began with,
and earlier versions can be asked for until ``expire`` takes them away.

What a write replaces is a whole part (a month of a grain, a bucket of keys): parts that it doesn't touch are taken over by name and neither read nor written.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tideglass.session import cut

#: Times that a change is tried again where others write at the same time.
TRIES = 5
#: Buckets that keys are dealt to in a table that is changed by key.
BUCKETS = 16


class Conflict(RuntimeError):
    """Another writer was first."""


class VersionedTable:
    """The table in a folder, which need not be there yet."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    # -- files

    def _at(self, name: str) -> tuple:
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self._conf), p

    def _load(self, version: int) -> dict:
        fs, p = self._at(f"manifests/{version:012d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _commit(self, version: int, manifest: dict) -> None:
        """The manifest of a new version, whole or not at all; ``Conflict`` if the version is there already."""
        name = f"manifests/{version:012d}.json"
        fs, draft = self._at(f"drafts/{uuid.uuid4().hex}.json")
        out = fs.create(draft, False)
        out.write(bytearray(json.dumps(manifest, ensure_ascii=False, sort_keys=True).encode()))
        out.close()
        _, p = self._at(name)
        fs.mkdirs(p.getParent())
        files = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.makeQualified(fs.getUri(), fs.getWorkingDirectory()).toUri(), self._conf)
        kinds = self._jvm.org.apache.hadoop.fs.Options.Rename
        never = self.spark.sparkContext._gateway.new_array(kinds, 1)
        never[0] = kinds.NONE
        try:
            files.rename(draft, p, never)
        except Exception as e:
            fs.delete(draft, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(f"version {version} of {self.path} is there already") from e
            raise

    # -- reading

    def versions(self) -> list[int]:
        fs, p = self._at("manifests")
        if not fs.exists(p):
            return []
        return sorted(int(name[:-5]) for name in (f.getPath().getName() for f in fs.listStatus(p)) if name.endswith(".json") and name[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict:
        """version, schema, parts (folder and values) and info of a version, the newest by default; version 0 is the empty table before the first write."""
        if version is None:
            had = self.versions()
            version = had[-1] if had else 0
        return self._load(version) if version else {"version": 0, "schema": None, "parts": [], "info": {}}

    def read(self, version: int | None = None, part: Callable[[dict], bool] | None = None, schema: str | None = None) -> DataFrame:
        """Rows of a version; of those parts only whose values ``part`` accepts. ``schema`` is for a table that isn't there yet."""
        manifest = self.manifest(version)
        kind = StructType.fromJson(manifest["schema"]) if manifest["schema"] else schema
        if kind is None:
            raise FileNotFoundError(f"there is no table at {self.path}")
        folders = [f"{self.path}/{p['folder']}" for p in manifest["parts"] if part is None or part(p["values"])]
        return self.spark.read.schema(kind).parquet(*folders) if folders else self.spark.createDataFrame([], kind)

    # -- writing

    def _written(self, df: DataFrame, by: list[str]) -> list[dict]:
        """The rows in folders of their own, one for each set of values of the columns ``by``, that no manifest names yet."""
        folder = f"rows/{uuid.uuid4().hex}"
        if not by:
            df.write.parquet(f"{self.path}/{folder}")
            return [{"folder": folder, "values": {}}]
        # (the columns stay in the rows; the folders' names carry copies of them)
        names = [f"__part{i}" for i in range(len(by))]
        copies = df.select("*", *(F.col(c).cast("string").alias(n) for c, n in zip(by, names, strict=True)))
        # (dealt by parts, but a part with very many rows is split among tasks, each of which writes a file of it)
        copies.hint("rebalance", *names).sortWithinPartitions(*names).write.partitionBy(*names).parquet(f"{self.path}/{folder}")
        found = [{"folder": folder, "values": {}}]
        for c in by:
            step = []
            for p in found:
                fs, at = self._at(p["folder"])
                for f in fs.listStatus(at):
                    name = f.getPath().getName()
                    if f.isDirectory() and "=" in name:
                        value = self._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils.unescapePathName(name.partition("=")[2])
                        step.append({"folder": f"{p['folder']}/{name}", "values": {**p["values"], c: None if value == "__HIVE_DEFAULT_PARTITION__" else value}})
            found = step
        return sorted(found, key=lambda p: json.dumps(p["values"], sort_keys=True))

    def change(self, make: Callable[[dict], tuple[DataFrame, Callable[[dict], bool]]], by: Iterable[str] = (), info: dict | None = None) -> int:
        """The next version: ``make`` gets the manifest that it follows on and gives new rows and a test of the values of those parts that they replace.

        Where another writer comes first, ``make`` is asked again on top of what that one wrote. The number of the new version.
        """
        by = list(by)
        for _ in range(TRIES):
            last = self.manifest()
            rows, gone = make(last)
            kept = [p for p in last["parts"] if not gone(p["values"])]
            schema = rows.schema if not last["schema"] or not kept else _merged(StructType.fromJson(last["schema"]), rows.schema)
            manifest = {"version": last["version"] + 1, "schema": json.loads(schema.json()), "info": {**last["info"], **(info or {})}}
            manifest["parts"] = kept + self._written(rows, by)
            try:
                self._commit(manifest["version"], manifest)
            except Conflict:
                self._sweep([p["folder"].split("/")[1] for p in manifest["parts"][len(kept) :]])
                continue
            return manifest["version"]
        raise Conflict(f"{self.path} is written by others all the time")

    def write(self, df: DataFrame, by: Iterable[str] = (), info: dict | None = None) -> int:
        """df as the whole table."""
        return self.change(lambda _: (df, lambda _: True), by, info)

    def upsert(self, df: DataFrame, keys: list[str], order: Column | None = None, buckets: int = BUCKETS) -> int:
        """Rows in place of those with the same keys, null being a key like any other. Of rows of df that share a key the one with the greatest ``order`` counts, in doubt the greatest by its columns as text.

        Keys are dealt to buckets, and only buckets that have new rows are written again. A table keeps the number of buckets that it began with.
        """
        n = int(self.manifest()["info"].get("buckets", buckets))
        one = _last(df, keys, order)
        fresh = cut(one.withColumn("_bucket", F.pmod(F.xxhash64(*keys), F.lit(n)).cast("int")))
        touched = {str(r[0]) for r in fresh.select("_bucket").distinct().collect()}  # (as many as there are buckets, at most)

        def make(last: dict) -> tuple[DataFrame, Callable[[dict], bool]]:
            rows = fresh
            if any(p["values"]["_bucket"] in touched for p in last["parts"]):
                had = self.read(last["version"], lambda v: v["_bucket"] in touched)
                same = [had[k].eqNullSafe(fresh[k]) for k in keys]
                rows = had.join(fresh.select(*keys), same, "left_anti").unionByName(fresh, allowMissingColumns=True)
            return rows, lambda v: v["_bucket"] in touched

        return self.change(make, ["_bucket"], {"buckets": n})

    def add(self, df: DataFrame, keys: list[str]) -> int:
        """Rows whose keys the table doesn't have yet, each once, beside what is there: what was written for a key stays for good, also where two writers bring the same key. The number of the version that has them."""
        one = cut(_last(df, keys, None))

        def make(last: dict) -> tuple[DataFrame, Callable[[dict], bool]]:
            if not last["parts"]:
                return one, lambda _: False
            had = self.read(last["version"])
            return one.join(had.select(*keys), [had[k].eqNullSafe(one[k]) for k in keys], "left_anti"), lambda _: False

        return self.change(make)

    # -- what is no longer needed

    def expire(self, keep: int = 2) -> list[int]:
        """Takes away all but the newest ``keep`` versions, and rows that no version names any more, such as those of a writer that died. Not to be run beside a writer. The versions that went."""
        had = self.versions()
        gone = had[:-keep] if keep else had
        for v in gone:
            fs, p = self._at(f"manifests/{v:012d}.json")
            fs.delete(p, False)
        named = {p["folder"].split("/")[1] for v in had[len(gone) :] for p in self._load(v)["parts"]}
        fs, p = self._at("rows")
        if fs.exists(p):
            self._sweep([name for name in (f.getPath().getName() for f in fs.listStatus(p)) if name not in named])
        fs, p = self._at("drafts")
        fs.delete(p, True)
        return gone

    def _sweep(self, names: list[str]) -> None:
        for name in set(names):
            fs, p = self._at(f"rows/{name}")
            fs.delete(p, True)


def _last(df: DataFrame, keys: list[str], order: Column | None) -> DataFrame:
    """One row for each key."""
    whole = F.struct(*(F.col(f"`{c}`") for c in df.columns))
    rank = F.struct(*([order] if order is not None else []), F.to_json(whole))
    return df.groupBy(*(F.col(k) for k in keys)).agg(F.max_by(whole, rank).alias("_last")).select("_last.*")


def _merged(old: StructType, new: StructType) -> StructType:
    """The old columns and the new ones behind them; a column that changes its type is an error."""
    known = {f.name: f for f in old.fields}
    for f in new.fields:
        if f.name in known and known[f.name].dataType != f.dataType:
            raise ValueError(f"{f.name} was {known[f.name].dataType.simpleString()} and is {f.dataType.simpleString()} now")
    return StructType([*old.fields, *(f for f in new.fields if f.name not in known)])
