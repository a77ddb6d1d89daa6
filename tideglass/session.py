"""Session helpers shared by every plan.

Nothing here changes a session that was built elsewhere, except for the two
settings without which results could differ: the time zone and the search path
of Python workers.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)


def local_session(cores: int | str = "*", partitions: int = 8) -> SparkSession:
    """A local session for tests and the bench."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tideglass")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def prepare(spark: SparkSession) -> SparkSession:
    """UTC days, and workers that find this package when it is not installed."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    env = spark.sparkContext.environment
    if ROOT not in env.get("PYTHONPATH", "").split(":"):
        env["PYTHONPATH"] = ":".join(x for x in (ROOT, env.get("PYTHONPATH")) if x)
    return spark


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of the data folder; any path that Spark can read will do."""
    return prepare(spark).read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    Only a local session, as in tests, gets a folder of its own where the setting is missing; on a cluster that
    would be a disk that others cannot see, so that it is an error there.
    """
    sc = spark.sparkContext
    had = sc._jsc.sc().getCheckpointDir()
    if had.isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="tideglass-checkpoint-")
        sc.setCheckpointDir(folder)
        had = sc._jsc.sc().getCheckpointDir()
    return had.get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage through the checkpoint folder that all executors share."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def share(spark: SparkSession, name: str, data: bytes) -> None:
    """Write a file to the shared folder and send it to the executors, where ``SparkFiles.get(name)`` finds it."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/{name}")
    out = path.getFileSystem(sc._jsc.hadoopConfiguration()).create(path, True)
    try:
        for lo in range(0, len(data), 1 << 20):
            out.write(bytearray(data[lo : lo + (1 << 20)]))
    finally:
        out.close()
    sc.addFile(path.toString())


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns, made longer until no column of df has them (in any case)."""
    had, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in had:
            name += "_"
        had.add(name.lower())
        out.append(name)
    return out


def quoted(name: str) -> str:
    """A column's name as a reference to it, also with dots and quotes in it."""
    return "`" + name.replace("`", "``") + "`"
