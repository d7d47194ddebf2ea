"""Session settings, the shared folder, and the tables of a data directory."""

from __future__ import annotations

import re
import tempfile
import uuid
import weakref
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("seqbucket")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir of the session. Where that is unset, a local
    session (tests) gets a temporary folder that is then set as the checkpoint folder; on a cluster, whose machines
    would each write to a folder of their own, it is an error."""
    sc = spark.sparkContext
    found = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
        sc.setCheckpointDir(found)
    return found.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; what is written there is deleted when the session's JVM ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    target, fs = _file(spark, path)
    fs.deleteOnExit(target)
    return path


def _file(spark: SparkSession, path: str) -> tuple:
    """A path and its file system, as the session's Hadoop configuration has them."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df once to the shared folder and reads it back: its lineage is cut, and what is used twice
    is computed once. The files outlive any executor; they go with the session, or before that with release."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _paths[id(out)] = (weakref.ref(out), path)
    return out


def release(*tables: DataFrame) -> None:
    """Deletes what materialize wrote for these tables: the state of a round that the next has replaced. Plans
    that read them can't run afterwards."""
    for df in tables:
        ref, path = _paths.pop(id(df), (lambda: None, None))
        if ref() is df:
            target, fs = _file(df.sparkSession, path)
            fs.delete(target, True)


#: Where materialize wrote a table, by the table's identity.
_paths: dict[int, tuple] = {}


def tasks(spark: SparkSession, rows: int, per_task: int) -> int:
    """Partitions for a stage whose tasks should see about per_task rows each: at least as many as the
    session's shuffle partitions, and growing with the rows."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_task))


def ship(spark: SparkSession) -> None:
    """Sends this package to the executors, once a context: their Python workers may run elsewhere or in another folder."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


_shipped: set[str] = set()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
