"""Session-level helpers: table loading and lineage cuts in the shared checkpoint folder."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of one key from which on the key is joined by a broadcast: of N rows at most N / HOT such keys exist.
HOT = 100_000

#: Spark's setting by which an execution deletes its shuffle files at its end.
SWEEP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_WRITTEN: list[tuple[SparkSession, str]] = []


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: the session's ``spark.checkpoint.dir``.

    Only where that is unset and all tasks run in the driver's own process, as in local tests, a
    temporary folder is made and set; on a cluster an unset folder is an error.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not is_local(sc.master):
            raise RuntimeError(f"spark.checkpoint.dir must name a folder that all executors of {sc.master} share")
        folder = tempfile.mkdtemp(prefix="turfspoor-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def is_local(master: str) -> bool:
    """Whether a master runs its tasks in the driver's own process (``local-cluster`` does not)."""
    return master == "local" or master.startswith("local[")


def _hadoop_path(spark: SparkSession, path: str):
    return spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)


def _delete(spark: SparkSession, path: str) -> None:
    try:
        p = _hadoop_path(spark, path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone; the folder belongs to the cluster then
        pass


@atexit.register
def _clean() -> None:
    while _WRITTEN:
        _delete(*_WRITTEN.pop())


def scratch(spark: SparkSession, name: str) -> str:
    """The path of a new folder in the shared one; what is put there goes when the driver ends."""
    path = f"{shared_folder(spark)}/turfspoor-{name}-{uuid.uuid4().hex}"
    _WRITTEN.append((spark, path))
    return path


def written(df: DataFrame, name: str = "cut", sweep: bool = False) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder and read them again.

    Unlike a cached or locally checkpointed table this survives the loss of any executor, and
    later scans still prune columns. The files go when the driver ends. With ``sweep`` the shuffle
    files of the write go as soon as it is done, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = scratch(spark, name)
    before = spark.conf.get(SWEEP, None) if sweep else None
    if sweep:
        spark.conf.set(SWEEP, "true")
    try:
        df.write.parquet(path)
    finally:
        if sweep:
            spark.conf.unset(SWEEP) if before is None else spark.conf.set(SWEEP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Delete the files behind a table made by ``written`` that is no longer needed."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        for item in [w for w in _WRITTEN if path.endswith(w[1].split("://")[-1].lstrip("/"))]:
            _WRITTEN.remove(item)
            _delete(*item)


def join_hot(left: DataFrame, right: DataFrame, keys: list[str], rows: Column, hot: int = HOT) -> DataFrame:
    """``left`` joined with the one row that ``right`` has for each key, whatever the keys' frequencies.

    ``rows`` is a column of ``right``, the number of rows that ``left`` has of the key (or an upper bound of it). Keys with more
    than ``hot`` rows never go through a shuffle: there are at most N / ``hot`` of them, so they are
    broadcast; all others are joined as Spark sees fit. ``left`` is read twice if there are hot keys.
    """
    few = right.filter(rows > hot)
    if not few.take(1):
        return left.join(right, keys)
    cold = left.join(F.broadcast(few.select(*keys)), keys, "left_anti").join(right.filter(rows <= hot), keys)
    return left.join(F.broadcast(few), keys).unionByName(cold)
