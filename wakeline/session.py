"""What a session needs before it runs this library's Python kernels, and tables that cut lineage."""

from __future__ import annotations

import atexit
import hashlib
import tempfile
import uuid
import zipfile
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()
_tables: dict[str, SparkSession] = {}
_files: set[tuple[str, str]] = set()
#: Bytes that are handed to the file system at once.
_PIECE = 4 << 20


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application (they need no PYTHONPATH)."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    _shipped.add(sc.applicationId)
    home = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="wakeline-")) / "wakeline.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(home.rglob("*.py")):
            z.write(p, p.relative_to(home.parent))
    sc.addPyFile(str(target))


def prepare(spark: SparkSession) -> None:
    """Ship the package, and make sure of a checkpoint folder: the one the cluster names, or a local one on a local master only."""
    ship(spark)
    sc = spark.sparkContext
    if spark.conf.get("spark.checkpoint.dir", "") or sc.getCheckpointDir() is not None:
        return
    if not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    sc.setCheckpointDir(tempfile.mkdtemp(prefix="wakeline-ckpt-"))


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage: write to the shared checkpoint folder and go on from there."""
    prepare(df.sparkSession)
    return df.checkpoint()


def table(df: DataFrame) -> DataFrame:
    """Like cut, as a compressed table in the checkpoint folder, for frames of many small rows.

    It goes with ``free``, or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._wakeline_path = path
    return out


@contextmanager
def brief_shuffles(spark: SparkSession):
    """Inside, the shuffle files of an execution go when it ends, not when the driver's JVM next collects its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared one, deleted when the driver's Python ends."""
    prepare(spark)
    top = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir")
    path = f"{top}/wakeline-{uuid.uuid4().hex}"
    if not _tables:
        atexit.register(_free_all)
    _tables[path] = spark
    return path


def free(*frames: DataFrame) -> None:
    """Delete tables whose last reader is done."""
    for df in frames:
        path = getattr(df, "_wakeline_path", None)
        if path in _tables:
            _delete(_tables.pop(path), path)


def shared_file(spark: SparkSession, data: bytes) -> str:
    """Put bytes into the shared folder as a file that executors fetch by the name returned; the same bytes go once."""
    prepare(spark)
    sc = spark.sparkContext
    name = f"wakeline-{hashlib.sha256(data).hexdigest()}.bin"
    if (sc.applicationId, name) in _files:
        return name
    path = f"{sc.getCheckpointDir() or spark.conf.get('spark.checkpoint.dir')}/{name}"
    where = sc._jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(sc._jsc.hadoopConfiguration()).create(where, True)
    for lo in range(0, len(data), _PIECE):
        out.write(bytearray(data[lo : lo + _PIECE]))
    out.close()
    sc.addFile(path)
    _files.add((sc.applicationId, name))
    return name


def _delete(spark: SparkSession, path: str) -> None:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _free_all() -> None:
    for path, spark in _tables.items():
        try:
            _delete(spark, path)
        except Exception:  # the session has ended: the folder's owner clears it
            return
