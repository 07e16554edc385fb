"""Session settings and the shared working folder.

Intermediate tables that several stages read are written below the folder named by
``spark.checkpoint.dir``; only where a session has none (tests, a laptop) one is set here.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CONF = "spark.checkpoint.dir"


def local_session(cpus: int | str = "*", partitions: int = 8, name: str = "gleaner", **conf: str) -> SparkSession:
    """A session for one machine, with the settings that the engine's results rely on (UTC, AQE, Arrow)."""
    b = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", conf.pop("driver_memory", "8g"))
    )
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workspace(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. A local one is set only where the session names none and runs on one machine."""
    folder = spark.conf.get(CONF, None) or spark.sparkContext.getConf().get(CONF)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{CONF} must name a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="gleaner-")
        spark.conf.set(CONF, folder)
    return folder.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder through the Hadoop file system it lives on; a missing one is no error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike ``persist`` the rows survive the loss of an executor, and unlike ``checkpoint`` they are columnar and
    compressed. The files go when the ``scratch`` around the call ends, at the latest when the driver's Python does.
    """
    spark = df.sparkSession
    path = f"{workspace(spark)}/gleaner/{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    df.write.parquet(path)
    out = spark.read.parquet(path)
    out.gleaner_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; other tables are left alone."""
    for t in tables:
        path = getattr(t, "gleaner_path", None)
        if path:
            _written[:] = [w for w in _written if w[1] != path]
            _quiet_remove(t.sparkSession, path)


_written: list[tuple[SparkSession, str]] = []


@contextmanager
def scratch() -> Iterator[None]:
    """What is materialized inside is deleted at the end; results have to be written or collected before."""
    start = len(_written)
    try:
        yield
    finally:
        release(start)


def release(start: int = 0) -> None:
    """Delete the intermediate tables written since the ``start``-th."""
    while len(_written) > start:
        _quiet_remove(*_written.pop())


atexit.register(release)


def _quiet_remove(spark: SparkSession, path: str) -> None:
    try:
        remove(spark, path)
    except Exception:  # the JVM may be gone already; the folder belongs to the cluster's own clean-up then
        pass
