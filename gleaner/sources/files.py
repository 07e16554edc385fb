"""Small files and joined part files on whatever file system Spark reaches, through Hadoop's file contexts."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _hadoop(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, conf, p, p.getFileSystem(conf)


def modified(spark: SparkSession, path: str) -> int:
    """Milliseconds of a file's or folder's last change, 0 where there is none."""
    _, _, p, fs = _hadoop(spark, path)
    return fs.getFileStatus(p).getModificationTime() if fs.exists(p) else 0


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small file's text; None where there is none."""
    jvm, _, p, fs = _hadoop(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode("utf-8")
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small file beside its place and move it there over the old one, which stays whole until then."""
    jvm, conf, p, fs = _hadoop(spark, path)
    beside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{jvm.java.util.UUID.randomUUID()}")
    fs.setWriteChecksum(False)
    out = fs.create(beside, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    _move(spark, fs.makeQualified(beside), fs.makeQualified(p))


def _move(spark: SparkSession, source, target) -> None:
    jvm = spark.sparkContext._jvm
    rename = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(rename, 1)
    how[0] = rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(source, target, how)


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """The part files of a folder, in the order of their names, as one file; the folder goes. Bytes are copied by the JVM."""
    jvm, conf, p, fs = _hadoop(spark, path)
    parts = sorted((s.getPath().toString() for s in fs.listStatus(jvm.org.apache.hadoop.fs.Path(folder)) if s.getPath().getName().startswith("part-")))
    beside = jvm.org.apache.hadoop.fs.Path(p.getParent(), f".{p.getName()}.{jvm.java.util.UUID.randomUUID()}")
    fs.setWriteChecksum(False)
    out = fs.create(beside, True)
    try:
        for part in parts:
            stream = fs.open(jvm.org.apache.hadoop.fs.Path(part))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(stream, out, conf, False)
            finally:
                stream.close()
    finally:
        out.close()
    _move(spark, fs.makeQualified(beside), fs.makeQualified(p))
    fs.delete(jvm.org.apache.hadoop.fs.Path(folder), True)
