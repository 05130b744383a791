"""Small file-system steps through Hadoop, so any store Spark reads will do."""

from __future__ import annotations

from pyspark.sql import SparkSession

# Schemes of object stores without a rename that fails if the name is taken.
REPLACING = ("s3", "s3a", "s3n", "gs", "oss", "cosn", "wasb", "wasbs")


def _at(spark: SparkSession, path: str):
    jvm = spark._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where) and fs.getFileStatus(where).isDirectory()


def qualified(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    return fs.makeQualified(where).toString()


def names(spark: SparkSession, path: str) -> list[str]:
    """Entries of a folder, hidden ones left out; none if it is not there."""
    fs, where = _at(spark, path)
    if not fs.exists(where):
        return []
    found = [s.getPath().getName() for s in fs.listStatus(where)]
    return sorted(n for n in found if not n.startswith((".", "_SUCCESS", "_temporary")))


def read_text(spark: SparkSession, path: str) -> str:
    fs, where = _at(spark, path)
    stream = fs.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_once(spark: SparkSession, draft: str, path: str, text: str) -> bool:
    """Write a draft and rename it into place; False if the place is taken.

    Stores whose rename copies and may replace a file give two writers the same place, so
    they are refused.
    """
    fs, where = _at(spark, draft)
    if (scheme := fs.getUri().getScheme()) in REPLACING:
        raise ValueError(f"{scheme}: a rename may replace a file there; keep commits elsewhere")
    out = fs.create(where, True)
    try:
        out.write(bytearray(text.encode("utf-8")))
    finally:
        out.close()
    jvm = spark._jvm
    files = jvm.org.apache.hadoop.fs
    context = files.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(files.Options.Rename, 0)  # never overwrite
    try:
        context.rename(where, files.Path(path), plain)
    except Exception as error:  # the JVM error arrives wrapped
        fs.delete(where, False)
        if _caused_by(error, "org.apache.hadoop.fs.FileAlreadyExistsException"):
            return False
        raise
    return True


def _caused_by(error: Exception, name: str) -> bool:
    """Whether a JVM error or one it wraps is of a class."""
    cause = getattr(error, "java_exception", None) or getattr(error, "_origin", None)
    while cause is not None:
        if cause.getClass().getName() == name:
            return True
        cause = cause.getCause()
    return False


def delete_folder(spark: SparkSession, path: str) -> None:
    fs, where = _at(spark, path)
    fs.delete(where, True)
