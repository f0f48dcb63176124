"""Exclusive creation of one small file: the only primitive that commits in this library."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import SparkSession


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, target, target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _local(spark: SparkSession, path: str) -> str | None:
    """The path on this machine, if that is where Spark finds it too: a path without scheme belongs to the default file system."""
    parsed = urlparse(path)
    if parsed.scheme:
        return parsed.path if parsed.scheme == "file" else None
    _, target, fs = _fs(spark, path)
    full = fs.makeQualified(target).toUri()
    return full.getPath() if full.getScheme() == "file" else None


def put_if_absent(spark: SparkSession, path: str, data: bytes) -> bool:
    """Create ``path`` with ``data`` unless it exists; True if this call created it. Readers never see a partial file.

    On a local or mounted path a hard link decides; elsewhere a rename without overwrite of Hadoop's FileContext does,
    which is atomic on HDFS. On plain object stores use a connector whose rename is conditional.
    """
    if (local := _local(spark, path)) is not None:
        os.makedirs(os.path.dirname(local), exist_ok=True)
        staged = f"{local}.{uuid.uuid4().hex}.tmp"
        with open(staged, "wb") as out:
            out.write(data)
            out.flush()
            os.fsync(out.fileno())
        try:
            os.link(staged, local)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(staged)
    jvm, target, fs = _fs(spark, path)
    fs.mkdirs(target.getParent())
    staged = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}.tmp")
    out = fs.create(staged, False)
    out.write(data)
    out.close()
    target, staged = fs.makeQualified(target), fs.makeQualified(staged)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    none[0] = jvm.org.apache.hadoop.fs.Options.Rename.NONE
    try:
        context.rename(staged, target, none)
        return True
    except Exception as error:
        fs.delete(staged, False)
        if "already exists" in str(error).lower():
            return False
        raise


def read_bytes(spark: SparkSession, path: str) -> bytes | None:
    """The content of a small file, or None if there is none."""
    if (local := _local(spark, path)) is not None:
        try:
            with open(local, "rb") as src:
                return src.read()
        except FileNotFoundError:
            return None
    jvm, target, fs = _fs(spark, path)
    if not fs.exists(target):
        return None
    stream = fs.open(target)
    try:
        return bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
    finally:
        stream.close()


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder, sorted; none if there is no such folder."""
    if (local := _local(spark, path)) is not None:
        return sorted(os.listdir(local)) if os.path.isdir(local) else []
    _, target, fs = _fs(spark, path)
    return sorted(x.getPath().getName() for x in fs.listStatus(target)) if fs.exists(target) else []


def remove(spark: SparkSession, path: str) -> None:
    """Delete a file or folder, if it is there. Only for what no log names."""
    _, target, fs = _fs(spark, path)
    fs.delete(target, True)
