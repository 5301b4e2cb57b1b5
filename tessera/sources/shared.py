"""File-system steps that Spark has no DataFrame for: a shared folder, whole small files, exclusive creation."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, else one that is set here.

    That is a temporary one on a master of one machine, whose tasks share its disk, and otherwise one
    under the warehouse; a warehouse on local disks is an error, as executors would not see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if path:
        return path
    if re.match(r"local(\[|$)", spark.sparkContext.master):
        path = tempfile.mkdtemp(prefix="tessera-")
    else:
        path = f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_tessera"
        if file_of(spark, path)[0].getScheme() == "file":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(path)
    return spark.sparkContext.getCheckpointDir()


def file_of(spark: SparkSession, path: str):
    """The file system of a path, and the path for it."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), at


def exists(spark: SparkSession, path: str) -> bool:
    fs, at = file_of(spark, path)
    return fs.exists(at)


def read_text(spark: SparkSession, path: str) -> str:
    """A small file, whole."""
    fs, at = file_of(spark, path)
    stream = fs.open(at)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names in a directory, sorted; none if there is no such directory."""
    fs, at = file_of(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []


def remove(spark: SparkSession, path: str) -> None:
    fs, at = file_of(spark, path)
    fs.delete(at, True)


def write_text(spark: SparkSession, path: str, text: str, *, exclusive: bool = False) -> bool:
    """Write a small file so that readers see all of it or nothing; with ``exclusive`` False is returned if it was there already.

    Exclusive creation is a hard link on a local disk, and elsewhere a rename that fails if the name is
    taken, which HDFS does in one step; an object store must offer the same through its Hadoop connector.
    """
    fs, at = file_of(spark, path)
    if fs.getScheme() == "file":  # the driver's disk; without checksum files that others' edits would leave stale
        name = at.toUri().getPath()
        os.makedirs(os.path.dirname(name), exist_ok=True)
        fresh = os.path.join(os.path.dirname(name), f".{os.path.basename(name)}-{uuid.uuid4().hex}")
        with open(fresh, "w", encoding="utf-8", newline="") as out:
            out.write(text)
        if not exclusive:
            os.replace(fresh, name)
            return True
        try:
            os.link(fresh, name)
            return True
        except FileExistsError:
            return False
        finally:
            os.unlink(fresh)
    jvm = spark.sparkContext._jvm
    fresh = jvm.org.apache.hadoop.fs.Path(at.getParent(), f".{at.getName()}-{uuid.uuid4().hex}")
    fs.mkdirs(at.getParent())
    out = fs.create(fresh, True)
    out.write(text.encode())
    out.close()
    kind = jvm.org.apache.hadoop.fs.Options.Rename
    how = spark.sparkContext._gateway.new_array(kind, 1)
    how[0] = kind.NONE if exclusive else kind.OVERWRITE
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(at.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    try:
        context.rename(context.makeQualified(fresh), context.makeQualified(at), how)
        return True
    except Py4JJavaError as error:
        if exclusive and error.java_exception.getClass().getSimpleName() == "FileAlreadyExistsException":
            fs.delete(fresh, False)
            return False
        raise
