"""Tables that are published whole: a new version is written aside, and readers follow one pointer.

A version is a folder of its own. Pointers are small files numbered from 1, each naming a version; the
highest number holds. A pointer comes to be by a rename that never replaces, so of two writers who saw the
same state only one succeeds, and a reader sees the old version or the new one, never a part of either.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

from .tables import delete


class Conflict(RuntimeError):
    """Another writer has published since the state that this one started from."""


def _path(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = where.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs.makeQualified(where), fs


def rename_to_free(spark: SparkSession, made: str, target: str) -> bool:
    """Rename a file or folder to a name that must be free; False, and nothing changes, if it is taken."""
    where, fs = _path(spark, target)
    fs.mkdirs(where.getParent())
    options = spark._jvm.org.apache.hadoop.fs.Options.Rename
    free = spark.sparkContext._gateway.new_array(options, 1)
    free[0] = options.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(where.toUri(), spark._jsc.hadoopConfiguration()).rename(_path(spark, made)[0], where, free)
        return True
    except Py4JJavaError:
        if not fs.exists(where):
            raise
        return False


def exists(spark: SparkSession, path: str) -> bool:
    where, fs = _path(spark, path)
    return fs.exists(where)


def ensure(spark: SparkSession, path: str) -> None:
    """Make a folder, if it is not there."""
    where, fs = _path(spark, path)
    fs.mkdirs(where)


def state(spark: SparkSession, root: str) -> int:
    """The number of the pointer that holds; 0 before anything is published."""
    where, fs = _path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    return max((int(m[1]) for n in names if (m := re.fullmatch(r"current-(\d+)", n))), default=0)


def _read(spark: SparkSession, root: str, number: int) -> str:
    where, fs = _path(spark, f"{root}/current-{number}")
    stream = fs.open(where)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def current(spark: SparkSession, root: str) -> str:
    """The folder of the version that holds now. It stays readable when a newer one is published, until `clean`."""
    if not (number := state(spark, root)):
        raise FileNotFoundError(f"nothing is published in {root}")
    return f"{root}/{_read(spark, root, number)}"


def publish(df: DataFrame, root: str, kind: str = "parquet", expected: int | None = None, **options) -> str:
    """Write a new version and make it the one that holds; returns its folder.

    With `expected`, the state that the caller has read, nothing is published and Conflict is raised if there
    is a newer one. Without it the last to finish wins. A write that fails or is killed leaves what was.
    """
    spark, name = df.sparkSession, f"version-{uuid.uuid4().hex}"
    df.write.format(kind).options(**options).save(f"{root}/{name}")
    while True:
        seen = state(spark, root)
        if expected is not None and seen != expected:
            delete(spark, [f"{root}/{name}"])
            raise Conflict(f"{root} is at {seen} and not at {expected}")
        draft = f"{root}/.pointer-{uuid.uuid4().hex}"
        where, fs = _path(spark, draft)
        out = fs.create(where, False)
        out.write(bytearray(name.encode()))
        out.close()
        if rename_to_free(spark, draft, f"{root}/current-{seen + 1}"):
            return f"{root}/{name}"
        delete(spark, [draft])


def clean(spark: SparkSession, root: str, keep: int = 2) -> None:
    """Remove versions older than the last `keep`, and what failed writes have left; no write may run meanwhile."""
    number = state(spark, root)
    held = {_read(spark, root, n) for n in range(max(1, number - keep + 1), number + 1)}
    where, fs = _path(spark, root)
    names = [s.getPath().getName() for s in fs.listStatus(where)] if fs.exists(where) else []
    old = [n for n in names if (n.startswith("version-") and n not in held) or n.startswith(".pointer-") or ((m := re.fullmatch(r"current-(\d+)", n)) and int(m[1]) <= number - keep)]
    delete(spark, [f"{root}/{n}" for n in old])
