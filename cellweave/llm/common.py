"""Helpers that the operators of this package share."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of the word definition, fixed by the contracts: space and U+0009 to U+000D.
SPACE = " \t\n\x0b\f\r"
#: The same for Java's and Python's regular expressions.
SPACE_RE = r"[\x20\x09-\x0D]+"
WORD_RE = r"[^\x20\x09-\x0D]+"


#: Paths given out inside each open scratch(), the innermost last.
_open: list[list[str]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what operators wrote to the shared folder inside; results that still read it must be written by then."""
    _open.append([])
    try:
        yield
    finally:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        for written in _open.pop():
            path = jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(conf).delete(path, True)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the session names in spark.checkpoint.dir.

    Where that is unset, a local session (as in tests) gets a temporary folder; a cluster must name one.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cellweave-"))
        root = spark.sparkContext.getCheckpointDir()
    path = f"{root.rstrip('/')}/cellweave/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df once to the shared folder and return the written table: short lineage that any executor can read again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: Column) -> Column:
    """The words of a text as an array; a null or blank text has none."""
    trimmed = F.trim(F.coalesce(text, F.lit("")), F.lit(SPACE))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE_RE))


def let(value: Column, body) -> Column:
    """body(value) with value worked out once for the row, bound as a lambda variable."""
    return F.transform(F.array(value), body)[0]


def fresh(columns: list[str], name: str) -> str:
    """A column name like `name` that none of columns has, upper and lower case alike."""
    taken, out = {c.lower() for c in columns}, f"_{name}"
    while out.lower() in taken:
        out = f"_{out}"
    return out


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")
