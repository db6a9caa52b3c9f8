"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.tables import bounded_batches  # noqa: F401

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
#: Java class of a character that is no ASCII white space.
WORD = "[^\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one of this machine, which only a local master can share."""
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not root:
        if not re.fullmatch(r"local(\[[^\]]*\])?", sc.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = tempfile.mkdtemp(prefix="lexspark-")
        sc.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder, removed when the application ends."""
    path = f"{shared_dir(spark)}/lexspark-{what}-{uuid.uuid4().hex}"
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path


def stored(df: DataFrame, what: str) -> DataFrame:
    """df, written once to the shared folder: it cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes what stored() wrote for df, once nothing reads it any more."""
    for f in {x.rsplit("/", 1)[0] for x in df.inputFiles()}:
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)


def small(df: DataFrame, rows: int) -> DataFrame:
    """df with a broadcast hint if it has at most so many rows, else df: Spark then plans a shuffled join.

    Only for stored tables of fixed-width rows, whose count is a read of footers.
    """
    return F.broadcast(df) if df.count() <= rows else df


_HELD: dict = {}


def held(key=None, make: Callable[[], object] | None = None):
    """The one object that a worker keeps from task to task; another key's makes way, and without a key none is kept."""
    if key is None or key not in _HELD:
        _HELD.clear()
        if make:
            _HELD[key] = make()
    return _HELD.get(key)


def neutral(df: DataFrame, *wanted: str | None) -> tuple[DataFrame, list[str | None], Callable[..., DataFrame]]:
    """df with its columns named c0, c1 and so on, so that no name clashes with an operator's own; the new names of wanted; and what gives back the old ones.

    The last takes a DataFrame and columns to add at the end, which take the place of columns of that name.
    """
    new = [f"c{i}" for i in range(len(df.columns))]
    exact, loose = dict(zip(df.columns, new)), dict(zip(map(str.lower, df.columns), new))

    def back(out: DataFrame, *more: str) -> DataFrame:
        low = {m.lower() for m in more}
        held = [(n, c) for n, c in zip(new, df.columns) if c.lower() not in low]
        return out.select(*[n for n, _ in held], *more).toDF(*[c for _, c in held], *more)

    return df.toDF(*new), [None if w is None else exact.get(w) or loose[w.lower()] for w in wanted], back


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """The words of a text (null: none), as the fixed class of ASCII white space splits it."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), "[\\x20\\x09-\\x0D]+"), "")
