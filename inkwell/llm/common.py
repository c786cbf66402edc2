"""Reading tables, cutting lineage in the shared folder, and small column helpers."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that separate words: space, tab, line feed, vertical tab, form feed, carriage return.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: Folders that written() has made in this thread, so that clean() of one run leaves those of other threads alone.
_WRITTEN: ContextVar[list[str]] = ContextVar("written")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a session in one process (tests) gets
    a temporary folder; a cluster gets an error, as its executors could not read each other's disks."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-shared-"))
        found = spark.sparkContext.getCheckpointDir()
    return found.rstrip("/")


def written_paths() -> list[str]:
    """This thread's folders that written() has made and clean() has not deleted."""
    try:
        return _WRITTEN.get()
    except LookupError:
        _WRITTEN.set(paths := [])
        return paths


def written(df: DataFrame) -> DataFrame:
    """df, computed once and read back from Parquet in the shared folder, so that lost executors need no recomputation."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/inkwell-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written_paths().append(path)
    return spark.read.schema(df.schema).parquet(path)


def position() -> int:
    """How many tables written() has made so far in this thread; for clean()."""
    return len(written_paths())


def clean(spark: SparkSession, since: int = 0, keep_last: bool = False) -> None:
    """Deletes what written() has left in the shared folder since a position; for when a job's results, or a stage's, are stored.

    keep_last: the newest table stays.
    """
    paths = written_paths()
    kept = [paths.pop()] if keep_last and len(paths) > since else []
    while len(paths) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    paths.extend(kept)


def named(df: DataFrame, *without: str) -> list[Column]:
    """The columns of df, whatever their names hold, but for the given names (in any case, as Spark compares them)."""
    gone = {w.lower() for w in without}
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c.lower() not in gone]


def whole(df: DataFrame, *without: str) -> Column:
    """A row as one struct, so that operators can add columns beside it without a clash."""
    return F.struct(*named(df, *without))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that no column of df has (Spark compares names without regard to case)."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once a row, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


#: Characters besides A-Z that lower() would change.
OTHER_CAPITALS = r"[\p{IsUppercase}\p{Lt}&&[^A-Z]]"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case, all else unchanged; lower() where it does just that, as it is several times faster."""
    only_ascii = F.octet_length(text) == F.length(text)
    return F.when(only_ascii | ~text.rlike(OTHER_CAPITALS), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def blank_words(text: Column) -> Column:
    """The maximal runs of characters other than BLANKS; null has none."""
    return F.coalesce(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+", -1), ""), F.array().cast("array<string>"))
