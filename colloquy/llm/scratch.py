"""Written tables in the folder that the cluster shares: they cut lineage and outlive a lost executor."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from colloquy.sources.shared import fresh

#: Rows of one key from which its join is a broadcast of its few rows on the other side.
HOT_ROWS = 100_000

#: Stands for a null id inside the operators: smaller than every id in use, and given back as null.
NULL_ID = -(2**63)


_made: list[str] = []


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Deletes on leaving what scratch tables were begun inside; their results must be written by then."""
    before = len(_made)
    yield
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while len(_made) > before:
        path = jvm.org.apache.hadoop.fs.Path(_made.pop())
        path.getFileSystem(conf).delete(path, True)


#: Spark deletes the shuffle files of a query when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


class Scratch:
    """Parquet tables under the shared folder; with ``release`` what was shuffled for a table goes when it is written."""

    def __init__(self, spark: SparkSession, name: str, release: bool = False):
        self.spark = spark
        self.release = release
        self.root = fresh(spark, name)
        self.n = 0
        _made.append(self.root)

    def save(self, df: DataFrame) -> DataFrame:
        """Writes ``df`` and returns the table read back."""
        self.n += 1
        path = f"{self.root}/{self.n}"
        before = self.spark.conf.get(CLEANUP, "false")
        try:
            self.spark.conf.set(CLEANUP, "true" if self.release else before)
            df.write.parquet(path)
        finally:
            self.spark.conf.set(CLEANUP, before)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, *tables: DataFrame) -> None:
        """Deletes tables that nothing reads any more."""
        jvm, sc = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in tables:
            for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
                path = jvm.org.apache.hadoop.fs.Path(folder)
                path.getFileSystem(sc).delete(path, True)


@contextmanager
def batch_bytes(spark: SparkSession, size: int) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes: a task holds its batch in the JVM and again in Python."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    try:
        spark.conf.set(key, str(size))
        yield
    finally:
        spark.conf.set(key, before)


def id_in(name: str = "doc_id") -> Column:
    return F.coalesce(F.col(name).cast("long"), F.lit(NULL_ID))


def id_out(column) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.nullif(column, F.lit(NULL_ID))


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns whatever their names, whose doc_id is not in the one column of ``ids``.

    Null ids stay; they are dealt by their text, so that no task gets them all.
    """
    key = docs["doc_id"].cast("long")
    dealt = F.coalesce(key, F.xxhash64(docs["text"].cast("string")))
    return docs.join(ids, (dealt == ids[ids.columns[0]]) & key.isNotNull(), "left_anti")


def join_hot(rows: DataFrame, few: DataFrame, on: list[str], hot: DataFrame) -> DataFrame:
    """``rows`` left-joined with ``few``, which has at most one row for each key, so that no task gets all rows of a hot key.

    ``hot`` has the keys with more than ``HOT_ROWS`` rows: at most one for each so many, hence broadcast, as is their side
    of ``few``. All other rows meet in a plain join. Keys are not null.
    """
    if not hot.head(1):
        return rows.join(few, on, "left")
    hot = F.broadcast(hot.select(*on))
    rest = rows.join(hot, on, "left_anti").join(few, on, "left")
    return rest.unionByName(rows.join(hot, on, "left_semi").join(F.broadcast(few.join(hot, on, "left_semi")), on, "left"))
