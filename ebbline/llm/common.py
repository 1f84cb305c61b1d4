"""Shared helpers of the training-data operators."""

from __future__ import annotations

import ctypes
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbline.sources import scratch

#: White space that separates words: space, tab, LF, VT, FF and CR.
BLANKS = " \t\n\x0b\x0c\r"
#: The same as a Java pattern.
BLANK_RUN = r"[ \t\n\x0B\f\r]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Rows of an Arrow batch while a table is cut.
BATCH_ROWS = 2_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"
#: A side of a join is broadcast only when it was counted and has no more rows than this.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once: a lambda variable binds it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay as they are."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words between runs of ASCII white space, as an array; no words give an empty one."""
    trimmed = F.btrim(text, F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and read back from a table in the shared folder: its lineage ends there. The table goes when the application ends, or with ``discard``.

    While it is computed, Arrow batches are short: texts are long, and a worker holds a batch as a whole."""
    spark = df.sparkSession
    path = scratch.fresh(spark)
    before = spark.conf.get(_BATCH)
    spark.conf.set(_BATCH, str(int(before) if 0 < int(before) < BATCH_ROWS else BATCH_ROWS))
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_BATCH, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.ebbline_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``cut`` that nothing reads any more."""
    for df in tables:
        files, at = scratch.file_system(df.sparkSession, df.ebbline_path)
        files.delete(at, True)


def plain(df: DataFrame, *wanted: str) -> tuple[DataFrame, list[str], list[str]]:
    """df with columns named c0, c1, ... that clash with nothing, its own names for ``toDF`` afterwards, and what the wanted columns are called meanwhile."""
    names = df.columns
    return df.toDF(*(f"c{i}" for i in range(len(names)))), names, [f"c{names.index(w)}" for w in wanted]


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in gone (key, distinct); all columns stay, whatever their names."""
    rows, names, (at,) = plain(docs, key)
    few = maybe_broadcast(gone.select(F.col(key).alias("__gone")), gone.count())
    return rows.join(few, F.col(at) == F.col("__gone"), "left_anti").toDF(*names)


def release() -> None:
    """Gives back what a worker's pools keep: workers live on after a task, beside those of other steps."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def maybe_broadcast(df: DataFrame, rows: int, bound: int = BROADCAST_ROWS) -> DataFrame:
    """A broadcast hint for a side of a counted size; beyond the bound Spark shuffles and splits skewed keys."""
    return F.broadcast(df) if rows <= bound else df
