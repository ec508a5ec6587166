"""Small helpers that the corpus operators share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom.operators.loops import Saved, scratch, shared_folder

__all__ = ["WORD", "Saved", "fold", "in_arrow", "named", "others", "packed", "scratch", "shared_folder", "small", "table", "text_crc", "unpacked", "word_count"]

#: A word: a longest run of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"
#: Rows of two longs at most that are sent to every executor; more are joined by a shuffle.
BROADCAST_ROWS = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def named(name: str) -> Column:
    """A column by its whole name, dots and backticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


def others(df: DataFrame, *left_out: str) -> list[str]:
    """Columns but those left out. What an operator adds takes the place of an input
    column of the same name."""
    gone = {c.lower() for c in left_out}
    return [c for c in df.columns if c.lower() not in gone]


def packed(names: list[str]) -> Column:
    """The columns as one struct `_row`: inside it no name meets one of an operator's own."""
    return F.struct(*([named(c).alias(c) for c in names] or [F.lit(0).alias("none")])).alias("_row")


def unpacked(names: list[str]) -> list[Column]:
    return [F.col("_row").getField(c).alias(c) for c in names]


def in_arrow(rows: DataFrame, run: Callable, added: str) -> DataFrame:
    """rows through mapInArrow: `run` returns `_row` and the columns that `added` declares."""
    return rows.mapInArrow(run, StructType([rows.schema["_row"], *StructType.fromDDL(added).fields]))


def small(rows: DataFrame, most: int = BROADCAST_ROWS) -> DataFrame:
    """rows, to be sent to every executor if counting finds `most` of them or fewer, else to be
    joined by a shuffle. The result of a join does not depend on it."""
    return rows.hint("broadcast" if rows.count() <= most else "merge")


def text_crc(column: Column) -> Column:
    """Unsigned CRC-32 of a string's UTF-8 bytes; null for null."""
    return F.crc32(column.cast("string").cast("binary"))


def fold(column: str, parts: int) -> Column:
    """crc32(column as text) mod parts; a null id falls in no fold (-1)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % parts, F.lit(-1))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
