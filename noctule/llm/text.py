"""Column expressions shared by the operators of this package."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: What counts as a word in every contract: a run without ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def words(text: Column) -> Column:
    """Words of a text in order; NULL and white space give an empty array."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def n_words(text: Column) -> Column:
    """Number of words; 0 for NULL."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def in_fold(key: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the key's text falls in a fold; a NULL key falls in none."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds == fold, F.lit(False))


def only(df: DataFrame, *columns: str) -> DataFrame:
    """The named columns, so that nothing else can clash with an operator's own."""
    return df.select(*(F.col(f"`{c}`") for c in columns))
