"""Words, as every operator of this package counts them, and small frame helpers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from wireloom.functions.shipping import ship

#: Space, tab, line feed, vertical tab, form feed, carriage return: what ``bytes.split()`` splits at.
WHITE = bytes([0x20, *range(0x09, 0x0E)])
WORD = r"[^\x20\x09-\x0D]+"


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of characters other than ASCII white space; none for null.
    Lone surrogates, which UTF-8 lacks, are kept as they are."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until ``df`` has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


ship(__name__)
