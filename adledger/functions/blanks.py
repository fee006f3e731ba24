"""What counts as "no information" in a column."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from adledger import fixed


def blank_text(c: Column) -> Column:
    """Null, empty or spaces only."""
    return c.isNull() | (F.trim(c) == "")


def blank_number(c: Column) -> Column:
    """Null or zero."""
    return c.isNull() | (c == 0)


def some_text(c: Column) -> Column:
    """The text, or null when it says nothing."""
    return F.when(F.trim(c) != "", c)


def some_number(c: Column) -> Column:
    """The number, or null when it is zero."""
    return F.nullif(c, F.lit(0))


def is_true(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def uninformative(c: Column) -> Column:
    """Null, blank, or a word that stands for "nothing was learned"."""
    return c.isNull() | c.isin(*fixed.NO_INFORMATION) | (F.trim(c, F.lit(fixed.WHITESPACE)) == "")


def notes_of(*entries: Column) -> Column:
    """The notes that apply, in order, joined; empty when there is none."""
    return F.concat_ws("; ", *entries)


def join_notes(*parts: Column) -> Column:
    return F.concat_ws("; ", *[F.nullif(p, F.lit("")) for p in parts])


def flags_of(*entries: Column) -> Column:
    """The flags that apply, in order, as an array."""
    return F.array_compact(F.array(*entries))
