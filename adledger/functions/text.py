"""Text clean-up as column expressions."""

from __future__ import annotations

import html

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from adledger import fixed

_MARK = "\u0001"


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def mentions(low: Column, *words: str) -> Column:
    """Any of some plain words occurs: a byte search that spares a regex."""
    hit = F.contains(low, F.lit(words[0]))
    for w in words[1:]:
        hit = hit | F.contains(low, F.lit(w))
    return hit


def strip(c: Column, chars: str = fixed.WHITESPACE) -> Column:
    return F.trim(c, F.lit(chars))


def squash(c: Column) -> Column:
    """Runs of whitespace become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(c, r"(?U)\s+", " "))


def norm_text(c: Column) -> Column:
    """Form used to compare quotes: plain quotes and dashes, one space, lower case."""
    plain = F.translate(F.coalesce(c, F.lit("")), fixed.PUNCT_FROM, fixed.PUNCT_TO)
    return F.lower(squash(plain))


def fingerprint(c: Column) -> Column:
    """16 hex digits of the SHA-256 of the normalised text."""
    return F.substring(F.sha2(norm_text(c), 256), 1, 16)


def url_key(c: Column) -> Column:
    """16 hex digits of the SHA-1 of the trimmed URL."""
    return F.substring(F.sha1(strip(c)), 1, 16)


@F.pandas_udf(StringType())
def _decode_entities(s: pd.Series) -> pd.Series:
    return s.map(html.unescape, na_action="ignore")


def unescape(c: Column) -> Column:
    """HTML entities decoded. Only texts holding an ``&`` leave the JVM."""
    has_entity = F.contains(c, F.lit("&"))
    return F.when(has_entity, _decode_entities(F.when(has_entity, c))).otherwise(c)


def html_to_text(c: Column) -> Column:
    return squash(unescape(F.regexp_replace(c, "<[^>]+>", " ")))


def unescape_items(items: Column) -> Column:
    """Entities decoded in every item of a string array."""
    joined = unescape(F.array_join(items, _MARK))
    return F.when(F.size(items) == 0, items).otherwise(F.split(joined, _MARK))


def cut_boilerplate(c: Column, marker: str = fixed.BOILERPLATE) -> Column:
    """Text before the first boilerplate marker."""
    return F.when(c.rlike(marker), strip(F.get(F.split(c, marker, 2), F.lit(0)))).otherwise(c)


def challenged(page: Column, body: Column, pattern: str = fixed.CHALLENGE) -> Column:
    """A bot check rather than a page: in the body's head or in the title."""
    title = F.regexp_extract(F.coalesce(page, F.lit("")), fixed.TITLE, 1)
    head = F.substring(F.coalesce(body, F.lit("")), 1, 4000)
    return head.rlike(pattern) | F.substring(title, 1, 200).rlike(pattern)


def heading_pos(low: Column, anchor: str, start: Column | int = 1) -> Column:
    """1-based position, at or after ``start``, of an anchor that begins a line; else 0."""
    a = anchor.lower()
    start = start if isinstance(start, Column) else F.lit(start)
    later = let(F.position(F.lit("\n" + a), low, F.greatest(start - 1, F.lit(1))),
                lambda newline: F.when(newline > 0, newline + 1).otherwise(0))
    return F.when((start == 1) & F.startswith(low, F.lit(a)), 1).otherwise(later)


def slice_between(c: Column, starts, ends, minlen: int = 80) -> Column:
    """Text from the first start anchor to the nearest line-start end anchor.

    A start whose slice is shorter than ``minlen`` gives way to the next one;
    no start at all gives an empty text.
    """
    def from_start(low: Column, anchor: str) -> Column:
        def cut(at: Column) -> Column:
            begin = at + len(anchor)
            stops = [F.nullif(heading_pos(low, e, begin), F.lit(0)) for e in ends]
            piece = c.substr(begin, F.least(F.length(c) + 1, *stops) - begin)
            piece = strip(F.regexp_replace(piece, r"[ \t]*\n[ \t]*", " "), " |\n\t:")
            return let(F.when(at > 0, F.regexp_replace(piece, r"(?U)\s{2,}", " ")),
                       lambda p: F.when(F.length(p) >= minlen, p))

        return let(F.position(F.lit(anchor.lower()), low), cut)

    return F.coalesce(let(F.lower(c), lambda low: F.coalesce(
        *[from_start(low, s) for s in starts])), F.lit(""))


def labelled_value(c: Column, label: str) -> Column:
    """Value after a label in flat text, cut at the next known label; null if none."""
    import re
    raw = F.regexp_extract(c, "(?U)" + re.escape(label) + fixed.LABEL_VALUE, 1)
    head = F.get(F.split(strip(raw), fixed.STOP_LABELS, 2), F.lit(0))
    return F.nullif(strip(head, " :,-"), F.lit(""))
