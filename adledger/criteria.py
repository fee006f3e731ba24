"""Search criteria: one frozen object for a run, or one row per saved search.

Rules read thresholds as Columns, so the same rule serves both forms:
``Criteria.columns()`` gives literals, ``criteria_from_row()`` gives the columns
of a joined criteria table.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
import re
from types import SimpleNamespace

from pyspark.sql import functions as F

FURNISHINGS = ("furnished", "unfurnished", "either")
AIRCON_MODES = ("preferred", "required", "ignored")
CONCIERGE_MODES = ("preferred", "expected", "ignored")
DATE_FORMATS = ("%Y-%m-%d", "%d %B %Y", "%d %b %Y", "%d/%m/%Y")


class CriteriaError(ValueError):
    """A criteria value that cannot be used."""


@dataclasses.dataclass(frozen=True)
class Criteria:
    budget_pcm: int
    min_bedrooms: int = 0
    max_bedrooms: int = 0
    min_bathrooms: int = 0
    furnishing: str = "either"
    furnishing_strict: bool = False
    min_sqft: int = 0
    good_floor_from: int = 2
    lift_required_from_floor: int = 3
    aircon: str = "preferred"
    concierge: str = "preferred"
    districts_only: bool = False
    prime: tuple = ()
    affluent: tuple = ()
    fringe: tuple = ()
    move_in: dt.date | None = None
    move_in_slack_days: int = 7
    first_run_days: int = 14

    def __post_init__(self):
        for name, allowed in (("furnishing", FURNISHINGS), ("aircon", AIRCON_MODES),
                              ("concierge", CONCIERGE_MODES)):
            value = str(getattr(self, name)).strip().lower()
            if value not in allowed:
                raise CriteriaError(f"{name} must be one of {', '.join(allowed)}")
            object.__setattr__(self, name, value)
        for field in dataclasses.fields(self):
            if field.type != "int":
                continue
            value = getattr(self, field.name)
            if isinstance(value, bool) or not isinstance(value, int) or value < 0:
                raise CriteriaError(f"{field.name} must be a whole number, not negative")
        if self.budget_pcm == 0:
            raise CriteriaError("budget_pcm must be greater than 0")
        if self.max_bedrooms and self.max_bedrooms < self.min_bedrooms:
            raise CriteriaError("max_bedrooms is below min_bedrooms: nothing can match")
        for name in ("prime", "affluent", "fringe"):
            words = (str(w).strip().lower() for w in getattr(self, name))
            object.__setattr__(self, name, tuple(w for w in words if w))
        object.__setattr__(self, "move_in", _as_date(self.move_in))

    def columns(self) -> SimpleNamespace:
        lit = {f.name: F.lit(getattr(self, f.name)) for f in dataclasses.fields(self)
               if f.name not in ("prime", "affluent", "fringe", "move_in")}
        return SimpleNamespace(
            **lit, move_in=F.lit(self.move_in).cast("date"),
            tiers=(self.prime, self.affluent, self.fringe))


def criteria_from_row(prefix: str = "") -> SimpleNamespace:
    """Thresholds as columns of a criteria table (tier lists are arrays)."""
    names = [f.name for f in dataclasses.fields(Criteria)
             if f.name not in ("prime", "affluent", "fringe")]
    cols = {n: F.col(prefix + n) for n in names}
    return SimpleNamespace(
        **cols, tiers=tuple(F.col(prefix + n) for n in ("prime", "affluent", "fringe")))


def _as_date(value) -> dt.date | None:
    if value is None or isinstance(value, dt.date):
        return value
    text = re.sub(r"\s+", " ", str(value)).strip()
    if not text:
        return None
    for fmt in DATE_FORMATS:
        try:
            return dt.datetime.strptime(text, fmt).date()
        except ValueError:
            pass
    raise CriteriaError(f"move_in is not a readable date: {value!r}")
