"""Predicates as objects: what a query says of one column, and their flat form as rows of intervals.

A NumericRange is a union of intervals, a NominalRange a set of values. flat() writes a batch of conditions as the rows that
predicates.interval_probability() joins with a leaf, so that the number of intervals is data and not part of a plan.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Interval:
    lo: float = -math.inf
    hi: float = math.inf
    lo_inc: bool = True
    hi_inc: bool = True

    @property
    def empty(self) -> bool:
        return self.lo > self.hi or (self.lo == self.hi and not (self.lo_inc and self.hi_inc))

    def meet(self, other: Interval) -> Interval:
        lo, hi = max(self.lo, other.lo), min(self.hi, other.hi)
        at = lambda end, inc, v: all(getattr(i, inc) for i in (self, other) if getattr(i, end) == v)
        return Interval(lo, hi, at("lo", "lo_inc", lo), at("hi", "hi_inc", hi))


@dataclass(frozen=True)
class NumericRange:
    """A union of intervals; null_too: whether null fulfils it."""

    intervals: tuple[Interval, ...] = field(default=(Interval(),))
    null_too: bool = False

    def is_impossible(self) -> bool:
        return not self.null_too and all(i.empty for i in self.intervals)

    def meet(self, other: NumericRange) -> NumericRange:
        both = [i.meet(j) for i in self.intervals for j in other.intervals]
        return NumericRange(tuple(i for i in both if not i.empty), self.null_too and other.null_too)

    def disjoint(self) -> tuple[Interval, ...]:
        """The same union as disjoint intervals in ascending order."""
        out: list[Interval] = []
        for i in sorted((i for i in self.intervals if not i.empty), key=lambda i: (i.lo, not i.lo_inc)):
            last = out[-1] if out else None
            if last and (i.lo < last.hi or (i.lo == last.hi and (i.lo_inc or last.hi_inc))):
                hi, inc = max((last.hi, last.hi_inc), (i.hi, i.hi_inc))
                out[-1] = Interval(last.lo, hi, last.lo_inc, inc)
            else:
                out.append(i)
        return tuple(out)

    def holds(self, x: Column) -> Column:
        inside = F.lit(False)
        for i in self.disjoint():
            inside = inside | ((x >= i.lo if i.lo_inc else x > i.lo) & (x <= i.hi if i.hi_inc else x < i.hi))
        return F.coalesce(inside, F.lit(False)) | (x.isNull() & F.lit(self.null_too))


@dataclass(frozen=True)
class NominalRange:
    """A set of values; null_too: whether null fulfils it."""

    values: frozenset[float]
    null_too: bool = False

    def is_impossible(self) -> bool:
        return not self.values and not self.null_too

    def meet(self, other: NominalRange) -> NominalRange:
        return NominalRange(self.values & other.values, self.null_too and other.null_too)

    def disjoint(self) -> tuple[Interval, ...]:
        return tuple(Interval(v, v) for v in sorted(self.values))

    def holds(self, x: Column) -> Column:
        return F.coalesce(x.isin(sorted(self.values)), F.lit(False)) | (x.isNull() & F.lit(self.null_too))


FLAT = "query_id long, column string, intervals array<struct<lo:double,hi:double,lo_inc:boolean,hi_inc:boolean>>, null_too boolean, inverted boolean"


def flat(spark: SparkSession, conditions: list[dict[str, NumericRange | NominalRange]], inverted: frozenset[str] = frozenset()) -> DataFrame:
    """(query_id, column, intervals, null_too, inverted): one row for each condition; inverted names columns of whose values the inverse counts."""
    rows = [(i, c, [(float(v.lo), float(v.hi), v.lo_inc, v.hi_inc) for v in r.disjoint()], r.null_too, c in inverted) for i, q in enumerate(conditions) for c, r in q.items()]
    return spark.createDataFrame(rows, FLAT)


def holds(condition: dict[str, NumericRange | NominalRange]) -> Column:
    """Whether a row fulfils all of a query's conditions."""
    out = F.lit(True)
    for c, r in condition.items():
        out = out & r.holds(F.col(c))
    return out
