"""The attribute catalog of a table: names, statistical types, domains."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import Enum

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class MetaType(str, Enum):
    REAL = "REAL"
    BINARY = "BINARY"
    DISCRETE = "DISCRETE"


class StatType(str, Enum):
    REAL = "REAL"
    INTERVAL = "INTERVAL"
    POSITIVE = "POSITIVE"
    CATEGORICAL = "CATEGORICAL"
    ORDINAL = "ORDINAL"
    COUNT = "COUNT"
    BINARY = "BINARY"

    @property
    def meta(self) -> MetaType:
        if self in (StatType.REAL, StatType.INTERVAL, StatType.POSITIVE):
            return MetaType.REAL
        return MetaType.BINARY if self is StatType.BINARY else MetaType.DISCRETE


@dataclass(frozen=True)
class Attribute:
    attr_id: int
    name: str
    meta: MetaType
    low: float | None = None
    high: float | None = None
    ndv: int | None = None


#: A column of at most so many distinct values may be grouped by; above it an integer column counts as REAL.
GROUP_BY_LIMIT = 1200


@dataclass(frozen=True)
class Context:
    attributes: tuple[Attribute, ...]

    @classmethod
    def of(cls, df: DataFrame, columns: list[str] | None = None, meta: dict[str, MetaType] | None = None, null_values: dict[str, float] | None = None) -> Context:
        """Types from meta, else from the schema and the numbers of distinct values; domains from one aggregation."""
        columns = columns or [f.name for f in df.schema if isinstance(f.dataType, T.NumericType)]
        profile = domains(df, columns, null_values).collect()  # one row per column
        out = []
        for i, (c, r) in enumerate(zip(columns, profile, strict=True)):
            kind = (meta or {}).get(c)
            if kind is None:
                integral = isinstance(df.schema[c].dataType, T.IntegralType | T.BooleanType)
                small = r.ndv <= GROUP_BY_LIMIT
                kind = MetaType.BINARY if r.ndv <= 2 and r.lo in (0, 1, None) and r.hi in (0, 1, None) else MetaType.DISCRETE if small and integral else MetaType.REAL
            out.append(Attribute(i, c, MetaType(kind), r.lo, r.hi, r.ndv))
        return cls(tuple(out))

    @classmethod
    def binary(cls, df: DataFrame, columns: list[str]) -> Context:
        return cls.of(df, columns, dict.fromkeys(columns, MetaType.BINARY))

    @classmethod
    def categorical(cls, df: DataFrame, columns: list[str]) -> Context:
        return cls.of(df, columns, dict.fromkeys(columns, MetaType.DISCRETE))

    @property
    def names(self) -> list[str]:
        return [a.name for a in self.attributes]

    def meta_of(self, scope: list[int]) -> list[MetaType]:
        return [self.attributes[i].meta for i in scope]

    def domains_of(self, scope: list[int]) -> list[tuple[float | None, float | None]]:
        return [(self.attributes[i].low, self.attributes[i].high) for i in scope]

    def with_meta(self, name: str, meta: MetaType) -> Context:
        return Context(tuple(replace(a, meta=meta) if a.name == name else a for a in self.attributes))

    def groupable(self) -> list[str]:
        return [a.name for a in self.attributes if a.ndv is not None and a.ndv <= GROUP_BY_LIMIT]


def schema_context(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, name, meta, lo, hi, ndv, groupable) of the numeric columns of several tables. Columns that aren't groupable are those
    whose values are too many to be kept one by one."""
    rows = [(t, a.name, a.meta.value, a.low, a.high, a.ndv, a.ndv <= GROUP_BY_LIMIT) for t, df in tables.items() for a in Context.of(df).attributes]
    return next(iter(tables.values())).sparkSession.createDataFrame(rows, "table string, name string, meta string, lo double, hi double, ndv long, groupable boolean")


def domains(df: DataFrame, columns: list[str], null_values: dict[str, float] | None = None) -> DataFrame:
    """(attr_id, name, lo, hi, n, n_null, ndv), one pass with map-side combine; ndv is exact."""
    value = {c: F.col(c).cast("double") for c in columns}
    for c, v in (null_values or {}).items():
        value[c] = F.nullif(value[c], F.lit(float(v)))
    value = {c: F.when(~F.isnan(v), v) for c, v in value.items()}
    long = df.select(F.explode(F.array(*[F.struct(F.lit(i).alias("attr_id"), F.lit(c).alias("name"), value[c].alias("v")) for i, c in enumerate(columns)])).alias("x"))
    counts = long.groupBy("x.attr_id", "x.name", "x.v").agg(F.count("*").alias("k"))
    out = counts.groupBy("attr_id", "name").agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("k").alias("n"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("k"))), F.lit(0)).alias("n_null"), F.count("v").alias("ndv"))
    return out.orderBy("attr_id")


def encode_strings(df: DataFrame, column: str, code: str) -> tuple[DataFrame, DataFrame]:
    """df with a dictionary code of column (ranks of its sorted distinct values, from 0), and the dictionary.

    The ranks come from a range partition of the distinct values, so no task sees all of them.
    """
    from statloom.functions.prefix import rank_values

    words = rank_values(df.select(column).where(F.col(column).isNotNull()).distinct(), column, code)
    return df.join(words, column, "left"), words
