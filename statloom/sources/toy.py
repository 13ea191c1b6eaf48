"""Synthetic tables of known dependence, the same at every run: values are functions of the row number and the seed."""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

#: The columns a1, a2, ... of each table. U(k): uniform integer in [0, k); N(m, s): normal; C(p0, p1, ...):
#: 0, 1, ... with these probabilities.
TABLES = {
    "strong_corr_cont": ["N(0,20)", "N(0,20)", "a1+a2", "2.5*a1+5", "2.5*a2+5", "a1*a1/100+a5", "a1+a4+N(0,2)", "a3+a5+a6+a7"],
    "weak_corr_cont": ["U(10)", "U(3)", "a1+a2+C(0.8,0.2)", "N(10,20)", "2.5*a4+N(0,3)", "U(10)*U(10)+U(3)*a4/100", "a4/2+a1/2+N(0,3)", "2*a3+a4+N(0,3)"],
    "independent_cont": ["U(10)", "U(3)", "U(10)+U(3)", "N(10,20)", "2.5*N(10,20)", "U(3)*N(10,20)", "N(10,20)/2+U(10)", "2*U(10)+N(10,20)"],
    "strong_corr_cat": ["U(10)", "a1+C(0.9,0.1)", "a1+a2", "a3+C(0.8,0.1,0.1)", "a3+a4", "2*a2+U(10)", "a1+10", "a1+a4+a5+a7"],
    "medium_corr_cat": ["U(10)", "a1+C(0.9,0.1)", "a1+a2", "a3+C(0.8,0.1,0.1)", "U(10)", "a5+C(0.5,0.2,0.3)", "a4+a5+U(5)", "a4+U(10)", "U(20)", "U(20)+C(0.4,0.3,0.3)"],
    "weak_corr_cat": ["U(10)", "U(10)", "a1+a2+C(0.7,0.3)", "a1+C(0.7,0.2,0.1)", "U(40)", "a5+a4+C(0.7,0.3)", "a2+C(0.7,0.3)", "U(100)"],
    "independent_cat": ["U(10)", "U(11)", "U(21)+U(3)", "U(24)", "U(45)", "U(13)", "U(58)", "U(137)"],
    "sweep_total": ["U(4)", "a1+1", "a1+a2", "2*a1+1", "3*a2-1", "a5+a4", "a6-a3", "a2*a2", "a8+a7+a5+a3", "a9-a6-a4-a2-a1"],
    "sweep_high": ["U(3)", "a1+C(0.8,0.2)", "a1+C(0.7,0.2,0.1)", "2*a1+C(0.8,0.2)", "a2+a3", "U(3)", "a6+C(0.9,0.1)", "a6+a1", "2*a6+C(0.8,0.2)+a1", "a7+a9"],
    "sweep_medium": ["U(3)", "a1+C(0.7,0.3)", "a2+C(0.6,0.2,0.2)", "2*a1+C(0.8,0.2)", "a2+a3+C(0.7,0.3)", "U(3)", "a6+C(0.9,0.1)", "a6+a1", "2*a6+C(0.8,0.2)+a1", "a7+a9"],
    "sweep_slight": ["U(3)", "U(3)", "a1+a2+C(0.7,0.3)", "2*a1+C(0.7,0.2,0.1)", "a2+a3+C(0.7,0.3)", "U(3)", "a6+a4+C(0.7,0.3)", "a2+C(0.7,0.3)", "a6+C(0.7,0.3)", "a8+a9"],
    "sweep_independent": ["U(4)", "U(4)+1", "U(4)+2", "2*U(4)", "3*U(4)", "3*(U(4)+1)-1", "U(4)*U(4)", "2*U(4)+1", "U(4)", "U(4)"],
}


def toy(spark: SparkSession, name: str, rows: int = 500_000, seed: int = 0) -> DataFrame:
    df = spark.range(rows)
    salt = iter(range(seed * 1000, seed * 1000 + 1000))

    def share() -> str:
        return f"((pmod(xxhash64(id, {next(salt)}), 4294967296) + 0.5D) / 4294967296)"

    def drawn(m: re.Match) -> str:
        args = [float(x) for x in m[2].split(",")]
        if m[1] == "U":
            return f"floor({share()} * {int(args[0])})"
        if m[1] == "N":
            return f"({args[0]}D + {args[1]}D * sqrt(-2 * ln({share()})) * cos({2 * math.pi}D * {share()}))"
        u, total, parts = share(), 0.0, []
        for p in args[:-1]:
            total += p
            parts.append(f"int({u} >= {total}D)")
        return "(" + " + ".join(parts) + ")"

    for i, rule in enumerate(TABLES[name], 1):
        df = df.selectExpr("*", f"cast({re.sub(r'([UNC])[(]([0-9.,]+)[)]', drawn, rule)} as double) as a{i}")
    return df.drop("id")
