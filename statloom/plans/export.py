"""Models as text and as SQL expressions.

as_text() and from_text() keep every kind of node, shared ones once. as_sql() writes a model's likelihood as one SQL expression
over a row's columns, which Catalyst compiles into the scan's own code, and which other SQL engines read too; as_column() is
the same as a Spark column.
"""

from __future__ import annotations

import json
import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from statloom.operators.columns import ChowLiuTree
from statloom.plans import nodes as N
from statloom.plans.shapes import DISCRETE, Gaussians, Parametric, Piecewise, TreeLeaf

KINDS: dict[str, type] = {c.kind: c for c in (N.Leaf, N.Joint, N.Sum, N.Product, N.Factorize, N.Split, Parametric, Piecewise, TreeLeaf, Gaussians)}
#: Fields of each kind that its text holds, beside id, scope and children.
FIELDS: dict[str, tuple[str, ...]] = {
    "leaf": ("lo", "hi", "pdf", "value", "non_null", "rows", "discrete"),
    "joint": ("low", "high", "pdf", "rows"),
    "sum": ("weights", "centres", "rows"),
    "product": (),
    "factorize": ("condition",),
    "split": ("boxes", "weights", "rows"),
    "parametric": ("family", "a", "b", "c", "non_null", "rows"),
    "piecewise": ("x", "y", "non_null", "rows"),
    "gaussians": ("mean", "cov"),
}


def _plain(v):
    if isinstance(v, np.ndarray):
        return v.tolist()
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list | tuple) else v.item() if isinstance(v, np.generic) else v


def as_text(root: N.Node) -> str:
    """One line of JSON for each node, children first; the last is the root."""
    number = {id(n): i for i, n in enumerate(reversed(N._topological(root)))}
    lines = []
    for n in reversed(N._topological(root)):
        d = {"id": number[id(n)], "kind": n.kind, "scope": list(n.scope), "children": [number[id(c)] for c in n.children]}
        d |= {"columns": list(n.tree.columns), "parent": list(n.tree.parent), "order": list(n.tree.order), "log_factor": n.tree.log_factor.tolist()} if n.kind == "tree" else {f: _plain(getattr(n, f)) for f in FIELDS[n.kind]}
        lines.append(json.dumps(d, sort_keys=True))
    return "\n".join(lines)


def from_text(text: str) -> N.Node:
    made: dict[int, N.Node] = {}
    node = None
    for line in text.splitlines():
        d = json.loads(line)
        kids, scope = [made[c] for c in d["children"]], d["scope"]
        if d["kind"] == "tree":
            node = TreeLeaf(scope, tree=ChowLiuTree(d["columns"], d["parent"], d["order"], np.array(d["log_factor"])))
        else:
            given = {f: d[f] for f in FIELDS[d["kind"]]}
            value = given.pop("value", None)
            arrays = {k: np.array(v, float) for k, v in given.items() if k in ("lo", "hi", "pdf", "low", "high", "weights", "x", "y", "mean", "cov")}
            if d["kind"] == "joint":
                arrays |= {k: arrays[k].reshape(-1, len(scope)) for k in ("low", "high")}
            if given.get("centres"):
                arrays["centres"] = [np.array(c) for c in given["centres"]]
            if "boxes" in given:
                arrays["boxes"] = [{c: tuple(b) for c, b in box.items()} for box in given["boxes"]]
            node = KINDS[d["kind"]](scope, kids, **given | arrays)
            if value is not None:
                node.value = np.array(value)
        made[d["id"]] = node
    return N.assign_ids(node)


def _number(v: float) -> str:
    if math.isinf(v):
        return f"CAST('{'-' if v < 0 else ''}Infinity' AS DOUBLE)"
    return f"CAST({float(v)!r} AS DOUBLE)"


def _cases(tests: list[tuple[str, str]]) -> str:
    """The value of the first test that holds, by halves, so that the depth is the logarithm of their number; 0 if none does.

    Each test is (upper end, value): x up to that end."""
    if len(tests) == 1:
        return tests[0][1]
    half = len(tests) // 2
    return f"CASE WHEN x_ <= {tests[half - 1][0]} THEN {_cases(tests[:half])} ELSE {_cases(tests[half:])} END"


def _leaf_sql(n: N.Leaf, x: str) -> str:
    if isinstance(n, Piecewise):
        parts = []
        for i in range(len(n.x) - 1):
            s = (n.y[i + 1] - n.y[i]) / (n.x[i + 1] - n.x[i])
            parts.append((_number(n.x[i + 1]), f"({_number(n.y[i])} + {_number(s)} * (x_ - {_number(n.x[i])}))"))
        inside = _cases([(_number(n.x[0]), "CAST(0 AS DOUBLE)"), *parts, (_number(math.inf), "CAST(0 AS DOUBLE)")])
    elif isinstance(n, Parametric) and n.family not in DISCRETE:
        a, b = _number(n.a), _number(n.b)
        inside = {
            "gaussian": f"exp(-((x_ - {a}) * (x_ - {a})) / (2 * {b} * {b})) / {_number(n.b * math.sqrt(2 * math.pi))}",
            "lognormal": f"CASE WHEN x_ > 0 THEN exp(-((ln(x_) - {a}) * (ln(x_) - {a})) / (2 * {b} * {b})) / (x_ * {_number(n.b * math.sqrt(2 * math.pi))}) ELSE 0 END",
            "exponential": f"CASE WHEN x_ >= 0 THEN {a} * exp(-{a} * x_) ELSE 0 END",
            "gamma": f"CASE WHEN x_ > 0 THEN exp({_number(n.a * math.log(n.b) - math.lgamma(n.a)) if n.family == 'gamma' else 0} + ({a} - 1) * ln(x_) - {b} * x_) ELSE 0 END",
            "uniform": f"CASE WHEN x_ >= {a} AND x_ <= {b} THEN 1 / ({b} - {a}) ELSE 0 END",
        }[n.family]
    else:  # bins; what lies between two of them has no mass
        tests, end = [], -math.inf
        for lo, hi, p in zip(n.lo, n.hi, n.pdf, strict=True):
            if lo > end:
                tests.append((_number(lo), "CAST(0 AS DOUBLE)"))
            tests.append((_number(hi), _number(p)))
            end = hi
        inside = _cases([*tests, (_number(math.inf), "CAST(0 AS DOUBLE)")])
    return f"CASE WHEN {x} IS NULL THEN CAST(1 AS DOUBLE) ELSE {_number(n.non_null)} * ({inside}) END".replace("x_", x)


def as_sql(root: N.Node, quote: str = '"') -> str:
    """The likelihood of a row with the model's columns. Null cells of leaves, products, sums and joint leaves are summed out; what a
    factorize node is conditioned on must be known."""
    name = lambda c: f"CAST({quote}{c}{quote} AS DOUBLE)"

    def sql(n: N.Node) -> str:
        if isinstance(n, N.Leaf):
            return _leaf_sql(n, name(n.scope[0]))
        if isinstance(n, N.Joint):
            cell = [" AND ".join(f"({name(c)} IS NULL OR {name(c)} BETWEEN {_number(lo)} AND {_number(hi)})" for c, lo, hi in zip(n.scope, low, high, strict=True)) for low, high in zip(n.low, n.high, strict=True)]
            return "(" + (" + ".join(f"CASE WHEN {w} THEN {_number(p)} ELSE 0 END" for w, p in zip(cell, n.pdf, strict=True)) or "0") + ")"
        if isinstance(n, N.Sum):
            return "(" + " + ".join(f"{_number(w)} * {sql(c)}" for w, c in zip(n.weights, n.children, strict=True)) + ")"
        if isinstance(n, N.Product | N.Factorize):
            return "(" + " * ".join(map(sql, n.children)) + ")"
        if isinstance(n, N.Split):
            upto = [" AND ".join(f"{name(c)} <= {_number(hi)}" for c, (_, hi) in box.items()) for box in n.boxes]
            return "CASE " + " ".join(f"WHEN {w} THEN {sql(c)}" for w, c in zip(upto, n.children, strict=True)) + " ELSE 0 END"
        raise TypeError(f"a {n.kind} node has no SQL expression")

    return sql(root)


def as_column(root: N.Node) -> Column:
    return F.expr(as_sql(root, "`"))
