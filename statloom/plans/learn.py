"""Learning a model from a table, level by level.

The planner decides for tasks; a task is a row set of the one table, a scope and a condition. Row sets are numbered, and each
row of the table carries the numbers of the sets that it is in (one for each branch of the model that still grows). So a level
of any number of tasks takes a few passes: one aggregation keyed by row set profiles all sets; one draws a bounded sample of
each and decides, set by set on the executors, from dependence matrices (with cluster centres or cuts where rows will be
split); one counts the bins of all one-dimensional leaves; each joint leaf counts its cells. Then the rows get their new
numbers. Decisions come from samples, all masses and weights from aggregations over all rows. What reaches the driver is
bounded for each set by leaf_bins, cells and the square of the number of columns.
"""

from __future__ import annotations

from collections.abc import Iterable
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from enum import Enum

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from statloom.functions.rdc import SAMPLE_ROWS, components, rdc_matrix
from statloom.operators.histograms import PAD
from statloom.operators.rows import best_cut, conditioning_column, kmeans, split_attribute
from statloom.plans.nodes import Factorize, Joint, Leaf, Node, Product, Split, Sum, assign_ids, prune, validate
from statloom.sources.context import Context, MetaType


class Operation(Enum):
    CREATE_LEAF = 1
    SPLIT_COLUMNS = 2
    SPLIT_ROWS = 3
    NAIVE_FACTORIZATION = 4
    REMOVE_UNINFORMATIVE = 5
    FACTORIZE = 6
    REMOVE_CONDITION = 7
    SPLIT_ROWS_CONDITION = 8


@dataclass
class Params:
    threshold: float = 0.3
    strong: float = 0.75
    sample_rows: int = SAMPLE_ROWS
    min_row_ratio: float = 0.01
    multivariate_leaf: bool = True
    alpha: float = 1.0
    clusters: int = 2
    seed: int = 17
    leaf_bins: int = 1200
    real_bins: int = 60
    cells: int = 50_000
    #: How rows are split: by `kmeans`, or on one binary column's values (`mle`); and on a condition column at its median
    #: (`grid_naive`) or at the best of some cuts (`grid`).
    rows: str = "kmeans"
    cuts: str = "grid_naive"


@dataclass
class Task:
    set: int
    scope: list[str]
    condition: list[str]
    place: tuple[list, int]
    strong: bool = False
    no_clusters: bool = False
    no_independence: bool = False


def next_operation(task: Task, rows: int, least: int, distinct: dict[str, int], rdc: np.ndarray | None, params: Params) -> tuple[Operation | None, object]:
    """The planner: what to do with a task, and what with (columns, groups). rdc is over scope + condition; without it, the answer is None where it counts."""
    s, c = task.scope, task.condition
    constant = [x for x in s if distinct[x] <= 1]
    few = rows <= least
    at_end = Operation.CREATE_LEAF if params.multivariate_leaf or task.strong else Operation.NAIVE_FACTORIZATION
    if len(s) == 1 and not c or task.strong and not c:
        return Operation.CREATE_LEAF, None
    if few and not c or task.no_clusters and len(c) <= 1:
        return at_end, None
    if len(constant) == len(s):
        return at_end, None
    if constant and not c:
        return Operation.REMOVE_UNINFORMATIVE, constant
    useless = [x for x in c if distinct[x] <= 1]
    if useless:
        return Operation.REMOVE_CONDITION, useless
    if rdc is None:
        return None, None
    if c:
        k = len(s)
        weak = [x for i, x in enumerate(c) if (rdc[k + i, :k] <= params.threshold).all()]
        if weak:
            return Operation.REMOVE_CONDITION, weak
        return (at_end, None) if few else (Operation.SPLIT_ROWS_CONDITION, None)
    if not task.no_independence:
        groups = components(rdc >= params.threshold)
        if len(groups) > 1:
            return Operation.SPLIT_COLUMNS, [[s[i] for i in g] for g in groups]
    strong = [g for g in components(rdc >= params.strong) if len(g) > 1]
    if strong:
        if len(strong[0]) == len(s):
            return Operation.CREATE_LEAF, None
        return Operation.FACTORIZE, [s[i] for i in strong[0]]
    return (at_end, None) if few or task.no_clusters else (Operation.SPLIT_ROWS, None)


@dataclass
class Profile:
    """A row set: its number of rows, and of each column the number of distinct values, the ends and the number of known ones."""

    rows: int
    distinct: dict[str, int]
    low: dict[str, float | None]
    high: dict[str, float | None]
    known: dict[str, int]


@dataclass
class Pending:
    """A split whose row sets haven't been counted yet."""

    task: Task
    node: Sum | Split
    sets: list[int]


class Learner:
    def __init__(self, df: DataFrame, context: Context, params: Params):
        self.params, self.names = params, context.names
        self.meta = {a.name: a.meta for a in context.attributes}
        doubles = [F.col(c).cast("double") for c in self.names]
        known = [F.when(~F.isnan(d), d).alias(c) for c, d in zip(self.names, doubles, strict=True)]
        self.table = df.select(*known, F.array(F.lit(0)).alias("_at")).persist()  # spills to disk; lost parts are made again
        self.profiles: dict[int, Profile] = {}
        self.inside: dict[int, tuple[int, Column]] = {}  # new set -> the set that it is part of, and which part
        self.n_sets = 1

    def run(self) -> Node:
        holder: list = [None]
        tasks, pending = [Task(0, self.names, [], (holder, 0))], []
        self._profile([0])
        n = self.profiles[0].rows
        self.least = int(self.params.min_row_ratio * n) if self.params.min_row_ratio < 1 else int(self.params.min_row_ratio)
        while tasks:
            decided = self._decide(tasks)
            tasks, pending, leaves = [], [], []
            for t, (op, what, extra) in decided:
                self._apply(t, op, what, extra, tasks, pending, leaves)
            self._make_leaves(leaves)
            if pending:
                self._renumber({t.set for t in tasks} | {p.task.set for p in pending}, [s for p in pending for s in p.sets])
                for p in pending:
                    tasks += self._split_done(p)
        self.table.unpersist()
        root = assign_ids(prune(holder[0]))
        if bad := validate(root):
            raise AssertionError("; ".join(bad))
        return root

    def _rows(self, sets: Iterable[int]) -> DataFrame:
        """A row for each row of the table and set that it is in."""
        return self.table.select(*self.names, F.explode("_at").alias("_set")).where(F.col("_set").isin(list(sets)))

    def _profile(self, sets: list[int]) -> None:
        c = list(enumerate(self.names))
        made = [F.count("*").alias("n"), *[F.approx_count_distinct(x).alias(f"d_{i}") for i, x in c], *[F.min(x).alias(f"lo_{i}") for i, x in c], *[F.max(x).alias(f"hi_{i}") for i, x in c], *[F.count(x).alias(f"k_{i}") for i, x in c]]
        for r in self._rows(sets).groupBy("_set").agg(*made).collect():  # one row for each set
            distinct = {x: 1 if r[f"lo_{i}"] == r[f"hi_{i}"] else max(2, r[f"d_{i}"]) for i, x in c}
            self.profiles[r["_set"]] = Profile(r["n"], distinct, {x: r[f"lo_{i}"] for i, x in c}, {x: r[f"hi_{i}"] for i, x in c}, {x: r[f"k_{i}"] for i, x in c})
        for s in sets:
            self.profiles.setdefault(s, Profile(0, dict.fromkeys(self.names, 1), dict.fromkeys(self.names), dict.fromkeys(self.names), dict.fromkeys(self.names, 0)))

    def _decide(self, tasks: list[Task]) -> list[tuple[Task, tuple]]:
        """The planner's word on each task, with what the split that it may ask for needs: centres, or a column and a cut."""
        p, plain, asked = self.params, {}, {}
        for k, t in enumerate(tasks):
            own = self.profiles[t.set]
            op, what = next_operation(t, own.rows, self.least, own.distinct, None, p)
            if op is None:
                asked.setdefault(t.set, []).append((k, t.scope, t.condition, t.strong, t.no_clusters, t.no_independence, own.rows, own.distinct))
            else:
                plain[k] = (op, what, None)
        if not asked:
            return [(t, plain[k]) for k, t in enumerate(tasks)]
        rate = F.lit(0.0)
        for s in asked:
            rate = F.when(F.col("_set") == s, min(1.0, 1.2 * p.sample_rows / self.profiles[s].rows)).otherwise(rate)
        names, discrete, least = self.names, {c: m != MetaType.REAL for c, m in self.meta.items()}, self.least

        def judge(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
            x = {c: g[c].to_numpy(float)[: p.sample_rows] for c in names}
            out = []
            for k, scope, condition, strong, no_clusters, no_independence, rows, distinct in asked[key[0]]:
                used = [*scope, *condition]
                m = np.stack([x[c] for c in used], 1)
                flags = [discrete[c] for c in used]
                rdc = rdc_matrix(m, flags, p.seed)
                task = Task(key[0], scope, condition, ([], 0), strong, no_clusters, no_independence)
                op, _ = next_operation(task, rows, least, distinct, rdc, p)
                centres, column, cut = [], None, None
                if op is Operation.SPLIT_ROWS and p.rows == "mle":  # centres that differ in one column
                    at = conditioning_column(m)
                    centres = [[v if i == at else 0.5 for i in range(len(scope))] for v in (0.0, 1.0)]
                elif op is Operation.SPLIT_ROWS:
                    centres = [c.tolist() for c in kmeans(np.nan_to_num(m), p.clusters, p.seed)]
                elif op is Operation.SPLIT_ROWS_CONDITION:
                    n = len(scope)
                    at = split_attribute(rdc, list(range(n)), list(range(n, len(used))))
                    column = used[at]
                    cut = best_cut(m, list(range(n)), at, flags) if p.cuts == "grid" else None
                out.append((k, rdc.ravel().tolist(), centres, column, cut))
            return pd.DataFrame(out, columns=["task", "rdc", "centres", "column", "cut"])

        sampled = self._rows(asked).where(F.rand(p.seed) < rate).repartition(4 * len(asked), "_set")  # not merged again, so that sets are judged side by side
        for r in sampled.groupBy("_set").applyInPandas(judge, "task int, rdc array<double>, centres array<array<double>>, column string, cut double").collect():  # one row for each task
            t = tasks[r.task]
            own, d = self.profiles[t.set], len(t.scope) + len(t.condition)
            rdc = np.array(r.rdc).reshape(d, d)
            op, what = next_operation(t, own.rows, self.least, own.distinct, rdc, p)
            cut = None if r["cut"] is None or np.isnan(r["cut"]) else r["cut"]
            plain[r.task] = (op, what, (r.column, cut) if op is Operation.SPLIT_ROWS_CONDITION else r.centres)
        for k, t in enumerate(tasks):  # a small set of which the sample holds nothing
            if k not in plain:
                own, d = self.profiles[t.set], len(t.scope) + len(t.condition)
                plain[k] = (Operation.REMOVE_CONDITION, list(t.condition), None) if t.condition else (Operation.CREATE_LEAF, None, None)
        cuts = [k for k, x in plain.items() if x[0] is Operation.SPLIT_ROWS_CONDITION]
        with ThreadPoolExecutor(8) as pool:  # jobs of their own, side by side
            for k, ends in zip(cuts, pool.map(lambda k: self._ends(tasks[k], *plain[k][2]), cuts), strict=True):
                plain[k] = (*plain[k][:2], ends)
        return [(t, plain[k]) for k, t in enumerate(tasks)]

    def _apply(self, t: Task, op: Operation, what, extra, tasks: list[Task], pending: list[Pending], leaves: list[tuple[Task, list[str], tuple]]) -> None:
        parent, slot = t.place
        if op is Operation.CREATE_LEAF:
            leaves.append((t, t.scope, t.place))
        elif op is Operation.NAIVE_FACTORIZATION:
            node = parent[slot] = Product(list(t.scope), [None] * len(t.scope))
            leaves += [(t, [c], (node.children, i)) for i, c in enumerate(t.scope)]
        elif op in (Operation.SPLIT_COLUMNS, Operation.REMOVE_UNINFORMATIVE):
            groups = what if op is Operation.SPLIT_COLUMNS else [*([c] for c in what), [c for c in t.scope if c not in what]]
            node = parent[slot] = Product(list(t.scope), [None] * len(groups))
            tasks += [Task(t.set, g, [], (node.children, i), no_independence=True) for i, g in enumerate(groups)]
        elif op is Operation.FACTORIZE:
            weak = [c for c in t.scope if c not in what]
            node = parent[slot] = Factorize(list(t.scope), [None, None], condition=weak)
            tasks += [Task(t.set, weak, [], (node.children, 0)), Task(t.set, what, weak, (node.children, 1), strong=True)]
        elif op is Operation.REMOVE_CONDITION:
            tasks.append(Task(t.set, t.scope, [c for c in t.condition if c not in what], t.place, t.strong, t.no_clusters))
        elif op is Operation.SPLIT_ROWS_CONDITION:
            self._cut(t, extra, tasks, pending)
        else:
            centres = [np.array(c) for c in extra]
            nearest = F.array_min(F.array(*[F.struct(sum(((F.coalesce(F.col(c), F.lit(0.0)) - float(x)) ** 2 for c, x in zip(t.scope, m, strict=True)), F.lit(0.0)).alias("d"), F.lit(i).alias("i")) for i, m in enumerate(centres)]))["i"]
            node = Sum(list(t.scope), weights=np.zeros(0), centres=centres, rows=float(self.profiles[t.set].rows))
            pending.append(Pending(t, node, [self._new(t.set, nearest == i) for i in range(len(centres))]))

    def _new(self, inside: int, part: Column) -> int:
        number = self.n_sets
        self.n_sets += 1
        self.inside[number] = (inside, part)
        return number

    def _ends(self, t: Task, column: str, cut: float | None) -> tuple[str, float, float] | None:
        """A column to split at, where the lower side ends and where the upper one begins."""
        rows = self._rows([t.set]).select("_set", column)
        lower = last_below(rows, column, cut)
        return None if lower is None else (column, lower, rows.where(F.col(column) > lower).agg(F.min(column)).first()[0])

    def _cut(self, t: Task, ends: tuple[str, float, float] | None, tasks: list[Task], pending: list[Pending]) -> None:
        if ends is None:
            tasks.append(Task(t.set, t.scope, t.condition, t.place, t.strong, no_clusters=True))
            return
        column, lower, upper = ends
        # boxes end at observed values, which lie inside bins; a value in the gap between goes to the upper box
        boxes = [{column: (-np.inf, lower)}, {column: (upper, np.inf)}]
        node = Split(list(t.scope), boxes=boxes, weights=np.zeros(0), rows=float(self.profiles[t.set].rows))
        pending.append(Pending(t, node, [self._new(t.set, F.coalesce(F.col(column) <= lower, F.lit(False))), self._new(t.set, F.coalesce(F.col(column) > lower, F.lit(False)))]))

    def _renumber(self, live: set[int], new: list[int]) -> None:
        """Rows get the numbers of the new sets beside those of sets that are still needed; and the new sets their profiles."""
        held = F.filter("_at", lambda s: s.isin(list(live)))
        more = [F.when(F.array_contains("_at", self.inside[s][0]) & self.inside[s][1], F.lit(s)) for s in new]
        before, self.table = self.table, self.table.select(*self.names, F.concat(held, F.array_compact(F.array(*more))).alias("_at")).persist()
        self._profile(new)
        before.unpersist()

    def _split_done(self, p: Pending) -> list[Task]:
        """The tasks of a split's parts, now that their rows are counted; the task again, not to be split, if one part has them all."""
        t, counts = p.task, [self.profiles[s].rows for s in p.sets]
        live = [i for i, n in enumerate(counts) if n]
        if len(live) < 2:
            return [Task(t.set, t.scope, t.condition, t.place, t.strong, no_clusters=True, no_independence=not t.condition)]
        parent, slot = t.place
        parent[slot] = p.node
        p.node.weights, p.node.children = np.array([counts[i] for i in live]) / sum(counts), [None] * len(live)
        if isinstance(p.node, Sum):
            p.node.centres = [p.node.centres[i] for i in live]
        return [Task(p.sets[i], t.scope, t.condition, (p.node.children, k), t.strong) for k, i in enumerate(live)]

    def _make_leaves(self, leaves: list[tuple[Task, list[str], tuple]]) -> None:
        single = {(t.set, scope[0]) for t, scope, _ in leaves if len(scope) == 1}
        made = self._histograms(single) if single else {}
        joint = [(t, scope, place) for t, scope, place in leaves if len(scope) > 1]
        for t, scope, (parent, slot) in leaves:
            if len(scope) == 1:
                parent[slot] = made[t.set, scope[0]]
        if joint:
            with ThreadPoolExecutor(8) as pool:  # jobs of their own, side by side
                for (_, _, (parent, slot)), leaf in zip(joint, pool.map(lambda x: joint_leaf(self._rows([x[0].set]), x[1], self.meta, self.params, self.profiles[x[0].set].rows), joint), strict=True):
                    parent[slot] = leaf

    def _histograms(self, wanted: set[tuple[int, str]]) -> dict[tuple[int, str], Leaf]:
        """All one-dimensional leaves of a level: value counts, or counts of equal-width bins for columns of too many values, in one job."""
        p, keys, binned = self.params, [], {}
        for i, c in enumerate(self.names):
            sets = [s for s, x in wanted if x == c]
            if not sets:
                continue
            key = F.col(c)
            for s in sets:
                own = self.profiles[s]
                lo, hi = own.low[c], own.high[c]
                if lo is not None and lo != hi and (self.meta[c] == MetaType.REAL or own.distinct[c] > 1.1 * p.leaf_bins):
                    binned[s, c] = (lo, hi)
                    key = F.when(F.col("_set") == s, F.least(F.floor((F.col(c) - lo) / (hi - lo) * p.real_bins), F.lit(p.real_bins - 1)).cast("double")).otherwise(key)
            keys.append(F.when(F.col("_set").isin(sets) & F.col(c).isNotNull(), F.struct(F.lit(i).alias("c"), key.alias("v"))))
        long = self._rows({s for s, _ in wanted}).select("_set", F.explode(F.array_compact(F.array(*keys))).alias("x"))
        got: dict[tuple[int, str], list] = {k: [] for k in wanted}
        for r in long.groupBy("_set", "x.c", "x.v").agg(F.count("*").alias("n")).collect():  # at most about leaf_bins rows for each leaf
            got[r["_set"], self.names[r.c]].append((r.v, r.n))
        out = {}
        for (s, c), counts in got.items():
            size = self.profiles[s].rows
            if (s, c) in binned:
                k = np.zeros(p.real_bins)
                for v, n in counts:
                    k[int(v)] = n
                out[s, c] = bins_leaf(c, *binned[s, c], k, p, size)
            elif self.meta[c] != MetaType.REAL and len(counts) <= p.leaf_bins:
                out[s, c] = values_leaf(c, counts, p, size)
            else:  # few more values than leaf_bins, or one value of a real column, or none
                lo, hi = self.profiles[s].low[c], self.profiles[s].high[c]
                v, n = np.array([x[0] for x in counts]), np.array([x[1] for x in counts], float)
                k = np.bincount(np.minimum(((v - lo) / ((hi - lo) or 1) * p.real_bins).astype(int), p.real_bins - 1), n, p.real_bins) if len(v) else np.zeros(p.real_bins)
                out[s, c] = bins_leaf(c, lo, hi, k, p, size)
        return out


def learn(df: DataFrame, context: Context | None = None, params: Params | None = None) -> Node:
    """The model of df's columns that context names (all numeric ones by default)."""
    return Learner(df, context or Context.of(df), params or Params()).run()


def learn_binary(df: DataFrame, columns: list[str] | None = None, params: Params | None = None) -> Node:
    """The model of binary columns: rows are split on the column whose two values explain the others best, and what can't be split
    is an exact joint table. min_row_ratio of 1 or more is a number of rows."""
    columns = columns or df.columns
    return learn(df, Context.binary(df, columns), params or Params(rows="mle"))


def last_below(rows: DataFrame, column: str, cut: float | None = None) -> float | None:
    """The greatest value up to cut, or below the median if there is none (up to it, if it is the least): where a lower half ends.

    Null if all values are on one side. The median is right up to a ten-thousandth of the rows, by a mergeable sketch."""
    known = rows.where(F.col(column).isNotNull())
    s = known.agg(F.min(column).alias("lo"), F.max(column).alias("hi"), F.percentile_approx(column, 0.5, 10_000).alias("m")).first()
    if s.lo is None or s.lo == s.hi:
        return None
    below = F.col(column) <= cut if cut is not None else (F.col(column) <= s.lo if s.m == s.lo else F.col(column) < s.m)
    last = known.where(below).agg(F.max(column)).first()[0]
    return None if last is None or last >= s.hi else float(last)


def make_leaf(rows: DataFrame, scope: list[str], meta: dict[str, MetaType], params: Params, size: int) -> Node:
    return histogram_leaf(rows, scope[0], meta[scope[0]], params, size) if len(scope) == 1 else joint_leaf(rows, scope, meta, params, size)


def values_leaf(column: str, counts: Iterable[tuple[float, int]], params: Params, size: int) -> Leaf:
    """A bin for each value, smoothed by alpha."""
    pairs = sorted(counts)
    x, k = np.array([float(v) for v, _ in pairs]), np.array([n for _, n in pairs], float)
    edges = np.r_[x[0] - PAD, (x[1:] + x[:-1]) / 2, x[-1] + PAD] if len(x) else np.zeros(1)
    total = k.sum()
    leaf = Leaf([column], lo=edges[:-1], hi=edges[1:], pdf=(k + params.alpha) / (total + params.alpha * len(k)) if len(k) else k, non_null=total / size if size else 0.0, rows=float(size))
    leaf.value = x
    return leaf


def bins_leaf(column: str, lo: float | None, hi: float | None, k: np.ndarray, params: Params, size: int) -> Leaf:
    """Counts k of bins of equal width from lo to hi, smoothed by alpha."""
    n, b = k.sum(), len(k)
    if not n:
        return Leaf([column], lo=[], hi=[], pdf=[], non_null=0.0, rows=float(size), discrete=False)
    if lo == hi:
        return Leaf([column], lo=[lo - PAD / 100], hi=[hi], pdf=[1.0], non_null=n / size, rows=float(size), discrete=False)
    edges = np.linspace(lo, hi, b + 1)
    edges[0] = np.nextafter(lo, -np.inf)
    return Leaf([column], lo=edges[:-1], hi=edges[1:], pdf=(k + params.alpha) / (n + params.alpha * b), non_null=n / size, rows=float(size), discrete=False)


def histogram_leaf(rows: DataFrame, column: str, meta: MetaType, params: Params, size: int) -> Leaf:
    """Values one by one if there are at most leaf_bins of them, else bins of equal width; smoothed by alpha."""
    v = rows.where(F.col(column).isNotNull() & ~F.isnan(column))
    counts = v.groupBy(column).count().limit(params.leaf_bins + 1).collect() if meta != MetaType.REAL else None  # at most leaf_bins + 1 rows
    if counts is not None and len(counts) <= params.leaf_bins:
        return values_leaf(column, [(r[column], r["count"]) for r in counts], params, size)
    s = v.agg(F.min(column).alias("lo"), F.max(column).alias("hi")).first()
    b = params.real_bins
    k = np.zeros(b)
    at = F.least(F.floor((F.col(column) - s.lo) / (s.hi - s.lo) * b), F.lit(b - 1)).cast("int") if s.lo is not None and s.lo < s.hi else F.lit(0)
    for r in v.groupBy(at.alias("b")).count().collect():  # at most real_bins rows
        k[r["b"]] = r["count"]
    return bins_leaf(column, s.lo, s.hi, k, params, size)


def joint_leaf(rows: DataFrame, scope: list[str], meta: dict[str, MetaType], params: Params, size: int) -> Node:
    """Sparse cells. A column of too many values is binned by width, with ever fewer bins until there are at most `cells` cells.

    If the coarsest bins still have more, each half of the columns is a leaf of its own, so that every row counts."""
    v = rows.dropna(subset=scope)
    s = v.agg(*[F.min(c).alias(f"lo_{i}") for i, c in enumerate(scope)], *[F.max(c).alias(f"hi_{i}") for i, c in enumerate(scope)], *[F.approx_count_distinct(c).alias(f"d_{i}") for i, c in enumerate(scope)]).first()
    if s["lo_0"] is None:
        return Joint(list(scope), low=np.zeros((0, len(scope))), high=np.zeros((0, len(scope))), pdf=np.zeros(0), rows=float(size))
    bins = params.real_bins
    while True:
        keys = []
        for i, c in enumerate(scope):
            lo, hi = s[f"lo_{i}"], s[f"hi_{i}"]
            fine = meta[c] != MetaType.REAL and s[f"d_{i}"] <= bins * 4 or lo == hi
            keys.append(F.col(c) if fine else F.least(F.floor((F.col(c) - lo) / (hi - lo) * bins), F.lit(bins - 1)).cast("double"))
        cells = v.groupBy(*[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("n"), *[F.min(c).alias(f"lo{i}") for i, c in enumerate(scope)], *[F.max(c).alias(f"hi{i}") for i, c in enumerate(scope)])
        got = cells.limit(params.cells + 1).collect()  # at most cells + 1 rows
        if len(got) <= params.cells:
            break
        if bins <= 2:
            half = len(scope) // 2
            return Product(list(scope), [make_leaf(rows, list(part), meta, params, size) for part in (scope[:half], scope[half:])])
        bins //= 2
    n = np.array([r["n"] for r in got], float)
    return Joint(list(scope), low=np.array([[r[f"lo{i}"] for i in range(len(scope))] for r in got]), high=np.array([[r[f"hi{i}"] for i in range(len(scope))] for r in got]), pdf=n / n.sum(), rows=float(size))
