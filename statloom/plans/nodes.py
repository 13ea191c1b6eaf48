"""The model: a rooted graph of a few hundred nodes at most, evaluated in batches of queries or rows.

Kinds: leaf (one column; plans/shapes.py has more kinds of leaves), joint (several columns, sparse cells), sum (weights; row
clusters), product (independent columns), factorize (left: weak columns; right: strong columns given the weak ones) and split
(children valid in boxes of the condition columns). Batches are dictionaries of column -> array; NaN or a missing column means
unknown.

A leaf answers for itself by its methods; a new kind of node can also be taught to the evaluation by register().
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np

Box = dict[str, tuple[float, float]]
Batch = dict[str, np.ndarray]


@dataclass(eq=False)
class Node:
    scope: list[str]
    children: list[Node] = field(default_factory=list)
    id: int = -1

    kind = "node"

    def __mul__(self, other: Node) -> Product:
        """Independent parts."""
        parts = [g for n in (self, other) for g in (n.children if isinstance(n, Product) else [n])]
        return Product([c for g in parts for c in g.scope], parts)

    def __rmul__(self, weight: float) -> Sum:
        """A part of a mixture; parts are added to a mixture whose weights sum to 1."""
        return Sum(list(self.scope), [self], weights=np.array([float(weight)]))

    def __add__(self, other: Node) -> Sum:
        a, b = (n if isinstance(n, Sum) else 1.0 * n for n in (self, other))
        if set(a.scope) != set(b.scope):
            raise ValueError("parts of a mixture have one scope")
        return Sum(list(a.scope), [*a.children, *b.children], weights=np.r_[a.weights, b.weights])

    def given(self, weak: Node) -> Factorize:
        """This node's columns, modelled given those of weak."""
        return Factorize([*weak.scope, *self.scope], [weak, self], condition=list(weak.scope))

    def walk(self) -> list[Node]:
        """All nodes, each once, parents before children."""
        out, seen, queue = [], set(), [self]
        while queue:
            n = queue.pop(0)
            if id(n) not in seen:
                seen.add(id(n))
                out.append(n)
                queue += n.children
        return out


@dataclass(eq=False)
class Leaf(Node):
    """Bins lo < v <= hi in ascending order, their mass among non-null values, the value that stands for each."""

    lo: np.ndarray = None
    hi: np.ndarray = None
    pdf: np.ndarray = None
    non_null: float = 1.0
    rows: float = 0.0
    discrete: bool = True
    kind = "leaf"
    #: Whether EM fits its parameters.
    fits = False

    def __post_init__(self):
        self.lo, self.hi, self.pdf = (np.asarray(x, float) for x in (self.lo, self.hi, self.pdf))
        self.cum = np.r_[0.0, np.cumsum(self.pdf)]
        self.value = (self.lo + self.hi) / 2

    def parameters(self) -> int:
        return len(self.pdf)

    def range_mass(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        i, j = np.searchsorted(self.hi, lo, "left"), np.searchsorted(self.lo, hi, "left")
        return np.where((j > i) & (lo <= hi), np.clip(self.cum[np.maximum(j, i)] - self.cum[i], 0, 1), 0.0) * self.non_null

    def bin_of(self, x: np.ndarray) -> np.ndarray:
        """Index of the bin that holds x, -1 if none does."""
        if not len(self.hi):
            return np.full(len(x), -1)
        i = np.minimum(np.searchsorted(self.hi, x, "left"), len(self.hi) - 1)
        return np.where((x > self.lo[i]) & (x <= self.hi[i]), i, -1)

    def point_mass(self, x: np.ndarray, floor: float = 0.0) -> np.ndarray:
        i = self.bin_of(x)
        p = np.where(i >= 0, self.pdf[np.maximum(i, 0)] if len(self.pdf) else 0.0, 0.0)
        return np.where(np.isnan(x), 1.0, np.maximum(p * self.non_null, floor))

    def moment(self, k: int) -> float:
        total = self.pdf.sum()
        if total <= 0:
            return math.nan
        m = self.value**k if self.discrete else (self.hi ** (k + 1) - self.lo ** (k + 1)) / ((k + 1) * (self.hi - self.lo))
        return float((self.pdf * m).sum() / total)

    def mode(self) -> float:
        return float(self.value[int(np.argmax(self.pdf))]) if len(self.pdf) else math.nan

    def partial(self, lo: np.ndarray, hi: np.ndarray, power: int) -> np.ndarray:
        """E[x^power 1(lo <= x <= hi)]; of a negative power, without x = 0."""
        with np.errstate(divide="ignore"):
            f = np.where(self.value != 0, self.value.astype(float) ** power, 0.0 if power < 0 else 0.0**power)
        cum = np.r_[0.0, np.cumsum(self.pdf * f)]
        i, j = np.searchsorted(self.hi, lo, "left"), np.searchsorted(self.lo, hi, "left")
        return np.where(j > i, cum[np.maximum(j, i)] - cum[i], 0.0) * self.non_null

    def slope(self, x: np.ndarray) -> np.ndarray:
        """Of the mass, between neighbouring bins."""
        if len(self.pdf) < 2:
            return np.zeros(len(x))
        i = self.bin_of(x)
        lo, hi = np.maximum(i - 1, 0), np.minimum(i + 1, len(self.pdf) - 1)
        return np.where(i >= 0, (self.pdf[hi] - self.pdf[lo]) / np.maximum(self.value[hi] - self.value[lo], 1e-300) * self.non_null, 0.0)

    def within(self, lo: float, hi: float) -> Leaf:
        """The leaf given that lo <= x <= hi."""
        p = self.pdf * ((self.hi >= lo) & (self.lo < hi))
        return Leaf(self.scope, lo=self.lo, hi=self.hi, pdf=p / p.sum() if p.sum() else p, non_null=1.0, rows=self.rows, discrete=self.discrete)

    def draw(self, n: int, rng: np.random.Generator) -> np.ndarray:
        i = np.minimum(np.searchsorted(self.cum, rng.random(n) * self.cum[-1], "right") - 1, len(self.pdf) - 1)
        return self.value[i] if self.discrete else self.lo[i] + rng.random(n) * (self.hi[i] - self.lo[i])


@dataclass(eq=False)
class Joint(Node):
    """Sparse cells: value ranges [low, high] per column and their mass."""

    low: np.ndarray = None
    high: np.ndarray = None
    pdf: np.ndarray = None
    rows: float = 0.0
    kind = "joint"

    def __post_init__(self):
        self.low, self.high, self.pdf = (np.asarray(x, float) for x in (self.low, self.high, self.pdf))

    def range_mass(self, lo: Batch, hi: Batch, m: int) -> np.ndarray:
        out = np.empty(m)
        step = max(1, (1 << 22) // max(1, len(self.pdf)))
        for at in range(0, m, step):
            inside = np.ones((min(step, m - at), len(self.pdf)), bool)
            for k, c in enumerate(self.scope):
                if c in lo:
                    a, b = lo[c][at : at + step, None], hi[c][at : at + step, None]
                    inside &= (self.high[None, :, k] >= a) & (self.low[None, :, k] <= b) & (a <= b)
            out[at : at + step] = inside @ self.pdf
        return np.clip(out, 0, 1)

    def point_mass(self, x: Batch, m: int) -> np.ndarray:
        lo, hi = {}, {}
        for c in self.scope:
            if c in x:
                lo[c], hi[c] = np.where(np.isnan(x[c]), -np.inf, x[c]), np.where(np.isnan(x[c]), np.inf, x[c])
        return self.range_mass(lo, hi, m)


@dataclass(eq=False)
class Sum(Node):
    weights: np.ndarray = None
    centres: list[np.ndarray] | None = None
    rows: float = 0.0
    kind = "sum"


@dataclass(eq=False)
class Product(Node):
    kind = "product"


@dataclass(eq=False)
class Factorize(Node):
    """children: [left, right]; left is over condition."""

    condition: list[str] = field(default_factory=list)
    kind = "factorize"


@dataclass(eq=False)
class Split(Node):
    """children hold in boxes of the condition columns; every row is in one of them."""

    boxes: list[Box] = field(default_factory=list)
    weights: np.ndarray = None
    rows: float = 0.0
    kind = "split"


def assign_ids(root: Node) -> Node:
    for i, n in enumerate(root.walk()):
        n.id = i
    return root


def terminals(node: Node, box: Box) -> list[tuple[Box, Node]]:
    """The pieces of a right branch with the boxes in which they hold."""
    if isinstance(node, Split):
        return [t for c, b in zip(node.children, node.boxes, strict=True) for t in terminals(c, box | {k: _meet(box.get(k), v) for k, v in b.items()})]
    return [(box, node)]


def _meet(a: tuple[float, float] | None, b: tuple[float, float]) -> tuple[float, float]:
    return b if a is None else (max(a[0], b[0]), min(a[1], b[1]))


#: What register() was told: for each operation, a function for each kind of node.
BEHAVIOUR: dict[str, dict[type, Callable]] = {k: {} for k in ("probability", "log_likelihood", "moments", "complete", "slope")}


def register(kind: type, **functions: Callable) -> None:
    """Teaches the evaluation a kind of node, or another way for one that it knows.

    probability(node, lo, hi, m); likelihood(node, x, m) or log_likelihood(node, x, m), of which the other follows;
    moments(node, k) -> {column: value}; complete(node, x, m, rng) -> batch; slope(node, x).
    """
    if (f := functions.pop("likelihood", None)) is not None:
        functions["log_likelihood"] = lambda node, x, m: np.log(f(node, x, m))
    if unknown := functions.keys() - BEHAVIOUR.keys():
        raise ValueError(f"no such operation: {', '.join(sorted(unknown))}")
    for k, g in functions.items():
        BEHAVIOUR[k][kind] = g


def behaviour(operation: str, node: Node) -> Callable | None:
    return next((f for c in type(node).__mro__ if (f := BEHAVIOUR[operation].get(c)) is not None), None)


def bottom_up(root: Node, functions: dict[type, Callable], results: dict[int, object] | None = None, **args) -> object:
    """functions[kind](node, results of its children, **args) for each node once, children first; the root's result."""
    results = {} if results is None else results
    for n in reversed(_topological(root)):
        f = next(functions[c] for c in type(n).__mro__ if c in functions)
        results[id(n)] = f(n, [results[id(c)] for c in n.children], **args)
    return results[id(root)]


def top_down(root: Node, functions: dict[type, Callable], given: object = None, **args) -> dict[int, object]:
    """functions[kind](node, what its parents gave it, **args) -> what it gives to each of its children; parents first. By node identity,
    what each node was given."""
    held: dict[int, list] = {id(n): [] for n in root.walk()}
    held[id(root)].append(given)
    for n in _topological(root):
        f = next((functions[c] for c in type(n).__mro__ if c in functions), None)
        for c, g in zip(n.children, f(n, held[id(n)], **args) if f else [None] * len(n.children), strict=True):
            held[id(c)].append(g)
    return held


def rebuild_scopes(root: Node) -> Node:
    """Scopes of inner nodes made anew from their children's."""
    for n in reversed(_topological(root)):
        if n.children:
            n.scope = list(dict.fromkeys(c for child in n.children for c in child.scope))
        if isinstance(n, Factorize):
            n.condition = list(n.children[0].scope)
    return root


def probability(node: Node, lo: Batch, hi: Batch, m: int) -> np.ndarray:
    """P(lo <= row <= hi) for m boxes; a column that a batch lacks is unconstrained."""
    if (f := behaviour("probability", node)) is not None:
        return f(node, lo, hi, m)
    if isinstance(node, Leaf):
        c = node.scope[0]
        return node.range_mass(lo[c], hi[c]) if c in lo else np.ones(m)
    if isinstance(node, Joint):
        return node.range_mass(lo, hi, m)
    if isinstance(node, Sum):
        return sum(w * probability(c, lo, hi, m) for w, c in zip(node.weights, node.children, strict=True))
    if isinstance(node, Product):
        return math.prod((probability(c, lo, hi, m) for c in node.children), start=np.ones(m))
    if isinstance(node, Factorize):
        total = np.zeros(m)
        for box, piece in terminals(node.children[1], {}):
            a, b = dict(lo), dict(hi)
            for c, (x, y) in box.items():
                a[c] = np.maximum(lo[c], x) if c in lo else np.full(m, x)
                b[c] = np.minimum(hi[c], y) if c in hi else np.full(m, y)
            total += probability(node.children[0], a, b, m) * probability(piece, lo, hi, m)
        return np.minimum(1.0, total)
    if isinstance(node, Split):
        return sum(w * probability(c, lo, hi, m) for w, c in zip(node.weights, node.children, strict=True))
    raise TypeError(node.kind)


def log_likelihood(node: Node, x: Batch, m: int, memo: dict[int, np.ndarray] | None = None) -> np.ndarray:
    """Log mass of rows; unknown cells are summed out. memo collects each node's values by its identity."""
    with np.errstate(divide="ignore"):
        if (f := behaviour("log_likelihood", node)) is not None:
            out = f(node, x, m)
        elif isinstance(node, Leaf):
            c = node.scope[0]
            out = np.log(node.point_mass(x[c])) if c in x else np.zeros(m)
        elif isinstance(node, Joint):
            out = np.log(node.point_mass(x, m))
        elif isinstance(node, Sum | Split) and not (isinstance(node, Split) and _inside(node, x, m) is not None):
            out = _log_sum([log_likelihood(c, x, m, memo) + np.log(w) for w, c in zip(node.weights, node.children, strict=True)])
        elif isinstance(node, Split):
            at = _inside(node, x, m)
            parts = np.stack([log_likelihood(c, x, m, memo) for c in node.children])
            out = np.where(at >= 0, parts[np.maximum(at, 0), np.arange(m)], -np.inf)
        elif isinstance(node, Product):
            out = sum((log_likelihood(c, x, m, memo) for c in node.children), np.zeros(m))
        elif isinstance(node, Factorize):
            known = all(c in x and not np.isnan(x[c]).any() for c in node.condition)
            if known:
                out = log_likelihood(node.children[0], x, m, memo) + log_likelihood(node.children[1], x, m, memo)
            else:
                total = np.zeros(m)
                for box, piece in terminals(node.children[1], {}):
                    lo, hi = {}, {}
                    for c in node.condition:
                        v = x.get(c, np.full(m, np.nan))
                        a, b = box.get(c, (-np.inf, np.inf))
                        lo[c], hi[c] = np.where(np.isnan(v), a, np.where((v >= a) & (v <= b), v, np.inf)), np.where(np.isnan(v), b, np.where((v >= a) & (v <= b), v, -np.inf))
                    total += probability(node.children[0], lo, hi, m) * np.exp(log_likelihood(piece, x, m))
                out = np.log(np.minimum(1.0, total))
        else:
            raise TypeError(node.kind)
    if memo is not None:
        memo[id(node)] = out
    return out


def _inside(node: Split, x: Batch, m: int) -> np.ndarray | None:
    """The child for each row: the first whose box's upper ends it doesn't exceed; None if a condition cell is unknown."""
    if any(c not in x or np.isnan(x[c]).any() for box in node.boxes for c in box):
        return None
    return box_of(node.boxes, x, m)


def box_of(boxes: list[Box], x: Batch, m: int) -> np.ndarray:
    at = np.full(m, -1)
    for i, box in enumerate(boxes):
        hit = at < 0
        for c, (_, hi) in box.items():
            hit &= x[c] <= hi
        at[hit] = i
    return at


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    z = np.stack(parts)
    top = z.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(z - safe).sum(axis=0))


# --- algebra on the graph


def copy(node: Node, seen: dict[int, Node] | None = None) -> Node:
    seen = {} if seen is None else seen
    if id(node) not in seen:
        new = object.__new__(type(node))
        new.__dict__ = {k: (v.copy() if isinstance(v, list | np.ndarray | dict) else v) for k, v in node.__dict__.items()}
        seen[id(node)] = new
        new.children = [copy(c, seen) for c in node.children]
    return seen[id(node)]


def prune(node: Node) -> Node:
    """Without nodes of one child, and sums in sums or products in products."""
    node.children = [prune(c) for c in node.children]
    if isinstance(node, Product):
        node.children = [g for c in node.children for g in (c.children if isinstance(c, Product) else [c])]
    if isinstance(node, Sum) and not node.centres:
        flat = [(w * v, g) for w, c in zip(node.weights, node.children, strict=True) for v, g in (zip(c.weights, c.children, strict=True) if isinstance(c, Sum) and not c.centres else [(1.0, c)])]
        node.weights, node.children = np.array([w for w, _ in flat]), [g for _, g in flat]
    return node.children[0] if isinstance(node, Sum | Product) and len(node.children) == 1 else node


def compress(root: Node) -> Node:
    """Equal subgraphs become one."""
    known: dict[tuple, Node] = {}

    def visit(n: Node) -> Node:
        n.children = [visit(c) for c in n.children]
        data = tuple((k, v.tobytes() if isinstance(v, np.ndarray) else repr(v)) for k, v in sorted(n.__dict__.items()) if k not in ("children", "id"))
        return known.setdefault((n.kind, data, tuple(id(c) for c in n.children)), n)

    return visit(root)


def limit_fan_out(node: Node, most: int = 10) -> Node:
    """Sums and products of at most `most` children, by intermediate nodes."""
    node.children = [limit_fan_out(c, most) for c in node.children]
    while isinstance(node, Sum | Product) and len(node.children) > most:
        groups = [node.children[i : i + most] for i in range(0, len(node.children), most)]
        if isinstance(node, Product):
            node.children = [Product(sorted({s for c in g for s in c.scope}), g) if len(g) > 1 else g[0] for g in groups]
        else:
            w = [node.weights[i : i + most] for i in range(0, len(node.weights), most)]
            node.children = [Sum(list(node.scope), g, weights=v / v.sum()) if len(g) > 1 else g[0] for g, v in zip(groups, w, strict=True)]
            node.weights, node.centres = np.array([v.sum() for v in w]), None
    return node


def marginalize(node: Node, keep: list[str]) -> Node | None:
    """The model of the columns in keep; a factorize node keeps its condition columns inside."""
    if not set(node.scope) & set(keep):
        return None
    if isinstance(node, Leaf):
        return copy(node)
    if isinstance(node, Joint):
        at = [i for i, c in enumerate(node.scope) if c in keep]
        return Joint([node.scope[i] for i in at], low=node.low[:, at], high=node.high[:, at], pdf=node.pdf, rows=node.rows)
    if isinstance(node, Factorize):
        right = marginalize(node.children[1], keep)
        left = node.children[0] if right else marginalize(node.children[0], keep)
        return left if right is None else Factorize([c for c in node.scope if c in keep or c in node.condition], [copy(left), right], condition=list(node.condition))
    kids = [(i, k) for i, c in enumerate(node.children) if (k := marginalize(c, keep)) is not None]
    if not kids:
        return None
    new = copy(node)
    new.children, new.scope = [k for _, k in kids], [c for c in node.scope if c in keep]
    return new if isinstance(new, Split) else prune(new)


def condition(node: Node, evidence: dict[str, float]) -> tuple[Node | None, float]:
    """The model of the other columns given point evidence, and the evidence's log probability."""
    x = {c: np.array([v]) for c, v in evidence.items()}
    rest = [c for c in node.scope if c not in evidence]

    def visit(n: Node) -> Node | None:
        if not set(n.scope) & set(evidence):
            return copy(n)
        if isinstance(n, Leaf):
            return None
        if isinstance(n, Joint):
            ok = np.ones(len(n.pdf), bool)
            for k, c in enumerate(n.scope):
                if c in evidence:
                    ok &= (n.low[:, k] <= evidence[c]) & (n.high[:, k] >= evidence[c])
            at = [k for k, c in enumerate(n.scope) if c in rest]
            total = n.pdf[ok].sum()
            return Joint([n.scope[k] for k in at], low=n.low[ok][:, at], high=n.high[ok][:, at], pdf=n.pdf[ok] / total if total else n.pdf[ok]) if at else None
        if isinstance(n, Factorize):
            pieces, weights = [], []
            for box, piece in terminals(n.children[1], {}):
                if any(not lo <= evidence[c] <= hi for c, (lo, hi) in box.items() if c in evidence):
                    continue
                lo = {c: np.array([evidence[c] if c in evidence else box.get(c, (-np.inf, 0))[0]]) for c in n.condition if c in evidence or c in box}
                hi = {c: np.array([evidence[c] if c in evidence else box.get(c, (0, np.inf))[1]]) for c in n.condition if c in evidence or c in box}
                w = float(probability(n.children[0], lo, hi, 1)[0] * np.exp(log_likelihood(piece, x, 1)[0]))
                parts = [p for p in (_restricted(visit(n.children[0]), {c: b for c, b in box.items() if c in rest}), visit(piece)) if p is not None]
                if w > 0 and parts:
                    pieces.append(parts[0] if len(parts) == 1 else Product(sorted({s for p in parts for s in p.scope}), parts))
                    weights.append(w)
            return Sum([c for c in n.scope if c in rest], pieces, weights=np.array(weights) / sum(weights)) if pieces else None
        if isinstance(n, Product):
            parts = [k for c in n.children if (k := visit(c)) is not None]
            return Product([c for c in n.scope if c in rest], parts) if len(parts) > 1 else parts[0] if parts else None
        ll = np.array([log_likelihood(c, x, 1)[0] for c in n.children]) + np.log(n.weights)
        ok = [i for i in range(len(ll)) if np.isfinite(ll[i])]
        kids = [(i, k) for i in ok if (k := visit(n.children[i])) is not None]
        if not kids:
            return None
        w = np.exp(ll[[i for i, _ in kids]] - ll[ok].max())
        return Sum([c for c in n.scope if c in rest], [k for _, k in kids], weights=w / w.sum())

    ll = float(log_likelihood(node, x, 1)[0])
    made = visit(node) if np.isfinite(ll) and rest else None
    return (assign_ids(prune(made)) if made is not None else None), ll


def _restricted(node: Node | None, box: Box) -> Node | None:
    """node within a box of its columns, normalised."""
    if node is None or not box:
        return node
    m = 1
    whole = lambda n: float(probability(n, {c: np.array([b[0]]) for c, b in box.items() if c in n.scope}, {c: np.array([b[1]]) for c, b in box.items() if c in n.scope}, m)[0])

    def visit(n: Node) -> Node:
        if not set(n.scope) & set(box):
            return n
        n = copy(n)
        if isinstance(n, Leaf):
            return n.within(*box[n.scope[0]])
        if isinstance(n, Joint):
            ok = np.ones(len(n.pdf), bool)
            for k, c in enumerate(n.scope):
                if c in box:
                    ok &= (n.high[:, k] >= box[c][0]) & (n.low[:, k] <= box[c][1])
            p = n.pdf[ok]
            return Joint(n.scope, low=n.low[ok], high=n.high[ok], pdf=p / p.sum() if p.sum() else p)
        if isinstance(n, Sum):
            w = np.array([v * whole(c) for v, c in zip(n.weights, n.children, strict=True)])
            n.weights = w / w.sum() if w.sum() else n.weights
        n.children = [visit(c) for c in n.children]
        return n

    return visit(node)


def validate(root: Node) -> list[str]:
    """What is wrong with a model; empty if nothing is."""
    bad = []
    for n in root.walk():
        if isinstance(n, Sum):
            if not math.isclose(float(np.sum(n.weights)), 1.0, abs_tol=1e-6):
                bad.append(f"node {n.id}: weights sum to {np.sum(n.weights)}")
            bad += [f"node {n.id}: child {c.id} has another scope" for c in n.children if set(c.scope) != set(n.scope)]
        if isinstance(n, Product):
            if sum(len(c.scope) for c in n.children) != len({s for c in n.children for s in c.scope}):
                bad.append(f"node {n.id}: scopes overlap")
            if {s for c in n.children for s in c.scope} != set(n.scope):
                bad.append(f"node {n.id}: scope isn't its children's")
        if isinstance(n, Factorize) and (len(n.children) != 2 or set(n.children[0].scope) & set(n.children[1].scope)):
            bad.append(f"node {n.id}: a factorize node needs two children of disjoint scopes")
        if isinstance(n, Split) and len(n.boxes) != len(n.children):
            bad.append(f"node {n.id}: boxes and children differ")
        if isinstance(n, Leaf | Joint) and n.pdf is not None and len(n.pdf) and not math.isclose(float(n.pdf.sum()), 1.0, abs_tol=1e-6):
            bad.append(f"node {n.id}: mass {n.pdf.sum()}")
    return bad


def stats(root: Node) -> dict[str, int]:
    nodes = root.walk()
    out: dict[str, int] = {"nodes": len(nodes), "edges": sum(len(n.children) for n in nodes)}
    for n in nodes:
        out[n.kind] = out.get(n.kind, 0) + 1
    out["parameters"] = sum(n.parameters() if isinstance(n, Leaf) else len(n.pdf) if isinstance(n, Joint) else len(n.weights) if isinstance(n, Sum | Split) else 0 for n in nodes)
    depth = {id(root): 0}
    for n in nodes:
        for c in n.children:
            depth[id(c)] = max(depth.get(id(c), 0), depth[id(n)] + 1)
    out["layers"] = max(depth.values()) + 1
    return out


# --- inference beyond counting


def moments(node: Node, k: int) -> dict[str, float]:
    """E[x^k] of each column."""
    if (f := behaviour("moments", node)) is not None:
        return f(node, k)
    if isinstance(node, Leaf):
        return {node.scope[0]: node.moment(k)}
    if isinstance(node, Joint):
        mid = (node.low + node.high) / 2
        return {c: float((node.pdf * mid[:, i] ** k).sum()) for i, c in enumerate(node.scope)}
    if isinstance(node, Product):
        return {c: v for child in node.children for c, v in moments(child, k).items()}
    if isinstance(node, Factorize):
        out = moments(node.children[0], k)
        total: dict[str, float] = {}
        for box, piece in terminals(node.children[1], {}):
            w = float(probability(node.children[0], {c: np.array([b[0]]) for c, b in box.items()}, {c: np.array([b[1]]) for c, b in box.items()}, 1)[0])
            for c, v in moments(piece, k).items():
                total[c] = total.get(c, 0.0) + w * v
        return out | total
    parts = [moments(c, k) for c in node.children]
    return {c: float(sum(w * p[c] for w, p in zip(node.weights, parts, strict=True))) for c in node.scope}


def variance(node: Node) -> dict[str, float]:
    m1, m2 = moments(node, 1), moments(node, 2)
    return {c: m2[c] - m1[c] ** 2 for c in m1}


def expectation(node: Node, lo: Batch, hi: Batch, m: int, powers: dict[str, int]) -> np.ndarray:
    """E[prod x_c^powers[c] * 1(lo <= row <= hi)]; without powers, the probability."""
    if not set(powers) & set(node.scope):
        return probability(node, lo, hi, m)
    if isinstance(node, Leaf):
        c = node.scope[0]
        return node.partial(lo.get(c, np.full(m, -np.inf)), hi.get(c, np.full(m, np.inf)), powers[c])
    if isinstance(node, Joint):
        mid = (node.low + node.high) / 2
        w = node.pdf.copy()
        for k, c in enumerate(node.scope):
            if c in powers:
                w = w * np.where((mid[:, k] != 0) | (powers[c] > 0), mid[:, k], np.inf) ** powers[c]
        out = np.zeros(m)
        for q in range(m):
            ok = np.ones(len(w), bool)
            for k, c in enumerate(node.scope):
                if c in lo:
                    ok &= (node.high[:, k] >= lo[c][q]) & (node.low[:, k] <= hi[c][q])
            out[q] = w[ok].sum()
        return out
    if isinstance(node, Product):
        return math.prod((expectation(c, lo, hi, m, powers) for c in node.children), start=np.ones(m))
    if isinstance(node, Factorize):
        total = np.zeros(m)
        for box, piece in terminals(node.children[1], {}):
            a = lo | {c: np.maximum(lo[c], x) if c in lo else np.full(m, x) for c, (x, _) in box.items()}
            b = hi | {c: np.minimum(hi[c], y) if c in hi else np.full(m, y) for c, (_, y) in box.items()}
            total += expectation(node.children[0], a, b, m, powers) * expectation(piece, lo, hi, m, powers)
        return total
    return sum(w * expectation(c, lo, hi, m, powers) for w, c in zip(node.weights, node.children, strict=True))


def complete(node: Node, x: Batch, m: int, rng: np.random.Generator | None = None) -> Batch:
    """Unknown cells filled: with rng by draws, else by a most probable completion (argmax branches, leaf modes)."""
    memo: dict[int, np.ndarray] = {}
    log_likelihood(node, x, m, memo)
    out = {c: x.get(c, np.full(m, np.nan)).astype(float).copy() for c in node.scope}
    jobs: list[tuple[Node, np.ndarray]] = [(node, np.arange(m))]
    while jobs:
        n, rows = jobs.pop()
        if not len(rows):
            continue
        if (f := behaviour("complete", n)) is not None:
            for c, v in f(n, {c: out[c][rows] for c in n.scope}, len(rows), rng).items():
                out[c][rows] = v
        elif isinstance(n, Leaf):
            c = n.scope[0]
            empty = rows[np.isnan(out[c][rows])]
            out[c][empty] = n.draw(len(empty), rng) if rng is not None else n.mode()
        elif isinstance(n, Joint):
            for r in rows:
                p = n.pdf.copy()
                for k, c in enumerate(n.scope):
                    if not np.isnan(out[c][r]):
                        p = p * ((n.low[:, k] <= out[c][r]) & (n.high[:, k] >= out[c][r]))
                if p.sum() <= 0:
                    p = n.pdf
                i = int(rng.choice(len(p), p=p / p.sum())) if rng is not None else int(np.argmax(p))
                for k, c in enumerate(n.scope):
                    if np.isnan(out[c][r]):
                        out[c][r] = (n.low[i, k] + n.high[i, k]) / 2
        elif isinstance(n, Product):
            jobs += [(c, rows) for c in n.children]
        elif isinstance(n, Factorize):
            sub = {c: out[c][rows] for c in n.children[0].scope}
            for c, v in complete(n.children[0], sub, len(rows), rng).items():
                out[c][rows] = v
            jobs.append((n.children[1], rows))
        elif isinstance(n, Split):
            at = _inside(n, {c: out[c][rows] for b in n.boxes for c in b}, len(rows))
            at = np.where(at < 0, int(np.argmax(n.weights)), at)
            jobs += [(c, rows[at == i]) for i, c in enumerate(n.children)]
        else:
            with np.errstate(divide="ignore"):
                z = np.stack([(memo[id(c)][rows] if id(c) in memo else log_likelihood(c, {k: v[rows] for k, v in x.items()}, len(rows))) + np.log(w) for w, c in zip(n.weights, n.children, strict=True)])
            if rng is not None:
                z = z + rng.gumbel(size=z.shape)
            at = z.argmax(axis=0)
            jobs += [(c, rows[at == i]) for i, c in enumerate(n.children)]
    return out


def node_gradients(root: Node, x: Batch, m: int) -> tuple[dict[int, np.ndarray], dict[int, np.ndarray]]:
    """Log derivative of the root's value by each node's value, and each node's log value, by node identity."""
    memo: dict[int, np.ndarray] = {}
    log_likelihood(root, x, m, memo)
    grad = {id(n): [] for n in root.walk()}
    grad[id(root)] = [np.zeros(m)]
    done: dict[int, np.ndarray] = {}
    for n in _topological(root):
        g = done[id(n)] = _log_sum(grad[id(n)]) if grad[id(n)] else np.full(m, -np.inf)
        for k, c in enumerate(n.children):
            with np.errstate(divide="ignore", invalid="ignore"):
                if isinstance(n, Sum | Split):
                    at = _inside(n, x, m) if isinstance(n, Split) else None
                    grad[id(c)].append(g + np.log(n.weights[k]) if at is None else np.where(at == k, g, -np.inf))
                else:
                    grad[id(c)].append(g + sum((memo[id(o)] for o in n.children if o is not c), np.zeros(m)))
    return done, memo


def _topological(root: Node) -> list[Node]:
    out, state = [], {}

    def visit(n: Node):
        if id(n) in state:
            return
        state[id(n)] = True
        for c in n.children:
            visit(c)
        out.append(n)

    visit(root)
    return out[::-1]


def feature_gradients(root: Node, x: Batch, m: int) -> Batch:
    """Slope of the root's density by each column: leaf slopes between neighbouring bins times the leaf's gradient."""
    grad, _ = node_gradients(root, x, m)
    out = {c: np.zeros(m) for c in root.scope}
    for n in root.walk():
        if (f := behaviour("slope", n)) is not None:
            out[n.scope[0]] += f(n, x[n.scope[0]]) * np.exp(grad[id(n)])
        elif isinstance(n, Leaf):
            out[n.scope[0]] += n.slope(x[n.scope[0]]) * np.exp(grad[id(n)])
    return out


def em_step_sums(root: Node, x: Batch, m: int) -> dict[int, np.ndarray]:
    """What one EM iteration adds up over all rows, by node id: expected counts of a sum's children, weighted sums of a leaf that has
    parameters to fit."""
    grad, memo = node_gradients(root, x, m)
    top = memo[id(root)]
    out = {}
    for n in root.walk():
        if isinstance(n, Sum):
            with np.errstate(divide="ignore", invalid="ignore"):
                parts = [np.exp(grad[id(n)] + memo[id(c)] + np.log(w) - top) for w, c in zip(n.weights, n.children, strict=True)]
            out[n.id] = np.array([np.nansum(np.where(np.isfinite(top), p, 0.0)) for p in parts])
        elif isinstance(n, Leaf) and n.fits:
            with np.errstate(invalid="ignore"):
                w = np.exp(grad[id(n)] + memo[id(n)] - top)
            v = x[n.scope[0]]
            known = np.isfinite(top) & np.isfinite(w) & ~np.isnan(v)
            out[n.id] = n.em_sums(v[known], w[known])
    return out

