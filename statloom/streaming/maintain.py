"""Keeping a model up to date under inserted and deleted rows, in batches or as a stream.

A batch is routed from the root: to the nearest centre of a sum, into the box of a split, by columns elsewhere. Each task
routes its own rows and sends counts of bins and cells; their sums are merged into the model. A leaf's mass becomes
(n pdf + m delta) / (n + m) with non-null counts n and m (negative for deletions); a sum's weights follow its counts.

A value that no bin holds gets a bin of its own, as long as a batch brings no more than NEW of them to a leaf. If it brings more,
or the leaf's bins are ranges of a real column, such values count in the nearest bin, which is widened to hold them. So what
reaches the driver is bounded for each leaf, whatever the batch.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.operators.histograms import PAD
from statloom.plans import nodes as N
from statloom.plans.model import Model
from statloom.sources.shared import cut


def update(model: Model, batch: DataFrame, sign: int = 1) -> Model:
    """The model with batch's rows added (sign 1) or taken out (sign -1)."""
    if sign not in (1, -1):
        raise ValueError("sign is 1 or -1")
    root = N.assign_ids(N.copy(model.root))
    scope = list(root.scope)
    shared = model.spark.sparkContext.broadcast(pickle.dumps(root))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        r = pickle.loads(shared.value)  # noqa: S301  written above
        for b in batches:
            out: list[tuple] = []
            _route(r, {c: b[c].to_numpy(float, na_value=np.nan) for c in scope}, np.arange(len(b)), out)
            yield pd.DataFrame(out, columns=["node", "what", "key", "n"])

    doubles = batch.select(*[F.col(c).cast("double").alias(c) for c in scope])
    deltas = cut(doubles.mapInPandas(count, "node int, what string, key string, n long").groupBy("node", "what", "key").agg(F.sum("n").alias("n")))
    many = {r.node for r in deltas.where("what = 'new'").groupBy("node").count().where(F.col("count") > NEW).collect()}  # at most one row for each leaf
    known = deltas.where((F.col("what") != "new") | ~F.col("node").isin(list(many)))
    nearest = deltas.where((F.col("what") == "new") & F.col("node").isin(list(many)))

    def settle(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        nodes = {n.id: n for n in pickle.loads(shared.value).walk()}  # noqa: S301  written above
        for b in batches:
            yield pd.DataFrame([(i, "near", f"{_nearest(nodes[i], k)}", k, n) for i, k, n in zip(b["node"], b["key"], b["n"], strict=True)], columns=["node", "what", "at", "key", "n"])

    if many:
        near = cut(nearest.mapInPandas(settle, "node int, what string, at string, key string, n long"))
        ends = near.select("node", "at", F.posexplode(F.split("key", ",")).alias("i", "x")).groupBy("node", "at", "i").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
        ends = ends.groupBy("node", "at").agg(F.sort_array(F.collect_list(F.struct("i", "lo", "hi"))).alias("e"))  # one for each column of a leaf
        near = near.groupBy("node", "what", "at").agg(F.sum("n").alias("n")).join(ends, ["node", "at"])
        text = [F.array_join(F.col(f"e.{k}").cast("array<string>"), ",") for k in ("lo", "hi")]
        near = near.select("node", "what", F.concat_ws("|", "at", *text).alias("key"), "n")
        known = known.unionByName(near)
    deltas = known.collect()  # at most a leaf's bins and NEW rows for each leaf
    by_node: dict[int, list] = {}
    for r in deltas:
        by_node.setdefault(r.node, []).append(r)
    for n in root.walk():
        _merge(n, by_node.get(n.id, []), sign)
    if bad := N.validate(root):
        raise AssertionError("; ".join(bad))
    return Model(root, model.rows + sign * batch.count(), model.spark)


#: New values that a batch may add to a leaf as bins of their own.
NEW = 10_000


def _nearest(n: N.Node, key: str) -> int:
    """The bin or cell nearest to a value."""
    if isinstance(n, N.Leaf):
        v = float(key)
        return int(np.argmin(np.maximum(n.lo - v, 0) + np.maximum(v - n.hi, 0))) if len(n.pdf) else 0
    row = np.array([float(y) for y in key.split(",")])
    return int(np.argmin((np.maximum(n.low - row, 0) + np.maximum(row - n.high, 0)).sum(axis=1))) if len(n.pdf) else 0


def _route(n: N.Node, x: N.Batch, rows: np.ndarray, out: list[tuple]) -> None:
    if not len(rows):
        return
    if isinstance(n, N.Leaf):
        v = x[n.scope[0]][rows]
        ok = ~np.isnan(v)
        out += [(n.id, "rows", "", len(rows)), (n.id, "non_null", "", int(ok.sum()))]
        at = n.bin_of(v[ok])
        out += [(n.id, "bin", str(i), int(k)) for i, k in zip(*np.unique(at[at >= 0], return_counts=True), strict=True)]
        fresh = v[ok][at < 0]
        if n.discrete or not len(n.pdf):
            out += [(n.id, "new", repr(float(u)), int(k)) for u, k in zip(*np.unique(fresh, return_counts=True), strict=True)]
        elif len(fresh):  # beyond the ends of a real column's bins, or in a gap
            which = np.array([_nearest(n, repr(float(u))) for u in fresh])
            out += [(n.id, "near", f"{i}|{float(fresh[which == i].min())!r}|{float(fresh[which == i].max())!r}", int((which == i).sum())) for i in np.unique(which).tolist()]
    elif isinstance(n, N.Joint):
        v = np.stack([x[c][rows] for c in n.scope], 1)
        v = v[~np.isnan(v).any(axis=1)]
        out.append((n.id, "rows", "", len(rows)))
        u, k = np.unique(v, axis=0, return_counts=True)
        for row, c in zip(u, k, strict=True):
            hit = np.flatnonzero(((n.low <= row) & (row <= n.high)).all(axis=1))
            out.append((n.id, "cell", str(hit[0]), int(c)) if len(hit) else (n.id, "new", ",".join(repr(float(y)) for y in row), int(c)))
    elif isinstance(n, N.Sum) and n.centres:
        far = np.stack([((np.stack([np.nan_to_num(x[c][rows]) for c in n.scope], 1) - m) ** 2).sum(axis=1) for m in n.centres])
        at = far.argmin(axis=0)
        for i, c in enumerate(n.children):
            out.append((n.id, "child", str(i), int((at == i).sum())))
            _route(c, x, rows[at == i], out)
    elif isinstance(n, N.Split):
        at = N.box_of(n.boxes, {c: x[c][rows] for box in n.boxes for c in box}, len(rows))
        for i, c in enumerate(n.children):
            out.append((n.id, "child", str(i), int((at == i).sum())))
            _route(c, x, rows[at == i], out)
    elif isinstance(n, N.Sum):
        raise ValueError("a sum without centres can't route rows")
    else:
        for c in n.children:
            _route(c, x, rows, out)


def _merge(n: N.Node, deltas: list, sign: int) -> None:
    got = {(r.what, r.key): r.n for r in deltas}
    if not got:
        return
    if isinstance(n, N.Sum | N.Split):
        counts = n.weights * n.rows + sign * np.array([got.get(("child", str(i)), 0) for i in range(len(n.children))])
        if (counts < -1e-6).any():
            raise ValueError(f"node {n.id}: more rows deleted than it has")
        n.rows = float(counts.sum())
        n.weights = np.maximum(counts, 0) / counts.sum() if counts.sum() > 0 else n.weights
    elif isinstance(n, N.Leaf):
        old = n.rows * n.non_null
        mass = n.pdf * old
        for (what, key), k in got.items():
            if what == "bin":
                mass[int(key)] += sign * k
        n.lo, n.hi = n.lo.copy(), n.hi.copy()
        for (what, key), k in got.items():
            if what == "near":
                i, low, high = key.split("|")
                i = int(i)
                mass[i] += sign * k
                n.lo[i] = min(n.lo[i], np.nextafter(float(low), -np.inf)) if i == 0 else n.lo[i] if float(low) > n.lo[i] else max(n.hi[i - 1], np.nextafter(float(low), -np.inf))
                n.hi[i] = max(n.hi[i], float(high)) if i + 1 == len(n.hi) else min(max(n.hi[i], float(high)), n.lo[i + 1])
        fresh = sorted((float(key), k) for (what, key), k in got.items() if what == "new")
        if fresh and sign < 0:
            raise ValueError(f"node {n.id}: a deleted value was never there")
        if (mass < -0.5).any():
            raise ValueError(f"node {n.id}: more rows of a bin deleted than it has")
        lo, hi, value = n.lo, n.hi, n.value
        for v, k in fresh:  # a value between or beyond the bins gets one of its own
            i = int(np.searchsorted(hi, v))
            a = max(v - PAD, hi[i - 1]) if i else v - PAD
            b = min(v + PAD, lo[i]) if i < len(lo) else v + PAD
            lo, hi, value, mass = np.insert(lo, i, a), np.insert(hi, i, max(b, v)), np.insert(value, i, v), np.insert(mass, i, float(k))
        rows = n.rows + sign * got.get(("rows", ""), 0)
        now = old + sign * got.get(("non_null", ""), 0)
        mass = np.maximum(mass, 0)
        n.lo, n.hi, n.value, n.rows = lo, hi, value, rows
        n.non_null = float(now / rows) if rows > 0 else 0.0
        n.pdf = mass / mass.sum() if mass.sum() > 0 else mass
        n.cum = np.r_[0.0, np.cumsum(n.pdf)]
    elif isinstance(n, N.Joint):
        mass = n.pdf * n.rows
        for (what, key), k in got.items():
            if what == "cell":
                mass[int(key)] += sign * k
            elif what == "near":
                i, low, high = key.split("|")
                mass[int(i)] += sign * k
                n.low[int(i)] = np.minimum(n.low[int(i)], [float(y) for y in low.split(",")])
                n.high[int(i)] = np.maximum(n.high[int(i)], [float(y) for y in high.split(",")])
            elif what == "new":
                if sign < 0:
                    raise ValueError(f"node {n.id}: a deleted value was never there")
                row = np.array([float(y) for y in key.split(",")])
                n.low, n.high, mass = np.vstack([n.low, row]), np.vstack([n.high, row]), np.r_[mass, float(k)]
        n.rows += sign * got.get(("rows", ""), 0)
        mass = np.maximum(mass, 0)
        n.pdf = mass / mass.sum() if mass.sum() > 0 else mass


def spark_path(spark, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def follow(model: Model, stream: DataFrame, path: str, checkpoint: str, sign_column: str | None = None):
    """Starts a streaming query that keeps the model stored under path up to date; stream's rows carry model columns.

    sign_column: 1 for inserted and -1 for deleted rows. Each micro-batch writes a new version <path>/v<batch id>, so a batch
    that runs again after a failure replaces its own version: it starts from the version before it. Two versions are kept.
    """
    model.save(f"{path}/v-1")

    def apply(batch: DataFrame, batch_id: int) -> None:
        m = Model.load(batch.sparkSession, f"{path}/v{batch_id - 1}")
        parts = [(batch, 1)] if sign_column is None else [(batch.where(F.col(sign_column) == s), s) for s in (1, -1)]
        for rows, s in parts:
            if not rows.isEmpty():
                m = update(m, rows, s)
        m.save(f"{path}/v{batch_id}")
        if batch_id > 0:  # the version before is what a batch that runs again starts from; older ones go
            old = spark_path(batch.sparkSession, f"{path}/v{batch_id - 2}")
            old.getFileSystem(batch.sparkSession._jsc.hadoopConfiguration()).delete(old, True)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).start()
