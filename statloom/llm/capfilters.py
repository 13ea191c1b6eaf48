"""Near-duplicate vectors within a label by spherical-cap filters.

A filter is a direction; a vector passes it if their inner product reaches a threshold. Directions are a random product code:
after a random rotation, a vector's two halves are compared with c codewords each, and filter (i, j) is the direction made of
codewords i and j, so c * c filters are decoded from 2 c inner products: of each half's list only codewords that can still
reach the threshold are visited. The threshold is set so that a random vector passes `passed` filters; a vector that passes
fewer is listed under its `passed` best, so that none has a short list; and c follows the number of vectors of a label so that
a filter holds few unrelated vectors at any table size. Two vectors at cosine 0.93 share many of the filters that either passes.

What is joined on filters is a vector's key and its components rounded to bytes, with a bound of what the rounding may change.
Vectors of one filter whose rounded cosine is near enough for that bound are linked provisionally, and provisional links form
candidate groups. In these, all pairs are verified in double precision, each vector being sent once for each block pair of its
group. So links are counted once, and pairs are never written out. Equal vectors of a label are one representative with a
multiplicity. A filter or a group with many vectors is dealt in pairs of blocks to many tasks.

Defined results: rows whose label or id is null, or whose vector is null, empty, zero or holds null or non-finite components
link with nothing and are their own component; vectors of unequal length don't link; rows of equal id and vector are each
other's link; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import connected_components, cut, deal_blocks, join_hot, pair_indices, star_edges, whole_groups
from statloom.llm.minhash import sized
from statloom.llm.topk import usable

PASSED, LEAST_CODE = 32, 128


class Code:
    """A random product code of c * c filters over d dimensions."""

    def __init__(self, d: int, c: int, passed: int, seed: int = 29):
        r = np.random.default_rng([seed, d, c])
        self.d, self.c, self.passed, self.half = d, c, passed, max(1, d // 2)
        self.turn = np.linalg.qr(r.normal(size=(d, d)))[0]
        unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
        self.left, self.right = unit(r.normal(size=(c, self.half))), unit(r.normal(size=(c, max(1, d - self.half))))
        if d == 1:
            self.right[:] = 0
        x = unit(r.normal(size=(64, d))) @ self.turn
        best = np.concatenate([np.sort((a[:, None] + b[None, :]).ravel())[-8 * passed :] if c * c > 8 * passed else (a[:, None] + b[None, :]).ravel() for a, b in zip(*self._scores(x), strict=True)])
        self.least = float(np.sort(best)[-min(len(best), 64 * passed)])

    def _scores(self, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        right = y[:, self.half :] @ self.right.T if self.d > 1 else np.zeros((len(y), self.c))
        return y[:, : self.half] @ self.left.T, right

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector, ascending, the filters whose threshold it reaches, and in any case its `passed` best."""
        out = []
        k = min(self.passed, self.c)
        u, v = np.nonzero(np.outer(np.arange(1, k + 1), np.arange(1, k + 1)) <= self.passed)  # where the best sums of two sorted lists are
        for at in range(0, len(x), 512):
            left, right = self._scores(x[at : at + 512] @ self.turn)
            order = np.argsort(-right, axis=1, kind="stable")
            best = -np.sort(-left, axis=1)[:, u] + np.take_along_axis(right, order, axis=1)[:, v]
            nth = min(self.passed, best.shape[1]) - 1
            least = np.minimum(self.least, -np.partition(-best, nth, axis=1)[:, nth])
            for a, b, o, low in zip(left, right, order, least, strict=True):
                b = -b[o]  # ascending
                i = np.flatnonzero(a - b[0] >= low)
                n = np.searchsorted(b, a[i] - low, "right")
                j = np.concatenate([o[:k] for k in n]) if len(n) else np.zeros(0, np.int64)
                out.append(np.sort(np.repeat(i, n) * self.c + j).astype("<i8"))
        return out


@lru_cache(maxsize=8)
def code(d: int, c: int, passed: int) -> Code:
    return Code(d, c, passed)


def code_size(per_label: int, passed: int = PASSED) -> int:
    """Codewords for which a filter holds about one unrelated vector of a label; a power of two, so it seldom changes."""
    return max(LEAST_CODE, 1 << round(np.log2(max(2.0, np.sqrt(passed * per_label)))))


def near_vectors(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", least: float = 0.93, passed: int = PASSED) -> DataFrame:
    """id_col, n_links (other rows at cosine of at least `least` with the same label), component_id, kept."""
    valid = F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & usable(F.col(vector_col)) & F.exists(vector_col, lambda x: x != 0)
    table = rows.select(F.col(id_col).alias("id"), F.when(valid, F.col(label_col)).alias("label"), F.when(valid, F.col(vector_col).cast("array<double>")).alias("v"))
    table = table.withColumn("key", F.when(F.col("v").isNotNull(), F.xxhash64("label", "v")))
    reps = table.where("v is not null").groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("n"), F.first("key").alias("key"))
    d_and_n = table.where("v is not null").groupBy("label", F.size("v").alias("d")).count().agg(F.max("count")).first()[0]
    c = code_size(d_and_n or 1, passed)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            col = b.column("v")
            ends, flat = np.asarray(col.offsets), np.asarray(col.flatten())
            filters: list = [None] * b.num_rows
            packed: list = [None] * b.num_rows
            rounded: list = [None] * b.num_rows
            lengths = np.diff(ends)
            for d in np.unique(lengths):
                who = np.flatnonzero(lengths == d)
                x = np.stack([flat[ends[i] - ends[0] : ends[i + 1] - ends[0]] for i in who])
                x = x / np.abs(x).max(axis=1, keepdims=True)  # squares neither overflow nor vanish
                x = x / np.linalg.norm(x, axis=1, keepdims=True)
                step = np.abs(x).max(axis=1, keepdims=True) / 127
                near = np.rint(x / step).astype(np.int8)
                head = np.c_[step[:, 0], np.linalg.norm(x - near * step, axis=1)].astype("<f4")
                for i, f, u, h, r in zip(who, code(int(d), c, passed).decode(x), x, head, near, strict=True):
                    filters[i], packed[i], rounded[i] = f, u.tobytes(), h.tobytes() + r.tobytes()
            made = {"key": b.column("key"), "n": b.column("n"), "d": pa.array(lengths.astype(np.int32)), "x": pa.array(packed, pa.binary()), "rounded": pa.array(rounded, pa.binary()), "filters": pa.array(filters, pa.list_(pa.int64()))}
            yield pa.RecordBatch.from_pydict(made)

    coded = cut(reps.select("key", "n", "v").mapInArrow(decode, "key long, n long, d int, x binary, rounded binary, filters array<long>").join(reps.select("key", "label", "id"), "key"))
    listed = coded.select("key", "label", "d", "rounded", F.explode("filters").alias("filter")).select(F.xxhash64("label", "d", "filter").alias("at"), "key", "rounded")
    sizes = listed.groupBy("at").agg(F.count("*").alias("size")).where("size > 1")
    members = join_hot(listed, sizes, "at", "size", listed.count())
    group = ["at", "_i", "_j"]
    dealt = deal_blocks(members, "key", "size").select(*group, "_own", "key", "rounded")
    near = dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_near(group, least), "a long, b long")
    groups = cut(connected_components(near))
    members = sized(groups).withColumnRenamed("node", "key").join(coded.select("key", F.col("n").alias("weight"), "x"), "key")
    group = ["root", "_i", "_j"]
    dealt = deal_blocks(members, "key", "size", 256).select(*group, "_own", "key", "weight", "x")
    links = cut(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(_verify(group, least), "key long, links long, other long"))

    counted = links.where("links > 0").groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(links.where("other is not null"), "key", "other")
    kin = coded.select("key", "id", "n").join(counted, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    kin = cut(kin.select("key", "id", "root", "n", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    first = kin.groupBy("root").agg(F.min("id").alias("component"), F.count("*").alias("reps"))
    n_rows = kin.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    kin = join_hot(kin, first, "root", "reps", n_rows).select("key", "n", "links", "component")
    out = join_hot(table.where("key is not null").select("id", "key"), kin, "key", "n", n_rows)
    out = out.select("id", "links", "component").union(table.where("key is null").select("id", F.lit(0), "id"))
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))


def _near(group: list[str], least: float):
    """Links that join, within each group, those vectors whose cosine may reach least as far as their rounded components tell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group, 16_384):
            key, own = (table.column(c).to_numpy() for c in ("key", "_own"))
            crossed = table.column("_i").to_numpy() != table.column("_j").to_numpy()
            packed = table.column("rounded").to_pylist()
            size = np.array([len(p) for p in packed]) - 8
            step, off = (np.frombuffer(b"".join(p[:8] for p in packed), "<f4").reshape(-1, 2).T.astype(float)[k] for k in (0, 1))
            x = np.zeros((len(packed), size.max()), np.float32)
            for d in np.unique(size):
                who = np.flatnonzero(size == d)
                x[who, :d] = np.frombuffer(b"".join(packed[i][8:] for i in who), np.int8).reshape(len(who), d)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for a, b in pair_indices(starts, len(packed), own, crossed, 200_000):
                cosine = np.einsum("ij,ij->i", x[a], x[b]).astype(float) * step[a] * step[b]
                # |x.y - x'.y'| <= |x - x'| + |y - y'| + |x - x'| |y - y'| for unit x and y
                hit = (cosine + (off[a] + off[b]) * (1 + 1e-5) + off[a] * off[b] >= least - 1e-5) & (key[a] != key[b])
                node, root = star_edges(key[a[hit]], key[b[hit]])
                left.append(node)
                right.append(root)
            node, root = star_edges(np.concatenate(left), np.concatenate(right))
            yield pa.RecordBatch.from_pydict({"a": pa.array(node, pa.int64()), "b": pa.array(root, pa.int64())})

    return run


def _verify(group: list[str], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group, 4096):
            n = table.num_rows
            key, weight, own, i, j = (table.column(c).to_numpy() for c in ("key", "weight", "_own", "_i", "_j"))
            x = [np.frombuffer(v) for v in table.column("x").to_pylist()]
            links = np.zeros(n, np.int64)
            left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            for lo, hi in zip(starts, np.r_[starts[1:], n], strict=True):
                m = np.stack(x[lo:hi])  # of one length, as only such vectors are linked
                ok = np.triu(m @ m.T >= least, 1)
                if i[lo] != j[lo]:
                    ok &= own[lo:hi, None] != own[None, lo:hi]
                a, b = np.nonzero(ok)
                links[lo:hi] += ok @ weight[lo:hi] + ok.T @ weight[lo:hi]
                node, root = star_edges(key[lo + a], key[lo + b])
                left.append(node)
                right.append(root)
            some = np.flatnonzero(links)
            node, root = np.concatenate(left), np.concatenate(right)
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.r_[key[some], node]),
                "links": pa.array(np.r_[links[some], np.zeros(len(node), np.int64)]),
                "other": pa.array(np.r_[np.zeros(len(some), np.int64), root], mask=np.r_[np.ones(len(some), bool), np.zeros(len(node), bool)]),
            })

    return run
