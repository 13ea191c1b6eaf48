"""Exact top-k inner products over vectors in descending length.

Vectors are rotated by the eigenvectors of their second-moment matrix (the right singular vectors of the whole table), so
that a few leading coordinates hold most of an inner product. Candidates are sorted by descending length over the whole
table, by a range partition, and packed in blocks. For a query q with current k-th best score t, a block of longest length L
is skipped once |q| L < t, and with it all that follow in its part; within a block, the partial product over the leading
coordinates plus the Cauchy-Schwarz bound |rest of q| |rest of x| must reach t before the exact product is computed. Exact
products are integers. Bounds are computed in floating point and widened by a margin that covers its rounding.

Queries travel, candidates stay: queries are packed in blocks too, first scanned against the longest `head` vectors (the only
rows that are broadcast, of a fixed number), which gives each query a t that is valid for the whole table, and then sent to
those parts of the candidates that may still reach it. A part holds about part_bytes of vectors, so that what a task holds and
what the driver knows of each part (its longest length) don't grow with the table; the number of parts does. A window per query
merges the k best of each part.

Defined results: vectors that are null or hold null or non-finite components take no part; vectors of unequal length are
filled with zeros; equal scores go to the smaller id; a row isn't its own neighbour, and neither is any other row of its id;
null ids take no part; repeated rows of an id count once per row; scores beyond the range of a long are held at its ends; an
empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from statloom.llm.common import cut

BLOCK, QUERY_BLOCK = 2048, 1024
OUT = "query_id long, vec_id long, score long"
ENDS = np.iinfo(np.int64)


def usable(vector: Column) -> Column:
    """Whether a vector holds only finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & ~F.coalesce(bad, F.lit(True))


def _matrix(b: pa.RecordBatch, column: str, d: int) -> np.ndarray:
    col = b.column(column)
    if not len(col):
        return np.zeros((0, d), np.int64)
    ends, flat = np.asarray(col.offsets), np.asarray(col.flatten())
    lengths = np.diff(ends)
    if (lengths == d).all():
        return flat.reshape(-1, d)
    out = np.zeros((len(lengths), d), np.int64)
    out[np.arange(d) < lengths[:, None]] = flat
    return out


def second_moment(rows: DataFrame, d: int) -> np.ndarray:
    """Sum of x x^T over all rows: d x d numbers from each task, added up in two steps; 64 matrices reach the driver."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        total = np.zeros((d, d))
        for b in batches:
            x = _matrix(b, "v", d).astype(float)
            total += x.T @ x
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % 64], pa.int32()), "m": pa.array([total.tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(m, float) for m in table.column("m").to_pylist())
        return pa.table({"m": pa.array([total.tobytes()], pa.binary())})

    parts = rows.select("v").mapInArrow(sums, "slot int, m binary").groupBy("slot").applyInArrow(add, "m binary").collect()
    return sum((np.frombuffer(r.m, float) for r in parts), np.zeros(d * d)).reshape(d, d)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, held at the ends of the range of a long."""
    most = lambda x: float(np.abs(x.astype(float)).max(initial=0))
    if most(a) * most(b) * a.shape[1] < 2.0**62:
        return np.einsum("ij,ij->i", a, b)
    split = lambda x: (x & 0x3FFFFF, (x >> 22) & 0x3FFFFF, x >> 44)
    p, q = split(a), split(b)
    total = np.zeros(len(a), object)
    for i in range(3):
        for j in range(3):
            total += np.einsum("ij,ij->i", p[i], q[j]).astype(object) << 22 * (i + j)
    return np.array([min(max(t, ENDS.min), ENDS.max) for t in total], np.int64)


class Queries:
    """A block of queries with the scores that a candidate must reach."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, lead: int, least: np.ndarray | None = None):
        self.ids, self.x = ids, x
        self.least = np.full(len(ids), ENDS.min) if least is None else least
        y = x.astype(float) @ turn
        self.lead, self.norm, self.rest = y[:, :lead], np.linalg.norm(y, axis=1), np.linalg.norm(y[:, lead:], axis=1)


class Candidates:
    """A block of candidates in descending length."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, lead: int):
        y = x.astype(float) @ turn
        norm = np.linalg.norm(y, axis=1)
        order = np.argsort(-norm, kind="stable")
        self.ids, self.x, self.norm = ids[order], x[order], norm[order]
        self.lead, self.rest = y[order, :lead], np.linalg.norm(y[order, lead:], axis=1)


def reaches(q: Queries, length: float, bound: np.ndarray) -> np.ndarray:
    """Whether a vector of up to that length may reach each query's bound."""
    return q.norm * length + 1e-9 * (1 + q.norm * length) >= _real(bound)


def _real(bound: np.ndarray) -> np.ndarray:
    return np.where(bound == ENDS.min, -np.inf, bound.astype(float))


Found = tuple[np.ndarray, np.ndarray, np.ndarray]


def scan(q: Queries, blocks: list[Candidates], k: int) -> Found:
    """The k best candidates of each query that reach its bound, as (query index, id, score); blocks in descending length."""
    best: Found = (np.zeros(0, np.int64),) * 3
    bound = q.least.copy()
    for c in blocks:
        live = np.flatnonzero(reaches(q, c.norm[0], bound))
        if not len(live):
            break  # all that follow are shorter
        reach = q.lead[live] @ c.lead.T + np.outer(q.rest[live], c.rest) + 1e-9 * (1 + q.norm[live] * c.norm[0])[:, None]
        a, b = np.nonzero(reach >= _real(bound[live])[:, None])
        a = live[a]
        if not len(a):
            continue
        score = np.concatenate([products(q.x[a[i : i + 100_000]], c.x[b[i : i + 100_000]]) for i in range(0, len(a), 100_000)])
        good = (score >= bound[a]) & (q.ids[a] != c.ids[b])
        best = _best(np.r_[best[0], a[good]], np.r_[best[1], c.ids[b[good]]], np.r_[best[2], score[good]], k)
        bound = np.maximum(bound, _kth(best, len(bound), k))
    return best


def _best(q: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> Found:
    order = np.lexsort((ids, ~score, q))
    q, ids, score = q[order], ids[order], score[order]
    starts = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, int)
    rank = np.arange(len(q)) - np.repeat(starts, np.diff(np.r_[starts, len(q)]))
    return q[rank < k], ids[rank < k], score[rank < k]


def _kth(best: Found, n: int, k: int) -> np.ndarray:
    """The k-th score of each of n queries, or the least there is."""
    at, first, count = np.unique(best[0], return_index=True, return_counts=True)
    out = np.full(n, ENDS.min)
    out[at[count == k]] = best[2][first[count == k] + k - 1]
    return out


def _packed(part: int, kind: int, length: float, ids: np.ndarray, x: np.ndarray, least: np.ndarray) -> dict:
    most = np.abs(x.astype(float)).max(initial=0)
    x = x.astype("<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8")
    return {"part": part, "kind": kind, "length": length, "ids": ids.astype("<i8").tobytes(), "x": x.tobytes(), "least": least.astype("<i8").tobytes()}


def _unpacked(ids: bytes, x: bytes, d: int) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(ids, "<i8")
    return ids, np.frombuffer(x, f"<i{len(x) // (len(ids) * d)}").reshape(-1, d).astype(np.int64)


PACKED = "part int, kind int, length double, ids binary, x binary, least binary"
SCHEMA = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("length", pa.float64()), ("ids", pa.binary()), ("x", pa.binary()), ("least", pa.binary())])


def top_k(candidates: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "vec_id", vector_col: str = "v", head: int = 4096, part_bytes: int = 32 << 20) -> DataFrame:
    """query_id, rank, vec_id, score. Both tables hold an id and an array<long>; queries may be rows of candidates."""
    spark = candidates.sparkSession
    rows = candidates.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).where("id is not null and v is not null")
    asked = queries.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<long>").alias("v")).where("id is not null and v is not null").distinct()
    d, n = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)), F.count("*")).first()
    d = max(d, 1)
    turn = np.linalg.eigh(second_moment(rows, d))[1][:, ::-1].copy()
    lead = max(1, d // 4)
    n_parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n * d * 8 // part_bytes))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, none = TaskContext.get().partitionId(), np.zeros(0, np.int64)
        for b in batches:
            ids, x = np.asarray(b.column("id")), _matrix(b, "v", d)
            lengths = np.linalg.norm(x.astype(float), axis=1)
            for i in range(0, len(ids), BLOCK):
                at = slice(i, i + BLOCK)
                yield pa.RecordBatch.from_pylist([_packed(part, 0, float(lengths[at].max()), ids[at], x[at], none)], schema=SCHEMA)

    length = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double"))
    # equal lengths, and equal rows, are dealt by the row's number, so that they fill several parts
    sorted_rows = rows.select("id", "v", length.alias("l"), F.monotonically_increasing_id().alias("row"))
    sorted_rows = sorted_rows.repartitionByRange(n_parts, F.desc("l"), "row").sortWithinPartitions(F.desc("l"))
    blocks = cut(sorted_rows.select("id", "v").mapInArrow(pack, PACKED))
    lengths = {r.part: r.length for r in blocks.groupBy("part").agg(F.max("length").alias("length")).collect()}  # one number for each part_bytes of vectors
    longest = blocks.orderBy(F.desc("length")).limit(-(-head // BLOCK)).collect()  # of a fixed number of rows

    shared = spark.sparkContext.broadcast((turn, [(r.ids, r.x) for r in longest]))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, first = shared.value
        first = [Candidates(*_unpacked(*r, d), turn, lead) for r in first]
        for b in batches:
            ids, x = np.asarray(b.column("id")), _matrix(b, "v", d)
            q = Queries(ids, x, turn, lead)
            q.least = np.concatenate([_kth(scan(Queries(ids[i : i + QUERY_BLOCK], x[i : i + QUERY_BLOCK], turn, lead), first, k), len(ids[i : i + QUERY_BLOCK]), k) for i in range(0, len(ids), QUERY_BLOCK)] or [q.least])
            for part, longest in lengths.items():
                live = np.flatnonzero(reaches(q, longest, q.least))
                for i in range(0, len(live), QUERY_BLOCK):
                    at = live[i : i + QUERY_BLOCK]
                    yield pa.RecordBatch.from_pylist([_packed(part, 1, 0.0, ids[at], x[at], q.least[at])], schema=SCHEMA)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn, _ = shared.value
        part, own = None, []
        for b in batches:
            for r in b.to_pylist():
                if r["part"] != part:
                    part, own = r["part"], []
                ids, x = _unpacked(r["ids"], r["x"], d)
                if not r["kind"]:
                    own.append(Candidates(ids, x, turn, lead))
                    continue
                q = Queries(ids, x, turn, lead, np.frombuffer(r["least"], "<i8"))
                who, found, score = scan(q, own, k)
                yield pa.RecordBatch.from_pydict({"query_id": q.ids[who], "vec_id": found, "score": score})

    sent = asked.mapInArrow(ask, PACKED)
    found = blocks.unionByName(sent).repartition(n_parts, "part").sortWithinPartitions("part", "kind", F.desc("length")).mapInArrow(meet, OUT)
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
