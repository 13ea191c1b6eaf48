"""MinHash parts that the line and n-gram operators share.

Signatures. A permutation orders all shingle hashes of a text, whatever their number, on a circle. It gives four values: the
nearest hash on either side of either of two opposite points. Each is the extreme of a random order, so two texts agree in it
with the probability of their Jaccard similarity. The values of a band come from as many independent permutations. Bands that
share permutations look from different points, whose nearest hashes are different shingles but in sets of a few, so one
differing shingle seldom spoils two of them.

Banding. A band is `rows` values. With b bands, a pair at similarity s meets in some band with probability
1 - (1 - s**rows)**b; bands_for() gives the b for a target recall. Entries (band hash, key, 64-bit sketch) are packed by
slices of the band hash and shuffled as few large byte strings. In a slice, keys of one band whose sketches agree often enough
for the threshold (recall of that test alone: over 0.999) are candidates; each band gives the edges of a spanning forest of
its candidates, and connected candidates form groups.

Verification. Within a candidate group all pairs are compared on their full shingle sets: small groups together, by sorting
their shingles, large ones by strings of bits that bound how similar two sets can be, then exactly, in blocks of bounded size
that are dealt to many tasks, some at a time, so that what is dealt doesn't fill the disk. A band or a group of any size is thus complete: there is no cap.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import connected_components, cut, deal_blocks, join_hot, pair_indices, star_edges, whole_groups

ENTRY = np.dtype([("band", "<u8"), ("key", "<i8"), ("sketch", "<u8")])
#: Bands with more keys than this are dealt out again, as block pairs.
WIDE = 4096


def bands_for(least: float, rows: int, recall: float) -> int:
    return math.ceil(math.log(1 - recall) / math.log(1 - least**rows))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 64-bit integers."""
    y = x >> np.uint64(33)
    y ^= x
    y *= np.uint64(0xFF51AFD7ED558CCD)
    z = y >> np.uint64(33)
    z ^= y
    z *= np.uint64(0xC4CEB9FE1A85EC53)
    return np.bitwise_xor(z, np.right_shift(z, np.uint64(33), out=y), out=y)


def mix32(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of unsigned 32-bit integers."""
    y = x >> np.uint32(16)
    y ^= x
    y *= np.uint32(0x85EBCA6B)
    z = y >> np.uint32(13)
    z ^= y
    z *= np.uint32(0xC2B2AE35)
    return np.bitwise_xor(z, np.right_shift(z, np.uint32(16), out=y), out=y)


class Signer:
    """Signatures of bands * rows values, as entries."""

    def __init__(self, bands: int, rows: int, seed: int = 41):
        self.bands, self.rows = bands, rows
        r = np.random.default_rng([seed, bands, rows])
        n = -(-bands // 4) * rows
        self.flip = r.integers(0, 1 << 32, rows, dtype=np.uint64).astype(np.uint32)  # one for each value of a band
        self.odd = r.integers(0, 1 << 32, (rows, n // rows), dtype=np.uint64).astype(np.uint32) | np.uint32(1)
        self.weights = r.integers(0, 1 << 63, (bands, rows, 1), dtype=np.uint64) | np.uint64(1)
        self.bits = r.integers(0, 1 << 32, (64, 1), dtype=np.uint64).astype(np.uint32) | np.uint32(1)

    def signatures(self, hashes: np.ndarray, starts: np.ndarray, held: int = 1 << 17) -> np.ndarray:
        """hashes: scrambled 32-bit shingle hashes of all texts; starts: where each text's begin (none is empty). Bands x rows x texts.

        Texts are taken in runs of about `held` hashes: few enough for the cache, many enough for numpy's calls not to count."""
        out = np.empty((-(-self.bands // 4), 4, self.rows, len(starts)), np.uint32)
        signed = out.view(np.int32)
        cuts = np.flatnonzero(np.r_[True, starts[1:] // held != starts[:-1] // held]) if len(starts) else []
        for lo, hi in zip(cuts, [*cuts[1:], len(starts)], strict=True):
            own = hashes[starts[lo] : starts[hi] if hi < len(starts) else len(hashes)]
            at, flipped, turned = starts[lo:hi] - starts[lo], np.empty_like(own), np.empty_like(own)
            halved = turned.view(np.int32)
            for r, flip in enumerate(self.flip):
                np.bitwise_xor(own, flip, out=flipped)
                for b, odd in enumerate(self.odd[r]):
                    np.multiply(flipped, odd, out=turned)
                    np.minimum.reduceat(turned, at, out=out[b, 0, r, lo:hi])
                    np.maximum.reduceat(turned, at, out=out[b, 1, r, lo:hi])
                    np.minimum.reduceat(halved, at, out=signed[b, 2, r, lo:hi])
                    np.maximum.reduceat(halved, at, out=signed[b, 3, r, lo:hi])
        return out.reshape(-1, self.rows, len(starts))[: self.bands]

    def entries(self, keys: np.ndarray, sig: np.ndarray) -> np.ndarray:
        """Texts x bands; in memory, band by band."""
        values = sig.reshape(-1, len(keys))
        values = values[np.arange(64) % len(values)] * self.bits
        sketch = np.packbits((values >> np.uint32(31)).astype(np.uint8), axis=0).T.copy().view("<u8")[:, 0]
        out = np.empty((self.bands, len(keys)), ENTRY)
        out["key"], out["sketch"] = keys, sketch
        for b in range(self.bands):
            out["band"][b] = mix64((sig[b] * self.weights[b]).sum(axis=0) + np.uint64(b))
        return out.T


def agreeing(least: float) -> int:
    """Sketch bits of 64 that a pair at similarity `least` shares with a probability of over 0.999."""
    p = (1 + least) / 2
    return int(64 * p - 3.6 * math.sqrt(64 * p * (1 - p)))


def slices(entries: np.ndarray, n_slices: int) -> Iterator[tuple[int, bytes]]:
    """Entries packed by the slice of their band hash."""
    entries = entries.ravel(order="K")
    own = ((entries["band"] >> np.uint64(40)) * np.uint64(n_slices) >> np.uint64(24)).astype(np.uint16 if n_slices < 1 << 16 else np.uint32)
    order = np.argsort(own, kind="stable")
    packed, own = entries.view(np.uint64).reshape(len(entries), 3).take(order, axis=0), own[order]  # plain numbers move faster than records
    ends = np.r_[np.flatnonzero(own[1:] != own[:-1]) + 1, len(own)] if len(own) else []
    start = 0
    for end in ends:
        yield int(own[start]), packed[start:end].tobytes()
        start = end


def _agree(sketch_a: np.ndarray, sketch_b: np.ndarray) -> np.ndarray:
    return np.int64(64) - np.bitwise_count(sketch_a ^ sketch_b).astype(np.int64)


def _links(keys: np.ndarray, sketch: np.ndarray, bits: int, pairs: Iterable[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) that join those pairs of different keys whose sketches agree in at least bits."""
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i, j in pairs:
        near = (_agree(sketch[i], sketch[j]) >= bits) & (keys[i] != keys[j])
        if near.any():
            node, root = star_edges(keys[i[near]], keys[j[near]])
            a.append(node)
            b.append(root)
    return star_edges(np.concatenate(a), np.concatenate(b))


def candidate_groups(rounds: Iterable[DataFrame], least: float) -> DataFrame:
    """(node, root): keys that share a candidate group, from rows (slice int, payload binary). Keys with no candidate have no row.

    Each round has bands of its own, whose entries leave the disk before the next."""
    return connected_components(reduce(DataFrame.union, [candidate_edges(packed, least) for packed in rounds]), "a", "b")


def sized(groups: DataFrame) -> DataFrame:
    """groups (node, root) with size, the number of a root's nodes. Rows of three numbers; no root gathers in a task."""
    return join_hot(groups, groups.groupBy("root").agg(F.count("*").alias("size")), "root", "size", groups.count())


def _bands_of(e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different entries (band, key) of bands with several keys, sorted, and where each band starts."""
    # most bands have one entry: a plain sort of their first bits, with places for the last, leaves those that may have more
    low = np.uint64((1 << len(e).bit_length()) - 1)
    band = np.sort((e["band"] & ~low) | np.arange(len(e), dtype=np.uint64))
    new = np.r_[True, (band[1:] ^ band[:-1]) > low, True]
    e = e.view(np.uint64).reshape(len(e), 3).take((band[~(new[:-1] & new[1:])] & low).astype(np.int64), axis=0).view(ENTRY)[:, 0]
    e = e[np.lexsort((e["key"], e["band"]))]
    same = e["band"][1:] == e["band"][:-1]
    e = e[np.r_[True, ~(same & (e["key"][1:] == e["key"][:-1]))]] if len(e) else e
    new = np.r_[True, e["band"][1:] != e["band"][:-1], True] if len(e) else np.ones(1, bool)
    e = e[~(new[:-1] & new[1:])]
    return e, np.flatnonzero(np.r_[True, e["band"][1:] != e["band"][:-1]]) if len(e) else np.zeros(0, np.int64)


def candidate_edges(packed: DataFrame, least: float) -> DataFrame:
    """(a, b): links that join the candidates which one round's bands give."""
    bits = agreeing(least)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, ["slice"], 1):
            payloads = table.column("payload").to_pylist()
            for lo, hi in zip(starts, [*starts[1:], len(payloads)], strict=True):
                e, at = _bands_of(np.frombuffer(b"".join(payloads[lo:hi]), ENTRY))
                size = np.repeat(np.diff(np.r_[at, len(e)]), np.diff(np.r_[at, len(e)]))
                w, wide = e[size > WIDE], size[size > WIDE]
                e = e[size <= WIDE]
                at = np.flatnonzero(np.r_[True, e["band"][1:] != e["band"][:-1]]) if len(e) else at[:0]
                keys = e["key"].copy()
                a, b = _links(keys, e["sketch"].copy(), bits, pair_indices(at, len(e)))
                none = np.zeros(len(a), np.int64)
                edge = np.r_[np.ones(len(a), bool), np.zeros(len(w), bool)]
                yield pa.RecordBatch.from_pydict({
                    "a": pa.array(np.r_[a, w["key"]]),
                    "b": pa.array(np.r_[b, np.zeros(len(w), np.int64)], mask=~edge),
                    "band": pa.array(np.r_[none, w["band"].astype(np.int64)], mask=edge),
                    "sketch": pa.array(np.r_[none, w["sketch"].astype(np.int64)], mask=edge),
                    "size": pa.array(np.r_[none, wide], mask=edge),
                })

    met = packed.repartition("slice").sortWithinPartitions("slice").mapInArrow(meet, "a long, b long, band long, sketch long, size long")
    met = cut(met)
    group = ["band", "_i", "_j"]

    def meet_wide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group, 2048):
            key, sketch, own, i, j = (table.column(c).to_numpy() for c in ("a", "sketch", "_own", "_i", "_j"))
            a, b = _links(key, sketch.view(np.uint64), bits, pair_indices(starts, table.num_rows, own, i != j))
            yield pa.RecordBatch.from_pydict({"a": a, "b": b})

    wide = deal_blocks(met.where("band is not null").select("a", "band", "sketch", "size"), "a", "size", 1024)
    more = wide.repartition(*group).sortWithinPartitions(*group).mapInArrow(meet_wide, "a long, b long")
    parts = met.rdd.getNumPartitions()
    few = max(1, min(parts, met.sparkSession.sparkContext.defaultParallelism), parts // 8)  # an edge is much smaller than the entries that gave it
    return met.where("b is not null").select("a", "b").coalesce(few).union(more)


def bloom_of(keys: DataFrame, column: str, bits: int = 1 << 25) -> np.ndarray:
    """A Bloom filter of a fixed 4 MB (two hashes). It only spares rows from a shuffle, so that it fills up does no harm."""

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held = np.zeros(bits, bool)
        for b in batches:
            for at in _bloom_at(b.column(0).to_numpy(), bits):
                held[at] = True
        yield pa.RecordBatch.from_pydict({"slot": pa.array([TaskContext.get().partitionId() % 8], pa.int32()), "held": pa.array([np.packbits(held).tobytes()], pa.binary())})

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(bits // 8, np.uint8)
        for m in table.column("held").to_pylist():
            total |= np.frombuffer(m, np.uint8)
        return pa.table({"held": pa.array([total.tobytes()], pa.binary())})

    total = np.zeros(bits // 8, np.uint8)
    few = keys.select(column).coalesce(64)
    for row in few.mapInArrow(fill, "slot int, held binary").groupBy("slot").applyInArrow(add, "held binary").groupBy().applyInArrow(add, "held binary").toLocalIterator():  # one filter
        total |= np.frombuffer(row.held, np.uint8)
    return total


def _bloom_at(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    h = mix64(keys.astype(np.int64).view(np.uint64))
    return (h % np.uint64(bits)).astype(np.int64), ((h >> np.uint64(32)) % np.uint64(bits)).astype(np.int64)


def maybe_in(bloom: np.ndarray, keys: np.ndarray) -> np.ndarray:
    a, b = _bloom_at(keys, len(bloom) * 8)
    has = lambda x: bloom[x >> 3] >> (7 - (x & 7)).astype(np.uint8) & 1
    return (has(a) & has(b)).astype(bool)


def _by_size(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The order of sets by size, sizes in that order, and (row, column) of each different hash of each set, by column; row is a place in
    that order."""
    counts = np.fromiter(map(len, sets), np.int64, len(sets))
    flat, row = mix64(np.concatenate(sets)), np.repeat(np.arange(len(sets)), counts)
    low = np.uint64((1 << len(sets).bit_length()) - 1)
    order = np.argsort((flat & ~low) | row.astype(np.uint64))
    flat, row = flat[order], row[order]
    new = np.r_[True, flat[1:] != flat[:-1]] if len(flat) else np.zeros(0, bool)
    once = new | np.r_[True, row[1:] != row[:-1]] if len(row) else new
    column, row = (np.cumsum(new) - 1)[once], row[once]
    n = np.bincount(row, minlength=len(sets))
    by_size = np.argsort(n, kind="stable")
    place = np.empty(len(sets), np.int64)
    place[by_size] = np.arange(len(sets))
    return by_size, n[by_size], place[row], column


def _windows(n: np.ndarray, least: float, rows: int) -> list[tuple[int, int, int]]:
    """(a, b, end): sets a to b have similar ones up to end only, but for those before a."""
    return [(s, min(s + rows, len(n)), int(np.searchsorted(n, n[min(s + rows, len(n)) - 1] / least + 1e-6, "right"))) for s in range(0, len(n), rows)]


def _near(n: np.ndarray, row: np.ndarray, column: np.ndarray, near: list[tuple[int, int, int]], least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of each window that may be similar.

    Each set has a string of bits, which say of a hash class whether it has an odd number of its hashes. Two sets differ in as many
    hashes as their strings do in bits, or more, so pairs whose strings differ too much are not similar."""
    bits = 1 << min(11, max(8, int(2 * n.mean()).bit_length()))
    odd = (np.bincount(row * bits + column % bits, minlength=len(n) * bits) & 1).astype(np.uint8).reshape(len(n), bits)
    odd = np.packbits(odd, axis=1).view(np.uint64).T.copy()
    for a, b, end in near:
        apart = np.zeros((b - a, end - a), np.uint16)
        for word in odd:
            apart += np.bitwise_count(word[a:b, None] ^ word[None, a:end])
        i, j = np.nonzero(apart <= (n[a:b, None] + n[None, a:end]) * ((1 - least) / (1 + least)) + 1e-3)
        yield i[i < j] + a, j[i < j] + a


def _linked(sets: list[np.ndarray], least: float, cell_limit: int = 1 << 23, rows: int = 64, dense: float = 1 / 16, first: int = 0) -> np.ndarray:
    """Which pairs of sets (repeats in them don't matter) have a Jaccard similarity of at least `least`. With first, only pairs of one of
    the first so many sets and another set are asked for.

    Sets are taken by size, `rows` at a time, and compared with those up to 1 / least times as large; others can't be so similar.
    What strings of bits leave is counted by bits, or, if it is over `dense` of all pairs, by products of 0/1 matrices."""
    by_size, n, row, column = _by_size(sets)
    near = _windows(n, least, rows)
    x, y = (np.concatenate(v) for v in zip(*_near(n, row, column, near, least), strict=True))
    if first:
        asked = (by_size[x] < first) != (by_size[y] < first)
        x, y = x[asked], y[asked]
    keep = (np.bincount(column) > 1)[column] if len(column) else np.zeros(0, bool)
    row, column = row[keep], column[keep]
    share = np.zeros(len(x), np.int64)
    if len(column) and len(x):
        column = np.cumsum(np.r_[True, column[1:] != column[:-1]]) - 1
        width = int(column[-1]) + 1
        full = len(x) > dense * len(sets) ** 2 / 2
        step = min(-(-width // 64) * 64, max(64, cell_limit // len(sets) // 64 * 64))
        inter = np.zeros((len(sets), len(sets)) if full else (0, 0), np.float32)
        for lo in range(0, width, step):
            s, t = np.searchsorted(column, (lo, lo + step))
            m = np.zeros((len(sets), step), np.float32 if full else np.uint8)
            m[row[s:t], column[s:t] - lo] = 1
            if full:
                for a, b, end in near:
                    inter[a:b, a:end] += m[a:b] @ m[a:end].T
            else:
                packed = np.packbits(m, axis=1).view(np.uint64)
                at_once = max(1, cell_limit // 8 // packed.shape[1])
                for k in range(0, len(x), at_once):
                    both = packed[x[k : k + at_once]] & packed[y[k : k + at_once]]
                    share[k : k + at_once] += np.bitwise_count(both).sum(axis=1, dtype=np.int64)
        if full:
            share = inter[x, y]
    found = share >= least * (n[x] + n[y] - share) - 1e-4
    ok = np.zeros((len(sets), len(sets)), bool)
    ok[by_size[x[found]], by_size[y[found]]] = True
    return ok | ok.T


#: A candidate group of up to so many members is compared by sorting, a larger one by strings of bits.
FEW = 16
#: Each member of a group is sent once for each of its blocks. A group has up to MANY blocks of `block` members; in larger groups
#: blocks hold up to LARGE members and about LARGE_BYTES bytes of shingles.
MANY, LARGE, LARGE_BYTES = 8, 4096, 4 << 20
#: Sets that are compared at once with as many others, in blocks of more.
CHUNK = 1024
#: Bytes that are dealt out at once, unless twice the members' own are more.
DEALT = 256 << 20
#: Shingles that are compared at once, but for a larger group.
AT_ONCE = 1 << 17


def unpacked(column: pa.BinaryArray) -> tuple[np.ndarray, np.ndarray]:
    """Shingles from bytes: 64-bit hashes of all sets, and how many each has."""
    return np.frombuffer(b"".join(column.to_pylist()), np.uint64), pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64) // 8


def _shared(hashes: np.ndarray, counts: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For rows with counts hashes each (repeats don't matter), in groups of at most FEW that begin at starts: row pairs (a, b) with a common
    hash, how many they share, and how many different hashes each row has."""
    n = len(counts)
    row = np.repeat(np.arange(n), counts)
    group = np.repeat(np.arange(len(starts), dtype=np.uint64), np.diff(np.r_[starts, n]))
    tagged = mix64(hashes ^ mix64(group + np.uint64(1))[row])
    low = np.uint64((1 << int(n).bit_length()) - 1)
    order = np.argsort((tagged & ~low) | row.astype(np.uint64))  # rows ascend where hashes are equal; an unstable sort is several times faster
    tagged, row = tagged[order], row[order]
    new = np.r_[True, tagged[1:] != tagged[:-1]] if len(row) else np.zeros(0, bool)
    first = new | np.r_[True, row[1:] != row[:-1]] if len(row) else new
    tagged, row, new = tagged[first], row[first], new[first]
    size = np.bincount(row, minlength=n)
    share = np.zeros(n * FEW, np.int64)
    for a, b in pair_indices(np.flatnonzero(new), len(row), at_once=AT_ONCE):
        share += np.bincount(row[a] * FEW + row[b] - row[a], minlength=n * FEW)
    pair = np.flatnonzero(share)
    return pair // FEW, pair // FEW + pair % FEW, share[pair], size


def _chunks(sets: list[np.ndarray], own: np.ndarray, crossed: bool, least: float, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places of sets to be compared with each other (None), or with those of other places, by size and chunk by chunk. Chunks whose sizes
    differ too much are left out; if crossed, so are those of equal own."""
    n = np.fromiter((len(np.unique(s)) for s in sets), np.int64, len(sets))
    sides = [np.flatnonzero(own == k) for k in np.unique(own)] if crossed else [np.arange(len(sets))]
    parts = [(k, s[lo : lo + chunk]) for k, s in enumerate(s[np.argsort(n[s], kind="stable")] for s in sides) for lo in range(0, len(s), chunk)]
    for p, (side, a) in enumerate(parts):
        for q in range(p, len(parts)):
            other, b = parts[q]
            if crossed and side == other or n[a[-1]] < least * n[b[0]] - 1e-6 or n[b[-1]] < least * n[a[0]] - 1e-6:
                continue
            yield a, b if p != q else None


def _linked_pairs(sets: list[np.ndarray], own: np.ndarray, crossed: bool, least: float, chunk: int = CHUNK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(a, b), each pair once, of sets with a Jaccard similarity of at least `least`; if crossed, only those of unequal own."""
    if len(sets) <= 2 * chunk:
        x, y = np.nonzero(np.triu(_linked(sets, least)))
        met = (own[x] != own[y]) | (not crossed)
        yield x[met], y[met]
        return
    for a, b in _chunks(sets, own, crossed, least, chunk):
        if b is None:
            x, y = np.nonzero(np.triu(_linked([sets[k] for k in a], least)))
            yield a[x], a[y]
        else:
            x, y = np.nonzero(_linked([sets[k] for k in (*a, *b)], least, first=len(a))[: len(a), len(a) :])
            yield a[x], b[y]


def _forest(sets: list[np.ndarray], least: float, known: np.ndarray, first: int = 0, rows: int = 64, at_once: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links among sets (none empty), as many as join what is linked; with first, of one of the first so many sets with another.

    As _linked, but sets that are joined already are not compared; known says which are from the start."""
    by_size, n, row, column = _by_size(sets)
    cols, at = column[np.argsort(row, kind="stable")], np.r_[0, np.cumsum(n)]
    root = np.unique(known[by_size], return_inverse=True)[1].astype(np.int64)
    near = _windows(n, least, rows)
    held = np.zeros((rows, int(column.max()) + 1), bool)
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for (a, b, _), (x, y) in zip(near, _near(n, row, column, near, least), strict=True):
        if first:
            asked = (by_size[x] < first) != (by_size[y] < first)
            x, y = x[asked], y[asked]
        apart = root[x] != root[y]
        x, y = x[apart], y[apart]
        own = np.repeat(np.arange(b - a), n[a:b]), cols[at[a] : at[b]]
        held[own] = True
        most = 1
        while len(x):
            # up to `most` pairs of each two components are compared, then those that aren't joined yet
            pair = root[x] * len(sets) + root[y]
            order = np.argsort(pair, kind="stable")
            new = np.flatnonzero(np.r_[True, np.diff(pair[order]) != 0])
            rank = np.arange(len(x)) - np.repeat(new, np.diff(np.r_[new, len(x)]))
            now, later = order[rank < most], order[rank >= most]
            now = now[: max(1, int(np.searchsorted(np.cumsum(n[y[now]]), at_once, "right")))] if len(now) else now
            later = np.setdiff1d(np.arange(len(x)), now) if len(now) + len(later) < len(x) else later
            i, j = x[now], y[now]
            starts = np.r_[0, np.cumsum(n[j])]
            place = np.arange(starts[-1]) + np.repeat(at[j] - starts[:-1], n[j])
            share = np.add.reduceat(held[np.repeat(i - a, n[j]), cols[place]], starts[:-1], dtype=np.int64)
            ok = share >= least * (n[i] + n[j] - share) - 1e-4
            found_a.append(by_size[i[ok]])
            found_b.append(by_size[j[ok]])
            node, to = star_edges(root[i[ok]], root[j[ok]])
            label = np.arange(len(sets))
            label[node] = to
            root = label[root]
            x, y = x[later], y[later]
            apart = root[x] != root[y]
            x, y, most = x[apart], y[apart], most * 4
        held[own] = False
    return np.concatenate(found_a), np.concatenate(found_b)


def _joined(sets: list[np.ndarray], own: np.ndarray, crossed: bool, least: float, chunk: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
    """(a, b): links as of _linked_pairs, as many as join what is linked."""
    known = np.arange(len(sets))
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for own_at, other_at in _chunks(sets, own, crossed, least, chunk):
        at = own_at if other_at is None else np.r_[own_at, other_at]
        if (known[at] == known[at[0]]).all():
            continue
        x, y = _forest([sets[k] for k in at], least, known[at], 0 if other_at is None else len(own_at))
        a.append(at[x])
        b.append(at[y])
        node, to = star_edges(known[at[x]], known[at[y]])
        label = np.arange(len(sets))
        label[node] = to
        known = label[known]
    return np.concatenate(a), np.concatenate(b)


def _blocks(members: DataFrame, block: int) -> DataFrame:
    """members with _n, the number of blocks of their group."""
    size = F.col("size")
    large = members.where(size > MANY * block).groupBy("root").agg(F.sum(F.octet_length("shingles")).alias("_bytes"))
    plain = F.ceil(size / block)
    n = F.least(plain, F.greatest(F.lit(MANY), F.ceil(size / LARGE), F.ceil(F.col("_bytes") / LARGE_BYTES)))
    # at most one in MANY * block members names a large group
    return members.join(F.broadcast(large), "root", "left").withColumn("_n", F.when(F.col("_bytes").isNull(), plain).otherwise(n).cast("int")).drop("_bytes")


def verified_links(members: DataFrame, least: float, sets_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]] = unpacked, block: int = 256, count: bool = True) -> DataFrame:
    """From rows (root, size, key, weight, shingles) of all candidate groups, root and size being a group's name and its number of members:
    (key, links, other).

    Rows with other join what each block pair's verified links join; links sums the weights of the keys that a key links with.
    sets_of makes shingles of the column shingles, in the task that compares them. Without count, links is of no use, and pairs that are
    joined by others needn't be compared.
    """
    group = ["root", "_i", "_j"]
    members = _blocks(cut(members.select("root", "size", "key", "weight", "shingles")), block)
    length = F.octet_length("shingles").cast("long") + 64
    held, sent = members.agg(F.coalesce(F.sum(length), F.lit(0)), F.coalesce(F.sum(length * F.col("_n")), F.lit(0))).first()
    shares = max(1, -(-sent // max(DEALT, 2 * held)))  # one after another, so that only one is on disk

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in whole_groups(batches, group, 1024):
            n = table.num_rows
            key, weight, own, i, j = (table.column(c).to_numpy() for c in ("key", "weight", "_own", "_i", "_j"))
            hashes, counts = sets_of(table.column("shingles").combine_chunks())
            at = np.r_[0, np.cumsum(counts)]
            ends = np.r_[starts[1:], n]
            links = np.zeros(n, np.int64)

            def link(x: np.ndarray, y: np.ndarray) -> None:
                np.add.at(links, x, weight[y])
                np.add.at(links, y, weight[x])
                node, root = star_edges(key[x], key[y])
                a.append(node)
                b.append(root)

            a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
            few = ends - starts <= FEW
            # runs of small groups that have about AT_ONCE shingles together
            run = np.cumsum(np.r_[True, (few[1:] != few[:-1]) | ~few[1:] | (at[ends[1:]] // AT_ONCE != at[ends[:-1]] // AT_ONCE)])
            for r in np.split(np.arange(len(starts)), np.flatnonzero(run[1:] != run[:-1]) + 1):
                lo, hi = starts[r[0]], ends[r[-1]]
                if few[r[0]]:
                    x, y, share, size = _shared(hashes[at[lo] : at[hi]], counts[lo:hi], starts[r] - lo)
                    ok = share >= least * (size[x] + size[y] - share) - 1e-9
                    x, y = x[ok] + lo, y[ok] + lo
                    met = (i[x] == j[x]) | (own[x] != own[y])
                    link(x[met], y[met])
                else:
                    of = [hashes[at[k] : at[k + 1]] for k in range(lo, hi)], own[lo:hi], i[lo] != j[lo], least
                    for x, y in _linked_pairs(*of) if count else [_joined(*of)]:
                        link(x + lo, y + lo)
            some = np.flatnonzero(links)
            a, b = star_edges(np.concatenate(a), np.concatenate(b))
            yield pa.RecordBatch.from_pydict({
                "key": pa.array(np.r_[key[some], a]),
                "links": pa.array(np.r_[links[some], np.zeros(len(a), np.int64)]),
                "other": pa.array(np.r_[np.zeros(len(some), np.int64), b], mask=np.r_[np.ones(len(some), bool), np.zeros(len(a), bool)]),
            })

    def share(k: int) -> DataFrame:
        dealt = deal_blocks(members, "key", "size", blocks=F.col("_n"), part=(k, shares)).select(*group, "_own", "key", "weight", "shingles")
        return cut(dealt.repartition(*group).sortWithinPartitions(*group).mapInArrow(verify, "key long, links long, other long"))

    return reduce(DataFrame.union, [share(k) for k in range(shares)])
