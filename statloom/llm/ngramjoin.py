"""N-gram Jaccard join of documents by MinHash banding.

A document is the set of its n-grams of words (runs of characters other than [\\x20\\x09-\\x0D], lower-cased); one with fewer
words has its words as its only n-gram. Documents with equal sets are one class. Classes meet in bands; candidates are
verified on full n-gram sets. Band and row counts follow from the target recall at the threshold.

Defined results: a text that is null or has no word links with nothing, not even another such text; null ids take part and
count as links, but no component is named after one unless it has no other id; rows of equal id are rows of their own; an
empty table gives an empty result; other columns play no part. Sets are compared by 64-bit hashes of their n-grams.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from statloom.llm.common import connected_components, cut, join_hot
from statloom.llm.minhash import Signer, bands_for, bloom_of, candidate_groups, maybe_in, mix64, sized, slices, verified_links

WORDS, LEAST, ROWS, RECALL = 5, 0.8, 5, 0.9995


class WordHashes(dict):
    """64-bit hashes of words; forgets all when it holds very many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(texts: list[str | None], words: int, known: WordHashes) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all texts, one after another, and how many each text has."""
    own = [t.lower().encode().split() if t else [] for t in texts]
    n = np.array([len(w) for w in own], np.int64)
    flat = np.fromiter(map(known.__getitem__, (w for ws in own for w in ws)), np.uint64, int(n.sum()))
    odd = np.random.default_rng(7).integers(0, 1 << 63, words, dtype=np.uint64) | np.uint64(1)
    padded = np.r_[flat, np.zeros(words, np.uint64)]
    rolled = np.zeros(len(flat), np.uint64)
    for k in range(words):
        rolled += mix64(padded[k : k + len(flat)]) * odd[k]
    ends = np.cumsum(n)
    left = np.repeat(ends, n) - np.arange(len(flat))
    whole = left >= words
    few = np.flatnonzero((n > 0) & (n < words))
    for t in few:  # fewer words than an n-gram has: all of them
        at, h = ends[t] - n[t], np.uint64(n[t])
        for k in range(n[t]):
            h = mix64(h + flat[at + k : at + k + 1] * odd[k])[0]
        rolled[at], whole[at] = h, True
    return mix64(rolled[whole]), np.where(n >= words, n - words + 1, (n > 0).astype(np.int64))


def _distinct(hashes: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    return [np.unique(x) for x in np.split(hashes, np.cumsum(counts)[:-1])] if len(counts) else []


def _keys(sets: list[np.ndarray]) -> np.ndarray:
    return np.array([xxhash.xxh3_64_intdigest(s.tobytes()) for s in sets], np.uint64).view(np.int64)


def _by_texts(b: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[tuple[int, int, list]]:
    """Runs of rows whose texts have about so many characters together."""
    texts = b.column("text").to_pylist()
    lo, held = 0, 0
    for i, t in enumerate(texts):
        held += len(t or "")
        if held >= chars or i + 1 == len(texts):
            yield lo, i + 1, texts[lo : i + 1]
            lo, held = i + 1, 0


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: float = LEAST, rows: int = ROWS, recall: float = RECALL) -> DataFrame:
    """row, id, component (its smallest id), n_links (other rows at a similarity of at least `least`), first (whether the row
    stays when one of each component does). row is monotonically_increasing_id() of docs, which must be a table or a result that
    is read back, so that its rows come in the same order twice."""
    spark = docs.sparkSession
    bands = bands_for(least, rows, recall)
    n_slices = 8 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    plain = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, known = Signer(bands, rows), WordHashes()
        for b in batches:
            for lo, hi, texts in _by_texts(b):
                hashes, counts = shingles(texts, words, known)
                sets = _distinct(hashes, counts)
                some = np.array([i for i, s in enumerate(sets) if len(s)], np.int64)
                keys, entries = np.zeros(0, np.int64), np.zeros((0, bands), np.int64)
                if len(some):
                    own = [sets[i] for i in some]
                    keys = _keys(own)
                    starts = np.r_[0, np.cumsum([len(s) for s in own])[:-1]]
                    entries = signer.entries(keys, signer.signatures((np.concatenate(own) >> np.uint64(16)).astype(np.uint32), starts))
                key, packed = [None] * len(texts), [None] * len(texts)
                for i, k, e in zip(some, keys.tolist(), entries, strict=True):
                    key[i], packed[i] = k, e.tobytes()
                yield pa.RecordBatch.from_pydict({"row": b.column("row").slice(lo, hi - lo), "id": b.column("id").slice(lo, hi - lo), "key": pa.array(key, pa.int64()), "entries": pa.array(packed, pa.binary())})

    signed = cut(plain.mapInArrow(sign, "row long, id long, key long, entries binary"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from statloom.llm.minhash import ENTRY

        for b in batches:
            _, first = np.unique(b.column("key").to_numpy(), return_index=True)
            got = list(slices(np.frombuffer(b"".join(b.column("entries").take(pa.array(first)).to_pylist()), ENTRY), n_slices))
            yield pa.RecordBatch.from_pydict({"slice": pa.array([s for s, _ in got], pa.int32()), "payload": pa.array([p for _, p in got], pa.binary())})

    groups = candidate_groups([signed.where("key is not null").select("key", "entries").mapInArrow(pack, "slice int, payload binary")], least)
    groups = cut(groups)
    n_rows = signed.count()
    classes = signed.where("key is not null").groupBy("key").agg(F.count("*").alias("weight"), F.min("id").alias("least_id"), F.min("row").alias("first_row"))
    classes = cut(classes.join(sized(groups).withColumnRenamed("node", "key"), "key", "left"))
    # a class's n-grams are made again from its first row; other texts aren't
    shared = spark.sparkContext.broadcast(bloom_of(classes.where("root is not null"), "first_row"))

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bloom = WordHashes(), shared.value
        for b in batches:
            for _, _, texts in _by_texts(b.filter(pa.array(maybe_in(bloom, b.column("row").to_numpy())))):
                sets = [s for s in _distinct(*shingles(texts, words, known)) if len(s)]
                yield pa.RecordBatch.from_pydict({"key": pa.array(_keys(sets), pa.int64()), "shingles": pa.array([s.tobytes() for s in sets], pa.binary())})

    full = plain.select("row", "text").mapInArrow(fetch, "key long, shingles binary").dropDuplicates(["key"])
    members = full.join(classes.where("root is not null").select("key", "weight", "root", "size"), "key")
    links = verified_links(members, least)
    counted = links.where("links > 0").groupBy("key").agg(F.sum("links").alias("links"))
    roots = connected_components(links.where("other is not null"), "key", "other")
    kin = classes.drop("root", "size", "first_row").join(counted, "key", "left").join(roots.withColumnRenamed("node", "key"), "key", "left")
    kin = cut(kin.select("key", F.coalesce("root", "key").alias("root"), "least_id", "weight", (F.col("weight") - 1 + F.coalesce("links", F.lit(0))).alias("links")))
    named = kin.groupBy("root").agg(F.min("least_id").alias("component"), F.count("*").alias("classes"))
    kin = join_hot(kin, named, "root", "classes", n_rows)
    out = join_hot(signed.select("row", "id", "key"), kin.select("key", "root", "weight", "links", "component"), "key", "weight", n_rows)
    out = cut(out.select("row", "id", "root", "links", "component"))
    firsts = out.groupBy("root").agg(F.min(F.struct(F.col("id").isNull(), F.col("id"), F.col("row")))["row"].alias("first_row"), F.count("*").alias("rows"))
    out = join_hot(out, firsts, "root", "rows", n_rows).select("row", "id", F.coalesce("component", "id").alias("component"), "links", (F.col("first_row") == F.col("row")).alias("first"))
    alone = signed.where("key is null").select("row", "id", F.col("id").alias("component"), F.lit(0).alias("links"), F.lit(True).alias("first"))
    return out.union(alone).select("row", "id", "component", F.col("links").cast("long").alias("n_links"), "first")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without the rows of a component that come after its first (smallest id, then row). docs must be a table or a
    result that is read back, so that its rows come in the same order twice."""
    gone = joined(docs, **options).where("not first").select(F.col("row").alias("_gone"))
    rows = docs.select(F.struct(*docs.columns).alias("_doc"), F.monotonically_increasing_id().alias("_row"))
    return rows.join(gone, F.col("_row") == F.col("_gone"), "left_anti").select("_doc.*")
