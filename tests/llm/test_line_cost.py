"""What verification and meeting of lines cost, with results as by definition."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql.classic.dataframe import DataFrame

from statloom.llm import ngramjoin
from statloom.llm.linededup import _places, python_keys
from statloom.llm.minhash import ENTRY, Signer, _linked, _shared, bloom_of, candidate_edges, maybe_in, slices


def _similar(a, b):
    both = len(np.intersect1d(a, b))
    return both >= 0.8 * (len(np.union1d(a, b))) - 1e-9


@pytest.mark.parametrize("seed", range(6))
def test_sets_by_size(seed):
    """Sets of very different sizes, a few at a time."""
    r = np.random.default_rng(seed)
    base = [np.unique(r.integers(0, 1 << 63, int(k), dtype=np.uint64)) for k in r.integers(1, 90, 8)]
    sets = [np.unique(np.r_[b[r.random(len(b)) < 0.95], r.integers(0, 1 << 63, int(r.integers(1, 6)), dtype=np.uint64)]) for b in (base[k] for k in r.integers(0, 8, 60))]
    want = np.array([[i != j and _similar(a, b) for j, b in enumerate(sets)] for i, a in enumerate(sets)])
    for rows, cells in ((1, 1 << 23), (7, 600), (64, 1 << 23)):
        assert (_linked(sets, 0.8, cells, rows=rows) == want).all()


def test_shared_counts_repeats_once():
    """Hashes that differ in their low bits only are different; a repeat within a row counts once, however far apart."""
    rows = [[8, 9, 8, 10, 8], [9, 8, 11], [12, 13], [8, 12, 12, 13]]
    a, b, share, size = _shared(np.array(sum(rows, []), np.uint64), np.array([len(x) for x in rows]), np.array([0, 2]))
    assert {(int(x), int(y)): int(s) for x, y, s in zip(a, b, share, strict=True)} == {(0, 1): 2, (2, 3): 2} and size.tolist() == [3, 3, 2, 3]


def test_places():
    made = pa.RecordBatch.from_pydict({"ld_row": [5, 6, 7], "id": [1, None, 3], "text": ["a\n \n\tb ", None, "\nb"]})
    got = [tuple(r.values()) for out in _places([made]) for r in out.to_pylist()]
    a, b = python_keys(["a", "b"]).tolist()
    assert got == [(5, 1, 0, a), (5, 1, 2, b), (7, 3, 1, b)]


def test_edges_come_in_fewer_parts(spark):
    """Candidate edges of 64 parts of entries are contracted in fewer tasks."""
    keys = np.arange(200, dtype=np.int64)
    sig = np.repeat(np.random.default_rng(1).integers(0, 1 << 32, (4, 5, 100), dtype=np.uint64).astype(np.uint32), 2, axis=2)
    entries = Signer(4, 5).entries(keys, sig)
    assert entries.dtype == ENTRY
    before = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        edges = candidate_edges(spark.createDataFrame([(s, p) for s, p in slices(entries, 512)], "slice int, payload binary"), 0.8)
        assert edges.rdd.getNumPartitions() <= 64 + 8  # those of the wide bands, and an eighth
        assert {(max(r), min(r)) for r in edges.collect()} == {(2 * k + 1, 2 * k) for k in range(100)}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_ngrams_are_made_again_for_candidates_only(spark, tmp_path, monkeypatch):
    """The second reading makes n-grams of the first row of each class that has a candidate, and of no other text."""
    words = [f"w{i}" for i in range(4000)]
    texts = [" ".join(words[40 * k : 40 * k + 40]) for k in range(90)]
    rows = [(i, t) for i, t in enumerate([*texts, texts[0] + " more", texts[0] + " more", None, ""])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    made = spark.sparkContext.accumulator(0)
    own = ngramjoin.shingles

    def counted(texts, n, known):
        made.add(len(texts))
        return own(texts, n, known)

    monkeypatch.setattr(ngramjoin, "shingles", counted)
    cloudpickle.register_pickle_by_value(ngramjoin)
    try:
        got = {r.id: (r.component, r.n_links) for r in ngramjoin.joined(spark.read.parquet(f"{tmp_path}/d")).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(ngramjoin)
    assert {k: v for k, v in got.items() if v[1]} == {0: (0, 2), 90: (0, 2), 91: (0, 2)} and len(got) == len(rows)
    assert len(rows) + 2 <= made.value <= len(rows) + 4


def test_one_filter_reaches_the_driver(spark, monkeypatch):
    """Filters of many parts are joined by tasks, whatever the number of parts."""
    got = []
    own = DataFrame.toLocalIterator
    monkeypatch.setattr(DataFrame, "toLocalIterator", lambda self, *a, **b: (got.append(r) or r for r in own(self, *a, **b)))
    bloom = bloom_of(spark.range(0, 1000, 1, 16).toDF("k"), "k", 1 << 20)
    assert maybe_in(bloom, np.arange(1000)).all() and maybe_in(bloom, np.arange(1000, 3000)).sum() < 20
    assert len(got) == 1
