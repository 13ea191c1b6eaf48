"""What verification of large candidate groups moves, with the links of a brute-force comparison."""

import collections

import numpy as np
import pytest
from pyspark.sql import functions as F

from statloom.llm import minhash
from statloom.llm.minhash import _blocks, _forest, _joined, _linked_pairs, verified_links


def _sets(n: int, seed: int = 3) -> list[np.ndarray]:
    r = np.random.default_rng(seed)
    base = [r.integers(0, 1 << 63, int(k), dtype=np.uint64) for k in (5, 12, 14, 40, 45)]
    return [np.r_[b[r.random(len(b)) < r.choice([0.8, 0.95, 1.0])], r.integers(0, 1 << 63, int(r.integers(1, 3)), dtype=np.uint64)] for b in (base[k] for k in r.integers(0, len(base), n))]


def _links(sets: list[np.ndarray]) -> set[tuple[int, int]]:
    alone = [set(s.tolist()) for s in sets]
    return {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if len(alone[i] & alone[j]) >= 0.8 * len(alone[i] | alone[j]) - 1e-9}


@pytest.mark.parametrize("chunk", [1, 7, 40, 1024])
def test_pairs_by_chunks(chunk):
    """Each link once, whatever the chunks; between two blocks, links within one of them are left out."""
    sets, own = _sets(120), np.arange(120) % 3 % 2
    want = _links(sets)
    for crossed in (False, True):
        got = [(min(p), max(p)) for a, b in _linked_pairs(sets, own, crossed, 0.8, chunk) for p in zip(a.tolist(), b.tolist(), strict=True)]
        assert len(got) == len(set(got)) and set(got) == {(i, j) for i, j in want if not crossed or own[i] != own[j]}


def _components(n: int, links) -> list[int]:
    up = list(range(n))
    for i, j in links:
        x, y = max(up[i], up[j]), min(up[i], up[j])
        up = [y if u == x else u for u in up]
    return up


@pytest.mark.parametrize("chunk", [1, 7, 40, 1024])
@pytest.mark.parametrize("seed", [3, 4])
def test_components_by_chunks(chunk, seed):
    """Links that join what is linked, and no others; few, as joined sets are not compared."""
    sets, own = _sets(120, seed), np.arange(120) % 3 % 2
    want = _links(sets)
    for crossed in (False, True):
        asked = {(i, j) for i, j in want if not crossed or own[i] != own[j]}
        got = [(min(p), max(p)) for p in zip(*(v.tolist() for v in _joined(sets, own, crossed, 0.8, chunk)), strict=True)]
        assert set(got) <= asked and _components(120, got) == _components(120, asked)
    for rows, at_once in ((5, 1 << 22), (64, 1), (64, 200)):
        got = zip(*(v.tolist() for v in _forest(sets, 0.8, np.arange(120), rows=rows, at_once=at_once)), strict=True)
        assert _components(120, got) == _components(120, want)


def _members(spark, sets: list[np.ndarray]):
    rows = [(7, len(sets), k, k % 4 + 1, bytearray(s.tobytes())) for k, s in enumerate(sets)]
    return spark.createDataFrame(rows, "root long, size long, key long, weight long, shingles binary")


@pytest.mark.parametrize("shares", [1, 4])
def test_links_of_a_large_group(spark, monkeypatch, shares):
    """In blocks, chunks and shares, each link counts once on both sides."""
    sets = _sets(150)
    monkeypatch.setattr(minhash, "CHUNK", 8)
    members = _members(spark, sets)
    if shares > 1:  # 8 blocks send 8 times the members' bytes
        monkeypatch.setattr(minhash, "DEALT", 1)
    out = verified_links(members, 0.8, block=10)
    want = collections.Counter()
    for i, j in _links(sets):
        want[i] += j % 4 + 1
        want[j] += i % 4 + 1
    got = {r.key: r.n for r in out.where("links > 0").groupBy("key").agg(F.sum("links").alias("n")).collect()}
    assert got == dict(want)
    want = _components(len(sets), _links(sets))
    for made in (out, verified_links(members, 0.8, block=10, count=False)):
        assert _components(len(sets), [(r.key, r.other) for r in made.where("other is not null").collect()]) == want


def test_a_large_group_is_not_sent_by_its_size(spark):
    """Members go to as many blocks as their group fills with LARGE members or LARGE_BYTES bytes, not to one for each 256 members."""
    made = spark.range(3).selectExpr("id as root", "id as key", "int(array(2000, 60000, 5000000)[int(id)]) as size", "'x' as shingles")
    assert [r._n for r in _blocks(made, 256).orderBy("root").collect()] == [8, 15, 1221]
