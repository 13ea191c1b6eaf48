"""Recall of MinHash bands on sets of a few shingles, at the parameters of the registered queries."""

import random

import numpy as np
import pytest

from statloom.llm import linededup, ngramjoin
from statloom.llm.minhash import Signer, _agree, agreeing, bands_for
from tests.llm.edge import brute_join, brute_lines, documents


def met(shared, one, two, rows, recall, n=4000):
    """The share of n pairs of sets, with shared members and some of their own, that are candidates."""
    signer, at = Signer(bands_for(0.8, rows, recall), rows), np.arange(n)
    hashes = np.random.default_rng(1).integers(0, 1 << 32, (n, shared + one + two), dtype=np.uint64).astype(np.uint32)
    a = signer.entries(at, signer.signatures(hashes[:, : shared + one].ravel(), at * (shared + one)))
    b = signer.entries(at, signer.signatures(np.delete(hashes, range(shared, shared + one), 1).ravel(), at * (shared + two)))
    return ((a["band"] == b["band"]).any(axis=1) & (_agree(a["sketch"][:, 0], b["sketch"][:, 0]) >= agreeing(0.8))).mean()


@pytest.mark.parametrize("parts", [(4, 1, 0), (5, 1, 0), (8, 1, 1), (20, 2, 2), (40, 5, 5), (200, 25, 25)])
def test_recall_by_size(parts):
    assert met(*parts, ngramjoin.ROWS, ngramjoin.RECALL) >= 0.9985


def test_short_documents_join(spark, tmp_path):
    """Texts of 9 words, and the same without the last one: 5 and 4 n-grams."""
    r, rows = random.Random(3), []
    for i in range(150):
        words = [f"w{r.randrange(10**6)}" for _ in range(9)]
        rows += [(2 * i, " ".join(words), "en", "s", 1), (2 * i + 1, " ".join(words[:8]), "en", "s", 1)]
    links, _ = brute_join([(x[0], x[1]) for x in rows])
    assert set(links.values()) == {1}
    assert {x.id: x.n_links for x in ngramjoin.joined(documents(spark, f"{tmp_path}/d", rows)).collect()} == links


@pytest.mark.parametrize("parts", [(4, 1, 0), (8, 1, 1), (12, 3, 0), (16, 2, 2), (20, 5, 0)])
def test_recall_of_lines(parts):
    assert met(*parts, linededup.ROWS, linededup.RECALL) >= 0.999


def test_short_lines_at_the_default(spark, tmp_path):
    """Lines of 9 characters, and the same without the last one: 5 and 4 shingles. Longer ones with an edit."""
    r, rows = random.Random(5), []
    for i in range(150):
        line = "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9 if i % 2 else 60))
        near = line[:8] if i % 2 else line[:30] + "0" + line[31:]
        rows.append((i, f"{line}\n{near}", "en", "s", 1))
    want = brute_lines([(x[0], x[1]) for x in rows])
    assert sum("\n" not in t for t in want.values()) == 150
    assert {x.doc_id: x.text for x in linededup.dedup_lines(documents(spark, f"{tmp_path}/d", rows)).collect()} == want
