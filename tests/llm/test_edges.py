"""Each operator on nulls, empties, long texts, repeats, empty tables and clashing names, against plain re-implementations."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from statloom.llm import bpe, capfilters, htmltext, linededup, mixing, ngramjoin, packing, pii, topk, toxicity
from statloom.llm.common import pair_indices, star_edges
from tests.llm.edge import brute_join, brute_lines, documents

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    return documents(spark, str(tmp_path_factory.mktemp("d") / "docs"))


@pytest.fixture(scope="module")
def none(spark, tmp_path_factory):
    return documents(spark, str(tmp_path_factory.mktemp("d") / "none"), [])


def test_mixing(spark, docs, none):
    out = mixing.mix(docs).select("mx_row.source", *[f"mx_{x}" for x in ("size", "source_size", "target", "copies")], F.col("mx_row.doc_id").alias("doc_id")).toPandas()
    assert len(out) == 13 and out["mx_copies"].between(0, 2).all()
    for _, g in out.groupby("source", dropna=False):
        size, target, taken = g["mx_size"].sum(), g["mx_target"].iloc[0], (g["mx_size"] * g["mx_copies"]).sum()
        assert size == g["mx_source_size"].iloc[0] and target <= 2 * size and abs(taken - target) <= g["mx_size"].max()
    total = out.drop_duplicates("source")
    assert total["mx_target"].sum() == pytest.approx(1.5 * total["mx_source_size"].sum())
    assert out["mx_copies"].tolist() == [r.mx_copies for r in mixing.mix(docs).collect()]
    rep = mixing.repeat(mixing.mix(docs))
    assert rep.columns == docs.columns and rep.count() == out["mx_copies"].sum()
    assert mixing.mix(none).count() == 0
    assert mixing.quality_weights(spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1)], "doc_id long, quality int")).collect() == [(1, 1.25)]


def test_bpe(docs, none):
    for size, overlap in ((32_768, 512), (64, 16)):
        got = {(r.doc_id, r.decoded): r.ids for r in bpe.encode(docs, RANKS, PATTERN, chunk_chars=size, overlap=overlap).collect()}
        c = bpe.codec(RANKS, PATTERN)
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        assert set(got) == set(rows)
        for key in rows:
            assert got[key] == c.encode(key[1]).tolist()
    assert bpe.encode(none, RANKS, PATTERN).count() == 0


def test_packing(spark, docs, none, tmp_path):
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(JSON)
    packing.write(docs, f"{tmp_path}/s", JSON, PATTERN, shard_ids=5000, block_ids=64)
    got = sorted(packing.read_back(spark, f"{tmp_path}/s").collect(), key=lambda r: r.start)
    assert [r.doc_id for r in got] == sorted((r.doc_id for r in docs.collect()), key=lambda x: (x is not None, x))
    at = 0
    want = {}
    for r in docs.collect():
        want.setdefault(r.doc_id, []).append(tk.encode(r.text or "", add_special_tokens=False).ids + [0])
    for r in got:
        assert r.start == at and r.ids in want[r.doc_id] and r.n_tokens == len(r.ids)
        at += r.n_tokens
    packing.write(none, f"{tmp_path}/n", JSON, PATTERN)
    assert packing.read_back(spark, f"{tmp_path}/n").count() == 0
    assert packing.crc(np.array([1, 2], "<u4")) == {"ids_crc32": zlib.crc32(b"\1\0\0\0\2\0\0\0")}


@given(st.integers(1, 32), st.lists(st.integers(0, 2**32 - 1), max_size=300), st.integers(1, 50))
@settings(max_examples=60, deadline=None)
def test_shards(bits, ids, block):
    ids = np.array(ids, "<u8") % (1 << bits)
    ends = np.array(sorted({len(ids), len(ids) // 2}))
    s = packing.Shard(packing.pack_shard(ids.astype("<u4"), ends, bits, block))
    assert np.array_equal(s.ids(0, len(ids)), ids)
    assert np.array_equal(np.concatenate(list(s.documents())), ids)
    if len(ids) > 3:
        assert np.array_equal(s.ids(1, len(ids) - 1), ids[1:-1])


@given(st.text(alphabet=" ab1.'\n\té²<|end", max_size=40))
@settings(max_examples=150, deadline=None)
def test_spaced_encoder(text):
    e = packing.encoder(JSON, PATTERN)
    assert np.frombuffer(e.encode(text), "<u4").tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids


def test_line_dedup(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = brute_lines(rows)
    out = linededup.dedup_lines(docs)
    assert out.columns == docs.columns
    key = lambda x: (x[0] is None, x[0] or 0, x[1] or "")
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=key) == sorted(((rows[i][0], t) for i, t in want.items()), key=key)
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_fuzzy(spark, tmp_path):
    r = random.Random(4)
    base = ["".join(r.choice("abcdefgh ") for _ in range(r.randrange(3, 120))) for _ in range(60)]
    rows = []
    for i in range(80):
        lines = []
        for _ in range(r.randrange(1, 6)):
            b = list(r.choice(base))
            for _ in range(r.randrange(3)):
                b[r.randrange(len(b))] = r.choice("xyz")
            lines.append("".join(b))
        rows.append((i, "\n".join(lines), "en", "s", 1))
    d = documents(spark, f"{tmp_path}/f", rows)
    want = brute_lines([(x[0], x[1]) for x in rows])
    assert {x.doc_id: x.text for x in linededup.dedup_lines(d, recall=0.999999).collect()} == want


def test_ngram_join(docs, none):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    links, comp = brute_join(rows)
    got = ngramjoin.joined(docs).collect()
    ids = sorted(((r.id, r.n_links, r.component) for r in got), key=str)
    want = sorted(((rows[i][0], links[i], min((rows[j][0] for j in comp[i] if rows[j][0] is not None), default=None)) for i in range(len(rows))), key=str)
    assert ids == want
    assert sum(r.first for r in got) == len(set(comp.values()))
    kept = ngramjoin.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(comp.values()))
    assert ngramjoin.one_of_each(none).count() == 0


def test_wide_bands_are_complete(spark, tmp_path, monkeypatch):
    """A group of near copies too large for one task is split, and loses nothing."""
    import statloom.llm.minhash as m

    monkeypatch.setattr(m, "WIDE", 8)
    words = [f"w{i}" for i in range(200)]
    r = random.Random(1)
    rows = []
    for i in range(40):
        w = list(words)
        w[r.randrange(200)] = f"x{i}"
        rows.append((i, " ".join(w), "en", "s", 1))
    d = documents(spark, f"{tmp_path}/w", rows)
    links, _ = brute_join([(x[0], x[1]) for x in rows])
    assert {x.id: x.n_links for x in ngramjoin.joined(d).collect()} == links


def test_pii(docs, none):
    out = pii.extract(docs)
    assert out.count() == 13 and out.where(F.size("base") > 0).count() == 0
    assert pii.extract(none).count() == 0


def test_html():
    text = lambda h, gone=frozenset(): htmltext.Page(h).text(set(gone))
    assert text("") == "" and text("<p>a<p>b <b>c</b>d<br>e") == "a b cd e"
    assert text("<nav>x</nav><article><h1>T</h1><p>1 &amp; 2</p><section class=comments>no</section></article><aside>z</aside>") == "T 1 & 2"
    assert text("<a href='x>y'>k</a> 1 < 2 <b") == "k 1 < 2 <b"
    page = htmltext.Page("<div>template</div><p>own</p>")
    assert text("<div>template</div><p>own</p>", [h for h, t in zip(page.hashes(), page.tag, strict=True) if t == "div"]) == "own"


def test_site_templates(spark, tmp_path):
    rows = [(i, f"http://h{i % 2}.example/p{i}", f"<div><p>Site {i % 2}</p><span>motto</span></div><p>text number {i}</p>") for i in range(20)] + [(20, None, None), (21, "http://h0.example/", ""), (21, "http://h0.example/", "")]
    spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'c' as row", "'c' as host", "'c' as gone").write.parquet(f"{tmp_path}/p")
    got = {r.page_id: r.text for r in htmltext.main_text(spark.read.parquet(f"{tmp_path}/p")).collect()}
    assert got == {i: f"text number {i}" for i in range(20)} | {20: "", 21: ""}
    assert htmltext.main_text(spark.read.parquet(f"{tmp_path}/p").limit(0)).count() == 0


def test_top_k(spark):
    r = np.random.default_rng(2)
    x = r.integers(-20, 20, (300, 6))
    x[7] = x[8] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(400, None), (401, [1, 2]), (402, []), (None, [1] * 6)]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    full = {i: np.r_[v, np.zeros(6 - len(v), int)] for i, v in rows if v is not None and i is not None}
    got = {(g.query_id, g.rank): (g.vec_id, g.score) for g in topk.top_k(df, df.where("vec_id % 10 = 0"), k=4, head=16, part_bytes=2000).collect()}
    for q in [i for i in full if i % 10 == 0]:
        best = sorted(((-int(full[q] @ v), i) for i, v in full.items() if i != q))[:4]
        assert [got[q, k + 1] for k in range(4)] == [(i, -s) for s, i in best]
    assert topk.top_k(df.limit(0), df.limit(0)).count() == 0
    big = [(1, [10**10, 1]), (2, [2**63 - 1, -(2**63)]), (3, [-(2**63), 3]), (4, [3 * 10**9, 3 * 10**9]), (5, [0, 0]), (6, [10**10, 1]), (6, [10**10, 1])]
    got = {(g.query_id, g.rank): (g.vec_id, g.score) for g in topk.top_k(spark.createDataFrame(big, "vec_id long, v array<long>"), spark.createDataFrame(big, "vec_id long, v array<long>"), k=9).collect()}
    held = lambda a, b: max(-(2**63), min(2**63 - 1, sum(p * q for p, q in zip(a, b, strict=True))))
    for q, a in big:
        best = sorted((-held(a, v), i) for i, v in big if i != q)
        assert [got.get((q, n + 1)) for n in range(len(best) + 1)] == [*((i, -s) for s, i in best), None]
    bad = spark.createDataFrame([(1, [1.0, float("nan")]), (2, [None, 1.0]), (3, None), (4, [1.0]), (5, [float("inf")])], "i int, v array<double>")
    assert [b.i for b in bad.where(topk.usable(F.col("v"))).collect()] == [4]


def test_cap_filters(spark):
    r = np.random.default_rng(5)
    base = r.normal(size=(40, 64))
    v = np.concatenate([base + r.normal(size=base.shape) * 0.25, base, r.normal(size=(200, 64))]).astype("float32")
    rows = [(i, [float(y) for y in x], i % 2) for i, x in enumerate(v)]
    rows += [(900, rows[0][1], 0), (901, rows[0][1], 0), (902, None, 0), (903, [0.0] * 64, 0), (904, rows[0][1], None), (905, [1.0, None], 0), (906, [1.0, 2.0], 0), (907, [2.0, 4.0], 0), (None, rows[0][1], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").selectExpr("*", "1 as key", "2 as size")
    good = {i: (np.array(x, float), b) for i, x, b in rows if i is not None and x is not None and b is not None and None not in x and any(x)}
    links = {i: {j for j, (y, c) in good.items() if i != j and b == c and len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93} for i, (x, b) in good.items()}
    got = {r.vec_id: r for r in capfilters.near_vectors(df).collect()}
    for i, _, _ in rows:
        if i is None:
            continue
        seen, stack = set(), [i]
        while stack:
            j = stack.pop()
            if j not in seen:
                seen.add(j)
                stack += links.get(j, ())
        assert (got[i].n_links, got[i].component_id, got[i].kept) == (len(links.get(i, ())), min(seen), min(seen) == i)
    assert capfilters.near_vectors(df.limit(0)).count() == 0


def test_toxicity(spark, docs, none):
    lex = toxicity.Lexicon(["idiot", "scu*", "moron"], [(5.0, 3.0), (4.0, 2.0), (5.0, 1.0)])
    assert lex.match("idiot") == ((0, 0),) and lex.match("idi0t") == ((0, 1),) and lex.match("idioot") == ((0, 1),) and lex.match("diot") == ((0, 1),) and lex.match("iddiott") == ()
    assert lex.match("scumbag") == ((1, 0),) and lex.match("stum") == () and lex.match("") == ()
    assert lex.evidence("you idiot")[0] > 0 and lex.evidence('he said "idiot" to me')[2] > 0 and lex.evidence(None) == (0.0, 0.0, 0.0)
    m = toxicity.fit(none, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.tx_score for r in toxicity.score(docs, m).collect()] == pytest.approx([0.0] * 13, abs=1e-12)
    assert toxicity.score(none, m).count() == 0
    rows = [(i, f"text number {i} of words " + ("you are an idiot and a moron" if i % 4 == 0 else "you are a fine friend"), i) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string, n int")
    learned = toxicity.fit(d, spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(150)] + [(None, 1), (3, None)], "doc_id long, toxic int"))
    got = {r.doc_id: r for r in toxicity.score(d, learned).collect()}
    assert all((got[i].tx_score >= 0.5) == (i % 4 == 0) for i in range(200))
    assert {x.term for x in got[0].tx_matches} <= set(learned.lexicon.terms) and got[0].tx_matches


def brute_edits(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


@given(st.lists(st.text(alphabet="abc", min_size=5, max_size=7), min_size=1, max_size=5, unique=True), st.text(alphabet="abcd", max_size=8))
@settings(max_examples=200, deadline=None)
def test_automaton(terms, word):
    want = tuple((i, d) for i, t in enumerate(terms) if (d := brute_edits(t, word)) <= 1)
    assert toxicity.Lexicon(terms).match(word) == want


def test_pairs_and_forest():
    starts, n = np.array([0, 3, 4]), 8
    got = {(int(x), int(y)) for a, b in pair_indices(starts, n, at_once=2) for x, y in zip(a, b, strict=True)}
    assert got == {(0, 1), (0, 2), (1, 2), (4, 5), (4, 6), (4, 7), (5, 6), (5, 7), (6, 7)}
    node, root = star_edges(np.array([3, 2, 9, -4, 7]), np.array([1, 3, 8, 9, 7]))
    assert dict(zip(node.tolist(), root.tolist(), strict=True)) == {2: 1, 3: 1, 8: -4, 9: -4}
    r = np.random.default_rng(0)
    path = r.permutation(2000)
    node, root = star_edges(path[1:], path[:-1])
    assert sorted(node.tolist()) == list(range(1, 2000)) and not root.any()


def test_digest():
    from statloom.llm.q_bpe import digest

    assert digest(np.array([1], "<u4"), b"x")["ids_sha256"] == hashlib.sha256(b"\1\0\0\0").hexdigest()


def test_top_k_query_of_large_components(spark, tmp_path):
    """floor(256 * x) of components beyond a long is held at its ends, and so are scores."""
    from statloom.llm.q_topk import op6_topk

    rows = [(0, [1e10, 1.0]), (50, [1e300, -1e300]), (7, [0.5, -0.5]), (8, [None, 1.0]), (9, [float("nan"), 1.0]), (10, None), (None, [1.0, 1.0]), (11, [-1e10, 0.0])]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in op6_topk(spark, str(tmp_path)).orderBy("query_id", "rank").collect()]
    top = 2**63 - 1
    assert got == [(0, 1, 50, top), (0, 2, 7, 2560000000000 * 128 - 256 * 128), (0, 3, 11, -(2560000000000**2) if 2560000000000**2 <= top else -top - 1), (50, 1, 0, top), (50, 2, 7, top), (50, 3, 11, -top - 1)]
