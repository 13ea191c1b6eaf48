"""The pipeline and the corpus queries against plain versions and SQL."""

import collections
import hashlib

import duckdb
import numpy as np
import pandas as pd
import public_tokenizers
import pytest

import corpus_pipeline
from statloom.llm.bpe import codec
from statloom.llm.queries import QUERIES, SQL
from tests.llm.edge import brute_join, brute_lines


@pytest.fixture(scope="module")
def small(spark, sf, tmp_path_factory):
    """60 documents with their labels."""
    at = tmp_path_factory.mktemp("p")
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").limit(60)
    docs.coalesce(1).write.parquet(f"{at}/documents.parquet")
    spark.read.parquet(f"{sf}/labels.parquet").write.parquet(f"{at}/labels.parquet")
    return str(at)


def test_stages(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = [(r.doc_id, r.text, r.source) for r in docs.collect()]
        stage(spark, docs, small).write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        rows[name] = docs.collect()
        if name != "bpe":
            assert docs.columns == corpus_pipeline.COLUMNS
        got = [(r.doc_id, r.text) for r in rows[name]] if name != "bpe" else []
        if name == "toxicity":
            assert {d for d, _ in got} <= {d for d, _, _ in before} and len(got) >= 0.7 * len(before)
        if name == "line dedup":
            want = brute_lines([(d, t) for d, t, _ in before])
            assert dict(got) == {before[i][0]: t for i, t in want.items() if t.strip() or not before[i][1].strip()}
        if name == "n-gram join":
            _, comp = brute_join([(d, t) for d, t, _ in before])
            assert {d for d, _ in got} == {min(before[i][0] for i in c) for c in comp.values()}
        if name == "mixing":
            words = lambda t: len((t or "").split())
            size = collections.Counter()
            for _, t, s in before:
                size[s] += words(t)
            taken = collections.Counter()
            for r in rows[name]:
                taken[r.source] += words(r.text)
            most = {s: max(words(t) for _, t, x in before if x == s) for s in size}
            assert all(taken[s] <= 2 * size[s] + most[s] for s in size)
            assert abs(sum(taken.values()) - 1.5 * sum(size.values())) <= sum(most.values())
            mixed = got
    c = codec(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    want = collections.Counter((d, hashlib.sha256(c.encode(t or "").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in mixed)
    assert collections.Counter((r.doc_id, r.ids_sha256, r.decoded_sha256) for r in rows["bpe"]) == want
    assert all(len(np.frombuffer(r.ids, "<u4")) == r.n_tokens for r in rows["bpe"])


def test_run(spark, small):
    assert corpus_pipeline.run(spark, small).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_sql(spark, sf, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "labels"):
        con.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    a, b = QUERIES[name](spark, sf).toPandas(), con.execute(SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    norm = lambda d: d[cols].sort_values(cols).reset_index(drop=True)
    pd.testing.assert_frame_equal(norm(a), norm(b), check_dtype=False)


def test_pii_against_python(spark, sf):
    import re

    patterns = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
    luhn = lambda d: sum(sum(divmod(int(c) * 2, 10)) if i % 2 else int(c) for i, c in enumerate(d[::-1])) % 10 == 0

    def base(t):
        out = []
        for k, p in patterns.items():
            for m in re.finditer(p, t):
                d = re.sub("[^0-9]", "", m[0])
                if k == "ip" and max(map(int, m[0].split("."))) > 255 or k == "card" and not (13 <= len(d) <= 19 and luhn(d)) or k == "phone" and not 9 <= len(d) <= 15:
                    continue
                out.append(f"{k}:{m.start()}:{m.end()}")
        return out

    text = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in QUERIES["op4_pii"](spark, sf).collect():
        want = base(text[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [x for x in r.spans.split(",") if x and not x.startswith("other")] == want
        assert r.n_email == sum(x.startswith("email") for x in want)


def test_context_finds_unseen_identifiers(spark, tmp_path):
    from statloom.llm.pii import extract

    rows = [(i, f"call tel: +1 (202) 555-01{i:02d} now") for i in range(20)] + [(100 + i, f"my tel: 555-01{i:02d}-77 thanks") for i in range(3)] + [(200 + i, f"the +1 202 555 01{i:02d} and the 10.0.0.{i} and the x12345{i}") for i in range(9)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/c")
    found = {r.doc_id: [(x.s, x.e) for x in r.found] for r in extract(spark.read.parquet(f"{tmp_path}/c")).collect()}
    assert found[100] == [(8, 19)] and not found[0] and not found[200]


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op7_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").toPandas()
    assert ((got["score"] >= 0.5) == (got["toxic"] == 1)).mean() > 0.97
    assert got.loc[got["predicted"] == 1, "toxic"].mean() > 0.9


def test_html_of_the_tables(spark, sf):
    import html
    import re

    def plain(h):
        x = re.sub(r"<(p|/p|br|h1|/h1)>", " ", re.search(r"<article>(.*?)</article>", h, re.S)[1])
        return " ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split())

    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    for r in QUERIES["op5_html_text"](spark, sf).collect():
        assert r.text == plain(pages[r.page_id]) and r.n_chars == len(r.text)
