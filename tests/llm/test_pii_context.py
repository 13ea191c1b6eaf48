"""What the bootstrap finds after a trusted cue, though a base pattern rejected it or it is in pieces."""

import pytest

from statloom.llm import pii
from statloom.llm.pii import extract

NEW = ["DE89370400440532013000", "4111111111111112", "(555) 123 4567", "4111 1111 1111 1112", "999.1.2.3"]


@pytest.mark.parametrize("join", [": ", ":"])
def test_rejected_and_grouped(spark, tmp_path, join):
    rows = [(i, f"call tel{join}+1 (202) 555-01{i:02d} now") for i in range(40)] + [(100 + i, f"my tel{join}{x} thanks") for i, x in enumerate(NEW)] + [(200, "see http://x12345.example/ in 2019 and 2020 too")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/c")
    got = {r.doc_id: r for r in extract(spark.read.parquet(f"{tmp_path}/c")).collect()}
    at = len(f"my tel{join}")
    for i, x in enumerate(NEW):
        assert not got[100 + i].base and [(f.s, f.e) for f in got[100 + i].found] == [(at, at + len(x))], x
    assert all(len(got[i].base) == 1 and not got[i].found for i in range(40)) and not got[200].found


def test_secrets_of_the_documents(spark):
    """Every secret in the documents is found through its context, beside nothing that is none."""
    import re

    path = "/root/testdata/sf0.01/documents.parquet"
    docs = spark.read.parquet(path)
    want = {}
    for r in docs.select("doc_id", "text").collect():
        if spans := [(m.start(1), m.end(1)) for m in re.finditer(r"token = \"([0-9a-f]{40})\"", r.text or "")]:
            want[r.doc_id] = spans
    got = {r.doc_id: [(x.s, x.e) for x in r.found] for r in pii.extract(docs).where("size(found) > 0").collect()}
    assert len(want) >= 10 and got == want


def test_context_lends_trust_to_other_shapes(spark, tmp_path):
    """Secrets of clear form make a context trusted, and it makes unlike ones found; a form without such a context is not enough."""
    import hashlib

    digest = lambda i: hashlib.sha1(str(i).encode()).hexdigest()
    rows = [(i, f'set api_key = "{digest(i)}" here') for i in range(8)] + [(20, "set api_key='Zq9-short-1' here"), (21, f"commit{'x' * 3} {digest(99)} only once"), (22, "room 12345 and page 98765"), (23, None), (24, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    got = {r.doc_id: [dict(rows)[r.doc_id][x.s : x.e] for x in r.found] for r in pii.extract(spark.read.parquet(f"{tmp_path}/d")).collect()}
    assert all(got[i] == [digest(i)] for i in range(8)) and got[20] == ["Zq9-short-1"]
    assert not got[21] and not got[22] and not got[23] and not got[24]
