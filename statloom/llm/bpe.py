"""Byte-level BPE encoding and decoding with overlapping chunks.

A text longer than chunk_chars is cut into chunks that overlap by a fixed number of characters. Each chunk is pre-tokenised
on its own, in parallel. A chunk's first boundaries may be wrong, since it starts at an arbitrary character; but the
pre-token pattern looks at nothing left of where it stands, so once two neighbours agree on one boundary inside their
overlap they agree on all that follow. Neighbours are stitched at their first common boundary, the text is cut there, and the
pieces are encoded in parallel. Where an overlap has no common boundary (one pre-token covers it), the document is encoded as
a whole. A shorter text is one chunk and one piece. Decoding concatenates the raw bytes of the ids.

Defined results: a null or empty text has no ids; ids, order and repeated rows don't matter, every input row gives one row;
columns to carry along are named by the caller, so others can't clash.
"""

from __future__ import annotations

import base64
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_CHARS, OVERLAP = 32_768, 512
#: Characters at a chunk's end whose absence could change a boundary before them.
MARGIN = 8

Emit = Callable[[np.ndarray, bytes], dict]


class Codec:
    """Ranks and pattern of one vocabulary."""

    def __init__(self, ranks_path: str, pattern: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(pattern)

    def encode(self, text: str) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(text), dtype="<u4")

    def decode(self, ids: Sequence[int] | np.ndarray) -> bytes:
        return self.encoding.decode_bytes(ids.tolist() if isinstance(ids, np.ndarray) else list(ids))

    def boundaries(self, text: str, start: int, stop: int) -> list[int]:
        """Where pre-tokens of text begin, counted from its start, within [start, stop)."""
        return [m.start() for m in self.pattern.finditer(text) if start <= m.start() < stop]


@lru_cache(maxsize=4)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def emit_ids(ids: np.ndarray, decoded: bytes) -> dict:
    """The default output of encode(): the ids and the text that they decode to."""
    return {"ids": ids.astype("int64").tolist(), "decoded": decoded.decode("utf-8", "replace")}


EMIT_IDS = "ids array<long>, decoded string"


def encode(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    text_col: str = "text",
    keep: Sequence[str] = ("doc_id",),
    emit: Emit = emit_ids,
    emit_schema: str = EMIT_IDS,
    chunk_chars: int = CHUNK_CHARS,
    overlap: int = OVERLAP,
) -> DataFrame:
    """keep's columns of every row of docs, and what emit(ids, decoded bytes) returns for its text."""
    out = T.StructType([docs.schema[c] for c in keep] + T._parse_datatype_string(emit_schema).fields)
    rows = docs.select(*keep, F.coalesce(text_col, F.lit("")).alias("_text"))
    is_long = F.length("_text") > chunk_chars
    short = rows.where(~is_long).mapInArrow(_whole(ranks_path, pattern, list(keep), emit, out), out)
    return short.unionByName(_chunked(rows.where(is_long), ranks_path, pattern, list(keep), emit, out, chunk_chars, overlap))


def _arrow(out: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(out)


def _whole(ranks_path: str, pattern: str, keep: list[str], emit: Emit, out: T.StructType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, schema = codec(ranks_path, pattern), _arrow(out)
        for b in batches:
            got = []
            for text in b.column("_text"):
                ids = c.encode(text.as_py())
                got.append(emit(ids, c.decode(ids)))
            yield _batch(b, keep, got, schema)

    return run


def _batch(b: pa.RecordBatch, keep: list[str], got: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    made = [pa.array([g[f.name] for g in got], f.type) for f in list(schema)[len(keep) :]]
    return pa.RecordBatch.from_arrays([*(b.column(k).cast(schema.field(k).type) for k in keep), *made], schema=schema)


def _chunked(rows: DataFrame, ranks_path: str, pattern: str, keep: list[str], emit: Emit, out: T.StructType, size: int, overlap: int) -> DataFrame:
    rows = rows.withColumn("_row", F.monotonically_increasing_id())
    chunks_schema = T.StructType([*(rows.schema[c] for c in keep), *T._parse_datatype_string("_row long, _k int, _text string").fields])

    def split(batches):
        schema = _arrow(chunks_schema)
        for b in batches:
            for i in range(b.num_rows):
                text = b.column("_text")[i].as_py()
                n = -(-len(text) // size)
                fixed = [pa.array([b.column(c)[i].as_py()] * n, schema.field(c).type) for c in [*keep, "_row"]]
                yield pa.RecordBatch.from_arrays([*fixed, pa.array(range(n), pa.int32()), pa.array([text[k * size : (k + 1) * size + overlap] for k in range(n)])], schema=schema)

    bounds_schema = T.StructType([*chunks_schema.fields, *T._parse_datatype_string("_head array<int>, _tail array<int>").fields])

    def pretokenise(batches):
        c, schema = codec(ranks_path, pattern), _arrow(bounds_schema)
        for b in batches:
            heads, tails = [], []
            for text in b.column("_text").to_pylist():
                stop = len(text) - MARGIN
                at = c.boundaries(text, 0, stop)
                heads.append([p for p in at if p < overlap])
                tails.append([p - size for p in at if p >= size])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(heads, pa.list_(pa.int32())), pa.array(tails, pa.list_(pa.int32()))], schema=schema)

    by_row = Window.partitionBy("_row").orderBy("_k")
    pieces = rows.mapInArrow(split, chunks_schema).repartition("_row", "_k").mapInArrow(pretokenise, bounds_schema)
    pieces = pieces.withColumn("_cut", F.array_min(F.array_intersect("_tail", F.lead("_head").over(by_row))))
    pieces = pieces.withColumn("_last", F.lead("_k").over(by_row).isNull())
    pieces = pieces.withColumn("_from", F.coalesce(F.lag("_cut").over(by_row), F.lit(0)))
    pieces = pieces.withColumn("_met", F.min((F.col("_last") | F.col("_cut").isNotNull()).cast("int")).over(Window.partitionBy("_row")) == 1)
    pieces = pieces.select(*keep, "_row", "_k", "_text", "_from", "_cut", "_last", "_met").repartition("_row", "_k")
    coded_schema = T.StructType([*(rows.schema[c] for c in keep), *T._parse_datatype_string("_row long, _k int, _met boolean, _part binary").fields])

    def encode_pieces(batches):
        c, schema = codec(ranks_path, pattern), _arrow(coded_schema)
        for b in batches:
            parts = []
            for text, start, cut_at, last, met in zip(*(b.column(x).to_pylist() for x in ("_text", "_from", "_cut", "_last", "_met")), strict=True):
                if met:
                    parts.append(c.encode(text[start : None if last else size + cut_at]).tobytes())
                else:
                    parts.append(text[: None if last else size].encode())
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in [*keep, "_row", "_k", "_met"]), pa.array(parts, pa.binary())], schema=schema)

    def assemble(table: pa.Table) -> pa.Table:
        c, schema = codec(ranks_path, pattern), _arrow(out)
        table = table.sort_by("_k")
        joined = b"".join(table.column("_part").to_pylist())
        ids = np.frombuffer(joined, dtype="<u4") if table.column("_met")[0].as_py() else c.encode(joined.decode())
        first = table.slice(0, 1).combine_chunks().to_batches()[0]
        return pa.Table.from_batches([_batch(first, keep, [emit(ids, c.decode(ids))], schema)])

    return pieces.mapInArrow(encode_pieces, coded_schema).groupBy("_row").applyInArrow(assemble, out)
