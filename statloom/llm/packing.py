"""Token ids in fixed-width bit-packed shards.

A shard is a self-contained byte string: a header, the token offset of each document, the byte offset of each block, and the
blocks. A block holds block_ids ids (the last may hold fewer) of the same width, the fewest bits that the vocabulary needs,
most significant bit first, and starts on a byte. So any id is found from its position alone, and a block is unpacked by
numpy at once.

write() range-partitions the documents by id, encodes and packs them task by task and lets Spark's file writer commit the
shards (one per row, column `payload`): a task that is lost or run twice leaves nothing half written, and any store that
Spark reaches will do. Where each shard begins among all tokens follows from sums over tasks, then within a task; one row
per task meets in one place, no more.

Defined results: a null text has only the end id; null ids come first; rows of equal ids are ordered by the text's hash;
repeated rows are all written; an empty table makes no shard and reads back as no rows; columns other than id and text play
no part.
"""

from __future__ import annotations

import struct
import zlib
from array import array
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

HEADER = struct.Struct("<4sBxxxIIQ")  # magic, bits, ids in a block, documents, ids
MAGIC = b"SLT1"
BLOCK_IDS = 4096
SHARD_IDS = 1 << 20


def bits_for(vocabulary: int) -> int:
    return max(1, (vocabulary - 1).bit_length())


def pack_block(ids: np.ndarray, bits: int) -> bytes:
    if bits == 16:
        return ids.astype(">u2").tobytes()
    shifts = np.arange(bits - 1, -1, -1, dtype=np.uint32)
    return np.packbits(((ids[:, None].astype(np.uint32) >> shifts) & 1).astype(np.uint8)).tobytes()


def unpack_block(data: bytes | memoryview, n: int, bits: int) -> np.ndarray:
    if bits == 16:
        return np.frombuffer(data, ">u2", n).astype("<u4")
    at = np.arange(n, dtype=np.int64) * bits
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = np.frombuffer(data, np.uint8)
    words = np.zeros(n, np.uint64)
    for i in range(5):  # an id of up to 32 bits lies within 5 bytes
        words = (words << np.uint64(8)) | padded[(at >> 3) + i].astype(np.uint64)
    return ((words >> (np.uint64(40 - bits) - (at & 7).astype(np.uint64))) & np.uint64((1 << bits) - 1)).astype("<u4")


def pack_shard(ids: np.ndarray, doc_ends: np.ndarray, bits: int, block_ids: int = BLOCK_IDS) -> bytes:
    """ids of all documents of a shard, one after another; doc_ends: where each ends."""
    if len(ids) and int(ids.max()) >> bits:
        raise ValueError("an id is outside the vocabulary")
    blocks = [pack_block(ids[i : i + block_ids], bits) for i in range(0, len(ids), block_ids)]
    offsets = np.cumsum([0, *map(len, blocks)])
    return b"".join([HEADER.pack(MAGIC, bits, block_ids, len(doc_ends), len(ids)), np.asarray(doc_ends, "<u8").tobytes(), offsets.astype("<u8").tobytes(), *blocks])


class Shard:
    """Random access to one shard's bytes (bytes, or a memory map)."""

    def __init__(self, data: bytes | memoryview):
        magic, self.bits, self.block_ids, self.n_docs, self.n_ids = HEADER.unpack_from(data)
        if magic != MAGIC:
            raise ValueError("not a shard")
        n_blocks, at = -(-self.n_ids // self.block_ids), HEADER.size
        self.doc_ends = np.frombuffer(data, "<u8", self.n_docs, at).astype(np.int64)
        self.offsets = np.frombuffer(data, "<u8", n_blocks + 1, at := at + 8 * self.n_docs).astype(np.int64)
        self.body = memoryview(data)[at + 8 * (n_blocks + 1) :]

    def ids(self, start: int, stop: int) -> np.ndarray:
        first, last = start // self.block_ids, -(-stop // self.block_ids)
        got = [unpack_block(self.body[self.offsets[b] : self.offsets[b + 1]], min(self.block_ids, self.n_ids - b * self.block_ids), self.bits) for b in range(first, last)]
        return np.concatenate(got)[start - first * self.block_ids : stop - first * self.block_ids] if got else np.zeros(0, "<u4")

    def document(self, i: int) -> np.ndarray:
        return self.ids(int(self.doc_ends[i - 1]) if i else 0, int(self.doc_ends[i]))

    def documents(self) -> Iterator[np.ndarray]:
        yield from np.split(self.ids(0, self.n_ids), self.doc_ends[:-1]) if self.n_docs else ()


def _byte_characters() -> dict[int, str]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Known(dict):
    """A cache of at most 2 * most entries: those of the last `most` new ones, and of the ones before what was met again since."""

    def __init__(self, make: Callable[[str], bytes], most: int):
        self.make, self.most, self.before = make, most, {}

    def __missing__(self, x: str) -> bytes:
        if (got := self.before.get(x)) is None:
            got = self.make(x)
        if len(self) >= self.most:
            self.before = dict(self)
            self.clear()
        self[x] = got
        return got


class OddSpace(Exception):
    """A run that isn't told from its neighbours by one space alone."""


class SpacedEncoder:
    """Encodes with the tokenizers library, each distinct pre-token once.

    In a byte-level vocabulary whose pattern joins one space to the word after it, a pre-token ends before every single space
    between two characters that aren't white space; the text's ids are those of the runs between, joined. A run that isn't
    known is cut by the pattern (runs of letters, with or without ASCII punctuation after them, need no search), and the
    library's model encodes the pre-tokens that aren't known. A text with white space beside white space of which one is a
    space, or with a space at an end, or with what could be a special token, is encoded as a whole. Runs and pre-tokens stay
    known for later texts, up to a number.
    """

    KNOWN = 300_000
    #: ASCII signs that are neither letter nor number, but for the apostrophe, which begins contractions.
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"

    def __init__(self, json_path: str, pattern: str):
        import regex
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        self.model = self.tokenizer.model
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = regex.compile(pattern).findall
        self.characters = _byte_characters()
        self.pre_tokens = Known(self._pre_token, self.KNOWN)
        self.runs = Known(self._run, self.KNOWN)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pre_token(self, x: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(x.encode().decode("latin-1").translate(self.characters))]).tobytes()

    def _run(self, run: str) -> bytes:
        """Ids of a run with the space before it."""
        if run.isalpha():
            return self.pre_tokens[" " + run]
        if not run or run[0].isspace() or run[-1].isspace():
            raise OddSpace
        if (word := run.rstrip(self.SIGNS)).isalpha():
            return self.pre_tokens[" " + word] + self.pre_tokens[run[len(word) :]]
        return b"".join([self.pre_tokens[x] for x in self.find(" " + run)])

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        first, *rest = text.split(" ")
        if (rest and (not first or first[-1].isspace())) or any(s in text for s in self.special):
            return self._whole(text)
        try:
            return b"".join([*[self.pre_tokens[x] for x in self.find(first)], *[self.runs[run] for run in rest]])
        except OddSpace:
            return self._whole(text)


@lru_cache(maxsize=2)
def encoder(json_path: str, pattern: str) -> SpacedEncoder:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return SpacedEncoder(json_path, pattern)


SHARDS = "part int, shard int, doc_ids array<long>, n_ids long, payload binary"


def write(docs: DataFrame, path: str, json_path: str, pattern: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text", shard_ids: int = SHARD_IDS, block_ids: int = BLOCK_IDS) -> None:
    """Writes every document's ids and end_id in ascending order of id_col as shards under path."""
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(n, F.col("id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("id").asc_nulls_first(), "tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, shard, enc = TaskContext.get().partitionId(), 0, encoder(json_path, pattern)
        bits, end = bits_for(max(enc.vocabulary, end_id + 1)), np.array([end_id], "<u4").tobytes()
        doc_ids: list[int | None] = []
        held: list[bytes] = []
        size = 0

        def close() -> pa.RecordBatch:
            ends = np.cumsum([len(x) // 4 for x in held])
            payload = pack_shard(np.frombuffer(b"".join(held), "<u4"), ends, bits, block_ids)
            columns = [pa.array([part], pa.int32()), pa.array([shard], pa.int32()), pa.array([doc_ids], pa.list_(pa.int64())), pa.array([size], pa.int64()), pa.array([payload], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, names=["part", "shard", "doc_ids", "n_ids", "payload"])

        for b in batches:
            for doc_id, text in zip(b.column("id"), b.column("text"), strict=True):
                ids = enc.encode(text.as_py()) + end
                if size and size + len(ids) // 4 > shard_ids:
                    yield close()
                    shard, doc_ids, held, size = shard + 1, [], [], 0
                doc_ids.append(doc_id.as_py())
                held.append(ids)
                size += len(ids) // 4
        if held:
            yield close()

    rows.select("id", "text").mapInArrow(run, SHARDS).write.mode("overwrite").option("compression", "none").parquet(path)


def read_back(spark: SparkSession, path: str, emit: Callable[[np.ndarray], dict] | None = None, emit_schema: str = "ids array<long>") -> DataFrame:
    """Per document doc_id, start (ids of all documents before it), n_tokens, and what emit(ids) returns (the ids)."""
    emit = emit or (lambda ids: {"ids": ids.tolist()})
    shards = spark.read.schema(SHARDS).parquet(path)
    counts = shards.select("part", "shard", "n_ids")
    parts = counts.groupBy("part").agg(F.sum("n_ids").alias("n")).select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, 0)
    starts = counts.withColumn("within", F.sum("n_ids").over(own) - F.col("n_ids")).join(parts, "part").select("part", "shard", (F.col("before") + F.col("within")).alias("start"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                shard = Shard(b.column("payload")[i].as_buffer())
                doc_ids = b.column("doc_ids")[i].as_py()
                n = np.diff(shard.doc_ends, prepend=0)
                got = [emit(ids) for ids in shard.documents()]
                made = {k: [g[k] for g in got] for k in got[0]}
                fixed = {"part": pa.array([b.column("part")[i].as_py()] * len(n), pa.int32()), "shard": pa.array([b.column("shard")[i].as_py()] * len(n), pa.int32()), "doc_id": pa.array(doc_ids, pa.int64()), "within": pa.array(shard.doc_ends - n), "n_tokens": pa.array(n)}
                yield pa.RecordBatch.from_pydict({**fixed, **made})

    read = shards.select("part", "shard", "doc_ids", "payload").mapInArrow(run, f"part int, shard int, doc_id long, within long, n_tokens long, {emit_schema}")
    out = read.join(starts, ["part", "shard"])
    return out.withColumn("start", F.col("start") + F.col("within")).drop("part", "shard", "within")


def crc(ids: np.ndarray) -> dict:
    return {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())}
