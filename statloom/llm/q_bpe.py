from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from statloom.llm.bpe import encode
from statloom.llm.common import read


def digest(ids: np.ndarray, decoded: bytes) -> dict:
    return {"n_tokens": len(ids), "ids_sha256": hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), "decoded_sha256": hashlib.sha256(decoded).hexdigest()}


DIGEST = "n_tokens long, ids_sha256 string, decoded_sha256 string"


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return encode(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, emit=digest, emit_schema=DIGEST)
