from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from statloom.llm.common import read, scratch
from statloom.llm.packing import crc, read_back, write


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = scratch(spark, "shards")
    write(read(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return read_back(spark, path, crc, "ids_crc32 long")
