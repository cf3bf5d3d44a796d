"""Functions for SQL text: a table function that chunks, and scalar ones that need a scan in Python."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf

from . import chunking, exact


def register(spark: SparkSession) -> None:
    """``chunk_text(text, max)``, ``has_loop(text)``, ``speech_text(text)``."""

    @udtf(returnType="chunk_index int, context_before string, main_content string, context_after string, token_count int")
    class ChunkText:
        def eval(self, text: str, most: int):
            for i, c in enumerate(chunking.chunks_of(text, most)):
                yield i, c["context_before"], c["main_content"], c["context_after"], c["token_count"]

    @pandas_udf("boolean")
    def has_loop(text: pd.Series) -> pd.Series:
        return text.fillna("").map(exact.has_loop).astype(bool)

    @pandas_udf("string")
    def speech_text(text: pd.Series) -> pd.Series:
        return text.fillna("").map(exact.speech_text)

    spark.udtf.register("chunk_text", ChunkText)
    spark.udf.register("has_loop", has_loop)
    spark.udf.register("speech_text", speech_text)
