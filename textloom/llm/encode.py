"""Problem 6: the token ids of every document."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table
from .common import spread
from .tokenizers import DEFAULT_FOLDER, backtrack_encoder, batch_encoder


def token_ids(text: Column, vocabulary: str) -> Column:
    """ids ARRAY<INT> of a text by the rank file VOCABULARY; [] for null and empty texts. Texts of any length are read whole."""

    @F.pandas_udf("array<int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = backtrack_encoder(vocabulary).encode
        for batch in batches:
            yield pd.Series([encode(x) for x in batch])

    return ids(text)


def token_count(text: Column, vocabulary: str) -> Column:
    """The number of tokens of a text, encoded in batches by the library of the vocabulary file; 0 for null and empty texts."""

    @F.pandas_udf("long")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = batch_encoder(vocabulary)
        for batch in batches:
            yield pd.Series([len(x) for x in encode([t or "" for t in batch])], dtype="int64")

    return count(text)


def p6_ids(spark: SparkSession, sf_dir: str, folder: str = DEFAULT_FOLDER) -> DataFrame:
    """doc_id, ids of each row of documents: one pass, no shuffle but for inputs of fewer files than cores."""
    docs = spread(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return docs.select("doc_id", token_ids(F.col("text"), f"{folder}/byte_bpe_50k.tiktoken").alias("ids"))
