"""Encoding of a corpus with a public tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aislewise.llm.bpe import Vocabulary, encoder_of
from aislewise.staging import spread

#: Rows handled at a time, so that a batch of long texts stays small.
_ROWS = 512


def default_vocabulary() -> str:
    """Path of byte_bpe_50k of the installed public tokenizers."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def encode_corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary_path: str | None = None) -> DataFrame:
    """(id, ids): the token ids of each row's text, without special tokens.

    One row comes out for each row that goes in, repeated ids included. NULL and empty texts have an empty list; their
    rows stay. Strings of special tokens are ordinary text. Other columns are neither read nor returned. Texts are
    processed whole, without a shuffle (unless the source has fewer files than there are cores); the broadcast is the vocabulary (4 MB for 50,000 tokens, whatever the corpus).
    """
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(Vocabulary.load(vocabulary_path or default_vocabulary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, _ROWS):
                batch = whole.slice(at, _ROWS)
                ids, offsets = encoder.encode(batch.column(1).to_pylist())
                lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "ids"])

    narrow = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = narrow.schema["id"].dataType.simpleString()
    return spread(narrow).mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_col)
