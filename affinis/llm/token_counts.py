"""Numbers of tokens, from Arrow functions that return lengths only."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textkernel import begin, chunks
from .tokens import ENCODED_BYTES, encoder, forget

def count_batches(path: str, batch_bytes: int):
    """mapInArrow function: (id, text) to (id, n_bytes, n_tokens), in batches of about ``batch_bytes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin("tokens", forget)
        counts = encoder(path).counts
        for batch in batches:
            for i, j, data, offsets in chunks(batch.column(1), batch_bytes):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(np.diff(offsets)), pa.array(counts(data, offsets), pa.int64())], ["id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024, batch_bytes: int = ENCODED_BYTES) -> DataFrame:
    """n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every text, by the library of ``path``.

    A text is encoded without added special tokens, truncation or padding; special strings inside it are what the
    library takes them for. Texts for byte-level files are cut where white space follows something else, which tokens
    cannot cross, and a worker encodes each distinct piece once as long as it remembers it; other files encode whole
    texts. Batches hold texts of about ``batch_bytes`` together, or one longer text. Null is empty and has no tokens. A row for
    each input row; other columns are ignored, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = rows.mapInArrow(count_batches(path, batch_bytes), f"id {rows.schema['id'].dataType.simpleString()}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of ``documents`` with the 50k byte-level BPE."""
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
