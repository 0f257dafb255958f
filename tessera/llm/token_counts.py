"""Token counts: lengths only, from batches balanced by bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.tokens import PieceCounter, model, texts_of


def count_tokens(docs: DataFrame, tokenizer_path: str, max_tokens: int = 4096,
                 id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Number of tokens of every whole text, without begin or end tokens.

    Narrow: no shuffle. Each Arrow batch is cut into slices of about equal bytes, and texts at
    places that no piece of the model reaches over, so that memory does not depend on the longest
    text's number of tokens and repeated words are encoded once.

    Rows in, rows out, one for one (repeated rows too): id as it is (null stays null), ``n_bytes``
    (UTF-8), ``n_tokens``, ``over_limit`` (more than ``max_tokens``). Null and empty texts: 0
    bytes, 0 tokens. Other columns are not read, whatever their names.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = model(PieceCounter, tokenizer_path)
        for batch in batches:
            texts = texts_of(batch.column(1))
            counts = np.concatenate([np.zeros(0, np.int64), *counter.count(texts)])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pc.binary_length(texts).cast(pa.int64()), pa.array(counts), pa.array(counts > max_tokens)],
                ["id", "n_bytes", "n_tokens", "over_limit"],
            )

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    counted = source.mapInArrow(run, "id long, n_bytes long, n_tokens long, over_limit boolean")
    return counted.withColumnRenamed("id", id_column)
