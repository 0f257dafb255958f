"""Token ids in fixed-width bit-packed files.

File format: Parquet rows, one a block. A block holds whole documents in ascending id order:

``part, block``      place in the global order (range partition, running number in it)
``first_doc, last_doc``  id range, for Parquet's row-group statistics
``doc_ids``          ids of the block's documents
``doc_starts``       token offset of each document in the block, and the block's number of tokens
``width``            bits of an id: the minimum that holds the vocabulary
``packed``           the ids, ``width`` bits each, least significant bit first, no gaps

Token k of a block lies at bit ``k * width``, so a document is cut out of its block and unpacked
without reading what is before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm.tokens import WordBpeEncoder, model, texts_of

#: A block is closed once it holds so many tokens; a longer document makes a longer block.
BLOCK_TOKENS = 1 << 18

BLOCK_SCHEMA = (
    "part int, block int, first_doc long, last_doc long, doc_ids array<long>, "
    "doc_starts array<long>, width int, packed binary"
)


def bit_width(vocab_size: int) -> int:
    """Bits that hold every id below ``vocab_size`` (one at least)."""
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids below 2**width to bits, least significant first."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    out, step = [], 8 * 8192  # a multiple of 8 ids ends at a whole byte
    for at in range(0, len(ids), step):
        part = ids[at:at + step].astype("<u4")
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 4), axis=1, bitorder="little")[:, :width]
        out.append(np.packbits(bits.reshape(-1), bitorder="little").tobytes())
    return b"".join(out)


def unpack(packed: bytes, width: int, start: int, count: int) -> np.ndarray:
    """``count`` ids from id ``start`` on, as uint32."""
    if width in (8, 16, 32):
        return np.frombuffer(packed, f"<u{width // 8}", count, start * width // 8).astype("<u4")
    out, step = [np.zeros(0, "<u4")], 1 << 16
    for at in range(start, start + count, step):
        n = min(step, start + count - at)
        low = at * width
        data = np.frombuffer(packed, np.uint8)[low // 8:(low + n * width + 7) // 8]
        bits = np.unpackbits(data, bitorder="little")[low % 8:low % 8 + n * width].reshape(n, width)
        wide = np.zeros((n, 32), np.uint8)
        wide[:, :width] = bits
        out.append(np.packbits(wide, axis=1, bitorder="little").view("<u4").reshape(-1))
    return np.concatenate(out)


def write_token_files(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1,
                      id_column: str = "doc_id", text_column: str = "text",
                      block_tokens: int = BLOCK_TOKENS) -> None:
    """Encode every whole text, append ``end_id`` and write the ids in ascending id order.

    One shuffle: texts are dealt by ranges of the id (ties by the text's hash, so that a repeated
    or null id does not fill one task), then encoded where they are written. Null and empty texts
    are documents of the end id alone; null ids come first; repeated rows are repeated.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = model(WordBpeEncoder, tokenizer_path)
        width, part, block = bit_width(max(encoder.vocab_size, end_id + 1)), TaskContext.get().partitionId(), 0
        names, lengths, chunks, held = [], [], [], 0

        def close() -> pa.RecordBatch:
            ids = np.concatenate(chunks)
            starts = np.concatenate(([0], np.cumsum(lengths)))
            known = [n for n in names if n is not None]
            return pa.RecordBatch.from_pylist(
                [dict(part=part, block=block, first_doc=min(known, default=None), last_doc=max(known, default=None),
                      doc_ids=names, doc_starts=starts.tolist(), width=width, packed=pack(ids, width))],
                pa.schema([("part", pa.int32()), ("block", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()),
                           ("doc_ids", pa.list_(pa.int64())), ("doc_starts", pa.list_(pa.int64())),
                           ("width", pa.int32()), ("packed", pa.binary())]))

        for batch in batches:
            own, at = batch.column(0).to_pylist(), 0
            for sizes, ids in encoder.encode(texts_of(batch.column(1))):
                cut = np.cumsum(sizes)
                low = 0
                for size, high in zip(sizes.tolist(), cut.tolist(), strict=True):
                    names.append(own[at])
                    lengths.append(size + 1)
                    chunks += [ids[low:high], np.asarray([end_id], "<u4")]
                    held, low, at = held + size + 1, high, at + 1
                    if held >= block_tokens:
                        yield close()
                        names, lengths, chunks, held, block = [], [], [], 0, block + 1
        if names:
            yield close()

    source = docs.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
    tie = F.xxhash64("text")
    (source.repartitionByRange(F.col("id"), tie).sortWithinPartitions(F.col("id"), tie)
     .mapInArrow(run, BLOCK_SCHEMA).write.option("compression", "zstd").parquet(path))


def read_documents(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """Random access: token ids of some documents. Row groups without them are skipped."""

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        wanted = set(doc_ids)
        for frame in frames:
            for row in frame.itertuples():
                rows = [(d, unpack(row.packed, row.width, int(row.doc_starts[i]), int(row.doc_starts[i + 1] - row.doc_starts[i])).tolist())
                        for i, d in enumerate(row.doc_ids) if d in wanted]
                if rows:
                    yield pd.DataFrame(rows, columns=["doc_id", "ids"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    near = F.lit(False)
    for i in doc_ids:
        near = near | ((F.col("first_doc") <= i) & (F.col("last_doc") >= i))
    return blocks.where(near).mapInPandas(cut, "doc_id long, ids array<long>")


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """Every document of the files: doc_id, start (ids of all documents before it), n_tokens (with
    the end id), ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                part, block, names, starts, width, packed = (batch.column(k)[i] for k in range(6))
                starts = np.asarray(starts.as_py(), np.int64)
                ids = unpack(packed.as_buffer(), width.as_py(), 0, int(starts[-1]))
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
                n = len(crc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part.as_py()] * n, pa.int32()), pa.array([block.as_py()] * n, pa.int32()), pa.array(names.as_py(), pa.int64()),
                     pa.array(starts[:-1]), pa.array(np.diff(starts)), pa.array(crc, pa.int64())],
                    ["part", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCK_SCHEMA).parquet(path)
    rows = blocks.select("part", "block", "doc_ids", "doc_starts", "width", "packed").mapInArrow(
        digest, "part int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    # Offsets: totals of each part (as many rows as the write had tasks) and of blocks inside it.
    size = blocks.select("part", "block", F.element_at("doc_starts", -1).alias("size"))
    before = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    in_part = size.withColumn("in_part", F.coalesce(F.sum("size").over(before), F.lit(0)))
    parts = size.groupBy("part").agg(F.sum("size").alias("size"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("part", F.coalesce(F.sum("size").over(earlier), F.lit(0)).alias("before_part"))
    offsets = in_part.join(parts, "part").select("part", "block", (F.col("before_part") + F.col("in_part")).alias("base"))
    return rows.join(offsets, ["part", "block"]).select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
