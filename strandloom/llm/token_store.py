"""Token ids in Parquet: ordered by document, with dictionaries, deltas and page indexes."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common
from .pretokens import encoder

SCHEMA = "doc_id long, n_tokens long, part int, part_start long, ids array<int>"


def encode_bytes(raw: np.ndarray, offsets: np.ndarray, path: str, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
    """ids of texts, given as UTF-8 bytes and offsets of texts, by the tokenizers library, and the number of each text."""
    values, n = encoder(path).encode(raw, offsets)
    if end_id is None:
        return values, n
    n = n + 1
    out = np.empty(len(values) + len(n), np.uint32)
    inside = np.ones(len(out), bool)
    inside[np.cumsum(n) - 1] = False
    out[inside] = values
    out[~inside] = end_id
    return out, n


def encode(texts: list[str], path: str, end_id: int | None) -> list[bytes]:
    """ids of texts as little-endian unsigned 32-bit integers, by the tokenizers library."""
    coded = [t.encode() for t in texts]
    offsets = np.cumsum([0, *map(len, coded)])
    values, n = encode_bytes(np.frombuffer(b"".join(coded), np.uint8), offsets, path, end_id)
    ends = np.cumsum([0, *n.tolist()])
    return [values[i:j].astype("<u4").tobytes() for i, j in zip(ends[:-1], ends[1:], strict=True)]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2, row_group_bytes: int = 32 << 20, page_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the ids of every text to Parquet files in ascending order of the document id.

    Texts are range-partitioned by id and sorted, then encoded inside the write
    stage, so ids are never shuffled. `ids` has a dictionary; id, start and
    length columns have deltas (the second version of Parquet's data pages);
    row groups have row_group_bytes and pages at most page_rows documents, with
    column and offset indexes, so a reader can fetch the lengths alone or the
    tokens of a range of documents. `part` numbers the files in order, and
    part_start counts the ids before a document in its file. Retried tasks
    write the same rows.

    A null text is empty (only the end id); null ids sort first; equal ids are
    ordered by a hash of their texts; an empty table gives no rows.
    """
    common.prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, start = TaskContext.get().partitionId(), 0
        for b in batches:
            values, n = encode_bytes(*common.byte_view(b, "t"), tokenizer, end_id)
            offsets = np.concatenate([[0], np.cumsum(n)])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n), pa.array(np.full(len(n), part, np.int32)), pa.array(offsets[:-1] + start), common.lists(values.view(np.int32), offsets, pa.int32())], ["doc_id", "n_tokens", "part", "part_start", "ids"])
            start += int(offsets[-1])

    source = docs.select(common.ids(docs, id_col).alias("i"), docs[f"`{text_col}`"].alias("t"))
    ordered = source.repartitionByRange("i").sortWithinPartitions("i", F.xxhash64("t"))
    writer = ordered.mapInArrow(run, SCHEMA).write.option("compression", "zstd")
    for key, value in {
        "parquet.writer.version": "PARQUET_2_0",
        "parquet.block.size": row_group_bytes,
        "parquet.page.size": 256 << 10,
        "parquet.page.row.count.limit": page_rows,
        "parquet.enable.dictionary": "true",
        "parquet.enable.dictionary#doc_id": "false",
        "parquet.enable.dictionary#n_tokens": "false",
        "parquet.enable.dictionary#part_start": "false",
    }.items():
        writer = writer.option(key, value)
    writer.parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """Documents with `start`, the number of ids before them in all files.

    The starts need only the numbers of the files (a sum for each file), which
    are broadcast: one row per file, so never more than a few MB. With
    ids=False token pages are never read; a range of documents is pushed down
    to row groups and pages.
    """
    table = spark.read.schema(SCHEMA).parquet(path)
    totals = table.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("before"))
    rows = table if first is None else table.where(F.col("doc_id") >= first)
    rows = rows if last is None else rows.where(F.col("doc_id") <= last)
    columns = ["doc_id", (F.col("before") + F.col("part_start")).alias("start"), "n_tokens", *["ids"] * ids]
    return rows.join(F.broadcast(before), "part").select(*columns)


def digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of the ids as little-endian 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(3)
            values = memoryview(np.ascontiguousarray(ids.flatten().to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            ends = np.concatenate([[0], np.cumsum(ids.value_lengths().to_numpy(zero_copy_only=False))]) * 4
            crc = [zlib.crc32(values[i:j]) for i, j in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.select("doc_id", "start", "n_tokens", "ids").mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
