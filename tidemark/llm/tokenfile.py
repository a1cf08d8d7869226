"""Token-id files: frequency-ranked ids, byte-aligned variable length, control bytes apart from data bytes.

Ids are ranked by how often they occur, so that frequent ids take one byte. A block holds some documents: their
numbers of ids, a control stream (two bits for each id: its length less one) and a data stream (little-endian
bytes). A file is a folder with two Parquet tables: `blocks`, numbered in ascending doc_id order, and `ids`, the ids
by rank with their counts, so that its path alone is enough to read it. Decoding looks each control byte up in a
table of four lengths and gathers the data bytes with numpy.

Defined results: a null text is empty and has the end id alone; rows of a null doc_id come first; rows of one doc_id
are written each, in order of their texts; an empty table gives an empty file and result; other columns do not matter.
"""

from __future__ import annotations

import os
import uuid
import zlib
from array import array
from collections.abc import Iterator
from functools import cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer, pre_tokenizers

from . import common, pretoken

MODEL = "byte_bpe_50k.json"
END_ID = 0
#: Ranges of ids in which the tasks' counts are added up.
COUNT_PARTS = 8
BLOCK_DOCS = "part int, block int, nulls int, doc_ids binary, counts binary, n long, ids binary"
FILE = "part int, block int, nulls int, doc_ids binary, counts binary, n long, control binary, data binary"

#: The four lengths that each control byte stands for.
LENGTHS = np.stack([(np.arange(256) >> (2 * k) & 3) + 1 for k in range(4)], axis=1).astype(np.uint8)


@cache
def encoder(path: str) -> pretoken.Encoder:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    library.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)  # it only gets pieces

    def encode_new(words: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in library.encode_batch_fast(words, add_special_tokens=False)]

    return pretoken.Encoder(pretoken.vocabulary(path).special, encode_new)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """Control and data bytes of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, dtype="<u4")
    length = 1 + (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    padded = np.zeros(-(-len(values) // 4) * 4, dtype=np.uint8)
    padded[: len(values)] = length - 1
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    return control.tobytes(), values.view(np.uint8).reshape(-1, 4)[np.arange(4) < length[:, None]].tobytes()


def unpack(control: bytes, data: bytes, n: int) -> np.ndarray:
    length = LENGTHS[np.frombuffer(control, dtype=np.uint8)].reshape(-1)[:n]
    out = np.zeros((n, 4), dtype=np.uint8)
    out[np.arange(4) < length[:, None]] = np.frombuffer(data, dtype=np.uint8)
    return out.view("<u4").reshape(-1)


def blocks(docs: DataFrame, path: str) -> DataFrame:
    """Encoded blocks in ascending doc_id order: range partitions, each sorted; ids as uint16 where they fit."""
    ordered = docs.select("doc_id", "text").repartitionByRange(common.partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "text")
    ordered = ordered.select(F.spark_partition_id().alias("part"), "doc_id", "text")
    kind = "<u2" if pretoken.vocabulary(path).size <= 1 << 16 else "<u4"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, k = encoder(path), 0
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column(0)[0].as_py()
            doc_ids = batch.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype("<i8", copy=False)
            null = batch.column(1).is_null().to_numpy(zero_copy_only=False)  # the first rows, if any
            texts = [t or "" for t in batch.column(2).to_pylist()]
            for a, b in common.batches(texts, pretoken.BATCH_CHARS):
                ids = [np.append(x, END_ID) for x in enc.texts(texts[a:b])]
                counts = np.array([len(x) for x in ids], dtype="<i8")
                row = (part, k, int(null[a:b].sum()), doc_ids[a:b].tobytes(), counts.tobytes(), int(counts.sum()), np.concatenate(ids).astype(kind).tobytes())
                yield _row(row, BLOCK_DOCS)
                k += 1

    return ordered.mapInArrow(run, BLOCK_DOCS)


_KINDS = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _row(values: tuple, schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([v], _KINDS[k]) for v, (_, k) in zip(values, fields, strict=True)], names=[f for f, _ in fields])


def frequencies(encoded: DataFrame, size: int) -> list[tuple[int, int]]:
    """(id, count) over all documents: added up in each task, then by ranges of ids; at most the vocabulary's size for
    the driver."""
    kind, step = "<u2" if size <= 1 << 16 else "<u4", -(-size // COUNT_PARTS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, dtype=np.int64)
        for batch in batches:
            for x in batch.column(0):
                total += np.bincount(np.frombuffer(x.as_buffer(), dtype=kind), minlength=size)
        if total.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(COUNT_PARTS), pa.int32()), pa.array([total[k * step : (k + 1) * step].tobytes() for k in range(COUNT_PARTS)], pa.binary())], names=["range", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x, dtype=np.int64) for x in table["counts"].to_pylist())
        return pa.table([table["range"][:1], pa.array([total.tobytes()], pa.binary())], names=["range", "counts"])

    held = encoded.select("ids").mapInArrow(run, "range int, counts binary").groupBy("range").applyInArrow(add, "range int, counts binary").collect()
    return [(r["range"] * step + i, n) for r in held for i, n in enumerate(np.frombuffer(r["counts"], dtype=np.int64).tolist()) if n]


def ranking(counts: list[tuple[int, int]], size: int) -> np.ndarray:
    """by_rank[r]: the id of rank r; ids that do not occur follow in order."""
    n = np.zeros(size, dtype=np.int64)
    for i, c in counts:
        n[i] = c
    return np.lexsort((np.arange(size), -n)).astype(np.int64)


def write(docs: DataFrame, path: str | None = None) -> str:
    """The folder of the written file."""
    path = path or public_tokenizers.path(MODEL)
    size = max(pretoken.vocabulary(path).size, END_ID + 1)
    kind = "<u2" if size <= 1 << 16 else "<u4"
    encoded = common.written(blocks(docs, path), "token_blocks")
    counts = frequencies(encoded, size)
    by_rank = ranking(counts, size)
    rank = np.empty(size, dtype="<u4")
    rank[by_rank] = np.arange(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                control, data = pack(rank[np.frombuffer(r["ids"], dtype=kind)])
                yield _row((r["part"], r["block"], r["nulls"], r["doc_ids"], r["counts"], r["n"], control, data), FILE)

    folder, seen = f"{common.shared_dir(docs.sparkSession)}/token-file-{uuid.uuid4().hex}", dict(counts)
    encoded.mapInArrow(run, FILE).write.option("compression", "zstd").parquet(f"{folder}/blocks")
    # one row for each id of the vocabulary
    table = pa.table({"rank": pa.array(range(size), pa.int32()), "id": pa.array(by_rank, pa.int64()), "n": pa.array([seen.get(i, 0) for i in by_rank.tolist()], pa.int64())})
    docs.sparkSession.createDataFrame(table).coalesce(1).write.parquet(f"{folder}/ids")
    return folder


def starts(file: DataFrame) -> DataFrame:
    """part, block, first: the ids before each block; sums of parts first, then within a part."""
    per_part = file.groupBy("part").agg(F.sum("n").alias("n"))
    before = per_part.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    w = Window.partitionBy("part").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    inner = file.select("part", "block", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("inner"))
    return inner.join(before, "part").select("part", "block", (F.col("base") + F.col("inner")).cast("long").alias("first"))


def read_back(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 (and ids) of each document, decoded from the file."""
    file = spark.read.schema(FILE).parquet(f"{folder}/blocks")
    ranked = spark.read.parquet(f"{folder}/ids").select("rank", "id").collect()  # one row for each id of the vocabulary
    by_rank = np.zeros(len(ranked), dtype=np.int64)
    for r in ranked:
        by_rank[r["rank"]] = r["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                doc_ids, counts = (np.frombuffer(r[c], dtype="<i8") for c in ("doc_ids", "counts"))
                ids = by_rank[unpack(r["control"], r["data"], r["n"])].astype("<u4")
                ends = np.cumsum(counts)
                each = np.split(ids, ends[:-1])
                columns = [pa.array(doc_ids, mask=np.arange(len(doc_ids)) < r["nulls"]), pa.array(ends - counts + r["first"]), pa.array(counts), pa.array([zlib.crc32(x.tobytes()) for x in each], pa.int64())]
                names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                if with_ids:
                    columns.append(pa.array([x.tolist() for x in each], pa.list_(pa.int64())))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return file.join(starts(file), ["part", "block"]).mapInArrow(run, schema)


def op10_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_back(spark, write(common.read(spark, sf_dir, "documents")))


QUERIES = {"op10_token_file": op10_token_file}
ORACLES: dict[str, str] = {}
