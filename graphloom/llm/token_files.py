"""Token ids as binary shards: one concatenated id array, and Elias-Fano encoded document boundaries.

A shard is a file image: header, document ids, boundaries, ids. The m+1 boundaries of m documents in u ids take about
2 + log2(u/m) bits each: low bits packed, high bits in unary. Every 256th one bit's byte is stored beside them, and
``select`` counts on from there to the k-th one bit, so any document's offset is read without a table of 64-bit offsets.

A null text is empty and still gets the end id. A null doc_id sorts first. Rows of one doc_id are ordered by a hash of
their text; equal rows are written each. A text of any length is one document of one shard. Other columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import fresh_path, materialize
from graphloom.llm.tokens import WordEncoder, texts_of, vocabulary_path

MAGIC = b"GLTOKEF2"
HEADER = "<8sQQBBxxxxxxQQ"  # magic, documents, ids, bytes an id, low bits, bytes of high bits, bytes of low bits; samples follow from the documents
END_ID = 1
SAMPLE = 256
SHARD_TOKENS = 4_000_000


class EliasFano:
    """A non-decreasing sequence of n values up to u, in n * (2 + log2(u/n)) bits.

    samples: for every SAMPLE-th one bit of ``high``, the byte that holds it and the one bits before that byte.
    """

    def __init__(self, n: int, low_bits: int, high: np.ndarray, low: np.ndarray, samples: np.ndarray):
        self.n, self.low_bits, self.high, self.low, self.samples = n, low_bits, high, low, samples

    @classmethod
    def encode(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, u = len(v), int(v[-1]) if len(v) else 0
        bits = max(0, (u // n).bit_length() - 1) if n else 0
        places = (v >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        flags = np.zeros(int(places[-1]) + 1 if n else 0, np.uint8)
        flags[places] = 1
        low = ((v[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)).astype(np.uint8).ravel()
        sampled = places[::SAMPLE] // 8
        before = np.searchsorted(places, sampled * 8)
        samples = np.stack([sampled, before], axis=1).astype("<u4")
        return cls(n, bits, np.packbits(flags, bitorder="little"), np.packbits(low, bitorder="little"), samples)

    def select(self, k: int) -> int:
        """The k-th value."""
        byte, ones = self.samples[k // SAMPLE].tolist()
        while True:
            c = int(self.high[byte]).bit_count()
            if ones + c > k:
                break
            ones, byte = ones + c, byte + 1
        x = int(self.high[byte])
        for _ in range(k - ones):
            x &= x - 1
        high = byte * 8 + (x & -x).bit_length() - 1 - k
        at = k * self.low_bits
        held = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return (high << self.low_bits) | (held >> (at & 7) & ((1 << self.low_bits) - 1))


def pack_shard(doc_ids: list[int | None], arrays: list[np.ndarray]) -> bytes:
    """A shard's file image."""
    ids = np.concatenate(arrays) if arrays else np.zeros(0, "<u2")
    ef = EliasFano.encode(np.concatenate([[0], np.cumsum([len(a) for a in arrays])]))
    present = np.packbits([d is not None for d in doc_ids], bitorder="little").tobytes()
    head = struct.pack(HEADER, MAGIC, len(doc_ids), len(ids), ids.dtype.itemsize, ef.low_bits, len(ef.high), len(ef.low))
    return b"".join([head, np.array([d or 0 for d in doc_ids], "<i8").tobytes(), present, ef.samples.tobytes(), ef.high.tobytes(), ef.low.tobytes(), ids.tobytes()])


class Shard:
    """A shard read back: ids of any document by two selects."""

    def __init__(self, raw: bytes):
        magic, self.n, tokens, width, low_bits, high, low = struct.unpack_from(HEADER, raw)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        at = struct.calcsize(HEADER)

        def part(dtype: str, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, count, at)
            at += out.nbytes
            return out

        ids = part("<i8", self.n)
        present = np.unpackbits(part("u1", (self.n + 7) // 8), bitorder="little")[: self.n]
        self.doc_ids = [int(d) if p else None for d, p in zip(ids, present, strict=True)]
        samples = part("<u4", 2 * (self.n // SAMPLE + 1)).reshape(-1, 2)
        self.bounds = EliasFano(self.n + 1, low_bits, part("u1", high), part("u1", low), samples)
        self.ids = part(f"<u{width}", tokens)

    def document(self, k: int) -> np.ndarray:
        return self.ids[self.bounds.select(k) : self.bounds.select(k + 1)]


def write_shards(docs: DataFrame, vocabulary: str, end_id: int = END_ID, shard_tokens: int = SHARD_TOKENS, path: str | None = None) -> str:
    """Writes the shards, in ascending doc_id order by file, and returns their folder.

    Rows are dealt by ranges of (doc_id, text hash), so no doc_id makes a hot partition; a task holds one shard of
    about shard_tokens ids at a time. Spark's own writer puts each image, one to a file, into any store it reaches.
    """
    spark = docs.sparkSession
    path = path or fresh_path(spark, "shards")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, ids, arrays, total = WordEncoder.at(vocabulary), [], [], 0
        tail = np.array([end_id], encoder.dtype)

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([pack_shard(ids, arrays)], pa.binary())], ["image"])

        for batch in batches:
            for d, a in zip(batch.column("doc_id").to_pylist(), encoder.encode(texts_of(batch)), strict=True):
                ids.append(d)
                arrays.append(np.concatenate([a, tail]))
                total += len(a) + 1
                if total >= shard_tokens:
                    yield out()
                    ids, arrays, total = [], [], 0
        if ids:
            yield out()

    tie = F.xxhash64(F.coalesce("text", F.lit("")))
    d = docs.select("doc_id", "text", tie.alias("tie")).repartitionByRange(F.col("doc_id").asc_nulls_first(), "tie").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "tie")
    images = d.select("doc_id", "text").mapInArrow(run, "image binary")
    images.select(F.col("image").cast("string").alias("value")).write.option("maxRecordsPerFile", 1).text(path)
    return path


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the files alone."""
    schema = "path string, k long, shard_tokens long, doc_id long, own_start long, n_tokens long, ids_crc32 long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, raw in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                s = Shard(raw.as_buffer().to_pybytes())
                at = np.fromiter(map(s.bounds.select, range(s.n + 1)), np.int64, s.n + 1)
                wide = s.ids.astype("<u4")
                crc = [zlib.crc32(wide[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
                n = s.n
                yield pa.RecordBatch.from_arrays([
                    pa.array([name] * n), pa.array(range(n), pa.int64()), pa.array([len(s.ids)] * n, pa.int64()),
                    pa.array(s.doc_ids, pa.int64()), pa.array(at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crc, pa.int64()),
                ], ["path", "k", "shard_tokens", "doc_id", "own_start", "n_tokens", "ids_crc32"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("path", "content")
    rows = materialize(files.mapInArrow(run, schema), "shard-rows")  # each file is read and decoded once
    # Files are numbered by partition and then by record, which is the order of the ranges.
    heads = rows.filter("k = 0").select("path", "shard_tokens", F.regexp_extract("path", r"part-(\d+)-", 1).cast("long").alias("p"), F.regexp_extract("path", r"-c(\d+)\.", 1).cast("long").alias("c"))
    before = W.orderBy("p", "c").rowsBetween(W.unboundedPreceding, -1)
    bases = heads.withColumn("base", F.coalesce(F.sum("shard_tokens").over(before), F.lit(0))).select("path", "base")
    return rows.join(bases, "path").select("doc_id", (F.col("base") + F.col("own_start")).alias("start"), "n_tokens", "ids_crc32")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_shards(spark, write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path()))
