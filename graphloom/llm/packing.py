"""Best-fit packing by minimum bin slack: each bin takes the fullest combination that the lengths left allow.

Whole texts become ids and an end id; only documents longer than a sequence are cut, into full pieces and a rest. The
plan needs nothing but the number of pieces of each length, at most ``capacity`` counts whatever the input's size.

A null text is empty and has its end id alone. Equal rows are pieces of their own. Other columns are ignored; an empty
table gives an empty table.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, rank_in_groups
from graphloom.llm.tokens import WordEncoder, texts_of, vocabulary_path

CAPACITY = 2048
END_ID = 0


def fullest(lengths: list[int], counts: dict[int, int], room: int) -> list[int]:
    """The lengths, repeats included, that fill ``room`` best: subset sums as bits of an integer, largest first.

    Bit s of ``reached`` says that s is a sum of pieces seen so far. Each step (a length times a power of two, so that
    counts cost their logarithm) is kept, and the way back from the best sum takes it where the sum needs it.
    """
    mask = (1 << (room + 1)) - 1
    reached, steps = 1, []
    for x in lengths:
        left, k = min(counts[x], room // x), 1
        while left > 0:
            k = min(k, left)
            new = reached | (reached << (x * k)) & mask
            if new != reached:
                steps.append((x, k, reached))
                reached = new
            left, k = left - k, k * 2
        if reached >> room & 1:
            break
    at, out = reached.bit_length() - 1, []
    for x, k, before in reversed(steps):
        if not before >> at & 1:
            at -= x * k
            out += [x] * k
    return out


def plan_bins(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Patterns of lengths and how many bins each fills.

    Every bin starts with the largest length left and is completed to the least slack; the pattern is used as often as
    the counts allow, so each round uses up a length.
    """
    counts = {x: n for x, n in histogram.items() if n > 0}
    out: list[tuple[list[int], int]] = []
    while counts:
        first = max(counts)
        counts[first] -= 1
        rest = fullest([x for x in sorted(counts, reverse=True) if counts[x] and x <= capacity - first], counts, capacity - first)
        counts[first] += 1
        pattern = [first, *rest]
        need = {x: pattern.count(x) for x in pattern}
        times = min(counts[x] // k for x, k in need.items())
        for x, k in need.items():
            counts[x] -= k * times
            if not counts[x]:
                del counts[x]
        out.append((pattern, times))
    return out


def rank_table(plan: list[tuple[list[int], int]]) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length, by runs of ranks: first rank, pieces a bin, first bin, place of its first piece in a bin."""
    runs: dict[int, list[tuple[int, int, int, int]]] = {}
    used: dict[int, int] = {}
    first_bin = 0
    for pattern, times in plan:
        at = 0
        for x in sorted(set(pattern), reverse=True):
            k = pattern.count(x)
            runs.setdefault(x, []).append((used.get(x, 0), k, first_bin, at))
            used[x] = used.get(x, 0) + k * times
            at += k * x
        first_bin += times
    return {x: tuple(np.array(c, np.int64) for c in zip(*r, strict=True)) for x, r in runs.items()}


def cut_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: the pieces of every whole text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = WordEncoder.at(vocabulary)
        for batch in batches:
            row, piece, start, length, crc = [], [], [], [], []
            for i, a in enumerate(encoder.encode(texts_of(batch))):
                raw = a.astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                n = len(a) + 1
                for k, s in enumerate(range(0, n, capacity)):
                    e = min(n, s + capacity)
                    row.append(i)
                    piece.append(k)
                    start.append(s)
                    length.append(e - s)
                    crc.append(zlib.crc32(raw[4 * s : 4 * e]))
            ids = batch.column("doc_id").take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def pack(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver holds the counts by length (capacity of them at most) and the plan. Pieces get a rank within their
    length, dealt over buckets where a length is hot, and a rank determines bin and place.
    """
    pieces = materialize(cut_pieces(docs, vocabulary, capacity, end_id), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    table = rank_table(plan_bins(histogram, capacity))
    ranked = rank_in_groups(pieces.withColumn("h", F.xxhash64("doc_id", "piece", "ids_crc32")), ["length"], "h", ["doc_id", "piece"], "rank").drop("h")

    names, schema = pieces.columns, pieces.schema.add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            bins, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.argsort(length, kind="stable")
            cuts = np.flatnonzero(np.diff(length[order])) + 1
            for own in np.split(order, cuts) if len(order) else []:
                x = int(length[own[0]])
                first, k, first_bin, at = table[x]
                i = np.searchsorted(first, rank[own], "right") - 1
                r = rank[own] - first[i]
                bins[own] = first_bin[i] + r // k[i]
                offset[own] = at[i] + r % k[i] * x
            keep = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(bins), pa.array(offset)], [*names, "sequence_id", "offset"])

    return ranked.mapInArrow(place, schema)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path())
