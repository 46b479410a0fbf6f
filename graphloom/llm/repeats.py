"""Suffix-array dedup: removes every byte covered by a string of 200 bytes that also starts anywhere else.

Suffixes are dealt by content, not by place. In every window of 200 bytes the smallest hash of a 64-byte piece is its
anchor; equal windows have equal anchors, so suffixes that share 200 bytes meet under one key. Keys with one member
hold no repeat. Of every other key, the distinct surroundings of its anchor (the bytes of all windows that chose it,
with the number of their copies) are sorted by suffix_array.py; windows that follow each other in that order are
compared byte by byte, and each window of a surrounding with several copies repeats as it is.

A key with many distinct surroundings, such as a common passage's end, is split by content: into blocks of 16 windows
under the digest of the bytes that these share, and blocks that still have many into single windows. So no task ever
sorts a key of unbounded size, and every key is sorted.

A null text is empty. Strings are judged on the input; repeated rows are copies of each other. Texts under 200 bytes
lose nothing; a very long text is read as one value, and the spans of one text are gathered in one row. Copies of a
surrounding are told by a 128-bit BLAKE2b digest of its bytes, copies of a text by a SHA-256 prefix of 128 bits. Other
columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, same, whole_text
from graphloom.llm.shingles import U, chunks, mix, text_buffers
from graphloom.llm.suffix_array import suffix_arrays

LENGTH = 200
PIECE = 64  # a power of two
MOST_SORTED = 16  # distinct surroundings of a key; keys with more are split
LONG_KEY = 4  # surroundings from which keys are sorted apart from shorter ones: a batch takes as many rounds as its longest key
BLOCKS = (16, 1)  # windows under one key, after the first and the second split
SORTED_BYTES = 1 << 20  # surroundings whose suffixes are sorted at once, in whole keys
ROWS = 512  # rows that are cut or split at once, so that a batch never stands in memory several times over

_BYTES = mix(np.arange(1, 257, dtype=U) * U(0x9E3779B97F4A7C15))


def piece_hashes(data: np.ndarray, k: int = PIECE) -> np.ndarray:
    """A hash of the k bytes from every place, by doubling."""
    h, size, base = _BYTES[data], 1, 0xD6E8FEB86659FD93
    while size < k:
        h = h[:-size] * U(base) + h[size:]
        base, size = base * base % (1 << 64), size * 2
    return mix(h)


def anchors_of(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, k: int = PIECE):
    """document, place, bytes before and after, key and digest of the surroundings, of every anchor.

    An anchor at p is the choice of the windows that start from p - before to p + after (after is at most 0).
    """
    none = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return none, none, none, none, none, []
    h = piece_hashes(data, k)
    place = np.arange(len(h), dtype=U)
    least = (h >> U(32) << U(32)) | place  # equal hashes: the leftmost
    span, size = length - k + 1, 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    chosen = (least & U(0xFFFFFFFF)).astype(np.int64)  # of the window from each place
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))[: len(chosen)]
    fits = np.arange(len(chosen)) + length <= offsets[doc + 1]
    starts = np.flatnonzero(fits)
    if not len(starts):
        return none, none, none, none, none, []
    new = np.ones(len(starts), bool)
    new[1:] = (chosen[starts[1:]] != chosen[starts[:-1]]) | (starts[1:] != starts[:-1] + 1)
    first = starts[new]
    last = starts[np.append(np.flatnonzero(new)[1:] - 1, len(starts) - 1)]
    p = chosen[first]
    key = mix(h[p] ^ U(0x8EBC6AF09C88C6E3)).view(np.int64)
    return doc[first], p - offsets[doc[first]], p - first, last - p, key, digests(data.tobytes(), first, last + length, p - first)


def digests(raw: bytes, start: np.ndarray, end: np.ndarray, before: np.ndarray) -> list[bytes]:
    """128 bits for the bytes from each start to its end and the anchor's place in them."""
    new, one = hashlib.blake2b, [bytes([k]) for k in range(256)]
    return [new(raw[a:b] + one[k], digest_size=16).digest() for a, b, k in zip(start.tolist(), end.tolist(), before.tolist(), strict=True)]


def anchors(docs: DataFrame) -> DataFrame:
    """unit (digest of the text), p, before, after, key, sig of every anchor of every text; one scan, nothing shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            unit = batch.column("unit")
            data, offsets = text_buffers(batch.column("text"))
            for i, j in chunks(offsets, 1 << 19):
                own = offsets[i : j + 1]
                doc, p, before, after, key, sig = anchors_of(data[own[0] : own[-1]], own - own[0])
                yield pa.RecordBatch.from_arrays([
                    unit.take(pa.array(doc + i)), pa.array(p.astype(np.int32)), pa.array(before.astype(np.int16)), pa.array(after.astype(np.int16)), pa.array(key), pa.array(sig, pa.binary()),
                ], ["unit", "p", "before", "after", "key", "sig"])

    return docs.select("unit", "text").mapInArrow(run, "unit binary, p int, before short, after short, key long, sig binary")


SURROUNDING = "key long, sig binary, n long, split boolean, before short, after short, bytes binary"


def cut_surroundings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes around the wanted anchors of each text."""
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        data, offsets = text_buffers(batch.column("text"))
        wanted = batch.column("wanted")
        w = wanted.flatten()
        text = offsets[:-1][np.repeat(np.arange(len(wanted)), wanted.value_lengths().to_numpy(zero_copy_only=False))]
        p, before, after = (w.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("p", "before", "after"))
        low = int(offsets[0])
        raw = data[low : offsets[-1]].tobytes()
        own = [raw[a:b] for a, b in zip((text + p - before - low).tolist(), (text + p + after + LENGTH - low).tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([*(w.field(c) for c in ("key", "sig", "n", "split", "before", "after")), pa.array(own, pa.binary())], ["key", "sig", "n", "split", "before", "after", "bytes"])


PART = "own_key long, own_sig binary, key long, sig binary, n long, before short, after short, bytes binary"


def split_surroundings(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Each surrounding in parts of ``width`` windows, dealt by place from the anchor, under keys of their own.

    A part's key is the digest of its old key, its place and the bytes that all of its windows share; windows that are
    equal lie at one place, so their parts' keys are equal.
    """
    for batch in (b.slice(k, ROWS) for b in batches for k in range(0, b.num_rows, ROWS)):
        out: list[tuple] = []
        for r in batch.to_pylist():
            raw, before, windows = r["bytes"], r["before"], r["before"] + r["after"] + 1
            salt = r["key"].to_bytes(8, "little", signed=True)
            for place in range(-before // width * width, r["after"] + 1, width):
                x, y = max(0, place + before), min(windows, place + before + width)
                shared = raw[place + before + width - 1 : place + before + LENGTH]
                key = hashlib.blake2b(salt + place.to_bytes(2, "little", signed=True) + shared, digest_size=8).digest()
                whole = raw[x : y - 1 + LENGTH]
                sig = hashlib.blake2b(whole + bytes([before - x]), digest_size=16).digest()
                out.append((r["key"], r["sig"], int.from_bytes(key, "little", signed=True), sig, r["n"], before - x, y - 1 - before, whole))
        columns = list(zip(*out, strict=True)) if out else [[]] * 8
        types = (pa.int64(), pa.binary(), pa.int64(), pa.binary(), pa.int64(), pa.int16(), pa.int16(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["own_key", "own_sig", "key", "sig", "n", "before", "after", "bytes"])


FOUND = "key long, sig binary, runs array<struct<start:int,end:int>>"
RUNS = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def repeated_windows(raw: bytes, lengths: np.ndarray, windows: np.ndarray, copies: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Flags of the places in ``raw`` where a window starts that starts elsewhere under its key too.

    raw: surroundings joined, a byte after each; lengths: of each with that byte; windows, copies and keys: of each.
    """
    data = np.frombuffer(raw, np.uint8)
    begin = np.cumsum(lengths) - lengths
    symbols = data.astype(np.int64) + 1
    symbols[begin + lengths - 1] = 0
    is_window = np.zeros(len(data), bool)
    is_window[np.repeat(begin, windows) + np.arange(int(windows.sum())) - np.repeat(np.cumsum(windows) - windows, windows)] = True
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    order = suffix_arrays(symbols, np.add.reduceat(lengths, first))
    order = order[is_window[order]]
    owner = np.searchsorted(begin, order, "right") - 1
    hit = np.zeros(len(data), bool)
    hit[order[copies[owner] > 1]] = True
    near = np.flatnonzero(keys[owner[1:]] == keys[owner[:-1]]) if len(order) else order
    at = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    for k in range(0, len(near), 4096):
        one, other = order[near[k : k + 4096]], order[near[k : k + 4096] + 1]
        alike = (at[one] == at[other]).all(axis=1)
        hit[one[alike]] = True
        hit[other[alike]] = True
    return hit


def sort_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key and sig: runs of repeated windows of each surrounding that has any, by place from the anchor."""
    columns = ("key", "sig", "n", "before", "after", "bytes")
    waiting: list[list[tuple]] = [[], []]  # rows of short and of long keys
    size = [0, 0]

    def out(rows: list[tuple]) -> pa.RecordBatch:
        key, sig, n, before, after, own = zip(*rows, strict=True) if rows else [()] * 6
        if not key:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.list_(RUNS))], ["key", "sig", "runs"])
        lengths = np.array([len(x) + 1 for x in own])
        before = np.array(before)
        hit = repeated_windows(b"\0".join(own) + b"\0", lengths, before + np.array(after) + 1, np.array(n), np.array(key))
        edges = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))  # the byte after each surrounding ends its runs
        start, end = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        begin = np.cumsum(lengths) - lengths
        owner = np.searchsorted(begin, start, "right") - 1
        shift = begin[owner] + before[owner]
        who, count = np.unique(owner, return_counts=True)
        runs = pa.StructArray.from_arrays([pa.array((start - shift).astype(np.int32)), pa.array((end - shift).astype(np.int32))], fields=list(RUNS))
        lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(count)).astype(np.int32)), runs)
        return pa.RecordBatch.from_arrays([pa.array([key[k] for k in who], pa.int64()), pa.array([sig[k] for k in who], pa.binary()), lists], ["key", "sig", "runs"])

    own: list[tuple] = []
    for row in (r for batch in batches for r in zip(*(batch.column(c).to_pylist() for c in columns), strict=True)):
        if own and row[0] != own[-1][0]:
            k = len(own) >= LONG_KEY
            waiting[k] += own
            size[k] += sum(len(r[5]) for r in own)
            own = []
            if size[k] >= SORTED_BYTES:
                yield out(waiting[k])
                waiting[k], size[k] = [], 0
        if not own or row[1] != own[-1][1]:  # else cut again from a repeated row
            own.append(row)
    waiting[len(own) >= LONG_KEY] += own
    yield out(waiting[0])
    yield out(waiting[1])


def sorted_repeats(surroundings: DataFrame) -> DataFrame:
    """key, sig, runs of the surroundings that hold repeats; keys are dealt over tasks, each with few surroundings."""
    rows = surroundings.select("key", "sig", "n", "before", "after", "bytes")
    return rows.repartition("key").sortWithinPartitions("key", "sig").mapInArrow(sort_keys, FOUND)


def split_repeats(surroundings: DataFrame, width: int, *narrower: int) -> DataFrame:
    """The same for keys of any number of surroundings, each in parts of ``width`` windows and then of narrower ones.

    A part of one window is all that its key's windows can be, so the last split leaves one surrounding under each key.
    """
    parts = materialize(surroundings.drop("split").mapInArrow(lambda b: split_surroundings(b, width), PART), "parts")
    alike = parts.groupBy("key", "sig").agg(F.sum("n").alias("n"))
    keys = alike.groupBy("key").agg(F.sum("n").alias("all"), (F.count(F.lit(1)) > MOST_SORTED).alias("split")).filter("all > 1").drop("all")
    alike = materialize(alike.join(keys, "key"), "alike")
    of = parts.groupBy("key", "sig").agg(F.first("before").alias("before"), F.first("after").alias("after"), F.first("bytes").alias("bytes"))
    own = alike.join(of, ["key", "sig"])
    found = sorted_repeats(own.filter("not split"))
    if narrower:
        found = found.unionByName(split_repeats(own.filter("split").select(*surroundings.columns), *narrower))
    found = materialize(found, "found")
    told = parts.select("own_key", "own_sig", "key", "sig").join(found, ["key", "sig"])
    return told.groupBy(F.col("own_key").alias("key"), F.col("own_sig").alias("sig")).agg(F.flatten(F.collect_list("runs")).alias("runs"))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """unit, spans: what is covered by repeated strings, as [start, end) in bytes, of the texts that have any.

    docs: doc_id, text, unit.
    """
    a = materialize(anchors(docs), "anchors")
    shared = a.join(a.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("key"), "key", "left_semi")
    shared = materialize(shared, "shared")
    discard(a)
    sigs = shared.groupBy("key", "sig").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("unit", "p", "before", "after")).alias("one"))
    sigs = materialize(sigs.select("key", "sig", "n", "one.*"), "sigs")
    size = sigs.groupBy("key").agg((F.count(F.lit(1)) > MOST_SORTED).alias("split"))

    holders = docs.groupBy("unit").agg(F.min("doc_id").alias("doc_id"))
    wanted = sigs.join(size, "key").groupBy("unit").agg(F.collect_list(F.struct("key", "sig", "n", "split", "p", "before", "after")).alias("wanted")).join(holders, "unit")
    texts = docs.alias("d").join(wanted.alias("w"), same("d", "w", ["unit", "doc_id"])).select("d.text", "w.wanted")
    cut = materialize(texts.mapInArrow(cut_surroundings, SURROUNDING), "surroundings")
    found = sorted_repeats(cut.filter("not split")).unionByName(split_repeats(cut.filter("split").dropDuplicates(["key", "sig"]), *BLOCKS))
    found = materialize(found, "found")
    discard(cut, sigs)

    each = shared.select("key", "sig", "unit", "p").join(found, ["key", "sig"]).select("unit", "p", F.explode("runs").alias("run"))
    span = F.struct((F.col("p") + F.col("run.start")).alias("start"), (F.col("p") + F.col("run.end") - 1 + LENGTH).alias("end"))
    return each.groupBy("unit").agg(F.collect_set(span).alias("spans"))


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept: the bytes that stay of every text."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    d = docs.select("doc_id", whole_text().alias("text")).withColumn("unit", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))
    spans = repeated_spans(d)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 8 * ROWS) for b in batches for k in range(0, b.num_rows, 8 * ROWS)):
            data, offsets = text_buffers(batch.column("text"))
            data, offsets = data[offsets[0] : offsets[-1]], offsets - offsets[0]
            spans, size = batch.column("spans"), np.diff(offsets)
            count = spans.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            shift, each = np.repeat(offsets[:-1], count), spans.flatten()
            start, end = (each.field(c).to_numpy(zero_copy_only=False) + shift for c in ("start", "end"))
            depth = np.cumsum(np.bincount(start, minlength=len(data) + 1) - np.bincount(end, minlength=len(data) + 1))
            gone = depth[:-1] > 0
            # A run begins where its first byte goes and the byte before stays, or belongs to another text.
            begins = gone & ~np.append(False, gone[:-1])
            firsts = offsets[:-1][size > 0]
            begins[firsts] = gone[firsts]
            total = lambda flags: np.diff(np.append(0, np.cumsum(flags))[offsets])
            removed = total(gone)
            ends = np.append(0, np.cumsum(size - removed)).astype(np.int32)
            kept = pa.Array.from_buffers(pa.binary(), len(size), [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(data[~gone].tobytes())])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(total(begins), pa.int64()), kept], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    j = d.join(spans, "unit", "left").select("doc_id", "text", "spans")
    return j.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept binary")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return r.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
