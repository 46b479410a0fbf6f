"""Near duplicates by circulant MinHash: two permutations, one of them shifted circularly, make the whole signature.

Words are maximal runs of characters other than white space, A-Z in lower case; a document's set holds its distinct
five-word shingles, or its whole word sequence where that is shorter. Two documents are linked if
100 * |intersection| >= percent * |union|; every link is confirmed on the full sets.

Null texts and texts without words have an empty set and are linked with nothing. Equal sets are one class from the
start, so repeated rows cost one row each. A null doc_id is no candidate for component_id unless a component has no
other. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import materialize, rows_of, same
from graphloom.llm.components import components
from graphloom.llm.shingles import mix, shingle_sets

PERCENT = 85
#: 30 bands of 5: a pair at a similarity of 0.85 shares no band with probability (1 - 0.85^5)^30 = 2e-8.
BANDS, ROWS = 30, 5
BLOCK = 1024
PER_SALT = 2000

_SIGMA = np.uint64(0x2545F4914F6CDD1D)


def signature(values: np.ndarray, k: int) -> np.ndarray:
    """min over v of pi((sigma(v) + i) mod 2^32), for i from 0 to k - 1; sigma and pi are fixed mixing functions."""
    sigma = (mix(values * _SIGMA) >> np.uint64(32)).astype(np.uint32)
    shifts = np.arange(k, dtype=np.uint32)[:, None]
    out = np.full(k, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(sigma), 2048):
        x = sigma[None, at : at + 2048] + shifts
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(axis=1), out=out)
    return out


def band_hashes(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    h = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for column in sig.reshape(bands, rows).T.astype(np.uint64):
        h = mix(h ^ column)
    return h.view(np.int64)


def describe(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (128 bits, null for an empty set), bands; a text goes no further than this."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, out = [], [], []
            for s in shingle_sets(batch.column(1)):
                n.append(len(s))
                keys.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest() if len(s) else None)
                out.append(band_hashes(signature(s, bands * rows), bands, rows) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(out, pa.list_(pa.int64())), batch.column(2)], ["doc_id", "n_shingles", "set_key", "bands", "text_hash"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(run, f"doc_id {kind}, n_shingles long, set_key binary, bands array<long>, text_hash long")


def sets_of(docs: DataFrame) -> DataFrame:
    """node, packed: the sorted shingle hashes of the texts as bytes, where they are those that the node stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.tobytes() for s in shingle_sets(batch.column(1))]
            own = [(k, s) for k, s in zip(batch.column(0).to_pylist(), sets, strict=True) if hashlib.blake2b(s, digest_size=16).digest() == k]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in own], pa.binary()), pa.array([s for _, s in own], pa.binary())], ["node", "packed"])

    return docs.select("node", "text").mapInArrow(run, "node binary, packed binary")


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum()) if len(b) else 0


def confirm_stars(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted so that a leader's set comes before its members' sets: the members linked with it."""
    leader, own = None, np.zeros(0, np.uint64)
    for batch in batches:
        a, b = [], []
        for lead, node, packed in zip(batch.column("leader").to_pylist(), batch.column("node").to_pylist(), batch.column("packed").to_pylist(), strict=True):
            s = np.frombuffer(packed, np.uint64)
            if lead == node:
                leader, own = lead, s
                continue
            if lead != leader:
                raise ValueError("a leader's own row must come first")
            both = common(own, s)
            if 100 * both >= percent * (len(own) + len(s) - both):
                a.append(lead)
                b.append(node)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])


def block_links(nodes: list, labels: list, sets: list[np.ndarray], percent: int, columns: int = 4096) -> tuple[list, list]:
    """A forest of the links between nodes of different labels in a block, all pairs judged on their full sets.

    Only shingles of two sets or more can be common; their incidence matrix times its transpose, a slice of columns
    at a time, counts every intersection.
    """
    n = np.array([len(s) for s in sets], np.float64)
    row = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.full(len(values), -1)
    shared = np.flatnonzero(times > 1)
    place[shared] = np.arange(len(shared))
    column = place[column]
    row, column = row[column >= 0], column[column >= 0]
    both = np.zeros((len(sets), len(sets)), np.float64)
    for at in range(0, len(shared), columns):
        inside = (column >= at) & (column < at + columns)
        m = np.zeros((len(sets), min(columns, len(shared) - at)), np.float32)
        m[row[inside], column[inside] - at] = 1
        both += m @ m.T
    linked = np.triu(100 * both >= percent * (n[:, None] + n[None, :] - both), 1)
    ids = {x: k for k, x in enumerate(dict.fromkeys(labels))}
    apart = np.array([ids[x] for x in labels])
    linked &= apart[:, None] != apart[None, :]
    root = {x: x for x in labels}

    def find(x):
        while root[x] != x:
            root[x] = x = root[root[x]]
        return x

    a, b = [], []
    for i, j in zip(*np.nonzero(linked), strict=True):
        x, y = find(labels[i]), find(labels[j])
        if x != y:
            root[x] = y
            a.append(nodes[i])
            b.append(nodes[j])
    return a, b


def confirm_blocks(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by block: the links between different components in each."""
    key, nodes, labels, sets = None, [], [], []

    def out() -> pa.RecordBatch:
        a, b = block_links(nodes, labels, sets, percent) if len(set(labels)) > 1 else ([], [])
        return pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], ["a", "b"])

    for batch in batches:
        for r in batch.to_pylist():
            if (own := (r["bucket"], r["i"], r["j"])) != key:
                yield out()
                key, nodes, labels, sets = own, [], [], []
            nodes.append(r["node"])
            labels.append(r["label"])
            sets.append(np.frombuffer(r["packed"], np.uint64))
    yield out()


def near_duplicates(docs: DataFrame, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS, by_row: bool = False) -> DataFrame:
    """doc_id, text_hash, n_shingles, set_key (null for an empty set), component_id, kept; one row per document.

    kept marks the rows whose doc_id is component_id; with ``by_row`` the first row of a component by doc_id (nulls
    last) and text_hash, and every row without words: then only rows that agree in both tie.

    1. Signatures, then classes of equal sets. 2. In each band's bucket the most central class (whose buckets are the
    largest) leads; every other class is confirmed against it: no more pairs than rows, hot leaders dealt over salts.
    3. Buckets whose classes still lie in different components are compared whole, in blocks of bounded size, and
    give a forest of links, not all pairs. 4. Components of the confirmed links.
    """
    sig = materialize(describe(docs, bands, rows), "minhash")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("top")
    classes = sig.filter("set_key is not null").groupBy(F.col("set_key").alias("node")).agg(F.min("doc_id").alias("least"), F.first("bands").alias("bands"), first)
    classes = materialize(classes, "classes")
    banded = classes.select("node", F.explode("bands").alias("bucket"))
    full = materialize(banded.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "buckets")
    inside = materialize(banded.join(full, "bucket"), "banded")
    degree = inside.groupBy("node").agg(F.sum("n").alias("degree"))
    member = materialize(inside.join(degree, "node"), "members")
    lead = member.groupBy("bucket").agg(F.max(F.struct("degree", "node")).alias("top")).select("bucket", F.col("top.node").alias("leader"))
    stars = member.select("bucket", "node").join(lead, "bucket").filter("node <> leader").select("leader", "node").distinct()
    stars = materialize(stars, "stars")

    reps = degree.select("node").join(classes.select("node", "top.doc_id", "top.text_hash"), "node")
    packed = materialize(_packed(docs, sig, reps), "sets")

    many = stars.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / PER_SALT).alias("salts"))
    salted = stars.join(many, "leader").withColumn("salt", F.pmod(F.xxhash64("node"), "salts")).drop("salts")
    heads = many.select("leader", F.col("leader").alias("node"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"))
    rowset = salted.select("leader", "node", "salt").unionByName(heads).join(packed, "node")
    rowset = rowset.withColumn("rest", F.col("leader") != F.col("node")).repartition("leader", "salt").sortWithinPartitions("leader", "salt", "rest")
    links = materialize(rowset.select("leader", "node", "packed").mapInArrow(lambda b: confirm_stars(b, percent), "a binary, b binary"), "links")

    labels = components(links)
    told = member.select("bucket", "node", "n").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    split = told.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).filter("lo <> hi").select("bucket")
    rest = materialize(told.filter("n > 2").join(split, "bucket"), "rest")
    if not rest.isEmpty():
        links = links.unionByName(materialize(_rest_links(rest, packed, percent), "links"))
        labels = components(links)

    named = classes.select("node", "least", "top").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = named.groupBy("label").agg(F.min("least").alias("component_id"), F.min("top").alias("top"))
    of = named.drop("top").join(least, "label").select(F.col("node").alias("set_key"), "component_id", "top")
    out = sig.select("doc_id", "text_hash", "n_shingles", "set_key").join(of, "set_key", "left")
    out = out.withColumn("component_id", F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    kept = F.col("doc_id").eqNullSafe(F.col("component_id"))
    if by_row:
        kept = F.col("set_key").isNull() | F.col("doc_id").eqNullSafe(F.col("top.doc_id")) & (F.col("text_hash") == F.col("top.text_hash"))
    return out.select("doc_id", "text_hash", "n_shingles", "set_key", "component_id", kept.alias("kept"))


def _packed(docs: DataFrame, sig: DataFrame, reps: DataFrame) -> DataFrame:
    """node, packed of the classes that are candidates, made again from one text of each (node, doc_id, text_hash)."""
    texts = docs.filter("text is not null").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    key = ["doc_id", "text_hash"]
    found = sets_of(texts.alias("t").join(reps.alias("r"), same("t", "r", key)).select("r.node", "t.text"))
    again = sig.filter("set_key is not null").groupBy(*key).count().filter("count > 1")
    if not again.alias("a").join(reps.alias("r"), same("a", "r", key), "left_semi").isEmpty():  # repeated rows give a class its set again
        found = found.dropDuplicates(["node"])
    return found


def _rest_links(rest: DataFrame, packed: DataFrame, percent: int) -> DataFrame:
    """Links in buckets with several components: blocks of members, every two blocks once."""
    dealt = rest.withColumn("k", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("own", F.pmod(F.xxhash64("node"), "k").cast("int"))
    pairs = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    pairs = pairs.select("bucket", "node", "label", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    rows = pairs.join(packed, "node").repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    return rows.select("bucket", "i", "j", "node", "label", "packed").mapInArrow(lambda b: confirm_blocks(b, percent), "a binary, b binary")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("set_key", "text_hash")


def keep_near(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The documents, all columns, of which exactly one stands for each group; documents without words all stay.

    Rows are told apart by doc_id and a hash of the text; of those that agree in both, any one stays.
    """
    marks = near_duplicates(docs.select("doc_id", "text"), percent, by_row=True).filter("set_key is not null").select("doc_id", "text_hash", "kept")
    marks = materialize(marks, "near")
    key = ["doc_id", "text_hash"]
    out = rows_of(docs, doc_id="doc_id", text_hash=F.xxhash64("text")).alias("a").join(marks.filter("not kept").alias("b"), same("a", "b", key), "left_anti")
    tied = materialize(marks.filter("kept").groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "tied")
    if not tied.isEmpty():
        alike = out.alias("a").join(tied.alias("b"), same("a", "b", key), "left_semi")
        out = out.alias("a").join(tied.alias("b"), same("a", "b", key), "left_anti").unionByName(alike.dropDuplicates(key))
    return out.select("row.*")
