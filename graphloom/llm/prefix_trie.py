"""Conversation prefix trie by partition refinement: one class at first, split turn by turn, folded back to its root.

A class holds the conversations that agree in their first d turns; it is a node of the trie, named by its smallest
member and d. A round takes the classes that are still large, and splits each by its members' next turn; the members
of a class meet by a groupBy with map-side counts, and the few classes that hold a thousandth of all conversations or
more label theirs by a broadcast of at most a thousand rows, so no task gets a hot class. A class of one member is
retired: what it still has to come is a chain of nodes with one child each, which every turn states by itself. Classes
with at most ``LOCAL_ROWS`` members and turns to come are dealt over tasks, whole, and refined there in the same way, by array
operations over many classes at once. Afterwards sums over subtrees are folded back, level by level, over the large
classes alone. There are as many rounds as the deepest large class has turns.

Turns are known by a 128-bit digest of role and text; texts are read once and never shuffled. Rows with a null conv_id
belong to no conversation and are left out. A null role or text is empty. Turns come by turn, null first, then by role
and digest; repeated rows are turns of their own. A very long conversation is dealt over ranges of its rows, and met
with its class block by block. The members that end at one node are streamed through one task in order, since their
digest is of one text; memory stays bounded. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import discard, materialize, same

LOCAL_ROWS = 1 << 14  # members and turns to come of a class that a task refines by itself
BLOCK = 4096  # turns of a conversation that are met with its class under one key
HOT_SHARE = 1000  # a class with one in so many of a round's members is labelled by broadcast
BATCH_ROWS = 1 << 16  # turns that a task refines at once, in whole classes
NOTHING = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def numbered(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, at (from 0), key, bytes of every turn, and conv, n of every conversation.

    Rows are dealt by ranges of (conv, turn, role, key), so that a conversation of any length is ordered in parts, and
    equal rows are counted before they are dealt. Both tables are written.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    rows = turns.filter("conv_id IS NOT NULL").select(F.col("conv_id").cast("long").alias("conv"), "turn", role.alias("role"), digest.alias("key"), F.octet_length(text).cast("long").alias("bytes"))
    alike = rows.groupBy("conv", "turn", "role", "key", "bytes").agg(F.count(F.lit(1)).alias("n"))
    order = [F.asc_nulls_first("turn"), "role", "key"]
    dealt = materialize(alike.repartitionByRange("conv", *order).withColumn("bucket", F.spark_partition_id()), "turns")
    counts = materialize(dealt.groupBy("conv", "bucket").agg(F.sum("n").alias("n")), "counts")
    earlier = W.partitionBy("conv").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)  # a row for each task
    before = counts.select("conv", "bucket", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    own = W.partitionBy("conv", "bucket").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    first = F.col("before") + F.coalesce(F.sum("n").over(own), F.lit(0))
    placed = dealt.join(before, ["conv", "bucket"]).withColumn("first", first)
    out = placed.select("conv", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("at"), "key", "bytes")
    return out, counts.groupBy("conv").agg(F.sum("n").alias("n"))


def borrowed(c: Column) -> Column:
    """How many turns a conversation takes from the one it goes back to: unsigned crc32(decimal c) % 9."""
    return F.crc32(c.cast("string").cast("binary")) % 9


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conv, depth (from 1), key, bytes of every rebuilt turn, and conv, length of every conversation; both written.

    Conversation c begins with the first turns of c - c % 5 (% as in SQL, towards zero), and goes on with its own. At
    most nine conversations go back to one, with at most eight turns each; what a conversation's rows need to know is
    joined by conversation and range.
    """
    at, lengths = numbered(turns)
    at, lengths = materialize(at, "numbered"), materialize(lengths, "lengths")
    convs = lengths.select("conv", "n", (F.col("conv") - F.col("conv") % 5).alias("base"), borrowed(F.col("conv")).alias("h"))
    base = lengths.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = convs.join(base, "base", "left").withColumn("taken", F.least("h", F.coalesce("base_n", F.lit(0))))
    convs = materialize(convs.select("conv", "base", "h", "taken", (F.col("taken") + F.greatest(F.col("n") - F.col("h"), F.lit(0))).alias("length")), "convs")
    own = at.withColumn("block", F.floor(F.col("at") / BLOCK))
    blocks = lengths.select("conv", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / BLOCK))).alias("block"))
    shift = blocks.join(convs.select("conv", "h", "taken"), "conv")
    kept = own.join(shift, ["conv", "block"]).filter("at >= h").select("conv", (F.col("taken") + F.col("at") - F.col("h") + 1).alias("depth"), "key", "bytes")
    first = at.filter("at < 8").select(F.col("conv").alias("base"), "at", "key", "bytes")
    given = first.join(convs, "base").filter("at < h").select("conv", (F.col("at") + 1).alias("depth"), "key", "bytes")
    rows = materialize(kept.unionByName(given).sortWithinPartitions("depth"), "rebuilt")  # a round reads one depth
    discard(at, lengths)
    return rows, convs.select("conv", "length")


def labelled(members: DataFrame, depth: int) -> DataFrame:
    """The members with their class after a split: top (smallest member), parent, n, kind.

    Members of a class agree in the class that they come from and in their next turn. Large classes, at most HOT_SHARE of them, reach their members by
    broadcast, and only the others are shuffled to meet their members.
    """
    by, rest = ["old", "key", "bytes"], F.sum(F.col("length") - depth)
    classes = members.groupBy(*by).agg(F.min("conv").alias("top"), F.count(F.lit(1)).alias("n"), rest.alias("rest"))
    kind = F.when(F.col("n") == 1, "chain").when(F.col("n") + F.col("rest") <= LOCAL_ROWS, "local").otherwise("large")
    classes = materialize(classes.withColumn("kind", kind), "classes")
    least = classes.agg(F.sum("n")).first()[0] // HOT_SHARE + 1
    hot = F.broadcast(classes.filter(F.col("n") >= least))
    known = [F.col(c) for c in ("top", "n", "kind")]
    near = members.alias("m").join(hot.alias("c"), same("m", "c", by)).select("m.*", *known)
    far = members.alias("m").join(hot.alias("c"), same("m", "c", by), "left_anti").join(classes.filter(F.col("n") < least).alias("c"), same("m", "c", by)).select("m.*", *known)
    return near.unionByName(far).withColumnRenamed("old", "parent").drop("key")


def refine(rows: DataFrame, convs: DataFrame) -> list[DataFrame]:
    """Members by round: conv, length, depth, top, parent, n, bytes (of the class's last text), kind; all written."""
    whole = convs.agg(F.min("conv").alias("top"), F.count(F.lit(1)).alias("n"), F.sum("length").alias("rest")).first()
    kind = "chain" if whole.n == 1 else "local" if whole.n + whole.rest <= LOCAL_ROWS else "large"
    zero = F.lit(0).cast("long")
    first = {"depth": zero, "top": F.lit(whole.top), "parent": F.lit(None).cast("long"), "n": F.lit(whole.n).cast("long"), "bytes": zero, "kind": F.lit(kind)}
    state = materialize(convs.select("conv", "length", *(v.cast("long").alias(k) if k != "kind" else v.alias(k) for k, v in first.items())), "members")
    out = [state]
    while not (large := state.filter("kind = 'large'")).isEmpty():
        d = len(out)
        turn = rows.filter(F.col("depth") == d).select("conv", "key", "bytes")
        members = materialize(large.select("conv", "length", F.col("top").alias("old")).join(turn, "conv"), "split")
        if members.isEmpty():  # every member of every large class has ended
            break
        state = materialize(labelled(members, d).withColumn("depth", F.lit(d).cast("long")), "members")
        out.append(state)
        discard(members)
    return out


LOCAL = "top long, parent long, start long, top_bytes long, conv long, depth long, hi long, lo long, bytes long"


def refine_here(top: np.ndarray, parent: np.ndarray, start: np.ndarray, top_bytes: np.ndarray, conv: np.ndarray, depth: np.ndarray, hi: np.ndarray, lo: np.ndarray, size: np.ndarray) -> dict[str, list]:
    """The nodes of whole classes, sorted by (top, conv, depth); a member's first row is its place in the class.

    Classes are split by their members' next turn, all classes at once, until each has one member; then the sums of
    every node go to its parent, deepest first.
    """
    n_rows = len(top)
    first = np.flatnonzero(np.append(True, conv[1:] != conv[:-1])) if n_rows else np.zeros(0, np.int64)
    turns = np.diff(np.append(first, n_rows)) - 1
    out: dict[str, list] = {"conv_id": [], "depth": [], "parent": [], "n": [], "children": [], "leaves": [], "saved": [], "ends": [], "is_top": []}
    levels = []  # of each level: node columns, and the number of each node's parent in the level above
    member, group = np.arange(len(first)), np.unique(top[first], return_inverse=True)[1] if n_rows else np.zeros(0, np.int64)
    above, t = None, 0
    while len(member):
        head = np.flatnonzero(np.append(True, group[1:] != group[:-1]))
        count = np.diff(np.append(head, len(member)))
        at = first[member[head]]
        over = turns[member] == t
        ends: list[list[int]] = [[] for _ in head]
        owner = np.repeat(np.arange(len(head)), count)
        for k, c in zip(owner[over].tolist(), conv[first[member[over]]].tolist(), strict=True):
            ends[k].append(c)
        last = size[at + t] if t else top_bytes[at]
        levels.append({"conv": conv[at], "depth": start[at] + t, "parent": parent[at] if above is None else None, "above": above, "n": count, "bytes": last, "ends": ends})
        single = count == 1
        for k in np.flatnonzero(single).tolist():  # retired: its tail is a chain
            m = member[head[k]]
            c, d, more = int(conv[at[k]]), int(start[at[k]]) + t, int(turns[m]) - t
            for step in range(1, more + 1):
                name = hashlib.sha256(str(c).encode()).hexdigest() if step == more else NOTHING
                for column, value in zip(out.values(), (c, d + step, c, 1, int(step < more), 1, 0, name, False), strict=True):
                    column.append(value)
        levels[-1]["tail"] = np.where(single, turns[member[head]] > t, False)
        go = ~over & ~single[owner]
        member, owner, t = member[go], owner[go], t + 1
        row = first[member] + t
        order = np.lexsort((member, lo[row], hi[row], owner))
        member, owner, row = member[order], owner[order], row[order]
        new = np.append(True, (owner[1:] != owner[:-1]) | (hi[row[1:]] != hi[row[:-1]]) | (lo[row[1:]] != lo[row[:-1]])) if len(row) else np.zeros(0, bool)
        group, above = np.cumsum(new) - 1, owner[new]
    children = leaves = saved = np.zeros(0, np.int64)
    for k in range(len(levels) - 1, -1, -1):
        x = levels[k]
        n_nodes = len(x["conv"])
        own_children, own_leaves, own_saved = x["tail"].astype(np.int64), np.zeros(n_nodes, np.int64), (x["n"] - 1) * x["bytes"]
        if k + 1 < len(levels):
            up = levels[k + 1]["above"]
            np.add.at(own_children, up, 1)
            np.add.at(own_leaves, up, leaves)
            np.add.at(own_saved, up, saved)
        own_leaves = np.maximum(own_leaves, 1)
        above_conv = x["parent"] if x["parent"] is not None else levels[k - 1]["conv"][x["above"]]
        names = [hashlib.sha256(",".join(map(str, e)).encode()).hexdigest() if e else NOTHING for e in x["ends"]]
        for column, values in zip(out.values(), (x["conv"], x["depth"], above_conv, x["n"], own_children, own_leaves, own_saved, names, [k == 0] * n_nodes), strict=True):
            column.extend(values if isinstance(values, list) else values.tolist())
        children, leaves, saved = own_children, own_leaves, own_saved
    return out


FOLDED = NODES.replace("string", "string, is_top boolean")


def local_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of LOCAL, sorted by (start, top, conv, depth): nodes of whole classes, some at a time."""
    names = [f.split()[0] for f in LOCAL.split(", ")]
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
    columns = [f.split()[0] for f in FOLDED.split(", ")]

    def out(parts: list[list[np.ndarray]]) -> pa.RecordBatch:
        joined = [np.concatenate(c) for c in zip(*parts, strict=True)]
        nodes = refine_here(*joined)
        root = nodes["parent"]
        nodes["parent"] = [None if p == -(1 << 63) else p for p in root]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(nodes.values(), types, strict=True)], columns)

    waiting: list[list[np.ndarray]] = []
    size = 0
    for batch in batches:
        own = [batch.column(c).to_numpy(zero_copy_only=False) for c in names]
        while len(own[0]):
            # Classes of one start at a time, in the order of their tops.
            edge = np.flatnonzero(np.diff(own[0]) | np.diff(own[2]))
            if size >= BATCH_ROWS:  # stop where the class that is open ends
                prior = waiting[-1]
                open_one = prior[0][-1] == own[0][0] and prior[2][-1] == own[2][0]
                stop = 0 if not open_one else int(edge[0]) + 1 if len(edge) else len(own[0])
                if stop:
                    waiting.append([c[:stop] for c in own])
                    own = [c[stop:] for c in own]
                if len(own[0]):
                    yield out(waiting)
                    waiting, size = [], 0
            else:
                stop = len(own[0])
                waiting.append(own)
                size += stop
                own = [c[stop:] for c in own]
    if waiting:
        yield out(waiting)


def with_tails(members: DataFrame, rows: DataFrame) -> DataFrame:
    """The members' columns beside each of their turns to come; a conversation meets its class block by block."""
    blocks = F.sequence(F.floor(F.col("depth") / BLOCK), F.floor(F.col("length") / BLOCK))
    m = members.filter("length > depth").withColumn("block", F.explode(blocks))
    r = rows.select("conv", F.floor(F.col("depth") / BLOCK).alias("block"), F.col("depth").alias("own"), "key", F.col("bytes").alias("own_bytes"))
    return m.join(r, ["conv", "block"]).filter("own > depth")


def nodes_of_small(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes, with is_top, of the classes that are refined by one task each."""
    eight = lambda k: F.conv(F.hex(F.substring("key", k, 7)), 16, 10).cast("long")
    place = members.select("top", F.coalesce("parent", F.lit(-(1 << 63)).cast("long")).alias("parent"), F.col("depth").alias("start"), F.col("bytes").alias("top_bytes"), "conv", "depth", F.lit(0).cast("long").alias("hi"), F.lit(0).cast("long").alias("lo"), F.lit(0).cast("long").alias("bytes"))
    to_come = with_tails(members, rows).select("top", F.coalesce("parent", F.lit(-(1 << 63)).cast("long")).alias("parent"), F.col("depth").alias("start"), F.col("bytes").alias("top_bytes"), "conv", F.col("own").alias("depth"), eight(1).alias("hi"), eight(8).alias("lo"), F.col("own_bytes").alias("bytes"))
    dealt = place.unionByName(to_come).repartition("top", "start").sortWithinPartitions("start", "top", "conv", "depth")
    return dealt.mapInArrow(local_nodes, FOLDED)


def nodes_of_single(members: DataFrame, rows: DataFrame) -> DataFrame:
    """Nodes, with is_top, of retired conversations: the one where it is alone, and a chain below it."""
    name = F.sha2(F.col("conv").cast("string"), 256)
    one, none, nothing = F.lit(1).cast("long"), F.lit(0).cast("long"), F.lit(NOTHING)

    def node(depth: Column, parent: Column, more: Column, is_top: bool) -> list[Column]:
        return [F.col("conv").alias("conv_id"), depth.alias("depth"), parent.alias("parent_conv_id"), one.alias("n_convs"), more.cast("long").alias("n_children"), one.alias("n_leaves"), none.alias("saved_tokens"), F.when(more, nothing).otherwise(name).alias("ends_sha256"), F.lit(is_top).alias("is_top")]

    tops = members.select(*node(F.col("depth"), F.col("parent"), F.col("length") > F.col("depth"), True))
    return tops.unionByName(with_tails(members, rows).select(*node(F.col("own"), F.col("conv"), F.col("length") > F.col("own"), False)))


def ends_of(members: DataFrame) -> DataFrame:
    """conv_id, depth, ends_sha256 of the large classes in which a member ends; each is streamed through one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, done = None, None, []
        for batch in batches:
            for top, depth, conv in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (top, depth) != key:
                    if key:
                        done.append((*key, digest.hexdigest()))
                    key, digest = (top, depth), hashlib.sha256(str(conv).encode())
                else:
                    digest.update(b",%d" % conv)
        if key:
            done.append((*key, digest.hexdigest()))
        columns = zip(*done, strict=True) if done else [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string()), strict=True)], ["conv_id", "depth", "ends_sha256"])

    ended = members.filter("length = depth").select("top", "depth", "conv")
    return ended.repartition("top", "depth").sortWithinPartitions("top", "depth", "conv").mapInArrow(run, "conv_id long, depth long, ends_sha256 string")


def trie(turns: DataFrame) -> DataFrame:
    """Every node of the trie over rebuilt conversations, as NODES; turns: conv_id, turn, role, text."""
    rows, convs = rebuilt(turns)
    return trie_of(rows, convs)


def trie_of(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """Every node of the trie; rows: conv, depth, key, bytes; convs: conv, length, which turnless ones are among."""
    spark = rows.sparkSession
    rounds = refine(rows, convs) if not convs.isEmpty() else []
    if not rounds:
        return spark.createDataFrame([], NODES)
    every = rounds[0]
    for m in rounds[1:]:
        every = every.unionByName(m)
    settled = nodes_of_small(every.filter("kind = 'local'"), rows).unionByName(nodes_of_single(every.filter("kind = 'chain'"), rows))
    settled = materialize(settled, "settled")
    ends = materialize(ends_of(every.filter("kind = 'large'")), "ends")
    sums = [F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("n_leaves"), F.sum("saved_tokens").alias("below")]
    out, level = settled.drop("is_top"), None
    for depth in range(len(rounds) - 1, -1, -1):
        own = rounds[depth].filter("kind = 'large'").select(F.col("top").alias("conv_id"), F.col("parent").alias("parent_conv_id"), "depth", F.col("n").alias("n_convs"), "bytes").distinct()
        below = settled.filter(F.col("is_top") & (F.col("depth") == depth + 1)).select("parent_conv_id", "n_leaves", "saved_tokens")
        if level is not None:
            below = below.unionByName(level.select("parent_conv_id", "n_leaves", "saved_tokens"))
        below = below.groupBy(F.col("parent_conv_id").alias("conv_id")).agg(*sums)
        nodes = own.join(below, "conv_id", "left").join(ends, ["conv_id", "depth"], "left")
        level = materialize(nodes.select(
            "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"), F.coalesce("n_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("below", F.lit(0)) + (F.col("n_convs") - 1) * F.col("bytes")).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(NOTHING)).alias("ends_sha256"),
        ), "folded")
        out = out.unionByName(level)
    return out


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text"))


_CRC = "xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(CAST(c AS VARCHAR), ''), lambda x: ascii(x)::BIGINT)), lambda r, b: list_reduce(list_prepend(xor(r, b), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda s, z: xor(s >> 1, (s & 1) * 3988292384))), 4294967295)"
OP12_SQL = f"""
WITH t AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(len(role) || ':' || role || text)) AS p, role, text
  FROM (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL)),
v AS (SELECT c, {_CRC} % 9 AS h FROM (SELECT DISTINCT c FROM t)),
r AS (SELECT v.c, 0 AS part, p, role, text FROM v JOIN t ON t.c = v.c - v.c % 5 AND p <= h UNION ALL SELECT v.c, 1, p, role, text FROM v JOIN t ON t.c = v.c AND p > h),
s AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY part, p) AS d, sha256(len(role) || ':' || role || text) AS k, strlen(text) AS b FROM r),
m AS MATERIALIZED (SELECT c, 0 AS d, '' AS path, 0 AS b FROM v UNION ALL SELECT c, d, sha256(string_agg(k, '' ORDER BY d) OVER (PARTITION BY c ORDER BY d)), b FROM s),
e AS (SELECT c, max(d) AS size FROM m GROUP BY c),
n AS MATERIALIZED (SELECT d, path, min(c) AS top, count(*) AS n, min(b) AS b, coalesce(string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) FILTER (d = size), '') AS ends FROM m JOIN e USING (c) GROUP BY d, path),
g AS MATERIALIZED (SELECT m.c, m.d, n.top FROM m JOIN n USING (d, path)),
k AS MATERIALIZED (SELECT n.*, g.top AS parent FROM n LEFT JOIN g ON g.c = n.top AND g.d = n.d - 1),
ch AS (SELECT parent AS top, d - 1 AS d, count(*) AS children FROM k WHERE d > 0 GROUP BY 1, 2),
l AS MATERIALIZED (SELECT k.*, coalesce(children, 0) AS children FROM k LEFT JOIN ch USING (top, d)),
sub AS (SELECT g.top, g.d, count(*) FILTER (l.children = 0) AS leaves, sum((l.n - 1) * l.b) AS saved FROM l JOIN g ON g.c = l.top AND g.d <= l.d GROUP BY 1, 2)
SELECT top AS conv_id, CAST(d AS BIGINT) AS depth, parent AS parent_conv_id, n AS n_convs, children AS n_children, leaves AS n_leaves, CAST(saved AS BIGINT) AS saved_tokens, sha256(ends) AS ends_sha256
FROM l JOIN sub USING (top, d)
"""
