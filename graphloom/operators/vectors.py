"""Vector search: an inverted-list index that is kept up by id, exact block search, and a hashing vectoriser.

The index deals unit vectors to the nearest of a bounded number of centroids, fitted on a bounded sample; every row is
in one list, and a list of any size is searched in blocks. A query set is dealt to the lists that it asks for, and
meets their rows block by block as a matrix product; each block sends on its best few rows for each query. With a
threshold, the lists to ask follow from angles: a row within the angle of a query lies in a list whose centroid is no
further than that angle and the list's widest angle together, so nothing is missed. Without one, the nearest
``probes`` lists are asked; how many reach the wanted recall is measured on the sample.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.plans.rounds import shared_dir, written
from graphloom.registry import query
from graphloom.session import table

SAMPLE = 16384  # rows that centroids and probes are fitted on: those with the smallest hashes of their ids
MOST_LISTS = 4096
FIT_ROUNDS = 8
WANTED_RECALL, RECALL_AT = 0.95, 5
BLOCK_ROWS, BLOCK_QUERIES = 8192, 512  # of one matrix product
DIGITS = 12  # similarities are rounded, so that equal ones are ties, which go by id
MATCH_THRESHOLD = 0.82  # fixed value: a title's nearest module must be as similar as this
DIMENSIONS = 64


def matrix(column: pa.Array | pa.ChunkedArray, n: int) -> np.ndarray:
    flat = column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def lists_of(values: np.ndarray) -> pa.ListArray:
    ends = np.arange(len(values) + 1, dtype=np.int32) * (values.shape[1] if values.ndim > 1 else 0)
    return pa.ListArray.from_arrays(ends, values.ravel())


def unit(vectors: DataFrame, dimensions: int | None = None) -> DataFrame:
    """The rows with v scaled to length 1; those whose v is null, zero, not finite or of another length are left out."""
    dimensions = dimensions or vectors.agg(F.max(F.size("v"))).first()[0] or 0
    others = [c for c in vectors.columns if c != "v"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = batch.column("v").value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
            right = np.flatnonzero(size == dimensions)
            x = matrix(batch.column("v").take(pa.array(right)), len(right))
            norm = np.sqrt((x * x).sum(axis=1))
            good = np.flatnonzero(np.isfinite(norm) & (norm > 0))
            kept = pa.array(right[good])
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(kept) for c in others), lists_of(x[good] / norm[good, None])], [*others, "v"])

    schema = ", ".join(f"`{c}` {vectors.schema[c].dataType.simpleString()}" for c in others)
    return vectors.select(*others, F.col("v").cast("array<double>").alias("v")).mapInArrow(run, f"{schema}, v array<double>")


def best_rows(sims: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest of each row that are over -2, equal ones by smaller id."""
    rows, columns = [], []
    for i, s in enumerate(sims):
        least = np.partition(s, len(s) - k)[len(s) - k] if len(s) > k else -2.0
        found = np.flatnonzero((s >= least) & (s > -2))
        found = found[np.lexsort((ids[found], -s[found]))][:k]
        rows.append(np.full(len(found), i))
        columns.append(found)
    return (np.concatenate(rows), np.concatenate(columns)) if rows else (np.zeros(0, int), np.zeros(0, int))


def block_search(rows: DataFrame, queries: DataFrame, k: int, least: float | None = None) -> DataFrame:
    """query_id, id, sim: of each query, the k nearest rows of its group (at least ``least``), without itself.

    rows: grp, id, v; queries: grp, query_id, v, a query possibly in several groups; v of length 1. A group of any size
    is cut into blocks of rows and of queries, and every two of them meet in one matrix product.
    """
    size = rows.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).join(queries.groupBy("grp").agg(F.count(F.lit(1)).alias("m")), "grp")
    size = size.select("grp", F.ceil(F.col("n") / BLOCK_ROWS).alias("rb"), F.ceil(F.col("m") / BLOCK_QUERIES).alias("qb"))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    r = rows.join(size, "grp").select("grp", F.pmod(F.xxhash64("id"), F.col("rb")).alias("i"), all_of("qb").alias("j"), "id", "v")
    q = queries.join(size, "grp").select(F.col("grp").alias("to"), all_of("rb").alias("a"), F.pmod(F.xxhash64("query_id"), F.col("qb")).alias("b"), "query_id", F.col("v").alias("qv"))

    def match(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, names = left.column("id").to_numpy(), right.column("query_id").to_numpy()
        if len(ids) and len(names):
            sims = np.round(matrix(right.column("qv"), len(names)) @ matrix(left.column("v"), len(ids)).T, DIGITS)
            sims[names[:, None] == ids] = -3.0
            if least is not None:
                sims[sims < least] = -3.0
            a, b = best_rows(sims, ids, k)
            names, ids, sims = names[a], ids[b], sims[a, b]
        else:
            names, ids, sims = names[:0], ids[:0], np.zeros(0)
        return pa.table({"query_id": pa.array(names, pa.int64()), "id": pa.array(ids, pa.int64()), "sim": pa.array(sims, pa.float64())})

    near = r.groupBy("grp", "i", "j").cogroup(q.groupBy("to", "a", "b")).applyInArrow(match, "query_id long, id long, sim double")
    own = W.partitionBy("query_id").orderBy(F.desc("sim"), "id")  # k rows for each block that the query met
    return near.withColumn("rn", F.row_number().over(own)).filter(F.col("rn") <= k).drop("rn")


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Unit centroids of a sample of unit vectors; the start is every so many rows of the sample."""
    centroids = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(FIT_ROUNDS):
        own = (sample @ centroids.T).argmax(axis=1)
        total = np.zeros_like(centroids)
        np.add.at(total, own, sample)
        norm = np.sqrt((total * total).sum(axis=1))
        centroids[norm > 0] = total[norm > 0] / norm[norm > 0, None]
    return centroids


def probes_for(sample: np.ndarray, centroids: np.ndarray, recall: float = WANTED_RECALL, k: int = RECALL_AT) -> int:
    """The fewest nearest lists that hold ``recall`` of the k nearest sample rows of every so many sample rows."""
    own = (sample @ centroids.T).argmax(axis=1)
    asked = np.linspace(0, len(sample) - 1, min(len(sample), 256)).astype(int)
    sims = sample[asked] @ sample.T
    sims[np.arange(len(asked)), asked] = -3.0
    near = np.argsort(-sims, axis=1)[:, : min(k, len(sample) - 1)]
    place = np.argsort(np.argsort(-(sample[asked] @ centroids.T), axis=1), axis=1)  # of each list, by nearness
    needed = np.sort(np.take_along_axis(place, own[near], axis=1).ravel())
    return int(needed[math.ceil(recall * len(needed)) - 1]) + 1 if len(needed) else 1


class VectorIndex:
    """Rows (id, v, angle) in folders by list, and the centroids, which alone are held by the driver."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        c = spark.read.parquet(f"{path}/centroids").orderBy("list").collect()  # MOST_LISTS rows at most
        self.centroids, self.probes = np.array([r.v for r in c]), c[0].probes if c else 1

    @classmethod
    def build(cls, vectors: DataFrame, path: str, lists: int | None = None) -> VectorIndex:
        """vectors: id (long, not null, told apart), v. About the root of their number as lists, MOST_LISTS at most."""
        spark = vectors.sparkSession
        u = written(unit(vectors.select("id", "v")), "vectors")
        n = u.count()
        picked = u.select("id", "v", F.xxhash64("id").alias("h")).orderBy("h", "id").limit(SAMPLE).select("v").toArrow()
        sample = matrix(picked.column("v"), picked.num_rows)
        lists = min(lists or max(1, round(math.sqrt(n))), MOST_LISTS, max(1, len(sample) // 4))
        centroids = fitted(sample, lists) if n else np.zeros((0, 0))
        probes = probes_for(sample, centroids) if n else 1
        known = [(k, c.tolist(), probes) for k, c in enumerate(centroids)]
        spark.createDataFrame(known, "list int, v array<double>, probes int").coalesce(1).write.parquet(f"{path}/centroids")
        index = cls(spark, path)
        index._write(index._dealt(u), "errorifexists")
        return index

    def _write(self, dealt: DataFrame, mode: str) -> None:
        dealt.hint("rebalance", "list").write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy("list").parquet(f"{self.path}/rows")

    @property
    def rows(self) -> DataFrame:
        return self.spark.read.schema("id long, v array<double>, angle double, list int").parquet(f"{self.path}/rows")

    def _dealt(self, u: DataFrame) -> DataFrame:
        centroids = self.centroids

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                sims = matrix(batch.column("v"), batch.num_rows) @ centroids.T
                own = sims.argmax(axis=1)
                angle = np.arccos(np.clip(sims[np.arange(len(own)), own], -1, 1))
                yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("v"), pa.array(angle), pa.array(own.astype(np.int32))], ["id", "v", "angle", "list"])

        return u.select("id", "v").mapInArrow(run, "id long, v array<double>, angle double, list int")

    def search(self, queries: DataFrame, k: int = 5, probes: int | None = None, least: float | None = None) -> DataFrame:
        """query_id, id, sim. With ``least`` whole; else from the ``probes`` nearest lists (as fitted, if not given).

        queries: query_id (long), v.
        """
        if not len(self.centroids):
            return self.spark.createDataFrame([], "query_id long, id long, sim double")
        centroids, wanted = self.centroids, min(probes or self.probes, len(self.centroids))
        reach = np.full(len(centroids), -np.inf)
        if least is not None:
            for r in self.rows.groupBy("list").agg(F.max("angle").alias("a")).collect():  # a row for each list
                reach[r.list] = r.a + math.acos(least) + 1e-6

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                sims = matrix(batch.column("v"), batch.num_rows) @ centroids.T
                if least is not None:
                    who, where = np.nonzero(np.arccos(np.clip(sims, -1, 1)) <= reach)
                else:
                    where = np.argsort(-sims, axis=1, kind="stable")[:, :wanted]
                    who, where = np.repeat(np.arange(len(sims)), wanted), where.ravel()
                at = pa.array(who)
                yield pa.RecordBatch.from_arrays([pa.array(where.astype(np.int32)), batch.column("query_id").take(at), batch.column("v").take(at)], ["grp", "query_id", "v"])

        asked = unit(queries.select("query_id", "v"), centroids.shape[1]).mapInArrow(run, "grp int, query_id long, v array<double>")
        return block_search(self.rows.select(F.col("list").alias("grp"), "id", "v"), asked, k, least)

    def upsert(self, changed: DataFrame) -> list[int]:
        """Puts rows (id, v) in place of those with their ids; one with a null v goes. Rewrites the lists it touches alone.

        Returns their numbers. The new rows of a list are written beside the old ones before they take their place; a
        rerun after a failure gives the same rows.
        """
        ids = written(changed.select("id", "v"), "changed")
        new = self._dealt(unit(ids, self.centroids.shape[1]))
        old = self.rows.select("id", "list").join(ids.select("id"), "id", "left_semi")
        touched = sorted(r[0] for r in old.select("list").union(new.select("list")).distinct().collect())
        kept = self.rows.filter(F.col("list").isin(touched)).join(ids.select("id"), "id", "left_anti").select("id", "v", "angle", "list")
        merged = written(kept.unionByName(new), "merged")
        self._write(merged, "overwrite")
        left = {r[0] for r in merged.select("list").distinct().collect()}
        for k in set(touched) - left:  # a list that lost its last row isn't written anew
            p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/rows/list={k}")
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        return touched


def grams(text: Column) -> Column:
    """Words and letter triples of the words, marked at both ends, of a text in normal form."""
    words = F.filter(F.split(F.btrim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")
    triples = F.flatten(F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w)), lambda k: F.substring(F.concat(F.lit("<"), w, F.lit(">")), k, F.lit(3)))))
    return F.concat(words, triples)


def hashed_vectors(texts: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    """id, v: signed counts of the text's grams by hash; id, text in. A text without any has no row.

    A gram's MD5 gives its place (eight digits) and its sign (the ninth). Counts are added up before they are shuffled;
    a vector is gathered from at most ``dimensions`` of them.
    """
    g = texts.select("id", F.explode(grams(F.coalesce("text", F.lit("")))).alias("g")).withColumn("h", F.md5("g"))
    place = (F.conv(F.substring("h", 1, 8), 16, 10).cast("long") % dimensions).cast("int")
    sign = F.when(F.substring("h", 9, 1) < "8", 1).otherwise(-1)
    counts = g.groupBy("id", place.alias("k")).agg(F.sum(sign).cast("double").alias("w"))
    found = counts.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("k", "w"))).alias("m"))
    dense = F.transform(F.sequence(F.lit(0), F.lit(dimensions - 1)), lambda k: F.coalesce(F.try_element_at("m", k), F.lit(0.0)))
    return found.select("id", dense.alias("v"))


def embeddings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v"))


def asked(vectors: DataFrame) -> DataFrame:
    """The stated query set: ids divisible by 100, against all rows."""
    return vectors.filter("id % 100 = 0").withColumnRenamed("id", "query_id")


def new_index(vectors: DataFrame, lists: int | None = None) -> VectorIndex:
    spark = vectors.sparkSession
    return VectorIndex.build(vectors, f"{shared_dir(spark)}/graphloom/index-{uuid.uuid4().hex}", lists)


COSINE_SQL = "list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[]))"


def labelled(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    u = written(unit(table(spark, sf, "embeddings").select(F.col("label").alias("grp"), F.col("vec_id").alias("id"), F.col("embedding").alias("v"))), "labelled")
    return u, asked(u)


@query("vec_top_k", f"SELECT q.vec_id AS query_id, e.vec_id, round({COSINE_SQL}, 4) AS sim FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE_SQL} DESC, e.vec_id) <= 5")
def top_k(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Filtered top-k by cosine, exact: a stated set of queries against the rows of their label, in blocks."""
    return block_search(*labelled(spark, sf), k).select("query_id", F.col("id").alias("vec_id"), F.round("sim", 4).alias("sim"))


@query("vec_thresholded_top", f"SELECT q.vec_id AS query_id, e.vec_id, round({COSINE_SQL}, 4) AS sim FROM embeddings q JOIN embeddings e ON q.label = e.label AND q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 AND {COSINE_SQL} >= .2 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE_SQL} DESC, e.vec_id) = 1")
def thresholded_top(spark: SparkSession, sf: str, least: float = 0.2) -> DataFrame:
    """The nearest row of each query, if it is near enough."""
    return block_search(*labelled(spark, sf), 1, least).select("query_id", F.col("id").alias("vec_id"), F.round("sim", 4).alias("sim"))


@query("vec_index_top_k")
def index_top_k(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """The k nearest of all rows, by the index; no SQL, since a search by probes may miss some: see vec_index_recall."""
    e = embeddings(spark, sf)
    return new_index(e).search(asked(e), k).select("query_id", F.col("id").alias("vec_id"), F.round("sim", 4).alias("sim"))


@query("vec_index_recall", "SELECT count(*) AS queries, 5 * count(*) AS wanted, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def index_recall(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Whether the index finds nine of ten of the rows that a search of every list finds, which is exact."""
    e = embeddings(spark, sf)
    index = new_index(e)
    exact = written(index.search(asked(e), k, probes=len(index.centroids)), "exact")
    found = exact.join(index.search(asked(e), k).select("query_id", "id", F.lit(True).alias("hit")), ["query_id", "id"], "left")
    return found.agg(F.countDistinct("query_id").alias("queries"), F.count(F.lit(1)).alias("wanted"), (F.count("hit") >= 0.9 * F.count(F.lit(1))).alias("enough"))


CHANGED_SQL = "e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 3 THEN list_reverse(embedding) ELSE embedding END AS embedding FROM embeddings WHERE vec_id % 13 <> 5)"


@query("vec_index_upsert", f"WITH {CHANGED_SQL} SELECT q.vec_id AS query_id, e.vec_id, round({COSINE_SQL}, 4) AS sim FROM e q JOIN e ON q.vec_id <> e.vec_id WHERE q.vec_id % 100 = 0 QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY {COSINE_SQL} DESC, e.vec_id) <= 5")
def index_upsert(spark: SparkSession, sf: str, k: int = 5) -> DataFrame:
    """Search of every list after some rows took new vectors and others went, by id."""
    e = embeddings(spark, sf)
    index = new_index(e)
    new = e.filter("id % 7 = 3 OR id % 13 = 5").withColumn("v", F.when(F.col("id") % 13 == 5, F.lit(None)).when(F.col("id") % 7 == 3, F.reverse("v")))
    index.upsert(new)
    now = e.filter("id % 13 <> 5").withColumn("v", F.when(F.col("id") % 7 == 3, F.reverse("v")).otherwise(F.col("v")))
    return index.search(asked(now), k, probes=len(index.centroids)).select("query_id", F.col("id").alias("vec_id"), F.round("sim", 4).alias("sim"))


# Titles to be resolved: a map's name as it is, in other letters, by alias, with a doubled letter, or none at all.
TITLES_SQL = "t AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN ' ' || upper(p_name) || ' ' WHEN 2 THEN split_part(p_name, ' ', 2) WHEN 3 THEN left(p_name, 3) || substr(p_name, 3) ELSE 'no such thing' END AS title FROM part)"


def titles(spark: SparkSession, sf: str) -> DataFrame:
    name, k = F.col("p_name"), F.col("p_partkey") % 5
    title = F.when(k == 0, name).when(k == 1, F.concat(F.lit(" "), F.upper(name), F.lit(" "))).when(k == 2, F.get(F.split(name, " "), 1)).when(k == 3, F.concat(F.left(name, F.lit(3)), F.substr(name, F.lit(3)))).otherwise("no such thing")
    return table(spark, sf, "part").select("p_partkey", "p_name", title.alias("title"))


_NORMAL = r"trim(regexp_replace(lower(text), '[^\pL\pN]+', ' ', 'g'))"
_GRAM_SQL = "list_concat(string_split(n, ' '), flatten(list_transform(string_split(n, ' '), lambda w: list_transform(range(1, length(w) + 1), lambda k: substr('<' || w || '>', k, 3)))))"
_VECTOR_SQL = f"(SELECT key, CAST(('0x' || substr(h, 1, 8))::BIGINT % {DIMENSIONS} AS INTEGER) AS k, sum(CASE WHEN substr(h, 9, 1) < '8' THEN 1 ELSE -1 END) AS w FROM (SELECT key, md5(unnest({_GRAM_SQL})) AS h FROM (SELECT key, {_NORMAL} AS n FROM {{}}) WHERE n <> '') GROUP BY 1, 2)"
CASCADE_SQL = f"""WITH {TITLES_SQL}, n AS (SELECT p_name AS name, min(p_partkey) AS id FROM part GROUP BY 1), a AS (SELECT split_part(p_name, ' ', 2) AS alias, min(p_partkey) AS id FROM part GROUP BY 1),
two AS (SELECT p_partkey, title, n.id AS one, coalesce(m.id, a.id) AS two FROM t LEFT JOIN n ON n.name = title LEFT JOIN n m ON lower(m.name) = lower(trim(title)) LEFT JOIN a ON a.alias = lower(trim(title))),
lt AS (SELECT DISTINCT title AS key, title AS text FROM two WHERE one IS NULL AND two IS NULL), nt AS (SELECT id AS key, name AS text FROM n),
x AS {_VECTOR_SQL.format('lt')}, y AS {_VECTOR_SQL.format('nt')},
s AS (SELECT x.key AS title, y.key AS id, round(sum(x.w * y.w) / (sqrt((SELECT sum(w * w) FROM x z WHERE z.key = x.key)) * sqrt((SELECT sum(w * w) FROM y z WHERE z.key = y.key))), {DIGITS}) AS sim FROM x JOIN y USING (k) GROUP BY x.key, y.key),
b AS (SELECT title, arg_min(id, (-sim, id)) AS id, max(sim) AS sim FROM s WHERE sim >= {MATCH_THRESHOLD} GROUP BY 1)
SELECT p_partkey, coalesce(one, two, b.id) AS found, CASE WHEN one IS NOT NULL THEN 'exact' WHEN two IS NOT NULL THEN 'alias' WHEN b.id IS NOT NULL THEN 'similar' END AS stage, round(CASE WHEN one IS NULL AND two IS NULL THEN sim ELSE CASE WHEN coalesce(one, two) IS NOT NULL THEN 1.0 END END, 6) AS score FROM two LEFT JOIN b USING (title)"""


@query("join_cascade", CASCADE_SQL)
def cascade(spark: SparkSession, sf: str) -> DataFrame:
    """A title by its exact name, else by normal form or alias, else by the nearest vector above a threshold.

    What the first stages leave open is searched once for each different title, in the lists that can hold a match.
    """
    t = titles(spark, sf).withColumn("normal", F.lower(F.trim("title")))
    p = table(spark, sf, "part")
    n = p.groupBy(F.col("p_name").alias("title")).agg(F.min("p_partkey").alias("one"))
    m = n.select(F.lower("title").alias("normal"), F.col("one").alias("b"))
    alias = p.groupBy(F.get(F.split("p_name", " "), 1).alias("normal")).agg(F.min("p_partkey").alias("c"))
    two = written(t.join(n, "title", "left").join(m, "normal", "left").join(alias, "normal", "left").select("p_partkey", "title", "one", F.coalesce("b", "c").alias("two")), "two")
    left = two.filter("one IS NULL AND two IS NULL").select("title").distinct().withColumn("id", F.xxhash64("title"))
    index = new_index(hashed_vectors(n.select(F.col("one").alias("id"), F.col("title").alias("text"))))
    near = index.search(hashed_vectors(left.select("id", F.col("title").alias("text"))).withColumnRenamed("id", "query_id"), 1, least=MATCH_THRESHOLD)
    third = left.join(near.select(F.col("query_id").alias("h"), F.col("id").alias("three"), "sim"), F.col("h") == left["id"]).select("title", "three", "sim")
    known = F.col("one").isNotNull() | F.col("two").isNotNull()
    stage = F.when(F.col("one").isNotNull(), "exact").when(F.col("two").isNotNull(), "alias").when(F.col("three").isNotNull(), "similar")
    return two.join(third, "title", "left").select("p_partkey", F.coalesce("one", "two", "three").alias("found"), stage.alias("stage"), F.round(F.when(known, 1.0).otherwise(F.col("sim")), 6).alias("score"))
