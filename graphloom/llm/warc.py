"""Not-modified revisits of web archives: as-of join by canonical URL to the latest earlier full response.

A record has record_id, kind ('response', 'revisit' or another), url, time, headers (map; names in any case, of those that
differ in case only the last one counts) and, of responses, payload_sha256. A revisit takes the latest response of its canonical URL with an earlier time (of equal
times the largest record_id) if their validators agree, and its headers are that response's with the permitted ones
of the revisit on top. Verdicts: 'full' (a response), 'resolved', 'unchecked' (merged, but the two share no validator
to compare), 'mismatch' and 'no_response' (both left as they are), and 'other' (a record of another kind, or of none: neither
resolved nor of use to revisits).

A record without time is never earlier or later than another: such a revisit stays unresolved, such a response serves
none. A null URL matches no other. Null headers are none. Repeated records get the same result each; very long URLs and
headers are values like any other. Other columns are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from graphloom.llm.common import let, materialize

# What a 304 response may update, and query parameters that don't name a resource.
PERMITTED = ("date", "expires", "cache-control", "etag", "vary", "content-location")
TRACKING = r"^(ref|fbclid|gclid|sessionid|utm_[^=]*)(=|$)"
BUCKET_SECONDS = 86_400


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path without a slash at its end, parameters sorted, tracking ones and the fragment gone."""
    parts = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)([?][^#]*)?"
    # The scheme stays in front while its default port is dropped: port 443 of http is another place.
    origin = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1))
    host = F.regexp_replace(F.regexp_replace(origin, r"^(http://.*):80$|^(https://.*):443$", "$1$2"), r"^[^:]*://", "")
    path = F.regexp_replace(F.regexp_extract(url, parts, 2), r"/+$", "")
    query = F.split(F.regexp_replace(F.regexp_extract(url, parts, 3), r"^[?]", ""), "&")
    kept = F.array_sort(F.filter(query, lambda q: (q != "") & ~q.rlike(TRACKING)))
    return F.when(url.rlike(parts), F.concat(host, path, F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")))


def header_map(headers: Column) -> Column:
    """Names in lower case; of equal ones the last."""
    low = F.transform(F.map_entries(headers), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value")))

    def last_of_each(a: Column) -> Column:
        return F.filter(a, lambda e, i: ~F.exists(F.slice(a, i + 2, F.size(a)), lambda x: x["key"] == e["key"]))

    return F.map_from_entries(let(low, last_of_each))


def validators(response: Column, revisit: Column) -> Column:
    """'etag', 'date', 'none' (nothing to compare) or 'mismatch'."""
    etag = lambda h: F.regexp_replace(h["etag"], "^W/", "")
    both = lambda k: response[k].isNotNull() & revisit[k].isNotNull()
    return (
        F.when(both("etag"), F.when(etag(response) == etag(revisit), "etag").otherwise("mismatch"))
        .when(both("last-modified"), F.when(response["last-modified"] == revisit["last-modified"], "date").otherwise("mismatch"))
        .otherwise("none")
    )


def merge_headers(response: Column, revisit: Column) -> Column:
    """The response's headers, with those that a revisit may update taken from it."""
    news = F.map_filter(revisit, lambda k, v: k.isin(*PERMITTED) & v.isNotNull())
    olds = F.map_filter(response, lambda k, v: ~F.map_contains_key(news, k))
    return F.map_concat(olds, news)


def resolve_revisits(records: DataFrame, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """record_id, kind, url_key, verdict, response_id, check, headers, payload_sha256 of every record.

    Times are cut into buckets. The last response of each URL and bucket is aggregated map-side and carried on to the
    URL's later buckets; only records of one URL and one bucket are ever sorted together, so a URL with a third of
    all records is dealt over its buckets. Payloads stay where they are: their digests travel.
    """
    none = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))
    r = records.select("record_id", "kind", canonical_url(F.col("url")).alias("url_key"), "time", header_map(F.coalesce("headers", none)).alias("headers"), "payload_sha256")
    r = r.withColumn("bucket", F.floor(F.unix_timestamp("time") / bucket_seconds))
    # Maps can't be compared, so what is found by time and id is an array of pairs.
    full = F.when((F.col("kind") == "response") & F.col("time").isNotNull(), F.struct("time", "record_id", F.map_entries("headers").alias("headers"), "payload_sha256"))
    r = r.withColumn("own", full)
    lasts = r.filter("url_key is not null and bucket is not null").groupBy("url_key", "bucket").agg(F.max("own").alias("last"))
    earlier = W.partitionBy("url_key").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)
    carried = lasts.withColumn("carried", F.last("last", ignorenulls=True).over(earlier)).select("url_key", "bucket", "carried")
    # Equal times are peers: the latest strictly earlier one is the last of the group before.
    timed = r.filter("url_key is not null and bucket is not null")
    peers = timed.groupBy("url_key", "bucket", "time").agg(F.max("own").alias("last"))
    before = W.partitionBy("url_key", "bucket").orderBy("time").rowsBetween(W.unboundedPreceding, -1)
    peers = peers.withColumn("near", F.last("last", ignorenulls=True).over(before)).drop("last")
    found = timed.join(peers, ["url_key", "bucket", "time"]).join(carried, ["url_key", "bucket"]).withColumn("hit", F.coalesce("near", "carried")).drop("near", "carried")
    rest = r.filter("url_key is null or bucket is null").withColumn("hit", F.lit(None).cast(found.schema["hit"].dataType))
    all_ = found.unionByName(rest)
    hit = F.map_from_entries("hit.headers")
    check = validators(hit, F.col("headers"))
    j = all_.withColumn("check", F.when((F.col("kind") == "revisit") & F.col("hit").isNotNull(), check))
    good = F.col("check").isNotNull() & (F.col("check") != "mismatch")
    is_revisit = F.coalesce(F.col("kind") == "revisit", F.lit(False))
    verdict = F.when(F.col("kind") == "response", "full").when(~is_revisit, "other").when(F.col("hit").isNull(), "no_response").when(F.col("check") == "mismatch", "mismatch").when(F.col("check") == "none", "unchecked").otherwise("resolved")
    return j.select(
        "record_id", "kind", "url_key", verdict.alias("verdict"), F.when(F.col("kind") == "revisit", F.col("hit.record_id")).alias("response_id"), "check",
        F.when(good, merge_headers(hit, F.col("headers"))).otherwise(F.col("headers")).alias("headers"), F.when(good, F.col("hit.payload_sha256")).otherwise(F.col("payload_sha256")).alias("payload_sha256"),
    )


def archive_of(pages: DataFrame) -> DataFrame:
    """A crawl of all pages: a response a minute, a revisit half a minute after it, and for some one a week later or before.

    Every ninth revisit bears another validator; every fifth page has a Last-Modified and no ETag.
    """
    p = materialize(pages.select("page_id", "url", F.sha2(F.coalesce("html", F.lit("")), 256).alias("sha")), "captures")
    at = lambda s: F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") * 60 + s)
    text = lambda s: F.date_format(at(s), "yyyy-MM-dd HH:mm:ss")
    old = F.col("page_id") % 5 == 0
    tag = F.concat(F.lit('"'), F.substring("sha", 1, 16), F.lit('"'))

    def headers(s: int, validator_ok: Column, cache: str, kind: str) -> Column:
        pairs = [("date", text(s)), ("cache-control", F.lit(cache)), ("etag", F.when(old, None).when(validator_ok, tag).otherwise("W/\"other\"")), ("last-modified", F.when(old, F.when(validator_ok, text(-3600)).otherwise(text(-60)))), ("content-type", F.lit("text/html" if kind == "response" else "text/plain"))]
        return F.map_filter(F.map_from_arrays(F.array(*(F.lit(k) for k, _ in pairs)), F.array(*(v for _, v in pairs))), lambda k, v: v.isNotNull())

    def record(k: int, kind: str, s: int, ok: Column, cache: str) -> DataFrame:
        return p.select((F.col("page_id") * 4 + k).alias("record_id"), F.lit(kind).alias("kind"), "url", at(s).alias("time"), headers(s, ok, cache, kind).alias("headers"), (F.col("sha") if kind == "response" else F.lit(None).cast("string")).alias("payload_sha256"), "page_id")

    same = F.col("page_id") % 9 != 0
    parts = [record(0, "response", 0, F.lit(True), "max-age=60"), record(1, "revisit", 30, same, "max-age=600"), record(2, "revisit", 604_800, same, "no-cache").filter("page_id % 3 = 0"), record(3, "revisit", -30, F.lit(True), "no-cache").filter("page_id % 7 = 0")]
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    return out.drop("page_id")


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = resolve_revisits(archive_of(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    names = ("date", "cache-control", "etag", "last-modified", "content-type")
    return r.select("record_id", "kind", "url_key", "verdict", "response_id", F.col("check").alias("checked_by"), *(F.col("headers")[n].alias("h_" + n.replace("-", "_")) for n in names), "payload_sha256")


OP1_SQL = r"""
WITH p AS (SELECT page_id, url, sha256(coalesce(html, '')) AS sha FROM pages),
k(k, kind, s, cache) AS (VALUES (0, 'response', 0, 'max-age=60'), (1, 'revisit', 30, 'max-age=600'), (2, 'revisit', 604800, 'no-cache'), (3, 'revisit', -30, 'no-cache')),
r0 AS (
  SELECT page_id * 4 + k AS record_id, kind, 1700000000 + page_id * 60 + s AS t, sha, page_id, cache, k IN (0, 3) OR page_id % 9 <> 0 AS ok, page_id % 5 = 0 AS old,
    regexp_replace(regexp_replace(lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)', 1)), '^(http://.*):80$|^(https://.*):443$', '\1\2'), '^[^:]*://', '') AS host, regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)([?][^#]*)?', 2) AS path,
    list_sort(list_filter(string_split(regexp_replace(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)([^?#]*)([?][^#]*)?', 3), '^[?]', ''), '&'), lambda q: q <> '' AND NOT regexp_matches(q, '^(ref|fbclid|gclid|sessionid|utm_[^=]*)(=|$)'))) AS q
  FROM p, k WHERE k < 2 OR (k = 2 AND page_id % 3 = 0) OR (k = 3 AND page_id % 7 = 0)),
r AS (
  SELECT record_id, kind, t, host || regexp_replace(path, '/+$', '') || CASE WHEN len(q) > 0 THEN '?' || array_to_string(q, '&') ELSE '' END AS url_key, sha, cache,
    strftime(make_timestamp(t * 1000000), '%Y-%m-%d %H:%M:%S') AS d, CASE WHEN old THEN NULL WHEN ok THEN '"' || substr(sha, 1, 16) || '"' ELSE 'W/"other"' END AS etag,
    CASE WHEN old THEN strftime(make_timestamp((1700000000 + page_id * 60 - CASE WHEN ok THEN 3600 ELSE 60 END) * 1000000), '%Y-%m-%d %H:%M:%S') END AS lm
  FROM r0),
j AS (SELECT a.*, b.record_id AS b_id, b.etag AS b_etag, b.lm AS b_lm, b.sha AS b_sha, row_number() OVER (PARTITION BY a.record_id ORDER BY b.t DESC NULLS LAST, b.record_id DESC) AS rn
  FROM r a LEFT JOIN r b ON a.url_key = b.url_key AND b.kind = 'response' AND b.t < a.t AND a.kind = 'revisit'),
v AS (SELECT *, CASE WHEN b_id IS NULL THEN NULL WHEN etag IS NOT NULL AND b_etag IS NOT NULL THEN CASE WHEN regexp_replace(etag, '^W/', '') = regexp_replace(b_etag, '^W/', '') THEN 'etag' ELSE 'mismatch' END
    WHEN lm IS NOT NULL AND b_lm IS NOT NULL THEN CASE WHEN lm = b_lm THEN 'date' ELSE 'mismatch' END ELSE 'none' END AS checked_by FROM j WHERE rn = 1)
SELECT record_id, kind, url_key, CASE WHEN kind = 'response' THEN 'full' WHEN b_id IS NULL THEN 'no_response' WHEN checked_by = 'mismatch' THEN 'mismatch' WHEN checked_by = 'none' THEN 'unchecked' ELSE 'resolved' END AS verdict, b_id AS response_id, checked_by,
  d AS h_date, cache AS h_cache_control, CASE WHEN checked_by <> 'mismatch' THEN coalesce(etag, b_etag) ELSE etag END AS h_etag, CASE WHEN checked_by <> 'mismatch' THEN b_lm ELSE lm END AS h_last_modified,
  CASE WHEN kind = 'response' OR checked_by <> 'mismatch' THEN 'text/html' ELSE 'text/plain' END AS h_content_type, CASE WHEN kind = 'response' THEN sha WHEN checked_by <> 'mismatch' THEN b_sha END AS payload_sha256
FROM v
"""
