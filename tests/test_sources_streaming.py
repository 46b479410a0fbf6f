"""Sources, sinks and streams over small fixtures, late rows and repeated rows included."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from graphloom.sources import files
from graphloom.streaming import windows


def at(s):
    return dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)


def run(spark, tmp_path, batches, schema, plan, mode):
    """Feeds each batch as a file of its own, and gives all that was put out, by batch."""
    source, out = str(tmp_path / "in"), []
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        q = plan(spark.readStream.schema(schema).parquet(source)).writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, _: out.append(df.collect())).start()
        q.awaitTermination(60)
    return [r for b in out for r in b]


def test_late_rows_count_until_the_watermark(spark, tmp_path):
    schema = "k string, ts timestamp"
    batches = [[("a", at(1)), ("a", at(45))], [("a", at(3)), ("a", at(100))], [("a", at(2)), ("a", at(500))], [("a", at(501))]]
    got = run(spark, tmp_path, batches, schema, lambda s: windows.windowed_counts(s, "ts", "k"), "append")
    assert {((r.start - at(0)).total_seconds(), r.n) for r in got} == {(0, 2), (40, 1), (100, 1)}


def test_contents_pass_once(spark, tmp_path):
    batches = [[(1, "x", at(1)), (2, "y", at(2))], [(3, "x", at(9)), (4, None, at(10))], [(5, "", at(11))]]
    got = run(spark, tmp_path, batches, "id long, text string, ts timestamp", lambda s: windows.first_by_hash(s, "ts", "text"), "append")
    assert sorted(r.id for r in got) == [1, 2, 4]


def test_review_steps(spark, tmp_path):
    batches = [[(1, at(2), 80), (1, at(1), 20), (2, at(1), 90)], [(1, at(3), 75), (2, at(5), 10)]]
    got = run(spark, tmp_path, batches, "user_id long, ts timestamp, score int", windows.review_steps, "update")
    assert sorted(tuple(r) for r in got) == [(1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 1)]


def test_files(spark, tmp_path):
    for name, data in {"a.py": b"x = 1\n", "empty.py": b"", "node_modules/b.py": b"y\n", "d/c.pdf": b"%PDF-1.7", "d/e.bin": b"\0\1", "key.txt": b"# no\n- `a/b.py`\n\n2. c\n"}.items():
        p = tmp_path / "tree" / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)
    root = str(tmp_path / "tree")
    assert sorted(r.path for r in files.list_files(spark, root).collect()) == ["a.py", "d/c.pdf", "d/e.bin", "key.txt"]
    assert sorted(r.value for r in files.read_answer_key(spark, root + "/key.txt").collect()) == ["a/b.py", "c"]
    b = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    assert {r.n: r.t for r in b.select(F.element_at(F.split("path", "/"), -1).alias("n"), files.sniffed_type(F.col("content")).alias("t")).collect()} == {"a.py": "text", "b.py": "text", "c.pdf": "pdf", "e.bin": "binary", "key.txt": "text"}


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "ranks")
    files.overwrite_partitions(spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id int, scorer string, v int"), path, ["scorer"])
    files.overwrite_partitions(spark.createDataFrame([(3, "a", 2)], "id int, scorer string, v int"), path, ["scorer"])
    now = spark.read.parquet(path)
    assert sorted((r.id, r.scorer, r.v) for r in now.collect()) == [(2, "b", 1), (3, "a", 2)]
    changes = spark.createDataFrame([(2, "b", 9), (4, "c", 5)], "id int, scorer string, v int")
    assert sorted((r.id, r.v) for r in files.upsert(now, changes, ["id"]).collect()) == [(2, 9), (3, 2), (4, 5)]
    assert sorted(r.id for r in files.upsert(now, changes, ["id"], keep_unseen=False).collect()) == [2, 4]
    assert spark.read.parquet(files.write_snapshot(now, str(tmp_path / "snaps"))).count() == 2


def test_readers_see_finished_snapshots_only(spark, tmp_path):
    from graphloom.sources.snapshots import LostRace, SnapshotLog

    log = SnapshotLog(spark, str(tmp_path / "log"))
    with pytest.raises(LookupError):
        log.read()
    assert log.commit(spark.range(3)) == 0 and log.commit(spark.range(5)) == 1
    assert log.read().count() == 5 and log.read(0).count() == 3 and log.manifest(1)["rows"] == 5

    def refuse(rows):
        raise ValueError(f"{rows} rows are too few")

    with pytest.raises(ValueError, match="7 rows"):
        log.commit(spark.range(7), check=refuse)  # written, but never committed
    torn = spark.range(9).select(F.when(F.col("id") == 8, F.raise_error(F.lit("dies"))).otherwise(F.col("id")).alias("id"))
    with pytest.raises(Exception, match="dies"):
        log.commit(torn)
    with pytest.raises(LostRace):
        log.commit(spark.range(2), parent=0)  # another writer has made version 1
    assert log.versions() == [0, 1] and log.read().count() == 5 and len(log.unfinished()) == 3
    assert not [p for p in (tmp_path / "log" / "log").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_a_repeated_batch_is_not_doubled(spark, tmp_path):
    from graphloom.streaming import jobs

    root = str(tmp_path)
    stream = jobs.streamed_files(spark.range(100), 3, "id", root)
    out = jobs.drained(stream, root)
    assert sorted(r.id for r in out.collect()) == list(range(100))
    last = max(r.batch for r in out.select("batch").distinct().collect())
    jobs.put_batch(spark.createDataFrame(out.filter(F.col("batch") == last).drop("batch").collect(), "id long"), last, f"{root}/out")
    for p in (tmp_path / "progress" / "commits").iterdir():  # as if the driver had died before it noted the last batch
        if p.name.strip(".").removesuffix(".crc") == str(last):
            p.unlink()
    again = jobs.drained(spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(f"{root}/in"), root)
    assert sorted(r.id for r in again.collect()) == list(range(100))


def test_one_job_of_a_key_runs(spark, tmp_path):
    from graphloom.streaming import jobs

    hour = 3600
    batches = [[(1, 10, at(hour)), (1, 11, at(hour + 5)), (2, 20, at(0))], [(1, 12, at(2 * hour)), (1, 13, at(2 * hour - 1))], [(2, 21, at(30 * hour)), (1, 14, at(30 * hour))], [(2, 22, at(30 * hour + 1))], [(3, 30, at(hour))]]
    spark.conf.set(*jobs.STATE_STORE)
    try:
        got = run(spark, tmp_path, batches, "job long, event_id long, ts timestamp", lambda s: jobs.one_in_flight(s, "2 hours"), "append")
    finally:
        spark.conf.unset(jobs.STATE_STORE[0])
    # 13 comes while 10 still runs; 30 is older than the watermark
    assert {(r.event_id, r.started, r.running) for r in got} == {(10, True, 10), (11, False, 10), (20, True, 20), (13, False, 10), (12, True, 12), (21, True, 21), (14, True, 14), (22, False, 21)}
