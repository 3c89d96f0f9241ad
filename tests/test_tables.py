"""Numbered tables, jobs that resume, and merges that only touch their buckets."""

import random

import pytest
from pyspark.sql import functions as F

from tracklake.operators import changes, jobs
from tracklake.sources.tables import Change, Conflict, TableLog
from tracklake.streaming.bursts import ClockTable

KINDS = "id long, run string, v string"


def rows(spark, *r):
    return spark.createDataFrame(list(r), KINDS)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_commits_readers_and_partitions(spark, tmp_path):
    log = TableLog(spark, str(tmp_path))
    assert log.version().number == -1
    with pytest.raises(KeyError):
        log.read("occupancy")
    first = log.commit([Change("occupancy", rows(spark, (1, "a", "x"), (2, "b", "y"), (3, None, "z")), "run"), Change("audit_log", rows(spark, (1, "a", "made")))])
    second = log.replace_partitions("occupancy", rows(spark, (9, "a", "new"), (8, None, "new")), "run")
    third = log.append("audit_log", rows(spark, (2, "a", "replaced")))
    assert (first, second, third) == (0, 1, 2)
    assert got(log.read("occupancy")) == [(2, "b", "y"), (8, None, "new"), (9, "a", "new")]
    assert got(log.read("occupancy", first)) == [(1, "a", "x"), (2, "b", "y"), (3, None, "z")]  # a pinned reader
    assert got(log.read("occupancy", values=["a"])) == [(9, "a", "new")] and log.read("occupancy", values=["zz"]).count() == 0
    assert got(log.read("audit_log")) == [(1, "a", "made"), (2, "a", "replaced")]
    for change in (Change("audit_log", rows(spark), None, "all"), Change("audit_log", rows(spark), "run", "partitions")):
        with pytest.raises(ValueError, match="only grows"):
            log.commit([change])
    with pytest.raises(ValueError, match="no partitions by double"):
        log.commit([Change("x", spark.range(2).select(F.rand().alias("r")), "r")])
    log.commit([Change("occupancy", rows(spark), None, "all")])
    assert log.read("occupancy").count() == 0 and log.read("occupancy").columns == ["id", "run", "v"]


def test_a_number_is_given_once(spark, tmp_path, monkeypatch):
    one, two = TableLog(spark, str(tmp_path)), TableLog(spark, str(tmp_path))
    one.append("t", rows(spark, (1, "a", "x")))
    stale = [two.version()]
    one.append("t", rows(spark, (2, "a", "x")))
    real = two.version
    monkeypatch.setattr(two, "version", lambda number=None: stale.pop() if stale and number is None else real(number))
    stale = [real(0), real(0)]  # the second writer saw the first commit only
    assert two.append("t", rows(spark, (3, "a", "x"))) == 2
    assert [r[0] for r in got(one.read("t"))] == [1, 2, 3]
    with pytest.raises(Conflict):
        one._publish(one.version())


def test_backup_is_a_number_and_accounts_outlast_a_restore(spark, tmp_path):
    log = TableLog(spark, str(tmp_path))
    log.commit([Change("images", rows(spark, (1, "a", "x"))), Change("users", rows(spark, (1, "", "old"))), Change("audit_log", rows(spark, (1, "", "one")))])
    assert log.backup("evening") == 0
    log.commit([Change("images", rows(spark, (2, "a", "y")), None, "all"), Change("users", rows(spark, (1, "", "new")), None, "all"), Change("audit_log", rows(spark, (2, "", "two")))])
    log.commit([Change("later", rows(spark, (5, "", "")))])
    number = log.restore("evening")
    assert got(log.read("images")) == [(1, "a", "x")] and got(log.read("users")) == [(1, "", "new")] and log.read("audit_log").count() == 2
    with pytest.raises(KeyError):
        log.read("later")
    assert log.restore(number - 1) == number + 1 and got(log.read("images")) == [(2, "a", "y")] and log.read("later").count() == 1


def counting(spark, seen):
    def process(page):
        seen.append(sorted(r["id"] for r in page.collect()))
        bad = page.filter("id % 10 = 7").select(F.lit("j").alias("job_id"), F.col("id").cast("string").alias("item_id"), F.lit("failed").alias("state"), F.lit("broken").alias("error"))
        return {"done": page.filter("id % 10 <> 7").select("id"), "job_items": bad}

    return process


@pytest.mark.parametrize(("where", "stop_at"), [("_written", 0), ("_written", 3), ("_publish", 0), ("_publish", 2), ("_publish", 4)])
def test_a_job_that_is_killed_goes_on(spark, tmp_path, monkeypatch, stop_at, where):
    items = spark.range(35)
    log, seen, calls = TableLog(spark, str(tmp_path)), [], []
    real = getattr(TableLog, where)

    def killed(self, *a):
        calls.append(1)
        if len(calls) == (2 * stop_at + 2 if where == "_written" else stop_at + 1):  # a batch has two tables
            raise KeyboardInterrupt
        return real(self, *a)

    monkeypatch.setattr(TableLog, where, killed)
    with pytest.raises(KeyboardInterrupt):
        jobs.run_job(log, "j", items, "id", 10, counting(spark, seen))
    assert log.version().number == stop_at - 1
    end = jobs.run_job(TableLog(spark, str(tmp_path)), "j", items, "id", 10, counting(spark, seen))
    assert (end["state"], end["done"]) == ("done", 35)
    assert sorted(r["id"] for r in log.read("done").collect()) == [i for i in range(35) if i % 10 != 7]
    assert sorted(r["item_id"] for r in log.read("job_items").collect()) == ["17", "27", "7"]
    before = log.version()
    assert jobs.run_job(log, "j", items, "id", 10, counting(spark, seen)) == end and log.version() == before
    assert log.append("done", items, cursor=("j", {"batch": 2})) is None and log.version() == before  # a batch that comes again


def test_jobs_pause_skip_what_failed_and_do_not_share_a_cursor(spark, tmp_path, monkeypatch):
    items, log, seen = spark.range(35), TableLog(spark, str(tmp_path)), []
    asked = iter([False, True])
    assert jobs.run_job(log, "j", items, "id", 10, counting(spark, seen), stop=lambda: next(asked))["state"] == "paused"
    log.append("job_items", spark.createDataFrame([("j", "12", "failed", "x"), ("other", "13", "failed", "x")], "job_id string, item_id string, state string, error string"))
    jobs.run_job(log, "j", items, "id", 10, counting(spark, seen))
    assert 12 not in seen[1] and 13 in seen[1] and [len(s) for s in seen] == [10, 9, 10, 5]
    stale = log.version()
    real = log.version
    answers = [stale.__class__()]
    monkeypatch.setattr(log, "version", lambda number=None: answers.pop() if answers else real(number))
    with pytest.raises(Conflict, match="another writer"):
        log.append("done", items, cursor=("j", {"batch": 0}))


VERSION = "id long, v string, lamport long, origin string, row_hash string"


def one_after_the_other(spark, batches):
    table = spark.createDataFrame([], VERSION)
    for b in batches:
        merged = changes.merged_by_clock(table, spark.createDataFrame(b, VERSION), ["id"], ["v"]).drop("outcome")
        table = spark.createDataFrame(merged.collect(), VERSION)
    return got(table.select("id", "v", "lamport", "origin", "row_hash"))


def test_merge_on_read_equals_merging_one_after_the_other(spark, tmp_path):
    rng = random.Random(6)
    version = lambda i: (i, (v := rng.choice("abc")), rng.choice([None, 1, 2, 3, 4]), rng.choice([None, "x", "y"]), f"h{v}")
    batches = [[version(rng.randrange(12)) for _ in range(9)] for _ in range(7)]
    log = TableLog(spark, str(tmp_path))
    table = ClockTable(log, "things", ["id"], buckets=4)
    for n, b in enumerate(batches):
        table.merge(spark.createDataFrame(b, VERSION), n)
        table.merge(spark.createDataFrame(b, VERSION), n)  # a batch that comes again
        if n == 3:
            table.compact(2)
        assert got(table.rows().select("id", "v", "lamport", "origin", "row_hash")) == one_after_the_other(spark, batches[: n + 1])
    assert table.rows().count() == table.rows().select("id").distinct().count()
    before = got(table.rows())
    assert table.compact(1) and got(table.rows().drop("_batch")) == got(spark.createDataFrame(before, table.rows().schema).drop("_batch"))
    assert table.compact(1) == [] and all(len([p for p in log.version().tables["things"]["parts"] if p["value"] == str(b)]) <= 1 for b in range(4))


def test_a_batch_touches_its_buckets_only(spark, tmp_path):
    log = TableLog(spark, str(tmp_path))
    table = ClockTable(log, "things", ["id"], buckets=16)
    table.merge(spark.createDataFrame([(i, "a", 1, "x", "h") for i in range(200)], VERSION), 0)
    old = {p["path"] for p in log.version().tables["things"]["parts"]}
    table.merge(spark.createDataFrame([(3, "b", 2, "x", "h2"), (3, "c", 3, "x", "h3"), (3, "d", 3, "w", "h4")], VERSION), 1)
    parts = log.version().tables["things"]["parts"]
    assert len(parts) == len(old) + 1 and old <= {p["path"] for p in parts}
    assert [tuple(r) for r in table.rows().filter("id = 3").select("v", "lamport").collect()] == [("c", 3)]
    # What comes while buckets are folded stays.
    version, real = log.version(), log.version
    seen = [version]
    log.version = lambda number=None: seen.pop() if seen and number is None else real(number)
    table.merge(spark.createDataFrame([(3, "e", 9, "x", "h9")], VERSION), 2)
    seen.append(version)
    assert len(table.compact(1)) == 1
    assert [r["v"] for r in table.rows().filter("id = 3").collect()] == ["e"]


def test_several_rows_of_a_key_in_one_bundle(spark):
    local = spark.createDataFrame([(1, "a", 1, "x", "h1"), (4, "k", 1, "x", "h")], VERSION)
    remote = spark.createDataFrame([(1, "b", 2, "y", "h2"), (1, "c", 3, "y", "h3"), (2, "d", 1, "z", "h4"), (2, "e", 1, "y", "h5"), (3, "f", None, None, "h6"), (3, "f", None, None, "h6")], VERSION)
    found = changes.merged_by_clock(local, remote, ["id"], ["v"])
    assert sorted((r["id"], r["v"], r["outcome"]) for r in found.collect()) == [(1, "c", "conflict_resolved"), (2, "d", "inserted"), (3, "f", "inserted"), (4, "k", "kept")]
