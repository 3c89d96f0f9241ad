"""Small tables of many steps take few tasks, however many partitions a shuffle has: each task leaves files and an event."""

import random

import pytest
from pyspark.sql import functions as F

from tracklake.llm import near_copies
from tracklake.llm.components import components

WIDE = {"spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def wide(spark):
    before = {k: spark.conf.get(k) for k in WIDE}
    for k, v in WIDE.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def tasks_of(spark, group, work):
    """What ``work`` returns and the tasks that it took."""
    context, tracker = spark.sparkContext, spark.sparkContext.statusTracker()
    context.setJobGroup(group, group)
    try:
        out = work()
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    stages = {s for job in tracker.getJobIdsForGroup(group) if (info := tracker.getJobInfo(job)) for s in info.stageIds}
    return out, sum(info.numCompletedTasks for s in stages if (info := tracker.getStageInfo(s)))


def paths(n, length):
    """Links of n paths, in mixed order, and the smallest node of each."""
    rng, nodes = random.Random(5), list(range(n * length))
    rng.shuffle(nodes)
    runs = [nodes[i * length : (i + 1) * length] for i in range(n)]
    return [link for run in runs for link in zip(run, run[1:], strict=False)], {x: min(run) for run in runs for x in run}


def test_rounds_over_few_links_take_few_tasks(wide):
    rows, want = paths(5, 20)
    links = wide.createDataFrame(rows, "a long, b long")
    got, tasks = tasks_of(wide, "few-links", lambda: components(links).collect())
    assert {r["node"]: r["component"] for r in got} == want
    assert tasks < 640, tasks


@pytest.mark.parametrize("rows_a_task", [0, 10, 100_000])
def test_components_are_the_same_packed_or_not(wide, monkeypatch, rows_a_task):
    monkeypatch.setattr("tracklake.storage.ROWS_A_TASK", rows_a_task)
    rows, want = paths(4, 13)
    found = components(wide.createDataFrame([*rows, (900, 900)], "a long, b long"))
    assert {r["node"]: r["component"] for r in found.collect()} == want
    assert components(found.filter("node < 0").select(F.col("node").alias("a"), F.col("component").alias("b"))).count() == 0


@pytest.mark.parametrize("rows_a_task", [0, 100_000])
def test_near_copies_are_the_same_packed_or_not(spark, monkeypatch, rows_a_task):
    """A chain of texts, each near the next alone, so that stars meet further links."""
    monkeypatch.setattr("tracklake.storage.ROWS_A_TASK", rows_a_task)
    words = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(12):
        texts.append(" ".join(words))
        words[10 * i + 5] = f"other{i}"
    texts += [f"alone {i} with words of its own {i}" for i in range(5)] + texts[3:6]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert {r["doc_id"] for r in near_copies.first_of_each_group(docs).collect()} == {0, *range(12, 17)}
