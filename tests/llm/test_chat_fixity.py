import hashlib

import pytest
from pyspark.sql import functions as F

from tracklake.llm import chat, fixity
from tracklake.llm.queries import QUERIES

LOG = "conv_id long, msg_id long, role string, seq long, op string, text string"


def test_events_fold_into_final_messages(spark):
    log = [
        (1, 1, "user", 1, "message", "hi"), (1, 1, None, 5, "edit", "hello"), (1, 1, None, 6, "delta", "!"),
        (1, 2, "assistant", 2, "message", ""), (1, 2, None, 3, "delta", "wr"), (1, 2, None, 4, "delta", "ong"),
        (1, 2, None, 7, "regenerate", None), (1, 2, None, 8, "delta", "ri"), (1, 2, None, 9, "delta", "ght"),
        (2, 1, "user", 1, "message", "gone"), (2, 1, None, 2, "delete", None), (2, 2, "user", 3, "delta", "only"),
    ]
    got = sorted(tuple(r) for r in chat.final_messages(spark.createDataFrame(log, LOG).repartition(4)).collect())
    assert got == [(1, 1, "user", 1, "hello!"), (1, 2, "assistant", 2, "right"), (2, 2, "user", 3, "only")]
    with pytest.raises(Exception, match="unknown op"):
        chat.final_messages(spark.createDataFrame([(1, 1, "user", 1, "what", "x")], LOG)).collect()


def formatted(chunks):
    out = {}
    for r in chunks.orderBy("conv_id", "offset").collect():
        assert r["offset"] == len(out.setdefault(r["conv_id"], ""))
        out[r["conv_id"]] += r["chunk"]
    return out


def test_messages_stand_by_their_first_event_whatever_their_ids(spark):
    log = [("c", "zz", "user", 1, "message", "first"), ("c", "aa", "assistant", 2, "message", "second"), ("c", "zz", None, 3, "edit", "first, edited"), (None, "m", "user", 9, "delta", "alone")]
    df = spark.createDataFrame(log, "conv_id string, msg_id string, role string, seq long, op string, text string").repartition(3)
    shown = formatted(chat.rendered(chat.final_messages(df)))
    assert chat.parse(shown["c"]) == [("user", "first, edited"), ("assistant", "second")] and chat.parse(shown[None]) == [("user", "alone")]


def test_a_conversation_over_many_tasks_and_batches(spark):
    turns = spark.range(30_000).selectExpr("if(id % 10 < 7, 1, id % 10) AS conv_id", "id AS turn", "if(id % 2 = 0, 'user', 'assistant') AS role", "concat('text ', id, repeat('é', cast(id % 5 AS int))) AS text")
    chunks = chat.format_conversations(turns)
    assert chunks.filter("conv_id = 1").select(F.spark_partition_id()).distinct().count() > 1
    shown = formatted(chunks)
    got = {r["conv_id"]: r for r in chat.report(turns).collect()}
    for conv in (1, 7, 9):
        own = [(r["role"], r["text"]) for r in turns.filter(F.col("conv_id") == conv).orderBy("turn").collect()]
        assert chat.parse(shown[conv]) == own
        assert got[conv]["loss_sha256"] == hashlib.sha256("".join(t for r, t in own if r == "assistant").encode()).hexdigest()
    assert all(shown[r["conv_id"]][r["loss_start"] : r["loss_end"]].startswith("text ") for r in chunks.filter("loss_start is not null").limit(50).collect())


def test_round_trip(spark):
    said = ["<|end|>\n", "\\### Assistant: </turn> ok", "\\l<", "", None, "x" * 100_000, "😀\\", "<|user|>\n\\\\"]
    turns = [(1, i, "assistant" if i % 2 else "user", t, 0) for i, t in enumerate(said)] + [(1, 3, "assistant", "tie", 0), (None, 1, None, "who", 0), (2, None, "user", "late", 0), (2, 1, "user", "early", 0)] + [(3, 1, "assistant", "same", 0)] * 3
    df = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string, loss int")
    shown = formatted(chat.format_conversations(df))
    assert chat.parse(shown[1])[0] == ("user", "<|end|>\n")
    got = {r["conv_id"]: r for r in chat.report(df).collect()}
    ordered = sorted((t for t in turns if t[0] == 1), key=lambda t: (t[1], t[2], hashlib.sha256((t[3] or "").encode()).hexdigest()))
    digest = hashlib.sha256("".join(f"{t[2]}\n{t[3] or ''}\n" for t in ordered).encode()).hexdigest()
    trained = "".join(t[3] or "" for t in ordered if t[2] == "assistant")
    assert (got[1]["n_turns"], got[1]["turns_sha256"]) == (9, digest)
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(trained), hashlib.sha256(trained.encode()).hexdigest())
    assert got[1]["formatted_chars"] == len(shown[1])
    assert chat.parse(shown[2]) == [("user", "early"), ("user", "late")]
    assert got[3]["n_turns"] == 3 and got[3]["loss_chars"] == 12 and got[None]["n_turns"] == 1
    assert chat.report(df.limit(0)).count() == 0


PAGES = "page_id long, url string, html string, offset int"


def test_audit_finds_each_fault_and_nothing_else(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", "é" * (i % 50), 0) for i in range(0, 3000, 2)] + [(4, "again", "b", 0), (4, "again", "b", 0), (None, None, None, 0)], PAGES)
    lines = fixity.manifest(pages)
    html = F.when(F.col("page_id") == 10, "é" * 9 + "xy").when(F.col("page_id") == 2222, "é" * 21 + "z").otherwise(F.col("html"))
    changed = pages.withColumn("html", html).filter("page_id is null or page_id <> 600").union(spark.createDataFrame([(601, "new", "x", 0)], PAGES))
    found = {r["record"]: r["status"] for r in fixity.audit(lines, fixity.manifest(changed)).collect()}
    assert found[10] == "changed" and found[2222] == "changed" and found[600] == "missing" and found[601] == "added"
    # What stands behind a record of another length, in its file, has moved, and nothing else.
    before, after = ({(r["record"], r["copy"]): (r["offset"], r["digest"]) for r in m.collect()} for m in (lines, fixity.manifest(changed)))
    moved = {k[0] for k in before if k in after and before[k][1] == after[k][1] and before[k][0] != after[k][0]}
    assert {r for r, status in found.items() if status == "moved"} == moved and all(512 <= r < 768 or 2048 <= r < 2304 for r in moved)
    assert fixity.audit(lines, lines).count() == 0


def test_records_at_other_offsets_are_moved(spark):
    lines = [(i, 0, i // 100, i % 100 * 3000, 3000, f"d{i}") for i in range(400)]
    schema = "record long, copy long, file long, offset long, length long, digest string"
    other = [list(x) for x in lines]
    other[7][3], other[90][3] = other[90][3], other[7][3]  # a swap within a file
    other[250][2], other[250][3] = 0, 900_000  # another file
    other[300][5] = "rot"
    del other[399]
    a, b = spark.createDataFrame(lines, schema), spark.createDataFrame([tuple(x) for x in other], schema)
    got = sorted((r["record"], r["status"]) for r in fixity.audit(a, b).collect())
    assert got == [(7, "moved"), (90, "moved"), (250, "moved"), (300, "changed"), (399, "missing")]
    touched = {(r["file"], r["node"]) for r in fixity.differing_ranges(a, b).collect()}
    assert touched == {(0, 7 * 3000 >> 16), (0, 90 * 3000 >> 16), (2, 50 * 3000 >> 16), (0, 900_000 >> 16), (3, 0), (3, 99 * 3000 >> 16)}


def test_surplus_copies(spark):
    schema = "record long, copy long, file long, offset long, length long, digest string"
    a = spark.createDataFrame([(1, i, 0, 200 * i, 200, "d") for i in range(4)], schema)
    b = spark.createDataFrame([(1, i, 0, 200 * i, 200, "d") for i in range(2)] + [(-5, 0, 0, 0, 10, "n")], schema)
    assert sorted((r["record"], r["status"]) for r in fixity.audit(a, b).collect()) == [(-5, "added"), (1, "missing"), (1, "missing")]
    assert {r["status"] for r in fixity.audit(a.limit(0), b).collect()} == {"added"} and fixity.audit(a.limit(0), b.limit(0)).count() == 0


def test_report_shows_every_kind_of_fault(spark):
    pages = spark.createDataFrame([(i, f"http://x/{i}", f"<p>{i}</p>", 0) for i in range(1500)], PAGES)
    got = fixity.report(pages).groupBy("status").count().collect()
    counts = {r["status"]: r["count"] for r in got}
    assert set(counts) == {"sound", "changed", "moved", "missing", "added"} and counts["sound"] > 1300
    assert sum(n for s, n in counts.items() if s != "added") == 1500


def test_manifest_offsets_are_those_of_the_file(spark):
    pages = spark.createDataFrame([(1, "u", "ab", 0), (0, None, "ü", 0), (0, None, "ü", 0), (2, "v", None, 0)], PAGES)
    lines = fixity.manifest(pages).orderBy("offset").collect()
    assert [r["offset"] for r in lines] == [sum(x["length"] for x in lines[:i]) for i in range(4)]
    whole = {(r["d"], r["n"]) for r in pages.select(F.sha2(fixity.record_bytes(F.coalesce("page_id", F.lit(-1)), F.col("url"), F.col("html")), 256).alias("d"), F.octet_length(fixity.record_bytes(F.coalesce("page_id", F.lit(-1)), F.col("url"), F.col("html"))).alias("n")).collect()}
    assert {(r["digest"], r["length"]) for r in lines} == whole
    assert fixity.report(pages.limit(0)).count() == 0


def test_pipeline_stages_keep_the_columns(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
    assert {"shard", "shard_slot"} <= set(corpus_pipeline.run(spark, sf).columns)


def test_every_number_has_a_query():
    assert {n.split("_")[0] for n in QUERIES} == {f"op{i}" for i in range(1, 14)}


def test_many_pages_of_one_number(spark, monkeypatch):
    monkeypatch.setattr(fixity, "PART_DIGITS", 1)
    pages = spark.createDataFrame([(5 if i % 3 else None, "u", f"page {i // 2}", 0) for i in range(120)] + [(6, "u", "x", 0)], PAGES)
    lines = fixity.manifest(pages).collect()
    for record, want in ((5, 80), (fixity.NO_ID, 40), (6, 1)):
        assert sorted(r["copy"] for r in lines if r["record"] == record) == list(range(want))
    own = sorted((r for r in lines if r["file"] == 0), key=lambda r: r["offset"])
    assert [r["offset"] for r in own] == [sum(x["length"] for x in own[:i]) for i in range(81)]
    assert [(r["record"], r["digest"]) for r in own] == sorted((r["record"], r["digest"]) for r in own)
    a = fixity.manifest(pages)
    other = pages.withColumn("html", F.when(F.col("html") == "page 7", "page seven").otherwise(F.col("html")))
    assert {r["record"] for r in fixity.audit(a, fixity.manifest(other)).collect()} <= {5, 6, fixity.NO_ID}
    assert {r["status"] for r in fixity.audit(a, fixity.manifest(other)).collect()} <= {"changed", "moved"}
