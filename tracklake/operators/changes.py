"""Changes of tables as functions: a new table from an old one and what changes it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracklake.functions.text import row_hash
from tracklake.storage import checkpointed


def replaced(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Rows of ``new`` take the place of those with their key; of equal new keys the row that is largest in its other columns wins."""
    rest = [c for c in new.columns if c not in key]
    one = new.groupBy(*key).agg(F.max(F.struct(*rest)).alias("_row")).select(*key, *[F.col("_row")[c].alias(c) for c in rest]) if rest else new.dropDuplicates(key)
    return old.join(new.select(*key), key, "left_anti").unionByName(one.select(*new.columns))


def inserted_only(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """The rows of ``new`` that an insert which ignores known keys would add; of equal new keys one."""
    return new.dropDuplicates(key).join(old.select(*key), key, "left_anti")


def inserted_strictly(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """``old`` and ``new``; a known or repeated key is an error."""
    if not new.join(old.select(*key), key, "left_semi").isEmpty() or not new.groupBy(*key).count().filter("count > 1").isEmpty():
        raise ValueError(f"key {key} is already there")
    return old.unionByName(new)


def upserted(old: DataFrame, new: DataFrame, key: list[str], update: list[str]) -> DataFrame:
    """Known keys get the ``update`` columns of ``new`` and keep the others; unknown keys are added."""
    renamed = new.select(*[F.col(c).alias(f"n_{c}") for c in new.columns], F.lit(True).alias("_new"))
    same = [F.col(k).eqNullSafe(F.col(f"n_{k}")) for k in key]
    joined = old.withColumn("_old", F.lit(True)).join(renamed, same, "full")
    pick = lambda c: F.when(F.col("_old").isNull(), F.col(f"n_{c}")).when(F.col("_new").isNotNull() & F.lit(c in update), F.col(f"n_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) for c in old.columns])


def with_attempts(failures: DataFrame, key: list[str]) -> DataFrame:
    """Attempts and last error of every failed item."""
    return failures.groupBy(*key).agg(F.count("*").alias("attempts"), F.max_by("error", "at").alias("last_error"), F.max("at").alias("last_at"))


def superseded(old: DataFrame, new: DataFrame, subject: str, key: str) -> DataFrame:
    """``new`` appended; live rows of the same subject point to it."""
    by = new.groupBy(subject).agg(F.max(key).alias("_by"))
    closed = old.join(by, subject, "left").withColumn("superseded_by", F.coalesce("superseded_by", "_by")).drop("_by")
    return closed.select(*old.columns).unionByName(new.withColumn("superseded_by", F.lit(None).cast(old.schema["superseded_by"].dataType)).select(*old.columns))


def _clock(prefix: str = "") -> Column:
    """What decides between two versions of a row: null clocks count as 0, null origins as empty."""
    return F.struct(F.coalesce(F.col(f"{prefix}lamport"), F.lit(0)), F.coalesce(F.col(f"{prefix}origin"), F.lit("")))


def newest_by_clock(rows: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: that of the greatest (lamport, origin), then row_hash."""
    whole = F.max_by(F.struct(*rows.columns), F.struct(_clock(), F.coalesce("row_hash", F.lit(""))))
    return rows.groupBy(*key).agg(whole.alias("_row")).select(*[F.col("_row")[c].alias(c) for c in rows.columns])


def merged_by_clock(local: DataFrame, remote: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Last writer wins: for each key the row with the greater (lamport, origin), with outcome inserted, unchanged or conflict_resolved.

    Of several remote rows of a key the newest counts.  Null clocks count as 0, null origins as empty.  Keys only in
    ``local`` come with outcome kept.
    """
    out = newest_by_clock(remote, key).select(*[F.col(c).alias(f"r_{c}") for c in remote.columns])
    joined = local.join(out, [F.col(k).eqNullSafe(F.col(f"r_{k}")) for k in key], "full")
    here, there = F.col("row_hash").isNotNull(), F.col("r_row_hash").isNotNull()
    outcome = F.when(~there, "kept").when(~here, "inserted").when(F.col("row_hash") == F.col("r_row_hash"), "unchanged").otherwise("conflict_resolved")
    remote_wins = there & (~here | (_clock("r_") > _clock()) & (F.col("row_hash") != F.col("r_row_hash")))
    pick = lambda c: F.when(remote_wins, F.col(f"r_{c}")).otherwise(F.col(c)).alias(c)
    return joined.select(*[pick(c) for c in [*key, *columns, "lamport", "origin", "row_hash"]], outcome.alias("outcome"))


def folded_by_clock(versions: DataFrame, key: list[str], order: str) -> DataFrame:
    """One row a key: what merging its versions by ``merged_by_clock`` one after the other, by ``order``, leaves.

    A version takes the place of the one before it if its content differs and its (lamport, origin) is greater.
    """
    fields = [c for c in versions.columns if c not in (*key, order)]
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_at"), *fields)))
    each = versions.groupBy(*key).agg(ordered.alias("_v"))
    clock = lambda v: F.struct(F.coalesce(v["lamport"], F.lit(0)), F.coalesce(v["origin"], F.lit("")))
    wins = lambda old, new: (new["row_hash"] != old["row_hash"]) & (clock(new) > clock(old))
    last = F.aggregate(F.slice("_v", 2, F.greatest(F.size("_v") - 1, F.lit(0))), F.col("_v")[0], lambda old, new: F.when(wins(old, new), new).otherwise(old))
    return each.withColumn("_row", last).select(*key, *[F.col("_row")[c].alias(c) for c in fields])


def rows_since(df: DataFrame, lamport: int) -> DataFrame:
    return df.filter(F.col("lamport") > lamport)


def stamped(df: DataFrame, clock: int, origin: str, which: Column | None = None) -> DataFrame:
    """All rows, or those of a condition (such as a run's), with the next clock value and origin."""
    which = F.lit(True) if which is None else F.coalesce(which, F.lit(False))
    old = lambda c, kind: F.col(c) if c in df.columns else F.lit(None).cast(kind)
    return df.withColumns({"lamport": F.when(which, F.lit(clock + 1)).otherwise(old("lamport", "long")).cast("long"), "origin": F.when(which, F.lit(origin)).otherwise(old("origin", "string"))})


def replaced_alerts(old: DataFrame, new: DataFrame) -> DataFrame:
    """New alerts with the acknowledgements of old ones of the same id."""
    acks = old.select("alert_id", F.col("acknowledged_at").alias("_at"))
    return new.join(acks, "alert_id", "left").withColumn("acknowledged_at", F.coalesce("_at", "acknowledged_at") if "acknowledged_at" in new.columns else F.col("_at")).drop("_at")


def replaced_partition(old: DataFrame, new: DataFrame, column: str) -> DataFrame:
    """Partitions that occur in ``new`` are replaced whole."""
    return old.join(new.select(column).distinct(), column, "left_anti").unionByName(new)


def cascaded(tables: dict[str, DataFrame], links: list[tuple[str, str, str, str]], gone: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """Tables without the rows of ``gone`` and all that hang on them.

    ``links`` (child, child column, parent, parent column) in the order of the chain.  ``gone`` holds whole rows of its
    tables; what hangs on them goes by its link's key alone, so equal child rows go together.
    """
    lost = dict(gone)
    left = {name: df.exceptAll(lost[name]) if name in lost else df for name, df in tables.items()}
    for child, column, parent, key in links:
        if parent in lost:
            ids = lost[parent].select(F.col(key).alias(column)).distinct()
            rows = tables[child].join(ids, column, "left_semi").select(*tables[child].columns)
            left[child] = left[child].join(ids, column, "left_anti").select(*tables[child].columns)
            lost[child] = lost[child].unionByName(rows) if child in lost else rows
    return left


# The stages of a run and those that may follow.
NEXT_STAGES = {
    "preflight": {"confirmed", "failed"},
    "confirmed": {"triaged", "failed"},
    "triaged": {"identified", "triaged", "failed"},
    "identified": {"complete", "identified", "failed"},
    "complete": {"identified", "failed"},
    "failed": {"confirmed", "triaged", "identified"},
}


def next_stage(now: str, wanted: str) -> str:
    if wanted not in NEXT_STAGES.get(now, set()):
        raise ValueError(f"a run in stage {now} does not go to {wanted}")
    return wanted


def claimed(queue: DataFrame, wanted: Column, user: str, now: Column, minutes: int = 15) -> DataFrame:
    """Wanted items that are open, whose claim has run out, or that are the user's own, become the user's."""
    expired = (F.col("state") == "claimed") & (F.col("claimed_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    free = wanted & ((F.col("state") == "open") | expired | ((F.col("state") == "claimed") & (F.col("claimed_by") == user)))
    return queue.withColumns({"state": F.when(free, "claimed").otherwise(F.col("state")), "claimed_by": F.when(free, F.lit(user)).otherwise(F.col("claimed_by")), "claimed_at": F.when(free, now).otherwise(F.col("claimed_at"))})


def released(queue: DataFrame, now: Column, minutes: int = 15) -> DataFrame:
    """Claims that have run out are open again."""
    expired = (F.col("state") == "claimed") & (F.col("claimed_at") < now - F.expr(f"INTERVAL {minutes} MINUTES"))
    return queue.withColumns({"state": F.when(expired, "open").otherwise(F.col("state")), "claimed_by": F.when(~expired, F.col("claimed_by")), "claimed_at": F.when(~expired, F.col("claimed_at"))})


def restored(images: DataFrame, quarantine: DataFrame, ids: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """Quarantined images of ``ids`` that were not restored yet are pending again; a second call changes nothing."""
    back = quarantine.filter("restored_at is null").join(ids, "image_id", "left_semi").select("image_id", F.lit(True).alias("_back"))
    again = images.join(back, "image_id", "left").withColumn("status", F.when(F.col("_back") & F.lower("status").isin("quarantined", "blank"), "pending").otherwise(F.col("status"))).drop("_back")
    rows = quarantine.join(back, "image_id", "left").withColumn("restored_at", F.when(F.col("restored_at").isNull() & F.col("_back"), now).otherwise(F.col("restored_at"))).drop("_back")
    return again.select(*images.columns), rows.select(*quarantine.columns)


def acknowledged(alerts: DataFrame, wanted: Column, user: str, now: Column) -> DataFrame:
    """Wanted alerts that nobody acknowledged yet get the user and the time."""
    fresh = wanted & F.col("acknowledged_at").isNull()
    return alerts.withColumns({"acknowledged_at": F.when(fresh, now).otherwise(F.col("acknowledged_at")), "acknowledged_by": F.when(fresh, F.lit(user)).otherwise(F.col("acknowledged_by"))})


def merged_individuals(assignments: DataFrame, merges: DataFrame, individuals: DataFrame | None = None, rounds: int = 20) -> DataFrame:
    """Live assignments of merged individuals (source, target) point to the target, and on along chains of merges.

    A merge with itself, of one source with several targets, in a circle, or, where ``individuals`` (ind_id, reserve_id)
    are given, of unknown individuals or of two reserves, is an error.
    """
    if not merges.filter("source = target").isEmpty():
        raise ValueError("an individual cannot be merged with itself")
    if not merges.distinct().groupBy("source").count().filter("count > 1").isEmpty():
        raise ValueError("an individual has several targets")
    if individuals is not None:
        named = lambda c: individuals.select(F.col("ind_id").alias(c), F.col("reserve_id").alias(f"{c}_reserve"))
        both = merges.join(named("source"), "source", "left").join(named("target"), "target", "left")
        known = F.col("source_reserve").isNotNull() & F.col("target_reserve").isNotNull()
        if not both.filter(~known | (F.col("source_reserve") != F.col("target_reserve"))).isEmpty():
            raise ValueError("both individuals must exist, in one reserve")
    ends = checkpointed(merges.distinct())
    for _ in range(rounds):  # each round doubles the length of the chains that are followed
        on = ends.select(F.col("source").alias("target"), F.col("target").alias("_next"))
        step = ends.join(on, "target", "left")
        if step.filter("_next is not null").isEmpty():
            break
        ends = checkpointed(step.select("source", F.coalesce("_next", "target").alias("target")))
    else:
        raise ValueError("merges go in a circle")
    moved = assignments.join(ends.select(F.col("source").alias("ind_id"), F.col("target").alias("_to")), "ind_id", "left")
    return moved.withColumn("ind_id", F.when(F.col("superseded_by").isNull(), F.coalesce("_to", "ind_id")).otherwise(F.col("ind_id"))).drop("_to").select(*assignments.columns)


def retired(individuals: DataFrame, merges: DataFrame, at: Column) -> DataFrame:
    """Merged individuals are provisional again, and their notes say into which one they were merged and when."""
    said = F.concat(F.lit("merged into "), F.col("_to").cast("string"), F.lit(" on "), at.cast("string"))
    joined = individuals.join(merges.select(F.col("source").alias("ind_id"), F.col("target").alias("_to")), "ind_id", "left")
    notes = F.when(F.col("_to").isNotNull(), F.concat(F.coalesce(F.concat("notes", F.lit(" | ")), F.lit("")), said)).otherwise(F.col("notes"))
    return joined.withColumn("notes", notes).withColumn("provisional", F.col("provisional") | F.col("_to").isNotNull()).select(*individuals.columns)


def promoted(individuals: DataFrame, ids: DataFrame, lamport: int, hashed: list[str]) -> DataFrame:
    """Provisional individuals of ``ids`` (ind_id) are settled, with a new clock value and row hash, and are to be sent again."""
    due = ids.select("ind_id").distinct().withColumn("_due", F.lit(True))
    mark = F.coalesce(F.col("_due"), F.lit(False)) & F.col("provisional")
    out = individuals.join(due, "ind_id", "left").withColumn("_now", mark)
    out = out.withColumns({"provisional": F.col("provisional") & ~F.col("_now"), "lamport": F.when(F.col("_now"), F.lit(lamport)).otherwise(F.col("lamport")), "synced_at": F.when(~F.col("_now"), F.col("synced_at"))})
    return out.withColumn("row_hash", F.when(F.col("_now"), row_hash(*hashed)).otherwise(F.col("row_hash"))).select(*individuals.columns)


def next_clock(tables: dict[str, DataFrame]) -> int:
    """The largest clock value of all tables and one more."""
    return 1 + max((df.agg(F.coalesce(F.max("lamport"), F.lit(0)).alias("m")).first()["m"] for df in tables.values()), default=0)


def marked_synced(df: DataFrame, upto: int, at: Column) -> DataFrame:
    """Rows up to a clock value that were not sent yet count as sent."""
    return df.withColumn("synced_at", F.when(F.col("synced_at").isNull() & (F.col("lamport") <= upto), at).otherwise(F.col("synced_at")))


def merged_tables(local: dict[str, DataFrame], remote: dict[str, DataFrame], keys: dict[str, list[str]], columns: dict[str, list[str]]) -> dict[str, DataFrame]:
    """``merged_by_clock`` of every table that both sides have; a table of one side stays as it is there."""
    return {name: merged_by_clock(local[name], remote[name], keys[name], columns[name]) if name in local and name in remote else (local | remote)[name] for name in sorted({*local, *remote})}


def restored_tables(live: dict[str, DataFrame], backup: dict[str, DataFrame], preserved: tuple[str, ...] = ("users", "sessions")) -> dict[str, DataFrame]:
    """The tables of a backup, with the live accounts in place of its own."""
    return {name: live[name] if name in preserved and name in live else df for name, df in backup.items()}


def merged_json(left: Column, right: Column) -> Column:
    """Union of two JSON objects of strings; the right one wins."""
    kind = "map<string,string>"
    a, b = F.coalesce(F.from_json(left, kind), F.create_map().cast(kind)), F.coalesce(F.from_json(right, kind), F.create_map().cast(kind))
    return F.to_json(F.map_concat(F.map_filter(a, lambda k, v: ~F.map_contains_key(b, k)), b))


def violations(df: DataFrame, enums: dict[str, list[str]], foreign: dict[str, tuple[DataFrame, str]], key: str) -> DataFrame:
    """key, rule of every row that breaks an enumeration or a reference; nulls break none."""
    out = None
    for column, allowed in sorted(enums.items()):
        bad = df.filter(F.col(column).isNotNull() & ~F.col(column).isin(*allowed)).select(F.col(key).cast("string").alias("key"), F.lit(f"enum:{column}").alias("rule"))
        out = bad if out is None else out.unionByName(bad)
    for column, (parent, parent_key) in sorted(foreign.items()):
        bad = df.filter(F.col(column).isNotNull()).join(parent.select(F.col(parent_key).alias(column)).distinct(), column, "left_anti").select(F.col(key).cast("string").alias("key"), F.lit(f"reference:{column}").alias("rule"))
        out = bad if out is None else out.unionByName(bad)
    return out


def first_by_hash(files: DataFrame, content: str, path: str) -> DataFrame:
    """Of files with equal content the first by path."""
    order = Window.partitionBy(content).orderBy(path)
    return files.withColumn("_r", F.row_number().over(order)).filter("_r = 1").drop("_r")


def progress(jobs: DataFrame, now: Column) -> DataFrame:
    """Share done, whether a running job is stale (no checkpoint for 600 s) and the seconds left (from 20 done items on)."""
    silent = F.unix_timestamp(now) - F.unix_timestamp("checkpoint_at")
    spent = F.unix_timestamp("checkpoint_at") - F.unix_timestamp("started_at")
    left = F.when((F.col("state") == "running") & (F.col("done") >= 20), F.round(spent / F.col("done") * (F.col("total") - F.col("done")), 0))
    return jobs.withColumns({"share": F.round(F.try_divide(F.col("done").cast("double"), F.col("total")), 4), "stale": (F.col("state") == "running") & (silent > 600), "eta_s": left})


def session_valid(sessions: DataFrame, users: DataFrame, now: Column, idle_minutes: int = 30) -> DataFrame:
    """Sessions that hold, with the user's role."""
    joined = sessions.join(users.select("username", "role", "disabled"), "username")
    idle = F.col("last_seen_at") >= now - F.expr(f"INTERVAL {idle_minutes} MINUTES")
    return joined.filter(F.col("revoked_at").isNull() & ~F.col("disabled") & (F.col("expires_at") > now) & idle).select("token", "username", "role")


def lockout_minutes(attempts: Column) -> Column:
    """None below 5 failed attempts, then 1, 5, 15 and 30 minutes."""
    ladder = F.array(*[F.lit(m) for m in (1, 5, 15, 30)])
    return F.when(attempts >= 5, F.element_at(ladder, (F.least(attempts - 5, F.lit(3)) + 1).cast("int")))
