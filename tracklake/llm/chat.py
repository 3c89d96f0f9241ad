r"""Chat formatting from event logs.

A log holds, for every conversation, events in the order of ``seq`` (of any type that has an order): ``message`` and
``edit`` set a message's text, ``delta`` appends to it, ``regenerate`` empties it (what follows replaces it), ``delete``
removes the message.  Events are folded message by message; messages stand by the place of their first event.

Template: ``<|role|>`` newline, text, ``<|end|>`` newline, for every turn.  In roles and texts a backslash becomes two
and ``<`` becomes backslash and ``l``, so no text can hold a control string, and reading back is exact.

No conversation is one value or one group in memory.  Turns are dealt to tasks by ranges of (conversation, place), so a
conversation with a third of all rows lies in many tasks; each turn is a chunk of its formatted conversation, and its
offset is the running sum inside the task plus the sums of the conversation's earlier tasks.  Only a reader that wants
one digest of a whole conversation has to see its chunks in one order; it streams them and holds one chunk at a time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tracklake.llm.common import checkpointed, numbered

OPEN, SHUT, END = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
DELTA_CHARS = 512


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "<" if m[1] == "l" else m[1], text, flags=re.DOTALL)


def log_of_turns(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as an event log, each text streamed in parts of DELTA_CHARS characters.

    Every message opens with a draft that an edit clears or a regeneration drops, before the parts follow.  The sequence
    is turn (null last), then role, then a digest of the text; equal rows are messages of their own.  Message ids are
    opaque and say nothing of the order.  A null text is empty, a null role too.
    """
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    same = rows.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("n"))
    each = numbered(same, "n", "copy").drop("n").withColumn("digest", F.sha2("text", 256))
    keyed = each.withColumn("msg_id", F.left(F.sha2(F.concat_ws("|", "turn", "role", "digest", "copy"), 256), F.lit(32)))
    clear = F.when(F.col("msg_id") < "8", "edit").otherwise("regenerate")
    first = F.array(F.struct(F.lit("message").alias("op"), F.lit("(draft)").alias("part")), F.struct(clear.alias("op"), F.lit("").alias("part")))
    parts = F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.char_length("text") - 1), F.lit(DELTA_CHARS)), lambda i: F.struct(F.lit("delta").alias("op"), F.substr("text", i + 1, F.lit(DELTA_CHARS)).alias("part")))
    log = keyed.select("*", F.posexplode(F.concat(first, parts)).alias("i", "event"))
    seq = F.struct(F.col("turn").isNull().alias("undated"), "turn", "role", "digest", "copy", "i")
    return log.select("conv_id", "msg_id", "role", seq.alias("seq"), "event.op", F.col("event.part").alias("text"))


def final_messages(log: DataFrame) -> DataFrame:
    """conv_id, msg_id, role, place (its first seq) and text of every message that stands at the end of the log (conv_id, msg_id, role, seq, op, text).

    Events of one message with equal seq are taken by op, then text.  The last role that is not null holds.  Unknown ops
    are an error.  An empty log gives no messages; extra columns are ignored.
    """
    events = F.array_sort(F.collect_list(F.struct("seq", F.col("op"), F.coalesce("text", F.lit("")).alias("text"))))
    own = log.groupBy("conv_id", "msg_id").agg(F.max_by("role", F.when(F.col("role").isNotNull(), F.col("seq"))).alias("role"), F.min("seq").alias("place"), events.alias("events"))
    # Only what follows the last event that sets the text counts.
    last = F.array_max(F.transform("events", lambda e, i: F.when(e["op"].isin("message", "edit", "regenerate", "delete"), i).otherwise(-1)))
    known = F.forall("events", lambda e: e["op"].isin("message", "delta", "edit", "regenerate", "delete"))
    kept = F.filter("events", lambda e, i: (i >= F.col("last")) & ((e["op"] != "regenerate") & (e["op"] != "delete")))
    checked = own.withColumn("last", F.when(known, last).otherwise(F.raise_error("unknown op in the log")))
    gone = F.coalesce(F.element_at("events", F.greatest(F.col("last"), F.lit(0)) + 1)["op"] == "delete", F.lit(False)) & (F.col("last") >= 0)
    return checked.filter(~gone).select("conv_id", "msg_id", F.coalesce("role", F.lit("")).alias("role"), "place", F.array_join(F.transform(kept, lambda e: e["text"]), "").alias("text"))


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a task, sorted by conversation, with the sum ``at`` of the chars of the conversation's rows before each."""
    conv, carried = object(), 0
    for batch in batches:
        if not batch.num_rows:
            continue
        chars = batch.column("chars").to_numpy()
        code = pc.dictionary_encode(batch.column("conv_id"), null_encoding="encode").indices.to_numpy()
        before = np.concatenate(([0], np.cumsum(chars)[:-1]))
        begins = np.concatenate(([True], code[1:] != code[:-1]))
        at = before - before[np.maximum.accumulate(np.where(begins, np.arange(len(code)), 0))]
        if batch.column("conv_id")[0].as_py() == conv:
            own = np.cumsum(begins) == 1
            at[own] += carried
        conv, carried = batch.column("conv_id")[-1].as_py(), int(at[-1] + chars[-1])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int64))], names=[*batch.schema.names, "at"])


def rendered(messages: DataFrame) -> DataFrame:
    """The formatted conversations as ordered chunks, one a turn: conv_id, offset, chunk, loss_start, loss_end.

    ``offset`` is the chunk's place in the formatted conversation, loss_start and loss_end the span of a trained text
    in it (null for other roles), all in code points.  Messages are ordered by place, then msg_id.
    """
    head = F.concat(F.lit(OPEN), escaped(F.col("role")), F.lit(SHUT))
    body = escaped(F.col("text"))
    chunk = F.concat(head, body, F.lit(END))
    turns = messages.select("conv_id", "place", "msg_id", chunk.alias("chunk"), F.char_length(head).alias("skip"), F.char_length(body).alias("size"), (F.col("role") == TRAINED_ROLE).alias("trained"))
    dealt = turns.repartitionByRange("conv_id", "place", "msg_id").sortWithinPartitions("conv_id", "place", "msg_id")
    slim = dealt.select("conv_id", "chunk", F.char_length("chunk").cast("long").alias("chars"), "skip", "size", "trained", F.spark_partition_id().alias("task"))
    placed = checkpointed(slim.mapInArrow(_running, StructType([*slim.schema.fields, StructField("at", LongType())])))
    sums = placed.groupBy("conv_id", "task").agg(F.sum("chars").alias("chars"))
    earlier = Window.partitionBy("conv_id").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    # A conversation goes on from an earlier task at most once in each task: no more rows than tasks.
    starts = sums.select(F.col("conv_id").alias("s_conv"), F.col("task").alias("s_task"), F.sum("chars").over(earlier).alias("start")).filter("start is not null")
    joined = placed.join(F.broadcast(starts), F.col("conv_id").eqNullSafe(F.col("s_conv")) & (F.col("task") == F.col("s_task")), "left")
    offset = F.col("at") + F.coalesce("start", F.lit(0))
    start = F.when(F.col("trained"), offset + F.col("skip"))
    return joined.select("conv_id", offset.alias("offset"), "chunk", start.alias("loss_start"), (start + F.col("size")).alias("loss_end"))


def parse(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted conversation."""
    out = []
    for block in formatted.split(END)[:-1]:
        if not block.startswith(OPEN):
            raise ValueError("a turn does not start with a role")
        role, text = block[len(OPEN) :].split(SHUT, 1)
        out.append((unescape(role), unescape(text)))
    return out


DIGEST = "conv_id string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Digests of formatted conversations, from their chunks and loss spans alone.

    The rows come sorted by conversation and offset; one chunk is held at a time.
    """
    names = [c.split()[0] for c in DIGEST.split(", ")]
    encode = lambda s: s.encode("utf-8", "replace")
    conv, begun = None, False
    row = lambda: (conv, n, said.hexdigest(), loss, trained.hexdigest(), upto)
    for frame in frames:
        done = []
        for own, offset, chunk, start, end in zip(frame["conv_id"], frame["offset"], frame["chunk"], frame["loss_start"], frame["loss_end"], strict=True):
            if not begun or own != conv:
                if begun:
                    done.append(row())
                conv, begun, n, loss, upto, said, trained = own, True, 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            if offset != upto:
                raise ValueError("a chunk does not start where the one before it ends")
            for role, text in parse(chunk):
                n += 1
                said.update(encode(f"{role}\n{text}\n"))
            if not pd.isna(start):
                text = unescape(chunk[int(start) - offset : int(end) - offset])
                loss += len(text)
                trained.update(encode(text))
            upto += len(chunk)
        yield pd.DataFrame(done, columns=names)
    if begun:
        yield pd.DataFrame([row()], columns=names)


def format_conversations(turns: DataFrame) -> DataFrame:
    return rendered(final_messages(log_of_turns(turns)))


def report(turns: DataFrame) -> DataFrame:
    """One row a conversation: what its formatted text says when read back.

    A null conv_id is a conversation of its own.  No turns, no rows.  Very long texts are one chunk each.  Extra columns
    are ignored.  The digest of a conversation is by its nature taken in one order, so its chunks stream through one task.
    """
    kind = turns.schema["conv_id"].dataType
    shown = format_conversations(turns).withColumn("conv_id", F.col("conv_id").cast("string"))
    read = shown.repartition("conv_id").sortWithinPartitions("conv_id", "offset").mapInPandas(read_back, DIGEST)
    return read.withColumn("conv_id", F.col("conv_id").cast(kind))
