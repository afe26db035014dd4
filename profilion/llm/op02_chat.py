r"""Chat formatting from an event log.

A log has rows (conv_id, seq, message, kind, role, text). Sorted by seq, they fold into final messages:

- ``start`` begins a message, with a role and maybe text;
- ``delta`` adds text to it;
- ``edit`` puts text in place of all the message had;
- ``regenerate`` empties a message and drops the ones after it that came before the event.

Events that a later one overrules are found with windows over a conversation; what is left streams, sorted,
through a fold that holds one message at a time, so a conversation may have any length.

The template writes ``### role: text</turn>`` and a line feed for each message. In roles and texts, control
strings (and the backslash that escapes) are written as a backslash and a letter, which reading undoes. Only
the assistant's texts are under the loss mask, without marks.

Cases: null text or role counts as empty; rows of one turn are messages of their own, by role, then text; a
null conv_id is a conversation; other roles are formatted likewise and not learnt; events of one seq apply by
message, kind and text; deltas without a start make a message of empty role; extra columns are ignored; an
empty log gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from profilion.llm.cluster import parts

MARK, COLON, END = "### ", ": ", "</turn>\n"
#: Control strings and what is written for them inside texts.
ESCAPES = {"\\": "\\\\", "###": "\\h", "</turn>": "\\t", ": ": "\\c"}
TEXT = re.compile("|".join(re.escape(s) for s in ESCAPES if s != ": "))
ROLE = re.compile("|".join(map(re.escape, ESCAPES)))
ESCAPED = re.compile(r"\\(.)", re.S)
BACK = {v[1]: k for k, v in ESCAPES.items()}
LEARNT = "assistant"
SEGMENT = re.compile(f"{MARK}(.*?){COLON}(.*?){END}", re.S)


def escape(text: str, what: re.Pattern = TEXT) -> str:
    return what.sub(lambda m: ESCAPES[m[0]], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(lambda m: BACK[m[1]], text)


def live(events: DataFrame) -> DataFrame:
    """The events that count in the end, with the role of their message."""
    step = F.when(F.col("kind") == "start", 0).when(F.col("kind") == "regenerate", 1).when(F.col("kind") == "edit", 2).otherwise(3)
    log = events.repartition(parts(events.sparkSession), "conv_id").withColumn("tie", F.struct("message", step.alias("step"), "text"))
    later = Window.partitionBy("conv_id").orderBy(F.desc("seq"), F.desc("tie")).rowsBetween(Window.unboundedPreceding, -1)
    log = log.withColumn("cut", F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)).where(F.col("cut").isNull() | (F.col("cut") >= F.col("message")))
    own = Window.partitionBy("conv_id", "message")
    log = log.withColumn("role", F.last("role", ignorenulls=True).over(own.orderBy("seq", "tie").rowsBetween(Window.unboundedPreceding, 0)))
    reset = F.max(F.when(F.col("kind").isin("start", "edit", "regenerate"), F.struct("seq", "tie"))).over(own)
    return log.withColumn("reset", reset).where(F.col("reset").isNull() | (F.struct("seq", "tie") >= F.col("reset"))).select("conv_id", "message", "seq", "tie", "role", "text")


def render(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, segment, loss_start, loss_end): a conversation's formatted text is its segments
    in order of message; code points loss_start to loss_end of a segment are learnt (null: none)."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, role, texts = None, "", []

        def done() -> tuple:
            head = f"{MARK}{escape(role, ROLE)}{COLON}"
            body = escape("".join(texts))
            span = (len(head), len(head) + len(body)) if role == LEARNT else (None, None)
            return (*key, role, head + body + END, *span)

        def batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["conv_id", "message", "role", "segment", "loss_start", "loss_end"])

        for b in batches:
            rows = []
            for conv, message, r, t in zip(*(b.column(k).to_pylist() for k in ("conv_id", "message", "role", "text")), strict=True):
                if (conv, message) != key:
                    if key is not None:
                        rows.append(done())
                    key, texts = (conv, message), []
                role = r or ""
                texts.append(t or "")
            yield batch(rows)
        yield batch([done()] if key is not None else [])

    ordered = live(events).sortWithinPartitions("conv_id", "message", "seq", "tie").select("conv_id", "message", "role", "text")
    return ordered.mapInArrow(fold, "conv_id long, message long, role string, segment string, loss_start long, loss_end long")


def read_back(segments: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted text alone and the loss mask.

    segments must have a conversation's rows in one partition; they are sorted here."""

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None

        def fresh(conv) -> list:
            return [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]

        def batch(rows: list[list]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            rows = [(r[0], r[1], r[2].hexdigest(), r[3], r[4].hexdigest(), r[5]) for r in rows]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, kinds, strict=True)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for b in batches:
            rows = []
            for conv, segment, lo, hi in zip(*(b.column(k).to_pylist() for k in ("conv_id", "segment", "loss_start", "loss_end")), strict=True):
                if state is None or state[0] != conv:
                    if state is not None:
                        rows.append(state)
                    state = fresh(conv)
                for m in SEGMENT.finditer(segment):
                    state[1] += 1
                    state[2].update(f"{unescape(m[1])}\n{unescape(m[2])}\n".encode("utf-8", "surrogatepass"))
                if lo is not None:
                    learnt = unescape(segment[lo:hi])
                    state[3] += len(learnt)
                    state[4].update(learnt.encode("utf-8", "surrogatepass"))
                state[5] += len(segment)
            yield batch(rows)
        yield batch([state] if state is not None else [])

    ordered = segments.sortWithinPartitions("conv_id", "message")
    return ordered.mapInArrow(parse, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def log_of(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log: each turn starts a message, then streams its text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    turns = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    kinds = F.array(F.struct(F.lit("start").alias("kind"), F.lit(0).alias("step")), F.struct(F.lit("delta").alias("kind"), F.lit(1).alias("step")))
    return turns.withColumn("e", F.explode(kinds)).select("conv_id", (F.col("message") * 2 + F.col("e.step")).alias("seq"), "message", F.col("e.kind").alias("kind"), F.when(F.col("e.step") == 0, F.coalesce("role", F.lit(""))).alias("role"), F.when(F.col("e.step") == 1, F.coalesce("text", F.lit(""))).alias("text"))


def op2_chat(spark, sf_dir: str) -> DataFrame:
    """Conversations and one more, -7, whose texts hold the template's own control strings."""
    kept = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))
    return read_back(render(log_of(kept.unionByName(hard))))


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, length(replace(replace(replace(text, '\', '\\'), '###', '\h'), '</turn>', '\t')) + length(role) + 14 AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
