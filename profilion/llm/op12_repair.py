"""Conversation structure repair: the cheapest edits that give each conversation roles of the form (s?(ua)+)?.

Keeping a row costs nothing, giving it the role of a user or assistant 3, deleting it 4 and inserting an empty turn 3; a truncated
row that stays adds 3, blank and duplicate rows must go. The edits are paths through a weighted automaton of four states (nothing
yet, after the system, after a user, after an assistant). It is determinised lazily: the costs from each state to the end, less
their least, are one state of a new automaton, and each step of it is worked out once and kept in a table (``Automaton``). A scan
from the last row to the first looks the steps up and gives the costs; the trace then goes back against the scan, along arcs
that are tight (those on a cheapest path), and takes the edit of the least letter, so ties fall to the ASCII-least audit.

Conversations are range-sorted (``scans.placed``). One that lies within a block is repaired in one pass, without another shuffle.
One of several blocks is never brought together: each block gives the costs between all states at its ends, these few numbers are
folded along the conversation, and then the blocks are traced, each by itself for every state it could begin in. Only the
SHA-256 of its repaired text, sequential by nature, is taken in one task, streamed block by block.

Defined cases: rows of a turn are ordered by role, then text; rows without conv_id are one conversation; a null role, text or
turn counts as one space where letters are needed, and a null turn comes first; equal rows are duplicates of the first; a
conversation whose rows are all dropped gives zeros, an empty audit and the hash of an empty text; an empty table gives no
rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilion.llm import textkit as tk
from profilion.llm.sqltext import CRC_TABLE, crc32
from profilion.operators import scans
from profilion.session import settle

#: Costs of the edits, white space, what closes a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANKS, CLOSING = " \t\n\x0b\x0c\r", ".!?"
#: States: nothing yet, after the system, after a user, after an assistant. What a new turn leads to, and its role.
START, SYSTEM, USER, ASSISTANT = range(4)
NEW, ROLE = (USER, USER, ASSISTANT, USER), ("user", "user", "assistant", "user")
KEPT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
ENDS, FAR = (0, 2 * INSERT, INSERT, 0), 1 << 40
#: Rows of a block.
BLOCK = 1024

RESULT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


class Automaton:
    """The determinised automaton, as far as it has been needed. A symbol is a row's initial ("x": must go) and, if it is
    truncated, a "t". A state is the number of a vector of costs to the end, the least of them 0."""

    def __init__(self) -> None:
        self.vectors: list[tuple[int, ...]] = []
        self.numbers: dict[tuple[int, ...], int] = {}
        self.steps: dict[tuple[int, str], tuple[int, int]] = {}
        self.arcs: dict[tuple[int, str, int], tuple[str, int]] = {}

    def number(self, vector: tuple[int, ...]) -> tuple[int, int]:
        least = min(vector)
        vector = tuple(min(v - least, FAR) if v < FAR else FAR for v in vector)
        if vector not in self.numbers:
            self.numbers[vector] = len(self.vectors)
            self.vectors.append(vector)
        return self.numbers[vector], least

    def edits(self, symbol: str, state: int) -> list[tuple[str, int, int]]:
        """Edits of a row in a state: letter, cost, next state; letters ascending."""
        found, more = [("D", DELETE, state)], TRUNCATED if symbol.endswith("t") else 0
        if symbol[0] != "x":
            if (symbol[0], state) in KEPT:
                found.append(("K", more, KEPT[symbol[0], state]))
            found.append(("R", REROLE + more, NEW[state]))
        return found

    def costs(self, after: tuple[int, ...], symbol: str) -> list[int]:
        """Costs to the end before a row, from those after it."""
        costs = [min(c + after[to] for _, c, to in self.edits(symbol, s)) for s in range(4)]
        for _ in range(3):
            costs = [min(c, INSERT + costs[NEW[s]]) for s, c in enumerate(costs)]
        return costs

    def step(self, state: int, symbol: str) -> tuple[int, int]:
        """The state before a row, from the state after it, and what is added to all costs."""
        known = self.steps.get((state, symbol))
        if known is None:
            known = self.steps[state, symbol] = self.number(tuple(self.costs(self.vectors[state], symbol)))
        return known

    def scan(self, symbols: list[str], end: tuple[int, ...]) -> tuple[list[int], int]:
        """States behind each row and before the first, from the first row on, and what the last one's costs lack."""
        state, cost = self.number(end)
        path = [state]
        for symbol in reversed(symbols):
            state, more = self.step(state, symbol)
            path.append(state)
            cost += more
        return path[::-1], cost

    def tight(self, after: int, symbol: str, at: int) -> tuple[str, int]:
        """The least letters of tight arcs from a state over a row: those of turns put in before it, then the row's edit."""
        known = self.arcs.get((after, symbol, at))
        if known is None:
            behind, letters, here = self.vectors[after], "", at
            costs = self.costs(behind, symbol)
            while True:
                tight = [(a, to) for a, c, to in self.edits(symbol, here) if c + behind[to] == costs[here]]
                if tight and (tight[0][0] == "D" or INSERT + costs[NEW[here]] != costs[here]):
                    known = self.arcs[after, symbol, at] = (letters + tight[0][0], tight[0][1])
                    break
                letters, here = letters + "I", NEW[here]
        return known

    def trace(self, symbols: list[str], path: list[int], at: int) -> tuple[str, int]:
        letters = []
        for symbol, after in zip(symbols, path[1:]):
            arc, at = self.tight(after, symbol, at)
            letters.append(arc)
        return "".join(letters), at


def closing(at: int) -> str:
    """The turns put in behind the last row."""
    return "I" * (ENDS[at] // INSERT)


def symbols(initials: list[str], tails: list[str], again: list[bool]) -> list[str]:
    """tails: the last letter of each text ("": blank)."""
    return ["x" if not tail or dup else (i if i in ("s", "u", "a") else "o") + ("" if tail in CLOSING else "t") for i, tail, dup in zip(initials, tails, again)]


def spelled(roles: list[str], texts: list[str], audit: str, at: int) -> Iterator[str]:
    """The turns of a repaired conversation, as role:text."""
    row = 0
    for edit in audit:
        if edit == "K":
            yield f"{roles[row]}:{texts[row]}"
            at = KEPT[roles[row][0], at]
        elif edit != "D":
            yield f"{ROLE[at]}:{texts[row] if edit == 'R' else ''}"
            at = NEW[at]
        row += edit != "I"


def stretches(batches: Iterator[pa.RecordBatch], more: tuple[str, ...] = ()) -> Iterator[tuple[int | None, int, dict[str, list]]]:
    """Rows of one conversation and block, which lie together, as lists: (conv_id, block, rows without the dropped)."""
    held, now = None, None
    lists = (*FIELDS[3:], *more)
    for batch in batches:
        for row in zip(*(batch.column(k).to_pylist() for k in (*FIELDS, *more))):
            if held is None or row[:2] != now:
                if held is not None:
                    yield *now, held
                held, now = {k: [] for k in lists}, row[:2]
            if not row[2]:
                for k, v in zip(lists, row[3:]):
                    held[k].append(v)
    if held is not None:
        yield *now, held


FIELDS = ("conv_id", "_block", "dropped", "turn", "role", "text", "initial", "tail", "again")


def counted(rows: dict[str, list], marks: list[str]) -> dict:
    """The faults of a stretch, and what its neighbours need to know."""
    known = [t for t in rows["turn"] if t is not None]
    pairs = zip(rows["initial"], rows["initial"][1:])
    return {
        "blank": sum(not t for t in rows["tail"]),
        "duplicate": sum(bool(t) and d for t, d in zip(rows["tail"], rows["again"])),
        "truncated": sum(m.endswith("t") for m in marks),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in pairs),
        "lo": min(known, default=None), "hi": max(known, default=None), "turns": len(set(known)),
        "opens": rows["initial"][0] if marks else None, "shuts": rows["initial"][-1] if marks else None,
    }


def _gaps(lo, hi, turns: int) -> int:
    return hi - lo + 1 - turns if turns else 0


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema)


def _flushed(rows: Iterator[dict], schema: pa.Schema, most: int = 2000) -> Iterator[pa.RecordBatch]:
    held: list[dict] = []
    for row in rows:
        held.append(row)
        if len(held) == most:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


NUMBERS = ("blank", "duplicate", "truncated", "illegal")
L = pa.int64()
DONE = pa.schema([("conv_id", L), ("gaps", L), *[(k, L) for k in NUMBERS], ("cost", L), ("audit", pa.string()), ("repaired_sha256", pa.string())])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repairs conversations that lie in one block each."""
    automaton = Automaton()

    def repaired():
        for conv, _, rows in stretches(batches):
            met: set[tuple[str, str]] = set()
            for k, turn in enumerate(zip(rows["role"], rows["text"])):
                rows["again"][k] = turn in met
                met.add(turn)
            marks = symbols(rows["initial"], rows["tail"], rows["again"])
            path, cost = automaton.scan(marks, ENDS)
            cost += automaton.vectors[path[0]][START]
            audit, at = automaton.trace(marks, path, START)
            audit += closing(at)
            told = counted(rows, marks)
            text = "\n".join(spelled(rows["role"], rows["text"], audit, START))
            yield {"conv_id": conv, "gaps": _gaps(told["lo"], told["hi"], told["turns"]), **{k: told[k] for k in NUMBERS}, "cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256(text.encode()).hexdigest()}

    yield from _flushed(repaired(), DONE)


PART = pa.schema([("conv_id", L), ("_block", L), *[(k, L) for k in (*NUMBERS, "lo", "hi", "turns")], ("opens", pa.string()), ("shuts", pa.string()), ("table", pa.list_(L))])


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's faults and the least costs from each state before it (row) to each behind it (column)."""
    automaton = Automaton()

    def summed():
        for conv, block, rows in stretches(batches):
            marks = symbols(rows["initial"], rows["tail"], rows["again"])
            columns = []
            for to in range(4):
                path, cost = automaton.scan(marks, tuple(0 if s == to else FAR for s in range(4)))
                columns.append([min(v + cost, FAR) for v in automaton.vectors[path[0]]])
            yield {"conv_id": conv, "_block": block, **counted(rows, marks), "table": [columns[to][s] for s in range(4) for to in range(4)]}

    yield from _flushed(summed(), PART, 200)


FOLDED = pa.schema([("conv_id", L), ("_block", L), ("behind", pa.list_(L)), ("last", pa.bool_()), *[(k, L) for k in ("gaps", *NUMBERS, "cost")]])


def _folded(table: pa.Table) -> pa.Table:
    """The costs behind each block of a conversation, from its last to its first, and the conversation's own figures."""
    parts = sorted(table.to_pylist(), key=lambda p: p["_block"])
    costs = list(ENDS)
    for part in reversed(parts):
        part["behind"] = costs
        costs = [min(FAR, min(part["table"][4 * s + to] + costs[to] for to in range(4))) for s in range(4)]
    held, dated = [p for p in parts if p["opens"] is not None], [p for p in parts if p["turns"]]
    told = {k: sum(p[k] for p in parts) for k in NUMBERS} | {"cost": costs[START], "gaps": 0}
    told["illegal"] += sum(a["shuts"] + b["opens"] not in ("su", "ua", "au") for a, b in zip(held, held[1:]))
    if dated:
        told["gaps"] = _gaps(dated[0]["lo"], dated[-1]["hi"], sum(p["turns"] for p in dated) - sum(a["hi"] == b["lo"] for a, b in zip(dated, dated[1:])))
    return pa.Table.from_pylist([{k: p[k] for k in ("conv_id", "_block", "behind")} | {"last": p is parts[-1]} | told for p in parts], FOLDED)


TRACED = pa.schema([("conv_id", L), ("_block", L), ("audits", pa.list_(pa.string())), ("exits", pa.list_(L))])


def _traced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's audit and last state, for every state before it from which the end can be reached."""
    automaton = Automaton()

    def traced():
        for conv, block, rows in stretches(batches, ("behind",)):
            marks = symbols(rows["initial"], rows["tail"], rows["again"])
            path, _ = automaton.scan(marks, tuple(rows["behind"][0]) if rows["behind"] else ENDS)
            found = [automaton.trace(marks, path, at) for at in range(4)]
            yield {"conv_id": conv, "_block": block, "audits": [a for a, _ in found], "exits": [e for _, e in found]}

    yield from _flushed(traced(), TRACED, 50)


ENTERED = pa.schema([("conv_id", L), ("_block", L), ("state", L)])


def _entered(table: pa.Table) -> pa.Table:
    """The state before each block, from the first to the last."""
    parts, at = sorted(table.to_pylist(), key=lambda p: p["_block"]), START
    for part in parts:
        part["state"], at = at, part.pop("exits")[at]
    return pa.Table.from_pylist(parts, ENTERED)


WORDED = pa.schema([("conv_id", L), ("_block", L), ("worded", pa.string())])


def _worded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A block's part of the repaired text; nothing where no turn is left."""

    def worded():
        for conv, block, rows in stretches(batches, ("audit", "state")):
            turns = list(spelled(rows["role"], rows["text"], rows["audit"][0], rows["state"][0])) if rows["role"] else []
            if turns:
                yield {"conv_id": conv, "_block": block, "worded": "\n".join(turns)}

    yield from _flushed(worded(), WORDED, 20)


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations from their blocks, in order; of the text no more than a few blocks are held."""

    def joined():
        letters, digest, some = [], hashlib.sha256(), False
        for batch in batches:
            for row in batch.to_pylist():
                turns, at = [row["worded"]] if row["worded"] is not None else [], row["left"]
                letters.append(row["audit"])
                if row["last"]:
                    letters.append(closing(at))
                    turns.extend(spelled([], [], closing(at), at))
                for turn in turns:
                    digest.update((("\n" if some else "") + turn).encode())
                    some = True
                if row["last"]:
                    yield {k: row[k] for k in ("conv_id", "gaps", *NUMBERS, "cost")} | {"audit": "".join(letters), "repaired_sha256": digest.hexdigest()}
                    letters, digest, some = [], hashlib.sha256(), False

    yield from _flushed(joined(), DONE)


def repaired(rows: DataFrame, size: int = BLOCK) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) for each conv_id of rows with conv_id, turn,
    role, text, and dropped (true: only the conv_id counts). Letters in roles and texts must not be null."""
    ends = F.right(F.rtrim("text", F.lit(BLANKS)), F.lit(1))
    rows = rows.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text", "dropped", F.substring("role", 1, 1).alias("initial"), ends.alias("tail"), F.lit(False).alias("again"))
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)]
    rows = scans.placed(rows, ["conv_id"], order, ["text"], size)
    parts = settle(scans.blocks(rows, ["conv_id"]).where("_blocks > 1"))
    if parts.isEmpty():
        return rows.mapInArrow(tk.tidy(_whole), RESULT)
    # each block holds one conversation that goes on into the next at most, so there are no more parts than twice the blocks
    long_ones = rows.join(parts.select("conv_id", "_block"), _same(rows, parts), "left_semi")
    short_ones = rows.join(parts.select("conv_id", "_block"), _same(rows, parts), "left_anti").sortWithinPartitions("_row")
    return short_ones.mapInArrow(tk.tidy(_whole), RESULT).unionByName(_of_many_blocks(long_ones))


def _same(a: DataFrame, b: DataFrame) -> Column:
    return (a["_block"] == b["_block"]) & a["conv_id"].eqNullSafe(b["conv_id"])


def _with(rows: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows, in order, with what is known of their block."""
    return rows.join(facts, _same(rows, facts)).drop(facts["conv_id"], facts["_block"]).sortWithinPartitions("_row")


def _of_many_blocks(rows: DataFrame) -> DataFrame:
    name = F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text"))
    # dropped rows have no text that could be met again
    rows = rows.withColumn("name", F.when(F.col("dropped"), F.col("_row").cast("string")).otherwise(name))
    rows = settle(scans.seen(rows.drop("again"), ["conv_id"], "name", "again").drop("name").repartition("_block").sortWithinPartitions("_row"))
    sums = settle(rows.mapInArrow(tk.tidy(_summed), _ddl(PART)))
    folded = settle(sums.groupBy("conv_id").applyInArrow(_folded, _ddl(FOLDED)))
    traced = settle(_with(rows, folded.select("conv_id", "_block", "behind")).mapInArrow(tk.tidy(_traced), _ddl(TRACED)))
    entered = traced.select("conv_id", "_block", "exits").groupBy("conv_id").applyInArrow(_entered, _ddl(ENTERED))
    at = F.col("state").cast("int")
    known = traced.join(entered, _same(traced, entered)).select(traced["conv_id"], traced["_block"], F.get("audits", at).alias("audit"), F.get("exits", at).alias("left"), "state")
    known = settle(known.join(folded, _same(known, folded)).drop(folded["conv_id"], folded["_block"], "behind"))
    worded = _with(rows, known.select("conv_id", "_block", "audit", "state")).mapInArrow(tk.tidy(_worded), _ddl(WORDED))
    told = known.join(worded, _same(known, worded), "left").drop(worded["conv_id"], worded["_block"])
    # a row for each block: of the conversation itself nothing but its finished text goes through one task
    return told.repartition("conv_id").sortWithinPartitions("conv_id", "_block").mapInArrow(tk.tidy(_joined), RESULT)


def _ddl(schema: pa.Schema) -> str:
    kinds = {"int64": "long", "string": "string", "bool": "boolean", "list<item: int64>": "array<long>", "list<item: string>": "array<string>"}
    return ", ".join(f"{f.name} {kinds[str(f.type)]}" for f in schema)


def damaged(conversations: DataFrame) -> DataFrame:
    """The contract's damage, decided by crc32 of conv_id:turn: rows dropped (marked), emptied, freed of closing marks, repeated,
    given to the user."""
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select("conv_id", "turn", told("role").alias("role"), told("text").alias("text"), (F.crc32(F.concat(told("conv_id"), F.lit(":"), told("turn"))) % 20).alias("fate"))
    text = F.when(F.col("fate").isin(0, 1), "").when(F.col("fate") == 2, F.translate("text", CLOSING, "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fate") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("fate") == 0).alias("dropped"), copies.alias("copy")).drop("copy")


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(damaged(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


_TAIL = "right(rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1)"
#: For each state and edit: what it costs and leads to. Turns put in before a row come one after another, as often as there are states.
_ARCS = """arcs(st, initial, stays, letter, cost, next) AS (
  SELECT s, i, NULL, 'D', 4, s FROM range(4) a(s), (VALUES ('x'), ('s'), ('u'), ('a'), ('o')) b(i)
  UNION ALL SELECT s, i, true, 'R', 3, [2, 2, 3, 2][s + 1] FROM range(4) a(s), (VALUES ('s'), ('u'), ('a'), ('o')) b(i)
  UNION ALL VALUES (0, 's', true, 'K', 0, 1), (0, 'u', true, 'K', 0, 2), (1, 'u', true, 'K', 0, 2), (3, 'u', true, 'K', 0, 2), (2, 'a', true, 'K', 0, 3))"""
ORACLE = f"""WITH RECURSIVE {CRC_TABLE},
base AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  {crc32("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")} % 20 AS fate FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE WHEN fate = 4 THEN 'user' ELSE role END AS role,
  CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM base, range(2) c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
placed AS (SELECT *, row_number() OVER w AS place, {_TAIL} AS tail, lead(left(role, 1)) OVER w AS follows FROM damaged WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)),
met AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY place) > 1 AS again FROM placed),
marked AS (SELECT *, tail <> '' AND NOT again AND tail NOT IN ('.', '!', '?') AS cut,
  CASE WHEN tail = '' OR again THEN 'x' WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS initial FROM met),
{_ARCS},
ahead(st, inserts, here) AS (VALUES (0, 0, 0), (0, 1, 2), (0, 2, 3), (0, 3, 2), (1, 0, 1), (1, 1, 2), (1, 2, 3), (2, 0, 2), (2, 1, 3), (2, 2, 2), (3, 0, 3), (3, 1, 2), (3, 2, 3)),
walk AS (
  SELECT conv_id, 0::BIGINT AS place, 0 AS st, 0 AS cost, '' AS audit, []::STRUCT(role VARCHAR, text VARCHAR)[] AS turns FROM (SELECT DISTINCT conv_id FROM marked)
  UNION ALL
  SELECT conv_id, place, next, cost, audit, turns FROM (
    SELECT w.conv_id, m.place, a.next, w.cost + 3 * h.inserts + a.cost + CASE WHEN a.stays AND m.cut THEN 3 ELSE 0 END AS cost, w.audit || repeat('I', h.inserts) || a.letter AS audit,
      w.turns || list_transform(range(h.inserts), lambda k: {{'role': CASE WHEN (w.st = 2) = (k % 2 = 0) THEN 'assistant' ELSE 'user' END, 'text': ''}})
        || CASE WHEN a.stays THEN [{{'role': CASE WHEN a.letter = 'K' THEN m.role WHEN a.next = 3 THEN 'assistant' ELSE 'user' END, 'text': m.text}}] ELSE [] END AS turns
    FROM walk w JOIN marked m ON m.conv_id IS NOT DISTINCT FROM w.conv_id AND m.place = w.place + 1 JOIN ahead h ON h.st = w.st JOIN arcs a ON a.st = h.here AND a.initial = m.initial)
  QUALIFY row_number() OVER (PARTITION BY conv_id, next ORDER BY cost, audit) = 1),
done AS (SELECT * FROM (SELECT w.conv_id, w.cost + 3 * h.inserts AS cost, w.audit || repeat('I', h.inserts) AS audit,
    w.turns || list_transform(range(h.inserts), lambda k: {{'role': CASE WHEN (w.st = 2) = (k % 2 = 0) THEN 'assistant' ELSE 'user' END, 'text': ''}}) AS turns
  FROM walk w JOIN (SELECT conv_id, max(place) AS place FROM marked GROUP BY 1) l ON l.conv_id IS NOT DISTINCT FROM w.conv_id AND l.place = w.place JOIN ahead h ON h.st = w.st WHERE h.here IN (0, 3))
  QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY cost, audit) = 1),
faults AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (tail = '') AS blank, count(*) FILTER (tail <> '' AND again) AS duplicate,
  count(*) FILTER (cut) AS truncated, count(*) FILTER (follows IS NOT NULL AND left(role, 1) || follows NOT IN ('su', 'ua', 'au')) AS illegal FROM marked GROUP BY 1)
SELECT c.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit, sha256(coalesce(array_to_string(list_transform(turns, lambda x: x.role || ':' || x.text), chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN faults f ON f.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN done d ON d.conv_id IS NOT DISTINCT FROM c.conv_id"""
