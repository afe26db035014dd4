"""The prefix trie of conversations, by partition refinement.

All conversations start in one class, the root. Classes are split turn by turn: the members of a class whose next turns are equal
make a class of the next depth, named by a 128-bit fingerprint of its turns. A class of one member is retired: what is left of its
conversation is a chain that nobody shares and needs no more grouping. Several depths are split in one round, twice as many in each as
in the one before, so there are as many rounds as the longest shared prefix has binary digits.

Fold back: every node gives its leaf, or its saved tokens, to its smallest member. These nodes of a member lie below one another,
so a node's subtree is worth what its members are worth in all, but for its own smallest member, of which only nodes from this depth
on count: one sum over members and one running sum along each smallest member's nodes, instead of a walk from leaves to root.

A conversation of any length and a turn that any number of conversations share are many tasks' work (``scans``, ``facts``). The
members that end in a node are gathered in sorted blocks; only the SHA-256 of their list, sequential by nature, is taken in one
task, streamed block by block.

Defined cases: rows of a turn are ordered by role, then text; repeated rows are turns of their own; null role or text is empty and
a null turn comes first; rows without conv_id are left out; an empty table has no root and gives no rows; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilion.llm.sqltext import CRC_TABLE, crc32
from profilion.operators import facts, scans
from profilion.operators.scans import Scan
from profilion.session import settle

#: Depths of the first round; each one has twice as many as the one before.
FIRST = 4
NOBODY = hashlib.sha256(b"").hexdigest()
NODE = ["depth", "a", "b"]


def ordered(conversations: DataFrame, size: int = scans.BLOCK) -> DataFrame:
    """Placed turns: conv_id, nth (from 1), turn_name (a digest of role and text), bytes."""
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = conversations.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("turn_name", F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text")))).withColumn("bytes", F.octet_length("text").cast("long"))
    placed = scans.placed(rows, ["conv_id"], [F.col("turn").asc_nulls_first(), F.col("role"), F.substring("text", 1, 64)], ["text"], size, keep=["conv_id", "turn_name", "bytes"])
    return scans.scanned(placed, ["conv_id"], nth=Scan("sum", F.lit(1)))


def rebuilt(conversations: DataFrame, size: int = scans.BLOCK) -> tuple[DataFrame, DataFrame]:
    """The contract's conversations: (conv_id) of all, and their turns as (conv_id, depth, turn_name, bytes). The first h turns are those
    of conversation conv_id - conv_id % 5, h being crc32(conv_id) % 9; a conversation's own turns follow after its first h."""
    rows = settle(ordered(conversations, size))
    long = scans.blocks(rows, ["conv_id"])
    turns = long.groupBy("conv_id").agg(F.sum("_rows").alias("turns"))
    plan = turns.select("conv_id", (F.crc32(F.col("conv_id").cast("string").cast("binary")) % 9).alias("h"), (F.col("conv_id") - F.col("conv_id") % 5).alias("giver"))
    given = turns.select(F.col("conv_id").alias("giver"), F.col("turns").alias("has"))
    plan = settle(plan.join(given, "giver", "left").withColumn("takes", F.least("h", F.coalesce("has", F.lit(0)))).drop("has"))
    own = scans.told(rows, ["conv_id"], plan.select("conv_id", "h", "takes")).where("nth > h").withColumn("depth", F.col("takes") + F.col("nth") - F.col("h"))
    # no more than eight turns of a conversation are given, to four others and itself
    heads = rows.where("nth <= 8").select(F.col("conv_id").alias("giver"), F.col("nth").alias("depth"), "turn_name", "bytes")
    heads = plan.where("takes > 0").select("conv_id", "giver", "takes").join(heads, "giver").where("depth <= takes")
    columns = ["conv_id", "depth", "turn_name", "bytes"]
    return plan.select("conv_id"), own.select(columns).unionByName(heads.select(columns))


def paths(convs: DataFrame, turns: DataFrame, size: int = scans.BLOCK) -> DataFrame:
    """Placed rows, one for each conversation and depth from 0 on: the node it passes (a, b), that node's parent (up_a, up_b) and bytes."""
    tops = convs.select("conv_id", F.lit(0).cast("long").alias("depth"), F.lit(None).cast("binary").alias("turn_name"), F.lit(0).cast("long").alias("bytes"))
    rows = turns.select("conv_id", F.col("depth").cast("long"), "turn_name", "bytes").unionByName(tops)
    rows = rows.withColumn("x", F.when(F.col("depth") > 0, F.xxhash64("depth", "turn_name")).otherwise(0)).withColumn("y", F.when(F.col("depth") > 0, F.xxhash64("turn_name", F.lit("y"), "depth")).otherwise(0))
    rows = scans.placed(rows.drop("turn_name"), ["conv_id"], [F.col("depth")], size=size)
    rows = scans.scanned(rows, ["conv_id"], a=Scan("xor", F.col("x")), b=Scan("xor", F.col("y")))
    return settle(rows.withColumn("up_a", F.col("a").bitwiseXOR(F.col("x"))).withColumn("up_b", F.col("b").bitwiseXOR(F.col("y"))).drop("x", "y"))


def refined(rows: DataFrame, first: int = FIRST) -> tuple[DataFrame, DataFrame]:
    """Classes of two members or more (conv_id is the smallest), and the conversations that were retired with the depth, and the
    parent's name, of their first node of their own."""
    shared, alone, left, done, width = [], [], rows, -1, first
    while True:
        done, width = done + width, 2 * width
        now = left.where(F.col("depth") <= done)
        classes = settle(now.groupBy(*NODE).agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs"), F.max("bytes").alias("bytes"), F.max("up_a").alias("up_a"), F.max("up_b").alias("up_b")))
        shared.append(classes.where("n_convs > 1").select("conv_id", *NODE, "n_convs", "bytes", "up_a", "up_b"))
        single = classes.where("n_convs = 1").groupBy("conv_id").agg(F.min(F.struct("depth", "up_a", "up_b")).alias("s"))
        alone.append(settle(single.select("conv_id", F.col("s.depth").alias("from"), F.col("s.up_a").alias("up_a"), F.col("s.up_b").alias("up_b"))))
        left = settle(scans.told(left.where(F.col("depth") > done), ["conv_id"], alone[-1].select("conv_id", F.lit(True).alias("retired"))).where("retired IS NULL").drop("retired"))
        if left.isEmpty():
            return reduce(DataFrame.unionByName, shared), reduce(DataFrame.unionByName, alone)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The SHA-256 of each node's lists of members, joined by commas in order."""
    now, digest, out = None, None, []
    for batch in batches:
        for depth, a, b, ids in zip(*(batch.column(k).to_pylist() for k in (*NODE, "ids"))):
            if (depth, a, b) != now:
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (depth, a, b), hashlib.sha256()
            else:
                digest.update(b",")
            digest.update(ids.encode())
        yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), o)) for o in out], HASHED)
        out = []
    if now is not None:
        yield pa.RecordBatch.from_pylist([dict(zip((*NODE, "ends"), (*now, digest.hexdigest())))], HASHED)


HASHED = pa.schema([*[(k, pa.int64()) for k in NODE], ("ends", pa.string())])


def ends_of(rows: DataFrame, size: int = scans.BLOCK) -> DataFrame:
    """The hash of the members, of rows (conv_id, depth, a, b), that end in each node."""
    placed = scans.placed(rows.select("conv_id", *NODE), NODE, [F.col("conv_id")], size=size)
    lists = placed.groupBy(*NODE, "_block").agg(F.array_join(F.transform(F.sort_array(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))
    return lists.repartition(*NODE).sortWithinPartitions(*NODE, "_block").mapInArrow(_hashed, "depth long, a long, b long, ends string")


def trie(convs: DataFrame, turns: DataFrame, size: int = scans.BLOCK, first: int = FIRST) -> DataFrame:
    """Nodes of the trie of sequences: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256).

    convs: (conv_id), each once, those without turns too. turns: (conv_id, depth, turn_name, bytes), depths from 1 without gaps."""
    rows = paths(convs, turns, size)
    shared, alone = refined(rows, first)
    lengths = rows.groupBy("conv_id").agg(F.max("depth").alias("length"))
    children = shared.select(F.col("depth") - 1, "up_a", "up_b").union(alone.select(F.col("from") - 1, "up_a", "up_b")).toDF(*NODE).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    shared = shared.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0).cast("long")))
    shared = settle(shared.withColumn("saved", (F.col("n_convs") - 1) * F.col("bytes")).drop("bytes"))
    # what each conversation is worth as the smallest member of nodes
    worth = shared.groupBy("conv_id").agg(F.sum("saved").alias("worth"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    each = settle(lengths.join(worth, "conv_id", "left").join(alone.select("conv_id", "from"), "conv_id", "left").select(
        "conv_id", "length", "from", F.coalesce("worth", F.lit(0)).alias("worth"), F.when(F.col("from").isNotNull(), 1).otherwise(F.coalesce("leaf", F.lit(0))).alias("leaf")))
    known = settle(scans.told(rows, ["conv_id"], each))
    grouped = known.where("from IS NULL OR depth < from")
    sums = grouped.groupBy(*NODE).agg(F.sum("worth").alias("all_worth"), F.sum("leaf").alias("n_leaves"))
    ends = ends_of(grouped.where("depth = length"), size)
    # along the nodes of one smallest member: what lies above each of them does not count
    chained = scans.scanned(scans.placed(shared, ["conv_id"], [F.col("depth")], size=size), ["conv_id"], above=Scan("sum", F.col("saved"), before=True))
    nodes = chained.join(sums, NODE).join(ends, NODE, "left")
    nodes = nodes.select("conv_id", *NODE, "up_a", "up_b", "n_convs", "n_children", "n_leaves", (F.col("all_worth") - F.coalesce("above", F.lit(0))).alias("saved_tokens"), F.coalesce("ends", F.lit(NOBODY)).alias("ends_sha256"))
    nodes = settle(nodes)
    tails = known.where("depth >= from").select(
        "conv_id", *NODE, "up_a", "up_b", F.lit(1).cast("long").alias("n_convs"), (F.col("depth") < F.col("length")).cast("long").alias("n_children"), F.lit(1).cast("long").alias("n_leaves"),
        F.lit(0).cast("long").alias("saved_tokens"), F.when(F.col("depth") == F.col("length"), F.sha2(F.col("conv_id").cast("string"), 256)).otherwise(NOBODY).alias("ends_sha256"), (F.col("depth") > F.col("from")).alias("inner"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("a").alias("up_a"), F.col("b").alias("up_b"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("wanted"))
    wanting = nodes.withColumn("inner", F.lit(False)).unionByName(tails.where("NOT inner"))
    found = facts.joined(wanting, parents, ["depth", "up_a", "up_b"], "wanted", nodes.count() + alone.count())
    found = found.unionByName(tails.where("inner").withColumn("parent_conv_id", F.col("conv_id")))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def op13_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


ORACLE = f"""WITH {CRC_TABLE},
own AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS nth, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS turn
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT conv_id, {crc32("conv_id::VARCHAR")} % 9 AS h, conv_id - conv_id % 5 AS giver FROM (SELECT DISTINCT conv_id FROM own), crc_table),
laid AS (SELECT c.conv_id, 0 AS part, o.nth, o.turn FROM convs c JOIN own o ON o.conv_id = c.giver AND o.nth <= c.h UNION ALL SELECT c.conv_id, 1, o.nth, o.turn FROM convs c JOIN own o ON o.conv_id = c.conv_id AND o.nth > c.h),
lists AS (SELECT c.conv_id, coalesce(list(turn ORDER BY part, nth) FILTER (turn IS NOT NULL), []) AS turns FROM convs c LEFT JOIN laid l USING (conv_id) GROUP BY 1),
passed AS (SELECT conv_id, d AS depth, turns[1:d] AS path, len(turns) = d AS ends FROM lists, LATERAL (SELECT unnest(range(len(turns) + 1)) AS d)),
nodes AS (SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM passed GROUP BY 1, 2),
inner_nodes AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children, min(depth) - 1 AS depth FROM nodes WHERE depth > 0 GROUP BY 1),
worth AS (SELECT n.*, coalesce(i.n_children, 0) AS n_children, CASE WHEN n.depth > 0 THEN (n.n_convs - 1) * strlen(n.path[n.depth].text) ELSE 0 END AS saved FROM nodes n LEFT JOIN inner_nodes i ON i.path = n.path AND i.depth = n.depth),
above AS (SELECT path[1:d] AS path, d AS depth, (n_children = 0)::INT AS leaf, saved FROM worth, LATERAL (SELECT unnest(range(depth + 1)) AS d)),
summed AS (SELECT path, depth, sum(leaf)::BIGINT AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY 1, 2)
SELECT w.conv_id, w.depth, p.conv_id AS parent_conv_id, w.n_convs, w.n_children, s.n_leaves, s.saved_tokens, w.ends_sha256
FROM worth w JOIN summed s ON s.path = w.path AND s.depth = w.depth LEFT JOIN nodes p ON p.depth = w.depth - 1 AND p.path = w.path[1:w.depth - 1]"""
