"""The trie of common beginnings of conversations, by ternary search trees on range shards.

1. Distinct turns (role, text) become numbers in their order, and conversations
   sequences of them; equal sequences are one *class*.
2. Classes are dealt, in the order of their sequences, to range shards of a
   bounded number of turns.  A shard puts its sequences into a ternary search
   tree, medians first so that the trees of siblings are balanced, and one
   iterative pass from the last node to the first adds up members, leaves and
   savings.
3. As shards are ranges, a node can lie in several shards only if it is on the
   path of a shard's first or last sequence.  These *boundary nodes* are merged
   by a digest of their path; what was counted once per shard is corrected where
   a node begins, and the corrections reach its ancestors along that shard's
   last path.  All other nodes are final in their shard.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import written
from tallyspark.llm.merkle import crc32_sql
from tallyspark.operators.sequence import rank_in_group, with_sequence

#: Turns of a shard (a single longer sequence is a shard of its own).
SHARD_TURNS = 100_000
#: Ids in a piece of text that one step of the digest of members handles.
PIECE_IDS = 50_000
#: Boundary nodes that may be broadcast (about 150 bytes each).
BROADCAST_NODES = 200_000
#: Conversations share the beginnings of each hundredth one, of fewer than this number of turns.
GROUP, HEADS = 100, 6


def coded_turns(conversations: DataFrame) -> DataFrame:
    """``conv_id, pos, turn_id, n_chars``: the turns of each conversation, numbered from 1.

    Turns are ordered by ``turn`` (null first), ties by role and text; null
    roles and texts are empty.  ``turn_id`` numbers distinct (role, text) in
    their order.  Rows with a null ``conv_id`` are left out.
    """
    rows = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    numbers = with_sequence(rows.select("role", "text").distinct(), ["role", "text"], "turn_id")
    coded = rows.join(numbers, ["role", "text"]).select("conv_id", "turn", "turn_id", F.length("text").alias("n_chars"))
    return rank_in_group(coded, ["conv_id"], ["turn", "turn_id"], "pos").select("conv_id", "pos", "turn_id", "n_chars")


def with_shared_heads(turns: DataFrame) -> DataFrame:
    """``turns`` where each conversation c begins like conversation c - c % 100.

    Its first h turns (all, if there are fewer; none, if it is absent) replace
    c's own first h ones; h is the unsigned crc32 of c in decimal, modulo 6.  A
    row without a ``turn_id`` stands for the conversation itself.
    """
    convs = turns.select("conv_id").distinct().select(
        "conv_id", (F.col("conv_id") - F.col("conv_id") % GROUP).alias("base"),
        (F.crc32(F.col("conv_id").cast("string")) % HEADS).alias("h"))
    bases = turns.where((F.col("conv_id") % GROUP == 0) & (F.col("pos") < HEADS))
    heads = (bases.withColumnRenamed("conv_id", "base").join(convs, "base").where("pos <= h")
             .select("conv_id", "pos", "turn_id", "n_chars"))
    own = turns.where(F.col("pos") > F.crc32(F.col("conv_id").cast("string")) % HEADS)
    none = convs.select("conv_id", F.lit(0).cast("long").alias("pos"), F.lit(None).cast("long").alias("turn_id"),
                        F.lit(0).alias("n_chars"))
    return heads.unionByName(own).unionByName(none)


def sequences(turns: DataFrame) -> DataFrame:
    """``conv_id, seq, chars, k``: turn ids and text lengths in order, and a digest of the sequence."""
    ordered = F.array_sort(F.filter(F.collect_list(F.struct("pos", "turn_id", "n_chars")), lambda t: t["turn_id"].isNotNull()))
    rows = turns.groupBy("conv_id").agg(ordered.alias("t")).select(
        "conv_id", F.col("t.turn_id").alias("seq"), F.col("t.n_chars").alias("chars"))
    return rows.withColumn("k", F.sha2(F.concat_ws(",", F.col("seq").cast("array<string>")), 256))


def ids_digest(members: DataFrame) -> DataFrame:
    """``k, ends_sha256``: sha256 of each class's decimal ids, ascending, joined by commas.

    Ids are sorted over many tasks, which join them to pieces; only pieces meet
    in the task that hashes a class, as a stream.
    """
    ranged = members.select("k", "conv_id").repartitionByRange("k", "conv_id").sortWithinPartitions("k", "conv_id")

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, ids = b.column(0).to_pylist(), b.column(1).to_pylist()
            out, start = [], 0
            for i in range(1, len(keys) + 1):
                if i == len(keys) or keys[i] != keys[start] or i - start == PIECE_IDS:
                    out.append((keys[start], ids[start], ",".join(map(str, ids[start:i]))))
                    start = i
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.string()))],
                                             ["k", "low", "ids"])

    def digests(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state = None, None
        for b in batches:
            done = []
            for k, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist()):
                if k != key:
                    if state is not None:
                        done.append((key, state.hexdigest()))
                    key, state = k, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield _strings(done, "k", "ends_sha256")
        if state is not None:
            yield _strings([(key, state.hexdigest())], "k", "ends_sha256")

    joined = ranged.mapInArrow(pieces, "k string, low long, ids string")
    return joined.repartition("k").sortWithinPartitions("k", "low").mapInArrow(digests, "k string, ends_sha256 string")


def _strings(rows: list[tuple], *names: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in zip(*rows)], list(names))


class TernaryTree:
    """Sequences of numbers in a ternary search tree; node 0 is the empty beginning."""

    def __init__(self):
        self.key, self.below, self.above, self.first = [None], [-1], [-1], [-1]
        self.parent, self.depth, self.chars = [-1], [0], [0]
        self.members, self.low, self.ends = [0], [None], [None]

    def insert(self, seq: list[int], chars: list[int], members: int, low: int, ends: str) -> int:
        """Add a sequence that ``members`` conversations have, the smallest of them ``low``."""
        node = 0
        for turn, n in zip(seq, chars):
            link, at, there = self.first, node, self.first[node]
            while there >= 0 and self.key[there] != turn:
                link, at = (self.below if turn < self.key[there] else self.above), there
                there = link[at]
            if there < 0:
                there = link[at] = self._new(turn, n, node)
            node = there
        self.members[node], self.low[node], self.ends[node] = members, low, ends
        return node

    def _new(self, turn: int, n: int, parent: int) -> int:
        for column, value in ((self.key, turn), (self.below, -1), (self.above, -1), (self.first, -1), (self.parent, parent),
                              (self.depth, self.depth[parent] + 1), (self.chars, n), (self.members, 0), (self.low, None),
                              (self.ends, None)):
            column.append(value)
        return len(self.key) - 1

    def totals(self) -> tuple[list[int], list[int], list[int]]:
        """Add members and smallest ids up to the root; children, leaves and savings of each node's subtree."""
        size = len(self.key)
        children, leaves, saved = [0] * size, [0] * size, [0] * size
        for node in range(size - 1, -1, -1):  # a node comes after its parent
            leaves[node] = leaves[node] or 1
            saved[node] += (self.members[node] - 1) * self.chars[node]
            up = self.parent[node]
            if up >= 0:
                self.members[up] += self.members[node]
                self.low[up] = self.low[node] if self.low[up] is None else min(self.low[up], self.low[node])
                children[up] += 1
                leaves[up] += leaves[node]
                saved[up] += saved[node]
        return children, leaves, saved

    def path(self, node: int) -> list[int]:
        """The nodes from the root to ``node``."""
        out = []
        while node >= 0:
            out.append(node)
            node = self.parent[node]
        return out[::-1]


def _medians_first(n: int) -> Iterator[int]:
    """0 to n - 1: the middle one first, then the middles of both halves, and so on."""
    open_ranges = [(0, n)]
    while open_ranges:
        a, b = open_ranges.pop()
        if a < b:
            middle = (a + b) // 2
            yield middle
            open_ranges += [(middle + 1, b), (a, middle)]


_NODE = [("shard", pa.int64()), ("path", pa.string()), ("parent_path", pa.string()), ("on_last", pa.bool_()), ("depth", pa.int64()),
         ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("n_convs", pa.int64()), ("n_children", pa.int64()),
         ("n_leaves", pa.int64()), ("saved_tokens", pa.int64()), ("chars", pa.int64()), ("ends_sha256", pa.string())]
_NODE_SCHEMA = ("shard long, path string, parent_path string, on_last boolean, depth long, conv_id long, parent_conv_id long, "
                "n_convs long, n_children long, n_leaves long, saved_tokens long, chars long, ends_sha256 string")


def _shard(number: int, classes: list[tuple]) -> pa.RecordBatch:
    """The nodes of a shard of classes (seq, chars, members, low, ends), which ascend by seq.

    ``path`` is given for nodes that other shards may have, ``parent_path`` for
    nodes whose parent is one.
    """
    tree, ends = TernaryTree(), {}
    for i in _medians_first(len(classes)):
        ends[i] = tree.insert(*classes[i])
    children, leaves, saved = tree.totals()
    digests: dict[int, str] = {}
    last = set(tree.path(ends[len(classes) - 1]))
    for node in [*tree.path(ends[0]), *tree.path(ends[len(classes) - 1])]:
        if node not in digests:
            above = digests.get(tree.parent[node], "")
            digests[node] = hashlib.blake2b(f"{above},{tree.key[node]}".encode(), digest_size=16).hexdigest()
    size = len(tree.key)
    at = range(size)
    inner = [tree.parent[i] >= 0 and tree.parent[i] not in digests for i in at]
    columns = [
        [number] * size, [digests.get(i) for i in at], [digests.get(tree.parent[i]) for i in at], [i in last for i in at],
        tree.depth, tree.low, [tree.low[tree.parent[i]] if inner[i] else None for i in at], tree.members, children, leaves, saved,
        tree.chars, tree.ends]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _NODE)], [n for n, _ in _NODE])


def shard_nodes(classes: DataFrame) -> DataFrame:
    """Nodes of all shards of ``classes`` (``class_id`` in the order of ``seq``, and what ``_shard`` takes)."""
    turns = classes.agg(F.sum(F.size("seq"))).first()[0] or 0
    ranged = (classes.select("class_id", "seq", "chars", "members", "low", "ends_sha256")
              .repartitionByRange(max(1, -(-turns // SHARD_TURNS)), "class_id").sortWithinPartitions("class_id"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        held, size = [], 0
        for b in batches:
            for row in zip(*(b.column(i).to_pylist() for i in range(1, 6))):
                held.append(row)
                size += len(row[0]) + 1
                if size >= SHARD_TURNS:
                    yield _shard(number, held)
                    held, size, number = [], 0, number + 1
        if held:
            yield _shard(number, held)

    return ranged.mapInArrow(run, _NODE_SCHEMA)


def merge_boundaries(nodes: DataFrame) -> DataFrame:
    """One row per node of the whole trie from the nodes of its shards."""
    several = nodes.where("path is not null")
    merged = written(several.groupBy("path").agg(
        F.min("parent_path").alias("parent_path"), F.min("depth").alias("depth"), F.min("conv_id").alias("conv_id"),
        F.sum("n_convs").alias("n_convs"), F.sum("n_children").alias("children"), F.sum("n_leaves").alias("leaves"),
        F.sum("saved_tokens").alias("saved"), F.max("ends_sha256").alias("ends_sha256"), F.min("shard").alias("shard"),
        F.count("*").alias("times"), ((F.count("*") - 1) * F.max("chars")).alias("more_saved"),
        # A node without children in a shard was a leaf there; at most one of these counts, if it has none at all.
        F.when(F.sum("n_children") == 0, 1 - F.count("*")).otherwise(-F.count(F.when(F.col("n_children") == 0, 1)))
        .alias("more_leaves")), "boundary")
    # Corrections arise in a node's first shard and go up that shard's last path.
    upward = Window.partitionBy("shard").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    lasts = several.where("on_last").select("path", "shard", "depth")
    own = merged.where("times > 1").select("path", "shard", "more_saved", "more_leaves")
    rising = (lasts.join(own, ["path", "shard"], "left").fillna(0, ["more_saved", "more_leaves"])
              .withColumns({"up_saved": F.sum("more_saved").over(upward), "up_leaves": F.sum("more_leaves").over(upward)})
              .groupBy("path").agg(F.sum("up_saved").alias("up_saved"), F.sum("up_leaves").alias("up_leaves")))
    twice = merged.where("times > 1").groupBy(F.col("parent_path").alias("path")).agg(F.sum(F.col("times") - 1).alias("twice"))
    whole = (merged.join(rising, "path", "left").join(twice, "path", "left").fillna(0, ["up_saved", "up_leaves", "twice"])
             .select("path", "parent_path", "depth", "conv_id", F.lit(None).cast("long").alias("parent_conv_id"), "n_convs",
                     (F.col("children") - F.col("twice")).alias("n_children"), (F.col("leaves") + F.col("up_leaves")).alias("n_leaves"),
                     (F.col("saved") + F.col("up_saved")).alias("saved_tokens"), "ends_sha256"))
    whole = written(whole, "boundary")
    parents = whole.select(F.col("path").alias("parent_path"), F.col("conv_id").alias("above"))
    parents = F.broadcast(parents) if parents.count() <= BROADCAST_NODES else parents
    inner = nodes.where("path is null").select(*whole.columns)
    below = inner.where("parent_path is not null").unionByName(whole).join(parents, "parent_path", "left")
    below = below.withColumn("parent_conv_id", F.col("above")).select(*whole.columns)
    return inner.where("parent_path is null").unionByName(below).drop("path", "parent_path")


def trie(turns: DataFrame) -> DataFrame:
    """``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256`` of each node.

    ``turns``: ``conv_id, pos, turn_id, n_chars`` (a null ``turn_id``: the
    conversation has no turn of its own there).  A node stands for a sequence of
    turns that at least one conversation begins with; the root, for the empty
    one, has all.  A conversation without turns is a member of the root only; no
    conversation at all: no node.  The turn ids of a conversation (8 bytes each)
    are held by one task; otherwise tasks hold ``SHARD_TURNS`` turns.
    """
    built = written(sequences(turns), "sequences")
    classes = built.groupBy("k").agg(F.first("seq").alias("seq"), F.first("chars").alias("chars"), F.count("*").alias("members"),
                                     F.min("conv_id").alias("low"))
    classes = with_sequence(classes, ["seq"], "class_id").join(ids_digest(built), "k")
    nodes = written(shard_nodes(written(classes, "classes")), "nodes")
    empty = hashlib.sha256(b"").hexdigest()
    return merge_boundaries(nodes).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(empty)).alias("ends_sha256"))


ORACLE = f"""
WITH own AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos
  FROM conversations WHERE conv_id IS NOT NULL),
ids AS (SELECT DISTINCT conv_id, conv_id::VARCHAR AS name FROM own),
convs AS (SELECT conv_id, conv_id - conv_id % {GROUP} AS base, {crc32_sql('name')} % {HEADS} AS h FROM ids),
parts AS (
  SELECT c.conv_id, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.base WHERE pos <= h
  UNION ALL SELECT c.conv_id, pos, role, text FROM convs c JOIN own o ON o.conv_id = c.conv_id WHERE pos > h),
built AS (
  SELECT c.conv_id, coalesce(list({{'role': role, 'text': text}} ORDER BY pos) FILTER (pos IS NOT NULL), []) AS s
  FROM convs c LEFT JOIN parts p USING (conv_id) GROUP BY c.conv_id),
beginnings AS (SELECT conv_id, s, d, s[1:d] AS prefix FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM built)),
nodes AS (
  SELECT prefix, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    coalesce((count(*) - 1) * length(any_value(prefix[d].text)), 0) AS own_saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (len(s) = d), '')) AS ends_sha256
  FROM beginnings GROUP BY prefix, d),
children AS (SELECT prefix[1:depth - 1] AS prefix, depth - 1 AS depth, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
counted AS (SELECT n.*, coalesce(c.n, 0) AS n_children FROM nodes n LEFT JOIN children c USING (prefix, depth)),
below AS (
  SELECT prefix[1:k] AS prefix, k AS depth, sum(CASE WHEN n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum(own_saved) AS saved
  FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM counted) GROUP BY ALL)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, CAST(b.n_leaves AS BIGINT) AS n_leaves,
  CAST(b.saved AS BIGINT) AS saved_tokens, n.ends_sha256
FROM counted n JOIN below b USING (prefix, depth) LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.prefix = n.prefix[1:n.depth - 1]
"""
