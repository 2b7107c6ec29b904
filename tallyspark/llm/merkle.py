"""A Merkle manifest of a table, with a proof for every row, by cogrouped subtree exchange.

Leaves of a group stand in a fixed order; while a group has several nodes, every
16 consecutive ones (a run; the last may be shorter) become the hash of their
concatenation.  A *superblock* is a subtree of three such levels, 4,096 nodes.

* Upwards, each superblock is reduced where its nodes are, which leaves one node
  in 4,096, until every group has one: its subroot.  The subroots, in the order
  of their groups, are the leaves of the last tree.
* Downwards, the siblings that a superblock's nodes share outside it (its outer
  nodes) meet the nodes themselves in one cogroup by superblock, which finishes
  the local reduction, joins local and outer siblings to proofs and, for leaves,
  folds them.  No task holds more than a superblock and a path.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.common import written
from tallyspark.operators.sequence import rank_in_group

#: Nodes of a run, levels of a superblock, and its nodes.
RUN, LEVELS = 16, 3
BLOCK = RUN ** LEVELS
#: Characters of a digest in hex.
HEX = 64
#: Groups whose sizes may be broadcast (about 100 bytes each).
BROADCAST_GROUPS = 100_000

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _digest(joined: str) -> str:
    return hashlib.sha256(joined.encode()).hexdigest()


def leaf_hash(values: Sequence[Column]) -> Column:
    """Hex sha256 of the values, each ``-`` if null, else its UTF-8 byte count, ``:`` and itself."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*[F.when(t.isNull(), F.lit("-")).otherwise(
        F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts]).cast("binary"), 256)


def tampered_text(key: Column, text: Column) -> Column:
    """``text`` with A-Z lower-cased where 5 divides crc32(key as text); elsewhere as it is (null keys too)."""
    touched = F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))
    return F.when(touched, F.translate(text, _UPPER, _LOWER)).otherwise(text)


def _levels(n: int, most: int) -> int:
    """Levels by which a superblock of a group of ``n`` nodes is reduced."""
    levels = 0
    while n > 1 and levels < most:
        n, levels = -(-n // RUN), levels + 1
    return levels


def _runs(nodes: list[str], levels: int) -> tuple[list[list[str]], str]:
    """The joined runs of each level of a superblock, and the node that is left."""
    joined = []
    for _ in range(levels):
        runs = ["".join(nodes[i:i + RUN]) for i in range(0, len(nodes), RUN)]
        joined.append(runs)
        nodes = [_digest(r) for r in runs]
    return joined, nodes[0]


def _steps(joined: list[list[str]], i: int) -> tuple[list[int], list[str]]:
    """Place in its run and the siblings (joined) of node ``i`` at each level."""
    places, others = [], []
    for runs in joined:
        at = i % RUN
        i //= RUN
        places.append(at)
        others.append(runs[i][:HEX * at] + runs[i][HEX * (at + 1):])
    return places, others


def fold(node: str, places: Sequence[int], others: Sequence[str]) -> str:
    """The root that a node and its siblings lead to."""
    for at, around in zip(places, others):
        node = _digest(around[:HEX * at] + node + around[HEX * at:])
    return node


def _reduced(nodes: DataFrame) -> DataFrame:
    """``grp, pos, n, node``: one node per superblock of ``nodes`` (same columns)."""
    def reduce(block: pd.DataFrame) -> pd.DataFrame:
        ordered = block.sort_values("pos")
        _, top = _runs(ordered["node"].tolist(), _levels(int(ordered["n"].iloc[0]), LEVELS))
        return pd.DataFrame({"grp": [ordered["grp"].iloc[0]], "pos": [ordered["pos"].iloc[0] // BLOCK],
                             "n": [-(-int(ordered["n"].iloc[0]) // BLOCK)], "node": [top]})

    return (nodes.select("grp", "pos", "n", "node", F.expr(f"pos div {BLOCK}").alias("block")).groupBy("grp", "block")
            .applyInPandas(reduce, "grp string, pos long, n long, node string"))


def _stages(nodes: DataFrame, name: str) -> list[DataFrame]:
    """``nodes`` and its reductions, until every group has one node."""
    stages = [nodes]
    while (stages[-1].agg(F.max("n")).first()[0] or 0) > 1:
        stages.append(written(_reduced(stages[-1]), name))
    return stages


#: Outer nodes of a superblock (or of one node): from the inside out, place and joined siblings of each level.
_OUTER = "grp string, pos long, places array<int>, others array<string>, subroot string, root string"


def _exchange(nodes: DataFrame, outer: DataFrame) -> DataFrame:
    """The outer nodes of each node, from those of the superblocks that ``nodes`` form."""
    def join(block: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        ordered, up = block.sort_values("pos"), around.iloc[0]
        joined, _ = _runs(ordered["node"].tolist(), _levels(int(ordered["n"].iloc[0]), LEVELS))
        steps = [_steps(joined, i) for i in range(len(ordered))]
        return pd.DataFrame({"grp": ordered["grp"], "pos": ordered["pos"],
                             "places": [[*p, *up["places"]] for p, _ in steps],
                             "others": [[*o, *up["others"]] for _, o in steps],
                             "subroot": up["subroot"], "root": up["root"]})

    return (nodes.select("grp", "pos", "n", "node", F.expr(f"pos div {BLOCK}").alias("block")).groupBy("grp", "block")
            .cogroup(outer.groupBy("grp", "pos")).applyInPandas(join, _OUTER))


def _down(stages: list[DataFrame], outer: DataFrame, name: str) -> DataFrame:
    """The outer nodes of the superblocks of ``stages[0]``, from those of the last stage's nodes."""
    for nodes in reversed(stages[1:-1]):
        outer = written(_exchange(nodes, outer), name)
    return outer


def _finish(leaves: DataFrame, outer: DataFrame) -> DataFrame:
    """The last exchange: proofs of leaves, and what ``shown`` leaves fold to."""
    def join(block: pd.DataFrame, around: pd.DataFrame) -> pd.DataFrame:
        ordered, up = block.sort_values("pos"), around.iloc[0]
        joined, _ = _runs(ordered["node"].tolist(), _levels(int(ordered["n"].iloc[0]), LEVELS))
        proofs, folded = [], []
        for i, shown in enumerate(ordered["shown"].tolist()):
            places, others = _steps(joined, i)
            places += list(up["places"])
            others += list(up["others"])
            proofs.append(_digest("".join(others)))
            folded.append(fold(shown, places, others))
        return pd.DataFrame({"key": ordered["key"], "leaf": ordered["node"], "subroot": up["subroot"], "root": up["root"],
                             "proof_sha256": proofs, "folded_root": folded})

    return (leaves.select("grp", "pos", "n", "node", "shown", "key", F.expr(f"pos div {BLOCK}").alias("block"))
            .groupBy("grp", "block").cogroup(outer.groupBy("grp", "pos"))
            .applyInPandas(join, "key string, leaf string, subroot string, root string, proof_sha256 string, folded_root string"))


def manifest(rows: DataFrame, values: Sequence[Column], shown: Sequence[Column], group: str = "source",
             key: str = "doc_id") -> DataFrame:
    """``key, leaf, subroot, root, proof_sha256, folded_root, verified`` of each row.

    ``values`` are hashed to the row's leaf, ``shown`` to the leaf that a
    reader presents: ``folded_root`` is what it folds to with the row's proof,
    and ``verified`` tells whether that is the root.

    Leaves of a group ascend by key (null first; rows that share a key: by their
    leaf, so equal rows are interchangeable); groups ascend bytewise (null
    first, a group like any other).  Null values have their own encoding, so a
    null differs from an empty text.  An empty table has no root: the result is
    empty.  Other columns of ``rows`` play no part.
    """
    # A prefix tells null from the empty name and keeps the order: "-" is less than "=".
    grp = F.coalesce(F.concat(F.lit("="), F.col(f"`{group}`").cast("string")), F.lit("-"))
    slim = rows.select(grp.alias("grp"), F.col(f"`{key}`").alias("key"), leaf_hash(values).alias("node"),
                       leaf_hash(shown).alias("shown"))
    leaves = _placed(slim, "grp", ["key", "node", "shown"]).withColumn("key", F.col("key").cast("string"))
    stages = _stages(written(leaves, "merkle"), "merkle")
    tops = stages[-1].select("grp", F.col("node").alias("subroot"))
    roots = _stages(written(_placed(tops.select(F.lit("").alias("grp"), F.col("grp").alias("key"), F.col("subroot").alias("node")),
                                    "grp", ["key"]), "merkle"), "merkle")
    # Downwards: from the root to the groups, and from the groups to the superblocks of leaves.
    none = F.array().cast("array<int>"), F.array().cast("array<string>")
    outer = roots[-1].select("grp", "pos", none[0].alias("places"), none[1].alias("others"), F.lit("").alias("subroot"),
                             F.col("node").alias("root"))
    if len(roots) > 1:
        outer = written(_exchange(roots[0], _down(roots, outer, "merkle")), "merkle")
    of_group = (roots[0].select("pos", F.col("key").alias("name"), F.col("node").alias("top"))
                .join(outer.drop("grp", "subroot"), "pos")
                .select(F.col("name").alias("grp"), F.lit(0).cast("long").alias("pos"), "places", "others",
                        F.col("top").alias("subroot"), "root"))
    found = _finish(stages[0], _down(stages, of_group, "merkle"))
    return found.select(F.col("key").cast(rows.schema[key].dataType).alias(key), "leaf", "subroot", "root", "proof_sha256",
                        "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def _placed(rows: DataFrame, group: str, order: Sequence[str]) -> DataFrame:
    """``rows`` with their place ``pos`` in the group's order (from 0) and the group's size ``n``."""
    ranked = written(rank_in_group(rows, [group], list(order), "pos").withColumn("pos", F.col("pos") - 1), "placed")
    sizes = ranked.groupBy(group).agg(F.count("*").alias("n"))
    return ranked.join(F.broadcast(sizes) if sizes.count() <= BROADCAST_GROUPS else sizes, group)


def documents_manifest(docs: DataFrame) -> DataFrame:
    """The manifest of ``documents``, held against a copy whose texts were partly lower-cased."""
    columns = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    return manifest(docs, columns, [*columns[:-1], tampered_text(columns[0], columns[-1])])


#: Levels of the trees that the SQL spells out: 16**5 rows of a source, 16**3 sources.
_ORACLE_LEVELS = (5, 3)


def crc32_sql(text: str) -> str:
    """DuckDB SQL for the unsigned crc32 of an ASCII string expression (bitwise, polynomial 0xEDB88320)."""
    return (f"xor(4294967295::BIGINT, list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, len({text}) + 1), "
            f"lambda i: ascii(({text})[i])::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], "
            "[0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) "
            "ELSE x >> 1 END)))")


def _oracle() -> str:
    def leaf(text: str) -> str:
        parts = [f"CASE WHEN {v} IS NULL THEN '-' ELSE strlen({v}::VARCHAR) || ':' || {v}::VARCHAR END"
                 for v in ("doc_id", "source", "lang", "n_chars", text)]
        return f"sha256({' || '.join(parts)})"

    def tree(name: str, start: str, group: str, levels: int) -> str:
        """Tables ``{name}0`` (grp, p, node, n) and onwards, with the joined runs of each in ``{name}_runs{level}``."""
        sql = f"{name}0 AS (SELECT {group} AS grp, p, node, count(*) OVER (PARTITION BY {group}) AS n FROM {start})"
        for i in range(levels):
            sql += f""",
{name}_runs{i} AS (SELECT grp, p // 16 AS run, string_agg(node, '' ORDER BY p) AS joined, any_value(n) AS n FROM {name}{i} GROUP BY ALL),
{name}{i + 1} AS (SELECT grp, run AS p, CASE WHEN n > 1 THEN sha256(joined) ELSE joined END AS node, (n + 15) // 16 AS n FROM {name}_runs{i})"""
        return sql

    def climb(name: str, at: str, levels: int, first: str) -> str:
        """Chained tables that extend ``proof`` and ``shown`` of each row by the siblings of each level."""
        sql, last = "", first
        for i in range(levels):
            around = "(joined[1:64 * (p % 16)] {} joined[64 * (p % 16 + 1) + 1:])"
            sql += f""",
{name}_up{i} AS (SELECT x.* EXCLUDE ({at}, p, proof, shown), {at}, p // 16 AS p,
    CASE WHEN r.n > 1 THEN proof || {around.format('||')} ELSE proof END AS proof,
    CASE WHEN r.n > 1 THEN sha256({around.format('|| shown ||')}) ELSE shown END AS shown
  FROM {last} x JOIN {name}_runs{i} r ON r.grp = x.{at} AND r.run = x.p // 16)"""
            last = f"{name}_up{i}"
        return sql

    deep, wide = _ORACLE_LEVELS
    lowered = f"CASE WHEN {crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, '{_UPPER}', '{_LOWER}') ELSE text END"
    return f"""WITH leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS src, {leaf('text')} AS node, {leaf(f'({lowered})')} AS shown
  FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY doc_id NULLS FIRST, node) - 1 AS p FROM leaves),
{tree('a', 'placed', 'src', deep)},
tops AS (SELECT grp AS src, node, row_number() OVER (ORDER BY encode(grp)) - 1 AS p FROM a{deep}),
{tree('b', 'tops', "''", wide)},
start AS (SELECT doc_id, node AS leaf, src, p, '' AS proof, shown FROM placed){climb('a', 'src', deep, 'start')},
middle AS (SELECT x.doc_id, x.leaf, t.node AS subroot, '' AS top, t.p, x.proof, x.shown FROM a_up{deep - 1} x JOIN tops t USING (src)){climb('b', 'top', wide, 'middle')}
SELECT doc_id, leaf, subroot, b{wide}.node AS root, sha256(proof) AS proof_sha256, shown AS folded_root, shown = b{wide}.node AS verified
FROM b_up{wide - 1}, b{wide}"""


ORACLE = _oracle()
