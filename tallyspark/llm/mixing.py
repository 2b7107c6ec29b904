"""Mixing sources to target weights by hierarchical budgeting.

A token budget goes down a tree (by default domain, language, source).  Every
node shares its budget among its children by weight; what a child can't use,
because its documents are exhausted after ``max_epochs`` epochs, goes to its
siblings.  As a node never gets more than its subtree can use, a shortage
reaches the ancestors' other branches only when all siblings are full.  A leaf
turns its budget into whole epochs and, of one more epoch in a seeded order, the
shortest prefix of documents that reaches the rest.

Only DataFrame operations; the tree is as large as the number of sources, and
no order or running sum spans more than a small part of a leaf's documents.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import written

LEVELS = ("domain", "lang", "source")
#: Leaves of a plan that may be broadcast (about 100 bytes each).
BROADCAST_LEAVES = 100_000
#: Hex digits of the order that are summed up step by step: 4096 parts at a time, then single keys.
STEPS = (3, 6, 32)


def count_words(text: Column) -> Column:
    r"""Tokens of a text for budgeting: words ``[^\x20\x09-\x0D]+`` (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def node_weight(level: int, levels: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Weight of a node of ``level``: that of its path, where ``*`` stands for any name; 1 if none is given.

    Of several entries that fit, the last given counts.
    """
    out = F.lit(1)
    for path, weight in weights.items():
        if len(path) == level + 1:
            fits = F.lit(True)
            for name, value in zip(levels, path):
                fits = fits & (F.lit(True) if value == "*" else F.col(name) == value)
            out = F.when(fits, F.lit(int(weight))).otherwise(out)
    return out.cast("long")


def _share(children: DataFrame, above: Sequence[str], name: str) -> DataFrame:
    """``children`` (``budget`` of the parent, own ``capacity`` and ``weight``) with their share as ``budget``.

    In order of capacity by weight, a child is full if the level of shares that
    fills it needs no more than the parent's budget; the others share the rest
    by weight, rounded so that nothing is lost.  Integer arithmetic throughout.
    """
    order = [F.col("capacity") / F.col("weight"), F.col(name)]
    before = Window.partitionBy(*above).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    onward = Window.partitionBy(*above).orderBy(*order).rowsBetween(0, Window.unboundedFollowing)
    to_here = Window.partitionBy(*above).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*above)
    big = "cast({} as decimal(19,0))"
    full = F.expr(f"{big.format('filled')} * {big.format('weight')} + {big.format('capacity')} * {big.format('heavier')}"
                  f" <= {big.format('budget')} * {big.format('weight')}")
    part = f"({big.format('rest')} * {big.format('{}')}) div {big.format('open_weight')}"
    return (children.where("weight > 0")
            .withColumn("filled", F.coalesce(F.sum("capacity").over(before), F.lit(0)))
            .withColumn("heavier", F.sum("weight").over(onward))
            .withColumn("full", full)
            .withColumn("rest", F.col("budget") - F.sum(F.when(F.col("full"), F.col("capacity")).otherwise(0)).over(whole))
            .withColumn("open_weight", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(whole))
            .withColumn("open_here", F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(to_here))
            .withColumn("budget", F.when(F.col("full"), F.col("capacity")).otherwise(
                F.expr(part.format("open_here")) - F.expr(part.format("(open_here - weight)")))))


def leaf_budgets(leaves: DataFrame, budget: Column, weights: Mapping[tuple[str, ...], int], max_epochs: int,
                 levels: Sequence[str] = LEVELS) -> DataFrame:
    """``leaves`` (levels and ``tokens``) with their ``budget``; leaves in a subtree of weight 0 are left out.

    These have no capacity at any level, so nothing is shared out for them.
    """
    live = F.lit(True)
    for level in range(len(levels)):
        live = live & (node_weight(level, levels, weights) > 0)
    capacities = leaves.withColumn("capacity", F.when(live, F.col("tokens") * max_epochs).otherwise(0).cast("long"))
    total = capacities.agg(F.sum("capacity").alias("capacity"), F.sum("tokens").alias("tokens"))
    parents = total.select(F.least(budget, F.col("capacity")).cast("long").alias("budget"), F.lit(0).alias("__root"))
    above: list[str] = ["__root"]
    for level, name in enumerate(levels):
        here = [*levels[:level], name]
        nodes = (capacities.groupBy(*here).agg(F.sum("capacity").alias("capacity"))
                 .withColumn("weight", node_weight(level, levels, weights)))
        if not level:
            nodes = nodes.withColumn("__root", F.lit(0))
        parents = _share(nodes.join(parents, above), above, name).select(*here, "budget")
        above = here
    return leaves.join(parents, list(levels))


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in an epoch's seeded order (documents with the same key stay together)."""
    return F.md5(F.concat(F.lit(f"{seed}|"), epoch.cast("string"), F.lit("|"), F.coalesce(key.cast("string"), F.lit(""))))


def make_plan(docs: DataFrame, budget: Column, weights: Mapping[tuple[str, ...], int], max_epochs: int, seed: int,
              key: str = "doc_id", tokens: str = "n_tokens", levels: Sequence[str] = LEVELS) -> DataFrame:
    """One row per leaf: levels, ``tokens``, ``budget``, ``epochs`` (whole) and ``last`` (end of the prefix, or null).

    ``docs`` has the key, the levels (strings, not null) and a token count.
    ``budget`` may refer to ``tokens``, the sum over all documents.
    """
    leaves = docs.groupBy(*levels).agg(F.sum(tokens).alias("tokens"))
    epochs = F.expr("case when tokens > 0 then budget div tokens else 0 end")
    plan = (leaf_budgets(leaves, budget, weights, max_epochs, levels).withColumn("epochs", epochs)
            .withColumn("rest", F.col("budget") - F.col("epochs") * F.col("tokens")))
    plan = written(plan, "mix-plan")
    slim = docs.select(*levels, F.col(key).alias("__key"), F.col(tokens).alias("__n"))
    # Find, per leaf, the key at which the running sum of tokens reaches the rest: part by part.
    at = plan.where("rest > 0").select(*levels, "epochs", "rest", F.lit("").alias("last"))
    for digits in STEPS:
        placed = slim.join(_small(at), list(levels)).withColumn("__at", order_key(seed, F.col("epochs"), F.col("__key")))
        parts = (placed.where(F.col("__at").startswith(F.col("last")))
                 .groupBy(*levels, "epochs", "rest", F.substring("__at", 1, digits).alias("__part"))
                 .agg(F.sum("__n").alias("__n")))
        before = F.coalesce(F.sum("__n").over(
            Window.partitionBy(*levels).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        at = (parts.withColumn("before", before)
              .where((F.col("before") < F.col("rest")) & (F.col("before") + F.col("__n") >= F.col("rest")))
              .select(*levels, "epochs", (F.col("rest") - F.col("before")).alias("rest"), F.col("__part").alias("last")))
        at = written(at, "mix-at")
    return plan.drop("rest").join(at.select(*levels, "last"), list(levels), "left")


def _small(leaves: DataFrame) -> DataFrame:
    """A frame of leaves, broadcast if its size is within the bound."""
    return F.broadcast(leaves) if leaves.count() <= BROADCAST_LEAVES else leaves


def apply_plan(docs: DataFrame, plan: DataFrame, seed: int, key: str = "doc_id",
               levels: Sequence[str] = LEVELS) -> DataFrame:
    """``docs`` that the plan takes, with ``copies``: in how many epochs each occurs.

    ``docs`` has the columns ``levels``; documents of leaves that are not in the
    plan are left out.  Documents are taken whole, so a leaf exceeds its budget
    by less than its last document (all documents with the same key are one).
    A column ``copies`` of ``docs`` gives way; all others stay as they are.
    """
    leaf = plan.select(*[F.col(x).alias(f"__{x}") for x in (*levels, "epochs", "last")])
    same = [F.col(x) == F.col(f"__{x}") for x in levels]
    within = order_key(seed, F.col("__epochs"), F.col(key)) <= F.col("__last")
    copies = F.col("__epochs") + F.when(F.coalesce(within, F.lit(False)), 1).otherwise(0)
    joined = docs.join(_small(leaf), same).withColumn("copies", copies.cast("long"))
    return joined.where("copies > 0").drop(*[f"__{x}" for x in (*levels, "epochs", "last")])


#: Parameters of the registered query and of the pipeline's stage.
WEIGHTS = {("domain0",): 3, ("domain1",): 2, ("domain2",): 2,
           ("*", "en"): 5, ("*", "de"): 2, ("*", "fr"): 2, ("*", "es"): 2}
BUDGET_PART, MAX_EPOCHS, SEED = 0.8, 2, 20


def with_levels(docs: DataFrame) -> DataFrame:
    """``docs`` with the tree's levels as strings: the domain is the source's number modulo 3 (null: empty names)."""
    number = F.regexp_extract(F.coalesce("source", F.lit("")), "[0-9]{1,9}", 0)
    domain = F.when(number != "", F.concat(F.lit("domain"), number.try_cast("int") % 3))
    return docs.withColumns({"domain": F.coalesce(domain, F.lit("")),
                             "lang": F.coalesce(F.col("lang").cast("string"), F.lit("")),
                             "source": F.coalesce(F.col("source").cast("string"), F.lit(""))})


def budget() -> Column:
    """The part of all tokens that the registered mix takes."""
    return F.floor(F.col("tokens") * F.lit(BUDGET_PART)).cast("long")


def _oracle() -> str:
    def weight(level: int) -> str:
        cases = " ".join(f"WHEN {' AND '.join(f'{n} = {chr(39)}{v}{chr(39)}' for n, v in zip(LEVELS, p) if v != '*')} THEN {w}"
                         for p, w in WEIGHTS.items() if len(p) == level + 1)
        return f"CASE {cases} ELSE 1 END" if cases else "1"

    sql = rf"""WITH docs AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS n_tokens,
    coalesce(CASE WHEN regexp_extract(source, '[0-9]{{1,9}}') <> '' THEN
      'domain' || (CAST(regexp_extract(source, '[0-9]{{1,9}}') AS INT) % 3) END, '') AS domain,
    coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
leaves AS (SELECT domain, lang, source, CAST(sum(n_tokens) AS HUGEINT) AS tokens FROM docs GROUP BY ALL),
b0 AS (SELECT 0 AS root, least(CAST(floor(sum(tokens) * CAST({BUDGET_PART} AS DOUBLE)) AS HUGEINT), sum(tokens) * {MAX_EPOCHS}) AS budget FROM leaves)"""
    for level, name in enumerate(LEVELS):
        here, above = LEVELS[:level + 1], LEVELS[:level]
        part, cols = (", ".join(above) or "root"), ", ".join(here)
        on = " AND ".join(f"n.{x} = p.{x}" for x in above) or "true"
        sql += f""",
n{level} AS (SELECT n.*, p.budget, {'p.root' if not above else '0 AS root_'} FROM (
  SELECT {cols}, sum(tokens) * {MAX_EPOCHS} AS capacity, CAST({weight(level)} AS HUGEINT) AS weight FROM leaves GROUP BY {cols}) n
  JOIN b{level} p ON {on}),
f{level} AS (SELECT *, coalesce(sum(capacity) OVER (PARTITION BY {part} ORDER BY capacity / CAST(weight AS DOUBLE), {name}
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * weight
  + capacity * sum(weight) OVER (PARTITION BY {part} ORDER BY capacity / CAST(weight AS DOUBLE), {name}
    ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) <= budget * weight AS is_full FROM n{level}),
o{level} AS (SELECT *, budget - sum(CASE WHEN is_full THEN capacity ELSE 0 END) OVER (PARTITION BY {part}) AS rest,
  sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {part}) AS open_weight,
  sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER (PARTITION BY {part} ORDER BY capacity / CAST(weight AS DOUBLE), {name}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS open_here FROM f{level}),
b{level + 1} AS (SELECT {cols}, CASE WHEN is_full THEN capacity
  ELSE (rest * open_here) // open_weight - (rest * (open_here - weight)) // open_weight END AS budget FROM o{level})"""
    return sql + f""",
plan AS (SELECT *, CASE WHEN tokens > 0 THEN budget // tokens ELSE 0 END AS epochs FROM b{len(LEVELS)} JOIN leaves USING (domain, lang, source)),
placed AS (SELECT docs.*, epochs, budget - epochs * tokens AS rest,
  md5('{SEED}|' || CAST(epochs AS BIGINT) || '|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS place
  FROM docs JOIN plan USING (domain, lang, source)),
summed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY place
  RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) - sum(n_tokens) OVER (PARTITION BY domain, lang, source, place) AS before
  FROM placed)
SELECT doc_id, domain, lang, source, CAST(n_tokens AS BIGINT) AS n_tokens,
  CAST(epochs + CASE WHEN before < rest THEN 1 ELSE 0 END AS BIGINT) AS copies
FROM summed WHERE epochs + CASE WHEN before < rest THEN 1 ELSE 0 END > 0"""


ORACLE = _oracle()
