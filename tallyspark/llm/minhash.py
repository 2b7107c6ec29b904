"""Near-duplicate documents by bottom-k sketches from one hash function.

1. Documents with equal shingle sets form classes; the smallest id stands for a class.
2. A sketch holds the k smallest hashes of a set.  Two sets with the wanted
   similarity share, but for a chance under 1e-8, at least ``least_shared`` values of
   their sketches, so they share one of the rarest ``k - least_shared + 1`` of
   each: only those enter the inverted lists.
3. In every list all members are paired with its most central member, so that
   the pairs grow with the entries.  Linked members become one component.
4. Lists that still join several components are settled exactly: over the whole
   sets of their members, lists of the rarest shingles (as many as a similar
   pair can't both lack, given both sizes) pair members of different components.
5. Each pair is estimated on the sketch of its union, with slack, and what
   remains is compared on whole sets.  The last pass over open lists does not
   estimate: it leaves out only pairs whose sketches prove that too many values
   are not shared.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.llm.common import map_texts, written
from tallyspark.llm.components import components
from tallyspark.llm.shingles import bottom, shingle_sets

#: Values of a sketch, and how many of them a pair at similarity 0.75 shares at least (chance of fewer: 6e-9).
SKETCH, LEAST_SHARED = 64, 28
PERCENT = 75
#: Ids that may be broadcast to pick documents (8 bytes each).
BROADCAST_IDS = 1_000_000


def sketches(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, digest, sketch`` of each row; the digest (16 bytes) tells equal sets."""
    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("digest", T.BinaryType()),
              T.StructField("sketch", T.ArrayType(T.LongType()))]

    def apply(texts: pa.Array) -> list[pa.Array]:
        values, bounds = shingle_sets(texts)
        digests = [xxhash.xxh3_128_digest(values[bounds[i]:bounds[i + 1]].tobytes()) for i in range(len(texts))]
        # Halved hashes are the same order signed, as Spark sorts, and unsigned, as they were sorted here.
        return [pa.array(np.diff(bounds).astype(np.int64)), pa.array(digests, pa.binary()),
                bottom(values >> np.uint64(1), bounds, SKETCH)]

    return map_texts(docs, text, lambda: apply, fields, [key])


def shingles(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, shingles``: the whole set of each row."""
    def apply(texts: pa.Array) -> list[pa.Array]:
        values, bounds = shingle_sets(texts)
        return [pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(values.view(np.int64)))]

    return map_texts(docs, text, lambda: apply, [T.StructField("shingles", T.ArrayType(T.LongType()))], [key])


def _alike_sizes(a: Column, b: Column) -> Column:
    return (100 * F.least(a, b) >= PERCENT * F.greatest(a, b))


def _needed(a: Column, b: Column) -> Column:
    """Smallest intersection of sets of these sizes that reaches the similarity."""
    return F.ceil((a + b) * PERCENT / float(100 + PERCENT) - 1e-9)


def small_ids(ids: DataFrame) -> DataFrame:
    """A frame of ids, broadcast if their checked number is within the bound."""
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def _ids_of(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``docs`` whose key is in ``ids``."""
    return docs.join(small_ids(ids.select(F.col("id").alias(key)).distinct()), key, "left_semi")


def _likely(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) whose union sketch shares enough values."""
    a = classes.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("nx"))
    b = classes.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("ny"))
    union = F.slice(F.array_sort(F.array_union("x", "y")), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect("x", "y"), union))
    # Small unions are whole in their sketch; the others may deviate as far as the lists allow for.
    enough = F.when((F.size("x") < SKETCH) & (F.size("y") < SKETCH) & (F.size(F.array_union("x", "y")) <= SKETCH),
                    100 * shared >= PERCENT * F.size(union)).otherwise(shared >= LEAST_SHARED)
    return (pairs.join(a, "a").join(b, "b").where(_alike_sizes(F.col("nx"), F.col("ny")) & enough).select("a", "b").distinct())


def _possible(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs (a, b) but for those that surely miss the similarity.

    Up to the smaller of the largest values of both sketches each holds all
    of its set, so what only one of them has there is not in the intersection.
    """
    a = classes.select(F.col("id").alias("a"), F.col("sketch").alias("x"), F.col("n").alias("nx"))
    b = classes.select(F.col("id").alias("b"), F.col("sketch").alias("y"), F.col("n").alias("ny"))
    whole = F.lit((1 << 63) - 1).cast("long")  # a sketch that is its set holds all values
    ends = [F.when(F.col(n) <= SKETCH, whole).otherwise(F.array_max(s)) for s, n in (("x", "nx"), ("y", "ny"))]
    both = pairs.join(a, "a").join(b, "b").withColumn("end", F.least(*ends))

    def most(mine, other, n):
        return F.col(n) - F.size(F.filter(F.array_except(mine, other), lambda v: v <= F.col("end")))

    return (both.where(F.least(most("x", "y", "nx"), most("y", "x", "ny")) >= _needed(F.col("nx"), F.col("ny")))
            .select("a", "b").distinct())


def _confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that reach the similarity on their whole sets."""
    both = (pairs.join(sets.select(F.col("id").alias("a"), F.col("shingles").alias("x")), "a")
            .join(sets.select(F.col("id").alias("b"), F.col("shingles").alias("y")), "b")
            .withColumn("shared", F.size(F.array_intersect("x", "y"))))
    union = F.size("x") + F.size("y") - F.col("shared")
    return both.where(100 * F.col("shared") >= PERCENT * union).select("a", "b").distinct()


def _rarest_first(entries: DataFrame, counts: DataFrame, length: Column) -> DataFrame:
    """For every member the entries among its ``length`` rarest values that others have too.

    ``entries``: ``id, n, size`` (how many values the member has) and ``value``.
    Gives ``id, n, value, place`` (from 0) and ``central``, the sum of its counts.
    """
    shared = entries.join(counts, "value").groupBy("id", "n", "size").agg(
        F.sort_array(F.collect_list(F.struct("many", "value"))).alias("by"), F.sum("many").alias("central"))
    single = F.col("size") - F.size("by")  # values that no other member has come first
    kept = F.slice("by", 1, F.greatest(length - single, F.lit(0)).cast("int"))
    return (shared.select("id", "n", "central", single.alias("single"), F.posexplode(kept).alias("at", "e"))
            .select("id", "n", "central", F.col("e")["value"].alias("value"), (F.col("single") + F.col("at")).alias("place")))


def _counts(entries: DataFrame) -> DataFrame:
    return entries.groupBy("value").agg(F.count("*").alias("many")).where("many > 1")


def _roots(entries: DataFrame, links: DataFrame) -> DataFrame:
    """``entries`` with the ``root`` of each member."""
    return entries.join(components(links), "id", "left").withColumn("root", F.coalesce("root", "id"))


def link(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """``key, n_shingles, component_id`` of each row of ``docs``.

    Documents are linked where 100 * intersection >= 75 * union of their sets of
    five-word shingles (``shingle_sets``).  ``component_id`` is the smallest key
    reachable over links, itself included.  Documents without words (or a null
    text) have an empty set and are linked with nothing.  Rows that share a key
    are one document, and equal texts always share a component.  Rows with a null key are linked
    with nothing and have a null component.  Extra columns are ignored; an
    empty table gives an empty result.
    """
    source = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").cast("string").alias("t"))
    signed = written(sketches(source, "t", "id"), "sketches")
    # 1. Classes of equal sets, each with the smallest id.
    members = signed.where("n_shingles > 0 and id is not null")
    classes = written(members.groupBy("digest", "n_shingles").agg(F.min(F.struct("id", "sketch")).alias("m"))
                      .select("digest", F.col("n_shingles").alias("n"), "m.id", "m.sketch"), "classes")
    # 2. Inverted lists of each class's rarest retained values.
    entries = classes.select("id", "n", F.size("sketch").alias("size"), F.explode("sketch").alias("value"))
    needed = F.when(F.col("n") <= PERCENT * SKETCH // 100, F.ceil(F.col("n") * PERCENT / 100.0)).otherwise(LEAST_SHARED)
    lists = written(_rarest_first(entries, _counts(entries), F.col("size") - needed + 1), "lists")
    # 3. Every member with the most central one of its list.
    centres = lists.groupBy("value").agg(F.max(F.struct("central", "id", "n")).alias("c"))
    stars = (lists.join(centres, "value").where((F.col("id") != F.col("c.id")) & _alike_sizes(F.col("n"), F.col("c.n")))
             .select(F.greatest("id", "c.id").alias("a"), F.least("id", "c.id").alias("b")).distinct())
    stars = written(_likely(stars, classes), "pairs")
    ids = stars.select(F.col("a").alias("id")).unionByName(stars.select(F.col("b").alias("id")))
    sets = written(shingles(_ids_of(source, ids, "id"), "t", "id").distinct(), "sets")
    links = written(_confirmed(stars, sets), "links")
    # 4. Members of lists that may join further components.
    rooted = written(_roots(lists.select("id", "n", "value"), links), "rooted")
    open_lists = (rooted.groupBy("value").agg(F.min("root").alias("low"), F.max("root").alias("high"))
                  .where("low <> high").select("value"))
    open_ids = rooted.join(open_lists, "value", "left_semi").select("id").distinct()
    more = _settle(source, classes, written(open_ids, "open"), links)
    # 5. Components of classes, then of all rows.
    found = components(links.unionByName(more).unionByName(
        members.join(classes.select("digest", F.col("n").alias("n_shingles"), F.col("id").alias("b")), ["digest", "n_shingles"])
        .select(F.col("id").alias("a"), "b").where("a <> b")))
    return (signed.select("id", "n_shingles").join(found, "id", "left")
            .select(F.col("id").alias(key), "n_shingles", F.coalesce("root", "id").alias("component_id")))


def _settle(source: DataFrame, classes: DataFrame, open_ids: DataFrame, links: DataFrame) -> DataFrame:
    """Links between members of different components, from lists over whole sets."""
    sets = written(shingles(_ids_of(source, open_ids, "id"), "t", "id").distinct(), "sets")
    entries = sets.select("id", F.size("shingles").cast("long").alias("n"), F.size("shingles").alias("size"),
                          F.explode("shingles").alias("value"))
    longest = F.col("size") - F.ceil(F.col("size") * PERCENT / 100.0) + 1
    lists = written(_rarest_first(entries, _counts(entries), longest), "lists")
    found = links.limit(0)
    for every in (False, True):
        mixed = written(_mixed(_roots(lists, links.unionByName(found))), "mixed")
        x, y = (mixed.select(*[F.col(c).alias(f"{side}_{c}") for c in ("id", "n", "place", "root")], "value", "central", "largest")
                for side in "xy")
        if every:  # the members outside a list's largest component meet all of other components
            x = x.where("x_root <> largest")
        else:  # the most central member of each list meets all of other components
            x = x.groupBy("value").agg(F.max(F.struct("central", "x_id", "x_n", "x_place", "x_root")).alias("x")).select("value", "x.*")
        needed = _needed(F.col("x_n"), F.col("y_n"))
        pairs = x.join(y.drop("central"), "value").where(
            (F.col("x_root") != F.col("y_root")) & _alike_sizes(F.col("x_n"), F.col("y_n"))
            & (F.col("x_place") <= F.col("x_n") - needed) & (F.col("y_place") <= F.col("y_n") - needed))
        pairs = pairs.select(F.greatest("x_id", "y_id").alias("a"), F.least("x_id", "y_id").alias("b")).distinct()
        pairs = _possible(pairs, classes) if every else _likely(pairs, classes)
        found = written(found.unionByName(_confirmed(written(pairs, "pairs"), sets)), "links")
    return found


def _mixed(lists: DataFrame) -> DataFrame:
    """The lists that hold several components, with the root of the ``largest`` of each."""
    sizes = lists.groupBy("value", "root").agg(F.count("*").alias("many"))
    largest = sizes.groupBy("value").agg(F.max(F.struct("many", "root")).alias("l"), F.count("*").alias("roots"))
    return lists.join(largest.where("roots > 1").select("value", F.col("l.root").alias("largest")), "value")


def with_kept(linked: DataFrame, key: str = "doc_id") -> DataFrame:
    """``linked`` with ``kept``: one document of each component (rows with a null key are kept)."""
    return linked.withColumn("kept", F.coalesce(F.col(key) == F.col("component_id"), F.lit(True)))


ORACLE = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS i FROM words)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY ALL HAVING 100 * count(*) >= 75 * (max(x.n) + max(y.n) - count(*))),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (
  SELECT doc_id AS id, doc_id AS root FROM documents
  UNION SELECT e.a, r.root FROM reach r JOIN edges e ON e.b = r.id)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d LEFT JOIN sizes USING (doc_id)
JOIN (SELECT id AS doc_id, min(root) AS component_id FROM reach GROUP BY id) USING (doc_id)
"""
