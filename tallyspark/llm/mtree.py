"""Exact top-k inner products by best-first search in M-trees of paged nodes.

Vectors are lifted by one component to a common length, which turns the largest
inner product into the smallest distance.  Distinct vectors are dealt to trees
by their nearest of a few pivots; each tree is built where its vectors are and
written as pages: entries with their distance to the page's pivot and, in inner
pages, the covering radius and page of each child.  A query searches the tree of
its nearest pivot first; the score it then has to beat, with the trees' radii,
tells which other trees it must visit.  Stored distances and the triangle
inequality save most computations; what is left is exact integer arithmetic.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.llm.common import written

#: Vectors of a tree, trees at most (their pivots and radii are broadcast), entries of inner and of leaf pages.
TREE_ROWS, MAX_TREES, FANOUT, LEAF_ROWS = 20_000, 4_096, 32, 1_024
#: Distinct query vectors that a task takes on together.
QUERY_BLOCK = 4_096

PAGE_SCHEMA = ("tree int, page int, leaf boolean, pivot array<long>, radius double, parent_distances array<double>, "
               "radii array<double>, children array<int>, vectors array<array<long>>, ids array<array<long>>")


#: Squared lengths (of components rounded away from zero) stay below this, so that every inner product fits a long.
LONGEST = 2.0 ** 62


def whole_components(embedding: Column) -> Column:
    """floor(256 * x) of each component; null for vectors that are null, hold null or non-finite components, or are too long.

    Too long: the squared length reaches ``LONGEST``, so that a score need not fit a long.
    """
    doubles = F.transform(embedding, lambda x: x.cast("double"))
    sound = F.forall(doubles, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    length = F.aggregate(doubles, F.lit(0.0), lambda a, x: a + (F.abs(x) * 256 + 1) * (F.abs(x) * 256 + 1))
    return F.when(sound & (length < LONGEST), F.transform(doubles, lambda x: F.floor(x * 256).cast("long")))


def _matrix(lists: pa.Array, width: int) -> np.ndarray:
    """Rows of a list array, filled up with zeros to ``width``."""
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    values, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    out = np.zeros((len(lists), width), np.int64)
    ends = np.cumsum(sizes)
    out[np.repeat(np.arange(len(lists)), sizes), np.arange(len(values)) - np.repeat(ends - sizes, sizes)] = values
    return out


class Space:
    """Inner products, and distances between lifted vectors.  ``top``: the largest squared length."""

    def __init__(self, top: int, width: int):
        self.top, self.width = top, width
        #: Products of floats are exact below 2**53.
        self.kind = np.float64 if top < 2**52 else np.int64

    def lifted(self, vectors: np.ndarray) -> np.ndarray:
        squares = (vectors.astype(float) ** 2).sum(1)
        return np.hstack([vectors, np.sqrt(np.maximum(self.top - squares, 0))[:, None]])

    def between(self, vectors: np.ndarray, pivot: np.ndarray) -> np.ndarray:
        return np.sqrt(((self.lifted(vectors) - self.lifted(pivot[None])) ** 2).sum(1))

    def to_query(self, products: np.ndarray, square: float) -> np.ndarray:
        """Distances of a query (squared length ``square``) from inner products."""
        return np.sqrt(np.maximum(square + self.top - 2.0 * products, 0))

    def best_product(self, distance: np.ndarray | float, square: float) -> np.ndarray | float:
        """The largest inner product at no less than a distance, with some slack for rounding."""
        near = np.maximum(distance * (1 - 1e-9) - 1e-6, 0)
        return (square + self.top - near * near) / 2 + 1e-6 * (1 + abs(square) + self.top) ** 0.5


def build_pages(vectors: np.ndarray, ids: list, space: Space, tree: int) -> list[tuple]:
    """The pages of one M-tree, the root first (page 0)."""
    pages: list[tuple] = []
    draw = np.random.default_rng(tree)

    def add(at: np.ndarray, pivot: np.ndarray) -> tuple[int, float]:
        page = len(pages)
        pages.append(())
        distances = space.between(vectors[at], pivot)
        radius = float(distances.max())
        if len(at) <= LEAF_ROWS:
            pages[page] = (tree, page, True, pivot.tolist(), radius, distances.tolist(), None, None,
                           vectors[at].tolist(), [ids[i] for i in at.tolist()])
            return page, radius
        chosen = draw.choice(at, FANOUT, replace=False)
        to = np.array([space.between(vectors[at], vectors[c]) for c in chosen])
        nearest = to.argmin(0)
        if (nearest == nearest[0]).all():  # all alike: deal them out evenly
            nearest = np.arange(len(at)) % FANOUT
        parts = [(c, at[nearest == i]) for i, c in enumerate(chosen) if (nearest == i).any()]
        below = [add(part, vectors[c]) for c, part in parts]
        pivots = vectors[[c for c, _ in parts]]
        pages[page] = (tree, page, False, pivot.tolist(), radius, space.between(pivots, pivot).tolist(),
                       [r for _, r in below], [p for p, _ in below], pivots.tolist(), None)
        return page, radius

    add(np.arange(len(vectors)), vectors[0])
    return pages


class Tree:
    """Pages of a tree in memory, for searching."""

    def __init__(self, pages: pa.Table, space: Space):
        self.space, self.pages = space, {}
        for i in range(pages.num_rows):
            row = {c: pages.column(c)[i] for c in pages.column_names}
            leaf = row["leaf"].as_py()
            self.pages[row["page"].as_py()] = (
                leaf, _matrix(row["vectors"].values, space.width).astype(space.kind),
                np.array(row["parent_distances"].as_py()),
                row["ids"].as_py() if leaf else np.array(row["radii"].as_py()),
                None if leaf else row["children"].as_py())
            if row["page"].as_py() == 0:
                self.pivot = _matrix(pa.array([row["pivot"].as_py()], pa.list_(pa.int64())), space.width)[0].astype(space.kind)
                self.radius = row["radius"].as_py()

    def search(self, query: np.ndarray, k: int, least: float, own: int | None = None) -> list[tuple[int, int]]:
        """The best ``k`` (score, id), larger scores and then smaller ids first, of those that score ``least``.

        The id ``own`` is left out.
        """
        space = self.space
        query = query.astype(space.kind)
        square = float((query.astype(float) ** 2).sum())
        found: list[tuple[int, int]] = []  # a heap, the worst on top: (score, -id)
        root = float(space.to_query(np.array(query @ self.pivot), square))
        agenda = [(max(root - self.radius, 0.0), 0, root)]
        while agenda:
            near, page, to_pivot = heapq.heappop(agenda)
            if space.best_product(near, square) < least:
                break
            leaf, vectors, parent, extra, children = self.pages[page]
            bound = np.abs(to_pivot - parent)
            if not leaf:
                bound = np.maximum(bound - extra, 0)
            at = np.flatnonzero(space.best_product(bound, square) >= least)
            if not len(at):
                continue
            if 2 * len(at) > len(vectors):  # taking most rows costs more than their products
                at, products = np.arange(len(vectors)), vectors @ query
            else:
                products = vectors[at] @ query
            if leaf:
                good = np.flatnonzero(products >= least)
                good = good[np.argsort(-products[good], kind="stable")]
                for i, score in zip(at[good].tolist(), products[good].tolist()):
                    if score < least:
                        break
                    for id_ in extra[i]:
                        if id_ == own:
                            continue
                        entry = (int(score), -id_)
                        if len(found) < k:
                            heapq.heappush(found, entry)
                        elif entry > found[0]:
                            heapq.heapreplace(found, entry)
                    if len(found) == k:
                        least = max(least, found[0][0])
            else:
                distances = space.to_query(products, square)
                nears = np.maximum(distances - extra[at], 0)
                for i, n, d in zip(at.tolist(), nears.tolist(), distances.tolist()):
                    heapq.heappush(agenda, (n, children[i], d))
        return sorted(((s, -i) for s, i in found), key=lambda x: (-x[0], x[1]))


def _deal(distinct: DataFrame, pivots: np.ndarray, space: Space) -> DataFrame:
    """``distinct`` with the number of the nearest pivot."""
    lifted = space.lifted(pivots)
    squares = (lifted ** 2).sum(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for start in range(0, b.num_rows, 1024):
                part = b.slice(start, 1024)
                near = (squares - 2 * (space.lifted(_matrix(part.column(0), space.width)) @ lifted.T)).argmin(1)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(near.astype(np.int32))], [*part.schema.names, "pivot"])

    return distinct.mapInArrow(run, f"v array<long>, {'ids array<long>, ' if 'ids' in distinct.columns else ''}pivot int")


def top_k(vectors: DataFrame, queries: Column, k: int = 5, key: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score`` of the ``k`` best of all other rows for each row where ``queries`` holds.

    Score: inner product of ``whole_components``; of equal scores the smaller id
    is better; fewer rows than ``k``: all.  Vectors that are null, hold null or
    non-finite components or are too long for a long score (``LONGEST``) take no
    part; shorter vectors are filled up with zeros; rows with a null id take no
    part.  Rows equal in id and vector are one row; rows that share an id with
    other vectors count as one row each, but none is a result of a query with
    its id.  An empty table gives an empty result.
    """
    spark = vectors.sparkSession
    rows = written(vectors.select(F.col(f"`{key}`").cast("long").alias("id"), whole_components(F.col(f"`{embedding}`")).alias("v"),
                                  F.coalesce(queries, F.lit(False)).alias("q")).where("id is not null and v is not null"), "mtree")
    # Of equal vectors the k + 1 smallest ids are enough: a query leaves out only its own.
    first = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    distinct = written(rows.select("id", "v").distinct().withColumn("n", first).where(F.col("n") <= k + 1)
                       .groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids")), "mtree")
    shape = distinct.agg(
        F.count("*").alias("n"), F.max(F.size("v")).alias("width"),
        F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x * x)).alias("top")).first()
    schema = "query_id long, rank int, vec_id long, score long"
    if not shape["n"]:
        return spark.createDataFrame([], schema)
    space = Space(int(shape["top"]), int(shape["width"]))
    n_trees = min(MAX_TREES, -(-shape["n"] // TREE_ROWS))
    size = -(-shape["n"] // n_trees)
    chosen = distinct.orderBy(F.xxhash64("v"), "v").limit(n_trees).select("v").toArrow()
    dealt = written(_deal(distinct, _matrix(chosen.column(0), space.width), space), "mtree")
    sizes = {r["pivot"]: r["n"] for r in dealt.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    # A crowded pivot has several trees, so that none is much larger than the others.
    parts = {p: -(-n // size) for p, n in sizes.items()}
    starts = dict(zip(parts, np.cumsum([0, *parts.values()]).tolist()))
    lookup = F.create_map(*[F.lit(x) for p in parts for x in (p, F.struct(F.lit(starts[p]).alias("s"), F.lit(parts[p]).alias("n")))])
    place = lookup[F.col("pivot")]
    tree = (place["s"] + F.pmod(F.xxhash64("v"), place["n"]).cast("int")).alias("tree")

    def build(group: pa.Table) -> pa.Table:
        order = group.sort_by([("h", "ascending")])
        pages = build_pages(_matrix(order.column("v"), space.width), order.column("ids").to_pylist(), space,
                            order.column("tree")[0].as_py())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*pages), _page_types())], _page_names())

    pages = written(dealt.select(tree, "v", "ids", F.xxhash64("v").alias("h")).groupBy("tree").applyInArrow(build, PAGE_SCHEMA),
                    "mtree")
    roots = pages.where("page = 0").select("tree", "pivot", "radius").toArrow()
    root_trees, root_radii = roots.column("tree").to_numpy(), roots.column("radius").to_numpy()
    root_pivots = _matrix(roots.column("pivot"), space.width).astype(space.kind)

    # A query leaves out its own id, which is among k + 1 results once; an id with several vectors is left out in the search.
    several = rows.select("id", "v").distinct().groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id", F.col("id").alias("own"))
    queries_ = written(rows.where("q").select("id", "v").distinct().join(several, "id", "left"), "mtree")
    asked = queries_.select("v", "own").distinct()
    asked = asked.withColumn("block", F.pmod(F.xxhash64("v", F.lit(8)), F.lit(max(1, -(-asked.count() // QUERY_BLOCK)))).cast("int"))
    asked = written(asked, "mtree")
    n_blocks = asked.agg(F.max("block").alias("m")).first()["m"]
    if n_blocks is None:
        return spark.createDataFrame([], schema)

    def route(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Queries to the trees to visit: without ``least`` the nearest, with it all others that may beat it."""
        for b in batches:
            q = _matrix(b.column(0), space.width).astype(space.kind)
            squares = (q.astype(float) ** 2).sum(1)
            distances = space.to_query(q @ root_pivots.T, squares[:, None])
            least = b.column(2).to_numpy(zero_copy_only=False)
            home = distances.argmin(1)
            best = space.best_product(np.maximum(distances - root_radii, 0), squares[:, None])
            others = best >= least[:, None]
            others[np.arange(len(q)), home] = False
            first = np.zeros_like(others)
            first[np.arange(len(q)), home] = True
            at, to = np.nonzero(np.where(np.isnan(least)[:, None], first, others))
            yield pa.RecordBatch.from_arrays([*b.take(pa.array(at)).columns, pa.array(root_trees[to].astype(np.int32))],
                                             ["v", "block", "least", "own", "tree"])

    def search(asked_: pa.Table, pages_: pa.Table) -> pa.Table:
        searched = Tree(pages_, space)
        q = _matrix(asked_.column("v"), space.width)
        least = np.nan_to_num(asked_.column("least").to_numpy(), nan=-np.inf)
        own = asked_.column("own").to_pylist()
        hits = [searched.search(x, k + 1, y, o) for x, y, o in zip(q, least, own)]
        kind = pa.list_(pa.struct([("score", pa.int64()), ("id", pa.int64())]))
        return pa.Table.from_arrays([
            asked_.column("v").combine_chunks(), asked_.column("block").combine_chunks(),
            pa.array([float(h[k][0]) if len(h) > k else -np.inf for h in hits]), pa.array(own, pa.int64()),
            pa.array([[{"score": s, "id": i} for s, i in h] for h in hits], kind)], ["v", "block", "least", "own", "hits"])

    def visit(frame: DataFrame) -> DataFrame:
        routed = written(frame.mapInArrow(route, "v array<long>, block int, least double, own long, tree int"), "mtree")
        # Pages go to the blocks that have queries for their tree, and to no others.
        asked_for = routed.groupBy(F.col("tree").alias("of"), F.col("block").alias("to")).agg(F.count("*"))
        copies = pages.join(asked_for, F.col("tree") == F.col("of")).select(*pages.columns, F.col("to").alias("block"))
        return (routed.groupBy("tree", "block").cogroup(copies.groupBy("tree", "block"))
                .applyInArrow(search, "v array<long>, block int, least double, own long, "
                                      "hits array<struct<score: long, id: long>>"))

    home = written(visit(asked.select("v", "block", F.lit(float("nan")).alias("least"), "own")), "mtree")
    both = home.select("v", "own", "hits").unionByName(visit(home.select("v", "block", "least", "own")).select("v", "own", "hits"))
    best = F.row_number().over(Window.partitionBy("v", "own").orderBy(F.desc("score"), "id"))
    hits = (both.select("v", "own", F.inline("hits")).withColumn("n", best).where(F.col("n") <= k + 1)
            .groupBy("v", "own").agg(F.collect_list(F.struct((-F.col("score")).alias("minus"), "id")).alias("hits")))
    hits = hits.withColumnsRenamed({"v": "__v", "own": "__own"})
    answers = queries_.join(hits, (F.col("v") == F.col("__v")) & F.col("own").eqNullSafe(F.col("__own"))).select(
        F.col("id").alias("query_id"),
        F.slice(F.filter(F.sort_array("hits"), lambda h: h["id"] != F.col("id")), 1, k).alias("hits"))
    return (answers.select("query_id", F.posexplode("hits").alias("at", "hit"))
            .select("query_id", (F.col("at") + 1).alias("rank"), F.col("hit")["id"].alias("vec_id"),
                    (-F.col("hit")["minus"]).alias("score")))


def _page_names() -> list[str]:
    return [c.split()[0] for c in PAGE_SCHEMA.split(", ")]


def _page_types() -> list[pa.DataType]:
    kinds = {"int": pa.int32(), "boolean": pa.bool_(), "double": pa.float64(), "array<long>": pa.list_(pa.int64()),
             "array<double>": pa.list_(pa.float64()), "array<int>": pa.list_(pa.int32()),
             "array<array<long>>": pa.list_(pa.list_(pa.int64()))}
    return [kinds[c.split()[1]] for c in PAGE_SCHEMA.split(", ")]


ORACLE = """
WITH raw AS (SELECT vec_id, CAST(unnest(embedding) AS DOUBLE) AS x, generate_subscripts(embedding, 1) AS i
  FROM embeddings WHERE vec_id IS NOT NULL),
unsound AS (SELECT DISTINCT vec_id FROM raw WHERE x IS NULL OR NOT isfinite(x)),
parts AS (SELECT vec_id, i, CAST(floor(256 * x) AS BIGINT) AS x FROM raw WHERE vec_id NOT IN (FROM unsound)),
scores AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM parts q JOIN parts c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS r FROM scores)
SELECT query_id, CAST(r AS INTEGER) AS rank, vec_id, score FROM ranked WHERE r <= 5
"""
