"""Exact top-k by inner product with M-trees and best-first search.

Metric. With M the greatest norm of all vectors, x becomes (x, sqrt(M^2 - |x|^2)) and a query q becomes
(q, 0); then |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so the nearest vectors have the greatest inner
products, and the distance is a metric that bounds can be drawn from.

Index. All vectors are dealt to ``shards`` by the nearest of a bounded sample of pivots (at most
``most_pivots``, chosen by a hash); every row is indexed. A shard's M-tree is bulk-loaded into pages of at most
``page`` entries. A node stores its routing vector, its covering radius and its distance from its
parent's routing vector; a leaf entry stores its distance from the leaf's routing vector. Trees are
stored as rows, one for each shard, of nodes as flat arrays.

Search. Nodes wait in a queue ordered by the least distance that their radius allows. Before a child's or an
entry's distance is computed, the stored distance from its parent rules it out where
|d(q, parent) - d(child, parent)| - radius is already beyond the k-th best. Queries first search
their own pivot's shards; the k-th best distance found there then rules out every pivot whose ball lies
beyond it, and only the remaining pairs are searched. Bounds carry a margin for rounding, and the
entries that remain are compared by their exact integer products, ties to the smaller id.

Copies. Of equal vectors only the k + 1 smallest ids can be among a query's k best (one may be the
query itself), so an equal group enters the index with those; this loses no result. A shard larger
than ``shard_rows`` is split by a hash of the id, so that no task holds more.

Edge cases: vectors that are null or hold null or non-finite components take no part, as query or
candidate; nor do rows with a null id; vectors of different lengths are compared only with
their own length; repeated rows (same id and vector) count once; a query with fewer candidates gets all of them; an empty table gives
an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import functools
import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seriloom.functions.storage import cut_lineage

PAGE = 512
MOST_PIVOTS = 256
SHARD_ROWS = 50_000
ROWS_PER_PIVOT = 8_000
QUERY_BLOCK = 512
MARGIN = 1e-6


def integer_vectors(table: DataFrame, id_column: str, column: str, scale: int = 64) -> DataFrame:
    """(id, v array<bigint>) of usable rows: floor(scale * x) of each component."""
    v = F.col(column).cast("array<double>")
    usable = F.col(column).isNotNull() & F.forall(
        v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))
    )
    rows = table.filter(usable & F.col(id_column).isNotNull())
    return rows.select(F.col(id_column).cast("long").alias("id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def augmented(v: np.ndarray, greatest: float) -> np.ndarray:
    v = v.astype(np.float64)
    return np.column_stack([v, np.sqrt(np.maximum(greatest - (v * v).sum(axis=1), 0.0))])


def build_tree(points: np.ndarray, page: int = PAGE) -> dict[str, np.ndarray]:
    """An M-tree over the rows of ``points`` as flat arrays; node 0 is the root.

    A set of points larger than a page is divided among routing points picked far from each other; entries of equal points make a
    chain of pages with radius 0.
    """
    centre, radius, from_parent, first, count, leaf, children = [], [], [], [], [], [], []
    entries, entry_distance = [], []

    def node(at: np.ndarray, middle: np.ndarray, distance: np.ndarray, parent: np.ndarray | None) -> int:
        me = len(centre)
        centre.append(middle)
        radius.append(float(distance.max(initial=0.0)))
        from_parent.append(float(np.sqrt(((middle - parent) ** 2).sum())) if parent is not None else 0.0)
        first.append(0)
        count.append(0)
        leaf.append(len(at) <= page)
        children.append([])
        if leaf[me]:
            first[me], count[me] = len(entries), len(at)
            entries.extend(at.tolist())
            entry_distance.extend(distance.tolist())
            return me
        fan = min(page, max(2, -(-len(at) // page)))
        if radius[me] == 0.0:
            parts = [(part, middle) for part in np.array_split(at, fan)]
        else:
            # farthest-first routing points
            picked, nearest = [int(np.argmax(distance))], np.full(len(at), np.inf)
            owner = np.zeros(len(at), np.int64)
            for j in range(fan):
                d = np.sqrt(((points[at] - points[at[picked[j]]]) ** 2).sum(axis=1))
                closer = d < nearest
                nearest[closer], owner[closer] = d[closer], j
                far = int(np.argmax(nearest))
                if nearest[far] == 0.0 or j + 1 == fan:
                    break
                picked.append(far)
            parts = [(at[owner == j], points[at[p]]) for j, p in enumerate(picked) if (owner == j).any()]
        for part, route in parts:
            if len(part) == len(at):  # nothing was divided
                part_sets = np.array_split(part, 2)
            else:
                part_sets = [part]
            for x in part_sets:
                d = np.sqrt(((points[x] - route) ** 2).sum(axis=1))
                children[me].append(node(x, route, d, middle))
        return me

    if len(points):
        middle = points.mean(axis=0)
        node(np.arange(len(points)), middle, np.sqrt(((points - middle) ** 2).sum(axis=1)), None)
    sizes = np.array([len(c) for c in children], np.int64)
    return {
        "centre": np.array(centre).reshape(len(centre), points.shape[1]),
        "radius": np.array(radius),
        "from_parent": np.array(from_parent),
        "first": np.array(first, np.int64),
        "count": np.array(count, np.int64),
        "leaf": np.array(leaf, bool),
        "child_first": np.cumsum(sizes) - sizes,
        "child_count": sizes,
        "child": np.array([c for x in children for c in x], np.int64),
        "entry": np.array(entries, np.int64),
        "entry_distance": np.array(entry_distance),
    }


def search_tree(
    tree: dict[str, np.ndarray],
    greatest: float,
    vectors: np.ndarray,
    ids: np.ndarray,
    query: np.ndarray,
    own_id: int,
    k: int,
    bound: float,
    visited: list[int] | None = None,
) -> list[tuple[int, int]]:
    """(score, id) of the k best entries but ``own_id`` within distance ``bound``, best first."""
    if not len(ids):
        return []
    route = np.append(query.astype(np.float64), 0.0)
    best: list[tuple[int, int]] = []  # (score, -id), the worst first
    far = [bound]  # distance of the k-th best so far

    # the squared distance is |q|^2 + M^2 - 2 score
    fixed = float((query.astype(np.float64) ** 2).sum()) + greatest

    def limit() -> float:
        return far[0] * (1 + MARGIN) + MARGIN

    root = float(np.sqrt(((tree["centre"][0] - route) ** 2).sum()))
    queue = [(max(root - tree["radius"][0], 0.0), 0, root)]
    while queue:
        least, at, distance = heapq.heappop(queue)
        if least > limit():
            break
        if visited is not None:
            visited.append(at)
        if tree["leaf"][at]:
            span = slice(tree["first"][at], tree["first"][at] + tree["count"][at])
            near = np.abs(tree["entry_distance"][span] - distance) <= limit()
            rows = tree["entry"][span][near]
            scores = vectors[rows] @ query
            if len(best) == k:
                better = scores >= best[0][0]
                rows, scores = rows[better], scores[better]
            elif len(rows) > 2 * k:  # the page's own best k, one of them may be the query, and their ties
                better = scores >= np.partition(scores, len(scores) - k - 1)[len(scores) - k - 1]
                rows, scores = rows[better], scores[better]
            for score, i in zip(scores.tolist(), ids[rows].tolist()):
                if i == own_id:
                    continue
                if len(best) < k:
                    heapq.heappush(best, (score, -i))
                elif (score, -i) > best[0]:
                    heapq.heapreplace(best, (score, -i))
            if len(best) == k:
                far[0] = min(bound, float(np.sqrt(max(fixed - 2 * best[0][0], 0.0))))
            continue
        span = slice(tree["child_first"][at], tree["child_first"][at] + tree["child_count"][at])
        kids = tree["child"][span]
        kids = kids[np.abs(tree["from_parent"][kids] - distance) - tree["radius"][kids] <= limit()]
        ways = np.sqrt(((tree["centre"][kids] - route) ** 2).sum(axis=1))
        for kid, way in zip(kids.tolist(), ways.tolist()):
            lower = max(way - tree["radius"][kid], 0.0)
            if lower <= limit():
                heapq.heappush(queue, (lower, kid, way))
    return sorted(((s, -i) for s, i in best), key=lambda x: (-x[0], x[1]))


def _bytes(x: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(x.astype(kind)).tobytes()


TREE_KINDS = {"centre": "<f8", "radius": "<f8", "from_parent": "<f8", "first": "<i8", "count": "<i8", "leaf": "u1"}
TREE_KINDS |= {"child_first": "<i8", "child_count": "<i8", "child": "<i8", "entry": "<i8", "entry_distance": "<f8"}


def build_index(vectors: DataFrame, page: int, pivots: np.ndarray, greatest: float, shard_rows: int) -> tuple[DataFrame, np.ndarray]:
    """(one row per shard with its ids, vectors and tree, distance from each pivot to its farthest vector)."""
    dims = pivots.shape[1] - 1

    def assign(batches):
        for batch in batches:
            v = augmented(batch.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims), greatest)
            near = (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (v @ pivots.T)
            own = near.argmin(axis=1)
            way = np.sqrt(((v - pivots[own]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(own, pa.int32()), pa.array(way), batch.column("id"), batch.column("v")], ["pivot", "way", "id", "v"]
            )

    def build(_key, rows):
        v = rows.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(rows.num_rows, dims)
        ids = rows.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        v, ids = v[order], ids[order]
        tree = build_tree(augmented(v, greatest), page)
        row = {name: _bytes(tree[name], kind) for name, kind in TREE_KINDS.items()}
        row |= {"ids": _bytes(ids, "<i8"), "vectors": _bytes(v, "<i8")}
        first = rows.slice(0, 1)
        return pa.table({"pivot": first.column("pivot"), "part": first.column("part"), **{k: [x] for k, x in row.items()}})

    dealt = cut_lineage(vectors.select("id", "v").mapInArrow(assign, "pivot int, way double, id long, v array<long>"))
    sizes = dealt.groupBy("pivot").agg(F.ceil(F.count("*") / shard_rows).alias("parts"), F.max("way").alias("reach"))
    reach = np.full(len(pivots), -np.inf)
    for r in sizes.select("pivot", "reach").collect():  # a row for each pivot
        reach[r.pivot] = r.reach
    parts = dealt.join(sizes, "pivot").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    columns = ", ".join(f"{name} binary" for name in [*TREE_KINDS, "ids", "vectors"])
    built = parts.select("pivot", "part", "id", "v").groupBy("pivot", "part").applyInArrow(build, f"pivot int, part int, {columns}")
    return cut_lineage(built), reach


def search(queries: DataFrame, index: DataFrame, k: int, dims: int, greatest: float) -> DataFrame:
    """(query_id, id, score): the k best in each shard of the pivots in ``queries(query_id, q, pivot, bound, block)``."""

    def look(_key, asked, shards):
        out: dict[str, list] = {"query_id": [], "id": [], "score": []}
        if shards.num_rows and asked.num_rows:
            row = shards.to_pylist()[0]
            tree = {name: np.frombuffer(row[name], kind) for name, kind in TREE_KINDS.items()}
            tree["centre"] = tree["centre"].reshape(-1, dims + 1)
            ids = np.frombuffer(row["ids"], "<i8")
            vectors = np.frombuffer(row["vectors"], "<i8").reshape(-1, dims)
            exact = vectors.astype(np.float64)  # products of whole numbers below 2 ** 52 stay exact
            greatest_part = float(np.abs(exact).max(initial=0.0))
            for q in asked.to_pylist():
                v = np.array(q["q"], np.int64)
                own = exact if greatest_part * float(np.abs(v).max(initial=0)) * dims < 2**52 else vectors
                for score, i in search_tree(tree, greatest, own, ids, v.astype(own.dtype), q["query_id"], k, q["bound"]):
                    out["query_id"].append(q["query_id"])
                    out["id"].append(i)
                    out["score"].append(int(score))
        return pa.table({c: pa.array(x, pa.int64()) for c, x in out.items()})

    shards = index.select("pivot", "part")
    asked = queries.join(shards, "pivot")
    sent = index.join(queries.select("pivot", "block").distinct(), "pivot")  # a shard goes to each block of its queries
    key = ["pivot", "part", "block"]
    sent = sent.select(*[F.col(c).alias(f"of_{c}") for c in key], *[c for c in index.columns if c not in key])
    return asked.groupBy(*key).cogroup(sent.groupBy(*[f"of_{c}" for c in key])).applyInArrow(look, "query_id long, id long, score long")


def top_k(
    vectors: DataFrame,
    queries: DataFrame,
    k: int = 20,
    page: int = PAGE,
    most_pivots: int = MOST_PIVOTS,
    shard_rows: int = SHARD_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score) of ``queries(id, v)`` against ``vectors(id, v)``, integer components.

    A query never finds its own id.
    """
    lengths = sorted(r.n for r in vectors.select(F.size("v").alias("n")).filter("n > 0").distinct().collect())
    parts = [_top_k_of_length(vectors, queries, n, k, page, most_pivots, shard_rows) for n in lengths]
    if not parts:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, id long, score long")
    return functools.reduce(DataFrame.union, parts)


def _top_k_of_length(vectors, queries, dims, k, page, most_pivots, shard_rows) -> DataFrame:
    same = vectors.filter(F.size("v") == dims).select("id", "v").distinct()
    few = Window.partitionBy("v").orderBy("id")
    kept = cut_lineage(same.withColumn("n", F.row_number().over(few)).filter(F.col("n") <= k + 1).drop("n"))
    norm = F.aggregate("v", F.lit(0).cast("long"), lambda s, x: s + x * x)
    rows, greatest = kept.agg(F.count("*"), F.max(norm).cast("double")).first()
    n_pivots = int(min(most_pivots, max(1, rows // ROWS_PER_PIVOT)))
    chosen = kept.select("v").distinct().orderBy(F.xxhash64("v")).limit(n_pivots).collect()
    pivots = augmented(np.array([r.v for r in chosen]).reshape(-1, dims), greatest)
    index, reach = build_index(kept, page, pivots, greatest, shard_rows)

    def ways(batch) -> np.ndarray:
        q = batch.column("q").flatten().to_numpy(zero_copy_only=False).reshape(-1, dims).astype(np.float64)
        flat = (q * q).sum(axis=1)[:, None] + (pivots * pivots).sum(axis=1)[None, :] - 2.0 * (q @ pivots[:, :dims].T)
        return np.sqrt(np.maximum(flat, 0.0))

    def nearest(batches):
        for batch in batches:
            home = np.where(np.isfinite(reach), ways(batch), np.inf).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), batch.column("q"), pa.array(home, pa.int32())], ["query_id", "q", "pivot"])

    def others(batches):
        for batch in batches:
            bound = batch.column("bound").to_numpy()
            home = batch.column("home").to_numpy()
            open_ = ways(batch) - reach <= (bound * (1 + MARGIN) + MARGIN)[:, None]
            open_ &= np.isfinite(reach)
            open_[np.arange(len(home)), home] = False
            at, pivot = np.nonzero(open_)
            again = pa.array(at)
            yield pa.RecordBatch.from_arrays(
                [batch.column("query_id").take(again), batch.column("q").take(again), pa.array(pivot, pa.int32()), pa.array(bound[at])],
                ["query_id", "q", "pivot", "bound"],
            )

    own = queries.filter(F.size("v") == dims).select(F.col("id").alias("query_id"), F.col("v").alias("q")).distinct()
    block = F.pmod(F.xxhash64("query_id"), F.lit(max(1, rows // 20 // QUERY_BLOCK))).cast("int")
    asked = cut_lineage(own.mapInArrow(nearest, "query_id long, q array<long>, pivot int"))
    everything = asked.withColumn("bound", F.lit(float("inf"))).withColumn("block", block)
    home = cut_lineage(search(everything, index, k, dims, greatest))

    # with k results at home, only pivots with something as near as the k-th are left
    sq = F.aggregate("q", F.lit(0).cast("long"), lambda s, x: s + x * x)
    best_home = best_of(home, k).groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("kth"))
    far = F.sqrt(F.greatest(sq + F.lit(greatest) - 2 * F.col("kth"), F.lit(0.0)))
    bound = F.when(F.col("n") >= k, far).otherwise(F.lit(float("inf"))).alias("bound")
    rest = asked.join(best_home, "query_id", "left").select("query_id", "q", F.col("pivot").alias("home"), bound)
    rest = cut_lineage(rest.mapInArrow(others, "query_id long, q array<long>, pivot int, bound double")).withColumn("block", block)
    away = search(rest, index, k, dims, greatest)
    return best_of(home.union(away), k).select("query_id", "rank", "id", "score")


def best_of(found: DataFrame, k: int) -> DataFrame:
    """The k best of each query, ranked from 1."""
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
