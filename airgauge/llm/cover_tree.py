"""Exact top-k by inner product: dual-tree search over cover trees of queries and data.

Queries and data are cut into blocks of bounded size, each indexed by a cover tree. Every
query block meets every data block, a few of them in each task; pairs of nodes are pruned when their centres and
covering radii bound all scores below the worst k-th score of the node's queries.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

LEAF = 32
BASE = 1.3  # by which the cover shrinks from a node to its children
BLOCK = 4096
QUERIES_PER_BLOCK = 2048
BLOCKS_PER_TASK = 4  # of data, for one block of queries; about
MOST_TASKS = 1 << 16
SCALE = 256
_EXACT = 1 << 53  # sums of products below it are exact as doubles
_LONG = 1 << 62  # and below this as 64-bit integers


class CoverTree:
    """A cover tree over the rows of ``points``, as arrays.

    A node covers its points within ``radius`` of its centre, one of them. Its children's
    centres, of which its own is the first, are more than radius / BASE apart, and each
    child covers what lies within that. A node is a leaf if it has few points, or if that
    takes so many children that they would hold little more than their centres; its points
    are then compared at once.
    """

    def __init__(self, points: np.ndarray):
        self.centers: list[int] = []
        self.radius: list[float] = []
        self.children: list[list[int]] = []
        self.members: list[np.ndarray] = []
        if not len(points):
            return
        distance = np.linalg.norm(points - points[0], axis=1)
        self._add(0, np.arange(len(points)), distance)
        todo = [(0, distance)]
        while todo:
            node, distance = todo.pop()
            members = self.members[node]
            if len(members) > LEAF and self.radius[node] > 0:
                for parts in self._split(points, node, distance):
                    child = self._add(*parts)
                    self.children[node].append(child)
                    todo.append((child, parts[2]))

    def _split(self, points: np.ndarray, node: int, distance: np.ndarray) -> list[tuple]:
        """(centre, members, distances) of the children; none if they would be too many."""
        members, center = self.members[node], self.centers[node]
        cover, most, found = self.radius[node] / BASE, int(2 * np.sqrt(len(members))), []
        while len(members):
            if len(found) == most:
                return []
            inside = distance <= cover
            found.append((center, members[inside], distance[inside]))
            members = members[~inside]
            if len(members):
                center = int(members[0])
                distance = np.linalg.norm(points[members] - points[center], axis=1)
        return found

    def _add(self, center: int, members: np.ndarray, distance: np.ndarray) -> int:
        self.centers.append(center)
        self.radius.append(float(distance.max()) if len(distance) else 0.0)
        self.children.append([])
        self.members.append(members)
        return len(self.centers) - 1


class Search:
    """Best ``k`` data rows of each query, by score and then by smaller id."""

    def __init__(self, queries: np.ndarray, own: np.ndarray, query_tree: CoverTree, k: int):
        self.q, self.own, self.tree, self.k = queries, own, query_tree, k
        self.norm = np.linalg.norm(queries, axis=1)
        self.scores = np.full((len(queries), k), -np.inf)
        self.places = np.full((len(queries), k), -1, np.int64)
        self.ids = np.full((len(queries), k), np.iinfo(np.int64).max)
        self.q_center = queries[query_tree.centers]
        self.q_norm = np.linalg.norm(self.q_center, axis=1)

    def run(self, data: np.ndarray, ids: np.ndarray, places: np.ndarray, tree: CoverTree) -> None:
        """Take the rows of a data block into account."""
        center = data[tree.centers]
        norm, radius = np.linalg.norm(center, axis=1), np.array(tree.radius)
        q_radius = np.array(self.tree.radius)

        def bounds(qs: list[int], rs: list[int]) -> np.ndarray:
            """The most that any query below one node can score with any row below another."""
            a, b = self.q_norm[qs][:, None], norm[rs][None, :]
            x, y = q_radius[qs][:, None], radius[rs][None, :]
            far = a * y + b * x + x * y
            return self.q_center[qs] @ center[rs].T + far + 1e-9 * (a * b + far) + 1e-9

        def own_bounds(queries: np.ndarray, rs: list[int]) -> np.ndarray:
            """The same for single queries."""
            a, b, y = self.norm[queries][:, None], norm[rs][None, :], radius[rs][None, :]
            return self.q[queries] @ center[rs].T + a * y + 1e-9 * (a * b + a * y) + 1e-9

        todo = [(float(bounds([0], [0])[0, 0]), 0, 0, self.tree.members[0])]
        while todo:
            bound, q, r, queries = todo.pop()
            if bound < self.scores[queries, -1].min():
                continue
            below_q, below_r = self.tree.children[q], tree.children[r]
            if not below_q:
                # A group that is split no further may lie far apart: each query has a bound of its own.
                queries = queries[own_bounds(queries, [r])[:, 0] >= self.scores[queries, -1]]
                if not len(queries):
                    continue
                if not below_r:
                    self._leaf(queries, data, ids, places, tree.members[r])
                    continue
                most = own_bounds(queries, below_r).max(axis=0)
                todo += sorted(((float(x), q, child, queries) for x, child in zip(most, below_r)), key=lambda x: x[:3])
                continue
            split_q = not below_r or q_radius[q] > radius[r]
            qs, rs = (below_q, [r]) if split_q else ([q], below_r)
            table = bounds(qs, rs)
            pairs = [(float(table[i, j]), a, b, self.tree.members[a]) for i, a in enumerate(qs) for j, b in enumerate(rs)]
            todo += sorted(pairs, key=lambda x: x[:3])  # the most promising pair is taken first

    def _leaf(self, queries: np.ndarray, data: np.ndarray, ids: np.ndarray, places: np.ndarray, rows: np.ndarray) -> None:
        step = max(1, (1 << 20) // len(rows))
        for low in range(0, len(queries), step):
            self._compare(queries[low : low + step], data[rows], ids[rows], places[rows])

    def _compare(self, queries: np.ndarray, data: np.ndarray, ids: np.ndarray, places: np.ndarray) -> None:
        """Merge all rows of ``data`` with the best rows of the queries so far."""
        scores = self.q[queries] @ data.T
        scores[self.own[queries][:, None] == places[None, :]] = -np.inf
        least = self.scores[queries, -1]
        if len(data) > self.k:
            least = np.maximum(least, np.partition(scores, -self.k, axis=1)[:, -self.k])
        query, row = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        if not len(query):
            return
        use, query = np.unique(query, return_inverse=True)
        every = queries[use]
        before = np.repeat(np.arange(len(use)), self.k)
        owner = np.concatenate([before, query])
        score = np.concatenate([self.scores[every].ravel(), scores[use[query], row]])
        id_ = np.concatenate([self.ids[every].ravel(), ids[row]])
        place = np.concatenate([self.places[every].ravel(), places[row]])
        order = np.lexsort((place, id_, -score, owner))
        first = np.searchsorted(owner[order], np.arange(len(use)))
        best = order[first[:, None] + np.arange(self.k)]
        self.scores[every], self.ids[every], self.places[every] = score[best], id_[best], place[best]


def _packed(batch: pa.Table | pa.RecordBatch, scale: int) -> bytes:
    """A block: row places, ids, whole numbers (as doubles, which hold them exactly) and cover tree."""
    raw = pc.list_flatten(batch.column("vector")).to_numpy(zero_copy_only=False)
    vectors = np.floor(raw.astype(np.float64) * scale).reshape(batch.num_rows, -1)
    numbers = (batch.column(name).to_numpy() for name in ("place", "vec_id"))
    return pickle.dumps((*numbers, vectors, CoverTree(vectors)), pickle.HIGHEST_PROTOCOL)


_whole = np.frompyfunc(int, 1, 1)


def largest_score(queries: np.ndarray, data: np.ndarray) -> float:
    """A bound of all scores, and of all sums on the way to them."""
    return float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, data.shape[1])


def _compared_exactly(
    queries: np.ndarray, own: np.ndarray, data: np.ndarray, ids: np.ndarray, places: np.ndarray, k: int, most: float
) -> Iterator[tuple[int, int, int]]:
    """(query, row, score) of the best rows of each query, from products in whole numbers of any size."""
    convert = (lambda x: x.astype(np.int64)) if most < _LONG else _whole
    rows = convert(data).T
    for low in range(0, len(queries), 256):
        table = convert(queries[low : low + 256]) @ rows
        for i, scores in enumerate(table):
            others = np.flatnonzero(places != own[low + i])
            if scores.dtype == object:
                best = sorted(others.tolist(), key=lambda j: (-scores[j], ids[j], places[j]))[:k]
            else:
                best = others[np.lexsort((places[others], ids[others], -scores[others]))[:k]].tolist()
            for j in best:
                yield low + i, j, int(scores[j])


#: Found scores: ``wide`` orders those that a long cannot hold, whose ``score`` is the nearest long.
_FOUND = "query bigint, query_id bigint, vec_id bigint, place bigint, score bigint, wide binary"
_WIDE_BYTES = 288  # of a score's distance from the least that doubles can make


def _found_rows(query: np.ndarray, query_id: np.ndarray, vec_id: np.ndarray, place: np.ndarray, scores: list[int]) -> pa.RecordBatch:
    top = (1 << 63) - 1
    wide = [None if -_LONG < x < _LONG else (x + (1 << 8 * _WIDE_BYTES - 1)).to_bytes(_WIDE_BYTES, "big") for x in scores]
    near = [max(-top, min(top, x)) for x in scores]
    columns = [*map(pa.array, (query, query_id, vec_id, place)), pa.array(near, pa.int64()), pa.array(wide, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, [x.split()[0] for x in _FOUND.split(", ")])


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score) of the ``k`` best rows of each query.

    ``vectors`` has vec_id and embedding; components become floor(scale * x). Queries are
    the rows whose vec_id is divisible by ``every``, candidates all rows but the query's
    own. Null ids, null vectors and those with null or non-finite components take no part;
    vectors meet those of their own length only; repeated rows are candidates, and
    queries, each. Components may have any finite size: where sums of products pass 2**53,
    a pair of blocks is compared in whole numbers instead of by its trees. A score that no
    long can hold is ranked by its value and null. Other columns are ignored.
    """
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = (
        vectors.select("vec_id", "embedding", F.monotonically_increasing_id().alias("place"))
        .where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & sound)
        .select(F.col("vec_id").cast("bigint"), "place", F.size("embedding").alias("dim"), F.col("embedding").cast("array<double>").alias("vector"))
    )
    is_query = F.col("vec_id") % every == 0
    asked = rows.where(is_query)
    seen = rows.agg(F.count(F.lit(1)).alias("all"), F.count_if(is_query).alias("asked")).first()
    blocks = max(1, -(-seen["asked"] // QUERIES_PER_BLOCK))
    parts = max(1, -(-seen["all"] // (BLOCK * BLOCKS_PER_TASK)))
    tasks = min(blocks * parts, MOST_TASKS)

    def pack_queries(table: pa.Table) -> pa.Table:
        first = table.slice(0, 1)
        return pa.table({"dim": first["dim"], "block": first["block"], "queries": pa.array([_packed(table, scale)], pa.binary())})

    def pack_data(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[pa.RecordBatch]] = {}

        def row(dim: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(held.pop(dim))
            columns = [pa.array([dim], pa.int32()), table["place"].slice(0, 1).combine_chunks(), pa.array([_packed(table, scale)], pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["dim", "first", "data"])

        for batch in batches:
            for low in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(low, BLOCK)
                for dim in piece.column("dim").unique().to_pylist():
                    part = piece.filter(pc.equal(piece.column("dim"), dim))
                    held.setdefault(dim, []).append(part)
                    if sum(x.num_rows for x in held[dim]) >= BLOCK:
                        yield row(dim)
        for dim in list(held):
            yield row(dim)

    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for queries, data in zip(batch.column("queries"), batch.column("data")):
                places, ids, asked_rows, tree = pickle.loads(queries.as_buffer())
                data_places, data_ids, data_rows, data_tree = pickle.loads(data.as_buffer())
                most = largest_score(asked_rows, data_rows)
                if most < _EXACT:
                    found = Search(asked_rows, places, tree, k)
                    found.run(data_rows, data_ids, data_places, data_tree)
                    some = np.isfinite(found.scores)
                    query = np.broadcast_to(np.arange(len(ids))[:, None], some.shape)[some]
                    scores = found.scores[some].astype(np.int64).tolist()
                    yield _found_rows(places[query], ids[query], found.ids[some], found.places[some], scores)
                else:
                    best = list(_compared_exactly(asked_rows, places, data_rows, data_ids, data_places, k, most))
                    query, row = (np.array([x[i] for x in best], np.int64) for i in (0, 1))
                    yield _found_rows(places[query], ids[query], data_ids[row], data_places[row], [x[2] for x in best])

    block = F.pmod(F.xxhash64("place"), F.lit(blocks)).cast("int")
    queries = asked.withColumn("block", block).groupBy("dim", "block").applyInArrow(pack_queries, "dim int, block int, queries binary")
    data = rows.mapInArrow(pack_data, "dim int, first bigint, data binary")
    data = data.withColumn("part", F.pmod(F.xxhash64("first"), F.lit(parts)).cast("int"))
    data = data.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    queries = queries.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    keys = ["dim", "block", "part"]
    met = data.repartition(tasks, *keys).join(queries.repartition(tasks, *keys), keys)
    found = met.select("queries", "data").mapInArrow(search, _FOUND)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.desc("wide"), "vec_id", "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    held = F.when(F.col("wide").isNull() | (F.abs("score") < F.lit((1 << 63) - 1)), F.col("score"))
    return ranked.select("query_id", "rank", "vec_id", held.alias("score"))
