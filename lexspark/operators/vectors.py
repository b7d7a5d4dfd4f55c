"""Exact nearest neighbours between two tables of vectors (squared Euclidean distance).

Equal queries are searched once; where many queries meet a table full of copies, each distinct vector is
searched once too and its ``k`` least ids are joined to what was found. Two ways lead to the same rows:

* few queries - their matrix fits a stated number of bytes: it is broadcast, the vectors are read
  where they lie, and each task hands on only its best ``k`` per query;
* many queries - the vectors are dealt into slices and the queries into blocks, by hashes, and every
  slice meets every block in a task of its own. Each row is copied once per block (or slice), not once
  per cell that a query may reach, and no task holds more than one slice and one block.

Inside a task the slice is cut into cells around some of its vectors; the triangle inequality rules out
cells, a single-precision product gives the least value of every other cell, and the k least of these bound
what is looked at again, with a proven margin, so that few pairs have their distance computed.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lexspark.functions.text import similarity
from lexspark.operators.windows import top_k
from lexspark.session import saved, use_checkpoints

BROADCAST_BYTES = 64 << 20
BLOCK_ROWS = 100_000
TASKS = 48
_FILTER_SOURCES = 1000
_DIGITS = 9  # distances are ranked after rounding, so that summation order cannot swap equal ones
_TILE = 512  # a tile against a cell stays in a core's cache
_CELL_ROWS = 1024
_EXACT_ROWS = 100_000
_MANY_PAIRS = 10 ** 10  # from here on it pays to look for copies among the vectors
_FEW_DISTINCT = 0.8


def _whole(column) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    return column


def _matrix(column) -> np.ndarray:
    column = _whole(column)
    if not len(column):
        return np.zeros((0, 0))
    sizes = np.diff(column.offsets.to_numpy())
    if sizes.min() != sizes.max():
        raise ValueError("vectors of different lengths")
    return column.flatten().to_numpy(zero_copy_only=False).astype("float64").reshape(len(column), int(sizes[0]))


def _names(column) -> np.ndarray:
    return np.array(_whole(column).to_pylist(), dtype=object)


def _distinct(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first row of each distinct vector, number of its distinct vector for every row), distinct ones in mixed order."""
    bits = np.ascontiguousarray(vectors + 0.0).view(np.uint64)
    odd = np.random.default_rng(0).integers(0, 1 << 63, bits.shape[1], dtype=np.uint64) * 2 + 1
    mixed = ((bits ^ (bits >> np.uint64(29))) * odd).sum(1, dtype=np.uint64)
    mixed = (mixed ^ (mixed >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
    _, first, group = np.unique(mixed, return_index=True, return_inverse=True)
    if not np.array_equal(bits[first][group], bits):  # two vectors share a hash
        _, first, group = np.unique(vectors, axis=0, return_index=True, return_inverse=True)
    return first, group.reshape(-1)


def _place(sorted_keys: np.ndarray) -> np.ndarray:
    """Position of every row within the run of its key."""
    new = np.flatnonzero(np.append(True, sorted_keys[1:] != sorted_keys[:-1])) if len(sorted_keys) else np.zeros(0, dtype="int64")
    return np.arange(len(sorted_keys)) - np.repeat(new, np.diff(np.append(new, len(sorted_keys))))


class _Slice:
    """Distinct vectors of a slice in cells, ready to be searched."""

    def __init__(self, vectors: np.ndarray, scale: float, pivots: int | None):
        self.vectors, self.scale, dim = vectors, scale, vectors.shape[1]
        wide = vectors / scale
        count = min(len(vectors), pivots or max(1, min(256, len(vectors) // _CELL_ROWS)))
        self.centres = wide[:count]  # the order is mixed, so these are spread over the slice
        home = np.zeros(len(vectors), dtype="int64")
        for low in range(0, len(wide), _TILE):
            part = wide[low:low + _TILE]
            home[low:low + _TILE] = ((self.centres ** 2).sum(1)[None, :] - 2.0 * (part @ self.centres.T)).argmin(1)
        self.order = np.argsort(home, kind="stable")
        self.cuts = np.searchsorted(home[self.order], np.arange(count + 1))
        placed = wide[self.order]
        away = np.sqrt(((placed - self.centres[home[self.order]]) ** 2).sum(1))
        self.reach = np.array([away[a:b].max() if b > a else -np.inf for a, b in zip(self.cuts, self.cuts[1:], strict=False)])
        lengths = (placed * placed).sum(1)
        self.single = np.concatenate([placed, lengths[:, None]], 1).astype("float32")
        # rounding of dim + 1 products and sums of numbers up to 1 (scaled lengths), with a margin of two
        self.slack = 8.0 * (dim + 8) * 2.0 ** -24

    def candidates(self, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, vector) pairs that hold at least the k nearest distinct vectors of every query."""
        wide = queries / self.scale
        lengths = (wide * wide).sum(1)
        single = np.concatenate([-2.0 * wide, np.ones((len(wide), 1))], 1).astype("float32")
        gaps = lengths[:, None] + (self.centres ** 2).sum(1)[None, :] - 2.0 * (wide @ self.centres.T)
        gaps = np.sqrt(np.maximum(gaps, 0.0) + 1e-12)
        own, bound = gaps.argmin(1), np.full(len(wide), np.inf)
        cells = list(zip(self.cuts, self.cuts[1:], strict=False))
        for cell in np.unique(own):
            low, high = cells[cell]
            rows = np.flatnonzero(own == cell)
            if high - low >= k:
                bound[rows] = np.partition(single[rows] @ self.single[low:high].T, k - 1, axis=1)[:, k - 1]
        rows = np.flatnonzero(np.isinf(bound))
        some = self.single[:max(k, 4 * _CELL_ROWS)]
        if len(rows) and len(some) >= k:
            bound[rows] = np.partition(single[rows] @ some.T, k - 1, axis=1)[:, k - 1]
        limit = bound + 2 * self.slack
        least = np.maximum(gaps - self.reach[None, :] - 1e-5, 0.0)
        visits = least ** 2 - lengths[:, None] <= limit[:, None]
        limit = np.nextafter(limit.astype("float32"), np.float32(np.inf))
        nearest = np.full(visits.shape, np.inf, dtype="float32")  # least value of every cell
        for cell, (low, high) in enumerate(cells):
            rows = np.flatnonzero(visits[:, cell])
            if len(rows) and high > low:
                part = single if len(rows) == len(single) else single[rows]
                nearest[rows, cell] = (part @ self.single[low:high].T).min(1)
        if len(cells) >= k:  # the k least of them belong to k vectors
            least_k = np.partition(nearest, k - 1, axis=1)[:, k - 1].astype("float64") + 2 * self.slack
            limit = np.minimum(limit, np.nextafter(least_k.astype("float32"), np.float32(np.inf)))
        # the second product may be summed in another order than the first, which the margin covers
        visits = nearest <= limit[:, None] + np.float32(self.slack)
        found_q, found_v, found_s = [], [], []
        for cell, (low, high) in enumerate(cells):
            rows = np.flatnonzero(visits[:, cell])
            if not len(rows) or high == low:
                continue
            rough = single[rows] @ self.single[low:high].T
            hits = np.flatnonzero(rough <= limit[rows][:, None])
            q, v = np.divmod(hits, high - low)
            found_q.append(rows[q]), found_v.append(v + low), found_s.append(rough.reshape(-1)[hits])
        if not found_q:
            return np.zeros(0, dtype="int64"), np.zeros(0, dtype="int64")
        q, v, s = np.concatenate(found_q), np.concatenate(found_v), np.concatenate(found_s)
        ranked = np.lexsort((s, q))
        q, v, s = q[ranked], v[ranked], s[ranked].astype("float64")
        kth = np.full(len(wide), np.inf)
        last = _place(q) == k - 1
        kth[q[last]] = s[last]
        kept = s <= kth[q] + 2 * self.slack
        return q[kept], self.order[v[kept]]


def _best_of_block(queries: np.ndarray, vectors: np.ndarray, k: int, pivots: int | None = None):
    """(query index, vector index, distance) of the k best per query of this block; ties go to the lesser index.

    Equal vectors are compared once and contribute their k least indices, so copies cost nothing extra.
    """
    first, group = _distinct(vectors)
    members = np.argsort(group, kind="stable")  # rows of one vector lie together, in order
    starts = np.searchsorted(group[members], np.arange(len(first)))
    sizes = np.minimum(np.diff(np.append(starts, len(members))), k)
    distinct = vectors[first]
    scale = float(np.sqrt(max((queries ** 2).sum(1).max(), (distinct ** 2).sum(1).max()))) or 1.0
    block = _Slice(distinct, scale, pivots)
    found = []
    for low in range(0, len(queries), _TILE):
        tile = queries[low:low + _TILE]
        q, v = block.candidates(tile, k)
        exact = np.concatenate([np.zeros(0)] + [
            np.round(((tile[q[a:a + _EXACT_ROWS]] - distinct[v[a:a + _EXACT_ROWS]]) ** 2).sum(1), _DIGITS)
            for a in range(0, len(q), _EXACT_ROWS)])
        near = np.lexsort((exact, q))  # the k-th distance first, so that only what it lets through is spread to its copies
        kth = np.full(len(tile), np.inf)
        last = _place(q[near]) == k - 1
        kth[q[near][last]] = exact[near][last]
        kept = exact <= kth[q]
        q, v, exact = q[kept], v[kept], exact[kept]
        repeat = sizes[v]
        offset = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
        rows = members[np.repeat(starts[v], repeat) + offset]
        q, exact = np.repeat(q, repeat), np.repeat(exact, repeat)
        ranked = np.lexsort((rows, exact, q))
        ranked = ranked[_place(q[ranked]) < k]
        found.append((q[ranked] + low, rows[ranked], exact[ranked]))
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _search(queries: np.ndarray, wanted: np.ndarray, vectors, k: int, pivots: int | None = None) -> pa.Table:
    """Best k per query (by its number); a query with a wanted source sees only vectors of that source."""
    ids = _whole(vectors["vector_id"])
    order = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    matrix, sources, ids = _matrix(vectors["vector"])[order], _names(vectors["source"])[order], ids.take(pa.array(order))
    found_q, found_v, found_d = [np.zeros(0, dtype="int64")], [np.zeros(0, dtype="int64")], [np.zeros(0)]
    for source in dict.fromkeys(wanted):
        asking = np.flatnonzero(np.array([w is source or w == source for w in wanted], dtype=bool))
        offered = np.arange(len(ids)) if source is None else np.flatnonzero(sources == source)
        if len(asking) and len(offered):
            q, v, d = _best_of_block(queries[asking], matrix[offered], k, pivots)
            found_q.append(asking[q]), found_v.append(offered[v]), found_d.append(d)
    rows = pa.array(np.concatenate(found_v))
    return pa.table({"query": np.concatenate(found_q), "vector_id": ids.take(rows),
                     "vector_key": _whole(vectors["vector_key"]).take(pa.array(order)).take(rows),
                     "distance": np.concatenate(found_d)})


def _k_best(found: pa.Table, k: int) -> pa.Table:
    order = pc.sort_indices(found, sort_keys=[(name, "ascending") for name in ("query", "distance", "vector_id")],
                            null_placement="at_start")
    ranked = found.take(order)
    return ranked.filter(pa.array(_place(ranked["query"].to_numpy()) < k))


def _named(best: pa.Table, query_ids) -> pa.Table:
    """Ids in place of the queries' numbers, once per task."""
    return pa.table({"query_id": _whole(query_ids).take(_whole(best["query"])), "vector_id": _whole(best["vector_id"]),
                     "vector_key": _whole(best["vector_key"]), "distance": _whole(best["distance"])})


def _scan(queries: DataFrame, vectors: DataFrame, k: int, schema: T.StructType, pivots: int | None, block_rows: int) -> DataFrame:
    """Queries (already checked to be few) to every task; vectors stay where they are."""
    local = queries.toArrow()
    shared = queries.sparkSession.sparkContext.broadcast(
        (_whole(local["query_id"]), _matrix(local["vector"]), _names(local["wanted"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, wanted = shared.value
        best, held, rows = None, [], 0

        def searched() -> pa.Table:
            found = _search(matrix, wanted, pa.Table.from_batches(held), k, pivots)
            return found if best is None else _k_best(pa.concat_tables([best, found]), k)

        for batch in batches:
            if len(query_ids) and batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= block_rows:
                best = searched()
                held, rows = [], 0
        if held:
            best = searched()
        if best is not None:
            yield from _named(best, query_ids).to_batches(max_chunksize=10_000)

    return vectors.mapInArrow(run, schema)


def _grid(queries: DataFrame, vectors: DataFrame, k: int, schema: T.StructType, n_queries: int, pivots: int | None,
          block_rows: int) -> DataFrame:
    """Every slice of the vectors against every block of the queries, for query tables of any size.

    Slices and blocks are as many as their rows ask for, and at least so many that ``TASKS`` tasks have work;
    these are shared out so that what is copied is least.
    """
    n_vectors = vectors.count()
    blocks = max(-(-n_queries // block_rows), round((TASKS * n_queries / max(n_vectors, 1)) ** 0.5), 1)
    blocks = min(blocks, max(n_queries, 1))
    slices = max(-(-n_vectors // block_rows), min(-(-TASKS // blocks), -(-n_vectors // _CELL_ROWS)), 1)

    def every(count: int):
        return F.explode(F.sequence(F.lit(0), F.lit(count - 1)))

    left = queries.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int")).withColumn("slice", every(slices))
    right = vectors.withColumn("slice", F.pmod(F.xxhash64("vector_id"), F.lit(slices)).cast("int")).withColumn("block", every(blocks))

    def match(q: pa.Table, v: pa.Table) -> pa.Table:
        if not q.num_rows or not v.num_rows:
            return _named(pa.table({"query": pa.array([], pa.int64()), "vector_id": v["vector_id"].slice(0, 0),
                                    "vector_key": v["vector_key"].slice(0, 0), "distance": pa.array([], pa.float64())}),
                          q["query_id"].slice(0, 0))
        return _named(_search(_matrix(q["vector"]), _names(q["wanted"]), v, k, pivots), q["query_id"])

    keys, parts = ["slice", "block"], 3 * slices * blocks  # more parts than keys, so that few parts get two
    return left.repartition(parts, *keys).groupBy(*keys).cogroup(right.repartition(parts, *keys).groupBy(*keys)) \
        .applyInArrow(match, schema)


def _copies(vectors: DataFrame, k: int, enough: float) -> tuple[DataFrame, DataFrame | None]:
    """(every distinct vector once under its least id, its key with its ``k`` least ids); None if copies are few
    or there are not ``enough`` vectors.

    The estimate only decides whether copies are worth a pass of their own, the results are the same.
    """
    rows = vectors.count()
    if rows < enough or vectors.agg(F.approx_count_distinct(F.xxhash64("vector", "source"))).first()[0] > _FEW_DISTINCT * rows:
        return vectors, None
    # The source is part of the key, as a query may ask for one.
    keyed = vectors.withColumn("vector_key", F.md5(F.to_json(F.struct("vector", "source"))))
    ranked = top_k(keyed, ["vector_key"], ["vector_id"], k)  # each task drops what is beyond k before the shuffle
    first = ranked.withColumn("vector", F.when(F.col("rank") == 1, F.col("vector")))
    kept = saved(first.repartition(TASKS, "vector_key"), "distinct-vectors")
    return kept.where("rank = 1").drop("rank"), kept.select("vector_key", "vector_id")


def nearest(queries: DataFrame, vectors: DataFrame, k: int, *, query_id: str = "query_id",
            vector_id: str = "chunk_id", vector: str = "embedding", wanted: str | None = None,
            source: str = "source_law", broadcast_bytes: int = BROADCAST_BYTES, pivots: int | None = None,
            block_rows: int = BLOCK_ROWS, many_pairs: int = _MANY_PAIRS) -> DataFrame:
    """The ``k`` nearest stored vectors of every query: query, vector, rank, distance, similarity.

    ``wanted`` names a query column with the source to search in (NULL: all sources); the
    restriction comes before the ranking. Ties go to the lesser vector id.
    """
    asked = queries.where(F.col(vector).isNotNull()).select(
        F.col(query_id).alias("_id"), F.col(vector).alias("vector"),
        (F.col(wanted) if wanted else F.lit(None).cast("string")).alias("wanted"))
    stored = vectors.where(F.col(vector).isNotNull()).select(
        F.col(vector_id).alias("vector_id"), F.col(vector).alias("vector"),
        (F.col(source) if wanted else F.lit(None).cast("string")).alias("source"), F.lit(None).cast("string").alias("vector_key"))
    schema = T.StructType([
        T.StructField("query_id", T.StringType()),
        T.StructField("vector_id", stored.schema["vector_id"].dataType),
        T.StructField("vector_key", T.StringType()),
        T.StructField("distance", T.DoubleType()),
    ])
    # Read by the search and for its ids, so the queries are not embedded twice.
    keyed = saved(asked.withColumn("query_id", F.md5(F.to_json(F.struct("vector", "wanted")))), "queries")
    once = keyed.select("query_id", "vector", "wanted").dropDuplicates(["query_id"])
    # What is broadcast: numbers, ids and wanted sources; and what each task hands on, k rows per query.
    ids = F.length("query_id") + F.coalesce(F.length("wanted"), F.lit(0))
    size, rows = once.agg(F.coalesce(F.sum(F.size("vector").cast("bigint") * 8 + ids + 32 * k), F.lit(0)), F.count("*")).first()
    if wanted:  # few sources become a filter on the scan, which then skips the folders of all others
        sources = [row[0] for row in once.select("wanted").distinct().limit(_FILTER_SOURCES + 1).collect()]
        if len(sources) <= _FILTER_SOURCES and None not in sources:
            stored = stored.where(F.col("source").isin(sources))
    stored, members = _copies(stored, k, many_pairs / max(rows, 1))
    found = _scan(once, stored, k, schema, pivots, block_rows) if size <= broadcast_bytes else \
        _grid(once, stored, k, schema, rows, pivots, block_rows)
    # k rows per query: plans that read them more than once do not search again.
    use_checkpoints(queries.sparkSession)
    each = top_k(found, ["query_id"], ["distance", "vector_id"], k).drop("rank").checkpoint()
    if members is not None:  # the k best vectors by their least ids hold the k best rows
        each = each.drop("vector_id").join(members.hint("merge"), "vector_key")
    best = top_k(each.join(keyed.select("query_id", "_id").hint("merge"), "query_id"), ["_id"], ["distance", "vector_id"], k)
    return best.select(F.col("_id").alias(query_id), F.col("vector_id").alias(vector_id), "rank", "distance",
                       similarity(F.col("distance")).alias("similarity"))


def filter_after_ranking(results: DataFrame, condition, k: int, query_id: str = "query_id") -> DataFrame:
    """Keep ranked rows that meet a condition, then the first ``k`` of them, ranked anew."""
    kept = results.where(condition).withColumnRenamed("rank", "_old")
    return top_k(kept, [query_id], ["_old"], k).drop("_old")
