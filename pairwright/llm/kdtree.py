"""Exact search for the largest inner products with KD-trees per shard."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from pairwright.llm.tables import column, cut, map_arrow, small

LEAF = 256
#: Rows of a shard, and bytes of its vectors, at most, on average; a task holds one shard and its tree.
SHARD_ROWS = 200_000
SHARD_BYTES = 128_000_000
#: Rows, and bytes of their vectors, from which the splits between shards are taken.
SAMPLE_ROWS = 20_000
SAMPLE_BYTES = 32_000_000
#: Bytes of the boxes of all leaves that are sent to the tasks at most; beyond, queries go to all shards.
BOX_BYTES = 32_000_000
#: Queries of a task that are searched together.
BLOCK = 2048


def _within_bigint(scores: np.ndarray) -> np.ndarray:
    """Scores beyond the range of a bigint as its ends; only unbounded integers get there."""
    return np.clip(scores, -(2**63), 2**63 - 1) if scores.dtype == object else scores


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """[query, box]: no vector in the box has a larger inner product."""
    return _within_bigint(np.maximum(queries, 0) @ high.T + np.minimum(queries, 0) @ low.T)


class Tree:
    """Vectors under median splits of the widest dimension, with the tight bounding box of every node."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, leaf: int = LEAF) -> None:
        order = np.lexsort((ids,))
        self.ids, self.vectors = ids[order], vectors[order]
        self.lows: list[np.ndarray] = []
        self.highs: list[np.ndarray] = []
        self.spans: list[tuple[int, int]] = []
        self.children: list[tuple[int, int] | None] = []
        place = np.arange(len(ids))
        self._split(place, 0, len(ids), leaf)
        self.ids, self.vectors = self.ids[place], self.vectors[place]
        self.low, self.high = np.array(self.lows), np.array(self.highs)

    def _split(self, place: np.ndarray, start: int, end: int, leaf: int) -> None:
        # Nodes are made in order of a stack, not by recursion: a tree of equal vectors may be deep.
        stack = [(start, end, None, 0)]
        while stack:
            start, end, parent, side = stack.pop()
            mine = self.vectors[place[start:end]]
            low, high = mine.min(0), mine.max(0)
            node = len(self.lows)
            self.lows.append(low)
            self.highs.append(high)
            self.spans.append((start, end))
            self.children.append(None)
            if parent is not None:
                pair = list(self.children[parent] or (0, 0))
                pair[side] = node
                self.children[parent] = (pair[0], pair[1])
            wide = int((high - low).argmax())
            if end - start > leaf and high[wide] > low[wide]:
                middle = (end - start) // 2
                place[start:end] = place[start:end][np.argpartition(mine[:, wide], middle, kind="introselect")]
                stack += [(start + middle, end, node, 1), (start, start + middle, node, 0)]

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """[query, node]: no vector in the box of the node has a larger inner product."""
        return _bounds(queries, self.low, self.high)

    def search(self, own: int, query: np.ndarray, bounds: np.ndarray, k: int, floor: float, best: list) -> None:
        """Add the k best of this tree to the heap `best` of (score, -id), best bounds first.

        A box is opened unless its bound is below the k-th score known so far, here or from trees searched
        before (`floor`); a box that could only tie is opened, as a smaller id may be in it.
        """
        queue = [(-bounds[0], 0)]
        while queue:
            bound, node = heapq.heappop(queue)
            kth = max(floor, best[0][0]) if len(best) == k else floor
            if -bound < kth:
                break
            pair = self.children[node]
            if pair is not None:
                for child in pair:
                    if bounds[child] >= kth:
                        heapq.heappush(queue, (-bounds[child], child))
                continue
            start, end = self.spans[node]
            scores = _within_bigint(self.vectors[start:end] @ query)
            at = np.flatnonzero((scores >= kth) & (self.ids[start:end] != own))
            at = at[np.lexsort((self.ids[start:end][at], -scores[at]))]
            for i in at[:k].tolist():
                item = (scores[i], -int(self.ids[start + i]))
                if len(best) < k:
                    heapq.heappush(best, item)
                elif item > best[0]:
                    heapq.heapreplace(best, item)


class Splits:
    """Median splits of a sample, widest dimensions and largest parts first, into leaves that cover all of space."""

    def __init__(self, sample: np.ndarray, leaves: int) -> None:
        self.nodes: dict[int, tuple[int, int, int, int]] = {}  # node: dimension, threshold, below it, from it on
        self.leaf_of = {0: 0}
        queue, made = [(-len(sample), 0, np.arange(len(sample)))], 1
        while queue and len(self.leaf_of) < leaves:
            _, node, rows = heapq.heappop(queue)
            mine = sample[rows]
            wide = int((mine.max(0).astype(np.float64) - mine.min(0)).argmax()) if len(rows) > 1 else 0
            values = mine[:, wide]
            if len(rows) < 2 or values.max() == values.min():
                continue
            threshold = np.partition(values, len(values) // 2)[len(values) // 2]
            if threshold == values.min():
                threshold = values[values > threshold].min()
            below = values < threshold
            self.nodes[node] = (wide, int(threshold), made, made + 1)
            leaf = self.leaf_of.pop(node)
            self.leaf_of |= {made: leaf, made + 1: len(self.leaf_of) + 1}
            for child, part in ((made, rows[below]), (made + 1, rows[~below])):
                heapq.heappush(queue, (-len(part), child, part))
            made += 2

    def place(self, vectors: np.ndarray) -> np.ndarray:
        """The leaf of each vector."""
        out = np.zeros(len(vectors), np.int32)
        stack = [(0, np.arange(len(vectors)))]
        while stack:
            node, rows = stack.pop()
            if node in self.leaf_of:
                out[rows] = self.leaf_of[node]
            elif len(rows):
                wide, threshold, under, over = self.nodes[node]
                below = vectors[rows, wide] < threshold
                stack += [(under, rows[below]), (over, rows[~below])]
        return out


PLACED = "leaf int, vec_id bigint, v array<bigint>"


def _placing(splits: Splits, dims: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaves = splits.place(_matrix(batch.column("v"), dims, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(leaves), batch.column("vec_id"), batch.column("v")], names=["leaf", "vec_id", "v"])

    return run


BOXES = "leaf int, rows bigint, low array<bigint>, high array<bigint>"


def _boxing(dims: int):
    """A function over placed rows: for each leaf the number of rows and their tight box, by task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            leaves, values = batch.column("leaf").to_numpy(zero_copy_only=False), _matrix(batch.column("v"), dims, np.int64)
            order = np.argsort(leaves, kind="stable")
            starts = np.flatnonzero(np.diff(leaves[order], prepend=-1))
            for a, b in zip(starts.tolist(), [*starts[1:].tolist(), len(order)]):
                mine = values[order[a:b]]
                box = seen.setdefault(int(leaves[order[a]]), [0, mine[0], mine[0]])
                box[:] = box[0] + b - a, np.minimum(box[1], mine.min(0)), np.maximum(box[2], mine.max(0))
        for leaf, (n, low, high) in seen.items():
            arrays = [pa.array([leaf], pa.int32()), pa.array([n], pa.int64()), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (low, high))]
            yield pa.RecordBatch.from_arrays(arrays, names=["leaf", "rows", "low", "high"])

    return run


def _addressing(low: np.ndarray, high: np.ndarray, shards_of: list[list[int]], dims: int, kind: type):
    """A function over (vec_id, v, floor): the shards whose box may hold a vector with a score of the floor or more."""
    low, high = low.astype(kind), high.astype(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                queries = _matrix(part.column("v"), dims, kind)
                floors = _floors(part)
                bounds = _bounds(queries, low, high)
                to = [[s for leaf in np.flatnonzero(row).tolist() for s in shards_of[leaf]] for row in bounds >= floors[:, None]]
                columns = [*(part.column(c) for c in ("vec_id", "v", "floor")), pa.array(to, pa.list_(pa.int32()))]
                yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "v", "floor", "shards"])

    return run


RESULT = "query_id bigint, vec_id bigint, score bigint"


def _matrix(column: pa.Array, dims: int, kind: type) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims).astype(kind, copy=False)


def _floors(queries: pa.RecordBatch) -> np.ndarray:
    """The floors, a step lower: a double may stand above the score it was rounded from."""
    return np.nextafter(queries.column("floor").to_numpy(zero_copy_only=False), -np.inf)


def _kind(dims: int, largest: float) -> type:
    """The numbers in which no inner product is rounded or wraps, the fastest first."""
    most = dims * largest * largest
    return np.float64 if most < 2**53 else np.int64 if most < 2**62 else object


def _searching(k: int, dims: int, kind: type, leaf: int):
    """A function over batches sorted by shard, candidates before queries: the k best of each shard by query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree, ids, vectors = None, None, [], []
        for batch in batches:
            shards = batch.column("shard").to_numpy(zero_copy_only=False)
            is_query = batch.column("is_query").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((shards[1:] != shards[:-1]) | (is_query[1:] != is_query[:-1])) + 1
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(shards)]):
                part = batch.slice(a, b - a)
                if shards[a] != shard:
                    shard, tree, ids, vectors = shards[a], None, [], []
                own = part.column("vec_id").to_numpy(zero_copy_only=False)
                values = _matrix(part.column("v"), dims, kind)
                if not is_query[a]:
                    ids.append(own)
                    vectors.append(values)
                    continue
                if tree is None and ids:
                    tree, ids, vectors = Tree(np.concatenate(ids), np.concatenate(vectors), leaf), [], []
                if tree is None:
                    continue
                floors = _floors(part)
                for at in range(0, len(own), BLOCK):
                    yield _search_block(tree, own[at : at + BLOCK], values[at : at + BLOCK], floors[at : at + BLOCK], k)

    return run


def _search_block(tree: Tree, ids: np.ndarray, queries: np.ndarray, floors: np.ndarray, k: int) -> pa.RecordBatch:
    out = []
    # The bounds of a block take as much memory as some leaves.
    step = max(1, 4_000_000 // len(tree.low))
    for at in range(0, len(ids), step):
        bounds = tree.bounds(queries[at : at + step])
        for i in range(len(bounds)):
            best: list = []
            tree.search(int(ids[at + i]), queries[at + i], bounds[i], k, floors[at + i], best)
            out += [(int(ids[at + i]), -other, int(score)) for score, other in best]
    columns = list(zip(*out)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=[f.split()[0] for f in RESULT.split(", ")])


def top_k(
    vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, shard_rows: int = SHARD_ROWS, leaf_rows: int = LEAF
) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every` the k other vectors of largest score.

    Components are floor(scale * x), scores integer inner products, ties go to the smaller vec_id. Median
    splits, taken from the rows with the smallest hashes (`SAMPLE_ROWS` at most), cut space into leaves; a leaf
    is a shard, or as many as its rows need, dealt by a hash. A task builds the tree of a shard and searches the
    queries that reach it in blocks. Each query is first searched in a shard of its own leaf; its k-th score
    there is a floor for all others: it goes only to shards whose box may hold as good a score, and nothing is
    opened or returned below it. Neither the queries nor the vectors pass through the driver or one task, but
    for that sample and a box per leaf.

    Components and scores beyond the range of a bigint stand as its ends, and such scores are equal; tables that
    hold components large enough are searched with unbounded integers, slowly.

    Vectors null, empty, or with a null or infinite or undefined component take no part, nor do rows without
    a vec_id; shorter vectors count as followed by zeros. Rows that repeat a vec_id are candidates each, but
    not for queries of that id, of which each distinct vector is searched and the best results are kept.
    """
    raw = vectors.select(column(vectors, "vec_id", "bigint"), F.col("`embedding`").cast("array<double>").alias("e"))
    bad = F.exists("e", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = raw.where(F.col("vec_id").isNotNull() & F.col("e").isNotNull() & (F.size("e") > 0) & ~bad)
    whole = cut(ok.select("vec_id", F.transform("e", lambda x: F.floor(F.lit(float(scale)) * x)).alias("v")))
    found = whole.agg(F.count("*"), F.max(F.size("v")), F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))).first()
    rows, dims, largest = found[0], found[1] or 0, found[2] or 0
    spark = vectors.sparkSession
    if not rows:
        return spark.range(0).select(*(F.lit(None).cast(t).alias(n) for n, t in (("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "bigint"))))
    per_shard = max(1, min(shard_rows, SHARD_BYTES // (8 * dims)))
    wanted = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows // per_shard))
    kind = _kind(dims, largest)
    padded = F.concat("v", F.array_repeat(F.lit(0).cast("bigint"), F.lit(dims) - F.size("v"))).alias("v")
    whole = whole.select("vec_id", padded)
    sample = whole.orderBy(F.xxhash64("vec_id", "v")).limit(max(2, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * dims)))).select("v").toArrow()
    splits = Splits(_matrix(sample.column("v").combine_chunks(), dims, np.int64), wanted)
    placed = cut(map_arrow(whole, _placing(splits, dims), PLACED))
    boxes = map_arrow(placed, _boxing(dims), BOXES)
    size = {r["leaf"]: r["n"] for r in boxes.groupBy("leaf").agg(F.sum("rows").alias("n")).collect()}
    leaves, shards, shards_of = sorted(size), 0, []
    for leaf in leaves:
        parts = -(-size[leaf] // per_shard)
        shards_of.append(list(range(shards, shards + parts)))
        shards += parts
    dealt = spark.createDataFrame([(leaf, of[0], len(of)) for leaf, of in zip(leaves, shards_of)], "leaf int, start int, parts int")
    by_hash = (F.col("start") + F.pmod(F.xxhash64("vec_id", "v"), F.col("parts"))).cast("int")
    whole = placed.join(small(dealt, 200_000), "leaf").select("vec_id", "v", by_hash.alias("shard"))
    nothing = F.lit(float("-inf"))
    candidates = whole.select("shard", F.lit(False).alias("is_query"), "vec_id", "v", nothing.alias("floor"))
    queries = whole.where(F.col("vec_id") % every == 0).distinct()
    run = _searching(k, dims, kind, leaf_rows)

    def searched(asked: DataFrame) -> DataFrame:
        both = candidates.union(asked.select("shard", F.lit(True), "vec_id", "v", "floor"))
        return map_arrow(both.repartitionById(shards, "shard").sortWithinPartitions("shard", "is_query", "vec_id"), run, RESULT)

    first = searched(queries.withColumn("floor", nothing))
    kth = first.groupBy("query_id").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("f"))
    # A query vector that occurs with several values has several searches, and no floor that holds for all.
    kth = kth.join(queries.groupBy(F.col("vec_id").alias("query_id")).agg(F.count("*").alias("n")), "query_id").where("n = 1")
    asked = queries.join(kth, F.col("vec_id") == F.col("query_id"), "left")
    asked = asked.select("vec_id", "v", F.coalesce("f", nothing).alias("floor"))
    if len(leaves) * dims * 16 <= BOX_BYTES:
        sides = boxes.select("leaf", F.posexplode(F.arrays_zip("low", "high")).alias("at", "b"))
        sides = sides.groupBy("leaf", "at").agg(F.min("b.low").alias("low"), F.max("b.high").alias("high"))
        sides = sides.orderBy("leaf", "at").toArrow()
        low, high = (sides.column(c).to_numpy().reshape(len(leaves), dims) for c in ("low", "high"))
        to = map_arrow(asked, _addressing(low, high, shards_of, dims, kind), "vec_id bigint, v array<bigint>, floor double, shards array<int>")
    else:
        to = asked.withColumn("shards", F.sequence(F.lit(0), F.lit(shards - 1)))
    results = searched(to.select("vec_id", "v", "floor", F.explode("shards").alias("shard")))
    ranks = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    ranked = results.withColumn("rank", F.row_number().over(ranks)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
