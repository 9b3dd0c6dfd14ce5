"""Approximate nearest neighbours by a hash-prefix forest.

Each vector gets, in each of ``TREES`` trees, a string of ``DEPTH`` bits: the signs of its products with that tree's
random directions. A tree is the sorted array of those strings. A query descends in all trees to its longest
matching prefixes and then ascends in step, one bit at a time over all trees, tree by tree within a level, until
``least`` distinct candidates are found; these are ranked by their exact inner product in double precision.

Vectors are dealt to shards by a hash of their id and themselves, so a bucket that holds a third of all rows (equal
vectors, say, or one id) is spread over all shards, and each shard holds about ``SHARD`` vectors. A shard is one task, which
builds its forest once; all queries are streamed past it, a batch at a time, and the shards' best are merged with partial top-k
lists. So vectors are shuffled once and queries once for each shard. The directions are drawn, not fitted: the index
covers every row and nothing is sampled.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import column, partition_keys, prepare, stage, task

TREES, DEPTH = 48, 32
SHARD = 16_384
#: Distinct candidates of each shard: this share of its vectors, but ``LEAST`` at least.
SHARE, LEAST = 0.5, 400


@functools.cache
def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(dim).standard_normal((dim, TREES * DEPTH)).astype(np.float32)


def strings(v: np.ndarray) -> np.ndarray:
    """The bit string of each vector in each tree, as (trees, vectors) integers whose first bit is the highest."""
    out = np.zeros((TREES, len(v)), np.uint32)
    for lo in range(0, len(v), 2048):
        bits = (v[lo : lo + 2048].astype(np.float32) @ directions(v.shape[1]) > 0).reshape(-1, TREES, DEPTH)
        out[:, lo : lo + 2048] = np.packbits(bits, axis=2).view(">u4")[:, :, 0].T
    return out


class Forest:
    """Sorted arrays of bit strings over some vectors."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.repeated = len(np.unique(ids)) < len(ids)
        codes = strings(vectors)
        self.order = np.argsort(codes, axis=1, kind="stable").astype(np.int32)
        self.sorted = np.take_along_axis(codes, self.order, 1)

    def ranges(self, codes: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each tree and query, the slice of the sorted array that shares the query's first ``depth`` bits."""
        low = np.uint32((0xFFFFFFFF << (DEPTH - depth)) & 0xFFFFFFFF)
        lo = np.stack([np.searchsorted(s, c & low, "left") for s, c in zip(self.sorted, codes)])
        hi = np.stack([np.searchsorted(s, c | ~low, "right") for s, c in zip(self.sorted, codes)])
        return lo, hi

    def search(self, queries: np.ndarray, own: np.ndarray, k: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Ids and scores of the best ``k`` candidates of each query, nearest first, ties to smaller ids; an id counts once, by its best vector."""
        codes = strings(queries)
        levels = {}
        deepest = np.zeros(len(queries), int)  # the deepest level at which all trees together can suffice
        for depth in range(DEPTH, -1, -1):
            lo, hi = self.ranges(codes, depth)
            levels[depth] = lo, hi
            enough = ((hi - lo).sum(0) >= least) & (deepest == 0)
            deepest[enough] = depth
            if (deepest > 0).all():
                break
        for q in range(len(queries)):
            found, depth = np.zeros(len(self.ids), bool), int(deepest[q])
            while True:
                if depth not in levels:
                    levels[depth] = self.ranges(codes, depth)
                lo, hi = levels[depth][0][:, q], levels[depth][1][:, q]
                for t in range(TREES):
                    found[self.order[t, lo[t] : hi[t]]] = True
                    if t % 8 == 7 and np.count_nonzero(found) >= least:
                        break
                else:
                    if depth and np.count_nonzero(found) < least:
                        depth -= 1
                        continue
                break
            at = np.flatnonzero(found)
            at = at[self.ids[at] != own[q]]
            score = self.vectors[at] @ queries[q]
            if self.repeated:
                best = np.lexsort((-score, self.ids[at]))
                at, score = at[best], score[best]
                first = np.ones(len(at), bool)
                first[1:] = self.ids[at[1:]] != self.ids[at[:-1]]
                at, score = at[first], score[first]
            if len(at) > k:
                cut = np.partition(score, len(at) - k)[len(at) - k]
                keep = score >= cut
                at, score = at[keep], score[keep]
            best = np.lexsort((self.ids[at], -score))[:k]
            yield self.ids[at[best]], score[best]


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, share: float = SHARE, id_col: str = "vec_id", vec_col: str = "embedding", shard: int = SHARD) -> DataFrame:
    """The ``k`` rows of ``vectors`` nearest to each row of ``queries`` by inner product: ``(query_id, rank, vec_id, score)``.

    Null, empty, zero and non-finite vectors, vectors with null components and rows with null id take no part. A query
    meets the vectors of its own length. Its own id is no candidate, so rows of one id find neither themselves nor
    each other; an id on several rows is found once, by its best vector, and as a query takes the best of all its
    vectors. With fewer than ``k`` candidates all are returned; empty tables give no row. Other columns aren't read.
    """
    spark = vectors.sparkSession
    prepare(spark)

    def clean(df: DataFrame) -> DataFrame:
        v = column(vec_col).cast("array<double>")
        fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
        return df.where(column(id_col).isNotNull() & v.isNotNull()).where(fine).select(column(id_col).cast("long").alias("id"), v.alias("v"))

    # equal rows are one, found by partial aggregation, so that copies of a row are no hot shard
    points, asked = clean(vectors).distinct(), stage(clean(queries).distinct(), "queries")
    n = max(1, -(-clean(vectors).count() // shard))
    keys = F.array(*(F.lit(int(x)) for x in partition_keys(n)))
    points = points.select(F.get(keys, F.pmod(F.xxhash64("id", "v"), F.lit(n)).cast("int")).alias("shard"), F.lit(0).alias("kind"), "id", "v")
    visits = asked.select(F.explode(keys).alias("shard"), F.lit(1).alias("kind"), "id", "v")
    schema = "query_id long, vec_id long, score double"

    @task
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        forests: dict[int, Forest] | None = None
        for batch in batches:
            kind, ids, vs = (batch.column(i) for i in (1, 2, 3))
            kind, ids = kind.to_numpy(), ids.to_numpy()
            size = np.diff(vs.offsets.to_numpy())
            flat, off = np.asarray(vs.values.to_numpy(zero_copy_only=False), np.float64), vs.offsets.to_numpy()
            rows = lambda at, d: flat[(off[at][:, None] + np.arange(d))]  # noqa: B023, E731
            for d in np.unique(size[kind == 0]).tolist():
                at = np.flatnonzero((kind == 0) & (size == d))
                held.setdefault(d, []).append((ids[at], rows(at, d)))
            if not (kind == 1).any():
                continue
            if forests is None:
                forests = {}
                for d, parts in held.items():
                    own, v = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
                    order = np.argsort(own, kind="stable")
                    forests[d] = Forest(own[order], v[order])
                held.clear()
            for d, forest in forests.items():
                at = np.flatnonzero((kind == 1) & (size == d))
                if not len(at):
                    continue
                least = max(LEAST, k + 1, int(share * len(forest.ids)))
                found = [(np.full(len(i), q), i, s) for q, (i, s) in zip(ids[at], forest.search(rows(at, d), ids[at], k, least))]
                yield pa.RecordBatch.from_pydict(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found)))))

    both = points.unionByName(visits).repartition(n, "shard").sortWithinPartitions("shard", "kind")
    found = both.mapInArrow(search, schema).repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(w).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
