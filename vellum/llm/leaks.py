"""Benchmark decontamination by the q-gram lemma: filter in diagonal bands, verify by banded alignment.

Texts are compared as lower-case letters and digits with single spaces between. An item of m characters leaks into
a document if some region of the document is within e edits of it, e being ``ERROR`` of m, rounded down. Such a
region shares at least m - q + 1 - q e of the item's q-grams, and the diagonals (document position less item
position) of those lie at most e apart. So hits are counted in bands of 2 (e + 1) diagonals that overlap by
half: the region's hits lie in one of them. Bands that reach the bound are aligned.

Where q e would take the whole bound, the item's q is lowered until one q-gram at least must be shared; the edits aren't.
Items under ``Q`` characters match exactly, as a whole that no compared character adjoins. Items without
a compared character can't match; their number is logged as a warning.
"""

from __future__ import annotations

import functools
import logging
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.langid import PLANES, codepoints
from vellum.llm.shared import BASE, U64, chunks, group_slices, mix, over, prepare, ragged, rolling, task, utf8

Q = 12
ERROR = 0.05
#: Characters of benchmark text that are sent to the executors at once; larger benchmarks take several passes.
PASS_CHARS = 4_000_000
TABLE_BITS = 20


@functools.cache
def shown() -> np.ndarray:
    """The lower case of each code point that is a letter or digit, else 0."""
    table = np.zeros(0x110000, np.uint32)
    for c in range(PLANES):
        if (s := chr(c)).isalnum():
            table[c] = ord(s.lower()[0])
    return table


def normal(cps: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Characters as compared, the position each had, and the offsets of the texts; spaces only between characters."""
    x = shown()[cps]
    keep = x > 0
    space = np.zeros(len(x), bool)  # a gap's first character stands for it, if a character of the text stands before
    if len(x):
        space[1:] = keep[:-1] & ~keep[1:]
        starts = off[:-1][np.diff(off) > 0]
        space[starts] = False
    at = np.flatnonzero(keep | space)
    y = x[at]
    y[y == 0] = 32
    return y, at, np.searchsorted(at, off)


def grams(y: np.ndarray, q: int = Q) -> np.ndarray:
    return mix(rolling(y.astype(U64) * U64(BASE) + U64(1), q))


def distance(item: np.ndarray, y: np.ndarray, lo: int, hi: int, first: int, width: int, most: int) -> tuple[int, int, int] | None:
    """Edits, start and end of the best alignment of the whole item to a part of ``y[lo:hi]``; None above ``most``.

    Only cells on the ``width`` diagonals from ``first`` on (position in ``y`` less position in the item) are computed, so
    the cost is the item's length times the band's width. Of equal alignments the one that ends first, then the longest.
    """
    big, d = most + 1 + len(item), np.arange(width)
    cols = first + d  # how far in y a cell stands
    cost, origin = np.where((cols >= lo) & (cols <= hi), 0, big), cols.copy()
    for c in item:
        cols = cols + 1
        step = np.where((cols > lo) & (cols <= hi), y[np.clip(cols - 1, lo, hi - 1)] != c, big)
        diag, up = cost + step, np.append(cost[1:] + 1, big)
        new = np.where((cols >= lo) & (cols <= hi), np.minimum(diag, up), big)
        start = np.where(diag <= up, origin, np.append(origin[1:], 0))
        run = new - d  # insertions: the least cost to the left plus the way from there
        low = np.minimum.accumulate(run)
        source = np.maximum.accumulate(np.where(run == low, d, 0))
        better = (low < run) & (cols <= hi)
        cost, origin = np.where(better, low + d, new), np.where(better, start[source], start)
        if cost.min() > most:
            return None
    best = int(cost.min())
    at = int(np.flatnonzero(cost == best)[0])
    return best, int(origin[at]), int(cols[at])


class Index:
    """The q-grams of items that are compared by the same q."""

    def __init__(self, q: int, items: list[np.ndarray], number: np.ndarray, edits: np.ndarray):
        size = np.array([len(y) for y in items], np.int64)
        self.q, self.items, self.number, self.edits = q, items, number, edits
        self.bound = size - q + 1 - q * edits
        h = np.concatenate([grams(y, q) for y in items])
        item = np.repeat(np.arange(len(items), dtype=np.int32), size - q + 1)
        pos = np.concatenate([np.arange(n - q + 1, dtype=np.int32) for n in size])
        order = np.argsort(h, kind="stable")
        h, self.item, self.pos = h[order], item[order], pos[order]
        starts, _ = group_slices(h)
        self.table = np.zeros(1 << TABLE_BITS, bool)
        self.table[(h >> U64(64 - TABLE_BITS)).astype(np.int64)] = True
        self.keys, self.first = h[starts], np.append(starts, len(h))

    def matches(self, y: np.ndarray, off: np.ndarray):
        """``(document, item, start, end, edits)`` of each leak, as positions in ``y``."""
        q, h = self.q, grams(y, self.q)
        if not len(h):
            return
        maybe = np.flatnonzero(self.table[(h >> U64(64 - TABLE_BITS)).astype(np.int64)])
        k = np.minimum(np.searchsorted(self.keys, h[maybe]), len(self.keys) - 1)
        real = self.keys[k] == h[maybe]
        at, k = maybe[real], k[real]
        doc = np.searchsorted(off, at, side="right") - 1
        inside = at + q <= off[doc + 1]
        at, k, doc = at[inside], k[inside], doc[inside]
        counts = self.first[k + 1] - self.first[k]
        where = ragged(self.first[k], counts)
        at, doc = np.repeat(at, counts), np.repeat(doc, counts)
        item = self.item[where].astype(np.int64)
        band = (at - self.pos[where]) // (self.edits[item] + 1)
        # a hit counts in the band that starts at its half band and in the one before
        docs, item, band = np.concatenate([doc, doc]), np.concatenate([item, item]), np.concatenate([band, band - 1])
        order = np.lexsort((band, item, docs))
        docs, item, band = docs[order], item[order], band[order]
        new = np.ones(len(docs), bool)
        new[1:] = (docs[1:] != docs[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
        starts = np.flatnonzero(new)
        hits = np.diff(np.append(starts, len(docs)))
        good = starts[hits >= self.bound[item[starts]]]
        last: tuple[int, int, int] | None = None
        for d, i, b in zip(docs[good].tolist(), item[good].tolist(), band[good].tolist()):
            e, n = int(self.edits[i]), len(self.items[i])
            # two matches can't share a band: they would lie at least n - e diagonals apart
            low = b * (e + 1) - e
            lo, hi = max(int(off[d]), low), min(int(off[d + 1]), (b + 2) * (e + 1) + n + e)
            if last and last[:2] == (d, i) and lo < last[2]:
                lo = last[2]  # what the band before has matched isn't matched again
            if hi - lo >= n - e and (got := distance(self.items[i], y, lo, hi, low, 4 * e + 2, e)):
                yield d, int(self.number[i]), got[1], got[2], got[0]
                last = (d, i, got[2])


@dataclass
class Bench:
    """The items of one pass: indexes by q, and items under ``Q`` characters by length and characters, which come last in ``ids``."""

    ids: list[int | None]
    indexes: list[Index]
    short: dict[int, dict[bytes, list[int]]]

    @classmethod
    def of(cls, rows: list[tuple[int | None, str]], q: int = Q, error: float = ERROR) -> Bench:
        ids, items, small, lost = [], [], [], 0
        for i, text in rows:
            cps = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
            y = normal(cps, np.array([0, len(cps)]))[0]
            if len(y) and y[-1] == 32:
                y = y[:-1]
            if len(y) >= q:
                ids.append(i)
                items.append(y)
            elif len(y):
                small.append((i, y))
            else:
                lost += 1
        if lost:
            logging.getLogger(__name__).warning("%d benchmark items have no letter or digit and can't be matched", lost)
        short: dict[int, dict[bytes, list[int]]] = {}
        for j, (_, y) in enumerate(small, len(items)):
            short.setdefault(len(y), {}).setdefault(y.tobytes(), []).append(j)
        size = np.array([len(y) for y in items], np.int64)
        edits = (error * size).astype(np.int64)
        grain = np.minimum(q, size // (1 + edits))
        indexes = [Index(int(g), [items[j] for j in at], at, edits[at]) for g in np.unique(grain).tolist() if len(at := np.flatnonzero(grain == g))]
        return cls(ids + [i for i, _ in small], indexes, short)

    def whole(self, y: np.ndarray, off: np.ndarray):
        """Where items under q characters stand on their own, as ``matches``."""
        if not self.short:
            return
        edge = np.ones(len(y) + 1, bool)  # between the characters before and at a position no word goes on
        edge[1:-1] = (y[:-1] == 32) | (y[1:] == 32)
        edge[off] = True
        for n, items in self.short.items():
            at = np.flatnonzero(edge[: max(0, len(y) - n + 1)] & edge[n:])
            known = np.unique(np.concatenate([grams(np.frombuffer(b, y.dtype), n) for b in items]))
            h = grams(y, n)[at]
            at = at[known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h]
            doc = np.searchsorted(off, at, side="right") - 1
            last: dict[int, tuple[int, int]] = {}
            for d, a in zip(doc[at + n <= off[doc + 1]].tolist(), at[at + n <= off[doc + 1]].tolist()):
                for i in items.get(y[a : a + n].tobytes(), ()):
                    if last.get(i, (-1, 0))[0] != d or last[i][1] <= a:
                        last[i] = d, a + n
                        yield d, i, a, a + n, 0

    def matches(self, y: np.ndarray, off: np.ndarray):
        """``(document, item, start, end, edits)`` of each leak, as positions in ``y``."""
        yield from self.whole(y, off)
        for index in self.indexes:
            yield from index.matches(y, off)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """A row for each region of a document that holds an item: ``(doc_id, item_id, start, end, edits)``.

    ``start`` and ``end`` are character offsets in the document's text. Null and empty texts and items match
    nothing; repeated rows are each reported; equal items are each reported. Ties between alignments go to the one
    that ends first. Only the named columns are read. The benchmark reaches the executors in passes of
    ``PASS_CHARS`` characters, so what is broadcast doesn't grow with it. There is no shuffle.
    """
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.where(F.length(item_text) > 0).select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t"))
    passes = max(1, -(-int(items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // PASS_CHARS))
    schema = "doc_id long, item_id long, start long, end long, edits int"
    names = ["doc_id", "item_id", "start", "end", "edits"]
    out = None
    for k in range(passes):
        part = items.where(F.pmod(F.xxhash64("i", "t"), F.lit(passes)) == k)
        shared = spark.sparkContext.broadcast(Bench.of(sorted(map(tuple, part.collect()), key=lambda r: (r[0] is not None, r))))

        def work(batch: pa.RecordBatch, shared=shared):
            bench = shared.value
            data, off = utf8(batch.column(1))
            ids = batch.column(0)
            rows = []
            for lo, hi in chunks(off):
                cps, coff = codepoints(data, off[lo : hi + 1])
                y, at, yoff = normal(cps, coff)
                for d, i, a, b, e in bench.matches(y, yoff):
                    rows.append((ids[lo + d].as_py(), bench.ids[i], int(at[a] - coff[d]), int(at[b - 1] + 1 - coff[d]), e))
            yield {n: [r[j] for r in rows] for j, n in enumerate(names)}

        found = docs.select(F.col(id_col).cast("long"), text_col).mapInArrow(over(schema, work), schema)
        out = found if out is None else out.unionByName(found)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns; rows with null text stay. No shuffle."""
    spark = docs.sparkSession
    prepare(spark)
    items = benchmark.where(F.length(item_text) > 0).select(F.col(item_text).alias("t")).distinct()
    passes = max(1, -(-int(items.agg(F.coalesce(F.sum(F.length("t")), F.lit(0))).first()[0]) // PASS_CHARS))
    for k in range(passes):
        rows = items.where(F.pmod(F.xxhash64("t"), F.lit(passes)) == k).collect()
        shared = spark.sparkContext.broadcast(Bench.of(sorted((None, r.t) for r in rows)))

        @task
        def work(batches, shared=shared):
            bench = shared.value
            for batch in batches:
                data, off = utf8(batch.column(batch.schema.get_field_index(text_col)))
                bad = np.zeros(len(off) - 1, bool)
                for lo, hi in chunks(off):
                    cps, coff = codepoints(data, off[lo : hi + 1])
                    y, _, yoff = normal(cps, coff)
                    for d, *_ in bench.matches(y, yoff):
                        bad[lo + d] = True
                yield batch.filter(pa.array(~bad))

        docs = docs.mapInArrow(work, docs.schema)
    return docs
