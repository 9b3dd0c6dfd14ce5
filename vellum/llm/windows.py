"""Windows of a fixed number of bytes or words, gathered into runs that share an anchor.

Every window of ``width`` units holds ``width - gram + 1`` grams of ``gram`` units; its anchor is the leftmost of those
with the least hash. Equal windows have equal anchors at equal places, so windows can only be equal to windows of
the same anchor hash: consecutive windows of one text with the same anchor are one run, and what has to be
compared is about one run for every half window rather than one window for every unit.

A run is ``(h, c)``: the anchor's hash, and a hash of all the units its windows cover together with the place of the
anchor. Runs equal in both are taken as equal (128 bits).
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import BYTE_KEYS, U64, Spans, chunks, column, group_slices, mix, pack_arrays, partition_keys, partitions, rolling, sliding_argmin, stage, task, unpack_arrays, utf8, words

ROW = "kind int, h long, c long, k long, t long, pos int, m int, times long, entries long"
#: Bytes of text whose runs are sorted at once.
PORTION = 16 << 20
#: Runs of one portion that must share an anchor hash before it is spread over all reducers.
FREQUENT = 64
MARKED, OPEN, SPREAD = 0, 1, 2
NULL_ID = (1 << 63) - 1  # null ids come after all others


@dataclass(frozen=True)
class Unit:
    """What a window is made of."""

    name: str
    width: int
    gram: int

    def values(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A 64-bit value for each unit of consecutive texts, and the offset of each text in units."""
        body = data[off[0] : off[-1]]
        if self.name == "byte":
            return BYTE_KEYS[body], off - off[0]
        starts, ends, before = words(data, off)
        return Spans(BYTE_KEYS[body])(starts - off[0], ends - off[0]), before

    def place(self, v: np.ndarray) -> int:
        """Where the anchor of the first window stands."""
        return int(sliding_argmin(mix(rolling(v[: self.width], self.gram)), self.width - self.gram + 1)[0])

    def places(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each window of one text: hash of the anchor, and where it stands in the text."""
        g = mix(rolling(v, self.gram))
        at = sliding_argmin(g, self.width - self.gram + 1)
        return g[at], at

    def runs(self, v: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, ...]:
        """Of each run: hash of the anchor, hash of the run, text, first window, windows."""
        none = (np.zeros(0, U64), np.zeros(0, U64), *(np.zeros(0, np.int64),) * 3)
        if len(v) < self.width:
            return none
        g = mix(rolling(v, self.gram))
        at = sliding_argmin(g, self.width - self.gram + 1)
        doc = np.repeat(np.arange(len(off) - 1), np.diff(off))[: len(at)]
        valid = np.arange(len(at)) + self.width <= off[doc + 1]
        new = valid.copy()
        new[1:] &= ~valid[:-1] | (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new)
        if not len(first):
            return none
        # a run ends where the next begins or where windows stop being valid
        end = np.append(first[1:], len(at))
        lasts = np.cumsum(valid)
        m = lasts[end - 1] - lasts[first] + 1
        covered = Spans(v)(first, first + m - 1 + self.width)
        c = mix(covered + (at[first] - first).astype(U64) * U64(0x9E3779B97F4A7C15))
        return g[at[first]], c, doc[first], first - off[doc[first]], m


BYTES = Unit("byte", 200, 32)
WORDS = Unit("word", 13, 4)


def keyed(docs: DataFrame, id_col: str, text_col: str, rest: bool = False) -> DataFrame:
    """``(k, t, x)``: an id that is never null, 64 bits of hash that tell rows of one id apart, the text; with ``rest`` also the row."""
    x = F.coalesce(column(text_col).cast("string"), F.lit(""))
    others = [column(c) for c in docs.columns if c != text_col]
    extra = [F.struct(column(text_col).isNull().alias("missing"), F.struct(*others).alias("row")).alias("rest")] if rest else []
    return docs.select(F.coalesce(column(id_col).cast("long"), F.lit(NULL_ID)).alias("k"), x.alias("x"), *extra).withColumn("t", F.xxhash64("x")).select("k", "t", "x", *["rest"] * rest)


def shared_runs(rows: DataFrame, unit: Unit, across: bool, name: str) -> DataFrame:
    """What the runs alone decide, written to the shared folder; rows of three kinds.

    ``MARKED``: runs all of whose windows are repeats; with ``across`` those whose equal starts in a smaller id, with where it
    does, ``(h, c, times)`` being its k, t and pos; else all that have an equal. ``OPEN``: of anchor hashes with several distinct runs, one of each (``across``: those in the
    run's smallest id), with the ``times`` it occurs and the ``entries`` of the hash; their windows are still to be
    compared. ``SPREAD``: runs of anchor hashes that are frequent in some batch.

    A map task packs its runs by hash into one blob for each reducer. Frequent ones go to any reducer instead, and one
    run tells the reducer of the hash; so no reducer gets more than ``FREQUENT`` runs of a hash from a batch.
    """
    n = partitions(rows.sparkSession)
    keys = partition_keys(n)
    many = FREQUENT

    @task
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, all_off = utf8(batch.column(2))
            for begin, end in chunks(all_off, PORTION):
                yield from portion(batch.column(0).to_numpy()[begin:end], batch.column(1).to_numpy()[begin:end], data, all_off[begin : end + 1])

    def portion(k: np.ndarray, t: np.ndarray, data: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        got = []
        for lo, hi in chunks(off):
            h, c, doc, pos, m = unit.runs(*unit.values(data, off[lo : hi + 1]))
            got.append((h, c, doc + lo, pos, m))
        if not got:
            return
        h, c, doc, pos, m = map(np.concatenate, zip(*got))
        order = np.argsort(h, kind="stable")
        h, c, doc, pos, m = h[order], c[order], doc[order], pos[order], m[order]
        starts, ends = group_slices(h)
        often = ends - starts >= many
        # 0: to be found out, 1: spread, 2: tells the reducer of the hash
        flag = np.repeat(often, ends - starts).astype(np.uint8)
        signal = starts[often]
        goes = np.concatenate([np.where(flag == 1, mix(doc.astype(U64)) % U64(n), h % U64(n)), h[signal] % U64(n)]).astype(np.int64)
        h, c, doc, pos, m = (np.concatenate([x, x[signal]]) for x in (h, c, doc, pos, m))
        flag = np.concatenate([flag, np.full(len(signal), 2, np.uint8)])
        order = np.argsort(goes, kind="stable")
        cuts = np.searchsorted(goes[order], np.arange(n + 1))
        out: dict[str, list] = {"to": [], "blob": []}
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b] : cuts[b + 1]]
            used, local = np.unique(doc[at], return_inverse=True)
            out["to"].append(int(keys[b]))
            out["blob"].append(pack_arrays(np.diff(h[at], prepend=U64(0)), c[at], local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), pos[at].astype(np.uint32), m[at].astype(np.uint8), flag[at], np.diff(k[used], prepend=0), t[used]))
        yield pa.RecordBatch.from_pydict({"to": pa.array(out["to"], pa.int32()), "blob": pa.array(out["blob"], pa.binary())})

    @task
    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = []
        for batch in batches:
            for blob in batch.column(1):
                h, c, local, pos, m, flag, k, t = unpack_arrays(blob.as_py())
                k = np.cumsum(k)
                parts.append((np.cumsum(h, dtype=U64), c, k[local], t[local], pos, m, flag))
        if not parts:
            return
        h, c, k, t, pos, m, flag = (np.concatenate(x) for x in zip(*parts))
        del parts
        kind = np.full(len(h), -1, np.int8)
        kind[flag == 1] = SPREAD
        times, entries, source = np.zeros(len(h), np.int64), np.zeros(len(h), np.int64), np.zeros((2, len(h)), np.int64)
        rest = np.flatnonzero(flag != 1)
        rest = rest[np.lexsort((k[rest], c[rest], h[rest]))]
        hs, cs, ks = h[rest], c[rest], k[rest]
        starts, ends = group_slices(hs)
        if len(starts):
            size = ends - starts
            told = np.repeat(np.maximum.reduceat(flag[rest], starts) == 2, size)
            new = np.ones(len(rest), bool)
            new[1:] = (hs[1:] != hs[:-1]) | (cs[1:] != cs[:-1])
            first = np.flatnonzero(new)
            count = np.diff(np.append(first, len(rest)))
            several = np.repeat(np.add.reduceat(new.astype(np.int64), starts), size)
            equal = np.repeat(count, count)
            least = np.repeat(ks[first], count)
            if across:
                mark, open_ = ks > least, (ks == least) & (several > 1)
                source[0, rest], source[1, rest], equal = least, np.repeat(t[rest][first], count), np.where(mark, np.repeat(pos[rest][first].astype(np.int64), count), equal)
            else:
                mark, open_ = equal > 1, new & (several > 1)
            own = ~told & (flag[rest] == 0)
            kind[rest[told & (flag[rest] == 0)]] = SPREAD
            kind[rest[own & mark]] = MARKED
            both = rest[own & open_]
            times[rest], entries[rest] = equal, several
        else:
            both = rest
        at = np.concatenate([np.flatnonzero(kind >= 0), both])
        what = np.concatenate([kind[kind >= 0], np.full(len(both), OPEN, np.int8)])
        order = np.argsort(what, kind="stable")
        at, what = at[order], what[order]
        for lo in range(0, len(at), 50_000):
            p, w = at[lo : lo + 50_000], what[lo : lo + 50_000].astype(np.int32)
            shown = w != MARKED
            cols = {"kind": w, "h": np.where(shown, h[p].view(np.int64), source[0, p]), "c": np.where(shown, c[p].view(np.int64), source[1, p]), "k": k[p], "t": t[p], "pos": pos[p].astype(np.int32), "m": m[p].astype(np.int32), "times": np.where(w == SPREAD, 0, times[p]), "entries": np.where(w == OPEN, entries[p], 0)}
            yield pa.RecordBatch.from_pydict(cols)

    packed = rows.select("k", "t", "x").mapInArrow(cut, "to int, blob binary").repartition(n, "to")
    return stage(packed.mapInArrow(find, ROW), name)


def stretches(first: np.ndarray, count: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal stretches that runs of ``count`` windows from ``first`` cover."""
    if not len(first):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(first, kind="stable")
    first = first[order].astype(np.int64)
    end = np.maximum.accumulate(first + count[order] - 1 + width)
    cut = np.flatnonzero(first[1:] > end[:-1]) + 1
    return first[np.concatenate([[0], cut])], end[np.concatenate([cut - 1, [len(first) - 1]])]


def covered_rows(rows: DataFrame, marks: DataFrame, unit: Unit, schema: str, finish: Callable) -> DataFrame:
    """Each row of ``rows`` with the stretches its marked windows cover, handed to ``finish`` as a batch.

    ``marks`` has ``(k, t, pos, n)``: windows pos .. pos + n - 1. A row's marks are bounded by its text.
    """
    rest = ["rest"] * ("rest" in rows.columns)
    lists = marks.groupBy("k", "t").agg(F.collect_list(F.struct("pos", "n")).alias("marks"))
    joined = rows.join(lists.hint("shuffle_hash"), ["k", "t"], "left").select("k", "x", "marks.pos", "marks.n", *rest)

    @task
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.int64)
        for batch in batches:
            data, off = utf8(batch.column(1))
            got = [stretches(p.values.to_numpy(), n.values.to_numpy(), unit.width) if p.is_valid else (none, none) for p, n in zip(batch.column(2), batch.column(3))]
            yield from finish(batch, data, off, got)

    return joined.mapInArrow(work, schema)


def own_id(k: pa.Array) -> pa.Array:
    """Ids as they were: the stand-in for null is null again."""
    return pc.if_else(pc.equal(k, NULL_ID), None, k)
