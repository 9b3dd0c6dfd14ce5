"""Exact substring dedup by an enhanced suffix array, sparse over the corpus: one suffix for each anchored run.

Strings of 200 bytes can only be equal where their anchors are (``windows``), so the suffixes that start at one
anchor hash form a bucket of the corpus's suffix array. Runs that are equal throughout are one entry with a count. A
bucket of several entries is sorted, its common-prefix lengths are scanned with a stack, and each interval of the
tree that this visits holds the entries that share ``right`` bytes from the anchor on. Inside an interval the bytes
before the anchor are sorted and scanned the same way: where these extensions to the left differ, the entries are
a maximal repeat of ``left + right`` bytes, and all its occurrences come out, not just neighbours.

To mark windows, a bucket of more than ``BUCKET`` distinct entries isn't gathered in one task: its strings are
counted by their hashes. ``repeat_groups`` scans the stretches that the marked windows cover, whole, in a second pass.
"""

from __future__ import annotations

import hashlib
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import Spans, fields, hot_join, mix, partitions, stage, task, utf8
from vellum.llm.windows import BYTES, MARKED, NULL_ID, OPEN, SPREAD, covered_rows, keyed, own_id, shared_runs

BUCKET = 2000
WIDTH = BYTES.width


def common(a: bytes, b: bytes) -> int:
    """Length of the longest common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


def intervals(lcp: list[int], n: int) -> Iterator[tuple[int, int, int]]:
    """The common-prefix intervals ``(depth, first, last)`` of a sorted array, children first; ``lcp[i]`` is between i and i + 1."""
    stack = [(0, 0)]
    for i in range(1, n + 1):
        depth = lcp[i - 1] if i < n else -1
        left = i - 1
        while stack and depth < stack[-1][0]:
            d, left = stack.pop()
            if left < i - 1:
                yield d, left, i - 1
        if depth >= 0 and (not stack or stack[-1][0] < depth):
            stack.append((depth, left))
    while stack:
        d, left = stack.pop()
        if left < n - 1:
            yield d, left, n - 1


def maximal_repeats(texts: list[tuple[bytes, int]], least: int = WIDTH, exact: bool = False) -> Iterator[tuple[int, int, list[int]]]:
    """``(left, right, members)`` of each maximal repeat around the anchors of ``(bytes, anchor)`` of ``least`` bytes at least.

    Members that share more than ``right`` bytes come out at their own depth too; with ``exact`` only there.
    """
    if len(texts) == 2:
        (x, a), (y, b) = texts
        right, left = common(x[a:], y[b:]), common(x[:a][::-1], y[:b][::-1])
        if left + right >= least:
            yield left, right, [0, 1]
        return
    rights = [x[a:] for x, a in texts]
    lefts = [x[:a][::-1] for x, a in texts]
    order = sorted(range(len(texts)), key=rights.__getitem__)
    lcp = [common(rights[i], rights[j]) for i, j in zip(order, order[1:])]
    longest = max(map(len, lefts))
    rank = dict(zip(order, range(len(order))))
    for right, first, last in intervals(lcp, len(order)):
        if right + longest < least:
            continue
        inside = sorted(order[first : last + 1], key=lefts.__getitem__)
        ext = [common(lefts[i], lefts[j]) for i, j in zip(inside, inside[1:])]
        for left, a, b in intervals(ext, len(inside)):
            if left + right >= least:
                members = inside[a : b + 1]
                if exact and left == 0 and min(ext) > 0:  # the root, whose members share more
                    continue
                if exact and len(members) < last - first + 1:
                    places = [rank[i] for i in members]
                    if min(lcp[min(places) : max(places)]) > right:
                        continue
                yield left, right, members


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rest: bool = False) -> tuple[DataFrame, DataFrame]:
    """Rows keyed; the windows that occur elsewhere ``(k, t, pos, n)``."""
    n = partitions(docs.sparkSession)
    rows = keyed(docs, id_col, text_col, rest).repartition(n, "k", "t")
    runs = shared_runs(keyed(docs, id_col, text_col), BYTES, False, "runs")
    equal = runs.where(F.col("kind") == MARKED).select("h", "c", "k", "t", "pos", F.col("m").alias("n"))
    several = runs.where(F.col("kind") == OPEN).select("h", "c", "times", "entries", "k", "t", "pos", "m")

    # anchors that are frequent somewhere: the same, with partial sums instead of one reducer
    spread = runs.where(F.col("kind") == SPREAD)
    entries = stage(spread.groupBy("h", "c").agg(F.count("*").alias("times"), F.min(F.struct("k", "t", "pos", "m")).alias("at")), "entries")
    equal = equal.unionByName(hot_join(spread.drop("times"), entries.where("times > 1").select("h", "c", "times"), ["h", "c"], "times").select("h", "c", "k", "t", "pos", F.col("m").alias("n")))
    entries = entries.join(entries.groupBy("h").agg(F.count("*").alias("entries")).where("entries > 1"), "h")
    several = several.unionByName(entries.select("h", "c", "times", "entries", "at.*"))

    names = ("h", "c", "times", "entries", "pos", "m")
    wanted = several.groupBy("k", "t").agg(F.collect_list(F.struct(*names)).alias("want"))
    # all columns of the rows are kept, so that one exchange serves here and for the result
    sought = rows.join(wanted.hint("shuffle_hash"), ["k", "t"]).select("k", "t", "x", *(f"want.{f}" for f in names), *["rest"] * rest)

    bucket_size = BUCKET

    def entries_of(batch: pa.RecordBatch, large: bool) -> Iterator[tuple[int, list[np.ndarray]]]:
        """Of each row that has entries of such buckets, its place and those entries, a column for each name."""
        for i in range(len(batch)):
            cols = [batch.column(j)[i].values.to_numpy() for j in range(3, 9)]
            pick = (cols[3] > bucket_size) == large
            if pick.any():
                yield i, [col[pick] for col in cols]

    @task
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            view, ks, ts = memoryview(data), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            rows_of = entries_of(batch, False)
            while part := list(itertools.islice(rows_of, 500)):
                out: dict[str, list] = {f: [] for f in ("k", "t", *names, "x")}
                for i, cols in part:
                    for f, col in zip(names, cols):
                        out[f].append(col)
                    out["k"].append(np.full(len(cols[0]), ks[i]))
                    out["t"].append(np.full(len(cols[0]), ts[i]))
                    out["x"] += [bytes(view[a : a + l]) for a, l in zip((off[i] + cols[4]).tolist(), (cols[5] - 1 + WIDTH).tolist())]
                yield pa.RecordBatch.from_pydict({f: np.concatenate(v) if f != "x" else pa.array(v, pa.binary()) for f, v in out.items()})

    def anchor(x: bytes) -> int:
        v = BYTES.values(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0]
        return BYTES.place(v)

    named = ("k", "t", "pos", "n")
    types = [pa.int64(), pa.int64(), pa.int32(), pa.int32()]
    schema = "k long, t long, pos int, n int"

    @task
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        bucket: list[tuple] = []
        last = None

        def close() -> None:
            texts = [(e[-1], anchor(e[-1])) for e in bucket]
            ranges: list[list[tuple[int, int, int]]] = [[] for _ in bucket]
            for g, (left, right, members) in enumerate(maximal_repeats(texts)):
                for i in members:
                    a, m = texts[i][1], bucket[i][5]
                    first, end = max(0, a - left), min(m - 1, a - max(0, WIDTH - right))
                    if first <= end:
                        ranges[i].append((first, end, g))
            for (_, times, k, t, pos, *_), got in zip(bucket, ranges):
                if times == 1:  # equal ones are marked already
                    out.extend((k, t, pos + first, end - first + 1) for first, end, _ in union(got))

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], list(named))

        for batch in batches:
            for h, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last:
                    if len(bucket) > 1:
                        close()
                    bucket, last = [], h
                bucket.append(tuple(entry))
            if len(out) > 20_000:
                yield made()
                out.clear()
        if len(bucket) > 1:
            close()
        yield made()

    found = sought.mapInArrow(contexts, "k long, t long, h long, c long, times long, entries long, pos int, m int, x binary")
    small = found.select("h", "c", "times", "k", "t", "pos", "m", "x").repartition(n, "h").sortWithinPartitions("h", "c").mapInArrow(scan, schema)

    # from the rows as well, not from what ``contexts`` returns: two passes in one task would be two Python workers a core
    @task
    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            ks, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            for i, cols in entries_of(batch, True):
                for h, c, times, _, pos, m in zip(*(col.tolist() for col in cols)):
                    a = off[i] + pos
                    v = BYTES.values(data[a : a + m - 1 + WIDTH], np.array([0, m - 1 + WIDTH]))[0]
                    j = np.arange(m)
                    full = {"h": np.full(m, h), "c": np.full(m, c), "times": np.full(m, times), "k": np.full(m, ks[i]), "t": np.full(m, ts[i])}
                    yield pa.RecordBatch.from_pydict(full | {"pos": (pos + j).astype(np.int32), "j": j.astype(np.int32), "e": mix(Spans(v)(j, j + WIDTH)).view(np.int64)})

    large = sought.mapInArrow(strings, "h long, c long, times long, k long, t long, pos int, j int, e long")
    often = large.groupBy("h", "e").agg(F.sum("times").alias("all")).where("all > 1")
    hot = large.join(often, ["h", "e"])
    single = hot.where("times = 1").select("k", "t", "pos", F.lit(1).alias("n"))
    return rows, equal.select("k", "t", "pos", "n").unionByName(small).unionByName(single)


def union(ranges: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Ranges merged where they overlap or touch."""
    out: list[tuple[int, int, int]] = []
    for first, end, g in sorted(ranges):
        if out and first <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(end, out[-1][1]), out[-1][2])
        else:
            out.append((first, end, g))
    return out


def pieces(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(k, at, u, x)``: the stretches of each row that its repeated windows cover, with a hash of their bytes."""
    rows, marks = repeats(docs, id_col, text_col)

    def finish(batch, data, off, spans):
        view, ks = memoryview(data), batch.column(0).to_numpy()
        for k, a, (starts, ends) in zip(ks, off[:-1].tolist(), spans):
            for lo in range(0, len(starts), 500):
                s, e = starts[lo : lo + 500].tolist(), ends[lo : lo + 500].tolist()
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), k)), pa.array(s, pa.int64()), pa.array([bytes(view[a + i : a + j]) for i, j in zip(s, e)], pa.binary())], ["k", "at", "x"])

    return covered_rows(rows, marks, BYTES, "k long, at long, x binary", finish).withColumn("u", F.sha2("x", 256))


def repeat_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every occurrence of every maximal repeat of 200 bytes at least: ``(bucket, repeat, doc_id, start, length)``.

    A repeat is named by ``(bucket, repeat)`` and is maximal: its occurrences don't all have the same byte before or the
    same byte after them. All of them lie inside the stretches that ``drop_repeats`` cuts out, and hold at the same
    place the anchor of the repeat's first window. So the suffixes of the distinct stretches at each anchor, with the
    bytes before it that can be in the same first window, are the bucket, and a repeat comes out of one bucket
    only. Buckets of any size are scanned whole, in one task each; a stretch's suffix is shuffled for each
    anchor in it, and the output is as large as all occurrences, nested repeats included.
    """
    n = partitions(docs.sparkSession)
    found = stage(pieces(docs, id_col, text_col), "stretches")
    distinct = found.groupBy("u").agg(F.count("*").alias("times"), F.first("x").alias("x"))

    @task
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for u, times, x in zip(*(c.to_pylist() for c in batch.columns)):
                at = BYTES.places(BYTES.values(np.frombuffer(x, np.uint8), np.array([0, len(x)]))[0])
                h, first = at[0], np.flatnonzero(np.diff(at[1], prepend=-1))
                last = np.append(first[1:], len(h)) - 1
                for lo in range(0, len(first), 500):
                    f, e = first[lo : lo + 500], last[lo : lo + 500]
                    a, begin = at[1][f], np.maximum(f - 1, 0)
                    yield pa.RecordBatch.from_pydict({"h": h[f].view(np.int64), "u": [u] * len(f), "times": np.full(len(f), times), "begin": begin, "a": a - begin, "low": a - e, "high": a - f, "x": pa.array([x[i:] for i in begin.tolist()], pa.binary())})

    entries = stage(distinct.mapInArrow(cut, "h long, u string, times long, begin long, a long, low long, high long, x binary"), "suffixes")
    shared = entries.groupBy("h").agg(F.sum("times").alias("c")).where("c > 1").select("h")
    buckets = entries.join(shared, "h").repartition(n, "h").sortWithinPartitions("h", "u", "begin")

    @task
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, bucket = None, []

        def close() -> Iterator[pa.RecordBatch]:
            # a stretch that occurs again stands twice, so that what only its copies share is an interval too
            owner = [i for i, e in enumerate(bucket) for _ in range(min(e[1], 2))]
            out, g = [], 0
            if len(owner) > 1:
                for left, right, members in maximal_repeats([(bucket[i][-1], bucket[i][3]) for i in owner], exact=True):
                    if bucket[owner[members[0]]][4] <= left <= bucket[owner[members[0]]][5]:
                        for i in sorted({owner[j] for j in members}):
                            u, _, begin, a, *_ = bucket[i]
                            out.append((last, g, u, begin + a - left, left + right))
                        g += 1
                    if len(out) > 20_000:
                        yield made(out)
                        out.clear()
            yield made(out)

        def made(out: list[tuple]) -> pa.RecordBatch:
            types = (pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64())
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], t) for i, t in enumerate(types)], ["h", "g", "u", "j", "length"])

        for batch in batches:
            for h, *entry in zip(*(c.to_pylist() for c in batch.columns)):
                if h != last:
                    if bucket:
                        yield from close()
                    bucket, last = [], h
                bucket.append(entry)
        if bucket:
            yield from close()

    groups = buckets.mapInArrow(scan, "h long, g int, u string, j long, length long")
    own = F.when(F.col("k") == NULL_ID, F.lit(None)).otherwise(F.col("k"))
    return groups.join(found.select("u", "k", "at"), "u").select(F.col("h").alias("bucket"), F.col("g").alias("repeat"), own.alias(id_col), (F.col("at") + F.col("j")).alias("start"), "length")


def cut_out(view: memoryview, starts: np.ndarray, ends: np.ndarray) -> bytes:
    cuts = [0, *np.stack([starts, ends], 1).ravel().tolist(), len(view)]
    return b"".join([view[x:y] for x, y in zip(cuts[::2], cuts[1::2])])


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256)`` of each row, with ``text`` also ``kept`` and ``spans``.

    A byte goes if a string of 200 bytes that covers it starts anywhere else too, in the same text or another; all
    occurrences lose it. Repeated rows are copies of each other. Null counts as empty; texts under 200 bytes
    lose nothing. ``kept`` leaves out pieces of a character that a span cut. Only the named columns are read.
    """
    rows, marks = repeats(docs, id_col, text_col)
    schema = f"{id_col} long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept string, spans array<struct<start:long,end:long>>" * text

    def finish(batch, data, off, spans):
        view = memoryview(data)
        out: list[list] = [[], [], [], [], [], []]
        for a, b, (starts, ends) in zip(off[:-1].tolist(), off[1:].tolist(), spans):
            kept = cut_out(view[a:b], starts, ends)
            row = (b - a, b - a - len(kept), len(starts), hashlib.sha256(kept).hexdigest())
            for o, v in zip(out, (*row, *((kept.decode("utf-8", "ignore"), [{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)]) if text else ()))):
                o.append(v)
        types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))]
        names = [id_col, "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept", "spans"]
        cols = [own_id(batch.column(0)), *(pa.array(o, t) for o, t in zip(out, types))][: 7 if text else 5]
        yield pa.RecordBatch.from_arrays(cols, names[: len(cols)])

    return covered_rows(rows, marks, BYTES, schema, finish)


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with the repeated strings cut out of the text, as ``drop_repeats`` finds them; all rows and columns stay.

    Null texts stay null; a text that is repeated throughout is empty afterwards.
    """
    rows, marks = repeats(docs, id_col, text_col, rest=True)
    schema = "kept string, " + fields(rows.select("rest").schema)

    def finish(batch, data, off, spans):
        view = memoryview(data)
        kept = [cut_out(view[a:b], s, e).decode("utf-8", "ignore") if len(s) else str(view[a:b], "utf-8", "replace") for a, b, (s, e) in zip(off[:-1].tolist(), off[1:].tolist(), spans)]
        yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()), batch.column(4)], ["kept", "rest"])

    out = covered_rows(rows, marks, BYTES, schema, finish)
    text = F.when(F.col("rest.missing"), F.lit(None)).otherwise(F.col("kept"))
    return out.select(*(text.alias(c) if c == text_col else F.col("rest.row").getField(c).alias(c) for c in docs.columns))
