"""Substring dedup on a de Bruijn graph of words: repeated nonbranching paths are compacted and verified at their source.

Edges are windows of 13 words, nodes their first and last 12 words. As in k-mer counters that scale, edges are
partitioned by a minimizer: consecutive edges of a text with one anchor (``windows``) travel as one path.

1. Where all occurrences of an anchor have the same path, it is nonbranching and stays whole: every later occurrence of
   it repeats the one in the smallest document, its source.
2. Where they differ, each path's occurrence in its smallest document is expanded to edges with their nodes. Spark
   groups the edges that several documents have, with the source of each, counts the edges into and out of each node,
   and joins edges end to start: two that meet in a node with one edge in and one out, and that follow each other in
   their source, are of one path. A path is named by its first edge.
3. Occurrences of edges are joined to their paths, and stretches of a document that follow one source at one distance
   are put together into spans, those of step 1 with those of step 2.
4. Spans are verified at their coordinates: the words at the source and at the occurrence must have one digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vellum.llm.shared import Spans, hot_join, mix, partitions, stage, task, texts_of, utf8
from vellum.llm.windows import MARKED, OPEN, SPREAD, WORDS, keyed, own_id, shared_runs, stretches


NODE = WORDS.width - 1
SPAN = "k long, t long, pos int, n int, sk long, st long, sp int"


def compacted(repeated: DataFrame) -> DataFrame:
    """``(e, path, at)`` of each repeated edge ``(e, u, v, src)``: the path it is on, named by its source and first edge, and its place there.

    An edge goes on the path of the one before it, where the node between has one edge in and one out and the two
    follow each other in the same source text; the edges of a source text are bounded by it.
    """
    into = repeated.groupBy(F.col("v").alias("node")).agg(F.count("*").alias("n_in"))
    out = repeated.groupBy(F.col("u").alias("node")).agg(F.count("*").alias("n_out"))
    single = into.join(out, "node").where("n_in = 1 AND n_out = 1").select("node")
    before = repeated.join(single, repeated.v == single.node).select("node", F.struct("src.k", "src.t", (F.col("src.pos") + 1).alias("pos")).alias("next"))
    linked = repeated.join(before, (repeated.u == before.node) & (F.col("src") == F.col("next")), "left").select("e", "src", F.col("node").isNull().alias("first"))
    w = Window.partitionBy("src.k", "src.t").orderBy("src.pos").rowsBetween(Window.unboundedPreceding, 0)
    start = F.max(F.when(F.col("first"), F.col("src.pos"))).over(w)
    return linked.select("e", "src", start.alias("path"))


def first_seen(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """The rows, keyed, and the spans of each that start in a document of smaller id, with their source: ``SPAN``."""
    n = partitions(docs.sparkSession)
    rows = keyed(docs, id_col, text_col).repartition(n, "k", "t")  # one exchange, used for edges, sources and the result
    runs = shared_runs(keyed(docs, id_col, text_col), WORDS, True, "runs")
    whole = runs.where(F.col("kind") == MARKED).select("k", "t", "pos", F.col("m").alias("n"), F.col("h").alias("sk"), F.col("c").alias("st"), F.col("times").cast("int").alias("sp"))
    branching = runs.where(F.col("kind") == OPEN).select("h", "k", "t", "pos", "m")

    # anchors that are frequent somewhere: the same, with partial sums instead of one reducer
    spread = runs.where(F.col("kind") == SPREAD).drop("times", "entries")
    paths = stage(spread.groupBy("h", "c").agg(F.min(F.struct("k", "t", "pos")).alias("src"), F.count("*").alias("times")), "paths")
    paths = paths.join(paths.groupBy("h").agg(F.count("*").alias("paths")), "h")
    known = hot_join(spread, paths, ["h", "c"], "times")
    whole = whole.unionByName(known.where("k > src.k").select("k", "t", "pos", F.col("m").alias("n"), F.col("src.k").alias("sk"), F.col("src.t").alias("st"), F.col("src.pos").alias("sp")))
    branching = branching.unionByName(known.where("k = src.k AND paths > 1").select("h", "k", "t", "pos", "m"))

    wanted = branching.groupBy("k", "t").agg(F.collect_list(F.struct("h", "pos", "m")).alias("want"))
    sought = rows.join(wanted.hint("shuffle_hash"), ["k", "t"]).select("k", "t", "x", "want.h", "want.pos", "want.m")

    @task
    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(2))
            ks, ts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            out: list[list[np.ndarray]] = [[], [], [], [], [], []]
            for i in range(len(ks)):
                v, _ = WORDS.values(data, off[i : i + 2])
                h, pos, m = (batch.column(j)[i].values.to_numpy() for j in range(3, 6))
                which = np.repeat(np.arange(len(h)), m)
                at = pos[which] + np.arange(len(which)) - np.repeat(np.cumsum(m) - m, m)
                hashed = Spans(v)
                edge = mix(hashed(at, at + WORDS.width) ^ h[which].view(np.uint64)).view(np.int64)
                u, w = hashed(at, at + NODE).view(np.int64), hashed(at + 1, at + 1 + NODE).view(np.int64)
                for a, x in zip(out, (edge, u, w, np.full(len(which), ks[i]), np.full(len(which), ts[i]), at.astype(np.int32))):
                    a.append(x)
            if out[0]:
                yield pa.RecordBatch.from_pydict(dict(zip(("e", "u", "v", "k", "t", "pos"), map(np.concatenate, out))))

    # what several documents have, of all that is open: the edges of the graph
    edges = stage(sought.mapInArrow(expand, "e long, u long, v long, k long, t long, pos int"), "edges")
    repeated = edges.groupBy("e").agg(F.min(F.struct("k", "t", "pos")).alias("src"), F.max("k").alias("last"), F.min("u").alias("u"), F.min("v").alias("v"), F.count("*").alias("times")).where("src.k < last").drop("last")
    repeated = stage(repeated, "repeated edges")
    placed = compacted(repeated.drop("times")).join(repeated.select("e", "times"), "e")
    later = hot_join(edges.select("e", "k", "t", "pos"), placed, ["e"], "times").where("k > src.k")
    # the edges of a path that one occurrence has, in one row
    later = later.groupBy("k", "t", F.col("src.k").alias("sk"), F.col("src.t").alias("st"), "path", (F.col("pos") - F.col("src.pos")).alias("shift")).agg(F.collect_list("pos").alias("at"))
    single = later.select("k", "t", "sk", "st", "shift", F.explode(together(F.array_sort("at"))).alias("r")).select("k", "t", F.col("r.first").alias("pos"), F.col("r.n").alias("n"), "sk", "st", (F.col("r.first") - F.col("shift")).alias("sp"))
    return rows, spans_of(whole.unionByName(single))


def together(at: Column) -> Column:
    """Ascending positions as runs ``(first, n)``."""
    start = F.array().cast("array<struct<first:int,n:int>>")

    def step(out: Column, p: Column) -> Column:
        last = F.element_at(out, -1)
        joins = (F.size(out) > 0) & (F.try_element_at(out, F.lit(-1))["first"] + F.try_element_at(out, F.lit(-1))["n"] == p)
        longer = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["first"].alias("first"), (last["n"] + 1).alias("n"))))
        return F.when(joins, longer).otherwise(F.concat(out, F.array(F.struct(p.alias("first"), F.lit(1).alias("n")))))

    return F.aggregate(at, start, step)


def spans_of(marks: DataFrame) -> DataFrame:
    """Marks of one text that follow one source text at one distance, put together where they touch; a text's marks are bounded by it."""
    marks = marks.groupBy("k", "t", "sk", "st", (F.col("pos") - F.col("sp")).alias("shift")).agg(F.collect_list(F.struct("pos", "n")).alias("m"))

    @task
    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [batch.column(i).to_numpy() for i in range(5)]
            got = [stretches(p.values.to_numpy(), n.values.to_numpy(), 1) for p, n in zip(batch.column(5), batch.column(6))]
            count = [len(s) for s, _ in got]
            if sum(count):
                k, t, sk, st, shift = (np.repeat(x, count) for x in ids)
                first, end = (np.concatenate(x) for x in zip(*got))
                yield pa.RecordBatch.from_pydict({"k": k, "t": t, "pos": first.astype(np.int32), "n": (end - first).astype(np.int32), "sk": sk, "st": st, "sp": (first - shift).astype(np.int32)})

    return stage(marks.select("k", "t", "sk", "st", "shift", "m.pos", "m.n").mapInArrow(merge, SPAN), "spans")


def digest(ws: list[bytes], first: int, n: int) -> bytes:
    """Of the words that ``n`` windows from ``first`` on cover."""
    return hashlib.md5(b" ".join(ws[first : first + n + NODE])).digest()


def sources(rows: DataFrame, spans: DataFrame) -> DataFrame:
    """``(sk, st, sp, n, d)``: the digests of the words at the sources of the spans, each source once."""
    wanted = spans.select("sk", "st", "sp", "n").distinct().groupBy(F.col("sk").alias("k"), F.col("st").alias("t")).agg(F.collect_list(F.struct("sp", "n")).alias("want"))
    sought = rows.join(wanted.hint("shuffle_hash"), ["k", "t"]).select("k", "t", "x", "want.sp", "want.n")

    @task
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, t, x, sp, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts_of(batch.column(2)), batch.column(3), batch.column(4)):
                ws, sp, n = x.split(), sp.values.to_numpy(), n.values.to_numpy()
                yield pa.RecordBatch.from_pydict({"sk": np.full(len(sp), k), "st": np.full(len(sp), t), "sp": sp, "n": n, "d": pa.array([digest(ws, *s) for s in zip(sp.tolist(), n.tolist())], pa.binary())})

    return sought.mapInArrow(read, "sk long, st long, sp int, n int, d binary")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", text: bool = False) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256)`` of each row, with ``text`` also the kept words and removed spans.

    A word goes if a window of 13 words that covers it starts in a document with a smaller id too. Null and empty
    texts have no words; texts under 13 words lose none. Rows of one id don't remove each other's words, repeated
    rows included; a null id counts as larger than all ids. Only the named columns are read.
    """
    rows, spans = first_seen(docs, id_col, text_col)
    shown = spans.join(sources(rows, spans), ["sk", "st", "sp", "n"])
    lists = shown.groupBy("k", "t").agg(F.collect_list(F.struct("pos", "n", "d")).alias("s"))
    joined = rows.join(lists.hint("shuffle_hash"), ["k", "t"], "left").select("k", "x", "s.pos", "s.n", "s.d")
    schema = f"{id_col} long, n_words long, n_removed long, kept_sha256 string" + ", kept string, spans array<struct<start:long,end:long>>" * text

    @task
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield finish(batch)

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: dict[str, list] = {"n": [], "r": [], "s": [], "k": [], "p": []}
        for x, pos, n, d in zip(texts_of(batch.column(1)), *batch.columns[2:]):
            ws = x.split()
            out["n"].append(len(ws))
            starts = ends = np.zeros(0, np.int64)
            if pos.is_valid:
                pos, n = pos.values.to_numpy(), n.values.to_numpy()
                same = np.array([digest(ws, *s) == want for s, want in zip(zip(pos.tolist(), n.tolist()), d.values.to_pylist())])
                starts, ends = stretches(pos[same], n[same], WORDS.width)  # what only hashes alike isn't a repeat
            for s, e in zip(starts[::-1].tolist(), ends[::-1].tolist()):
                del ws[s:e]
            kept = b" ".join(ws)
            out["r"].append(out["n"][-1] - len(ws))
            out["s"].append(hashlib.sha256(kept).hexdigest())
            if text:
                out["k"].append(kept.decode("utf-8", "replace"))
                out["p"].append([{"start": int(s), "end": int(e)} for s, e in zip(starts, ends)])
        cols = [own_id(batch.column(0)), pa.array(out["n"], pa.int64()), pa.array(out["r"], pa.int64()), pa.array(out["s"], pa.string())]
        names = [id_col, "n_words", "n_removed", "kept_sha256"]
        if text:
            cols += [pa.array(out["k"], pa.string()), pa.array(out["p"], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))]
            names += ["kept", "spans"]
        return pa.RecordBatch.from_arrays(cols, names)

    return joined.mapInArrow(work, schema)
