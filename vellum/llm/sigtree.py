"""Exact n-gram Jaccard join by signature trees.

A document's set is its distinct word shingles. Documents of equal sets are one class. Two classes link when
``100 * intersection >= threshold * union``.

1. Shingles are packed by hash to the reducers, which find those of more than one class and their number of classes.
   A shingle that is frequent within a batch already is spread over all reducers, and only its count goes to the
   reducer of its hash.
2. A class can only link if the threshold's share of its set is shared at all. Of such a class only its shared
   shingles and its size matter to any overlap, so classes alike in both are one item; the members of an item link
   among each other or not at all, as its sizes say.
3. Items only link that have one of their rarest shingles in common: the first ``n - ceil(t n) + 1`` in order
   of frequency. Items that have such a shingle in common are put together (connected components), which loses no link.
4. Each such group is cut by size into levels, whose sizes differ by the threshold's ratio at most, so links run
   within a level or to the next, and levels into blocks of about ``BLOCK`` items: by the place of the least
   shingle, and a place that holds more of them by a hash of the item. Pairs of blocks that have one of the rarest shingles in common
   are a task each: a tree is built over either, its nodes hold OR- and AND-combined bitmaps of shingles and size
   ranges. A dual traversal drops a pair of nodes when the largest overlap that bitmaps and sizes allow is below
   the smallest one a link needs; pairs of leaves are verified on the whole sets.

Counts of links are weighted with the classes' documents, so copies aren't expanded into pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from vellum.llm.components import components
from vellum.llm.shared import BYTE_KEYS, LOWER, U64, Spans, chunks, group_slices, mix, pack_arrays, partition_keys, partitions, rolling, stage, task, unpack_arrays, utf8, words

SHINGLE = 3
BITS = 1024
FANOUT = 8
BLOCK = 512
#: Bytes of text whose shingles are sorted at once.
PORTION = 4 << 20
#: Parts in which a reducer sorts its shingles.
SLICES = 4
#: Classes of one portion that must have a shingle before it is spread over the reducers.
FREQUENT = 32
#: Counts of spread shingles up to this many rows are broadcast, 12 bytes each.
BROADCAST_ROWS = 1_000_000


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of consecutive texts, sorted within each, and the offset of each text's."""
    body = LOWER[data[off[0] : off[-1]]]
    starts, ends, before = words(data, off)
    w = Spans(BYTE_KEYS[body])(starts - off[0], ends - off[0])
    n = np.diff(before)
    doc = np.repeat(np.arange(len(n)), n)
    s = mix(rolling(w, size))
    keep = np.arange(len(s)) + size <= before[1:][doc[: len(s)]]
    s, owner = s[keep], doc[: len(s)][keep]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):  # the whole sequence as one
        whole = np.array([int(mix(Spans(w[before[d] : before[d + 1]])(np.array([0]), n[d : d + 1]) + U64(size))[0]) for d in few], U64)
        s, owner = np.concatenate([s, whole]), np.concatenate([owner, few])
    order = np.lexsort((s, owner))
    s, owner = s[order], owner[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]) | (owner[1:] != owner[:-1])
    s, owner = s[new], owner[new]
    return s, np.searchsorted(owner, np.arange(len(n) + 1))


def class_hashes(s: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The class of each text, from the shingles and offsets of ``shingle_sets``."""
    total = np.concatenate([[U64(0)], np.cumsum(mix(s ^ U64(0xA5A5A5A5A5A5A5A5)), dtype=U64)])
    return mix((total[at[1:]] - total[at[:-1]]) + np.diff(at).astype(U64) * U64(0x9E3779B97F4A7C15))


def needed(n: int, threshold: int) -> int:
    """The least overlap with any set that links to one of size n."""
    return -(-threshold * n // 100)


class Node:
    """Bitmaps and size ranges over a run of the sorted classes; children, or the classes themselves."""

    __slots__ = ("union", "meet", "low", "high", "most", "parts", "leaf")

    def __init__(self, parts: list, leaf: bool):
        self.parts, self.leaf = parts, leaf
        self.union, self.meet = 0, (1 << BITS) - 1
        for p in parts:
            self.union |= p.union
            self.meet &= p.meet
        self.low, self.high, self.most = min(p.low for p in parts), max(p.high for p in parts), max(p.most for p in parts)


class Item:
    """One class: its shared shingles and the bitmap of them."""

    __slots__ = ("cls", "low", "high", "most", "weight", "tokens", "union", "meet")

    def __init__(self, cls: int, n: int, weight: int, tokens: np.ndarray):
        self.cls, self.low, self.high, self.weight = cls, n, n, weight
        self.tokens, self.most = frozenset(tokens.tolist()), len(tokens)
        flags = np.zeros(BITS, np.uint8)
        flags[(tokens >> U64(64 - BITS.bit_length() + 1)).astype(np.int64)] = 1
        self.union = self.meet = int.from_bytes(np.packbits(flags).tobytes(), "big")


def tree(items: list[Item]) -> Node:
    """Bottom-up, over items in order of their least shingle, so that similar ones share nodes."""
    level: list = sorted(items, key=lambda i: (min(i.tokens, default=0), i.low, i.cls))
    leaf = True
    while leaf or len(level) > 1:
        level = [Node(level[i : i + FANOUT], leaf) for i in range(0, len(level), FANOUT)]
        leaf = False
    return level[0]


def possible(x: Node | Item, y: Node | Item, threshold: int) -> bool:
    """Whether some class of x may link to some class of y."""
    if 100 * x.high < threshold * y.low or 100 * y.high < threshold * x.low:
        return False
    need = -(-threshold * (x.low + y.low) // (100 + threshold))
    if min(x.most, y.most) < need:
        return False
    # every bit that all of one side have and none of the other has is a shingle that isn't common
    return x.most - (x.meet & ~y.union).bit_count() >= need and y.most - (y.meet & ~x.union).bit_count() >= need


def links(x: Node, y: Node, threshold: int, same: bool) -> Iterator[tuple[Item, Item]]:
    """All linked pairs between two trees, or within one; each pair once."""
    stack = [(x, y)]
    while stack:
        a, b = stack.pop()
        if not possible(a, b, threshold):
            continue
        if a.leaf and b.leaf:
            for i, p in enumerate(a.parts):
                for q in b.parts[i + 1 :] if same and a is b else b.parts:
                    if possible(p, q, threshold):
                        common = len(p.tokens & q.tokens)
                        if 100 * common >= threshold * (p.low + q.low - common):
                            yield p, q
        elif same and a is b:
            stack += [(p, q) for i, p in enumerate(a.parts) for q in a.parts[i:]]
        elif b.leaf or (not a.leaf and len(a.parts) >= len(b.parts)):
            stack += [(p, b) for p in a.parts]
        else:
            stack += [(a, q) for q in b.parts]


FOUND = "kind int, k long, cls long, n long, to int, blob binary"


def classes_and_candidates(docs: DataFrame, threshold: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """``(k, cls, n)`` of each row, and ``(cls, n, tokens, first, place)`` of each class that may link."""
    parts = partitions(docs.sparkSession)
    keys = partition_keys(parts)
    many = FREQUENT

    @task
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(1))
            for lo, hi in chunks(off, PORTION):
                yield from portion(batch.column(0).slice(lo, hi - lo), data, off[lo : hi + 1])

    def portion(ids: pa.Array, data: np.ndarray, off: np.ndarray) -> Iterator[pa.RecordBatch]:
        toks, sizes, cls = [], [], []
        for lo, hi in chunks(off):
            s, at = shingle_sets(data, off[lo : hi + 1])
            cls.append(class_hashes(s, at))
            sizes.append(np.diff(at))
            toks.append(s)
        toks, sizes, cls = np.concatenate(toks), np.concatenate(sizes), np.concatenate(cls)
        size = len(cls)
        yield pa.RecordBatch.from_pydict({"kind": pa.array(np.zeros(size, np.int32)), "k": ids, "cls": cls.view(np.int64), "n": sizes, "to": pa.array(keys[np.arange(size) % parts], pa.int32()), "blob": pa.nulls(size, pa.binary())})
        first = np.zeros(size, bool)  # one document speaks for its copies in the portion
        first[np.unique(cls, return_index=True)[1]] = True
        owner = np.repeat(np.arange(size, dtype=np.int32), sizes)
        pick = first[owner]
        toks, owner = toks[pick], owner[pick]
        order = np.argsort(toks, kind="stable")
        toks, owner = toks[order], owner[order]
        starts, ends = group_slices(toks)
        count = ends - starts
        often = np.repeat(count >= many, count)
        signal = starts[count >= many]
        # 0: to be counted, 1: spread, 2: counts of spread shingles
        flag = np.concatenate([often.astype(np.uint8), np.full(len(signal), 2, np.uint8)])
        goes = (np.concatenate([np.where(often, cls[owner], toks), toks[signal]]) % U64(parts)).astype(np.int32)
        number = np.concatenate([owner, np.zeros(len(signal), np.int32)])
        extra = np.zeros(len(flag), np.uint32)
        extra[len(toks) :] = count[count >= many]
        toks = np.concatenate([toks, toks[signal]])
        order = np.argsort(goes, kind="stable")
        cuts = np.searchsorted(goes[order], np.arange(parts + 1))
        to, blob = [], []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b] : cuts[b + 1]]
            used, local = np.unique(number[at], return_inverse=True)
            to.append(int(keys[b]))
            blob.append(pack_arrays(np.diff(toks[at], prepend=U64(0)), local.astype(np.uint16 if len(used) < 1 << 16 else np.uint32), flag[at], extra[at], cls[used], sizes[used].astype(np.uint32)))
            if len(to) == 64:
                yield rows(2, to, blob)
                to, blob = [], []
        if to:
            yield rows(2, to, blob)

    def rows(kind: int, to: list[int], blob: list[bytes]) -> pa.RecordBatch:
        n, none = len(to), lambda: pa.nulls(len(to), pa.int64())
        return pa.RecordBatch.from_pydict({"kind": pa.array(np.full(n, kind, np.int32)), "k": none(), "cls": none(), "n": none(), "to": pa.array(to, pa.int32()), "blob": pa.array(blob, pa.binary())})

    @task
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blobs: list[bytes] = []
        for batch in batches:
            kinds = batch.column(0).to_numpy()
            if (kinds == 0).any():
                yield batch.filter(pa.array(kinds == 0))
            blobs += [batch.column(5)[int(i)].as_py() for i in np.flatnonzero(kinds == 2)]
            del batch
        if not blobs:
            return
        out = []
        for part in range(SLICES):  # by the shingles' highest bits, so that one part is unpacked and sorted at a time
            got = []
            for blob in blobs:
                t, local, flag, extra, cls, n = unpack_arrays(blob)
                t = np.cumsum(t, dtype=U64)
                at = np.flatnonzero((t >> U64(56)).astype(np.int64) * SLICES >> 8 == part)
                got.append((t[at], cls[local[at]], n[local[at]], flag[at], extra[at]))
            t, cls, n, flag, extra = (np.concatenate(x) for x in zip(*got))
            got.clear()
            # spread shingles pass through with frequency 0, to be looked up
            out.append((t[flag == 1], cls[flag == 1], n[flag == 1], np.zeros(int((flag == 1).sum()), np.uint32)))
            signals = flag == 2
            st, sc = np.unique(t[signals]), None
            if len(st):
                sc = np.bincount(np.searchsorted(st, t[signals]), extra[signals], len(st)).astype(np.int64)
            rest = np.flatnonzero(flag == 0)
            order = rest[np.lexsort((cls[rest], t[rest]))]
            t, cls, n = t[order], cls[order], n[order]
            new = np.ones(len(t), bool)
            new[1:] = (t[1:] != t[:-1]) | (cls[1:] != cls[:-1])
            t, cls, n = t[new], cls[new], n[new]
            starts, ends = group_slices(t)
            df = ends - starts
            spread = np.zeros(len(starts), bool)
            if len(st):
                at = np.minimum(np.searchsorted(st, t[starts]), len(st) - 1)
                spread = st[at] == t[starts]
                np.add.at(sc, at[spread], df[spread])
                yield pa.RecordBatch.from_pydict({"kind": pa.array(np.full(len(st), 1, np.int32)), "k": st.view(np.int64), "cls": pa.nulls(len(st), pa.int64()), "n": sc, "to": pa.nulls(len(st), pa.int32()), "blob": pa.nulls(len(st), pa.binary())})
            keep = np.repeat((df > 1) | spread, df)
            freq = np.repeat(np.where(spread, 0, df), df).astype(np.uint32)
            out.append((t[keep], cls[keep], n[keep], freq[keep]))
        blobs.clear()
        t, cls, n, freq = (np.concatenate(x) for x in zip(*out))
        goes = cls % U64(parts)
        order = np.lexsort((cls, goes))
        cuts = np.searchsorted(goes[order], np.arange(parts + 1, dtype=U64))
        to, blob = [], []
        for b in np.flatnonzero(np.diff(cuts)).tolist():
            at = order[cuts[b] : cuts[b + 1]]
            used, first, local = np.unique(cls[at], return_index=True, return_inverse=True)
            to.append(int(keys[b]))
            blob.append(pack_arrays(t[at], local.astype(np.uint32), np.minimum(freq[at], 0xFFFFFFFF).astype(np.uint32), used, n[at][first]))
        yield rows(2, to, blob)

    texts = docs.select(F.col(id_col).cast("long").alias("k"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"))
    found = stage(texts.mapInArrow(cut, FOUND).repartition(parts, "to").mapInArrow(count, FOUND), "shingles")
    member = found.where("kind = 0").select("k", "cls", "n")
    spread = found.where("kind = 1").select(F.col("k").alias("t"), F.col("n").alias("f"))
    table: object = None
    if spread.count() <= BROADCAST_ROWS:
        pairs = sorted(map(tuple, spread.collect()), key=lambda r: r[0] % 2**64)
        table = docs.sparkSession.sparkContext.broadcast((np.array([p[0] for p in pairs], np.int64).view(U64), np.array([p[1] for p in pairs], np.int64)))
    # with more spread shingles than are broadcast, all of them keep one frequency above all others: an order too

    @task
    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = []
        for batch in batches:
            for blob in batch.column(1):
                t, local, f, cls, n = unpack_arrays(blob.as_py())
                got.append((t, cls[local], n[local], f.astype(np.int64)))
        if not got:
            return
        t, cls, n, f = (np.concatenate(x) for x in zip(*got))
        zero = np.flatnonzero(f == 0)
        f[zero] = np.iinfo(np.int64).max
        if table is not None and len(zero):
            st, sf = table.value
            f[zero] = sf[np.searchsorted(st, t[zero])]
        order = np.lexsort((t, f, cls))
        t, cls, n, f = t[order], cls[order], n[order], f[order]
        new = np.ones(len(t), bool)
        new[1:] = (t[1:] != t[:-1]) | (cls[1:] != cls[:-1])
        t, cls, n = t[new], cls[new], n[new]
        starts, ends = group_slices(cls)
        size = n[starts].astype(np.int64)
        least = -(-threshold * size // 100)
        prefix = (size - least + 1) - (size - (ends - starts))
        out: dict[str, list] = {"cls": [], "n": [], "tokens": [], "first": [], "place": []}
        for i in np.flatnonzero((ends - starts >= least) & (prefix > 0)).tolist():
            mine = t[starts[i] : ends[i]]
            out["cls"].append(int(cls[starts[i]].view(np.int64)))
            out["n"].append(int(size[i]))
            out["tokens"].append(mine.tobytes())
            out["first"].append(mine[: prefix[i]].view(np.int64))
            # where the least of so many shingles stands among all, made uniform
            out["place"].append(float(1 - (1 - int(mine.min()) / 2.0**64) ** len(mine)))
        if out["cls"]:
            yield pa.RecordBatch.from_pydict({"cls": pa.array(out["cls"], pa.int64()), "n": pa.array(out["n"], pa.int64()), "tokens": pa.array(out["tokens"], pa.binary()), "first": pa.array(out["first"], pa.list_(pa.int64())), "place": pa.array(out["place"], pa.float64())})

    schema = "cls long, n long, tokens binary, first array<long>, place double"
    candidates = found.where("kind = 2").select("to", "blob").repartition(parts, "to").mapInArrow(gather, schema)
    return member, stage(candidates, "candidates")


def join(docs: DataFrame, threshold: int = 70, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_shingles, n_similar, component_id, class_id)`` of each row.

    ``n_similar``: other rows whose sets link to this row's, copies included. ``component_id``: the smallest id
    reachable by links, the row's own included. Repeated rows count as documents of their own. Rows without words (null
    and empty texts too) have no shingle and no link, and are their own component. A null id never is the smallest;
    a component of null ids has a null id. Other columns aren't read.
    """
    return rooted(docs, threshold, id_col, text_col).drop("root_class")


def rooted(docs: DataFrame, threshold: int, id_col: str, text_col: str) -> DataFrame:
    """As ``join``, with ``root_class``: the least class of the component, which tells apart components of one smallest id."""
    spark = docs.sparkSession
    member, candidates = classes_and_candidates(docs, threshold, id_col, text_col)
    classes = member.where("n > 0").groupBy("cls").agg(F.count("*").alias("weight"), F.min("k").alias("least"))

    # classes alike in size and shared shingles are one item, named by its least class
    shown = candidates.select("cls", "n", F.md5("tokens").alias("s"), (F.octet_length("tokens") / 8).cast("long").alias("m"))
    of_class = shown.join(classes.select("cls", "weight"), "cls")
    item = stage(of_class.groupBy("s", "n").agg(F.min("cls").alias("item"), F.sum("weight").alias("total"), F.count("*").alias("members")), "items")
    shared = item.where("members > 1")
    alike = stage(of_class.join(shared, ["s", "n"]).select("cls", "item", "total", "weight", F.expr(f"100 * m >= {threshold} * (2 * n - m)").alias("linked")), "alike")
    items = candidates.join(item.select(F.col("item").alias("cls"), F.col("total").alias("weight")), "cls")

    index = items.select("cls", F.explode("first").alias("t"))
    heads = index.groupBy("t").agg(F.min("cls").alias("head"), F.count("*").alias("c")).where("c > 1")
    edges = index.join(heads, "t").where("cls <> head").select(F.col("cls").alias("a"), F.col("head").alias("b")).distinct()
    group = stage(components(edges), "groups")

    ratio = math.log(100 / threshold) if threshold < 100 else 1e-9
    near = items.drop("first").join(group.withColumnRenamed("node", "cls"), "cls")
    near = near.withColumn("level", F.floor(F.log("n") / ratio + 1e-9).cast("int") if threshold < 100 else F.col("n").cast("int"))
    sizes = near.groupBy("root", "level").agg(F.count("*").alias("c")).withColumn("blocks", F.ceil(F.col("c") / BLOCK).cast("int")).drop("c")
    near = near.join(sizes, ["root", "level"]).withColumn("slot", F.least(F.floor(F.col("place") * F.col("blocks")), F.col("blocks") - 1).cast("long"))
    near = stage(near.select("cls", "n", "weight", "tokens", "root", "level", "slot"), "near")
    # similar items fall in one slot; a slot of too many is split
    full = near.groupBy("root", "level", "slot").agg(F.ceil(F.count("*") / BLOCK).alias("parts")).where("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("cls"), F.col("parts")), F.lit(0))
    near = near.join(full, ["root", "level", "slot"], "left").withColumn("block", F.col("slot") * (1 << 20) + part).drop("slot", "parts")

    # pairs of blocks of one level, or of a level and the next
    nodes = stage(near.groupBy("root", "level", "block").agg(F.min("n").alias("low"), F.max("n").alias("high")), "blocks")
    several = nodes.groupBy("root").count().where("count > 1").select("root")
    reached = candidates.select("cls", "first").join(near.join(several, "root", "left_semi").select("cls", "root", "level", "block"), "cls")
    reached = reached.select("root", "level", "block", F.explode("first").alias("t")).distinct().join(nodes, ["root", "level", "block"])
    right = reached.select("root", "t", F.col("level").alias("l2"), F.col("block").alias("b2"), F.col("low").alias("low2"))
    pairs = reached.join(right, ["root", "t"]).where("(l2 = level AND b2 > block) OR l2 = level + 1").where(F.col("high") * 100 >= F.col("low2") * threshold)
    pairs = pairs.select("root", F.col("level").alias("l1"), F.col("block").alias("b1"), "l2", "b2").distinct()
    pairs = pairs.unionByName(nodes.select("root", F.col("level").alias("l1"), F.col("block").alias("b1"), F.col("level").alias("l2"), F.col("block").alias("b2")))
    pairs = stage(pairs.withColumn("task", F.xxhash64("root", "l1", "b1", "l2", "b2")).withColumn("same", F.expr("l1 = l2 AND b1 = b2")), "pairs")
    first = near.join(pairs, (near.root == pairs.root) & (near.level == pairs.l1) & (near.block == pairs.b1)).select("task", F.lit(0).alias("side"), "same", "cls", "n", "weight", "tokens")
    second = near.join(pairs.where("NOT same"), (near.root == pairs.root) & (near.level == pairs.l2) & (near.block == pairs.b2)).select("task", F.lit(1).alias("side"), "same", "cls", "n", "weight", "tokens")
    tasks = first.unionByName(second).repartition(partitions(spark), "task").sortWithinPartitions("task", "side")

    @task
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sides: list[list[Item]] = [[], []]
        last, one = None, False

        def close() -> dict[str, list]:
            weight: dict[int, int] = {}
            parent: dict[int, int] = {}

            def root(x: int) -> int:
                while parent.setdefault(x, x) != x:
                    parent[x] = x = parent[parent[x]]
                return x

            if sides[0] and (one or sides[1]):
                a = tree(sides[0])
                for p, q in links(a, a if one else tree(sides[1]), threshold, one):
                    weight[p.cls] = weight.get(p.cls, 0) + q.weight
                    weight[q.cls] = weight.get(q.cls, 0) + p.weight
                    x, y = root(p.cls), root(q.cls)
                    parent[max(x, y)] = min(x, y)
            return {"cls": list(weight), "links": list(weight.values()), "head": [root(c) for c in weight]}

        for batch in batches:
            for task, side, same, cls, n, w, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if task != last:
                    if last is not None and (got := close())["cls"]:
                        yield pa.RecordBatch.from_pydict(got)
                    sides, last, one = [[], []], task, same
                sides[side].append(Item(cls, n, w, np.frombuffer(tokens, U64)))
        if last is not None and (got := close())["cls"]:
            yield pa.RecordBatch.from_pydict(got)

    linked = stage(tasks.mapInArrow(verify, "cls long, links long, head long"), "links")
    per_item = stage(linked.groupBy(F.col("cls").alias("item")).agg(F.sum("links").alias("found")), "per item")
    with_links = alike.join(per_item, "item", "left")
    ways = linked.select(F.col("cls").alias("a"), F.col("head").alias("b")).unionByName(with_links.where("linked OR found IS NOT NULL").select(F.col("cls").alias("a"), F.col("item").alias("b")))
    reach = components(ways)
    least_of = reach.join(classes.select(F.col("cls").alias("node"), "least"), "node").groupBy("root").agg(F.min("least").alias("component"))
    many = with_links.select("cls", (F.coalesce("found", F.lit(0)) + F.when(F.col("linked"), F.col("total") - F.col("weight")).otherwise(0)).alias("links")).where("links > 0")
    alone = per_item.join(shared.select("item"), "item", "left_anti").select(F.col("item").alias("cls"), F.col("found").alias("links"))
    per_class = alone.unionByName(many).join(reach.withColumnRenamed("node", "cls").join(least_of, "root").select("cls", "root", "component"), "cls")
    full = classes.join(per_class, "cls", "left").select("cls", "weight", "links", "root", F.coalesce(F.when(F.col("links").isNotNull(), F.col("component")), "least").alias("component"))
    alone = F.col("n") == 0
    out = member.join(full, "cls", "left")
    return out.select(
        F.col("k").cast(docs.schema[id_col].dataType).alias(id_col),
        F.col("n").alias("n_shingles"),
        F.when(alone, F.lit(0)).otherwise(F.col("weight") - 1 + F.coalesce("links", F.lit(0))).cast("long").alias("n_similar"),
        F.when(alone, F.col("k")).otherwise(F.col("component")).cast(docs.schema[id_col].dataType).alias("component_id"),
        F.col("cls").alias("class_id"),
        F.coalesce("root", "cls").alias("root_class"),
    )


def with_classes(docs: DataFrame, text_col: str) -> DataFrame:
    """``(cls, n, row)``: the class and number of shingles of each row, and the row."""

    @task
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = utf8(batch.column(0))
            cls, n = [np.zeros(0, U64)], [np.zeros(0, np.int64)]
            for lo, hi in chunks(off):
                s, at = shingle_sets(data, off[lo : hi + 1])
                cls.append(class_hashes(s, at))
                n.append(np.diff(at))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cls).view(np.int64)), pa.array(np.concatenate(n).astype(np.int64)), batch.column(1)], ["cls", "n", "row"])

    rows = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("x"), F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"))
    return rows.mapInArrow(work, StructType([StructField("cls", LongType()), StructField("n", LongType()), StructField("row", rows.schema["row"].dataType)]))


def one_of_each(docs: DataFrame, threshold: int = 70, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component of linked rows: the one of smallest id, then of least class, then of least text.

    Rows without words and rows with null id stay. Of rows with equal id and equal text one stays. A row goes for its own
    links only: of an id on several rows, those that link with nothing stay. The ids, or ids and classes, that go are
    broadcast up to ``BROADCAST_ROWS`` and joined by shuffle beyond.
    """
    found = stage(rooted(docs, threshold, id_col, text_col), "components").where(F.col(id_col).isNotNull())
    twice = found.groupBy(id_col).count().where("count > 1").select(id_col)
    hint = lambda df: F.broadcast(df) if df.count() <= BROADCAST_ROWS else df
    gone = found.where(F.col(id_col) > F.col("component_id")).select(id_col)
    if twice.isEmpty():
        return docs.join(hint(gone), id_col, "left_anti").select(*docs.columns)
    again = hint(stage(twice, "repeated ids"))
    once = docs.join(again, id_col, "left_anti").join(hint(gone.distinct()), id_col, "left_anti").select(*docs.columns)
    row = found.where("n_shingles > 0").select("root_class", F.struct(F.col(id_col).alias("i"), F.col("class_id").alias("c")).alias("row"))
    first = row.groupBy("root_class").agg(F.min("row").alias("first"))
    gone = hint(stage(row.join(first, "root_class").where("row > first").select("row.*").distinct(), "gone"))
    several = with_classes(docs.join(again, id_col, "left_semi").select(*docs.columns), text_col)
    own, text = F.col("row").getField(id_col), F.col("row").getField(text_col)
    kept = several.join(gone, (own == F.col("i")) & (F.col("cls") == F.col("c")), "left_anti")
    least = kept.groupBy(own, "cls", "n", F.when(F.col("n") == 0, text)).agg(F.min_by("row", F.coalesce(text, F.lit(""))).alias("row"))
    return once.unionByName(least.select("row.*"))
