"""Language identification: multinomial logistic regression on TF-IDF of hashed character 1- to 3-grams.

Features: characters are lower-cased, everything that isn't a letter becomes a space, and each n-gram is hashed to
one of ``BUCKETS`` of its length. The term frequency is the share of the text's n-grams; document frequencies
are counted over every row that may be learned from, in Spark. The weights are fitted on the driver by
follow-the-regularised-leader with elastic-net penalties on a bounded sample of labelled rows
(``MAX_TRAIN`` rows, the same number of each language, with all their features), and a temperature fitted on a fifth of the sample that the weights never saw calibrates the probabilities.

Every text is scored whole, in one pass without a shuffle.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import chunks, column, fields, over, prepare, task, utf8

BUCKETS = 1 << 14
ORDERS = (1, 2, 3)
SIZE = BUCKETS * len(ORDERS)
MAX_TRAIN = 3200
#: Planes 4 to 13 are unassigned, 14 holds no letter and 15 and 16 are private.
PLANES = 0x40000
UNKNOWN = "und"
SPACE = 32
SCALE = 100.0  # term shares are small; this only moves the learning rate


@functools.cache
def letters() -> np.ndarray:
    """The lower case of each code point that is a letter, else a space."""
    table = np.full(0x110000, SPACE, np.uint32)
    for c in range(PLANES):
        s = chr(c)
        if s.isalpha():
            table[c] = ord(s.lower()[0])
    return table


def codepoints(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of consecutive UTF-8 texts and the offset of each; bytes that aren't UTF-8 become U+FFFD."""
    raw = data[off[0] : off[-1]]
    try:
        cps = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
        return cps, heads[off - off[0]]
    except UnicodeDecodeError:
        parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(off[:-1], off[1:])]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


def grams(cps: np.ndarray, off: np.ndarray) -> list[np.ndarray]:
    """The bucket of the n-gram at each position, for each order; ``SIZE`` where it would cross into the next text."""
    chars = letters()[cps]
    unit = (chars + np.uint32(1)) * np.uint32(0x9E3779B1)
    h, out = unit, []
    for k, n in enumerate(ORDERS):
        if k:
            h = h[:-1] * np.uint32(0x85EBCA6B) + unit[n - 1 :] if len(h) else h
        b = ((h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(18)).astype(np.int64) + k * BUCKETS
        full = np.full(len(chars), SIZE, np.int64)
        full[: len(b)] = b
        for back in range(1, n):
            at = off[1:] - back
            full[at[(at >= off[:-1])]] = SIZE
        out.append(full)
    return out


def gram_counts(lengths: np.ndarray) -> np.ndarray:
    return sum(np.maximum(lengths - n + 1, 0) for n in ORDERS)


def sum_vectors(parts: DataFrame, size: int) -> np.ndarray:
    """Sum of int64 vectors, one a row in ``v``, added up on the executors in levels of 64 until few are left."""

    @task
    def add(batches):
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                v = np.frombuffer(raw, np.int64)
                total = v.copy() if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    n = parts.rdd.getNumPartitions()
    while n > 64:
        n = -(-n // 64)
        parts = parts.repartition(n).mapInArrow(add, "v binary")
    total = np.zeros(size, np.int64)
    for row in parts.collect():
        total += np.frombuffer(row.v, np.int64)
    return total


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of the texts each bucket occurs, and how many texts there are; over all rows, one vector for each task."""

    @task
    def work(batches):
        total = np.zeros(SIZE + 1, np.int64)
        for batch in batches:
            data, off = utf8(batch.column(0))
            n = len(off) - 1
            for lo, hi in chunks(off, rows=256):
                cps, coff = codepoints(data, off[lo : hi + 1])
                if not len(cps):
                    continue
                seen = np.zeros((hi - lo, SIZE + 1), bool)
                owner = np.repeat(np.arange(hi - lo), np.diff(coff))
                for b in grams(cps, coff):
                    seen[owner, b] = True
                total[:SIZE] += seen[:, :SIZE].sum(0)
            total[SIZE] += n
        yield pa.RecordBatch.from_pydict({"v": [total.tobytes()]})

    total = sum_vectors(texts.mapInArrow(work, "v binary"), SIZE + 1)
    return total[:SIZE], int(total[SIZE])


@dataclass
class Model:
    """Weights times inverse document frequency; ``predict`` gives calibrated probabilities."""

    labels: list[str]
    weights: np.ndarray  # (SIZE + 1, labels), the last row of zeros
    bias: np.ndarray
    temperature: float

    def predict(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of each label, and whether the text has a letter."""
        n = len(off) - 1
        logits = np.tile(self.bias, (n, 1))
        lettered = np.zeros(n, bool)
        cps, coff = codepoints(data, off)
        size = np.diff(coff)
        full = np.flatnonzero(size)
        if len(full):
            starts = coff[:-1][full]
            lettered[full] = np.maximum.reduceat(letters()[cps] != SPACE, starts)
            total = sum(np.add.reduceat(self.weights[b], starts, axis=0, dtype=np.float64) for b in grams(cps, coff))
            logits[full] += SCALE * total / gram_counts(size[full])[:, None]
        return softmax(logits / self.temperature), lettered


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, n_labels: int, size: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.02, epochs: int = 3) -> np.ndarray:
    """Weights by FTRL-proximal with penalties ``l1`` and ``l2``; the last feature, the bias, has value 1 in each row."""
    z, n = np.zeros((size + 1, n_labels)), np.zeros((size + 1, n_labels))

    def weights(at):
        zi = z[at]
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(n[at])) / alpha + l2))

    rng = np.random.default_rng(7)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            at, x = rows[i]
            at, x = np.append(at, size), np.append(x, 1.0)
            w = weights(at)
            p = softmax(x @ w)
            p[y[i]] -= 1
            g = x[:, None] * p
            step = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - step * w
            n[at] += g * g
    return weights(np.arange(size + 1))


def fit(docs: DataFrame, text_col: str = "text", label_col: str = "lang", id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> Model:
    """A model of the labels of ``docs``; rows with null label or null text aren't learned from.

    Without any such row the model has no label, and every prediction is ``und``.
    """
    rows = docs.where(F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(label_col).count().collect()}
    labels = sorted(counts)
    prepare(docs.sparkSession)
    if not labels:
        return Model([], np.zeros((SIZE + 1, 0)), np.zeros(0), 1.0)
    df, n = document_frequencies(rows.select(text_col))
    idf = np.log((1 + n) / (1 + df)) + 0.1
    each = max(20, max_train // len(labels))
    share = F.lit(0.0)
    for lab in labels:
        share = F.when(F.col(label_col) == lab, min(1.0, each / counts[lab])).otherwise(share)
    draw = F.pmod(F.xxhash64(F.col(id_col).cast("string"), text_col, F.lit(11)), F.lit(1 << 20))

    def features(batch: pa.RecordBatch):
        data, off = utf8(batch.column(0))
        out = {"label": [], "at": [], "count": [], "total": []}
        for i, lab in enumerate(batch.column(1).to_pylist()):
            cps, coff = codepoints(data, off[i : i + 2])
            if len(cps):
                b = np.concatenate(grams(cps, coff))
                at, c = np.unique(b[b < SIZE], return_counts=True)
                out["label"].append(lab)
                out["at"].append(at.astype(np.int32).tobytes())
                out["count"].append(c.astype(np.int32).tobytes())
                out["total"].append(int(gram_counts(np.diff(coff))[0]))
        yield out

    schema = "label string, at binary, count binary, total long"
    lab = F.col(label_col).cast("string")
    # copies of a row draw alike, so the order is settled to the text and a run repeats exactly
    sample = rows.where(draw < share * float(1 << 20)).select(column(text_col).alias("t"), lab.alias("lab"), draw.alias("draw")).orderBy("draw", "lab", "t").limit(2 * each * len(labels)).select("t", "lab")
    got = sorted(map(tuple, sample.mapInArrow(over(schema, features), schema).collect()))
    xs = [(at := np.frombuffer(a, np.int32), SCALE * np.frombuffer(c, np.int32) / t * idf[at]) for _, a, c, t in got]
    names = [str(x) for x in labels]
    y = np.array([names.index(g[0]) for g in got])
    order = np.random.default_rng(5).permutation(len(xs))
    held, used = order[: len(xs) // 5], order[len(xs) // 5 :]
    w = follow_the_leader([xs[i] for i in used], y[used], len(names), SIZE)
    logits = np.array([x @ w[at] + w[SIZE] for at, x in (xs[i] for i in held)]).reshape(-1, len(names))
    temperature = calibrate(logits, y[held]) if len(held) else 1.0
    bias = w[SIZE].copy()
    w[:SIZE] *= idf[:, None]
    w[SIZE] = 0
    return Model(names, w.astype(np.float32), bias, temperature)


def calibrate(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log-likelihood, by golden-section search of its logarithm."""

    def loss(t):
        p = softmax(logits / np.exp(t))[np.arange(len(y)), y]
        return -np.log(np.maximum(p, 1e-12)).mean() + 1e-4 * t * t

    a, b, g = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - g * (b - a), a + g * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with ``lang_pred`` and ``lang_score`` added.

    Null text, empty text and text without a letter are ``und`` with score 0. Columns of those two names are
    replaced; all others, of whatever name, pass through. Repeated rows are predicted alike.
    """
    added = ("lang_pred", "lang_score")
    schema = fields(docs.schema, added) + ", lang_pred string, lang_score double"
    kept = [f.name for f in docs.schema if f.name not in added]
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        m = shared.value
        data, off = utf8(batch.column(batch.schema.get_field_index(text_col)))
        names = np.array([*m.labels, UNKNOWN], object)
        for lo, hi in chunks(off):
            p, lettered = m.predict(data, off[lo : hi + 1]) if m.labels else (np.zeros((hi - lo, 1)), np.zeros(hi - lo, bool))
            best = np.where(lettered, p.argmax(1), len(m.labels))
            part = batch.slice(lo, hi - lo)
            yield {n: part.column(i) for i, n in enumerate(part.schema.names)} | {"lang_pred": names[best].tolist(), "lang_score": np.where(lettered, p.max(1), 0.0)}

    return docs.select(*map(column, kept)).mapInArrow(over(schema, work), schema)


def held_out(id_col: str, folds: int, fold: int):
    """Whether crc32 of the id as text falls in the fold; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(True))
