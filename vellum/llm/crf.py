"""Toxicity: a two-state linear-chain conditional random field tags words; its marginals give scores and offsets.

A word's features are its letters, its prefixes of 3 to 6 and its suffix of 3, hashed. Training words get their
labels from the labelled documents: a word of a toxic document is toxic if one of its features is found in at
least ``MIN_DOCS`` toxic documents of the sample and almost only there. The field is fitted by gradient ascent of the
conditional likelihood. Forward-backward marginals of every word of every text aggregate to a score by a logistic
regression fitted on documents that the field wasn't fitted on.

A text is one chain from first word to last. A long one is computed in blocks of ``BLOCK`` words side by side: the
product of a block's transfer matrices carries the state over it, so blocks change nothing but the order of the sums.
The sample is bounded: ``MAX_TRAIN`` labelled rows, half of each class, in the order of a hash, of ``MAX_BYTES`` bytes of text together;
a row of any length can be drawn. The gradient is taken over pieces of ``PIECE`` words of these.
"""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm.shared import chunks, column, fields, over, prepare, utf8, words

MAX_TRAIN = 4000
MAX_BYTES = 64 << 20
MIN_DOCS = 4
BLOCK = 256
PIECE = 64
HASHED = 1 << 17
MEMO = 300_000
SUMMARY = 4
#: Share of training words that show only what all words have.
UNSEEN = 0.3
#: Words less likely toxic than this count for nothing in a document's measures.
FAINT = 0.3


def features(word: bytes) -> tuple[int, ...]:
    """Hashes of a word's letters and affixes, and one that all words have, so that unseen words lean to neither side by chance."""
    w = word.decode("utf-8", "replace").lower()
    w = "".join(filter(str.isalnum, w)) or w
    parts = {"", "w" + w, *("p" + w[:n] for n in (3, 4, 5, 6) if len(w) > n), *(("s" + w[-3:],) if len(w) > 3 else ())}
    return tuple(zlib.crc32(p.encode()) & (HASHED - 1) for p in sorted(parts))


def recur(first: np.ndarray, emission: np.ndarray, way: np.ndarray) -> np.ndarray:
    """Odds x[0] = first, x[t] = emission[t] (way01 + x way11) / (way00 + x way10), each kept in a range that doubles hold."""
    out = np.empty_like(emission)
    x = out[0] = np.clip(first, 1e-14, 1e14)
    for t in range(1, len(emission)):
        x = emission[t] * ((way[0, 1] + x * way[1, 1]) / (way[0, 0] + x * way[1, 0]))
        np.clip(x, 1e-14, 1e14, out=x)
        out[t] = x
    return out


def forward_backward(u: np.ndarray, size: np.ndarray, trans: np.ndarray, start: float | np.ndarray, after: np.ndarray | float = 1.0):
    """Of chains padded to a (time, chain) array of emission log-odds: log-odds of the prefixes, of the suffixes.

    ``start`` is the log-odds of a chain's first state, ``after`` the odds that what follows its last word lends that word.
    """
    e, w = np.exp(trans), np.exp(np.clip(u, -30, 30))
    a = recur(w[0] * np.exp(start), w, e)
    # backwards in time each step takes the word's own emission in first; padding passes on what comes after
    b = np.empty_like(w)
    x = b[-1] = np.broadcast_to(np.asarray(after, float), w.shape[1:])
    for t in range(len(u) - 2, -1, -1):
        y = w[t + 1] * x
        x = np.where(t + 1 < size, np.clip((e[1, 0] + y * e[1, 1]) / (e[0, 0] + y * e[0, 1]), 1e-14, 1e14), x)
        b[t] = x
    return np.log(a), np.log(b)


def transfer(u: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Of full blocks, the matrices (blocks, 2, 2) that take what enters a block's first word to what enters the next block's."""
    e, w = np.exp(trans), np.exp(np.clip(u, -30, 30))
    m = np.zeros((2, 2, u.shape[1]))
    m[0, 0] = m[1, 1] = 1
    for x in w:
        on = m[:, 1] * x
        m = np.stack([m[:, 0] * e[0, 0] + on * e[1, 0], m[:, 0] * e[0, 1] + on * e[1, 1]], axis=1)
        m /= m.max((0, 1))
    return m.transpose(2, 0, 1)


def odds(v: np.ndarray) -> np.ndarray:
    return np.clip(v[:, 1] / v[:, 0], 1e-14, 1e14)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class Field:
    """Weights of features and transitions, and of the four document measures."""

    weights: np.ndarray
    trans: np.ndarray
    start: float
    top: np.ndarray
    memo: dict[bytes, float] = field(default_factory=dict)

    def emission(self, ws: list[bytes]) -> np.ndarray:
        memo = self.memo
        fresh = {w for w in ws if w not in memo}
        if fresh:
            if len(memo) + len(fresh) > MEMO:
                memo.clear()
                fresh = set(ws)
            w = self.weights
            memo.update((f, float(sum(w[i] for i in features(f)))) for f in fresh)
        return np.fromiter(map(memo.__getitem__, ws), np.float64, len(ws))

    def marginals(self, u: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Probability of the toxic state of each word; ``lengths`` are the words of each text."""
        if not len(u):
            return np.zeros(0)
        pieces = -(-lengths // BLOCK)
        before = np.concatenate([[0], np.cumsum(pieces)])
        first = np.repeat(np.concatenate([[0], np.cumsum(lengths)[:-1]]), pieces)
        part = np.arange(len(first)) - np.repeat(before[:-1], pieces)
        start = first + part * BLOCK
        size = np.minimum(BLOCK, np.repeat(lengths, pieces) - part * BLOCK)
        enter, after = np.full(len(first), np.exp(self.start)), np.ones(len(first))
        long = np.flatnonzero(pieces > 1)
        if len(long):
            self.join(u, start, size, before[long], before[long + 1], enter, after)
        out = np.empty(len(u))
        order = np.argsort(size, kind="stable")
        lo = 0
        while lo < len(order):  # blocks of similar length together
            top = max(8, int(size[order[lo]] * 1.5))
            hi = int(np.searchsorted(size[order], top, side="right"))
            at = order[lo:hi]
            s, n = start[at], size[at]
            steps = np.arange(int(n.max()))[:, None]
            real = steps < n
            where = np.minimum(s + steps, len(u) - 1)
            a, b = forward_backward(np.where(real, u[where], 0.0), n, self.trans, np.log(enter[at]), after[at])
            out[where[real]] = sigmoid((a + b)[real])
            lo = hi
        return out

    def join(self, u: np.ndarray, start: np.ndarray, size: np.ndarray, low: np.ndarray, high: np.ndarray, enter: np.ndarray, after: np.ndarray) -> None:
        """Sets the odds that enter each block, and that follow it, of the texts of blocks ``low`` .. ``high`` - 1."""
        e, n = np.exp(self.trans), high - low
        inner = np.concatenate([np.arange(a, b - 1) for a, b in zip(low, high)])  # all but a text's last block are full
        product = np.empty((len(start), 2, 2))
        for lo in range(0, len(inner), 4096):
            at = inner[lo : lo + 4096]
            product[at] = transfer(u[start[at] + np.arange(BLOCK)[:, None]], self.trans)
        v = np.tile([1.0, np.exp(self.start)], (len(low), 1))
        for j in range(int(n.max()) - 1):
            on = n > j + 1
            v[on] = np.einsum("ni,nij->nj", v[on], product[low[on] + j])
            v[on] /= v[on].max(1, keepdims=True)
            enter[low[on] + j + 1] = odds(v[on])
        at = high - 1
        steps = np.arange(BLOCK)[:, None]
        tail = np.where(steps < size[at], u[np.minimum(start[at] + steps, len(u) - 1)], 0.0)
        s = np.stack([np.ones(len(at)), np.exp(np.clip(tail[0] + forward_backward(tail, size[at], self.trans, 0.0)[1][0], -30, 30))], 1)
        for j in range(int(n.max()) - 1):
            on = n > j + 1
            at = high[on] - 2 - j
            after[at] = odds(s[on] @ e.T)
            s[on] = np.einsum("nij,nj->ni", product[at], s[on])
            s[on] /= s[on].max(1, keepdims=True)

    def summary(self, p: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Expected toxic words, the most certain one, their share, and a constant, of each text."""
        out = np.zeros((len(lengths), SUMMARY))
        out[:, 3] = 1
        full = np.flatnonzero(lengths)
        if len(full):
            at = np.concatenate([[0], np.cumsum(lengths)[:-1]])[full]
            total, most = np.add.reduceat(np.where(p > FAINT, p, 0.0), at), np.maximum.reduceat(p, at)
            out[full, 0], out[full, 1] = np.log1p(total), most
            out[full, 2] = np.sqrt(total / lengths[full])
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(x @ self.top)


def token_labels(docs: list[list[bytes]], toxic: np.ndarray) -> list[np.ndarray]:
    """0/1 of each word, from how often its features' documents are toxic."""
    seen = [Counter(), Counter()]
    cache: dict[bytes, tuple[int, ...]] = {}
    for ws, t in zip(docs, toxic):
        fs = set()
        for w in set(ws):
            fs.update(cache.setdefault(w, features(w)))
        seen[t].update(fs)
    n = [max(1, int((toxic == k).sum())) for k in (0, 1)]
    bad = {f for f, c in seen[1].items() if c >= MIN_DOCS and (c / n[1]) > 12 * (seen[0][f] + 0.1) / n[0]}
    hit = {w: any(f in bad for f in fs) for w, fs in cache.items()}
    return [np.array([t and hit[w] for w in ws], bool) for ws, t in zip(docs, toxic)]


def train(docs: list[list[bytes]], toxic: np.ndarray, epochs: int = 8, rate: float = 0.3, l2: float = 1e-5) -> Field:
    """Adagrad on the conditional log-likelihood of the word labels, then the document measures on the other half."""
    half = np.arange(len(docs)) % 2 == 0
    used = [d for d, h in zip(docs, half) if h]
    model = Field(np.zeros(HASHED), np.array([[0.0, -1.0], [0.0, 0.0]]), -2.0, np.array([0.0, 0.0, 0.0, -2.0]))
    if not docs or len(set(toxic.tolist())) < 2:
        return model
    labels = token_labels(used, toxic[half])
    chains = [(ws[i : i + PIECE], y[i : i + PIECE]) for ws, y in zip(used, labels) for i in range(0, len(ws), PIECE)]
    cache = {w: features(w) for w in {w for ws, _ in chains for w in ws}}
    rng = np.random.default_rng(3)
    quiet = [c for c in chains if not c[1].any()]
    loud = [c for c in chains if c[1].any()]
    chains = loud + [quiet[i] for i in rng.permutation(len(quiet))[: max(4000, 2 * len(loud))]]
    gw, gt = np.full(HASHED, 1e-6), np.full((2, 2), 1e-6)
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(len(chains)), max(1, len(chains) // 256)):
            part = [chains[i] for i in batch]
            n = np.array([len(c[0]) for c in part])
            t_max = int(n.max())
            real = np.arange(t_max)[:, None] < n
            y = np.zeros(real.shape)
            flat = [cache[w] for ws, _ in part for w in ws]
            unseen = rng.random(len(flat)) < UNSEEN
            flat = [f[:1] if u else f for f, u in zip(flat, unseen)]  # as a word that training doesn't know
            owner = np.repeat(np.arange(len(flat)), [len(f) for f in flat])
            ids = np.array([i for f in flat for i in f])
            ut = np.bincount(owner, model.weights[ids], len(flat))
            u = np.zeros(real.shape)
            u.T[real.T] = ut
            y.T[real.T] = np.concatenate([c[1] for c in part])
            a, b = forward_backward(u, n, model.trans, model.start)
            g = np.where(real, y - sigmoid(a + b), 0.0)
            grad = np.bincount(ids, g.T[real.T][owner], HASHED) / len(part) - l2 * model.weights
            gw += grad * grad
            model.weights += rate * grad / np.sqrt(gw)
            pair = real[1:]
            if pair.any():
                left, right = np.exp(np.clip(a[:-1], -30, 30)), np.exp(np.clip(u[1:] + b[1:], -30, 30))
                e = np.exp(model.trans)
                cell = np.array([[e[0, 0] + 0 * left, e[0, 1] * right], [e[1, 0] * left, e[1, 1] * left * right]])
                cell /= cell.sum((0, 1))
                y0, y1 = y[:-1], y[1:]
                got = np.array([[(1 - y0) * (1 - y1), (1 - y0) * y1], [y0 * (1 - y1), y0 * y1]])
                d = ((got - cell) * pair).sum((2, 3)) / len(part)
                gt += d * d
                model.trans += 0.1 * d / np.sqrt(gt)
    rest = [d for d, h in zip(docs, half) if not h]
    sizes = np.array([len(d) for d in rest])
    x = model.summary(model.marginals(model.emission([w for d in rest for w in d]), sizes), sizes)
    y = toxic[~half].astype(float)
    loss = lambda w: np.logaddexp(0, -(2 * y - 1) * (x @ w)).sum() + 0.025 * w @ w
    top = np.zeros(SUMMARY)
    for _ in range(40):  # Newton steps of penalised logistic regression, halved until they help
        p = sigmoid(x @ top)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(SUMMARY)
        step = np.linalg.solve(h, x.T @ (y - p) - 0.05 * top)
        while np.abs(step).max() > 1e-6 and loss(top + step) > loss(top):
            step /= 2
        top += step
    model.top = top
    model.memo = {}
    return model


def fit(docs: DataFrame, labels: DataFrame, text_col: str = "text", label_col: str = "toxic", id_col: str = "doc_id", max_train: int = MAX_TRAIN) -> Field:
    """A field fitted on at most ``max_train`` labelled rows, drawn by a hash of the id, half of each class.

    ``labels`` holds ids and 0/1 labels; null labels, null texts and ids without a document aren't learned from.
    Where only one class has rows, or none, the field knows no toxic word and every text scores low. Only the drawn
    labels (a bounded number) meet the documents, so no text is shuffled.
    """
    known = labels.where(column(label_col).isin(0, 1) & column(id_col).isNotNull()).select(column(id_col).alias("k"), column(label_col).cast("int").alias("y"))
    counts = {r[0]: r[1] for r in known.groupBy("y").count().collect()}
    draw = F.pmod(F.xxhash64("k", F.lit(13)), F.lit(1 << 20))
    each = max_train // 2
    share = F.when(F.col("y") == 1, min(1.0, each / max(1, counts.get(1, 0)))).otherwise(min(1.0, each / max(1, counts.get(0, 0))))
    # repeated rows draw alike; they are ordered to the last column, so that a bounded number of them is the same in every run
    picked = known.where(draw < share * float(1 << 20)).orderBy(draw, "k", "y").limit(max_train + max_train // 4)
    texts = docs.where(column(text_col).isNotNull()).select(column(id_col).alias("k"), column(text_col).alias("t"))
    drawn = texts.join(F.broadcast(picked.distinct()), "k").select("y", F.xxhash64("k", "t").alias("h"), F.octet_length("t").cast("long").alias("n"), "t")
    most = 2 * max_train
    sizes = sorted((r.h, r.n) for r in drawn.select("h", "n").orderBy("h", "n").limit(most).collect())
    fits = int(np.searchsorted(np.cumsum([n for _, n in sizes]), MAX_BYTES, side="right"))
    if fits < len(sizes):  # the rows that come first, up to the one that would pass the bound
        drawn = drawn.where(F.col("h") < sizes[fits][0])
    got = sorted(map(tuple, drawn.select("y", "h", "t").orderBy("h", "y", "t").limit(most).collect()))
    got = [got[i] for i in np.random.default_rng(1).permutation(len(got))]
    return train([g[2].encode("utf-8", "replace").split() for g in got], np.array([g[0] for g in got], int))


def tag(docs: DataFrame, model: Field, text_col: str = "text", spans: bool = False, threshold: float = 0.5) -> DataFrame:
    """``docs`` with ``score`` and ``predicted``, and with ``spans`` the byte offsets of words tagged toxic.

    Texts that are null, empty or white space have no words; they score as a text without toxic words does.
    Columns of the names added are replaced, all others pass through; repeated rows score alike.
    """
    added = ["score", "predicted"] + ["spans"] * spans
    kept = [f for f in docs.schema if f.name not in added]
    schema = fields(docs.schema, added) + ", score double, predicted int" + ", spans array<struct<start:long,end:long,p:double>>" * spans
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def work(batch: pa.RecordBatch):
        m = shared.value
        data, off = utf8(batch.column(batch.schema.get_field_index(text_col)))
        view = memoryview(data)
        for lo, hi in chunks(off, 1 << 21):
            split = [bytes(view[a:b]).split() for a, b in zip(off[lo:hi].tolist(), off[lo + 1 : hi + 1].tolist())]
            lengths = np.array([len(w) for w in split])
            p = m.marginals(m.emission([w for ws in split for w in ws]), lengths)
            score = m.score(m.summary(p, lengths))
            part = batch.slice(lo, hi - lo)
            out = {n: part.column(i) for i, n in enumerate(part.schema.names)} | {"score": score, "predicted": (score >= 0.5).astype(np.int32)}
            if spans:
                starts, ends, before = words(data, off[lo : hi + 1])
                out["spans"] = [[{"start": int(starts[k] - off[lo + i]), "end": int(ends[k] - off[lo + i]), "p": float(p[k])} for k in np.flatnonzero(p[x:y] >= threshold) + x] for i, (x, y) in enumerate(zip(before[:-1].tolist(), before[1:].tolist()))]
            yield out

    return docs.select(*(column(f.name) for f in kept)).mapInArrow(over(schema, work, lambda: shared.value.memo.clear()), schema)
