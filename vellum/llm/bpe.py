"""BPE by speculation: greedy longest match, a vectorised test of every adjacent pair, exact merging of the rest.

A text is normalised and split into words exactly as its tokenizer file says. Each distinct word is encoded
once: the greedy longest match proposes tokens, and the proposal stands if every adjacent pair is compatible,
that is if merging the two tokens' characters gives back those two tokens. Pairs are tested together in numpy,
by undoing merges at the border. Only words with a failing pair are merged exactly.

Texts of characters below U+0180 take a compiled pattern; other texts go through the tokenizer's own normaliser
and splitter. Null counts as the empty text: no ids, and the empty string when decoded.
"""

from __future__ import annotations

import functools
import hashlib
import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vellum.llm.shared import chunks, large, over, prepare, utf8

#: Words remembered by one worker before it starts afresh.
MEMO = 150_000
END = "\n"  # stands for the word-end suffix


@functools.cache
def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in plain}
    for i, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + i)
    return table


class Words:
    """Splits texts into the words of one tokenizer file, as strings before the byte mapping."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        spec = json.load(open(path, encoding="utf-8"))
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        self.cut = re.compile("(" + "|".join(map(re.escape, self.special)) + ")") if self.special else None
        kinds = lambda k: "".join(re.escape(chr(c)) for c in range(0x180) if unicodedata.category(chr(c))[0] == k)
        letters, numbers, space = kinds("L"), kinds("N"), "\t-\r \x85\xa0"
        # letters and numbers start no other alternative, so they are tried first, being the most frequent
        self.fast = re.compile(f"[{letters}]+|[{numbers}]|'s|'t|'re|'ve|'m|'ll|'d|[^{space}{letters}{numbers}]+").findall
        self.ascii = re.compile("[a-z]+|[0-9]|'s|'t|'re|'ve|'m|'ll|'d|[^\t-\r a-z0-9]+").findall
        self.odd = re.compile("[^\x00-įı-ſ]")
        self.bytes = {v: k for k, v in byte_letters().items()}

    def __call__(self, text: str) -> list[str | int]:
        """Words in order; a special token written in the text is its id."""
        if "<|" not in text:
            if text.isascii():
                return self.ascii(text.lower())
            if not self.odd.search(text):
                return self.fast(text.lower())
        out: list[str | int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                seen = self.tokenizer.normalizer.normalize_str(part)
                out += [bytes(self.bytes[c] for c in w).decode() for w, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(seen)]
        return out


class Speculative:
    """Encodes distinct words of one byte-level BPE with a word-end suffix."""

    def __init__(self, path: str):
        spec = json.load(open(path, encoding="utf-8"))
        model = spec["model"]
        suffix = model["end_of_word_suffix"]
        self.names = {i: t for t, i in model["vocab"].items()} | {x["id"]: x["content"] for x in spec.get("added_tokens", [])}
        self.ids = {(t[: -len(suffix)] + END if t.endswith(suffix) else t): i for t, i in model["vocab"].items()}
        self.longest = max(map(len, self.ids))
        name = lambda t: t[: -len(suffix)] + END if t.endswith(suffix) else t
        size = max(self.names) + 1
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left, self.right, self.made = np.arange(size), np.arange(size), np.full(size, -1)
        keys, ranks = [], []
        for r, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a, b = name(a), name(b)
            i, j, k = self.ids[a], self.ids[b], self.ids[a + b]
            self.rank[i, j] = (r, k)
            keys.append(i << 32 | j)
            ranks.append(r)
            self.left[k], self.right[k], self.made[k] = i, j, r
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.append(np.array(keys, np.int64)[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(ranks, np.int64)[order], np.iinfo(np.int64).max)
        # a token that its own characters don't give can't be proposed
        self.stable = np.ones(size, bool)
        for t, i in self.ids.items():
            self.stable[i] = self.merge(t) == [i]

    def units(self, word: str) -> list[str]:
        return [*word[:-2], word[-2:]] if word.endswith(END) else list(word)

    def merge(self, word: str) -> list[int]:
        """Exact BPE: the pair of least rank first, the leftmost of equal ones."""
        ids = [self.ids[u] for u in self.units(word)]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(self.rank[p][0], i, *p) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if ids[i] == a else n
            if j >= n or ids[j] != b:
                continue
            ids[i], ids[j] = self.rank[a, b][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                if (p := (ids[i], ids[after[i]])) in self.rank:
                    heapq.heappush(heap, (self.rank[p][0], i, *p))
            if before[i] >= 0 and (p := (ids[before[i]], ids[i])) in self.rank:
                heapq.heappush(heap, (self.rank[p][0], before[i], *p))
        return [x for x in ids if x >= 0]

    def propose(self, word: str) -> list[int] | None:
        """Greedy longest match; None where it runs into a dead end."""
        out, i, n, ids, most = [], 0, len(word), self.ids, self.longest
        while i < n:
            for j in range(min(n, i + most), i, -1):
                if j != n - 1 and (t := ids.get(word[i:j])) is not None:
                    break
            else:
                return None
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging the characters of a followed by b leaves exactly a and b, for all pairs at once.

        The border is replayed backwards: the merge made last on either side is undone, and a pair across the
        border that would have been merged before it, or on a tie stands further left, shows the pair unstable.
        """
        a, b = a.copy(), b.copy()
        good, live = np.ones(len(a), bool), np.arange(len(a))
        limit = np.full(len(a), np.iinfo(np.int64).max)
        while len(live):
            x, y = a[live], b[live]
            at = np.searchsorted(self.keys, x << 32 | y)
            r = np.where(self.keys[at] == (x << 32 | y), self.ranks[at], np.iinfo(np.int64).max)
            bad = r < limit[live]
            good[live[bad]] = False
            mx, my = self.made[x], self.made[y]
            on = ~bad & ((mx >= 0) | (my >= 0))
            live, x, y, mx, my = live[on], x[on], y[on], mx[on], my[on]
            undo_left = mx > my  # a merge of equal rank happens further left first, so the right one is undone first
            limit[live] = np.where(undo_left, mx, my + 1)
            a[live] = np.where(undo_left, self.right[x], x)
            b[live] = np.where(undo_left, y, self.left[y])
        return good

    def encode(self, words: list[str]) -> list[list[int]]:
        """Ids of each word (without the suffix, before the byte mapping)."""
        letters = byte_letters()
        shown = [w + END if w.isascii() and "!" <= min(w) and max(w) <= "~" else "".join([letters[c] for c in w.encode()]) + END for w in words]
        guess = [self.propose(s) for s in shown]
        sizes = np.array([len(g) if g else 0 for g in guess])
        flat = np.array([t for g in guess if g for t in g], np.int64)
        bad = sizes == 0
        if len(flat):
            owner = np.repeat(np.arange(len(words)), sizes)
            np.logical_or.at(bad, owner, ~self.stable[flat])
            pair = np.flatnonzero(owner[1:] == owner[:-1])
            keys, back = np.unique(flat[pair] << 32 | flat[pair + 1], return_inverse=True)
            fine = self.compatible(keys >> 32, keys & 0xFFFFFFFF)
            np.logical_or.at(bad, owner[pair], ~fine[back])
        for i in np.flatnonzero(bad).tolist():
            guess[i] = self.merge(shown[i])
        return guess


class Codec:
    """Words and their encodings, remembered: ids as little-endian bytes and the decoded form."""

    def __init__(self, path: str):
        self.words, self.bpe = Words(path), Speculative(path)
        self.memo: dict[str | int, tuple[bytes, bytes]] = {}

    def learn(self, missing: list[str | int]) -> None:
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
        texts = [w for w in missing if isinstance(w, str)]
        for w, ids in [*zip(texts, self.bpe.encode(texts)), *((w, [w]) for w in missing if not isinstance(w, str))]:
            self.memo[w] = np.array(ids, "<u4").tobytes(), " ".join([self.bpe.names[i] for i in ids]).encode()

    def encode(self, texts: list[str]) -> Iterator[tuple[bytes, bytes]]:
        """Ids as ``<u4`` bytes and decoded UTF-8 of each text."""
        split = [self.words(t) for t in texts]
        memo = self.memo
        fresh = {w for ws in split for w in ws if w not in memo}
        if fresh:
            if len(memo) + len(fresh) > MEMO:
                fresh = {w for ws in split for w in ws}
            self.learn(sorted(fresh, key=str))
        for ws in split:
            got = [memo[w] for w in ws]
            yield b"".join([g[0] for g in got]), b" ".join([g[1] for g in got])


@large
@functools.cache
def codec(path: str) -> Codec:
    return Codec(path)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """Each text encoded and decoded: ``(id, n_tokens, ids_sha256, decoded_sha256)``, with ``keep_ids`` also ``ids`` and ``decoded``.

    One row for each row of ``docs``, repeated ids and texts included. Null and empty texts, and texts of white
    space only, have no tokens and decode to the empty text. Other columns of ``docs`` aren't read. No shuffle.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"{id_col} {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids

    def work(batch: pa.RecordBatch):
        c = codec(tokenizer)
        data, off = utf8(batch.column(1))
        view = memoryview(data)
        for lo, hi in chunks(off):
            texts = [str(view[a:b], "utf-8", "replace") for a, b in zip(off[lo:hi].tolist(), off[lo + 1 : hi + 1].tolist())]
            got = list(c.encode(texts))
            out = {id_col: batch.column(0).slice(lo, hi - lo), "n_tokens": [len(i) // 4 for i, _ in got], "ids_sha256": [hashlib.sha256(i).hexdigest() for i, _ in got], "decoded_sha256": [hashlib.sha256(d).hexdigest() for _, d in got]}
            yield out | ({"ids": [np.frombuffer(i, "<u4").tolist() for i, _ in got], "decoded": [d.decode() for _, d in got]} if keep_ids else {})

    prepare(docs.sparkSession)
    return docs.select(id_col, text_col).mapInArrow(over(schema, work, lambda: codec(tokenizer).memo.clear(), codec), schema)
