"""Length-delimited binary records of token ids, with masked checksums and a separate offset index.

Record: length of the payload (u64), masked CRC-32 of those 8 bytes, payload, masked CRC-32 of the payload; all
little-endian. Payload: a flag byte (1 = the id is null), the id (i64), the width of a token id in bytes
(2 where every id of the record is below 65,536, else 4), then the ids. The index beside each file, ``.idx``,
holds the offset of each record (u64), so any record is read without the others: what a shuffled reader needs.

Writing is safe against lost tasks: each attempt writes files of its own name, and only the files named by the
manifest, which Spark commits, are ever read.
"""

from __future__ import annotations

import functools
import struct
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.bpe import Words, byte_letters
from vellum.llm.shared import chunks, over, partitions, stage, task, utf8, work_path

HEAD = struct.Struct("<QI")
META = struct.Struct("<BqB")
MEMO = 300_000
MANIFEST = "file_no int, path string, n_records long, n_tokens long, n_bytes long"


class Corrupt(ValueError):
    """A record whose length or payload doesn't match its checksum."""


def masked(data: bytes) -> int:
    """A CRC-32, rotated and offset, so that checksums of data that hold checksums stay sound."""
    crc = zlib.crc32(data)
    return ((crc >> 15 | crc << 17) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    size = struct.pack("<Q", len(payload))
    return b"".join((size, struct.pack("<I", masked(size)), payload, struct.pack("<I", masked(payload))))


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return META.pack(doc_id is None, doc_id or 0, width) + ids.astype(f"<u{width}").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    null, doc_id, width = META.unpack_from(payload)
    return None if null else doc_id, np.frombuffer(payload, f"<u{width}", offset=META.size).astype("<u4")


def read_frame(f: BinaryIO) -> bytes | None:
    """The next payload; None at the end of the file."""
    head = f.read(HEAD.size)
    if not head:
        return None
    if len(head) < HEAD.size or masked(head[:8]) != HEAD.unpack(head)[1]:
        raise Corrupt("length of a record")
    size = HEAD.unpack(head)[0]
    payload, check = f.read(size), f.read(4)
    if len(payload) < size or len(check) < 4 or masked(payload) != struct.unpack("<I", check)[0]:
        raise Corrupt("payload of a record")
    return payload


def open_uri(uri: str, mode: str) -> BinaryIO:
    """A file of any filesystem that pyarrow knows; the folder is made where it must be."""
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    if mode == "rb":
        return where.open_input_file(path)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return where.open_output_stream(path, compression=None)


def read_at(path: str, picks: list[int]) -> Iterator[tuple[int | None, np.ndarray]]:
    """The records of one file with the given numbers, in that order, by its index."""
    with open_uri(f"{path}.idx", "rb") as f:
        at = np.frombuffer(f.read(), "<u8")
    with open_uri(path, "rb") as f:
        for k in picks:
            f.seek(int(at[k]))
            yield unpack(read_frame(f))


class Memo(dict):
    """Ids of each word as ``<u4`` bytes, by the library's model of the word alone; made when first asked for, remembered up to ``MEMO`` words."""

    def __init__(self, words: Words):
        self.model, self.letters = words.tokenizer.model, byte_letters()

    def __missing__(self, word: str | int) -> bytes:
        if len(self) >= MEMO:
            self.clear()
        if isinstance(word, str):
            letters = self.letters
            ids = [t.id for t in self.model.tokenize(word if word.isascii() and word.isalnum() else "".join([letters[c] for c in word.encode()]))]
        else:
            ids = [word]
        self[word] = raw = struct.pack(f"<{len(ids)}I", *ids)
        return raw


class Encoder:
    """Ids of whole texts by the tokenizers library, whose model sees each distinct word once for as long as it is remembered."""

    def __init__(self, path: str):
        self.words = Words(path)
        self.memo = Memo(self.words)

    def encode(self, texts: list[str]) -> Iterator[bytes]:
        memo = self.memo
        for text in texts:
            yield b"".join([memo[w] for w in self.words(text)])


@functools.cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def write_records(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode whole texts, append ``end_id`` to each, write record files to ``folder`` in ascending order of id.

    Returns the manifest, one row a file: ``file_no, path, n_records, n_tokens, n_bytes``; ``file_no`` follows the
    order of ids. Null ids come first; rows of equal id are ordered by a hash of the text, then the text, so a
    hot id is split over files too. Null text counts as empty: its record holds ``end_id`` alone. An empty
    table gives no file. Columns other than the two named aren't read.
    """
    spark = docs.sparkSession
    n = partitions(spark)

    @task
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, no = encoder(tokenizer), TaskContext.get().partitionId()
        path = f"{folder}/part-{no:07d}-{uuid.uuid4().hex}.rec"
        out, at, offsets, tokens = None, 0, [], 0
        for batch in batches:
            data, off = utf8(batch.column(1))
            view, keys = memoryview(data), batch.column(0).to_pylist()
            for lo, hi in chunks(off):
                texts = [str(view[a:b], "utf-8", "replace") for a, b in zip(off[lo:hi].tolist(), off[lo + 1 : hi + 1].tolist())]
                framed = []
                for key, raw in zip(keys[lo:hi], enc.encode(texts)):
                    ids = np.frombuffer(raw + struct.pack("<I", end_id), "<u4")
                    framed.append(frame(pack(key, ids)))
                    offsets.append(at)
                    at += len(framed[-1])
                    tokens += len(ids)
                out = out or open_uri(path, "wb")
                out.write(b"".join(framed))
        enc.memo.clear()
        if out:
            out.close()
            with open_uri(f"{path}.idx", "wb") as f:
                f.write(np.array(offsets, "<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"file_no": pa.array([no], pa.int32()), "path": [path], "n_records": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]})

    key = F.col(id_col).cast("long")
    rows = docs.select(key.alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange(n, "k", "h").sortWithinPartitions("k", "h", "t").select("k", "t")
    return stage(ordered.mapInArrow(write, MANIFEST), "manifest")


def read_records(manifest: DataFrame) -> DataFrame:
    """The records of the files of a manifest: ``(doc_id, start, n_tokens, ids_crc32)``.

    ``start`` is the number of ids of all records before, over all files. Every checksum is verified; a bad
    one raises ``Corrupt``. Only the manifest, one row a file, is ordered in one task.
    """
    spark = manifest.sparkSession
    files = max(1, manifest.count())
    based = manifest.withColumn("base", F.sum("n_tokens").over(Window.orderBy("file_no").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"

    def read(batch: pa.RecordBatch):
        for path, start in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist()):
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "n_tokens", "ids_crc32")}
            with open_uri(path, "rb") as raw:
                while (payload := read_frame(raw)) is not None:
                    doc_id, ids = unpack(payload)
                    for k, v in zip(out, (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))):
                        out[k].append(v)
                    start += len(ids)
                    if len(out["doc_id"]) >= 10_000:
                        yield out
                        out = {k: [] for k in out}
            yield out

    return based.repartitionByRange(min(files, 100_000), "file_no").select("path", "base").mapInArrow(over(schema, read), schema)


def token_files(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 1) -> DataFrame:
    """Write the files to the shared folder and read them back; see ``write_records`` and ``read_records``."""
    return read_records(write_records(docs, tokenizer, work_path(spark, "records"), end_id))
