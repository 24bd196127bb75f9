"""Token-id files in patched frame-of-reference blocks.

A file is a magic word, blocks of BLOCK ids, a document table and a trailer. A block stores its least id, the ids' distances
from it packed at a width that holds most of them (PERCENTILE), and the rest in an exception list of positions and high
bits. The trailer gives the block starts, so any document's ids are found without reading the blocks before it.
"""

from __future__ import annotations

import io
import math
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .tokens import vocabulary, word_ids

MAGIC = b"TQPF0001"
BLOCK = 1024
#: Blocks packed together.
AT_ONCE = 64
PERCENTILE = 90
#: Ids in one file at most, but for a longer document.
FILE_IDS = 1 << 25
#: Rows whose texts and ids are Python objects at a time.
ROWS = 512
_FILES = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])
_HEAD = struct.Struct("<IHHB")  # least id, ids, exceptions, width
_END = struct.Struct("<QQQ8s")  # blocks, documents, start of the tables


def pack_blocks(ids: np.ndarray, percentile: float = PERCENTILE) -> list[bytes]:
    """A block for each row of unsigned 32-bit ids; a row has 1 to BLOCK of them."""
    rows, n = ids.shape
    least = ids.min(axis=1, keepdims=True)
    far = (ids - least).astype("<u4")
    bits = np.frexp(far.astype(np.float64))[1]
    counts = np.bincount((bits + 33 * np.arange(rows)[:, None]).ravel(), minlength=33 * rows).reshape(rows, 33)
    widths = (np.cumsum(counts, axis=1) <= math.ceil(percentile / 100 * (n - 1))).sum(axis=1)  # the percentile, the higher of two
    out = [b""] * rows
    for width in np.unique(widths).tolist():
        same = np.flatnonzero(widths == width)
        low = np.unpackbits(far[same].view(np.uint8).reshape(len(same), n, 4)[:, :, : (width + 7) // 8], axis=2, bitorder="little")
        for row, packed in zip(same.tolist(), np.packbits(low[:, :, :width].reshape(len(same), -1), axis=1, bitorder="little"), strict=True):
            odd = np.flatnonzero(bits[row] > width).astype("<u2")
            high = (far[row, odd].astype("<u8") >> np.uint64(width)).astype("<u4")
            out[row] = _HEAD.pack(int(least[row, 0]), n, len(odd), width) + packed.tobytes() + odd.tobytes() + high.tobytes()
    return out


def pack_block(ids: np.ndarray, percentile: float = PERCENTILE) -> bytes:
    return pack_blocks(ids[None], percentile)[0]


def unpack_blocks(data: bytes, at: int = 0, most: int | None = None) -> tuple[np.ndarray, int]:
    """The ids of the blocks from this place on, and the place after them."""
    heads = []
    while at < len(data) and (most is None or len(heads) < most):
        least, n, odd, width = _HEAD.unpack_from(data, at)
        at += _HEAD.size
        heads.append((at, n, width, least, odd))
        at += (n * width + 7) // 8 + 6 * odd
    if not heads:
        return np.zeros(0, "<u4"), at
    found = np.array(heads, np.int64)
    ends = np.cumsum(found[:, 1])
    out = np.zeros(ends[-1], "<u4")
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))  # the 8 bytes from each byte on
    for n, width in {head[1:3] for head in heads}:
        same = np.flatnonzero((found[:, 1] == n) & (found[:, 2] == width))
        size, bit = (n * width + 7) // 8, np.arange(n) * width
        far = (eight[found[same, 0][:, None] + (bit >> 3)] >> (bit & 7).astype("<u8") & np.uint64((1 << width) - 1)).astype("<u4")
        for block, ids in zip(same.tolist(), far, strict=True):
            start, _, _, least, odd = heads[block]
            where = np.frombuffer(data, "<u2", odd, start + size)
            ids[where] |= np.frombuffer(data, "<u4", odd, start + size + 2 * odd) << np.uint32(width % 32)  # at 32 bits there is none
            out[ends[block] - n : ends[block]] = ids + np.uint32(least)
    return out, at


def unpack_block(data: bytes, at: int = 0) -> tuple[np.ndarray, int]:
    """The ids of the block at this place, and the place after it."""
    return unpack_blocks(data, at, 1)


class Writer:
    """Writes documents one after the other; keeps less than a block of ids, and a row of numbers for each document."""

    def __init__(self, stream, percentile: float = PERCENTILE):
        self._out, self._percentile = stream, percentile
        self._out.write(MAGIC)
        self._at, self._rest = len(MAGIC), np.zeros(0, "<u4")
        self._blocks, self._docs, self._known, self._counts = [], [], [], []
        self.n_ids = 0

    def _write(self, ids: np.ndarray) -> None:
        for data in pack_blocks(ids, self._percentile):
            self._blocks.append(self._at)
            self._out.write(data)
            self._at += len(data)

    def add(self, docs: list[int | None], ids: list[bytes]) -> None:
        self._docs += [0 if x is None else x for x in docs]
        self._known += [x is not None for x in docs]
        self._counts += [len(x) // 4 for x in ids]
        rest = np.concatenate([self._rest, np.frombuffer(b"".join(ids), "<u4")])
        self.n_ids += len(rest) - len(self._rest)
        whole = len(rest) - len(rest) % BLOCK
        for i in range(0, whole, AT_ONCE * BLOCK):
            self._write(rest[i : min(i + AT_ONCE * BLOCK, whole)].reshape(-1, BLOCK))
        self._rest = rest[whole:].copy()

    @property
    def n_docs(self) -> int:
        return len(self._docs)

    def close(self) -> None:
        if len(self._rest):
            self._write(self._rest[None])
        for column, kind in ((self._blocks, "<u8"), (self._docs, "<i8"), (self._known, "<u1"), (self._counts, "<u8")):
            self._out.write(np.array(column, kind).tobytes())
        self._out.write(_END.pack(len(self._blocks), len(self._docs), self._at, MAGIC))
        self._out.close()


class Reader:
    """A file's document table, and ids from any document on."""

    def __init__(self, file):
        self._file = file
        size = file.seek(0, io.SEEK_END) or file.tell()
        file.seek(size - _END.size)
        n_blocks, n_docs, self._tables, magic = _END.unpack(file.read(_END.size))
        if magic != MAGIC:
            raise ValueError("not a token-id file")
        file.seek(self._tables)
        data = file.read(size - _END.size - self._tables)
        at = 0
        columns = []
        for n, kind in ((n_blocks, "<u8"), (n_docs, "<i8"), (n_docs, "<u1"), (n_docs, "<u8")):
            columns.append(np.frombuffer(data, kind, n, at))
            at += n * np.dtype(kind).itemsize
        self.blocks, docs, known, self.counts = columns
        self.docs = [int(d) if k else None for d, k in zip(docs, known, strict=True)]
        self.starts = np.concatenate([[0], np.cumsum(self.counts.astype(np.int64))])

    def read(self, first: int = 0, last: int | None = None, step: int = 256) -> Iterator[tuple[int, np.ndarray]]:
        """(document's place in the file, its ids) for documents first to last, some blocks at a time."""
        last = len(self.docs) if last is None else last
        at_block = int(self.starts[first]) // BLOCK
        have, base = np.zeros(0, "<u4"), at_block * BLOCK
        for doc in range(first, last):
            start, end = int(self.starts[doc]), int(self.starts[doc + 1])
            parts = [have[start - base :]] if start < base + len(have) else [have[:0]]
            while base + len(have) < end:
                base += len(have)
                until = min(at_block + step, len(self.blocks))
                lo, hi = int(self.blocks[at_block]), int(self.blocks[until]) if until < len(self.blocks) else self._tables
                self._file.seek(lo)
                have, at_block = unpack_blocks(self._file.read(hi - lo))[0], until
                parts.append(have[max(0, start - base) :])
            ids = np.concatenate(parts) if len(parts) > 1 else parts[0]
            yield doc, ids[: end - start]


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int | None = 2, text: str = "text", key: str = "doc_id", file_ids: int = FILE_IDS) -> DataFrame:
    """The documents' ids, in ascending order of key, as files under folder; one row for each file.

    Only the key and the text are read. A null key comes first, rows that repeat a key stand by their text's hash, a null
    text counts as empty, ill-formed UTF-8 is U+FFFD, and an empty table gives no files. Result: part, seq (the files' order), path, n_docs, n_ids. Ranges of keys are dealt to tasks by a
    sample of the keys, and rows of one key may be split among tasks. A file that a lost task leaves is in no row.
    """
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), shared.valid(text).alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("text"))
    end = b"" if end_id is None else struct.pack("<I", end_id)

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, seq, out, to = word_ids(path), TaskContext.get().partitionId(), 0, None, ""
        made = []
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                keys, texts = (batch.column(name).slice(i, ROWS).to_pylist() for name in ("doc_id", "text"))
                if out is None:
                    to = f"{folder}/part-{part:06d}-{seq:04d}-{uuid.uuid4().hex}.tqpf"
                    out = Writer(shared.open_new(to))
                out.add(keys, [encoder.ids(x) + end for x in texts])
                if out.n_ids >= file_ids:
                    out.close()
                    made.append((part, seq, to, out.n_docs, out.n_ids))
                    out, seq = None, seq + 1
        if out is not None:
            out.close()
            made.append((part, seq, to, out.n_docs, out.n_ids))
        yield pa.RecordBatch.from_pylist([dict(zip(_FILES.names, row, strict=True)) for row in made], _FILES)

    dealt = rows.repartitionByRange(F.col("doc_id"), F.col("tie")).sortWithinPartitions("doc_id", "tie")
    return shared.materialize(dealt.select("doc_id", "text").mapInArrow(write, "part int, seq int, path string, n_docs long, n_ids long"), "token-files")


def read_token_files(files: DataFrame) -> DataFrame:
    """One row for each document of the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""

    def read(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, base in zip(batch["path"], batch["base"], strict=True):
                with shared.open_old(path) as f:
                    found = Reader(f)
                    crc = []
                    done = 0
                    for doc, ids in found.read():
                        crc.append(zlib.crc32(ids.tobytes()))
                        if len(crc) == 20_000 or doc == len(found.docs) - 1:
                            to = done + len(crc)
                            yield pd.DataFrame({"doc_id": pd.array(found.docs[done:to], "Int64"), "start": found.starts[done:to] + base, "n_tokens": found.counts[done:to].astype("int64"), "ids_crc32": np.array(crc, "int64")})
                            done, crc = to, []

    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)  # a row for each file
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))
    n = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return placed.select("path", "base").repartition(n, "path").mapInPandas(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op7_token_files(spark, sf_dir: str) -> DataFrame:
    """A row for each document, read back from the files. Odd rows as in write_token_files."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(write_token_files(docs, shared.new_folder(spark, "op7"), vocabulary(), end_id=2))
