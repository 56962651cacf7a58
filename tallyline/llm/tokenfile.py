"""Token-id files: patched frame-of-reference blocks.

A file is a row of frames and ends with a frame index.  A frame holds whole documents (about ``FRAME_IDS`` ids):

    magic, counts | doc ids, null flags, lengths | per block: minimum u32, width u8, exceptions u16, start u32
    | packed words | exception positions u8, exception values u32

A block is 256 ids.  Its minimum is subtracted; the width is that of the 90th percentile of the differences; ids
that need more bits have their low bits in place and their whole difference in the exception list.  Values are
packed in 8 lanes of 32, so packing and unpacking are 32 shifts over all blocks of one width.  The start index
lets one block be decoded alone (``read_block``).
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.llm.common import arrow_map, durable, fresh_dir, open_store
from tallyline.llm.tokens import encoded

BLOCK = 256
PERCENTILE = 90
FRAME_IDS = 1 << 20
MAGIC = b"TLPF"
HEAD = "<4sIQII"  # magic, documents, ids, packed words, exceptions
TAIL = "<Q4s"


def _widths(top: np.ndarray) -> np.ndarray:
    return np.where(top > 0, np.floor(np.log2(np.maximum(top, 1).astype(np.float64))) + 1, 0).astype(np.uint8)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """(blocks, 256) u32 below 2**width -> (blocks, 8 * width) u32."""
    v = values.reshape(-1, 32, 8)
    out = np.zeros((len(v), width, 8), np.uint32)
    for j in range(32):
        word, off = divmod(j * width, 32)
        out[:, word] |= v[:, j] << np.uint32(off)
        if off + width > 32:
            out[:, word + 1] |= v[:, j] >> np.uint32(32 - off)
    return out.reshape(len(v), -1)


def _unpack(words: np.ndarray, width: int) -> np.ndarray:
    w = words.reshape(-1, width, 8)
    out = np.empty((len(w), 32, 8), np.uint32)
    mask = np.uint32((1 << width) - 1)
    for j in range(32):
        word, off = divmod(j * width, 32)
        x = w[:, word] >> np.uint32(off)
        if off + width > 32:
            x = x | (w[:, word + 1] << np.uint32(32 - off))
        out[:, j] = x & mask
    return out.reshape(len(w), BLOCK)


def encode_frame(docs: list[int | None], lengths: list[int], ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    full = np.empty(blocks * BLOCK, np.uint32)
    full[:n] = ids
    full[n:] = ids[-1] if n else 0
    full = full.reshape(blocks, BLOCK)
    low = full.min(axis=1) if blocks else np.zeros(0, np.uint32)
    diff = full - low[:, None]
    at = BLOCK * PERCENTILE // 100
    width = _widths(np.partition(diff, at, axis=1)[:, at]) if blocks else np.zeros(0, np.uint8)
    limit = (np.uint64(1) << width.astype(np.uint64))[:, None]
    over = diff >= limit
    row, pos = np.nonzero(over)
    exceptions = diff[row, pos]
    counts = over.sum(axis=1).astype("<u2")
    starts = np.zeros(blocks + 1, np.int64)
    np.cumsum(width.astype(np.int64) * 8, out=starts[1:])
    words = np.zeros(int(starts[-1]), np.uint32)
    low_bits = diff & (limit - np.uint64(1)).astype(np.uint32)
    for w in np.unique(width):
        if w:
            which = np.nonzero(width == w)[0]
            words[starts[which][:, None] + np.arange(8 * int(w))] = _pack(low_bits[which], int(w))
    return b"".join((
        struct.pack(HEAD, MAGIC, len(docs), n, len(words), len(exceptions)),
        np.array([0 if d is None else d for d in docs], "<i8").tobytes(), np.array([d is None for d in docs], "u1").tobytes(), np.array(lengths, "<u4").tobytes(),
        low.astype("<u4").tobytes(), width.tobytes(), counts.tobytes(), starts[:-1].astype("<u4").tobytes(),
        words.astype("<u4").tobytes(), pos.astype("u1").tobytes(), exceptions.astype("<u4").tobytes(),
    ))


def _parts(frame: bytes):
    magic, docs, n, words, exceptions = struct.unpack_from(HEAD, frame)
    if magic != MAGIC:
        raise ValueError("not a token frame")
    blocks, at, out = -(-n // BLOCK), struct.calcsize(HEAD), []
    for kind, count in (("<i8", docs), ("u1", docs), ("<u4", docs), ("<u4", blocks), ("u1", blocks), ("<u2", blocks), ("<u4", blocks), ("<u4", words), ("u1", exceptions), ("<u4", exceptions)):
        out.append(np.frombuffer(frame, kind, count, at))
        at += out[-1].nbytes
    return n, *out


def decode_frame(frame: bytes) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """doc ids, lengths and ids of a frame."""
    n, docs, null, lengths, low, width, counts, starts, words, pos, exceptions = _parts(frame)
    diff = np.zeros((len(low), BLOCK), np.uint32)
    for w in np.unique(width):
        if w:
            which = np.nonzero(width == w)[0]
            diff[which] = _unpack(words[starts[which].astype(np.int64)[:, None] + np.arange(8 * int(w))], int(w))
    diff[np.repeat(np.arange(len(low)), counts), pos] = exceptions
    ids = (diff + low[:, None]).reshape(-1)[:n]
    return [None if z else int(d) for d, z in zip(docs, null, strict=True)], lengths, ids


def read_block(frame: bytes, block: int) -> np.ndarray:
    """The ids of one block, through the start index."""
    n, _, _, _, low, width, counts, starts, words, pos, exceptions = _parts(frame)
    w, at = int(width[block]), int(starts[block])
    diff = _unpack(words[at : at + 8 * w], w)[0] if w else np.zeros(BLOCK, np.uint32)
    e = int(counts[:block].astype(np.int64).sum())
    diff[pos[e : e + counts[block]]] = exceptions[e : e + counts[block]]
    return (diff + low[block])[: min(BLOCK, n - block * BLOCK)]


MANIFEST = "path string, first_doc long, n_docs long, n_ids long"


def write_files(docs: DataFrame, tokenizer: str, folder: str) -> DataFrame:
    """Write every document's ids, in ascending id order over all files; one row per file.

    A task writes one new file in the shared folder; only files named in the returned table count, so a task that
    runs twice leaves a file that nobody reads.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = open_store(folder)
        path = f"{root}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.tlpf"
        sink, at, index, first = None, 0, [], None
        names, lengths, chunks, held, total, count = [], [], [], 0, 0, 0

        def flush():
            nonlocal at, names, lengths, chunks, held
            frame = encode_frame(names, lengths, np.frombuffer(b"".join(chunks), "<u4"))
            sink.write(frame)
            index.append((at, len(frame)))
            at += len(frame)
            names, lengths, chunks, held = [], [], [], 0

        for doc, ids in encoded(batches, tokenizer):
            if sink is None:
                fs.create_dir(root, recursive=True)
                sink, first = fs.open_output_stream(path), doc
            names.append(doc)
            lengths.append(len(ids) // 4)
            chunks.append(ids)
            held, total, count = held + len(ids) // 4, total + len(ids) // 4, count + 1
            if held >= FRAME_IDS:
                flush()
        if sink is not None:
            if names:
                flush()
            sink.write(np.array(index, "<i8").tobytes() + struct.pack(TAIL, len(index), MAGIC))
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_doc": pa.array([first], pa.int64()), "n_docs": pa.array([count], pa.int64()), "n_ids": pa.array([total], pa.int64())})

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return durable(arrow_map(ordered, write, MANIFEST))


def frames(fs, path: str) -> Iterator[bytes]:
    """The frames of a file, one at a time."""
    with fs.open_input_file(path) as f:
        size = f.size()
        n, magic = struct.unpack(TAIL, f.read_at(struct.calcsize(TAIL), size - struct.calcsize(TAIL)))
        if magic != MAGIC:
            raise ValueError(f"not a token file: {path}")
        index = np.frombuffer(f.read_at(16 * n, size - struct.calcsize(TAIL) - 16 * n), "<i8").reshape(-1, 2)
        for at, length in index.tolist():
            yield f.read_at(length, at)


def read_files(manifest: DataFrame, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, read from the files."""
    total = F.sum("n_ids").over(Window.orderBy(F.col("first_doc").asc_nulls_first(), "path")) - F.col("n_ids")  # one row per file

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = open_store(folder)
        for batch in batches:
            for path, start in zip(batch["path"].to_pylist(), batch["start"].to_pylist(), strict=True):
                for frame in frames(fs, path):
                    docs, lengths, ids = decode_frame(frame)
                    ends = np.cumsum(lengths.astype(np.int64))
                    begins = ends - lengths
                    view = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
                    crcs = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(begins.tolist(), ends.tolist(), strict=True)]
                    yield pa.RecordBatch.from_pydict({"doc_id": pa.array(docs, pa.int64()), "start": pa.array(begins + start), "n_tokens": pa.array(lengths.astype(np.int64)), "ids_crc32": pa.array(crcs, pa.int64())})
                    start += int(ends[-1]) if len(ends) else 0

    files = manifest.select("path", total.cast("long").alias("start"))
    n = max(1, manifest.count())
    return arrow_map(files.repartition(n, "path"), read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, tokenizer: str, folder: str | None = None) -> DataFrame:
    """Write ``docs`` and read the files back.  Null text: the end id alone; repeated ids: each row for itself, in text order.

    The order is ascending by doc_id, null first.  An empty table writes no file and returns no rows.
    """
    folder = folder or fresh_dir(docs.sparkSession, "token-files")
    return read_files(write_files(docs, tokenizer, folder), folder)
