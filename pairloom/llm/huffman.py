"""Token ids in a canonical, length-limited Huffman code.

Counts of all ids are summed over all documents; their number is bounded by the
vocabulary, so the code is made on the driver (package-merge, at most ``LIMIT``
bits). Documents are dealt by ranges of their id and written in ascending order,
one file per range. A file is a header with the code lengths, then independent
blocks. A block lists its documents, the bit offset of every ``STEP``-th id
(checkpoint) and the bits. A reader starts at any checkpoint: it looks ``LIMIT``
bits up in one table that gives id and length, and does so for all checkpoints of
a block at once. The names of finished files are the rows of the result, so what
a lost task left behind is never read.

Defined cases: a null or empty text has only its end id; null document ids come
first and stay null; repeated rows are written each, equal ids in the order of
their content's hash; an empty table gives no file; other columns are not used.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window, functions as F

from pairloom.llm.common import fresh_folder, in_batches, slots
from pairloom.llm.tokens import encoder
from pairloom.session import cut

LIMIT = 16
STEP = 256
BLOCK = 1 << 18
MAGIC = b"PLHUFF01"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Bits per id, 0 for ids that never occur; least total length with at most ``limit`` bits."""
    lengths = np.zeros(len(counts), np.uint8)
    used = np.flatnonzero(counts)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError(f"{len(used)} ids need more than {limit} bits")
    order = used[np.argsort(counts[used], kind="stable")]
    weights = counts[order].astype(np.int64)
    level, leaves = weights, [np.ones(len(weights), bool)]
    for _ in range(limit - 1):
        pairs = level[: len(level) // 2 * 2].reshape(-1, 2).sum(axis=1)
        both = np.concatenate([weights, pairs])
        rank = np.argsort(both, kind="stable")
        level = both[rank]
        leaves.append(rank < len(weights))
    take = 2 * len(weights) - 2
    for leaf in reversed(leaves):
        single = int(leaf[:take].sum())
        lengths[order[:single]] += 1
        take = 2 * (take - single)
    return lengths


def codes_of(lengths: np.ndarray) -> np.ndarray:
    """Canonical codes: shorter first, then by id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    size = lengths[order].astype(np.int64)
    left = np.cumsum(np.uint64(1) << (LIMIT - size).astype(np.uint64)) - (np.uint64(1) << (LIMIT - size).astype(np.uint64))
    codes = np.zeros(len(lengths), np.uint64)
    codes[order] = left >> (LIMIT - size).astype(np.uint64)
    return codes


def lookup(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every ``LIMIT`` bits: the id that they begin with, and its length."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    room = 1 << (LIMIT - lengths[order].astype(np.int64))
    ids, sizes = np.zeros(1 << LIMIT, np.int32), np.ones(1 << LIMIT, np.int64)
    ids[: room.sum()], sizes[: room.sum()] = np.repeat(order, room), np.repeat(lengths[order], room)
    return ids, sizes


def pack(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, np.ndarray]:
    """Bits of the ids, and the bit offset of every ``STEP``-th id."""
    sizes, ids = lengths.astype(np.uint64), ids.astype(np.int64)
    size = sizes[ids]
    end = np.cumsum(size)
    begin = end - size
    words = np.zeros(int(end[-1]) // 64 + 2, np.uint64)
    # codes from the highest bit on; ids that never occur have none
    code, word, bit = (codes << ((np.uint64(64) - sizes) & np.uint64(63)))[ids], (begin >> np.uint64(6)).view(np.int64), begin & np.uint64(63)
    first = np.flatnonzero(np.diff(word, prepend=-1))
    words[word[first]] = np.bitwise_or.reduceat(code >> bit, first)
    over = np.flatnonzero(bit + size > np.uint64(64))
    words[word[over] + 1] |= code[over] << (np.uint64(64) - bit[over])
    return words.astype(">u8").tobytes(), begin[::STEP].astype("<u8")


def unpack(bits: bytes, checkpoints: np.ndarray, n: int, table: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """All ids of a block, every checkpoint a lane of its own."""
    ids, sizes = table
    # 32 bits from every 16th bit on, so that LIMIT bits from anywhere lie in one of them
    half = np.frombuffer(bits, ">u2").astype(np.uint32)
    pairs = (half << np.uint32(16)) | np.append(half[1:], np.uint32(0))
    at = checkpoints.astype(np.int64)
    seen = np.zeros((STEP, len(at)), np.uint16)
    for step in range(STEP):
        if step == n - (seen.shape[1] - 1) * STEP:  # the last lane is shorter
            at = at[:-1]
        if not len(at):
            break
        look = (pairs[at >> 4] >> (16 - (at & 15)).astype(np.uint32)).astype(np.uint16)
        seen[step, : len(at)] = look
        at = at + sizes[look]
    return ids[seen.T].ravel()[:n]


def block_bytes(docs: list[tuple[int | None, np.ndarray]], codes: np.ndarray, lengths: np.ndarray) -> bytes:
    ids = np.concatenate([x for _, x in docs])
    bits, marks = pack(ids, codes, lengths)
    names = np.array([0 if k is None else k for k, _ in docs], "<i8").tobytes()
    nulls = np.array([k is None for k, _ in docs], np.uint8).tobytes()
    sizes = np.array([len(x) for _, x in docs], "<u8").tobytes()
    head = struct.pack("<QQQQ", len(docs), len(ids), len(marks), len(bits))
    return head + names + nulls + sizes + marks.tobytes() + bits


def read_file(stream, size: Callable[[int], bytes]) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents of a file in order: id and token ids."""
    if size(8) != MAGIC:
        raise ValueError("no token file")
    (n,) = struct.unpack("<Q", size(8))
    table = lookup(np.frombuffer(zlib.decompress(size(n)), np.uint8))
    while head := size(32):
        docs, ids, marks, bits = struct.unpack("<QQQQ", head)
        names, nulls = np.frombuffer(size(8 * docs), "<i8"), np.frombuffer(size(docs), np.uint8)
        sizes, checkpoints = np.frombuffer(size(8 * docs), "<u8").astype(np.int64), np.frombuffer(size(8 * marks), "<u8")
        found, end = unpack(size(bits), checkpoints, ids, table), np.cumsum(sizes)
        for name, null, low, high in zip(names.tolist(), nulls.tolist(), (end - sizes).tolist(), end.tolist(), strict=True):
            yield None if null else name, found[low:high]


def tokenize(docs: DataFrame, path: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc, width, ids (little-endian numbers of ``width`` bytes with the end id) of every
    document, and a row for each task with the counts of all its ids (little-endian 64-bit
    numbers, by id; null in rows of documents)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(path), np.array([end_id], np.int32)
        kind = np.dtype("<u2" if max(tool.size, end_id) < 1 << 16 else "<u4")
        total = np.zeros(max(tool.size, end_id + 1), np.int64)

        def batch_of(docs: pa.Array, ids: list, counts: list) -> pa.RecordBatch:
            width = pa.array([kind.itemsize] * len(docs), pa.int32())
            return pa.RecordBatch.from_arrays([docs, width, pa.array(ids, pa.binary()), pa.array(counts, pa.binary())], names=["doc", "width", "ids", "counts"])

        for batch in batches:
            ids = []
            for found in tool.encode(batch.column(1).to_pylist()):
                ids.append(np.concatenate([found, end]).astype(kind).tobytes())
            total += np.bincount(np.frombuffer(b"".join(ids), kind), minlength=len(total))
            yield batch_of(batch.column(0), ids, [None] * len(ids))
        if total.any():
            yield batch_of(pa.array([None], pa.int64()), [None], [total.astype("<i8").tobytes()])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, run, "doc long, width int, ids binary, counts binary")


def id_counts(tokens: DataFrame) -> dict[int, int]:
    """How often each id occurs in all documents; at most one entry per id of the vocabulary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for raw in batch.column(0):
                part = np.frombuffer(raw.as_buffer(), "<i8").copy()
                part[: len(total)] += total
                total = part
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int64()), pa.array(total[used], pa.int64())], names=["id", "n"])

    rows = in_batches(tokens.where("counts IS NOT NULL").select("counts"), run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    return {r.id: r.n for r in rows.collect()}


def write_files(tokens: DataFrame, lengths: np.ndarray, folder: str) -> DataFrame:
    """Result per file: file, low (its first document), n_docs, n_tokens, slot in ascending order."""
    codes, packed = codes_of(lengths), zlib.compress(lengths.tobytes())
    rows = tokens.where("counts IS NULL").withColumn("tie", F.xxhash64("ids")).repartitionByRange(slots(tokens.sparkSession), "doc", "tie").sortWithinPartitions("doc", "tie")
    rows = rows.select("doc", "width", "ids", F.spark_partition_id().alias("slot"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        out, name, docs, held, count, tokens, slot = None, f"{uuid.uuid4().hex}.tok", [], 0, 0, 0, 0
        for batch in batches:
            for doc, width, raw, slot in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(posixpath.join(root, name), compression=None)
                    out.write(MAGIC + struct.pack("<Q", len(packed)) + packed)
                docs.append((doc, np.frombuffer(raw, f"<u{width}")))
                held += len(docs[-1][1])
                count, tokens = count + 1, tokens + len(docs[-1][1])
                if held >= BLOCK:
                    out.write(block_bytes(docs, codes, lengths))
                    docs, held = [], 0
        if out is not None:
            if docs:
                out.write(block_bytes(docs, codes, lengths))
            out.close()
            cols = [pa.array([name]), pa.array([slot], pa.int32()), pa.array([count], pa.int64()), pa.array([tokens], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["file", "slot", "n_docs", "n_tokens"])

    return in_batches(rows, run, "file string, slot int, n_docs long, n_tokens long")


def read_files(files: DataFrame, folder: str, id_col: str = "doc_id", ids: bool = True) -> DataFrame:
    """One row per document: id, start (ids of all documents before), n_tokens,
    ids_crc32 over 32-bit little-endian ids and, with ``ids``, the ids."""
    before = Window.orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    places = files.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    places = places.repartition(slots(files.sparkSession), "file")
    schema = pa.schema([(id_col, pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            for name, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows, held = [], 0
                with store.open_input_stream(posixpath.join(root, name), compression=None, buffer_size=1 << 20) as stream:
                    for doc, found in read_file(stream, stream.read):
                        rows.append((doc, start, len(found), zlib.crc32(found.astype("<u4").tobytes()), found if ids else None))
                        start, held = start + len(found), held + (len(found) if ids else 1)
                        if held >= 1 << 16:
                            yield batch_of(rows)
                            rows, held = [], 0
                if rows:
                    yield batch_of(rows)

    out = in_batches(places, run, f"{id_col} long, start long, n_tokens long, ids_crc32 long, ids array<int>")
    return out if ids else out.drop("ids")


def token_round_trip(docs: DataFrame, path: str, end_id: int = 2) -> DataFrame:
    """Encode, count, write all files, read them back."""
    folder = fresh_folder(docs.sparkSession, "tokens")
    tokens = cut(tokenize(docs, path, end_id))
    counts = id_counts(tokens)
    dense = np.zeros(max(counts, default=0) + 1, np.int64)
    for k, n in counts.items():
        dense[k] = n
    return read_files(cut(write_files(tokens, code_lengths(dense), folder)), folder, ids=False)
