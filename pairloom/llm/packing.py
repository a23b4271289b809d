"""Best-fit packing of documents into sequences, improved by local search.

Pieces are dealt by a hash of their place into shards of about ``SHARD`` pieces
(also pieces of equal rows); a shard holds
lengths only, so its size is bounded whatever the texts are, and only the last
bins of a shard can be less than full for want of pieces. In a shard every piece
goes, longest first, to the fullest bin that still takes it. Then bins that are not
full exchange pieces: one is moved, or one goes for one, or two for one or one for
two, whenever that raises the sum of squared fills, until none that is looked at helps:
only the ``NEAR`` nearest lengths, and pairs of neighbours in length, are. Each
exchange makes a fuller bin fuller and the emptier one emptier; emptied bins go.

Defined cases: a null or empty text is one piece of its end id; a repeated row is
packed as often as it occurs; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import in_batches
from pairloom.llm.tokens import encoder
from pairloom.session import cut

SHARD = 40_000
# Distinct pieces of text that the encoder of a worker keeps. In a chain of operators the
# executor still holds what earlier ones needed, so there is less room than for encoding alone.
KEPT = 300_000
# Nearest lengths that an exchange looks at.
NEAR = 8


def pieces_of(docs: DataFrame, path: str, room: int, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, piece, start, length, ids_crc32; a longer document has its short piece first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, end = encoder(path, KEPT), np.array([end_id], np.int32)
        for batch in batches:
            rows = []
            for doc, ids in zip(batch.column(0).to_pylist(), tool.encode(batch.column(1).to_pylist()), strict=True):
                ids = np.concatenate([ids, end]).astype("<u4")
                first = (len(ids) - 1) % room + 1
                for piece, stop in enumerate(range(first, len(ids) + 1, room)):
                    start = max(0, stop - room) if piece else 0
                    rows.append((doc, piece, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=[id_col, "piece", "start", "length", "ids_crc32"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, run, f"{id_col} long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, room: int) -> list[list[int]]:
    """Longest first into the fullest bin with room; bins as lists of positions."""
    bins: list[list[int]] = []
    by_free: list[list[int]] = [[] for _ in range(room + 1)]
    open_ = 0  # bit f: some bin has f free
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        fits = open_ >> size
        if fits:
            free = size + (fits & -fits).bit_length() - 1
            b = by_free[free].pop()
            if not by_free[free]:
                open_ &= ~(1 << free)
            bins[b].append(i)
        else:
            free, b = room, len(bins)
            bins.append([i])
        by_free[free - size].append(b)
        open_ |= 1 << (free - size)
    return bins


class Search:
    """Exchanges among the bins of one shard that are not full."""

    def __init__(self, lengths: list[int], bins: list[list[int]], room: int) -> None:
        self.size, self.bins, self.room = lengths, bins, room
        self.fill = [sum(lengths[i] for i in b) for b in bins]
        self.loose = {b for b in range(len(bins)) if self.fill[b] < room}
        self.items = sorted((lengths[i], b, i) for b in self.loose for i in bins[b])

    def _shift(self, b: int, out: tuple[int, ...], into: tuple[int, ...], other: int) -> None:
        """Pieces ``out`` of bin b change places with ``into`` of the other bin."""
        for source, target, moved in ((b, other, out), (other, b, into)):
            for i in moved:
                del self.items[bisect_left(self.items, (self.size[i], source, i))]
                insort(self.items, (self.size[i], target, i))
                self.bins[source].remove(i)
                self.bins[target].append(i)
        gain = sum(self.size[i] for i in out) - sum(self.size[i] for i in into)
        self.fill[b] -= gain
        self.fill[other] += gain
        for x in (b, other):
            if self.fill[x] in (0, self.room):
                self.loose.discard(x)
                for i in self.bins[x]:
                    del self.items[bisect_left(self.items, (self.size[i], x, i))]

    def _near(self, b: int, most: int):
        """Pieces of bins at least as full as b, no longer than ``most``, longest first."""
        at, seen = bisect_left(self.items, (most + 1,)) - 1, 0
        while at >= 0 and seen < NEAR:
            size, other, i = self.items[at]
            if other != b and self.fill[other] >= self.fill[b]:
                seen += 1
                yield size, other, i
            at -= 1

    def improve(self, b: int) -> bool:
        """One exchange that empties bin b further, if there is one."""
        own = sorted(self.bins[b], key=lambda i: -self.size[i])
        for i in own:  # a move
            fit = min((x for x in self.loose if x != b and self.room - self.fill[x] >= self.size[i] and self.fill[x] >= self.fill[b]), key=lambda x: self.room - self.fill[x], default=None)
            if fit is not None:
                self._shift(b, (i,), (), fit)
                return True
        pairs = [(i, j) for k, i in enumerate(own[:NEAR]) for j in own[k + 1 : k + 1 + NEAR]]
        for out in [(i,) for i in own] + pairs:  # one or two of b for one
            total = sum(self.size[i] for i in out)
            for size, other, j in self._near(b, total - 1):
                if total - size <= self.room - self.fill[other]:
                    self._shift(b, out, (j,), other)
                    return True
        for i in own:  # one of b for two
            for size, other, j in self._near(b, self.size[i] - 1):
                free = self.room - self.fill[other]
                for k in self.bins[other]:
                    if k != j and 0 < self.size[i] - size - self.size[k] <= free:
                        self._shift(b, (i,), (j, k), other)
                        return True
        return False

    def run(self) -> list[list[int]]:
        again = True
        while again:
            again = False
            for b in sorted(self.loose, key=lambda x: self.fill[x]):
                while b in self.loose and self.improve(b):
                    again = True
        return [b for b in self.bins if b]


def pack_pieces(pieces: DataFrame, room: int, shard: int = SHARD) -> DataFrame:
    """``pieces`` (a written table with a length column) plus sequence_id and offset."""
    shards = max(1, -(-pieces.count() // shard))
    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64(*pieces.columns, F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    dealt = dealt.repartition(shards, "shard").sortWithinPartitions("shard")

    def pack(table: pa.Table) -> pa.RecordBatch:
        lengths = table.column("length").to_numpy()
        bins = Search(lengths.tolist(), best_fit(lengths, room), room).run()
        order = np.fromiter((i for b in bins for i in b), np.int64, len(lengths))
        of = np.repeat(np.arange(len(bins)), [len(b) for b in bins])
        ends = np.cumsum(lengths[order])
        first = np.flatnonzero(np.diff(of, prepend=-1))
        offset = ends - lengths[order] - (ends - lengths[order])[first][of]
        number = (table.column("shard")[0].as_py() << 32) + of
        out = table.take(pa.array(order)).drop_columns(["shard"])
        out = out.append_column("sequence_id", pa.array(number, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))
        return out.combine_chunks().to_batches()[0]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            shard_of = batch.column(batch.schema.get_field_index("shard")).to_numpy()
            starts = [0, *(np.flatnonzero(np.diff(shard_of)) + 1).tolist(), batch.num_rows] if batch.num_rows else []
            for low, high in zip(starts, starts[1:]):
                part = batch.slice(low, high - low)
                if held and held[0].column(held[0].num_columns - 1)[0] != part.column(part.num_columns - 1)[0]:
                    yield pack(pa.Table.from_batches(held))
                    held = []
                held.append(part)
        if held:
            yield pack(pa.Table.from_batches(held))

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return in_batches(dealt, run, f"{kinds}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, room: int = 2048, end_id: int = 0) -> DataFrame:
    """All documents in sequences of at most ``room`` tokens, one row per piece."""
    return pack_pieces(cut(pieces_of(docs, path, room, end_id)), room)
