"""Removal of repeated byte strings by a depth-limited radix sort of suffixes.

Only the first ``SIZE`` bytes of a suffix matter: suffixes that agree so far are a
repeated window. The first, most significant digit of a window is its minimizer,
the least hash among the ``GRAM``-byte strings in it: equal windows have equal
minimizers wherever they stand, and neighbouring windows mostly share one, so a run
of windows travels as one stretch of text instead of one row per suffix.

1. Each document lists its minimizers; those that occur in one document once and
   nowhere else cannot belong to a repeated window and go no further.
2. The stretches of the others are dealt by minimizer. Within a task's batch equal
   stretches are folded into the first before the shuffle, and the copies are marked
   at once, so a passage in a third of all documents arrives once per batch.
   Where so many documents share a minimizer that one task could not hold their
   stretches, every window travels by itself, as a digest of all its bytes, and is
   dealt by that digest: no task gathers such a minimizer.
3. A task orders the windows of its stretches digit by digit (8 bytes each, most
   significant first), and after each digit drops what stands alone. After the last
   digit, the groups are the repeated windows; all but the first of a group are marked.
   Large groups are worked through in parts by their next digit.
4. Marks are gathered per document and the bytes removed.

Rows are told apart by their place in the table that is read, so ``docs`` must come
from files that do not change meanwhile.

Defined cases: a null text counts as empty; texts shorter than a window lose
nothing; order is by id (null first), then by place, so of repeated rows the first
stays; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import binary, in_batches, place_in, slots
from pairloom.llm.near_dup import rows_at
from pairloom.session import cut

SIZE = 100
GRAM = 24
# Windows of one stretch, bytes at work at once, windows sorted at once.
STRETCH = 4096
CHUNK = 1 << 20
WINDOWS = 1 << 20
# Documents of one minimizer, beyond which its windows are dealt one by one.
HOT = WINDOWS // (SIZE - GRAM + 1)
_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))


def _at_each_byte(raw: np.ndarray, n: int, shift: int) -> np.ndarray:
    """Eight bytes from each position on as a number."""
    return np.ndarray((n,), "<u8", raw, shift, (1,)).copy()


def stretches(texts: list[bytes], size: int = SIZE, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of neighbouring windows with one minimizer: text number, start, number of
    windows, minimizer, and whether the minimizer stands more than once in the run
    (else no two of its windows can be equal)."""
    lengths = np.array([len(t) for t in texts], np.int64)
    raw = np.frombuffer(b"".join(texts) + bytes(size + 32), np.uint8)
    total = int(lengths.sum())
    none = np.zeros(0, np.int64)
    if total < size:
        return none, none, none, none.astype(np.uint64), none.astype(bool)
    grams = total - gram + 1
    h = (_at_each_byte(raw, grams, 0) * _A) ^ (_at_each_byte(raw, grams, 8) * _B)
    h ^= h >> np.uint64(29)
    h = (h + _at_each_byte(raw, grams, 16)) * _C
    h ^= h >> np.uint64(32)
    h *= _A
    h ^= h >> np.uint64(30)
    span, width, low = size - gram + 1, 1, h
    while 2 * width <= span:  # least of twice as many neighbours each time
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if span > width:
        low = np.minimum(low[: total - size + 1], low[span - width : span - width + total - size + 1])
    starts = np.cumsum(lengths) - lengths
    of = np.repeat(np.arange(len(texts)), lengths)[: len(low)]
    fits = np.arange(len(low)) + size <= (starts + lengths)[of]
    edge = np.ones(len(low), bool)
    edge[1:] = (low[1:] != low[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(edge)
    run = np.cumsum(edge) - 1
    edge |= (np.arange(len(low)) - first[run]) % STRETCH == 0
    first = np.flatnonzero(edge)
    count = np.add.reduceat(fits.astype(np.int64), first)  # windows of a run that end inside their text
    kept = count > 0
    first, count = first[kept], count[kept]
    key, along = low[first], np.arange(span)
    twice = count > span
    some = np.flatnonzero(~twice)
    left = (h[first[some, None] + along] == key[some, None]).argmax(axis=1)  # leftmost in the first window
    last = first[some] + count[some] - 1
    right = (h[last[:, None] + along[::-1]] == key[some, None]).argmax(axis=1)  # rightmost in the last
    twice[some] = first[some] + left != last + span - 1 - right
    return of[first], first - starts[of[first]], count, key, twice


def in_chunks(texts: Iterator[tuple[object, bytes]]) -> Iterator[tuple[list, list[bytes]]]:
    """Texts with what belongs to them, about ``CHUNK`` bytes at a time."""
    names, held, n = [], [], 0
    for name, text in texts:
        names.append(name), held.append(text)
        n += len(text)
        if n >= CHUNK:
            yield names, held
            names, held, n = [], [], 0
    if held:
        yield names, held


def later_copies(raw: np.ndarray, start: np.ndarray, group: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Whether an equal window of the same group stands before each window. ``raw``
    has 8 spare bytes at its end; windows come in their order."""
    alive, code = np.arange(len(start)), group.astype(np.int64)
    again = np.zeros(len(start), bool)
    for depth in range(0, size, 8):
        if not len(alive):
            return again
        at = start[alive] + depth
        digit = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))[at].astype(np.uint64)
        if size - depth < 8:
            digit >>= np.uint64(8 * (8 - size + depth))
        order = np.lexsort((digit, code))
        c, g = code[order], digit[order]
        new = np.ones(len(order), bool)
        new[1:] = (c[1:] != c[:-1]) | (g[1:] != g[:-1])
        dense = np.cumsum(new) - 1
        kept = np.bincount(dense)[dense] > 1
        alive, code, new = alive[order][kept], dense[kept], new[kept]
    again[alive[~new]] = True  # sorting is stable: the first of a group is the earliest
    return again


def minimizers(docs: DataFrame, size: int, gram: int, text_col: str) -> DataFrame:
    """place, key, twice: each minimizer of each document once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            for places, texts in in_chunks(rows):
                of, _, _, key, inner = stretches(texts, size, gram)
                order = np.lexsort((key, of))
                of, key, inner = of[order], key[order], inner[order]
                new = np.ones(len(key), bool)
                new[1:] = (key[1:] != key[:-1]) | (of[1:] != of[:-1])
                first = np.flatnonzero(new)
                twice = np.diff(np.append(first, len(key))) > 1
                if len(first):
                    twice |= np.logical_or.reduceat(inner, first)
                cols = [pa.array(np.array(places, np.int64)[of[first]]), pa.array(key[first].view(np.int64)), pa.array(twice)]
                yield pa.RecordBatch.from_arrays(cols, names=["place", "key", "twice"])

    rows = docs.select(place_in(docs).alias("place"), binary(text_col).alias("text"))
    return in_batches(rows, run, "place long, key long, twice boolean")


def shared_minimizers(found: DataFrame) -> DataFrame:
    """place, keys: those that occur more than once, per document."""
    dealt = found.repartition(slots(found.sparkSession), "key").sortWithinPartitions("key").select("key", "place", "twice")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the last row, whose key may go on in the next batch
        open_ = False
        for batch in batches:
            if not batch.num_rows:
                continue
            key, place, twice = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            if held is not None:
                key, place, twice = (np.concatenate([a, b]) for a, b in zip(held, (key, place, twice), strict=True))
            same = np.zeros(len(key), bool)
            same[1:] |= key[1:] == key[:-1]
            same[:-1] |= key[1:] == key[:-1]
            same |= twice
            same[0] |= open_
            open_ = bool(len(key) > 1 and key[-1] == key[-2]) or (len(key) == 1 and open_)
            held = (key[-1:], place[-1:], twice[-1:])
            now = same[:-1]
            yield pa.RecordBatch.from_arrays([pa.array(place[:-1][now]), pa.array(key[:-1][now])], names=["place", "key"])
        if held is not None and (open_ or held[2][0]):
            yield pa.RecordBatch.from_arrays([pa.array(held[1]), pa.array(held[0])], names=["place", "key"])

    return in_batches(dealt, run, "place long, key long").groupBy("place").agg(F.collect_list("key").alias("keys"))


_STRETCH = "key long, none boolean, doc long, place long, start long, n long, inner boolean, text binary"


def hot_minimizers(shared: DataFrame) -> np.ndarray:
    """Minimizers of more than ``HOT`` documents, ascending."""
    counts = shared.select(F.explode("keys").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return np.array(sorted(r.key for r in counts.where(F.col("n") > HOT).select("key").collect()), np.int64)


def shared_stretches(docs: DataFrame, shared: DataFrame, size: int, gram: int) -> DataFrame:
    """Stretches of shared minimizers, and single windows (with a digest as text) of hot
    ones. Copies inside a batch carry no text: they are marks already, dealt by their
    place."""
    hot = hot_minimizers(shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = sorted(zip(*(c.to_pylist() for c in batch.columns), strict=True), key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
            seen: set[bytes] = set()
            windows: set[bytes] = set()
            for names, texts in in_chunks(((r[0], r[1], r[3]), r[2]) for r in rows):
                of, start, n, key, inner = stretches(texts, size, gram)
                wanted = np.concatenate([np.array(x[2], np.int64) for x in names])
                owner = np.repeat(np.arange(len(names)), [len(x[2]) for x in names])
                # (text, key) pairs that are wanted
                both = np.concatenate([np.stack([owner, wanted]), np.stack([of, key.view(np.int64)])], axis=1)
                order = np.lexsort((both[1], both[0]))
                new = np.ones(len(order), bool)
                new[1:] = (np.diff(both[:, order], axis=1) != 0).any(axis=0)
                code = np.empty(len(order), np.int64)
                code[order] = np.cumsum(new) - 1
                keep = np.flatnonzero(np.isin(code[len(wanted) :], code[: len(wanted)]))
                out = []
                keys = key[keep].view(np.int64)
                many = np.isin(keys, hot)
                for i, at, count, k, within, heavy in zip(of[keep].tolist(), start[keep].tolist(), n[keep].tolist(), keys.tolist(), inner[keep].tolist(), many.tolist(), strict=True):
                    place, doc, _ = names[i]
                    piece = texts[i][at : at + count + size - 1]
                    digest = hashlib.blake2b(piece, digest_size=16).digest()
                    known = digest in seen
                    seen.add(digest)
                    if known or not heavy:
                        out.append((place if known else k, doc is None, doc, place, at, count, within, None if known else piece))
                        continue
                    for j in range(count):
                        mark = hashlib.blake2b(piece[j : j + size], digest_size=16).digest()
                        known = mark in windows
                        windows.add(mark)
                        own = int.from_bytes(mark[:8], "little", signed=True)
                        out.append((place if known else own, doc is None, doc, place, at + j, 1, False, None if known else mark))
                cols = list(zip(*out, strict=True)) or [()] * 8
                kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names=["key", "none", "doc", "place", "start", "n", "inner", "text"])

    return in_batches(docs.join(shared, "place").select("place", "doc", "text", "keys"), run, _STRETCH)


def repeated_stretches(found: DataFrame, size: int) -> DataFrame:
    """place, low, high: bytes covered by windows that stand earlier as well."""
    order = ["key", F.col("none").desc(), "doc", "place", "start"]
    dealt = found.repartition(slots(found.sparkSession), "key").sortWithinPartitions(*order)

    def marks_of(groups: list[list[tuple[int, int, int, bytes, bool]]]) -> Iterator[tuple[int, int, int]]:
        """Stretches of one minimizer each: place, start, windows, text."""
        rows = [r for g in groups for r in g]
        counts = np.array([r[2] for r in rows], np.int64)
        raw = np.frombuffer(b"".join(r[3] for r in rows) + bytes(8), np.uint8)
        base = np.cumsum([0, *(len(r[3]) for r in rows)])[:-1]
        of = np.repeat(np.arange(len(rows)), counts)
        inside = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
        group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])[of]
        parts = -(-len(of) // WINDOWS)
        if parts == 1:
            again = later_copies(raw, base[of] + inside, group, size)
        else:  # many windows: by their next digit, one part at a time
            head = np.ndarray((len(raw) - 7,), ">u8", raw, 0, (1,))[base[of] + inside].astype(np.uint64)
            part = ((head * _A) >> np.uint64(33)) % np.uint64(parts)
            again = np.zeros(len(of), bool)
            for p in range(parts):
                own = np.flatnonzero(part == p)
                again[own] = later_copies(raw, (base[of] + inside)[own], group[own], size)
        at = np.flatnonzero(again)
        cuts = np.flatnonzero((np.diff(at) > size) | (np.diff(of[at]) != 0)) + 1 if len(at) else []
        for run in np.split(at, cuts) if len(at) else ():
            place, start, *_ = rows[of[run[0]]]
            yield place, start + int(inside[run[0]]), start + int(inside[run[-1]]) + size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True)) or [()] * 3
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["place", "low", "high"])

        key, own, seen, groups, windows, done = None, [], set(), [], 0, []

        def close() -> None:
            nonlocal windows
            if len(own) > 1 or own and own[0][4]:  # else its copies are marked and it does not repeat itself
                groups.append(own[:])
                windows += sum(r[2] for r in own)

        for batch in batches:
            for k, _, _, place, start, n, inner, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if text is None:
                    done.append((place, start, start + n + size - 1))
                    continue
                if k != key:
                    close()
                    key, own, seen = k, [], set()
                    if windows >= WINDOWS:
                        done.extend(marks_of(groups))
                        groups, windows = [], 0
                digest = hashlib.blake2b(text, digest_size=16).digest()
                if digest in seen:
                    done.append((place, start, start + n + size - 1))
                else:
                    seen.add(digest)
                    if len(text) >= size:  # else the digest of one window, which only copies of it meet
                        own.append((place, start, n, text, inner))
            if done:
                yield out(done)
                done = []
        close()
        if groups:
            done.extend(marks_of(groups))
        yield out(done)

    return in_batches(dealt, run, "place long, low long, high long")


def remove_repeats(docs: DataFrame, size: int = SIZE, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and kept (the remaining bytes; null
    where nothing was removed) for every row."""
    shared = cut(shared_minimizers(minimizers(docs, size, gram, text_col)))
    doc, text = F.col(id_col).cast("long").alias("doc"), binary(text_col).alias("text")
    some = rows_at(docs, shared.select("place"), doc, text)
    marks = repeated_stretches(shared_stretches(some, shared, size, gram), size)
    marks = cut(marks.groupBy("place").agg(F.collect_list(F.struct("low", "high")).alias("marks")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            removed, spans, sha, kept = [], [], [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                left, end, n, parts = 0, -1, 0, []
                for low, high in sorted((m["low"], m["high"]) for m in own):
                    if low > end:
                        parts.append(text[left:low])
                        n, end = n + 1, high
                    end = max(end, high)
                    left = end
                rest = b"".join(parts) + text[left:]
                removed.append(len(text) - len(rest)), spans.append(n), sha.append(hashlib.sha256(rest).hexdigest()), kept.append(rest)
            cols = [batch.column("place"), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(sha, pa.string()), pa.array(kept, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["place", "n_removed", "n_spans", "sha", "kept"])

    hit = rows_at(docs, marks.select("place"), text).join(marks, "place")
    changed = in_batches(hit, run, "place long, n_removed long, n_spans long, sha string, kept binary")
    whole = docs.select(place_in(docs).alias("place"), doc, binary(text_col).alias("text"))
    whole = whole.select("place", "doc", F.octet_length("text").cast("long").alias("n_bytes"), F.sha2("text", 256).alias("whole"))
    zero = F.lit(0).cast("long")
    return whole.join(changed, "place", "left").select(
        F.col("doc").alias(id_col), "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"),
        F.coalesce("sha", "whole").alias("kept_sha256"), "kept",
    )
