"""Benchmark decontamination by suffix arrays of the training texts.

Every task builds suffix arrays over shards of its own documents: words are
numbered by a 16-bit hash, four words make one 64-bit digit, and the suffixes of a
shard are sorted by their first digit. Test suffixes (windows of the items) are
looked up by binary search; within the range found the later digits decide, and
the words themselves are compared at the end, so hashing loses and adds nothing.
Neighbouring matches of one item are joined to longest verbatim matches.

Items are worked through in blocks of about ``BLOCK`` words, one broadcast each;
texts are neither shuffled nor collected. A passage found in a third of all
documents costs each of them its own matches and nothing else.

Defined cases: a null text, or one without words, has no words and no match; an
item without words has no window; items with equal ids count once, a null id as
the empty name; repeated rows are judged each; empty tables give no rows or no
matches; other columns are kept by :func:`remove_contaminated` and not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import held, hold_only, in_batches, place_in

WINDOW = 13
BLOCK = 1_000_000
SHARD = 1 << 20
DIGIT = 4
# Lower-case words of digits, letters and everything beyond ASCII; the rest becomes a space.
_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


class _Numbers(dict):
    """Words as numbers from 1 to 65535."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        number = self[word] = zlib.crc32(word) % 65535 + 1
        return number


_numbers = held(_Numbers())


def _number(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_numbers.__getitem__, words), np.uint64, len(words))


def _digit(numbers: np.ndarray, start: np.ndarray, n: int = DIGIT) -> np.ndarray:
    """``n`` words from each start as one number; ``numbers`` ends in enough zeros."""
    out = np.zeros(len(start), np.uint64)
    for k in range(n):
        out = (out << np.uint64(16)) | numbers[start + k]
    return out


class Windows:
    """The distinct windows of a block of items, and where each comes from."""

    def __init__(self, items: list[tuple[str, str]], size: int = WINDOW) -> None:
        found: dict[tuple[bytes, ...], list[tuple[str, int]]] = {}
        for item, text in items:
            words = words_of(text)
            for at in range(max(1, len(words) - size + 1) if words else 0):
                found.setdefault(tuple(words[at : at + size]), []).append((item, at))
        self.words, self.places = list(found), list(found.values())
        self.numbers = [_number(list(w)) for w in self.words]


class SuffixArray:
    """Suffixes of a shard of texts in the order of their first digit."""

    def __init__(self, texts: list[list[bytes]], size: int) -> None:
        self.words = [w for t in texts for w in [*t, b""]]  # an empty word between texts matches nothing
        numbers = _number(self.words)
        self.starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        numbers[self.starts[1:] - 1] = 0
        self.numbers = np.concatenate([numbers, np.zeros(size + DIGIT, np.uint64)])
        first = _digit(self.numbers, np.arange(len(numbers)))
        self.order = np.argsort(first)
        self.first = first[self.order]

    def find(self, windows: Windows) -> Iterator[tuple[int, np.ndarray]]:
        """For each window that occurs: its number and all places."""
        heads = [w[:DIGIT] for w in windows.numbers]
        short = [16 * (DIGIT - len(h)) for h in heads]
        low = np.array([sum(int(x) << (16 * (DIGIT - 1 - k)) for k, x in enumerate(h)) for h in heads], np.uint64)
        high = low | np.array([(1 << s) - 1 for s in short], np.uint64)
        begin, end = np.searchsorted(self.first, low, "left"), np.searchsorted(self.first, high, "right")
        for k in np.flatnonzero(end > begin).tolist():
            at, numbers, words = self.order[begin[k] : end[k]], windows.numbers[k], list(windows.words[k])
            for depth in range(DIGIT, len(numbers)):
                at = at[self.numbers[at + depth] == numbers[depth]]
                if not len(at):
                    break
            at = np.array([i for i in at.tolist() if self.words[i : i + len(words)] == words], np.int64)
            if len(at):
                yield k, at


def _joined(hits: list[tuple[str, int, int, int]]) -> list[dict]:
    """Longest verbatim matches: hits one word apart in both texts run on."""
    runs: dict[tuple[str, int], list[list[int]]] = {}
    for item, at_item, at_doc, n in sorted(hits, key=lambda h: (h[0], h[2] - h[1], h[2])):
        own = runs.setdefault((item, at_doc - at_item), [])
        if own and own[-1][0] + own[-1][1] - n + 1 == at_doc:
            own[-1][1] += 1
        else:
            own.append([at_doc, n])
    return [{"item": item, "item_word": at - shift, "doc_word": at, "n_words": n} for (item, shift), own in runs.items() for at, n in own]


def match_texts(texts: list[str | None], windows: Windows, size: int) -> Iterator[tuple[int, list[dict]]]:
    """Number of words and longest matches of each text."""

    def shard(held: list[list[bytes]]) -> Iterator[tuple[int, list[dict]]]:
        hits: dict[int, list[tuple[str, int, int, int]]] = {}
        array = SuffixArray(held, size)
        for k, places in array.find(windows):
            of = np.searchsorted(array.starts, places, "right") - 1
            for doc, at in zip(of.tolist(), (places - array.starts[of]).tolist(), strict=True):
                hits.setdefault(doc, []).extend((item, pos, at, len(windows.words[k])) for item, pos in windows.places[k])
        for doc, words in enumerate(held):
            yield len(words), _joined(hits.get(doc, []))

    held, n = [], 0
    for text in texts:
        held.append(words_of(text))
        n += len(held[-1]) + 1
        if n >= SHARD:
            yield from shard(held)
            held, n = [], 0
    if held:
        yield from shard(held)


def find_matches(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """``row`` (the document as it came), n_words and matches: item, item_word,
    doc_word, n_words of every longest verbatim match of at least ``size`` words
    (or of a whole shorter item)."""
    spark = docs.sparkSession
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("")).alias("item"), F.col(item_text).cast("string").alias("text")).where("text IS NOT NULL")
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // (5 * block)))
    rows = docs.select(F.struct("*").alias("row"))
    schema = docs.select(F.struct("*").alias("row"), F.lit(0).cast("long").alias("n_words"), F.lit(None).cast("array<struct<item:string,item_word:int,doc_word:int,n_words:int>>").alias("matches")).schema
    matches_type = pa.list_(pa.struct([("item", pa.string()), ("item_word", pa.int32()), ("doc_word", pa.int32()), ("n_words", pa.int32())]))

    def against(own: list[tuple[str, str]], rows: DataFrame, schema) -> DataFrame:
        shared, named = spark.sparkContext.broadcast(own), "place" if "place" in rows.columns else "row"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hold_only(_numbers)
            windows = Windows(shared.value, size)
            for batch in batches:
                if batch.num_rows:
                    rows = batch.column("row")
                    n, matches = zip(*match_texts(rows.field(text_col).to_pylist(), windows, size), strict=True)
                    kept = batch.column("place") if "place" in batch.schema.names else rows
                    yield pa.RecordBatch.from_arrays([kept, pa.array(n, pa.int64()), pa.array(matches, matches_type)], schema=pa.schema([(named, kept.type), ("n_words", pa.int64()), ("matches", matches_type)]))

        return in_batches(rows, run, schema)

    def items_of(k: int) -> list[tuple[str, str]]:
        return [(r.item, r.text) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == k).distinct().collect()]

    if blocks == 1:
        return against(items_of(0), rows, schema)
    rows = rows.withColumn("place", place_in(docs))
    parts = docs.select(F.struct(text_col).alias("row"), place_in(docs).alias("place"))
    small = "place long, n_words long, matches array<struct<item:string,item_word:int,doc_word:int,n_words:int>>"
    found = None
    for k in range(blocks):
        part = against(items_of(k), parts, small)
        found = part if found is None else found.unionByName(part)
    found = found.groupBy("place").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("matches")).alias("matches"))
    return rows.join(found, "place").drop("place")


def judge(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items (sorted as strings) and contaminated from the matches."""
    marks = F.array_sort(F.transform("matches", lambda m: F.struct(m.doc_word.alias("low"), (m.doc_word + m.n_words).alias("high"))))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))
    covered = F.aggregate(
        marks,
        start,
        lambda acc, m: F.struct(
            (acc.n + F.greatest(F.lit(0), m.high - F.greatest(m.low, acc.end))).alias("n"), F.greatest(acc.end, m.high).alias("end")
        ),
        lambda acc: acc.n.cast("long"),
    )
    items = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m.item)))
    out = found.withColumn("n_hit", covered).withColumn("items", items).withColumn("n_items", F.size("items").cast("long"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents, with all their columns, that are not contaminated."""
    return judge(find_matches(docs, benchmark, text_col)).where("NOT contaminated").select("row.*")

