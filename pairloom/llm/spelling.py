"""Spelling variants: words one letter apart, found in a trie of letter counts.

Every word is written as the counts of its letters, group by group (``GROUPS``: one
group for each letter from a to z, frequent ones first, and one for all others). The
trie starts with the length and branches on one count after the other. One inserted
letter raises one count by one, a replaced letter raises one and lowers another (or
none, inside a group), so a search from the root down has a surplus of one and a
deficit of one to spend; what it reaches is verified letter by letter.

The trie is dealt over the tasks by its nodes: a node holds at most ``shard`` letters,
or is opened ``STEP`` counts further (rounds of joins with the nodes that exist, so
no list of nodes is sent around); where all counts are used up, its words are dealt
into parts and the searches go to each part. Inside a node the search goes on in
numpy, depth first in blocks of bounded size.

Each pair is found once, from the shorter word (of equal lengths, from the smaller).

Defined cases: a null or empty text has no words; a null id is written as nothing in
the number that decides on a slip; a repeated row counts again; an empty table gives
no rows; other columns are not read. Very long texts are counted in one pass, very
long words compared in blocks.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.llm.common import in_batches, slots
from pairloom.session import cut

SHORTEST = 5
LEAST = 3
SLIP = 97
SHARD = 250_000
STEP = 2
# Letters by how common they are in European languages; every other letter is in one last group.
GROUPS = "etanisrholducmgpfbvwykzxjq"
_WIDTH = len(GROUPS) + 1
_HELD = 200_000
_BLOCK = 200_000

# Latin-1 bytes: A-Z to a-z, letters from C0 on stay, all else to a space.
_LETTERS = bytes(
    b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 0xC0 else 32 for b in range(256)
)
_GROUP_OF = np.full(256, len(GROUPS), np.int64)
_GROUP_OF[[ord(c) for c in GROUPS]] = np.arange(len(GROUPS))


def runs_of(text: str | None) -> list[bytes]:
    """Runs of letters in Latin-1, A-Z lower-cased."""
    return (text or "").encode("latin-1", "replace").translate(_LETTERS).split()


def slipped(run: bytes, head: int) -> bytes:
    """The run, without one letter where the number of document and run says so."""
    h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
    if h % SLIP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """word, n over all texts, for words of at least ``shortest`` letters."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def rows() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(held.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                head = zlib.crc32(f"{'' if doc is None else doc}:".encode())
                for word, n in Counter(runs_of(text)).items():
                    held[slipped(word, head)] += n
            if len(held) > _HELD:
                yield rows()
                held.clear()
        yield rows()

    rows = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    long_enough = in_batches(rows, run, "word string, n long").where(F.length("word") >= shortest)
    return long_enough.groupBy("word").agg(F.sum("n").alias("n"))


# The trie ------------------------------------------------------------------


def letter_counts(words: list[bytes]) -> np.ndarray:
    """One row per word, one column per group; counts above 255 stop there (a word that
    long is still found: the same letters stop alike on both sides, or differ by one)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    row = np.repeat(np.arange(len(words)), lengths)
    group = _GROUP_OF[np.frombuffer(b"".join(words), np.uint8)]
    counts = np.bincount(row * _WIDTH + group, minlength=len(words) * _WIDTH)
    return np.minimum(counts, 255).reshape(len(words), _WIDTH).astype(np.uint8)


def _coded(words: DataFrame) -> DataFrame:
    """word, n, len, counts (one byte per group)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            letters = [w.encode("latin-1") for w in batch.column("word").to_pylist()]
            counts = [c.tobytes() for c in letter_counts(letters)]
            columns = [*batch.columns, pa.array([len(x) for x in letters], pa.int32()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "len", "counts"])

    return in_batches(words.select("word", "n"), run, "word string, n long, len int, counts binary")


def _opened(asks: DataFrame, depth: int) -> DataFrame:
    """Searches one step further down: every combination of the next counts that the
    budget allows. In and out: word, n, len, counts, size (length searched for), node
    (counts so far), plus, minus (what is left to spend)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, nodes, plus, minus = [], [], [], []
            rows = zip(*(batch.column(c).to_pylist() for c in ("counts", "node", "plus", "minus")), strict=True)
            for i, (counts, node, p, m) in enumerate(rows):
                for step, p_left, m_left in _steps(counts[depth : depth + STEP], p, m):
                    at.append(i)
                    nodes.append(node + step)
                    plus.append(p_left)
                    minus.append(m_left)
            own = batch.select(["word", "n", "len", "counts", "size"]).take(pa.array(at, pa.int64()))
            columns = [*own.columns, pa.array(nodes, pa.binary()), pa.array(plus, pa.int32()), pa.array(minus, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=["word", "n", "len", "counts", "size", "node", "plus", "minus"])

    return in_batches(asks, run, "word string, n long, len int, counts binary, size int, node binary, plus int, minus int")


def _steps(counts: bytes, plus: int, minus: int) -> list[tuple[bytes, int, int]]:
    """Counts within the budget of ``counts``, with the budget that is left."""
    found = [(b"", plus, minus)]
    for c in counts:
        longer = []
        for node, p, m in found:
            longer.append((node + bytes([c]), p, m))
            if p and c < 255:
                longer.append((node + bytes([c + 1]), p - 1, m))
            if m and c > 0:
                longer.append((node + bytes([c - 1]), p, m - 1))
        found = longer
    return found


def near_words(words: DataFrame, shard: int = SHARD) -> DataFrame:
    """a, b, n_a, n_b: every pair of words that differ by one letter put in, left out
    or replaced, once. ``words``: word, n; distinct words of Latin-1 letters."""
    left = cut(_coded(words).withColumn("node", F.lit(b"")))
    same = left.select("*", F.col("len").alias("size"), F.lit(1).alias("plus"), F.lit(1).alias("minus"))
    longer = left.select("*", (F.col("len") + 1).alias("size"), F.lit(1).alias("plus"), F.lit(0).alias("minus"))
    asks = same.unionByName(longer)
    found = None
    for depth in range(0, _WIDTH, STEP):
        left = cut(left.withColumn("node", F.substring("counts", 1, min(depth + STEP, _WIDTH))))
        nodes = left.groupBy("len", "node").agg(F.sum(F.col("len").cast("long")).alias("letters"))
        nodes = cut(nodes.withColumnRenamed("len", "size"))
        last = depth + STEP >= _WIDTH
        whole = F.lit(True) if last else F.col("letters") <= shard
        parts = F.greatest(F.ceil(F.col("letters") / shard), F.lit(1)).cast("int")
        closed = nodes.where(whole).select("size", "node", parts.alias("parts"))
        asks = _opened(asks, depth)
        here = asks.join(closed, ["size", "node"])
        home = left.withColumnRenamed("len", "size").join(closed, ["size", "node"])
        pairs = cut(_searched(home, here, depth + STEP))
        found = pairs if found is None else found.unionByName(pairs)
        more = nodes.where(~whole).select("size", "node")
        if last or more.isEmpty():
            return found
        asks = cut(asks.join(more, ["size", "node"], "left_semi"))
        left = cut(left.join(more.withColumnRenamed("size", "len"), ["len", "node"], "left_semi"))
    return found


def _searched(home: DataFrame, asks: DataFrame, depth: int) -> DataFrame:
    """Pairs inside the nodes of one depth: the words of a part, then the searches."""
    part = F.pmod(F.xxhash64("word"), F.col("parts")).cast("int")
    kept = home.select(
        "size", "node", part.alias("part"), F.lit(0).alias("kind"), "word", "n", "counts", F.lit(0).alias("plus"), F.lit(0).alias("minus")
    )
    sent = asks.select(
        "size", "node", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(1).alias("kind"), "word", "n", "counts", "plus", "minus"
    )
    rows = kept.unionByName(sent).repartition(slots(home.sparkSession), "size", "node", "part")
    rows = rows.sortWithinPartitions("size", "node", "part", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, words, trie = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("size", "node", "part", "kind")), strict=True))
            cuts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for start, end in zip(cuts, cuts[1:]):
                if keys[start][:3] != key:
                    key, words, trie = keys[start][:3], [], None
                piece = batch.slice(start, end - start)
                if keys[start][3] == 0:
                    words.append(piece.select(["word", "n", "counts"]))
                elif words:
                    trie = trie or Trie(pa.Table.from_batches(words), depth)
                    yield from trie.search(piece)

    return in_batches(rows, run, "a string, b string, n_a long, n_b long")


class Trie:
    """The words of one node, which all have one length, below their first ``depth`` counts."""

    def __init__(self, rows: pa.Table, depth: int):
        self.depth = depth
        self.size = len(rows["word"][0].as_py())
        counts = _matrix(rows["counts"], _WIDTH)
        letters = _matrix(pa.array([w.encode("latin-1") for w in rows["word"].to_pylist()]), self.size)
        order = np.lexsort(counts.T[::-1]) if len(counts) else np.zeros(0, np.int64)
        self.letters, self.n = letters[order], rows["n"].to_numpy()[order]
        counts = counts[order]
        # Level k: the first row of each node, its last count, and its first child on level k + 1.
        self.rows, self.count, self.child = [np.array([0, len(counts)])], [np.zeros(1, np.int64)], []
        fresh = np.zeros(len(counts), bool)
        fresh[:1] = True
        for k in range(depth, _WIDTH):
            fresh[1:] |= counts[1:, k] != counts[:-1, k]
            first = np.flatnonzero(fresh)
            self.child.append(np.searchsorted(first, self.rows[-1]))
            self.rows.append(np.append(first, len(counts)))
            self.count.append(counts[first, k].astype(np.int64))

    def search(self, asks: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        """Depth first over blocks of searches; a block that would grow too large is halved."""
        counts = _matrix(asks.column("counts"), _WIDTH).astype(np.int64)
        words = [w.encode("latin-1") for w in asks.column("word").to_pylist()]
        n = asks.column("n").to_numpy()
        plus, minus = (asks.column(c).to_numpy() for c in ("plus", "minus"))
        who = np.arange(len(words))
        stack = [(0, who, np.zeros(len(who), np.int64), plus, minus)]
        while stack:
            level, who, node, plus, minus = stack.pop()
            bounds = self.rows[level] if level == len(self.child) else self.child[level]
            many = bounds[node + 1] - bounds[node]
            weight = int(many.sum()) * (self.size if level == len(self.child) else 1)
            if weight > _BLOCK and len(who) > 1:
                half = len(who) // 2
                stack += [(level, *(x[part] for x in (who, node, plus, minus))) for part in (slice(half, None), slice(half))]
                continue
            rep = np.repeat(np.arange(len(who)), many)
            at = np.arange(len(rep)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(bounds[node], many)
            if level == len(self.child):
                yield from self._verified(words, n, who[rep], at)
                continue
            more = self.count[level + 1][at] - counts[who[rep], self.depth + level]
            plus, minus = plus[rep] - (more == 1), minus[rep] - (more == -1)
            keep = (np.abs(more) <= 1) & (plus >= 0) & (minus >= 0)
            if keep.any():
                stack.append((level + 1, who[rep][keep], at[keep], plus[keep], minus[keep]))

    def _verified(self, words: list[bytes], n: np.ndarray, who: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
        step = max(1, 4 * _BLOCK // self.size)
        for i in range(0, len(who), step):
            w, t = who[i : i + step], at[i : i + step]
            other = self.letters[t]
            own = np.frombuffer(b"".join(words[x].ljust(self.size, b"\0") for x in w), np.uint8).reshape(len(w), self.size)
            shorter = np.array([len(words[x]) < self.size for x in w], bool)
            alike = own == other
            # A longer word: what agrees from the front and what agrees from the back, one on, leave one letter.
            front = np.where(alike.all(1), self.size, alike.argmin(1))
            moved = own[:, :-1] == other[:, 1:]
            back = np.where(moved.all(1), self.size - 1, moved[:, ::-1].argmin(1))
            one_more = shorter & (front + back >= self.size - 1)
            differing = self.size - alike.sum(1)
            spot = np.minimum(front, self.size - 1)
            rows = np.arange(len(w))
            replaced = ~shorter & (differing == 1) & (own[rows, spot] < other[rows, spot])
            good = np.flatnonzero(one_more | replaced)
            if len(good):
                a = pa.array([words[x].decode("latin-1") for x in w[good]], pa.string())
                b = pa.array([x.tobytes().decode("latin-1") for x in other[good]], pa.string())
                yield pa.RecordBatch.from_arrays([a, b, pa.array(n[w[good]]), pa.array(self.n[t[good]])], names=["a", "b", "n_a", "n_b"])


def _matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


# Forms ---------------------------------------------------------------------


def roots_of(forms: DataFrame) -> DataFrame:
    """word, root: the end of the chain word, form, form of the form, ... for words that
    have a form. Pointers double each round; words whose pointer stands at an end leave."""
    chain = cut(forms.where("form IS NOT NULL").select("word", F.col("form").alias("at")))
    done = None
    while True:
        ahead = chain.select(F.col("word").alias("at"), F.col("at").alias("next"))
        if done is not None:
            ahead = ahead.unionByName(done.select(F.col("word").alias("at"), F.col("root").alias("next")))
        joined = cut(chain.join(ahead, "at", "left"))
        ended = joined.where("next IS NULL").select("word", F.col("at").alias("root"))
        done = ended if done is None else done.unionByName(ended)
        chain = joined.where("next IS NOT NULL").select("word", F.col("next").alias("at"))
        if chain.isEmpty():
            return done
        done = cut(done)


def spelling_variants(docs: DataFrame, least: int = LEAST, shard: int = SHARD, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST) -> DataFrame:
    """word, n, n_near, form, form_n, root for every word of ``shortest`` letters and
    ``least`` occurrences. The form is the most frequent near word (ties: the smallest)
    where it is at least twice as frequent; the root is the last of the chain of forms."""
    words = cut(word_counts(docs, id_col, text_col, shortest).where(F.col("n") >= least))
    pairs = near_words(words, shard)
    sides = pairs.select(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("m")).unionByName(
        pairs.select(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("m"))
    )
    best = sides.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("m")).alias("m"), "other")).alias("best"))
    known = words.join(best, "word", "left")
    takes = -F.col("best.m") >= 2 * F.col("n")
    known = cut(
        known.select(
            "word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"),
            F.when(takes, F.col("best.other")).alias("form"), F.when(takes, -F.col("best.m")).alias("form_n"),
        )
    )
    return known.join(roots_of(known), "word", "left").withColumn("root", F.coalesce("root", "word"))
