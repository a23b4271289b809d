"""MinHash near-duplicates with tensored banding.

A document is the set of its distinct word shingles. Two small collections of
``GROUPS`` hash groups, each of ``ROWS`` minima, are computed: 2 * GROUPS * ROWS
minima in all. Every pair (i, j) of a group of the first and a group of the second
collection gives one table key, so GROUPS * GROUPS tables of 2 * ROWS minima come at
about the square root of their price. With 9 and 2, two documents of similarity 0.8
share a key with probability (1 - 0.36^9)^2 = 0.9998.

Candidates are never listed as all pairs of a bucket:

1. Documents with one set are one class from the start (its smallest member stands
   for it), joined by partial aggregation.
2. In every bucket each member is compared with the smallest one; links found by
   comparing the full sets are joined to components.
3. Members that the first comparison did not join, also those whose size ruled it
   out, are compared with a second member, the smallest of another component in the
   bucket.
4. For what still meets in a bucket without being joined, a prefix filter over the
   shingles themselves, rarest first, names the pairs that can be linked at all.
   It loses no link. Texts that many share leading shingles with are taken together
   in families; blocks of them are compared inside the tasks, each text in one family,
   and only one link for two components comes out.

Rows are told apart by their place in the table that is read (not by id), so
``docs`` must come from files that do not change meanwhile.

Defined cases: a null or empty text, or one without words, has no shingle and is
linked with nothing; with fewer words than a shingle takes, all words are one
shingle; repeated rows are equal texts and so one component, of which the first
row stays; a null id is never the smallest of a component unless all are null;
an empty table gives no rows; other columns are kept by :func:`drop_near_copies`.
"""

from __future__ import annotations

import math
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.llm.common import held, hold_only, in_batches, place_in, slots
from pairloom.operators.components import contract
from pairloom.session import cut

GROUPS = 9
ROWS = 2
WORDS = 5
PERCENT = 80
# Places that are sent to every task to fetch texts; beyond, texts are joined by a shuffle.
BROADCAST_PLACES = 2_000_000
# Members of a bucket that are listed in pairs; shingles and members in a block of a family
# of larger buckets; columns of a product.
FEW = 32
BLOCK = 400_000
MEMBERS = 1500
COLUMNS = 4096
_MIX = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) > 250_000:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


_hashes = held(_Hashes())


def words_of(text: str | None) -> list[bytes]:
    """Words between white space, A-Z lower-cased."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], k: int) -> np.ndarray:
    """Distinct 64-bit numbers of all shingles, ascending."""
    if not words:
        return np.zeros(0, np.uint64)
    each = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(words) - k + 1)
    out = np.zeros(n, np.uint64)
    for j in range(min(k, len(words))):
        out = (out ^ each[j : j + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def shingles(words: list[bytes], k: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves."""
    if not words:
        return set()
    return set(zip(*(words[j:] for j in range(k)))) if len(words) >= k else {tuple(words)}


def _seeds(n: int) -> np.ndarray:
    return np.random.default_rng(7).integers(1, 1 << 63, n, np.uint64) | np.uint64(1)


def signature(hashes: np.ndarray, groups: int, rows: int) -> np.ndarray:
    """One number for each group of minima, first the one collection, then the other."""
    seeds = _seeds(2 * groups * rows)
    low = np.empty(len(seeds), np.uint64)
    for at in range(0, len(hashes), 4096):
        part = hashes[at : at + 4096]
        for i, seed in enumerate(seeds):
            mixed = (part ^ (part >> np.uint64(31))) * seed
            least = (mixed ^ (mixed >> np.uint64(32))).min()
            low[i] = least if not at else min(low[i], least)
    out = np.zeros(2 * groups, np.uint64)
    for row in low.reshape(2 * groups, rows).T:
        out = (out ^ row) * _MIX
        out ^= out >> np.uint64(31)
    return out


def sketch(docs: DataFrame, k: int, groups: int, rows: int, id_col: str, text_col: str) -> DataFrame:
    """place, doc, n_shingles, cls (digest of the set), marks (group numbers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only(_hashes)
        for batch in batches:
            n, cls, marks = [], [], []
            for text in batch.column(2).to_pylist():
                found = shingle_hashes(words_of(text), k)
                n.append(len(found))
                cls.append(xxhash.xxh128_digest(found.tobytes()) if len(found) else None)
                marks.append(signature(found, groups, rows).view(np.int64) if len(found) else None)
            cols = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(marks, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(cols, names=["place", "doc", "n_shingles", "cls", "marks"])

    rows_in = docs.select(place_in(docs).alias("place"), F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows_in, run, "place long, doc long, n_shingles long, cls binary, marks array<long>")


def table_keys(nodes: DataFrame, groups: int, *more: str) -> DataFrame:
    """One row per node and table; keys are made of one group of each collection."""
    both = [
        F.xxhash64(F.lit(i * groups + j), F.element_at("marks", i + 1), F.element_at("marks", groups + j + 1))
        for i in range(groups)
        for j in range(groups)
    ]
    return nodes.select("node", "n_shingles", *more, F.explode(F.array(*both)).alias("key"))


def _fits(a: int, b: int, percent: int) -> bool:
    """Sets of these sizes can reach the similarity at all."""
    return 100 * min(a, b) >= percent * max(a, b)


def star_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """a, b: every member of a bucket with the smallest one, each pair once. Where the
    sizes rule the pair out, both stand as pairs with themselves: they met, and what
    follows may still link them with others of the bucket."""
    dealt = keys.repartition(slots(keys.sparkSession), "key").sortWithinPartitions("key", "node").select("key", "node", "n_shingles")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # key, first node and its size, over the edge of a batch
        for batch in batches:
            if not batch.num_rows:
                continue
            key, node, n = (c.to_numpy() for c in batch.columns)
            first = np.flatnonzero(np.diff(key, prepend=key[0] - 1) != 0) if last is None or key[0] != last[0] else np.flatnonzero(np.diff(key, prepend=key[0]) != 0)
            heads = np.zeros(len(key), np.int64)
            heads[first] = 1
            heads = np.cumsum(heads)
            starts = np.concatenate([[0], first]).astype(np.int64)
            head, size = node[starts].copy(), n[starts].copy()
            if last is not None:
                head[0], size[0] = last[1], last[2]
            other = head[heads] != node
            fits = 100 * np.minimum(size[heads], n) >= percent * np.maximum(size[heads], n)
            linked, apart = other & fits, other & ~fits
            alone = np.concatenate([head[heads][apart], node[apart]])
            pairs = np.unique(np.stack([np.concatenate([head[heads][linked], alone]), np.concatenate([node[linked], alone])]), axis=1)
            last = (key[-1], head[heads[-1]], size[heads[-1]])
            yield pa.RecordBatch.from_arrays([pa.array(pairs[0]), pa.array(pairs[1])], names=["a", "b"])

    return in_batches(dealt, run, "a long, b long").distinct()


def second_star_pairs(keys: DataFrame, percent: int) -> DataFrame:
    """a, b: in buckets with several components, the smallest member outside the
    component of the first one with what follows it in other components than its own."""
    dealt = keys.repartition(slots(keys.sparkSession), "key").sortWithinPartitions("key", "node").select("key", "node", "n_shingles", "root")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = first = pivot = None
        for batch in batches:
            found = set()
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                k, other = row[0], row[1:]
                if k != key:
                    key, first, pivot = k, other, None
                elif pivot is None:
                    pivot = other if other[2] != first[2] else None
                elif other[2] != pivot[2] and _fits(other[1], pivot[1], percent):
                    found.add((pivot[0], other[0]))
            rows = np.array(sorted(found), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([pa.array(rows[:, 0]), pa.array(rows[:, 1])], names=["a", "b"])

    return in_batches(dealt, run, "a long, b long").distinct()


def residual_pairs(keys: DataFrame, docs: DataFrame, k: int, percent: int, text_col: str) -> DataFrame:
    """a, b: what may still be linked among members of buckets with several components.

    Two sets that reach the similarity share at least t = p / (100 + p) * (n_a + n_b)
    shingles, so in any common order of shingles they share one among the first
    n_a - t + 1 of the one and n_b - t + 1 of the other. With the rarest first, a text
    that was changed too much for the first comparisons leads with shingles of its
    own, and no pair comes of it. The filter loses nothing.
    """
    roots = keys.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high").select("key")
    nodes = cut(keys.join(roots, "key", "left_semi").select("node", "root", F.col("n_shingles").alias("n")).distinct())
    texts = rows_at(docs, nodes.select(F.col("node").alias("place")), F.col(text_col).cast("string").alias("text"))
    texts = texts.join(nodes.withColumnRenamed("node", "place"), "place").select("place", "root", "n", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [shingle_hashes(words_of(t), k).view(np.int64) for t in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(each, pa.list_(pa.int64()))], names=["node", "root", "n", "set"])

    sets = cut(in_batches(texts, run, "node long, root long, n long, set array<long>"))
    each = sets.select("node", "root", "n", F.explode("set").alias("s"))
    spread_of = each.groupBy("s").agg(F.count("*").alias("df"))
    rarest = Window.partitionBy("node").orderBy("df", "s")
    least = F.ceil(F.lit(percent) * F.col("n") / 100)
    lead = each.join(spread_of, "s").withColumn("pos", F.row_number().over(rarest))
    lead = cut(lead.where((F.col("pos") <= F.col("n") - least + 1) & (F.col("df") > 1)).drop("df"))
    groups = lead.groupBy("s").agg(F.count("*").alias("many"), F.min("node").alias("first"), F.min("root").alias("low"), F.max("root").alias("high"))
    groups = cut(groups.where("low <> high").select("s", "many", "first"))
    few = lead.join(groups.where(F.col("many") <= FEW).select("s"), "s")
    a, b = few.alias("a"), few.alias("b")
    t = F.ceil(F.lit(percent) * (F.col("a.n") + F.col("b.n")) / (100 + percent))
    near = (F.col("a.pos") <= F.col("a.n") - t + 1) & (F.col("b.pos") <= F.col("b.n") - t + 1)
    fits = 100 * F.least("a.n", "b.n") >= percent * F.greatest("a.n", "b.n")
    both = a.join(b, (F.col("a.s") == F.col("b.s")) & (F.col("a.node") < F.col("b.node")) & (F.col("a.root") != F.col("b.root")) & near & fits)
    pairs = both.select(F.col("a.node").alias("a"), F.col("b.node").alias("b"))
    many = lead.join(groups.where(F.col("many") > FEW).select("s", "first"), "s").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return pairs.unionByName(_linked_in_blocks(families(many), sets, percent)).distinct()


def families(meets: DataFrame) -> DataFrame:
    """node, family: members of large buckets (a; b the smallest of the bucket), buckets with
    common members taken together. Texts of one origin share many leading shingles; so
    each stands in one family, however many large buckets it is in."""
    return contract(meets.distinct(), []).select("node", F.col("root").alias("family"))


def _linked_in_blocks(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """a, b: for every two components with a link among the members of a family, one link
    (two places in other blocks may name another). ``sets``: node, root, n, set.

    A large family is parted by size, so that linked sets stand in the same band or in
    neighbouring ones, and a band is dealt into blocks of about ``BLOCK`` shingles or
    ``MEMBERS`` texts. Every two blocks that can hold a link meet in one place, where all
    their sets are compared at once by a product of 0/1 matrices, some columns at a time.
    Pairs of texts that are not linked never leave the task.
    """

    def blocks(*keys: str) -> DataFrame:
        size = F.greatest(F.ceil(F.sum("n") / BLOCK), F.ceil(F.count("*") / MEMBERS)).cast("int")
        return rows.groupBy(*keys).agg(size.alias("blocks"))

    rows = cut(members.join(sets.select("node", "n"), "node"))
    # A little wider than the similarity asks for, so that rounding moves no set by two bands.
    width = max(1.001 * math.log(100 / percent), 1e-6)
    band = F.floor(F.log(F.col("n").cast("double")) / width).cast("int")
    banded = F.when(F.col("whole") > 1, band).otherwise(0).alias("band")
    rows = cut(rows.join(blocks("family").withColumnRenamed("blocks", "whole"), "family").select("family", "node", "n", banded))
    sizes = cut(blocks("family", "band"))
    dealt = rows.join(sizes, ["family", "band"]).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    for step in (1, -1):
        beside = sizes.select("family", (F.col("band") - step).alias("band"), F.col("blocks").alias("up" if step == 1 else "down"))
        dealt = dealt.join(beside, ["family", "band"], "left")
    span = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # Places: the lower band, whether the other block is of the next band, both blocks, and the sides that a row stands on.
    own = F.transform(span("blocks"), lambda x: F.struct(
        F.col("band").alias("low"), F.lit(0).alias("next"), F.least("block", x).alias("i"), F.greatest("block", x).alias("j"),
        F.when(x == F.col("block"), 2).when(x > F.col("block"), 0).otherwise(1).alias("side"),
    ))
    above = F.transform(span("up"), lambda x: F.struct(F.col("band").alias("low"), F.lit(1).alias("next"), F.col("block").alias("i"), x.alias("j"), F.lit(0).alias("side")))
    below = F.transform(span("down"), lambda x: F.struct((F.col("band") - 1).alias("low"), F.lit(1).alias("next"), x.alias("i"), F.col("block").alias("j"), F.lit(1).alias("side")))
    none = F.array().cast("array<struct<low:int,next:int,i:int,j:int,side:int>>")
    places = F.concat(own, F.when(F.col("up").isNotNull(), above).otherwise(none), F.when(F.col("down").isNotNull(), below).otherwise(none))
    placed = dealt.select("family", "node", F.explode(places).alias("at")).select("family", "node", "at.*").join(sets, "node")
    keys = ["family", "low", "next", "i", "j"]
    placed = placed.select(*keys, "side", "node", "root", "n", "set")
    placed = placed.repartition(slots(sets.sparkSession), *keys).sortWithinPartitions(*keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            each = np.stack([batch.column(c).to_numpy() for c in keys])
            cuts = np.r_[0, np.flatnonzero((np.diff(each, axis=1) != 0).any(0)) + 1, batch.num_rows]
            for start, end in zip(cuts, cuts[1:]):
                now = tuple(each[:, start])
                if now != place and held:
                    yield _links_of(pa.Table.from_batches(held), percent)
                    held = []
                place = now
                held.append(batch.slice(start, end - start))
        if held:
            yield _links_of(pa.Table.from_batches(held), percent)

    return in_batches(placed, run, "a long, b long")


def _links_of(rows: pa.Table, percent: int) -> pa.RecordBatch:
    """One link for every two components that are linked between the two sides."""
    side, node, root, n = (rows[c].to_numpy() for c in ("side", "node", "root", "n"))
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    if not len(left) or not len(right) or (root == root[0]).all():
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 2, names=["a", "b"])
    sets = rows["set"].combine_chunks()
    owner = np.repeat(np.arange(len(node)), np.diff(sets.offsets.to_numpy()))
    column = np.unique(sets.flatten().to_numpy(), return_inverse=True)[1]
    # Only shingles of both sides, and of two texts, can be common.
    many = np.bincount(column) > 1
    for one in (0, 1):
        many &= np.bincount(column[side[owner] != 1 - one], minlength=len(many)) > 0
    shared = many[column]
    owner, column = owner[shared], np.unique(column[shared], return_inverse=True)[1]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.zeros((len(left), len(right)), np.float32)
    for first in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
        part = slice(*np.searchsorted(column, [first, first + COLUMNS]))
        ones = np.zeros((len(node), COLUMNS), np.float32)
        ones[owner[part], column[part] - first] = 1
        common += ones[left] @ ones[right].T
    linked = 100 * common >= percent * (n[left][:, None] + n[right][None, :] - common)
    x, y = np.nonzero(linked & (root[left][:, None] != root[right][None, :]))
    a, b = left[x], right[y]
    ends = np.stack([np.minimum(root[a], root[b]), np.maximum(root[a], root[b])])
    once = np.unique(ends, axis=1, return_index=True)[1]
    a, b = node[a[once]], node[b[once]]
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])


def rows_at(docs: DataFrame, places: DataFrame, *columns: Column) -> DataFrame:
    """The rows of a table at the given places (distinct, a written table)."""
    rows = docs.select(place_in(docs).alias("place"), *columns)
    few = places.count() <= BROADCAST_PLACES
    return rows.join(F.broadcast(places) if few else places, "place", "left_semi")


def confirmed(pairs: DataFrame, docs: DataFrame, k: int, percent: int, text_col: str) -> DataFrame:
    """Pairs whose full shingle sets reach the similarity."""
    pairs = cut(pairs)
    places = cut(pairs.select(F.explode(F.array("a", "b")).alias("place")).distinct())
    texts = cut(rows_at(docs, places, F.col(text_col).cast("string").alias("text")))
    left = pairs.join(texts.select(F.col("place").alias("b"), F.col("text").alias("text_b")), "b")
    both = left.join(texts.select(F.col("place").alias("a"), F.col("text").alias("text_a")), "a").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only()
        kept: OrderedDict[int, set] = OrderedDict()

        def set_of(place: int, text: str) -> set:
            if place not in kept:
                kept[place] = shingles(words_of(text), k)
                if len(kept) > 8:
                    kept.popitem(last=False)
            return kept[place]

        for batch in batches:
            sure = []
            for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = set_of(a, text_a), shingles(words_of(text_b), k)
                same = len(x & y)
                sure.append(100 * same >= percent * (len(x) + len(y) - same))
            yield batch.select(["a", "b"]).filter(pa.array(sure, pa.bool_()))

    return cut(in_batches(both, run, "a long, b long"))


def _join(roots: DataFrame, links: DataFrame) -> DataFrame:
    """Components after more links: node, root (smallest place)."""
    a, b = (roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}")) for x in ("a", "b"))
    moved = links.join(a, "a", "left").join(b, "b", "left")
    moved = moved.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")).where("a <> b").distinct()
    if moved.isEmpty():
        return roots
    up = contract(moved, []).withColumnRenamed("root", "top")
    named = up.select(F.col("node").alias("root"), "top")
    old = roots.join(named, "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = up.join(roots.select("node"), "node", "left_anti").select("node", F.col("top").alias("root"))
    return cut(old.unionByName(new))


def components(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, groups: int = GROUPS, rows: int = ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """place, doc, n_shingles, root (place of the member that stays), component
    (smallest id of the component) for every row."""
    seen = cut(sketch(docs, k, groups, rows, id_col, text_col))
    first = F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", "place"))
    classes = seen.where("cls IS NOT NULL").groupBy("cls").agg(first.alias("least"), F.first("n_shingles").alias("n_shingles"), F.first("marks").alias("marks"))
    classes = cut(classes.select("cls", F.col("least.place").alias("node"), F.col("least.doc").alias("doc"), "n_shingles", "marks"))

    stars = cut(star_pairs(table_keys(classes, groups), percent))
    pairs = stars.where("a <> b")
    met = cut(stars.select(F.explode(F.array("a", "b")).alias("node")).distinct())
    roots = _join(met.select("node", F.col("node").alias("root")), confirmed(pairs, docs, k, percent, text_col))
    for last in (False, True):
        keys = table_keys(classes.drop("doc").join(roots, "node"), groups, "root")
        more = residual_pairs(keys, docs, k, percent, text_col) if last else second_star_pairs(keys, percent)
        more = cut(more.join(pairs, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            pairs = pairs.unionByName(more)
            roots = _join(roots, confirmed(more, docs, k, percent, text_col))

    named = classes.select("cls", "node", "doc").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = named.groupBy("root").agg(F.min(F.struct(F.col("doc").isNull().alias("none"), "doc", F.col("node").alias("place"))).alias("least"))
    named = named.select("cls", "root").join(best, "root").select("cls", F.col("least.place").alias("root"), F.col("least.doc").alias("component"))
    linked = seen.where("cls IS NOT NULL").select("place", "doc", "n_shingles", "cls").join(cut(named), "cls").drop("cls")
    lone = seen.where("cls IS NULL").select("place", "doc", "n_shingles", F.col("place").alias("root"), F.col("doc").alias("component"))
    return linked.unionByName(lone)


def drop_near_copies(docs: DataFrame, k: int = WORDS, percent: int = PERCENT, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents, with all their columns, of which one of each component stays."""
    gone = cut(components(docs, k, percent, id_col=id_col, text_col=text_col).where("root <> place").select("place"))
    rows = docs.select(F.struct("*").alias("row"), place_in(docs).alias("place"))
    few = gone.count() <= BROADCAST_PLACES
    return rows.join(F.broadcast(gone) if few else gone, "place", "left_anti").select("row.*")
