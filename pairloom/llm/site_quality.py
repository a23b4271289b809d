"""Quality classifier: evidence of a document combined with that of its site.

1. A linear classifier over the words of a text (hashed, present or not) and over
   coarse shape marks (capitals, symbols, repetition, length) is fitted on at most
   ``train_rows`` labelled rows: a third each of good, poor and toxic ones, those with
   the smallest hash of their id. Good means quality 1 and not toxic. Its weights have
   a fixed size.
2. Every document is scored. Sums of the probabilities per path, then per host, are
   the evidence of the sites: two levels of grouped sums, combined before the
   shuffle, so a host with a third of all rows is a few rows per task.
3. Shrinkage: the spread of host means around the global mean, and of path means
   around their host's, gives the weight of each prior (method of moments). A host's
   posterior is its own sum plus the global prior, a path's its own sum plus its
   host's posterior. The document itself is left out of its path's sum.
4. A document is kept when its own log odds, moved by how far its path is from the
   global mean, reach those of ``least``.

Defined cases: a null or empty text has shape marks only; null hosts and paths are
sites of their own; a site with one document falls back to its prior; without
labelled rows of both kinds every document is kept; an empty table gives no rows;
repeated rows are judged each; labels given twice count twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import hold_only, in_batches
from pairloom.llm.quality_rules import ENDS, LETTERS, SYMBOLS, UPPER
from pairloom.session import cut

SIZE = 1 << 18
TRAIN_ROWS = 8_000
# Standard errors by which the shares of a mark in good and bad texts must differ.
TELLING = 3.5
_FOLD = bytes(b if 48 <= b < 58 or 97 <= b < 123 or b > 127 else b + 32 if 65 <= b < 91 else 32 for b in range(256))


def marks(text: str | None) -> tuple[set[bytes], int]:
    """Distinct features of a text: its words, and shape marks that no word can be."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    words = raw.translate(_FOLD).split()
    out = set(words)
    n = max(1, len(words))

    def levels(name: bytes, share: float) -> list[bytes]:
        """All steps up to a share, so that large shares weigh more."""
        return [name + b" %d" % k for k in range(min(20, int(20 * share)) + 1)]

    inside = lambda chars: len(raw) - len(raw.translate(None, chars))
    shape = [
        *levels(b"capitals", inside(UPPER) / max(1, inside(LETTERS))),
        *levels(b"symbols", inside(SYMBOLS) / n),
        *levels(b"ends", inside(ENDS) / n / 2),
        *levels(b"forms", 1 - len(out) / n),
        *levels(b"runs", sum(map(eq, words, words[1:])) / n),
        b"size %d" % len(words).bit_length(),
    ]
    return out.union(shape), len(words)


class _Weights(dict):
    """Weight of a feature, looked up by hash once."""

    def __init__(self, weights: np.ndarray) -> None:
        self.all = weights

    def __missing__(self, mark: bytes) -> float:
        if len(self) > 250_000:
            self.clear()
        value = self[mark] = float(self.all[zlib.crc32(mark) % SIZE])
        return value


def train(rows: list[tuple[bool, np.ndarray]], rounds: int = 300, decay: float = 1e-4) -> np.ndarray:
    """Weights of a logistic regression, the constant last. Both kinds count alike in
    sum, so even odds are where a good and a bad text are told apart best, whatever
    share of the labelled rows is good."""
    good = np.array([r[0] for r in rows], float)
    weights = np.zeros(SIZE + 1)
    if not 0 < good.sum() < len(good):
        return weights
    at = np.concatenate([r[1] for r in rows]).astype(np.int64)
    of = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    # only marks whose shares in the two kinds differ by more than chance
    n_good, n_bad = good.sum(), len(good) - good.sum()
    in_good, in_bad = (np.bincount(at[good[of] == k], minlength=SIZE) for k in (1, 0))
    both = (in_good + in_bad) / len(good)
    spread = np.sqrt(both * (1 - both) * (1 / n_good + 1 / n_bad))
    telling = np.abs(in_good / n_good - in_bad / n_bad) > TELLING * spread
    at, of = at[telling[at]], of[telling[at]]
    share = np.where(good > 0, 0.5 / good.sum(), 0.5 / (len(good) - good.sum()))
    mean, square = np.zeros(SIZE + 1), np.zeros(SIZE + 1)
    for step in range(1, rounds + 1):  # Adam
        odds = np.bincount(of, weights[at], len(rows)) + weights[SIZE]
        error = share * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - good)
        slope = np.bincount(at, error[of], SIZE + 1).astype(float)
        slope[SIZE] = error.sum()
        slope += decay * weights
        mean = 0.9 * mean + 0.1 * slope
        square = 0.99 * square + 0.01 * slope**2
        weights -= 0.03 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-9)
    return weights


def fit(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Weights from a bounded sample of the labelled documents."""
    toxic = F.coalesce("toxic", F.lit(0)) != 0
    kind = F.when(F.col("quality") != 1, "poor").when(toxic, "toxic").otherwise("good").alias("kind")
    known = labels.where(F.col("quality").isNotNull()).select(F.col(id_col).cast("long").alias("doc"), kind).where("doc IS NOT NULL")
    # as many rows of each kind, since bad texts are few
    each = [known.where(F.col("kind") == k).orderBy(F.xxhash64("doc"), "doc").limit(train_rows // 3) for k in ("good", "poor", "toxic")]
    chosen = each[0].unionByName(each[1]).unionByName(each[2]).select("doc", (F.col("kind") == "good").alias("good"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.array(sorted({zlib.crc32(m) % SIZE for m in marks(t)[0]}), "<i4").tobytes() for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary())], names=["good", "marks"])

    sample = texts.join(F.broadcast(chosen), "doc").select("good", "text")  # at most train_rows small rows
    rows = in_batches(sample, run, "good boolean, marks binary").orderBy(F.xxhash64("marks"), "good").limit(train_rows)
    return train([(r.good, np.frombuffer(r.marks, "<i4")) for r in rows.collect()])


def score(docs: DataFrame, weights: np.ndarray, host: Column, path: Column, text_col: str = "text", keep: bool = True) -> DataFrame:
    """``row`` (the document as it came, with ``keep``), host, path, own log odds."""
    shared = docs.sparkSession.sparkContext.broadcast(weights.astype(np.float32))
    row = F.struct("*") if keep else F.struct(F.col(text_col))
    rows = docs.select(row.alias("row"), host.cast("string").alias("host"), path.cast("string").alias("path"))
    schema = rows.select("row" if keep else F.lit(0).alias("row"), "host", "path", F.lit(0.0).alias("own")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold_only()
        look = _Weights(shared.value)
        base = float(shared.value[SIZE])
        for batch in batches:
            texts = batch.column(0).field(text_col).to_pylist()
            own = [base + sum(map(look.__getitem__, marks(t)[0])) for t in texts]
            row = batch.column(0) if keep else pa.array([0] * len(own), pa.int32())
            yield pa.RecordBatch.from_arrays([row, *batch.columns[1:3], pa.array(own, pa.float64())], names=["row", "host", "path", "own"])

    return in_batches(rows, run, schema)


def chance(odds: Column) -> Column:
    return 1 / (1 + F.exp(-F.greatest(F.least(odds, F.lit(30.0)), F.lit(-30.0))))


def log_odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _prior_weight(groups: DataFrame, around: Column) -> float:
    """How many documents a prior counts for: p(1-p) over the spread of group means
    around it, less the spread that sampling alone gives (method of moments)."""
    p = F.greatest(F.least(around, F.lit(0.999)), F.lit(0.001))
    gap = F.col("n") * (F.col("s") / F.col("n") - p) ** 2
    row = groups.agg(F.sum(gap).alias("gap"), F.sum(p * (1 - p)).alias("chance"), F.sum(F.col("n") * p * (1 - p)).alias("all"), F.sum((F.col("n") - 1) * p * (1 - p)).alias("less")).first()
    if not row["all"]:
        return 1.0
    # E[gap] = sum p(1-p) (1 + (n-1) rho), rho = 1 / (weight + 1)
    rho = (row["gap"] - row["chance"]) / row["less"] if row["less"] else 0.0
    return 1 / min(max(rho, 1e-3), 0.5) - 1


def site_levels(scored: DataFrame) -> DataFrame:
    """host, path, n, s (sum of probabilities), prior (its host's posterior), weight
    of that prior and the global mean."""
    paths = cut(scored.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum(chance(F.col("own"))).alias("s")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    total = hosts.agg(F.sum("n").alias("n"), F.sum("s").alias("s")).first()
    mean = min(max(total.s / total.n, 0.001), 0.999) if total.n else 0.5
    weight = _prior_weight(hosts, F.lit(mean))
    top = hosts.select("host", ((F.col("s") + weight * mean) / (F.col("n") + weight)).alias("prior"))
    both = paths.alias("p").join(top.alias("t"), F.col("p.host").eqNullSafe(F.col("t.host"))).select("p.host", "p.path", "p.n", "p.s", "t.prior")
    both = cut(both)
    return both.withColumn("weight", F.lit(_prior_weight(both, F.col("prior")))).withColumn("mean", F.lit(mean))


def judge(scored: DataFrame, sites: DataFrame, least: float = 0.5) -> DataFrame:
    """own (log odds of the text), site (posterior of its path without it), odds, kept."""
    a, b = scored.alias("a"), sites.alias("b")
    on = F.col("a.host").eqNullSafe(F.col("b.host")) & F.col("a.path").eqNullSafe(F.col("b.path"))
    rows = a.join(b, on).select("a.*", "b.n", "b.s", "b.prior", "b.weight", "b.mean")
    rest = F.greatest(F.col("s") - chance(F.col("own")), F.lit(0.0))
    site = (rest + F.col("weight") * F.col("prior")) / (F.col("n") - 1 + F.col("weight"))
    rows = rows.withColumn("site", F.greatest(F.least(site, F.lit(0.999)), F.lit(0.001)))
    rows = rows.withColumn("odds", F.col("own") + log_odds(F.col("site")) - log_odds(F.col("mean")))
    return rows.withColumn("kept", F.col("odds") >= float(np.log(least / (1 - least)))).drop("n", "s", "prior", "weight", "mean")


def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """id, host, path, own, site, odds, kept for every document."""
    weights = fit(docs, labels, train_rows, id_col, text_col)
    only = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(host).alias("h"), F.col(path).alias("p"), F.col(text_col).alias("t"))
    scored = score(only, weights, F.col("h"), F.col("p"), "t")
    scored = cut(scored.select(F.col("row.doc").alias(id_col), "host", "path", "own"))
    return judge(scored, site_levels(scored), least)


def keep_good(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", id_col: str = "doc_id", text_col: str = "text", least: float = 0.5, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """The documents, with all their columns, that the classifier keeps. Texts are
    scored a second time instead of being carried through a shuffle."""
    weights = fit(docs, labels, train_rows, id_col, text_col)
    sites = site_levels(score(docs, weights, F.col(host), F.col(path), text_col, keep=False))
    return judge(score(docs, weights, F.col(host), F.col(path), text_col), sites, least).where("kept").select("row.*")
