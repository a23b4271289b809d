"""Quality rules by weak supervision.

Each rule looks at counts of one text and votes good, bad or abstains. How far a
rule can be trusted is not set by hand: expectation-maximisation over how often
each combination of votes occurs estimates the share of good texts and, for both
kinds of text, how often each rule is right when it votes. A text's posterior
probability of being good then follows from its votes. Only the table of vote
combinations reaches the driver, at most 3 to the number of rules rows.

Defined cases: a null text counts as empty; a text without words has all counts 0
and fails the base rules; an empty table gives no rows; repeated rows are judged
each; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import in_batches
from pairloom.session import cut

WHITE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LETTERS = UPPER + bytes(range(97, 123)) + bytes(range(0xC2, 0xF5))  # leading bytes beyond ASCII count as letters
ENDS = b".!?"
# Everyday words of four languages.
EVERYDAY = frozenset(
    "the of and to in is that it for was on with as are be by this at or from a an not have"
    " le la les de des du et en un une que qui dans pour est sur par au il elle on ne pas"
    " der die das und zu den von mit auf ist ein eine für im dem nicht sich des er sie es"
    " el los las y del se por con para su al lo como más o".encode().split()
)
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_upper", "n_everyday", "n_ends", "n_forms")
WINDOW = 5


def repeated_words(words: list[bytes], size: int = WINDOW) -> int:
    """Words inside windows of ``size`` words that occur twice or more, the first included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    known: dict[bytes, int] = {}
    ids = np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))
    base, code, top = len(known), ids[:n], len(known)
    for k in range(1, size):  # numbers that are equal exactly where the windows are
        if top * base >= 1 << 62:
            found, code = np.unique(code, return_inverse=True)
            top = len(found)
        code, top = code * base + ids[k : k + n], top * base
    _, at, count = np.unique(code, return_inverse=True, return_counts=True)
    step = np.zeros(len(words) + 1, np.int64)
    twice = np.flatnonzero(count[at] > 1)
    step[twice] += 1
    step[twice + size] -= 1
    return int(np.count_nonzero(np.cumsum(step[:-1])))


def counts_of(text: str | None) -> tuple[int, ...]:
    """The numbers named in ``COUNTS`` for one text."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [x for x in raw.split(b"\n") if x.strip(WHITE)]
    without = lambda chars: len(raw) - len(raw.translate(None, chars))
    return (
        len(words), len(text) - without(WHITE), without(SYMBOLS), len(lines) - len(set(lines)), repeated_words(words), len(lines),
        without(LETTERS), without(UPPER), sum(w.lower() in EVERYDAY for w in words), without(ENDS), len(set(words)),
    )


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id and the numbers named in ``COUNTS`` for every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array([counts_of(t) for t in batch.column(1).to_pylist()], np.int64).reshape(-1, len(COUNTS))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in rows.T)], names=[id_col, *COUNTS])

    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    return in_batches(rows, run, f"{id_col} long, " + ", ".join(f"{c} long" for c in COUNTS))


def rule_votes() -> dict[str, Column]:
    """1 good, -1 bad, 0 abstains. No rule is certain; how far each is trusted is estimated."""
    c = F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    n = c("n_words")
    return {
        "word_length": vote((c("word_chars") > 12 * n) | (c("word_chars") < 3 * n), c("word_chars").between(4 * n, 7 * n)),
        "symbols": vote(10 * c("n_symbols") > n, c("n_symbols") == 0),
        "marks": vote(3 * (c("n_symbols") + c("n_ends")) > n, 6 * (c("n_symbols") + c("n_ends")) < n),
        "capitals": vote(2 * c("n_upper") > c("n_letters"), 10 * c("n_upper") < c("n_letters")),
        "repeats": vote(10 * c("n_repeat_words") > n, 50 * c("n_repeat_words") <= n),
        "lines": vote(4 * c("n_dup_lines") > c("n_lines"), c("n_dup_lines") == 0),
        "everyday": vote((n >= 20) & (20 * c("n_everyday") < n), 8 * c("n_everyday") >= n),
        "variety": vote((n >= 20) & (3 * c("n_forms") < n) & (n < 400), (n < 400) & (2 * c("n_forms") > n)),
    }


def estimate(votes: np.ndarray, weight: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray, np.ndarray]:
    """Share of good texts, and per rule how often it is right on good and on bad ones."""
    good, right_good, right_bad = 0.85, np.full(votes.shape[1], 0.95), np.full(votes.shape[1], 0.4)
    up, down = votes > 0, votes < 0
    for _ in range(rounds):
        odds = np.log(good / (1 - good)) + up @ np.log(right_good / (1 - right_bad)) + down @ np.log((1 - right_good) / right_bad)
        sure = 1 / (1 + np.exp(-np.clip(odds, -500, 500)))
        on_good, on_bad = weight * sure, weight * (1 - sure)
        good = float(np.clip((on_good.sum() + 8) / (weight.sum() + 10), 0.01, 0.99))
        right_good = np.clip((on_good @ up + 8) / (on_good @ (up | down) + 10), 0.6, 0.998)
        # bad texts come in kinds and a rule may see only one of them; but it says bad
        # more often on bad texts than on good ones, which keeps the two from changing places
        right_bad = np.clip((on_bad @ down + 1) / (on_bad @ (up | down) + 5), 1.05 * (1 - right_good), 0.998)
    return good, right_good, right_bad


def judge_quality(docs: DataFrame, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, counts, votes, base_failed, posterior and kept for every document."""
    rules = rule_votes()
    rows = cut(text_counts(docs, id_col, text_col)).select("*", *(v.alias(f"vote_{k}") for k, v in rules.items()))
    names = [f"vote_{k}" for k in rules]
    found = rows.groupBy(*names).agg(F.count("*").alias("n")).collect()
    votes = np.array([[r[k] for k in names] for r in found], np.int64).reshape(-1, len(names))
    good, right_good, right_bad = estimate(votes, np.array([r.n for r in found], float))
    odds = F.lit(float(np.log(good / (1 - good))))
    for k, a, b in zip(names, right_good.tolist(), right_bad.tolist(), strict=True):
        odds = odds + F.when(F.col(k) > 0, float(np.log(a / (1 - b)))).when(F.col(k) < 0, float(np.log((1 - a) / b))).otherwise(0.0)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    rows = rows.withColumn("posterior", 1 / (1 + F.exp(-odds))).withColumn("base_failed", failed)
    return rows.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= least))
