"""Personal data: fixed patterns, and a semi-Markov conditional random field on top.

The patterns give the base spans (email, ip, card, phone). The field then looks at
the regions of a text that hold a digit or an ``@``: neighbouring tokens between
white space. A region is split into atoms (runs of letters, runs of digits, single
other characters). A candidate is a run of at most ``MOST`` atoms; its features
describe the whole span (shape of its digit groups, separators, what stands before
and after it), not its atoms one by one. Atoms outside entities score nothing. One
dynamic programme over a region chooses boundaries and kinds together; as entities
are bounded it takes time in proportion to the region. What it finds is added where
no base span is; base spans stay.

The weights are fitted here, by gradient on the log-likelihood (forward and backward
sums over all segmentations), on examples that a seeded generator writes: numbers,
dates, versions, prices and codes as well as data of the four kinds in forms that
the patterns know and forms that they do not (phone numbers without ``+``, spaced
or bracketed mail addresses).

Defined cases: a null or empty text has no span; spans of different kinds may
overlap; repeated rows are searched each; an empty table gives no rows; other
columns are kept by :func:`redact` and not looked at.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache, lru_cache
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import in_batches

KINDS = ("email", "ip", "card", "phone")
MOST = 24
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_NUMBERS = re.compile(r"[0-9+][0-9+(). -]*")
# A run of digits begins at its first digit: starting later in it cannot match either.
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_SEED = re.compile(r"[0-9@]")
_ATOM = re.compile(r"[A-Za-z]+|[0-9]+|\s|[^A-Za-z0-9\s]", re.ASCII | re.DOTALL)
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    odd, even = digits[::-2], digits[-2::-2]
    return (sum(map(int, odd)) + sum(sum(divmod(2 * int(d), 10)) for d in even)) % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """start, number of the kind, end; sorted."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append((start, 0, found.end()))
            done = found.end()
        at = text.find("@", max(at + 1, done))
    for run in _NUMBERS.finditer(text):
        piece, base = run.group(), run.start()
        if len(piece) < 7:
            continue
        for m in _IP.finditer(piece):
            if all(len(x.lstrip("0")) <= 3 and int(x.lstrip("0")[:4] or 0) <= 255 for x in m.group().split(".")):
                out.append((base + m.start(), 1, base + m.end()))
        for m in _CARD.finditer(piece):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append((base + m.start(), 2, base + m.end()))
        for m in _PHONE.finditer(piece):
            if 9 <= sum(c.isdigit() for c in m.group()) <= 15:
                out.append((base + m.start(), 3, base + m.end()))
    return sorted(out)


def regions(text: str) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring tokens that hold a digit or ``@`` each."""
    low = high = -1
    at = 0
    while found := _SEED.search(text, at):
        start = end = found.start()
        while start > max(high, 0) and not text[start - 1].isspace():
            start -= 1
        while end < len(text) and not text[end].isspace():
            end += 1
        if low >= 0 and start - high <= 1:
            high = end
        else:
            if low >= 0:
                yield low, high
            low, high = start, end
        at = end
    if low >= 0:
        yield low, high


def _bucket(n: int, edges: tuple[int, ...]) -> int:
    return sum(n >= e for e in edges)


_DIGITS = (1, 4, 7, 8, 9, 10, 11, 12, 13, 16, 17, 20)


@lru_cache(maxsize=10_000)
def features(span: str, before: str, after: str) -> tuple[str, ...]:
    """What is true of a whole span and of the characters next to it."""
    groups = re.findall(r"[0-9]+", span)
    digits = "".join(groups)
    sizes = "-".join(str(len(g)) for g in groups) if len(groups) <= 6 else "many"
    rest = {"a" if c.isalpha() else c for c in span if not c.isdigit()}
    out = [
        "always",
        f"digits {_bucket(len(digits), _DIGITS)}",
        f"groups {min(len(groups), 7)}",
        f"sizes {sizes}",
        f"chars {''.join(sorted(rest))}" if len(rest) <= 4 else "chars many",
        f"begins {'9' if span[0].isdigit() else 'a' if span[0].isalpha() else span[0]}",
        f"ends {'9' if span[-1].isdigit() else 'a' if span[-1].isalpha() else span[-1]}",
        f"before {'a' if before.isalpha() else '9' if before.isdigit() else before}",
        f"after {'a' if after.isalpha() else '9' if after.isdigit() else after}",
    ]
    local, sign, domain = span.partition("@")
    if sign:
        out.append("at one" if "@" not in domain else "at more")
        out.append("domain dots" if re.fullmatch(r"\s?[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", domain) else "domain odd")
        out.append("local odd" if not re.fullmatch(r"[A-Za-z0-9._%+-]+\s?", local) else "local plain")
    elif re.fullmatch(r"[0-9]+(\.[0-9]+){3}", span):
        out.append("quad small" if all(int(g[:4]) <= 255 for g in groups) else "quad large")
    elif len(digits) >= 12 and not rest - {" ", "-"}:
        out.append("check digit" if luhn(digits) else "no check digit")
    if not rest - set("+(). -") and 9 <= len(digits) <= 15:
        out.append("dialled" if span[0] in "+(" else "plain number")
    return tuple(out)


def candidates(atoms: list[str], left: str, right: str) -> list[tuple[int, int, tuple[str, ...]]]:
    """Begin, end and features of every span that may be an entity."""
    out = []
    for i, first in enumerate(atoms):
        if not (first[0].isalnum() or first in "+("):
            continue
        holds = False
        for j in range(i + 1, min(len(atoms), i + MOST) + 1):
            last = atoms[j - 1]
            holds |= last[0].isdigit() or last == "@"
            if holds and last[0].isalnum():
                before, after = atoms[i - 1][-1] if i else left, atoms[j][0] if j < len(atoms) else right
                out.append((i, j, features("".join(atoms[i:j]), before, after)))
    return out


def _scores(cands: list[tuple[int, int, tuple[str, ...]]], weights: dict[str, list[float]]) -> list[list[float]]:
    zero = [0.0] * len(KINDS)
    return [[sum(w) for w in zip(*(weights.get(f, zero) for f in fs), strict=True)] for _, _, fs in cands]


def decode(atoms: list[str], left: str, right: str, weights: dict[str, list[float]]) -> list[tuple[int, int, int]]:
    """Best segmentation: begin, end, kind of its entities."""
    cands = candidates(atoms, left, right)
    ending: dict[int, list[tuple[float, int, int]]] = {}
    for (i, j, _), scores in zip(cands, _scores(cands, weights), strict=True):
        kind = max(range(len(KINDS)), key=scores.__getitem__)
        if scores[kind] > 0:
            ending.setdefault(j, []).append((scores[kind], i, kind))
    best, back = [0.0], [None]
    for j in range(1, len(atoms) + 1):
        top, way = best[j - 1], None
        for score, i, kind in ending.get(j, ()):
            if best[i] + score > top:
                top, way = best[i] + score, (i, kind)
        best.append(top), back.append(way)
    out, j = [], len(atoms)
    while j:
        if back[j]:
            i, kind = back[j]
            out.append((i, j, kind))
            j = i
        else:
            j -= 1
    return out[::-1]


def _example(rng: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """A line of text with its entities (start, kind, end)."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 9)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        body += next(d for d in "0123456789" if luhn(body + d))
        sep = rng.choice(["", "", " ", "-"])
        return sep.join(body[k : k + 4] for k in range(0, 16, 4))

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice([f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{rng.randint(1, 99)}{a}{b}{c}"])

    def email() -> str:
        local = rng.choice([word(), f"{word()}.{word()}", f"{word()}.{num(2)}", f"{word()}{num(2)}", f"{word()}+{word()}"])
        sign = rng.choice(["@"] * 6 + [" @ "])
        return f"{local}{sign}{rng.choice([word(), word() + num(1)])}.{rng.choice(['com', 'org', 'example.com', 'co.uk', 'net'])}"

    kinds = (email, lambda: ".".join(str(rng.randint(0, 255)) for _ in range(4)), card, phone)
    other = (
        lambda: str(rng.randint(1900, 2100)), lambda: num(rng.randint(1, 6)), lambda: f"{num(4)}-{num(2)}-{num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)}",
        lambda: f"{rng.randint(0, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: f"{num(2)}:{num(2)}", lambda: f"${num(2)}.{num(2)}", lambda: f"{num(1)},{num(3)}",
        lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: f"{word()}{num(2)}", lambda: f"@{word()}", lambda: num(rng.randint(7, 24)),
        lambda: f"{rng.randint(256, 999)}.{num(3)}.{num(3)}.{num(3)}", lambda: f"{num(3)}-{num(2)}-{num(5)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}.{num(4)}", lambda: f"{num(1)}.{num(1)}.{num(1)}.{num(1)}.{num(1)}",
    )
    text, spans = word(), []
    for _ in range(rng.randint(1, 3)):
        text += rng.choice([" ", " ", " ", " (", ' "', " = ", ", "])
        kind = rng.randrange(8)
        piece = kinds[kind]() if kind < 4 else rng.choice(other)()
        digits = piece.replace(" ", "").replace("-", "")
        if kind >= 4 and 12 <= len(digits) <= 19 and digits.isdigit() and luhn(digits):
            continue
        if kind < 4:
            spans.append((len(text), kind, len(text) + len(piece)))
        text += piece + rng.choice(["", "", "", ".", ",", ")", '"', "###", "!!"])
        if rng.random() < 0.7:
            text += " " + word()
    return text, spans


def region_examples(texts: list[tuple[str, list[tuple[int, int, int]]]]) -> Iterator[tuple[list[str], str, str, set[tuple[int, int, int]]]]:
    """Atoms, neighbours and true entities (begin, end, kind) of each region."""
    for text, spans in texts:
        for low, high in regions(text):
            atoms = _ATOM.findall(text[low:high])
            ends = np.cumsum([0, *map(len, atoms)]).tolist()
            at = {low + e: k for k, e in enumerate(ends)}
            true = {(at[s], at[e], k) for s, k, e in spans if s in at and e in at}
            yield atoms, text[low - 1] if low else "", text[high] if high < len(text) else "", true


@cache
def train(examples: int = 1000, rounds: int = 4, rate: float = 0.25, decay: float = 1e-4, seed: int = 11) -> dict[str, list[float]]:
    """Weights per feature and kind: Adagrad on the log-likelihood of whole regions."""
    rng = random.Random(seed)
    names: dict[str, int] = {}
    rows = []
    for atoms, left, right, true in region_examples([_example(rng) for _ in range(examples)]):
        cands = candidates(atoms, left, right)
        if cands:
            rows.append((len(atoms), [(i, j, np.array([names.setdefault(f, len(names)) for f in fs])) for i, j, fs in cands], true))
    weights = np.zeros((len(names), len(KINDS)))
    square = np.full_like(weights, 1e-6)
    for _ in range(rounds):
        rng.shuffle(rows)
        for n, cands, true in rows:
            scores = np.array([weights[fs].sum(axis=0) for _, _, fs in cands])
            both = np.logaddexp.reduce(scores, axis=1)
            ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
            ending: dict[int, list[int]] = {}
            starting: dict[int, list[int]] = {}
            for c, (i, j, _) in enumerate(cands):
                ending.setdefault(j, []).append(c)
                starting.setdefault(i, []).append(c)
            for j in range(1, n + 1):
                ahead[j] = np.logaddexp.reduce([ahead[j - 1], *(ahead[cands[c][0]] + both[c] for c in ending.get(j, ()))])
            for i in range(n - 1, -1, -1):
                behind[i] = np.logaddexp.reduce([behind[i + 1], *(behind[cands[c][1]] + both[c] for c in starting.get(i, ()))])
            for c, (i, j, fs) in enumerate(cands):
                slope = np.exp(ahead[i] + scores[c] + behind[j] - ahead[n])
                for k in range(len(KINDS)):
                    if (i, j, k) in true:
                        slope[k] -= 1
                if np.abs(slope).max() > 1e-4:
                    step = slope + decay * weights[fs]
                    square[fs] += step**2
                    weights[fs] -= rate * step / np.sqrt(square[fs])
    return {name: weights[k].tolist() for name, k in names.items()}


def all_spans(text: str | None, weights: dict[str, list[float]]) -> list[tuple[int, int, int, bool]]:
    """start, kind, end, whether a base span; sorted."""
    text = text or ""
    base = base_spans(text)
    out = [(s, k, e, True) for s, k, e in base]
    starts = [s for s, _, _ in base]
    reach = [-1, *accumulate((e for _, _, e in base), max)]  # how far the first base spans reach
    for low, high in regions(text):
        if reach[bisect_right(starts, low)] >= high:
            continue  # wholly known
        atoms = _ATOM.findall(text[low:high])
        found = decode(atoms, text[low - 1] if low else "", text[high] if high < len(text) else "", weights)
        ends = np.cumsum([0, *map(len, atoms)]).tolist() if found else []
        for i, j, kind in found:
            start, end = low + ends[i], low + ends[j]
            if reach[bisect_left(starts, end)] <= start:
                out.append((start, kind, end, False))
    return sorted(out)


SPAN = "array<struct<start:int,kind:string,end:int,base:boolean>>"


def find_spans(docs: DataFrame, text_col: str = "text", weights: dict[str, list[float]] | None = None) -> DataFrame:
    """``row`` (the document as it came) and spans: start, kind, end (code points, end
    exclusive) and whether the span is a base one."""
    shared = docs.sparkSession.sparkContext.broadcast(weights or train())
    rows = docs.select(F.struct("*").alias("row"))
    schema = rows.select("row", F.lit(None).cast(SPAN).alias("spans")).schema
    kind = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [[{"start": s, "kind": KINDS[k], "end": e, "base": b} for s, k, e, b in all_spans(t, shared.value)] for t in batch.column(0).field(text_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(spans, kind)], names=["row", "spans"])

    return in_batches(rows, run, schema)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents with every span replaced by its kind in brackets; of overlapping
    spans the first names the whole stretch. A null text stays null."""
    found = find_spans(docs, text_col)
    spans = F.col("spans")
    text = F.col(f"row.`{text_col}`")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("end"))

    def add(acc: Column, s: Column) -> Column:
        label = F.concat(F.lit("["), F.upper(s.kind), F.lit("]"))
        fresh = F.concat(acc.out, F.substring(text, acc.end + 1, s.start - acc.end), label)
        return F.struct(F.when(s.start >= acc.end, fresh).otherwise(acc.out).alias("out"), F.greatest(acc.end, s.end).alias("end"))

    new = F.aggregate(spans, start, add, lambda acc: F.concat(acc.out, F.substring(text, acc.end + 1, F.length(text))))
    kept = [F.col(f"row.`{c}`").alias(c) if c != text_col else F.when(F.size(spans) > 0, new).otherwise(text).alias(c) for c in docs.columns]
    return found.select(*kept)
