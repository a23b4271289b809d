"""Repair of conversations whose turns are out of shape, at the least cost.

The rows of a conversation, by turn (nulls first; rows of one turn by ``role:text``),
are edited so that their roles read as an optional system row and then user and
assistant by turns, ending with the assistant, or nothing at all. Keeping a row costs
0, another role 1, leaving a row out 2 (it must go where it is blank or was said
before), putting an empty row in 5; a row that breaks off costs 5 more where it stays.

All choices are one shortest path in a small graph of (row, state), with one integer
for each path: the high digits are its cost, the low ones spell the letters of its
edits (three bits each, in places of their own from the front, zeros behind the end).
The smaller integer is the cheaper path, and of equally cheap ones the one whose
letters come first, so the plain minimum of integers decides everything.

Rows are put in order over all tasks by ranges of (conversation, turn, ``role:text``),
so one conversation may span any number of them. Equal rows of a turn are folded into
one with a count before that. A conversation that lies inside one range is settled
there. Of others, each piece of at most ``PIECE`` rows gives its best path for each
pair of states at its ends; a path ends with a row of its piece, so two paths of equal
cost that leave by different states differ in a letter of the piece, and pieces can be
put together from the last to the first by cost and own letters alone. The digest of a
repaired conversation runs over its rows in order, a stream of pieces in one task;
nothing of a conversation but its letters is held.

Defined cases: a null role or text is one space; a null conversation id is a
conversation of its own; a conversation of ``ids`` without rows gives zeros, no letters
and the digest of nothing; an empty table gives no rows; other columns are not read.
Very long texts pass through in pieces of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pairloom.llm.common import in_batches, slots
from pairloom.session import cut

PIECE = 512
PIECE_CHARS = 1_000_000
BLANKS = " \t\n\x0b\x0c\r"
REPAIRED = (
    "conv long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
)
_STATS = "n long, blank long, duplicate long, truncated long, illegal long, first string, last string, turns long, low long, high long, low_end long, high_end long"
_PIECE = "part int, seq long, symbols string, roles array<string>, texts array<string>, costs array<long>, paths array<string>"
_NAMES = [x.split()[0] for x in REPAIRED.split(", ")]

# States: nothing said yet, after the system row, after a user row, after an assistant row.
START, SYSTEM, USER, ASSISTANT = range(4)
_STATES = range(4)
_KEEP = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
_NEXT = {START: USER, SYSTEM: USER, USER: ASSISTANT, ASSISTANT: USER}
_DIGITS = str.maketrans("1234", "DIKR")
DELETE, INSERT, KEEP, REROLE = 1, 2, 3, 4
_COST = {DELETE: 2, INSERT: 5, KEEP: 0, REROLE: 1}
_BROKEN = 5


def damaged(rows: DataFrame) -> DataFrame:
    """The rows of ``conversations`` with the faults that the number of conversation and
    turn calls for: one row in twenty each is dropped, emptied, loses its full stops, is
    repeated, or is given to the user."""
    blank = F.lit(" ")
    named = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    role, text = (F.coalesce(F.col(c).cast("string"), blank) for c in ("role", "text"))
    fault = F.pmod(F.crc32(F.encode(named, "UTF-8")), F.lit(20))
    told = rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), fault.alias("fault")).where("fault <> 0")
    changed = told.select(
        "conv_id", "turn",
        F.when(F.col("fault") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("fault") == 1, F.lit("")).when(F.col("fault") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("fault") == 3, 2).otherwise(1).alias("times"),
    )
    return changed.withColumn("copy", F.explode(F.sequence(F.lit(1), "times"))).drop("times", "copy")


# Paths ---------------------------------------------------------------------


class Weights:
    """Integers for paths of at most ``letters`` edits."""

    def __init__(self, letters: int):
        self.bits = 3 * letters
        self.low = (1 << self.bits) - 1
        self.edit = {k: (c << self.bits) + (k << self.bits >> 3) for k, c in _COST.items()}
        self.broken = _BROKEN << self.bits

    def before(self, kind: int, rest: int | None, more: int = 0) -> int | None:
        """The path that starts with an edit: the letters of the rest move one place on."""
        if rest is None:
            return None
        letters = rest & self.low
        return self.edit[kind] + more + (rest - letters) + (letters >> 3)

    def cost(self, path: int) -> int:
        return path >> self.bits

    def letters(self, path: int) -> str:
        return format(path & self.low, "o").zfill(self.bits // 3).rstrip("0").translate(_DIGITS)


def _least(*paths: int | None) -> int | None:
    return min((p for p in paths if p is not None), default=None)


def _with_inserts(w: Weights, ahead: list[int | None]) -> list[int | None]:
    """Paths that may put up to two rows in before what ``ahead`` has for each state;
    two rows lead to every state that any number of them leads to."""
    once = [w.before(INSERT, ahead[_NEXT[s]]) for s in _STATES]
    twice = [w.before(INSERT, once[_NEXT[s]]) for s in _STATES]
    return [_least(ahead[s], once[s], twice[s]) for s in _STATES]


def _backwards(w: Weights, symbols: str, best: list[int | None]) -> list[int | None]:
    """From each state the best path over the rows, given the best after them."""
    for symbol in reversed(symbols):
        if symbol == "D":
            ahead = [w.before(DELETE, best[s]) for s in _STATES]
        else:
            more = w.broken if symbol.isupper() else 0
            keep = _KEEP.get(symbol.lower(), {})
            ahead = [
                _least(
                    w.before(DELETE, best[s]),
                    w.before(REROLE, best[_NEXT[s]], more),
                    w.before(KEEP, best[keep[s]], more) if s in keep else None,
                )
                for s in _STATES
            ]
        best = _with_inserts(w, ahead)
    return best


def _end(w: Weights) -> list[int | None]:
    return _with_inserts(w, [0 if s in (START, ASSISTANT) else None for s in _STATES])


def cheapest(symbols: str) -> tuple[int, str]:
    """Cost and letters of the edits of a whole conversation. A symbol per row: s, u, a,
    x (any other role), in capitals where the row breaks off, D where it must go."""
    return _remembered(symbols) if len(symbols) <= 32 else _cheapest(symbols)


def _cheapest(symbols: str) -> tuple[int, str]:
    w = Weights(3 * len(symbols) + 2)
    path = _backwards(w, symbols, _end(w))[START]
    return w.cost(path), w.letters(path)


_remembered = lru_cache(maxsize=50_000)(_cheapest)


def crossings(symbols: str) -> tuple[list[int | None], list[str | None]]:
    """Costs and letters of the best paths over a piece, for each state before it and
    each after it (position 4 * before + after); paths end with a row."""
    w = Weights(3 * len(symbols))
    costs: list[int | None] = [None] * 16
    paths: list[str | None] = [None] * 16
    for after in _STATES:
        found = _backwards(w, symbols, [0 if s == after else None for s in _STATES])
        for before in _STATES:
            if found[before] is not None:
                costs[4 * before + after] = w.cost(found[before])
                paths[4 * before + after] = w.letters(found[before])
    return costs, paths


def applied(letters: str, symbols: str, roles: list[str], texts: list[str], state: int) -> tuple[list[str], int]:
    """The repaired lines of a piece and the state after it. ``roles`` and ``texts``
    leave out the rows that must go."""
    lines, at, rows = [], 0, iter(symbols)
    for letter in letters:
        symbol = None if letter == "I" else next(rows)
        role = text = ""
        if symbol is not None and symbol != "D":
            role, text = roles[at], texts[at]
            at += 1
        if letter == "D":
            continue
        if letter == "K":
            state = _KEEP[symbol.lower()][state]
        else:
            state = _NEXT[state]
            role = "user" if state == USER else "assistant"
        lines.append(f"{role}:{text}")
    return lines, state


# Rows ----------------------------------------------------------------------


def _judged(rows: DataFrame) -> DataFrame:
    """conv, turn, role, text, copies, blank, broken, said (whether said before)."""
    line = F.concat("role", F.lit(":"), "text")
    folded = rows.groupBy("conv", "turn", "role", "text").agg(F.count("*").alias("copies"))
    folded = folded.withColumn("mark", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), line), 256)))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    first = folded.groupBy("conv", "mark").agg(F.min(place).alias("first"), F.count("*").alias("times")).where("times > 1").drop("times")
    first = first.withColumnsRenamed({"conv": "of", "mark": "as"})
    both = folded.join(first, F.col("conv").eqNullSafe(F.col("of")) & (F.col("mark") == F.col("as")), "left")
    bare = F.rtrim("text", F.lit(BLANKS))
    return both.select(
        "conv", "turn", "role", "text", "copies", (bare == "").alias("blank"),
        (~F.substring(bare, -1, 1).isin(".", "!", "?")).alias("broken"),
        F.coalesce(place > F.col("first"), F.lit(False)).alias("said"),
    )


class _Stretch:
    """Rows of one conversation that are being read, and their numbers."""

    def __init__(self, conv: int | None):
        self.conv = conv
        self.seq = 0
        self.clear()

    def clear(self) -> None:
        self.symbols: list[str] = []
        self.roles: list[str] = []
        self.texts: list[str] = []
        self.chars = 0
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.low = self.high = self.low_end = self.high_end = None

    def add(self, turn: int | None, role: str, text: str, fault: str) -> None:
        initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
        if self.symbols:
            self.illegal += self.last + initial not in ("su", "ua", "au")
        else:
            self.first, self.low_end = initial, turn
        if turn is not None and (self.high is None or turn != self.high):
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        self.last, self.high_end = initial, turn
        if fault in ("b", "d"):
            self.symbols.append("D")
            self.blank += fault == "b"
            self.duplicate += fault == "d"
            return
        self.truncated += fault == "t"
        self.symbols.append(initial.upper() if fault == "t" else initial)
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)

    def stats(self) -> list:
        return [len(self.symbols), self.blank, self.duplicate, self.truncated, self.illegal, self.first, self.last,
                self.turns, self.low, self.high, self.low_end, self.high_end]


def _gaps(low: int | None, high: int | None, turns: int) -> int:
    return 0 if low is None else min(high - low + 1 - turns, 2**63 - 1)


def _settled(s: _Stretch) -> list:
    symbols = "".join(s.symbols)
    cost, letters = cheapest(symbols)
    lines, _ = applied(letters, symbols, s.roles, s.texts, START)
    digest = hashlib.sha256("\n".join(lines).encode("utf-8", "surrogatepass")).hexdigest()
    return [s.conv, _gaps(s.low, s.high, s.turns), s.blank, s.duplicate, s.truncated, s.illegal, cost, letters, digest]


_COLUMNS = f"{REPAIRED}, {_PIECE}, " + _STATS.replace("blank long, duplicate long, truncated long, illegal long, ", "")
_ROW = pa.schema(
    [
        (name, {"int": pa.int32(), "long": pa.int64(), "string": pa.string(), "array<string>": pa.list_(pa.string()), "array<long>": pa.list_(pa.int64())}[kind])
        for name, kind in (x.split() for x in _COLUMNS.split(", "))
    ]
)


def _piece(s: _Stretch, part: int) -> dict:
    symbols = "".join(s.symbols)
    costs, paths = crossings(symbols)
    names = [x.split()[0] for x in _STATS.split(", ")]
    row = dict(zip(names, s.stats())) | dict(conv=s.conv, part=part, seq=s.seq, symbols=symbols, roles=s.roles, texts=s.texts, costs=costs, paths=paths)
    s.seq += 1
    s.clear()
    return row


def _read(judged: DataFrame, piece: int) -> DataFrame:
    """Settled conversations (``seq`` null) and pieces of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here: _Stretch | None = None
        first = True  # the first and the last conversation of a range may go on in another
        part = 0
        for batch in batches:
            out: list[dict] = []
            for part, conv, turn, role, text, copies, blank, broken, said in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if here is None:
                    here = _Stretch(conv)
                elif conv != here.conv:
                    if first or here.seq:
                        out.append(_piece(here, part))
                    else:
                        out.append(dict(zip(_NAMES, _settled(here))))
                    here, first = _Stretch(conv), False
                fault = "b" if blank else "d" if said else "t" if broken else ""
                for _ in range(copies):
                    if len(here.symbols) >= piece or here.symbols and here.chars + len(text) > PIECE_CHARS:
                        out.append(_piece(here, part))
                    here.add(turn, role, text, fault)
                    fault = fault if fault == "b" else "d"
                if len(out) >= 1000:
                    yield from pa.Table.from_pylist(out, _ROW).to_batches()
                    out = []
            yield from pa.Table.from_pylist(out, _ROW).to_batches()
        if here is not None:
            yield from pa.Table.from_pylist([_piece(here, part)], _ROW).to_batches()

    start = F.substring(F.concat("role", F.lit(":"), "text"), 1, 64)
    order = ["conv", "turn", F.concat("role", F.lit(":"), "text")]
    dealt = judged.repartitionByRange(slots(judged.sparkSession), "conv", "turn", start).sortWithinPartitions(*order)
    rows = dealt.select(F.spark_partition_id().alias("part"), "conv", "turn", "role", "text", "copies", "blank", "broken", "said")
    return in_batches(rows, run, _COLUMNS)


def _chosen(pieces: DataFrame) -> DataFrame:
    """conv, part, seq, letters: the path of every piece, from the last piece to the first."""

    def finished(conv, choices: list[tuple]) -> Iterator[tuple]:
        state = START
        for part, seq, exits, paths in reversed(choices):
            yield conv, part, seq, paths[state]
            state = exits[state]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, choices, best = None, [], None
        names = ["conv", "part", "seq", "letters"]

        def batch_of(rows) -> pa.RecordBatch:
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.string()]
            columns = list(zip(*rows)) or [()] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

        for batch in batches:
            for owner, part, seq, costs, paths in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if best is None or owner != conv:
                    if best is not None:
                        yield batch_of(finished(conv, choices))
                    conv, choices = owner, []
                    best = [0, 2 * _COST[INSERT], _COST[INSERT], 0]
                exits, totals, own = [None] * 4, [None] * 4, [None] * 4
                for before in _STATES:
                    ways = [
                        (costs[4 * before + s] + best[s], paths[4 * before + s], s) for s in _STATES if costs[4 * before + s] is not None
                    ]
                    if ways:
                        totals[before], own[before], exits[before] = min(ways)
                choices.append((part, seq, exits, own))
                best = totals
        if best is not None:
            yield batch_of(finished(conv, choices))

    rows = pieces.select("conv", "part", "seq", "costs", "paths").repartition(slots(pieces.sparkSession), "conv")
    rows = rows.sortWithinPartitions("conv", F.desc("part"), F.desc("seq"))
    return in_batches(rows, run, "conv long, part int, seq long, letters string")


_SUMS = ["blank", "duplicate", "truncated", "illegal"]
_END_LETTERS = {START: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


def _assembled(pieces: DataFrame, chosen: DataFrame) -> DataFrame:
    """Repaired conversations from their pieces in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def closed() -> pa.RecordBatch:
            tail, _ = applied(_END_LETTERS[now["state"]], "", [], [], now["state"])
            said(tail)
            letters = "".join(now["letters"]) + _END_LETTERS[now["state"]]
            cost = now["cost"] + _COST[INSERT] * len(_END_LETTERS[now["state"]])
            row = [now["conv"], _gaps(now["low"], now["high"], now["turns"]), *(now[c] for c in _SUMS), cost, letters, now["digest"].hexdigest()]
            return pa.RecordBatch.from_pylist([dict(zip(_NAMES, row))], pa.schema([_ROW.field(c) for c in _NAMES]))

        def said(lines: list[str]) -> None:
            for line in lines:
                now["digest"].update((("\n" if now["lines"] else "") + line).encode("utf-8", "surrogatepass"))
                now["lines"] = True

        for batch in batches:
            for row in batch.to_pylist():
                if now is None or row["conv"] != now["conv"]:
                    if now is not None:
                        yield closed()
                    now = dict.fromkeys([*_SUMS, "turns", "cost"], 0)
                    now |= dict(conv=row["conv"], letters=[], state=START, digest=hashlib.sha256(), lines=False, low=None, high=None, last=None, turn=None)
                for c in _SUMS:
                    now[c] += row[c]
                if now["last"] is not None:
                    now["illegal"] += now["last"] + row["first"] not in ("su", "ua", "au")
                    now["turns"] -= row["low_end"] is not None and row["low_end"] == now["turn"]
                now["turns"] += row["turns"]
                now["low"] = row["low"] if now["low"] is None else now["low"]
                now["high"] = now["high"] if row["high"] is None else row["high"]
                now["last"], now["turn"] = row["last"], row["high_end"]
                lines, after = applied(row["letters"], row["symbols"], row["roles"], row["texts"], now["state"])
                now["cost"] += row["costs"][4 * now["state"] + after]
                now["state"] = after
                now["letters"].append(row["letters"])
                said(lines)
        if now is not None:
            yield closed()

    chosen = chosen.withColumnsRenamed({"conv": "of", "part": "of_part", "seq": "of_seq"})
    same = F.col("conv").eqNullSafe(F.col("of")) & (F.col("part") == F.col("of_part")) & (F.col("seq") == F.col("of_seq"))
    both = pieces.join(chosen, same).drop("of", "of_part", "of_seq", "gaps", "cost", "audit", "repaired_sha256", "paths")
    rows = both.repartition(slots(pieces.sparkSession), "conv").sortWithinPartitions("conv", "part", "seq")
    return in_batches(rows, run, REPAIRED)


def repair(rows: DataFrame, ids: DataFrame, piece: int = PIECE) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256
    for every conversation of ``ids`` (conv_id). ``rows``: conv_id, turn, role, text."""
    blank = F.lit(" ")

    def said(column: str) -> Column:
        return F.coalesce(F.col(column).cast("string"), blank).alias(column)

    told = rows.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role"), said("text"))
    read = cut(_read(_judged(told), piece))
    settled = read.where("seq IS NULL").select(*_NAMES)
    pieces = read.where("seq IS NOT NULL")
    done = settled.unionByName(_assembled(pieces, cut(_chosen(pieces))))
    wanted = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    zero = F.lit(0).cast("long")
    return wanted.join(done, F.col("conv_id").eqNullSafe(F.col("conv")), "left").select(
        "conv_id",
        *[F.coalesce(c, zero).alias(c) for c in ("gaps", *_SUMS, "cost")],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
