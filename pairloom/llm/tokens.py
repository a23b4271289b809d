"""Token ids of whole texts by a public vocabulary file.

The vocabulary splits text before its merges, and a single space between two
characters that are no white space always begins a new split. So a text may be cut
there and every distinct piece encoded once by the library; the ids of the text
are those of its pieces in order. A tail of punctuation, or a lone line break, is
a split of its own as well, which makes the pieces repeat more often.
"""

from __future__ import annotations

import gc
import os
import re
from array import array
from collections.abc import Iterator

import numpy as np

from pairloom.llm.common import give_back, held, hold_only

ODD = re.compile(r"\s | \s")
# White space other than spaces and line breaks.
RARE = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
CUT = re.compile(r"(?<=\S)(?= \S)")
LINE = re.compile(r"(?<=\S)(\n)(?=\S)")
# Letters that the vocabulary's own pattern takes for letters as well.
WORD = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")
# The byte alphabet of the vocabulary: printable bytes stand for themselves, the rest follow from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = np.arange(256, dtype="<u4")
BYTES[[x for x in range(256) if x not in _PRINTED]] = np.arange(256, 256 + 256 - len(_PRINTED))
BYTES[10] = 10  # parts the words
TAIL = ".,!?;:&%$#*|"
# A word with its tail.
PLAIN = re.compile(f"({WORD.pattern})([{re.escape(TAIL)}]*)")
# Characters of text at work at once, and distinct pieces kept before the table starts anew
# unless an operator names a number of its own.
CHARS = 1 << 21
KEPT = 1_200_000


def _gather(flat: np.ndarray, ends: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The stretches of ``flat`` by their numbers, one after the other, and where each ends."""
    start = ends[at]
    size = ends[at + 1] - start
    total = np.cumsum(size)
    return flat[np.repeat(start - (total - size), size) + np.arange(total[-1] if len(at) else 0)], total


class _Pieces(dict):
    """Numbers pieces in the order of their first use."""

    def __init__(self) -> None:
        self.new: list = []

    def __missing__(self, piece):
        number = self[piece] = len(self)
        self.new.append(piece)
        return number


def _odd(text: str) -> bool:
    """Whether a space stands beside other white space (``ODD``), mostly without a search."""
    if "  " in text or " \n" in text or "\n " in text:
        return True
    return any(map(text.__contains__, RARE)) and ODD.search(text) is not None


class Encoder:
    def __init__(self, path: str, kept: int | None = None) -> None:
        self.kept = kept
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        # Strings of added tokens part a text before anything else, the longest first.
        self.added = {str(x): i for i, x in self.library.get_added_tokens_decoder().items()}
        self.parting = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        self.size = self.library.get_vocab_size()
        self._clear()

    def _most(self) -> int:
        """Pieces kept before the table starts anew."""
        return KEPT if self.kept is None else self.kept

    def _clear(self) -> None:
        self.pieces = _Pieces()
        self.flat, self.ends = array("i"), array("q", [0])
        self.uses = np.zeros(0, np.int64)
        self._new_parts()

    def _new_parts(self) -> None:
        """Splits by number, and the ids of each."""
        self.splits: dict[str, int] = {}
        self.parts, self.ends_of_parts = array("i"), array("q", [0])

    def _forget(self) -> None:
        """Keep the pieces that were used more than once since they came, or since
        they were last looked over; if those are too many as well, none."""
        kept = np.flatnonzero(self.uses > 1)
        if len(kept) > self._most() // 2:
            return self._clear()
        ends = np.array(self.ends, np.int64)
        ids, total = _gather(np.array(self.flat, np.int32), ends, kept)
        names = list(self.pieces)
        self.pieces = _Pieces()
        self.pieces.update((names[k], i) for i, k in enumerate(kept.tolist()))
        self.flat, self.ends = array("i"), array("q", [0])
        self.flat.frombytes(ids.astype(np.int32).tobytes())
        self.ends.frombytes(total.astype(np.int64).tobytes())
        self.uses = np.zeros(len(kept), np.int64)
        return None

    def _learn(self) -> None:
        """Ids of the pieces met for the first time."""
        texts = [x[0] if isinstance(x, tuple) else " " + x for x in self.pieces.new]
        self.pieces.new = []
        parts, splits = self.parts, self.splits
        known, words, other = len(self.ends_of_parts) - 1, [], []
        used, counts = array("q"), array("q")
        for text in texts:
            if plain := PLAIN.fullmatch(text):
                own = plain.groups() if plain.end(1) < len(text) else (text,)
            else:
                own = [x for part in LINE.split(text) for x in self._parts(part)] if "\n" in text else self._parts(text)
            counts.append(len(own))
            for part in own:
                number = splits.get(part)
                if number is None:
                    if WORD.fullmatch(part):
                        number = splits[part] = known + len(words)
                        words.append(part)
                    else:
                        number = splits[part] = -1 - len(other)  # after all words
                        other.append(part)
                used.append(number)
        merge = self.library.model.tokenize  # a word is one split: straight to the merges
        ends = self.ends_of_parts
        mapped = BYTES[np.frombuffer("\n".join(words).encode(), np.uint8)].tobytes().decode("utf-32-le")
        for text in mapped.split("\n") if words else ():
            parts.extend([x.id for x in merge(text)])
            ends.append(len(parts))
        first = len(ends) - 1
        for number, found in enumerate(self.library.encode_batch_fast(other, add_special_tokens=False)):
            splits[other[number]] = first + number
            parts.extend(found.ids)
            ends.append(len(parts))
        at = np.frombuffer(used, np.int64) if used else np.zeros(0, np.int64)
        at = np.where(at < 0, first - 1 - at, at)
        ids, total = _gather(np.frombuffer(parts, np.int32) if parts else np.zeros(0, np.int32), np.frombuffer(ends, np.int64), at)
        last = np.cumsum(np.frombuffer(counts, np.int64))
        self.ends.frombytes((np.concatenate([[0], total])[last] + len(self.flat)).tobytes())
        self.flat.frombytes(ids.tobytes())
        if len(splits) > self._most() // 2:
            self._new_parts()

    @staticmethod
    def _parts(text: str) -> tuple[str, ...]:
        """A text without its tail, and the tail, where letters end before it."""
        stem = text.rstrip(TAIL)
        if stem and len(stem) < len(text) and stem[-1].isalpha():
            return stem, text[len(stem) :]
        return (text,) if text else ()

    def _some(self, texts: list[str]) -> Iterator[np.ndarray]:
        if len(self.pieces) > self._most():
            self._forget()
        pieces, counts = [], []
        for text in texts:
            if not _odd(text):
                own = text.split(" ")
            else:
                own = CUT.split(text)
                own[1:] = [x[1:] for x in own[1:]]  # the space that opens each
            own[0] = (own[0],)
            counts.append(len(own))
            pieces += own
        at = np.fromiter(map(self.pieces.__getitem__, pieces), np.int64, len(pieces))
        if self.pieces.new:
            collects = gc.isenabled()
            gc.disable()  # many small objects without cycles
            self._learn()
            if collects:
                gc.enable()
        used = np.bincount(at, minlength=len(self.pieces))
        used[: len(self.uses)] += self.uses
        self.uses = used
        flat, ends = np.frombuffer(self.flat, np.int32) if self.flat else np.zeros(0, np.int32), np.frombuffer(self.ends, np.int64)
        ids, total = _gather(flat, ends, at)
        del flat, ends
        bounds = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(counts)])]
        for low, high in zip(bounds, bounds[1:]):
            yield ids[low:high]

    def encode(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """Ids of each text, null as empty; equal to the library's on the whole text."""
        held, chars = [], 0
        for text in texts:
            if text and any(map(text.__contains__, self.added)):
                yield from self._some(held) if held else ()
                held, chars = [], 0
                yield self._parted(text)
                continue
            held.append(text or "")
            chars += len(held[-1])
            if chars >= CHARS:
                yield from self._some(held)
                held, chars = [], 0
        if held:
            yield from self._some(held)

    def _parted(self, text: str) -> np.ndarray:
        """Ids of a text that holds strings of added tokens: what lies between is encoded apart."""
        parts = self.parting.split(text)
        between = self._some(parts[::2])
        ids = [next(between)]
        for name, rest in zip(parts[1::2], between):
            ids += [np.array([self.added[name]], np.int32), rest]
        return np.concatenate(ids)


_ready: dict[str, Encoder] = held({})


def encoder(path: str, kept: int | None = None) -> Encoder:
    """The encoder of this worker process, with a table of at most ``kept`` pieces (``KEPT``)."""
    hold_only(_ready)
    if path not in _ready or _ready[path].kept != kept:
        _ready.clear()
        give_back()
        _ready[path] = Encoder(path, kept)
    return _ready[path]
