"""Plain versions of the text operators, for small inputs."""

from __future__ import annotations

import hashlib
import re


def links(texts: dict, k: int, percent: int = 80) -> dict:
    """Smallest id of each text's component."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()
    root = {i: i for i in texts}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(texts)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= percent * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: top(i) for i in ids}


def repeats(docs: list[tuple[int, bytes]], size: int = 100) -> list[tuple]:
    """id, bytes, removed, spans, digest of the rest; documents in order."""
    seen, out = set(), []
    for i, text in docs:
        gone = [0] * (len(text) + 1)
        for at in range(len(text) - size + 1):
            window = text[at : at + size]
            if window in seen:
                gone[at] += 1
                gone[at + size] -= 1
            seen.add(window)
        level, mask = 0, []
        for step in gone[:-1]:
            level += step
            mask.append(level > 0)
        rest = bytes(b for b, g in zip(text, mask) if not g)
        spans = sum(g and not (n and mask[n - 1]) for n, g in enumerate(mask))
        out.append((i, len(text), sum(mask), spans, hashlib.sha256(rest).hexdigest()))
    return out


def luhn(digits: str) -> bool:
    total = 0
    for n, d in enumerate(reversed(digits)):
        v = int(d) * (2 if n % 2 else 1)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    out = []
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    for kind, pattern in enumerate(patterns):
        for m in re.finditer(pattern, text):
            digits = re.sub(r"[^0-9]", "", m.group())
            if kind == 1 and any(int(x) > 255 for x in m.group().split(".")):
                continue
            if kind == 2 and not (12 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), kind, m.end()))
    return sorted(out)


def counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows: dict[tuple, list[int]] = {}
    for at in range(len(words) - 4):
        windows.setdefault(tuple(words[at : at + 5]), []).append(at)
    hit = {p + j for ps in windows.values() if len(ps) > 1 for p in ps for j in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)
