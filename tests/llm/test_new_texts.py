import hashlib
import random
import zlib
from collections import Counter

import pytest

from pairloom.llm import main_text, spelling, turns
from pairloom.llm.page_samples import MARK, sample_pages

# Main text of pages ------------------------------------------------------------

PAGE = (
    '<html><head><title>T</title><script>if (a < b) document.write("<p>no</p>")</script></head><body><nav><ul><li><a href="/">Home</a></li></ul></nav>'
    '<div class="cookie-notice">We use cookies.</div><article><h1>On  rivers</h1><p>Water &amp; stone,<br>and <b>sa</b>nd.<p>The end &eacute;.</article>'
    '<section id="comments"><p>A long reply of a reader. It says many things, and more.</p></section><footer>&copy; me</footer></body></html>'
)


def test_main_text_of_a_page():
    assert main_text.texts_of(main_text.labeller(), [PAGE]) == ["On rivers Water & stone, and sand. The end é."]


def test_blocks_are_right_on_pages_not_fitted_on():
    pages = [main_text.blocks_of(p) for p in sample_pages(150, 4711)]
    truth = [MARK in text for page in pages for text, _, _ in page]
    clean = [[(text.replace(MARK, "") or " ", path, linked) for text, path, linked in page] for page in pages]
    right = (main_text.labeller().scores(main_text.Sequences(clean)) > 0) == truth
    assert right.mean() > 0.99


def test_gradient_against_differences():
    model = main_text.Labeller(3)
    model.w = {k: v.astype("float64") for k, v in model.w.items()}
    pages = [main_text.blocks_of(p)[:6] for p in sample_pages(4, 5)]
    s = main_text.Sequences(pages)
    truth = main_text.np.arange(len(s.n_tags)) % 2

    def loss():
        z = model.scores(s).astype("float64")
        return float(main_text.np.mean(main_text.np.logaddexp(0, z) - truth * z))

    grad = model.gradient(s, truth)
    for name in ("on_h", "back_x", "on_b", "measures", "tags", "out"):
        at = tuple(int(i) for i in main_text.np.unravel_index(main_text.np.abs(grad[name]).argmax(), grad[name].shape))
        old = model.w[name][at]
        step = 2e-2
        model.w[name][at] = old + step
        up = loss()
        model.w[name][at] = old - step
        down = loss()
        model.w[name][at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(grad[name][at]), rel=0.05, abs=2e-4)


def test_main_text_of_odd_rows(spark):
    long = "<article>" + "<p>Some words of this text, and more.</p>" * 3000 + "</article>"
    odd = [None, "", "  ", "plain words", "<", "<p", '<a href="', "<!-- open", "<script>x", "</p></div>", "&amp;&#0;&bogus;", long, PAGE, PAGE]
    rows = [(i if i else None, None if i == 3 else "u", h, "x", 1) for i, h in enumerate(odd)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars long")
    got = {r.page_id: r for r in main_text.extract(docs).collect()}
    assert len(got) == len(odd) and got[None].text == "" and got[3].url is None
    assert got[11].text == " ".join(["Some words of this text, and more."] * 3000)
    assert got[12].text == got[13].text and all(r.n_chars == len(r.text) for r in got.values())
    assert main_text.extract(docs.limit(0)).count() == 0


# Spelling variants -----------------------------------------------------------------


def plain_words(rows):
    found = Counter()
    for doc, text in rows:
        run, runs = "", []
        for c in (text or "") + " ":
            c = c.lower() if "A" <= c <= "Z" else c
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                runs.append(run)
                run = ""
        for run in runs:
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            found[run] += 1
    return {w: n for w, n in found.items() if len(w) >= 5 and n >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows):
    words = plain_words(rows)
    near = {w: [v for v in words if one_apart(w, v)] for w in words}
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * words[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


@pytest.mark.parametrize("shard", [spelling.SHARD, 40])
def test_variants_against_all_pairs(spark, shard):
    rng = random.Random(1)
    base = ["".join(rng.choices("abcdeéß", k=rng.randint(5, 8))) for _ in range(40)]
    rows = []
    for i in range(60):
        text = []
        for _ in range(60):
            w = list(rng.choice(base[: rng.choice((3, 12, 40))]))
            if rng.random() < 0.3:
                at = rng.randrange(len(w))
                w[at : at + rng.randint(0, 1)] = rng.choice(("", "a", "é", "b"))
            text.append("".join(w))
        rows.append((i, rng.choice((" ", "-", "1")).join(text)))
    rows += [(None, "aaaaa aaaab aaaab"), (7, None), (8, ""), (9, "Zebra ZEBRA zebrá zebra"), (9, "aaaaa " * 50), (9, "aaaaa " * 50), (10, "q" * 400 + " "), (11, "日本 " + "q" * 400), (12, "q" * 400), (13, "q" * 401)] + [(14, "q" * 401)] * 4
    docs = spark.createDataFrame([(i, t, 1, "w") for i, t in rows], "doc_id long, text string, n long, word string")
    got = {tuple(r) for r in spelling.spelling_variants(docs, shard=shard).select("word", "form", "root", "n", "n_near", "form_n").collect()}
    assert got == plain_variants(rows)


def test_variants_of_nothing(spark):
    assert spelling.spelling_variants(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# Conversations -------------------------------------------------------------------


def plain_repair(rows):
    """rows in order (turn, role, text) -> the returned columns but the id, by trying edits."""
    kinds, seen = [], set()
    for _, role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        kinds.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    initial = [r[:1] for _, r, _ in rows]

    # paths as (cost, letters, lines, state), pruned by state: "", "s", "u", "a"
    front = {"": [(0, "", ())]}

    def extended(front):
        grown = {s: list(v) for s, v in front.items()}
        for _ in range(2):
            for s in list(grown):
                to = "a" if s == "u" else "u"
                role = "user" if to == "u" else "assistant"
                grown.setdefault(to, [])
                grown[to] += [(c + 5, l + "I", x + (role + ":",)) for c, l, x in grown[s] if not l.endswith("II")]
        return {s: sorted(set(v))[:40] for s, v in grown.items()}

    for (turn, role, text), kind, first in zip(rows, kinds, initial):
        front = extended(front)
        after = {}
        for s, paths in front.items():
            for c, l, x in paths:
                after.setdefault(s, []).append((c + 2, l + "D", x))
                if kind in ("b", "d"):
                    continue
                more = 5 if kind == "t" else 0
                to = "a" if s == "u" else "u"
                after.setdefault(to, []).append((c + 1 + more, l + "R", x + (("user:" if to == "u" else "assistant:") + text,)))
                if first == to or first == "s" and s == "":
                    after.setdefault(first, []).append((c + more, l + "K", x + (f"{role}:{text}",)))
        front = {s: sorted(v)[:40] for s, v in after.items()}
    front = extended(front)
    cost, letters, lines = min(front.get("", []) + front.get("a", []))
    turns_ = [t for t, _, _ in rows if t is not None]
    gaps = max(turns_) - min(turns_) + 1 - len(set(turns_)) if turns_ else 0
    illegal = sum((a if a in ("s", "u", "a") else "x") + b not in ("su", "ua", "au") for a, b in zip(initial, initial[1:]))
    return (gaps, kinds.count("b"), kinds.count("d"), kinds.count("t"), illegal, cost, letters, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def conversations(rng, n):
    out = []
    for conv in range(n):
        for turn in range(rng.randint(1, 9)):
            role = rng.choice(("user", "assistant", "user", "assistant", "system", "tool", "", None))
            text = rng.choice(("Yes.", "No", " ", "", None, "Well! ", f"It is {turn}.", "ünd?\n", "same."))
            out += [(conv, rng.choice((turn, turn, turn, turn + 3, None)), role, text)] * rng.choice((1, 1, 1, 1, 2))
    return out


def in_order(rows):
    told = [(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows]
    told.sort(key=lambda q: (q[1] is not None, q[1] or 0, f"{q[2]}:{q[3]}"))
    by = {}
    for c, t, r, x in told:
        by.setdefault(c, []).append((t, r, x))
    return by


@pytest.mark.parametrize("piece", [turns.PIECE, 2])
def test_repair_against_tried_edits(spark, piece):
    rows = conversations(random.Random(piece), 120)
    rows += [(None, 1, "user", "Hi."), (None, 2, "assistant", "Hi.")]
    rows += [(500, i % 40, ("user", "assistant", "system")[i * 7 % 3], f"{i * i % 11}" + "." * (i % 4 > 0)) for i in range(150)]
    rows += [(501, 3, "user", "again.")] * 30
    frame = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, conv string, n long")
    ids = frame.select("conv_id").unionByName(spark.createDataFrame([(900,)], "conv_id long"))
    got = {r[0]: tuple(r)[1:] for r in turns.repair(frame, ids, piece).collect()}
    want = {c: plain_repair(x) for c, x in in_order(rows).items()}
    assert got.pop(900) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())
    assert got == want


def test_repair_of_long_texts_and_of_nothing(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "word " * 100_000 + f"{i}.") for i in range(8)]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    (row,) = turns.repair(frame, frame.select("conv_id")).collect()
    assert row.audit == "K" * 8 and row.cost == 0
    assert row.repaired_sha256 == hashlib.sha256("\n".join(f"{r}:{x}" for _, _, r, x in rows).encode()).hexdigest()
    assert turns.repair(frame.limit(0), frame.select("conv_id").limit(0)).count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. B!") for c in (None, 1, 2) for t in [None, *range(60)]]
    got = Counter((r.conv_id, r.turn, r.role, r.text) for r in turns.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect())
    want = Counter()
    for c, t, role, text in rows:
        h = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if h:
            want[c, t, "user" if h == 4 else role, "" if h == 1 else "A B" if h == 2 else text] += 2 if h == 3 else 1
    assert got == want
