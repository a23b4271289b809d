import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from pairloom.llm import huffman, packing, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "  ", "\n", " a", "a ", "a  b", "it's  fine\n\n ok", "<|endoftext|> x", "a<|endoftext|>b", "<|endoftext|><|endoftext|>  \n<|endoftext", "x" * 5000, "日本 語\u3000é", "a\x1cb \x85 c", "word " * 3000]


@pytest.fixture(scope="module")
def library():
    tool = Tokenizer.from_file(PATH)
    return lambda text: tool.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_ids_of_whole_texts(library, monkeypatch):
    rng = random.Random(2)
    chars = " \n\t  ab'sé.,1\u3000\u00a0日-|#Z"
    texts = TEXTS + ["".join(rng.choice(chars) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    monkeypatch.setattr(tokens, "KEPT", 300)
    monkeypatch.setattr(tokens, "CHARS", 500)
    tool = tokens.Encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in tool.encode(texts)] == [library(t) for t in texts]


@pytest.mark.parametrize("n", [1, 2, 5, 300, 50257])
def test_codes_are_complete_and_decode(n):
    rng = np.random.default_rng(n)
    counts = rng.zipf(1.3, n) % 10**9 + 1
    counts[rng.random(n) < 0.2] = 0
    counts[0] += 1
    lengths = huffman.code_lengths(counts)
    used = lengths[lengths > 0].astype(float)
    assert lengths.max() <= huffman.LIMIT and ((counts > 0) == (lengths > 0)).all()
    assert (2.0**-used).sum() == (1 if len(used) > 1 else 0.5)
    ids = rng.choice(n, 3000, p=counts / counts.sum())
    for size in (1, 255, 256, 257, 512, 3000):
        bits, marks = huffman.pack(ids[:size], huffman.codes_of(lengths), lengths)
        assert (huffman.unpack(bits, marks, size, huffman.lookup(lengths)) == ids[:size]).all()


def test_lengths_are_least_under_the_limit():
    # without the limit, Fibonacci counts make codes longer than 16 bits
    counts = [1, 1]
    while len(counts) < 30:
        counts.append(counts[-1] + counts[-2])
    assert huffman.code_lengths(np.array(counts)).max() == huffman.LIMIT
    counts = np.array([5, 9, 12, 13, 16, 45])
    assert (huffman.code_lengths(counts) * counts).sum() == 224


def test_files_round_trip(spark, library, tmp_path):
    rows = [(i * 7 % 13 if i < 13 else None, t, "x") for i, t in enumerate([*TEXTS, "again", "again"])] + [(3, "twice", "x"), (3, "twice", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(4)
    got = huffman.token_round_trip(docs, PATH).orderBy("start").collect()
    assert len(got) == len(rows) and [r.doc_id for r in got] == sorted((r[0] for r in rows), key=lambda x: (x is not None, x or 0))
    start = 0
    for r in got:
        assert r.start == start
        start += r.n_tokens
    crc = lambda t: zlib.crc32(np.array([*library(t), 2], "<u4").tobytes())
    assert sorted((r.doc_id is None, r.doc_id or 0, r.ids_crc32) for r in got) == sorted((r[0] is None, r[0] or 0, crc(r[1])) for r in rows)
    assert huffman.token_round_trip(docs.where("false"), PATH).count() == 0


def packed(spark, rows, room=64, shard=None):
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard string")
    return packing.pack_documents(docs, PATH, room=room).collect()


def test_packing_holds_every_piece_once(spark, library):
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["on", "the", "way", "out"]) for _ in range(rng.choice([3, 20, 40, 70, 200]))), "x") for i in range(300)]
    rows += [(i, t, "x") for i, t in enumerate(TEXTS, 1000)] + [(None, "same", "x")] * 3
    got = packed(spark, rows)
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at and length > 0
            at += length
        assert at <= 64
    total = 0
    by_doc = {}
    for r in got:
        by_doc.setdefault(r.doc_id, []).append(r)
    for i, t, _ in rows:
        ids = [*library(t), 0]
        total += len(ids)
        if i is None:
            continue
        own = sorted(by_doc[i], key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(-(-len(ids) // 64)))
        assert all(r.length == 64 for r in own[1:]) and sum(r.length for r in own) == len(ids)
        for r in own:
            assert r.ids_crc32 == zlib.crc32(np.array(ids[r.start : r.start + r.length], "<u4").tobytes())
    assert len(by_doc[None]) == 3
    assert len(bins) <= -(-total // 64) * 1.02 + 1
    assert packed(spark, []) == []


def test_exchanges_empty_bins():
    # best fit leaves 6+3 | 5+4 | 2, while 6+4 | 5+3+2 is enough
    sizes = [6, 5, 4, 3, 2]
    better = packing.Search(sizes, [[0, 3], [1, 2], [4]], 10).run()
    assert sorted(i for b in better for i in b) == [0, 1, 2, 3, 4] and len(better) == 2
    rng = np.random.default_rng(1)
    lengths = rng.integers(1, 101, 2000)
    first = packing.best_fit(lengths, 100)
    after = packing.Search(lengths.tolist(), [b[:] for b in first], 100).run()
    assert len(after) <= len(first) and all(sum(lengths[i] for i in b) <= 100 for b in after)
    assert sorted(i for b in after for i in b) == list(range(2000))


def test_parts_are_numbers_and_may_be_forgotten(monkeypatch):
    monkeypatch.setattr(tokens, "KEPT", 40)
    rng = random.Random(11)
    marks = ["", ",", ".", "!?", "...", "\n", "7", "é", "\u3000", "x-y"]
    texts = ["".join(rng.choice(["", " ", "  "]) + "".join(rng.choice("abcdé") for _ in range(rng.randint(0, 4))) + rng.choice(marks) for _ in range(50)) for _ in range(40)]
    tool = tokens.Encoder(PATH)
    for k in range(0, len(texts), 5):
        for text, ids in zip(texts[k : k + 5], tool.encode(texts[k : k + 5]), strict=True):
            assert ids.tolist() == tool.library.encode(text, add_special_tokens=False).ids
    assert all(isinstance(x, int) and 0 <= x < len(tool.ends_of_parts) - 1 for x in tool.splits.values())


def test_an_operator_may_keep_fewer_pieces(library, monkeypatch):
    monkeypatch.setattr(tokens, "CHARS", 500)
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("abcdé") for _ in range(6)) for _ in range(60)) for _ in range(60)]
    few = tokens.encoder(PATH, 100)
    for text, ids in zip(texts, few.encode(texts), strict=True):
        assert ids.tolist() == library(text)
        assert len(few.pieces) < 400  # one batch of new pieces at most on top
    assert tokens.encoder(PATH, 100) is few
    assert tokens.encoder(PATH) is not few and packing.KEPT < tokens.KEPT


def test_blocks_of_every_length_come_back():
    rng = np.random.default_rng(4)
    counts = np.r_[0, 1 << np.arange(20), np.ones(300, np.int64), 0]
    lengths = huffman.code_lengths(counts)
    codes, table = huffman.codes_of(lengths), huffman.lookup(lengths)
    assert lengths.max() == huffman.LIMIT
    for n in (1, 2, 63, 64, 255, 256, 257, 511, 512, 513, 5000):
        ids = rng.integers(1, len(counts) - 1, n)
        bits, marks = huffman.pack(ids, codes, lengths)
        want = "".join(format(int(codes[i]), f"0{lengths[i]}b") for i in ids)
        assert "".join(format(x, "08b") for x in bits)[: len(want)] == want
        assert huffman.unpack(bits, marks, n, table).tolist() == ids.tolist()


def test_odd_spaces_are_seen_without_a_search():
    space = [chr(x) for x in range(0x110000) if tokens.re.match(r"\s", chr(x))]
    assert set(space) == {" ", "\n", *tokens.RARE}
    for x in [*space, "a", "\u200b"]:
        for text in (f"a {x}b", f"a{x} b", f"a{x}b c", f"{x}", f" {x}", f"{x} "):
            assert tokens._odd(text) == bool(tokens.ODD.search(text))
