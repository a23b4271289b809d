import re
import zlib

import numpy as np
import plain
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def contaminated(docs, items):
    """Ids of documents of which windows of items cover a twentieth."""
    windows = set()
    for item in items:
        w = words(item)
        windows |= {tuple(w[i : i + 13]) for i in range(max(1, len(w) - 12))} if w else set()
    by_first = {}
    for window in windows:
        by_first.setdefault(window[0], []).append(window)
    out = set()
    for i, text in docs.items():
        w = words(text)
        hit = set()
        for at, first in enumerate(w):
            for window in by_first.get(first, ()):
                if tuple(w[at : at + len(window)]) == window:
                    hit |= set(range(at, at + len(window)))
        if hit and 20 * len(hit) >= len(w):
            out.add(i)
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    kept = [{r.doc_id: r.text for r in docs.collect()}]
    tables = [docs]
    for name, stage in corpus_pipeline.STAGES:
        place = str(tmp_path / name)
        stage(spark, tables[-1], FOLDER).write.parquet(place)
        tables.append(spark.read.parquet(place))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert tables[-1].columns == COLUMNS
            kept.append({r.doc_id: r.text for r in tables[-1].collect()})
    good, apart, clean, redacted = kept[1:]
    # a stage only takes documents away, or changes texts where that is its work
    assert set(good.items()) <= set(kept[0].items()) and len(good) > len(kept[0]) // 3
    component = plain.links(good, 5)
    assert apart == {i: t for i, t in good.items() if component[i] == i}
    items = [r.text for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    taken = contaminated(apart, items)
    assert clean == {i: t for i, t in apart.items() if i not in taken}
    assert set(redacted) == set(clean)
    for i, text in redacted.items():
        assert not plain.base_spans(text or "")
        if not plain.base_spans(clean[i] or "") and not re.search(r"[0-9@]", clean[i] or ""):
            assert text == clean[i]
    sizes = {r.doc_id: r.n_chars for r in tables[4].collect()}
    assert sizes == {i: len(t or "") for i, t in redacted.items()}

    tool = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, places = {}, {}
    for r in tables[-1].collect():
        pieces.setdefault(r.doc_id, []).append((r.piece, r.start, r.length, r.ids_crc32))
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(redacted)
    for i, own in pieces.items():
        ids = np.array([*tool.encode(redacted[i] or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for n, (piece, start, length, crc) in enumerate(sorted(own)):
            assert (piece, start) == (n, at) and crc == zlib.crc32(ids[at : at + length].tobytes())
            at += length
        assert at == len(ids)
    for row in places.values():
        row.sort()
        assert [o for o, _ in row] == [sum(n for _, n in row[:k]) for k in range(len(row))] and sum(n for _, n in row) <= 2048


def test_run_is_the_stages_in_order(spark):
    assert [name for name, _ in corpus_pipeline.STAGES] == [
        "quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii_redaction", "best_fit_packing"
    ]
    out = corpus_pipeline.run(spark, FOLDER)
    assert out.columns[:7] == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and out.count() > 50
