import random

import plain
import pytest
from pyspark.sql import functions as F

from pairloom.llm import decontaminate, near_dup, pii, quality_rules, repeats, site_quality
from pairloom.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
ODD = [None, "", " \n\t ", "one", "One TWO", "x" * 30_000, "a b " * 4000, "é ü\u00a0ñ 日本", "\x0b\x1c \x85"]
# columns whose names the operators use inside
EXTRA = "doc_id long, text string, lang string, source string, n_chars long, place long, row string, body string, key string, doc long, n long"


def table(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or ""), 1, "r", "b", "k", 2, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, EXTRA)


def near_texts(rng, n=60):
    words = ["w%d" % i for i in range(300)]
    out = []
    for _ in range(n // 6):
        base = [rng.choice(words) for _ in range(rng.randint(5, 120))]
        out.append(" ".join(base))
        for _ in range(5):
            other = base[:]
            for _ in range(rng.randint(0, 1 + len(base) // 12)):
                other[rng.randrange(len(other))] = rng.choice(words)
            out.append(" ".join(other))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_components_against_all_pairs(spark, k):
    rng = random.Random(k)
    texts = near_texts(rng) + ODD + ["ONE", "one two", "same again"] + ["same again"] * 3
    docs = table(spark, texts).repartition(3)
    docs.write.parquet(place := __import__("tempfile").mkdtemp() + "/t")
    docs = spark.read.parquet(place)
    want = plain.links(dict(enumerate(texts)), k)
    got = {r.doc: r.component for r in near_dup.components(docs, k=k).collect()}
    assert got == want
    kept = near_dup.drop_near_copies(docs, k=k)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.select("doc_id").collect()) == sorted(set(want.values()))


def test_chains_are_joined_whole(spark):
    # each text is near the next only: the first comparison cannot join them all
    words = ["v%d" % i for i in range(140)]
    texts = [" ".join(words[i : i + 100]) for i in range(0, 40, 4)]
    got = near_dup.components(table(spark, texts), k=2).collect()
    assert {r.component for r in got} == set(plain.links(dict(enumerate(texts)), 2).values()) == {0}


def test_sizes_that_fit_no_first_member_are_still_compared(spark, tmp_path):
    # long rows come first in the buckets of the last two, which are near each other only
    passage = ["p%d" % i for i in range(241)]
    own = [100] * 40 + [30, 30]
    texts = [" ".join(passage + ["o%d_%d" % (i, j) for j in range(n)]) for i, n in enumerate(own)]
    table(spark, texts).coalesce(1).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    want = plain.links(dict(enumerate(texts)), 2)
    assert want[41] == 40 and len(set(want.values())) == 41
    assert {r.doc: r.component for r in near_dup.components(docs, k=2).collect()} == want


def family(n, seed):
    """Texts that share nearly all their shingles, of which few reach the similarity."""
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(3000)]
    base = [rng.choice(words) for _ in range(200)]
    out = []
    for _ in range(n):
        text = base[:]
        for at in rng.sample(range(200), rng.randint(3, 8)):
            text[at] = rng.choice(words) + "x"
        out.append(" ".join(text))
    return out


def test_a_family_of_near_copies_lists_links_only(monkeypatch, spark, tmp_path):
    monkeypatch.setattr(near_dup, "MEMBERS", 60)  # several blocks
    asked = []
    confirmed = near_dup.confirmed
    monkeypatch.setattr(near_dup, "confirmed", lambda pairs, *more: confirmed(asked.append(pairs.count()) or pairs, *more))
    texts = family(240, 3)
    table(spark, texts).write.parquet(str(tmp_path / "t"))
    got = {r.doc: r.component for r in near_dup.components(spark.read.parquet(str(tmp_path / "t")), k=5).collect()}
    assert got == plain.links(dict(enumerate(texts)), 5)
    assert len(asked) < 3 or asked[2] < 240


def test_a_text_of_many_large_buckets_is_sent_once(monkeypatch, spark, tmp_path):
    sent, in_batches = [], near_dup.in_batches

    def seen(rows, *more):
        if {"root", "set"} <= set(rows.columns):
            sent.append(rows.count())
        return in_batches(rows, *more)

    monkeypatch.setattr(near_dup, "in_batches", seen)
    texts = family(240, 3)
    table(spark, texts).write.parquet(str(tmp_path / "t"))
    got = {r.doc: r.component for r in near_dup.components(spark.read.parquet(str(tmp_path / "t")), k=5).collect()}
    assert got == plain.links(dict(enumerate(texts)), 5)
    assert len(sent) == 1 and 0 < sent[0] <= len(texts)


def test_families_are_parted_by_size(monkeypatch, spark, tmp_path):
    # near copies of one text cut at many lengths: links within a band of sizes and across two
    monkeypatch.setattr(near_dup, "MEMBERS", 12)
    monkeypatch.setattr(near_dup, "FEW", 2)
    rng = random.Random(5)
    texts = []
    for text in family(120, 8):
        words = text.split()
        texts.append(" ".join(words[: rng.randint(60, 200)]))
    table(spark, texts).write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    sets = {i: near_dup.shingles(near_dup.words_of(t), 2) for i, t in enumerate(texts)}
    rows = [(i, i, len(x), near_dup.shingle_hashes(near_dup.words_of(t), 2).view("int64").tolist()) for (i, x), t in zip(sets.items(), texts)]
    held = spark.createDataFrame(rows, "node long, root long, n long, set array<long>")
    members = spark.createDataFrame([(i, 0) for i in sets], "node long, family long")
    got = {(r.a, r.b) for r in near_dup._linked_in_blocks(members, held, 80).collect()}
    want = {(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])}
    assert got == want and len(want) > 100
    assert {r.doc: r.component for r in near_dup.components(docs, k=2).collect()} == plain.links(dict(enumerate(texts)), 2)


def test_repeated_rows_and_null_ids_leave_one(spark):
    docs = table(spark, ["same text of six words here"] * 4 + [None, None], ids=[7, 7, None, 3, None, None])
    kept = near_dup.drop_near_copies(docs).select("doc_id", "text").collect()
    assert sorted((r.doc_id or -1, r.text or "") for r in kept) == [(-1, ""), (-1, ""), (3, "same text of six words here")]
    assert near_dup.components(docs.where("false")).count() == 0


def test_tensored_keys_meet():
    rng = random.Random(1)
    met = 0
    for _ in range(300):
        base = {rng.getrandbits(60) for _ in range(90)}
        other = set(list(base)[:80]) | {rng.getrandbits(60) for _ in range(10)}
        import numpy as np

        a, b = (near_dup.signature(np.array(sorted(x), np.uint64), 9, 2) for x in (base, other))
        met += any(a[:9] == b[:9]) and any(a[9:] == b[9:])
    assert met >= 299


def test_repeats_against_every_window(spark):
    rng = random.Random(9)
    common = ["".join(rng.choice("abcdefgh ") for _ in range(n)) for n in (99, 100, 101, 260)]
    texts = []
    for _ in range(40):
        texts.append("".join(rng.choice([*common, "ab" * 90, "z" * 150, "".join(rng.choice("xyz é") for _ in range(rng.randint(0, 120)))]) for _ in range(rng.randint(0, 4))))
    texts += ODD + [texts[0]] * 3
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    docs = table(spark, texts, ids).repartition(3)
    docs.write.parquet(place := __import__("tempfile").mkdtemp() + "/t")
    got = sorted(tuple(r) for r in repeats.remove_repeats(spark.read.parquet(place)).drop("kept").collect())
    assert got == plain.repeats(sorted((i, (t or "").encode()) for i, t in zip(ids, texts)))
    assert repeats.remove_repeats(docs.where("false")).count() == 0


def test_no_task_gathers_a_minimizer_of_many_documents(monkeypatch, spark, tmp_path):
    rng = random.Random(4)
    line = "".join(rng.choice("abcdefgh ") for _ in range(60))
    other = ["".join(rng.choice("xyz é") for _ in range(150)) for _ in range(120)]
    texts = [other[2 * i] + line + other[2 * i + 1] for i in range(60)] + [other[0] + line + other[1] + "end", other[7][-60:] + line, line * 5]
    table(spark, texts).repartition(3).write.parquet(str(tmp_path / "t"))
    found, whole = [], repeats.repeated_stretches
    monkeypatch.setattr(repeats, "HOT", 10, raising=False)
    monkeypatch.setattr(repeats, "repeated_stretches", lambda dealt, size: whole(found.append(dealt) or dealt, size))
    got = sorted(tuple(r) for r in repeats.remove_repeats(spark.read.parquet(str(tmp_path / "t"))).drop("kept").collect())
    assert got == plain.repeats([(i, t.encode()) for i, t in enumerate(texts)])
    assert max(r["count"] for r in found[0].where("text IS NOT NULL").groupBy("key").count().collect()) <= 10


def test_repeats_in_parts(monkeypatch, spark):
    import numpy as np

    raw = np.frombuffer(b"abcabcabcabc" * 30 + bytes(8), np.uint8)
    start = np.arange(200)
    whole = repeats.later_copies(raw, start, np.zeros(200, int), 20)
    assert whole.tolist() == [False] * 3 + [True] * 197


def test_base_spans_and_counts_against_plain():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789012345678901234567890..@@ab+ -() \n%é٣") for _ in range(rng.randint(0, 50)))
        assert pii.base_spans(text) == plain.base_spans(text)
        text = "".join(rng.choice("ab \n\n\t|é\x1c\u00a0") for _ in range(rng.randint(0, 80)))
        assert quality_rules.counts_of(text)[:5] == plain.counts(text)
    many = " ".join("w%d" % rng.randrange(9000) for _ in range(30_000)) + " a b c d e f a b c d e"
    assert quality_rules.counts_of(many)[:5] == plain.counts(many)


def test_the_field_finds_held_out_entities():
    weights = pii.train()
    rng = random.Random(99)
    right = wrong = missed = 0
    for atoms, left, after, true in pii.region_examples([pii._example(rng) for _ in range(400)]):
        got = set(pii.decode(atoms, left, after, weights))
        right, wrong, missed = right + len(got & true), wrong + len(got - true), missed + len(true - got)
    assert right > 300 and wrong < 0.05 * right and missed < 0.05 * right
    assert [(x[1], x[3]) for x in pii.all_spans("call (743) 555-3824 now", weights)] == [(3, False)]
    assert pii.all_spans("in 2024, version 1.2.3, item 1234567", weights) == []


def test_pii_rows_and_redaction(spark):
    texts = ["mail joe.x@mail.example.com or 10.1.2.3!", *ODD, "+1 (743) 555-3824", "4111 1111 1111 1111"]
    docs = table(spark, texts)
    found = {r.row.doc_id: r.spans for r in pii.find_spans(docs).collect()}
    assert len(found) == len(texts) and [s.kind for s in found[0]] == ["email", "ip"] and not any(found[i] for i in range(1, 1 + len(ODD)))
    clean = pii.redact(docs)
    assert clean.columns == docs.columns
    got = {r.doc_id: r.text for r in clean.collect()}
    assert got[0] == "mail [EMAIL] or [IP]!" and got[1] is None and got[10] == "[PHONE]" and got[11] == "[CARD]"
    assert pii.redact(docs.where("false")).count() == 0


def test_query_rows_of_pii(spark):
    rows = {r.doc_id: r for r in QUERIES["op1_pii"](spark, FOLDER).collect()}
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        want = plain.base_spans(r.text or "")
        own = rows[r.doc_id]
        assert [own.n_email, own.n_ip, own.n_card, own.n_phone] == [sum(k == i for _, k, _ in want) for i in range(4)]
        assert own.base_sha256 == __import__("hashlib").sha256(",".join(f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in want).encode()).hexdigest()


def test_quality_rules(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_quality_rules"](spark, FOLDER).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = sum(rows[i].kept == (q == 1) for i, q in labels.items() if not rows[i].base_failed)
    assert right >= 0.95 * sum(not rows[i].base_failed for i in labels)
    for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect():
        own = rows[r.doc_id]
        n, chars, symbols, lines, repeat = plain.counts(r.text or "")
        assert (own.n_words, own.word_chars, own.n_symbols, own.n_dup_lines, own.n_repeat_words) == (n, chars, symbols, lines, repeat)
        assert own.base_failed == (n < 10 or 100 * repeat > 20 * n) and not (own.base_failed and own.kept)
    odd = quality_rules.judge_quality(table(spark, ODD + ["good"] * 3)).collect()
    assert len(odd) == len(ODD) + 3 and all(r.base_failed for r in odd if r.n_words < 10)
    assert quality_rules.judge_quality(table(spark, ODD).where("false")).count() == 0


def test_decontamination(spark):
    words = ["q%d" % i for i in range(40)]
    items = [("a", " ".join(words[:20])), ("b", "short Item"), ("c", None), (None, " ".join(words[20:40])), ("a", " ".join(words[:20])), ("d", "?!")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    texts = ["x " * 50 + " ".join(words[2:18]).upper() + " y", "a SHORT; item!", " ".join(words[:12]), " ".join(words[19:33]) + " z", *ODD, "short item " * 3]
    docs = table(spark, texts)
    for block in (1_000_000, 3):
        found = decontaminate.judge(decontaminate.find_matches(docs, bench, block=block))
        got = {r.row.doc_id: (r.n_words, r.n_hit, r.items, r.contaminated) for r in found.collect()}
        assert got[0] == (67, 16, ["a"], True) and got[1] == (3, 2, ["b"], True) and got[2] == (12, 0, [], False)
        assert got[3] == (15, 13, [""], True) and got[4 + len(ODD)] == (6, 6, ["b"], True)
        assert all(not got[i][1] for i in range(4, 4 + len(ODD)))
    longest = decontaminate.find_matches(docs, bench).where("row.doc_id = 0").first().matches
    assert [(m["item"], m["item_word"], m["doc_word"], m["n_words"]) for m in longest] == [("a", 2, 50, 16)]
    kept = decontaminate.remove_contaminated(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, *range(4, 4 + len(ODD))]
    none = bench.where("false")
    assert decontaminate.remove_contaminated(docs, none).count() == len(texts)
    assert decontaminate.remove_contaminated(docs.where("false"), bench).count() == 0


def test_site_classifier_on_held_out_labels(spark):
    """Half of the labels train. Junk shows in the shape of a text; abuse shows in a few
    words only, of which some thousand labelled rows teach a part."""
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    first = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0)
    rest = labels.join(first.select("doc_id"), "doc_id", "left_anti")
    rows = site_quality.classify(docs, first).join(rest, "doc_id").collect()
    kept = {}
    for r in rows:
        kept.setdefault((r.quality, r.toxic), []).append(r.kept)
    share = {k: sum(v) / len(v) for k, v in kept.items()}
    assert share[1, 0] >= 0.97 and share[0, 0] <= 0.05 and share[1, 1] <= 0.6, share


def test_sites_shrink_toward_their_host(spark):
    rows = [("h", "p", 2.0)] * 50 + [("h", "q", -2.0)] + [("g", "p", -2.0)] * 50 + [(None, None, 0.0)]
    scored = spark.createDataFrame(rows, "host string, path string, own double")
    sites = {(r.host, r.path): r.site for r in site_quality.judge(scored, site_quality.site_levels(scored)).collect()}
    # the only page of h/q stands by its host, not by itself
    assert sites["h", "q"] > 0.5 > sites["g", "p"] and len(sites) == 4
    assert site_quality.site_levels(scored.where("false")).count() == 0


def test_classifier_edges(spark):
    docs = table(spark, ODD + ["fine words"] * 4)
    labels = spark.createDataFrame([(3, 1, None), (4, 0, 1), (None, 1, 0), (5, None, 0), (3, 1, 0)], "doc_id long, quality int, toxic int")
    assert site_quality.classify(docs, labels).count() == len(ODD) + 4
    kept = site_quality.keep_good(docs, labels.where("false"))
    assert kept.columns == docs.columns and kept.count() == len(ODD) + 4
    assert site_quality.keep_good(docs.where("false"), labels).count() == 0
