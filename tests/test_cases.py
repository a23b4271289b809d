import random

import pytest
from brute import distances, least_weight
from pyspark.sql import functions as F
from test_decode import as_hits, many_shots
from test_graph import USER, random_edges

from pairloom.functions.masks import flag_words, flags_of_words
from pairloom.plans.cases import run_cases
from pairloom.plans.decode import Decoder, Options, decode_case
from pairloom.sources.casefile import read_cases

EDGE = "e {} {} {} 0.1 {}\n"


def write(path, edges, shots):
    top = max(x for u, v, _, _ in edges for x in (u, v) if x is not None)
    lines = [f"{top + 1} 4 {len(edges)} {len(shots)} 3 3 0.001\n"]
    lines += [EDGE.format(u, -1 if v is None else v, w, " ".join(map(str, [len(obs), *obs]))) for u, v, w, obs in edges]
    lines += [f"s {mask} {len(hits)} {' '.join(map(str, hits))}\n" for mask, hits in shots]
    path.write_text("".join(lines))


def test_cases_side_by_side_as_one_by_one(spark, tmp_path):
    rng = random.Random(4)
    files = {}
    for name, seed, scale in (("a", 51, 1), ("b", 52, 0.37)):
        edges = [(u, v, w * scale, [rng.randrange(4)] if rng.random() < 0.4 else []) for u, v, w in random_edges(seed, n=12, m=20)]
        if name == "b":  # some weights are negative
            edges = [(u, v, -w if k % 5 == 0 else w, obs) for k, (u, v, w, obs) in enumerate(edges)]
        nodes = sorted({x for u, v, _, _ in edges for x in (u, v) if x is not None})
        shots = [(rng.randrange(16), rng.sample(nodes, rng.randint(0, 6))) for _ in range(14)]
        write(tmp_path / f"{name}.txt", edges, shots)
        files[name] = len(shots)
    run = run_cases(read_cases(spark, f"{tmp_path}/*.txt"))
    got = {}
    for r in run.results.collect():
        got.setdefault(r.case.rsplit("/", 1)[1][0], {})[r.shot] = (r.n_hits, r.weight, r.status, r.true_mask)
    for name in files:
        alone = decode_case(read_cases(spark, str(tmp_path / f"{name}.txt")))
        assert got[name] == {r.shot: (r.n_hits, r.weight, r.status, r.true_mask) for r in alone.collect()}
    totals = {r.case.rsplit("/", 1)[1][0]: r for r in run.totals.collect()}
    assert {k: r.shots for k, r in totals.items()} == files
    wrong = {}
    for r in run.mistakes.collect():
        wrong.setdefault(r.case.rsplit("/", 1)[1][0], set()).add(r.shot)
        assert r.predicted != r.expected and r.predicted_bits != r.expected_bits
    assert {k: len(wrong.get(k, ())) for k in files} == {k: r.mistakes for k, r in totals.items()}
    for rows in (run.hits, run.pairs):
        assert all(r.shot in wrong[r.case.rsplit("/", 1)[1][0]] for r in rows.select("case", "shot").collect())


def test_a_hit_outside_its_own_case_is_an_error(spark, tmp_path):
    write(tmp_path / "a.txt", [(0, 1, 2, []), (1, None, 2, [])], [(0, [0])])
    write(tmp_path / "b.txt", [(0, 9, 2, []), (9, None, 2, [])], [(0, [1])])  # node 1 is known in the other case only
    with pytest.raises(Exception, match="outside the graph"):
        run_cases(read_cases(spark, f"{tmp_path}/*.txt"))


def test_two_hundred_observables(spark):
    rng = random.Random(8)
    rows = random_edges(61, n=14, m=24)
    nodes = sorted({x for u, v, _ in rows for x in (u, v) if x is not None})
    # an edge flips the flags of its ends, so every way flips the same
    own = {x: set(rng.sample(range(200), 5)) for x in nodes}
    edges = [(u, v, float(w) * (-1 if k % 6 == 0 else 1), 0.1, sorted(own[u] ^ (own[v] if v is not None else set())), k) for k, (u, v, w) in enumerate(rows)]
    shots = many_shots(nodes, 12, 3)
    everyone = spark.createDataFrame([(s,) for s in [*shots, 77]], "shot long")
    decoder = Decoder(spark.createDataFrame(edges, USER), options=Options(masks=False))
    got = {r.shot: r for r in decoder.decode_observables(everyone, as_hits(spark, shots)).collect()}
    assert set(got) == {*shots, 77} and got[77].status == "ok"
    for s, hits in shots.items():
        want = set()
        for h in hits:
            want ^= own[h]
        assert got[s].obs == sorted(want)
        assert sum(word % 2**64 << 64 * i for i, word in enumerate(got[s].words)) == sum(1 << x for x in want)
    d, rim = distances([(u, v, abs(w)) for u, v, w, *_ in edges], nodes)
    toggled = [x for x in nodes if sum(w < 0 and x in (u, v) for u, v, w, *_ in edges) % 2]
    less = sum(w for _, _, w, *_ in edges if w < 0)
    for s, hits in {**shots, 77: []}.items():
        assert got[s].weight == 2 * (least_weight(set(hits) ^ set(toggled), d, rim) + less)
    with pytest.raises(ValueError):
        Decoder(spark.createDataFrame(edges[:1], USER).withColumn("obs", F.array(F.lit(3)))).decode_observables(everyone, as_hits(spark, shots))


def test_words_of_flags(spark):
    rows = [(1, 0), (1, 63), (1, 64), (1, 199), (2, 5), (2, 5), (3, 130), (3, 130), (3, 130)]
    words = flag_words(spark.createDataFrame(rows, "shot long, obs long"), ["shot"])
    got = {r.shot: (r.words, r.obs) for r in words.withColumn("obs", flags_of_words(F.col("words"))).collect()}
    assert got == {1: ([1 - 2**63, 1, 0, 128], [0, 63, 64, 199]), 2: ([], []), 3: ([0, 0, 4], [130])}


def test_round_trip_reads_each_table_once(spark):
    """Edges and header in one pass each; shots and hits in two, one of which counts the shots of each block."""
    from pairloom.catalog.queries import QUERIES

    plan = QUERIES["case_roundtrip"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < sum("Relation" in line and line.rstrip().endswith("text") for line in plan.splitlines()) <= 6
