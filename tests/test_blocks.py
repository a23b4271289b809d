"""A graph that stays a table, searched in many small blocks, against the broadcast form."""

import random

import pytest

from pairloom.operators import blocks, clusters, paths
from pairloom.operators.clusters import threshold_components
from pairloom.operators.pairs import near_pairs, pairs_within
from pairloom.operators.paths import Graph, balls, pair_distances
from pairloom.operators.regions import owned

DISCRETE = "u long, v long, w long, sign int, obs_mask long"


@pytest.fixture(scope="module")
def graphs(spark):
    rng = random.Random(11)
    rows = []
    for n in range(120):  # ten columns, some steps missing, some far
        for v in ((n + 1) if n % 10 < 9 else None, n + 10, (n + 57) if n % 17 == 0 else None):
            if v is not None and v < 120 and rng.random() < 0.9:
                rows.append((n, v, 2 * rng.randint(1, 4), 1, n % 8))
        if n % 10 == 0:
            rows.append((n, None, 4, 1, 1))
    table = spark.createDataFrame(rows, DISCRETE)
    return Graph(table), Graph(table, broadcast_edges=0)


@pytest.fixture(scope="module")
def hits(spark):
    rng = random.Random(5)
    rows = [(shot, det) for shot in range(60) for det in rng.sample(range(120), 1 + shot % 7)]
    return spark.createDataFrame(rows, "shot long, det long")


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    def refuse(*_):
        raise AssertionError("a short reach must not grow by joins")

    monkeypatch.setattr(blocks, "BLOCK", 16)
    monkeypatch.setattr(paths, "_balls_by_join", refuse)


def rows_of(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()))


def both(graphs, make, *columns):
    flat, table = graphs
    assert flat.flat is not None and table.flat is None
    want = rows_of(make(flat), *columns)
    assert want and rows_of(make(table), *columns) == want


def test_balls(spark, graphs):
    sources = spark.createDataFrame([(n, n % 25) for n in range(130)], "src long, radius long")
    both(graphs, lambda g: balls(g, sources), "src", "node", "d")


def test_pair_distances(spark, graphs):
    asked = spark.createDataFrame([(a, b, 10 + a % 20) for a in range(0, 120, 3) for b in range(a, 125, 2)], "u long, v long, cap long")
    both(graphs, lambda g: pair_distances(g, asked), "u", "v", "d")


def test_pairs_of_shots(graphs, hits):
    both(graphs, lambda g: pairs_within(hits, g, 22), "shot", "u", "v", "d")
    wide = hits.selectExpr("shot", "det", "double(det % 13) AS rho")
    both(graphs, lambda g: near_pairs(wide, g, strict=True), "shot", "u", "v", "d")


def test_threshold_components(graphs, hits):
    both(graphs, lambda g: threshold_components(hits, g, 14), "shot", "det", "root")


def test_owned(graphs, hits):
    both(graphs, lambda g: owned(hits, g, 9), "shot", "node", "owner", "d")


@pytest.mark.parametrize("posts", [3, 1000])
def test_far_links_chain_as_regions_do(graphs, hits, monkeypatch, posts):
    flat = graphs[0]
    want = rows_of(threshold_components(hits, flat, 14), "shot", "det", "root")

    def refuse(*_):
        raise AssertionError("far steps must not grow regions shot by shot")

    monkeypatch.setattr(blocks, "MOST_HOPS", 1)
    monkeypatch.setattr(clusters, "POSTS", posts)
    monkeypatch.setattr(clusters, "meetings", refuse)
    flat._tables.pop("posts 14", None)
    assert rows_of(threshold_components(hits, flat, 14), "shot", "det", "root") == want
