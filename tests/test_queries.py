"""Every kind of query against its SQL counterpart on the smallest tables."""

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries

FOLDER = "/root/testdata/sf0.001"

# The rest runs the same operators and is left out here only to keep the suite short.
CHECKED = [
    "edge_merge_independent", "edge_merge_smallest", "edge_discretize", "boundary_edge_min", "negative_toggles", "joint_probability",
    "implied_weight", "model_pieces", "model_graph", "negative_observables", "observables_from_paths", "shot_slice", "number_functions", "name_functions", "obs_mask_unpack", "shot_hits_normalized", "pair_dist_bounded",
    "boundary_dist", "shortest_path_weight_noisy", "threshold_components", "cluster_levels", "cluster_parent", "ready_time", "match_weight",
    "critical_path", "cluster_event_costs", "makespan_lpt", "percentile_linear", "level_stats", "level_counts_zero_filled",
    "level_count_histogram", "power_law_fit", "speedup_pairing", "spaced_sample", "error_sampling", "case_roundtrip", "adaptive_level1",
]


@pytest.fixture(scope="module")
def con():
    return compare.connect(FOLDER)


@pytest.mark.parametrize("name", CHECKED)
def test_against_sql(spark, con, name):
    assert compare.difference(queries()[name](spark, FOLDER), con, oracle_sql()[name]) is None


def test_entry(spark):
    assert entry(spark).count() == 1472


def test_signed_and_correlated_are_no_heavier_than_plain(spark):
    plain = {r.shot: r.weight for r in queries()["match_weight_noisy"](spark, FOLDER).collect()}
    lowered = {r.shot: r.weight for r in queries()["match_weight_correlated"](spark, FOLDER).collect()}
    assert plain.keys() == lowered.keys() and all(lowered[s] <= plain[s] for s in plain)
