"""Every operator as a named query over the supplied tables: (spark, folder) -> DataFrame."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from pairloom.functions import masks, numeric, text, weights
from pairloom.operators import accounting, adaptive, clusters, correlated, edges, hierarchy, hits as hit_ops, landmarks, matching, paths, regions, sampling, stats
from pairloom.operators.clusters import Level
from pairloom.operators.pairs import pairs_within
from pairloom.operators.paths import Graph
from pairloom.plans import bounds as schedules, cases
from pairloom.plans.decode import Decoder, Options, decode_case
from pairloom.session import cut, shared_folder
from pairloom.sources import casefile, errormodel, lattice, sinks
from pairloom.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

# The first two levels of the schedule of the unit lattice.
LEVELS = [Level(3, 10), Level(53, 1300)]
CHAIN = 16


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


_graphs: dict[tuple[str, str, str], Graph] = {}


def _graph(spark: SparkSession, folder: str, weights_of: str) -> Graph:
    """A graph is prepared once per application; its boundary and component tables stay with it."""
    key = (spark.sparkContext.applicationId, folder, weights_of)
    if key not in _graphs:
        _graphs[key] = Graph(edges.search_ready(edges.discretise(lattice.edges(spark, folder, weights_of))))
    return _graphs[key]


def unit_graph(spark: SparkSession, folder: str) -> Graph:
    return _graph(spark, folder, "unit")


def noisy_graph(spark: SparkSession, folder: str) -> Graph:
    return _graph(spark, folder, "noisy")


def r9(name: str):
    return F.round(name, 9).alias(name)


# Edges ---------------------------------------------------------------------


def _merged(strategy: str) -> Query:
    def run(spark: SparkSession, folder: str) -> DataFrame:
        out = edges.merge_parallel(lattice.parallel_edges(spark, folder), strategy)
        return out.select("u", "v", r9("w"), r9("p"), F.array_join(F.col("obs").cast("array<string>"), ";").alias("obs"), "parallel")

    return run


QUERIES["edge_merge_independent"] = _merged("independent")
QUERIES["edge_merge_smallest"] = _merged("smallest_weight")
QUERIES["edge_merge_keep"] = _merged("keep_original")
QUERIES["edge_merge_replace"] = _merged("replace")


@query
def edge_merge_disallow_count(spark, folder):
    merged = edges.merge_parallel(lattice.parallel_edges(spark, folder), "keep_original")
    return merged.agg(F.count_if(F.col("parallel") > 1).alias("n_offending"), F.count("*").alias("n_pairs"))


@query
def edge_weights(spark, folder):
    return lattice.edges(spark, folder, "noisy").select("u", "v", r9("p"), r9("w"))


@query
def edge_normaliser(spark, folder):
    return edges.normaliser(lattice.edges(spark, folder, "noisy")).select(r9("largest"), "integral", F.round("norm", 3).alias("norm"))


@query
def edge_discretize(spark, folder):
    return edges.discretise(lattice.edges(spark, folder, "noisy")).select("u", "v", "w", F.col("sign").cast("long").alias("sign"), "obs_mask")


@query
def boundary_edge_min(spark, folder):
    rim = lattice.nodes(spark, folder).where("id % 7 = 3").select("id")
    out = edges.discretise(lattice.edges(spark, folder, "noisy"), rim)
    return out.select("u", "v", "w")


@query
def edge_lookup(spark, folder):
    wanted = table(spark, folder, "lineitem").where("l_linenumber = 1").select(
        (F.col("l_partkey") + 1).alias("u"), F.when(F.col("l_quantity") > 10, F.col("l_partkey")).alias("v")
    ).distinct()
    return edges.lookup(lattice.edges(spark, folder, "noisy"), wanted).select("u", "v", r9("w"))


@query
def edge_exists(spark, folder):
    wanted = table(spark, folder, "lineitem").select(F.col("l_partkey").alias("u"), (F.col("l_partkey") + F.col("l_linenumber")).alias("v")).distinct()
    return edges.existing(lattice.edges(spark, folder), wanted)


@query
def edge_graph_size(spark, folder):
    return edges.graph_size(lattice.parallel_edges(spark, folder))


@query
def max_weight_plus_one(spark, folder):
    return edges.heaviest_plus_one(edges.discretise(lattice.edges(spark, folder, "noisy")))


@query
def negative_weight_sync(spark, folder):
    return edges.negative_totals(edges.discretise(lattice.signed_edges(spark, folder)))


@query
def negative_toggles(spark, folder):
    return edges.negative_toggles(edges.discretise(lattice.signed_edges(spark, folder)))


@query
def negative_observables(spark, folder):
    """Every edge flips an observable numbered by its first node."""
    signed = lattice.signed_edges(spark, folder).withColumn("obs", F.array((F.col("u") % 5000).cast("int")))
    return edges.toggled_observables(signed).select(F.col("obs").cast("long").alias("obs"))


def _split_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Model lines of one error per order: its lines with a discount are the pieces."""
    piece = F.concat(
        F.lit("D"), F.col("l_suppkey").cast("string"), F.lit(" D"), (F.col("l_suppkey") + 1 + F.col("l_partkey") % 5).cast("string"),
        F.when(F.col("l_linenumber") == 1, F.lit(" L0")).otherwise(F.lit("")),
    )
    lines = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(
        F.min("l_discount").alias("p"), F.array_join(F.array_sort(F.collect_list(piece)), " ^ ").alias("body")
    )
    return lines.select(
        F.col("l_orderkey").alias("error"),
        F.concat(F.lit("error("), F.format_string("%.17g", F.col("p") / 3), F.lit(") "), F.col("body")).alias("value"),
    )


@query
def model_pieces(spark, folder):
    return errormodel.pieces(_split_errors(spark, folder), correlated=True).select(
        "error", F.col("piece").cast("long").alias("piece"), "u", "v", r9("p"), F.array_join(F.col("obs").cast("array<string>"), ";").alias("obs")
    )


@query
def model_edges(spark, folder):
    lines = errormodel.model_lines(lattice.edges(spark, folder, "noisy"))
    return errormodel.pieces(lines).select("u", "v", r9("p"), F.array_join(F.col("obs").cast("array<string>"), ";").alias("obs"))


@query
def model_graph(spark, folder):
    merged, _ = errormodel.graph_edges(_split_errors(spark, folder), correlated=True)
    obs = F.array_join(F.col("obs").cast("array<string>"), ";").alias("obs")
    return merged.select("u", "v", r9("w"), r9("p"), obs, "parallel")


def _joint(spark: SparkSession, folder: str) -> DataFrame:
    return edges.joint_probabilities(errormodel.pieces(_split_errors(spark, folder), correlated=True))


@query
def joint_probability(spark, folder):
    return _joint(spark, folder).select("u", "v", "other_u", "other_v", r9("joint"))


@query
def implied_weight(spark, folder):
    return edges.implied_weights(_joint(spark, folder)).select("u", "v", "other_u", "other_v", r9("w"))


# Scalars -------------------------------------------------------------------


@query
def weight_functions(spark, folder):
    items = table(spark, folder, "lineitem").select(F.col("l_discount").alias("p"), F.col("l_tax").alias("q")).distinct()
    p, q = F.col("p"), F.col("q")
    return items.where("p > 0 AND q > 0").select(
        "p", "q",
        F.round(weights.log_odds(p), 9).alias("w"),
        F.round(weights.xor_probability(p, q), 9).alias("x"),
        F.round(weights.merge_log_odds(weights.log_odds(p), -weights.log_odds(q)), 9).alias("merged"),
        weights.is_probability(p).cast("long").alias("valid"),
    )


@query
def obs_mask_pack(spark, folder):
    bits = table(spark, folder, "lineitem").groupBy("l_orderkey").agg(F.collect_list((F.col("l_linenumber") - 1).cast("int")).alias("bits"))
    return bits.select(F.col("l_orderkey").alias("shot"), masks.mask_from_indices(F.col("bits")).alias("obs_mask"))


@query
def obs_mask_unpack(spark, folder):
    packed = obs_mask_pack(spark, folder)
    bits = masks.bits_from_mask(F.col("obs_mask"), 7)
    return packed.select(
        "shot",
        F.array_join(bits.cast("array<string>"), "").alias("bits"),
        masks.mask_text(F.col("obs_mask")).alias("set_bits"),
        masks.mask_from_bits(bits).alias("again"),
    )


@query
def hits_joined_text(spark, folder):
    items = table(spark, folder, "lineitem").groupBy(F.col("l_orderkey").alias("shot")).agg(F.collect_list("l_partkey").alias("ids"))
    joined = items.select("shot", text.joined_ids(F.col("ids")).alias("ids"))
    return joined.withColumn("n_parts", F.size(text.split_nonempty(F.col("ids"), ";")).cast("long"))


@query
def name_functions(spark, folder):
    points = lattice.bench_points(spark, folder).groupBy("case", "distance", "noise").agg(F.count("*").alias("shots"))
    d = F.col("distance")
    return points.select(
        "case",
        text.case_distance(F.concat("case", F.lit("_"))).cast("long").alias("parsed"),
        text.case_label(d, d, F.col("noise") / 1000.0).alias("label"),
        text.render_case_name(F.lit("case_r{rounds}_d{distance}_p{p4}_s{shots}_seed{seed}"), d, d, F.col("noise") + 20, F.col("shots"), F.col("noise") / 1000.0).alias("file"),
        text.probability_text(F.col("noise") / 1000.0).alias("p4"),
    )


@query
def number_functions(spark, folder):
    items = table(spark, folder, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("n"), F.col("l_quantity").cast("long").alias("q"),
        F.col("l_extendedprice").alias("x"), F.col("l_discount").alias("r"),
    ).distinct()
    n, q, x = F.col("n"), F.col("q"), F.col("x")
    texts = F.when(n > 4, F.lit("")).otherwise(n.cast("string")), F.when(n > 2, q.cast("string")).otherwise(F.lit(""))
    return items.select(
        "k", "n", "q", "x", "r",
        numeric.subtract_to_zero(n, q).alias("less"),
        numeric.scaled_ceiling(q, 1.5).alias("scaled"),
        numeric.ceil_to_distance(x * F.col("r")).alias("up"),
        numeric.floor_to_distance(x * F.col("r")).alias("down"),
        numeric.above_threshold(x / 7.0, 1).alias("above"),
        F.round(numeric.level_exponent(q), 6).alias("exponent"),
        numeric.add_saturating(q * F.lit(10**17), F.lit(2 * 10**18)).alias("total"),
        numeric.multiply_saturating(q, F.lit(10**17)).alias("product"),
        numeric.element_or_zero(F.array(n, q), n).alias("element"),
        text.number_or_zero(texts[0]).alias("number"),
        text.first_number(*texts).alias("first"),
        text.state_name(n - 1).alias("state"),
    )


# Hits and pairs ------------------------------------------------------------


@query
def shot_hits_normalized(spark, folder):
    rim = lattice.nodes(spark, folder).where("id % 50 = 7").select("id")
    return hit_ops.normalise(lattice.hits(spark, folder), lattice.nodes(spark, folder), rim)


@query
def shot_slice(spark, folder):
    return hit_ops.slice_shots(lattice.hits(spark, folder), 100, 500)


@query
def pair_candidates(spark, folder):
    """All hit pairs of a shot within 40; a shot's farther pairs are never listed."""
    pairs = pairs_within(lattice.hits(spark, folder), unit_graph(spark, folder), 40)
    return pairs.select("shot", "u", "v", "d", F.floor(F.col("d") / 2).cast("long").alias("time"))


# Paths ---------------------------------------------------------------------


@query
def pair_dist_bounded(spark, folder):
    graph = unit_graph(spark, folder)
    reach = paths.balls(graph, graph.nodes().select(F.col("id").alias("src"), F.lit(CHAIN).alias("radius")))
    return reach.where("src <= node").select(F.col("src").alias("u"), F.col("node").alias("v"), "d")


@query
def pair_dist_labels(spark, folder):
    """Every hit with the next one of its shot, on the graph as a table."""
    edge = edges.search_ready(edges.discretise(lattice.edges(spark, folder)))
    order = Window.partitionBy("shot").orderBy("det")
    pairs = lattice.hits(spark, folder).select(F.col("det").alias("u"), F.lead("det").over(order).alias("v")).where("v IS NOT NULL")
    pairs = pairs.distinct().withColumn("cap", F.lit(2**40))
    return paths.pair_distances(Graph(edge, broadcast_edges=0), cut(pairs), masks=False).select("u", "v", "d")


@query
def distance_unit(spark, folder):
    """Pairs of near hits, and every hit with the boundary."""
    graph = unit_graph(spark, folder)
    hits = cut(lattice.hits(spark, folder))
    rim = matching.rim_of(hits, graph).select(F.lit(None).cast("long").alias("v"), F.col("rim").alias("d"))
    return stats.distance_unit(pairs_within(hits, graph, CHAIN).select("v", "d").unionByName(rim))


@query
def boundary_dist(spark, folder):
    return paths.boundary_distances(unit_graph(spark, folder)).select("node", "d", "mask")


@query
def graph_components(spark, folder):
    """The whole lattice of parts beside the graph of customers and orders, an edge for each
    order; a customer without orders is a component of its own."""
    part = F.lit(2 * 10**9)
    grid = lattice.edges(spark, folder).select((part + F.col("u")).alias("u"), (part + F.col("v")).alias("v"))
    bought = table(spark, folder, "orders").select(F.col("o_custkey").alias("u"), (F.lit(10**9) + F.col("o_orderkey")).alias("v"))
    alone = table(spark, folder, "customer").select(F.col("c_custkey").alias("u"), F.lit(None).cast("long").alias("v"))
    edge = grid.unionByName(bought).unionByName(alone).select("u", "v", F.lit(2).cast("long").alias("w"), F.lit(0).cast("long").alias("obs_mask"))
    return landmarks.graph_components(Graph(edge))


@query
def component_span_bounds(spark, folder):
    return landmarks.component_spans(unit_graph(spark, folder))


@query
def shortest_path_weight_noisy(spark, folder):
    graph = noisy_graph(spark, folder)
    reach = paths.balls(graph, graph.nodes().select(F.col("id").alias("src"), F.lit(40_000_000).alias("radius")))
    return reach.where("src < node").select(F.col("src").alias("u"), F.col("node").alias("v"), "d")


@query
def path_edges(spark, folder):
    graph = unit_graph(spark, folder)
    pairs = pairs_within(lattice.hits(spark, folder), graph, CHAIN).select("u", "v", F.lit(CHAIN).alias("cap")).distinct()
    steps = paths.shortest_paths(graph, pairs)
    return steps.groupBy("u", "v").agg(
        F.count("*").alias("n_edges"), F.min_by("a", "pos").alias("first_node"), F.max_by("b", "pos").alias("last_node"),
        F.sum(F.abs(F.col("a") - F.col("b")).isin(1, lattice.WIDTH).cast("long")).alias("n_real"),
    )


@query
def radius_neighbors(spark, folder):
    levels = spark.createDataFrame([(1, 4), (2, 8), (3, 12)], "level long, b long")
    near = paths.radius_lists(unit_graph(spark, folder), levels)
    return near.groupBy("level", "u").agg(F.count("*").alias("n"), F.sum("v").alias("v_sum"), F.max("d").alias("farthest"))


# Clusters ------------------------------------------------------------------


def _chained(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    graph = unit_graph(spark, folder)
    return graph, cut(clusters.threshold_components(lattice.hits(spark, folder), graph, CHAIN))


@query
def threshold_components(spark, folder):
    return _chained(spark, folder)[1]


@query
def component_diameter(spark, folder):
    graph, rooted = _chained(spark, folder)
    return clusters.diameters(rooted, graph, 30)


def _level1(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame, DataFrame]:
    graph = unit_graph(spark, folder)
    hits = cut(lattice.hits(spark, folder))
    rooted = cut(clusters.threshold_components(hits, graph, LEVELS[0].b))
    rim = matching.rim_of(hits, graph)
    return graph, rooted, clusters.judge(rooted, rim, graph, LEVELS[0])


@query
def cluster_level1(spark, folder):
    verdicts = _level1(spark, folder)[2]
    # The diameter is only measured where the cheap tests pass.
    return verdicts.select("shot", "root", "size", F.when(F.col("accepted"), F.col("diameter")).alias("diameter"), "near_rim", "far_rim", "accepted")


@query
def cluster_residual(spark, folder):
    _, rooted, verdicts = _level1(spark, folder)
    taken = rooted.join(verdicts.where("accepted"), ["shot", "root"], "left_semi")
    return clusters.residual(rooted.select("shot", "det"), taken)


@query
def cluster_deferral(spark, folder):
    _, rooted, verdicts = _level1(spark, folder)
    members = rooted.join(verdicts.where("accepted"), ["shot", "root"])
    kept, deferred = hierarchy.defer_heavy(members, F.col("size") > 1)
    left = clusters.residual(rooted.select("shot", "det"), members).unionByName(deferred).distinct()
    return kept.select("shot", "det", F.lit("kept").alias("place")).unionByName(left.select("shot", "det", F.lit("next").alias("place")))


def _members(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame]:
    graph = unit_graph(spark, folder)
    return graph, cut(clusters.cluster_levels(cut(lattice.hits(spark, folder)), graph, LEVELS))


@query
def cluster_levels(spark, folder):
    return _members(spark, folder)[1].select("shot", F.col("level").cast("long").alias("level"), "root", "det", "size", "diameter", "forced")


# Bounds that leave most of the graph outside, so that every level chains in it.
NARROW = [Level(3, 10), Level(9, 24), Level(27, 72)]


@query
def cluster_levels_narrow(spark, folder):
    members = clusters.cluster_levels(cut(lattice.hits(spark, folder)), unit_graph(spark, folder), NARROW)
    return members.select("shot", F.col("level").cast("long").alias("level"), "root", "det", "size", "diameter", "forced")


@query
def owner_regions(spark, folder):
    """Nodes within 8 of a hit of the shot, by their nearest hit."""
    owners = regions.owned(lattice.hits(spark, folder), unit_graph(spark, folder), 8)
    return owners.groupBy("shot", F.col("owner").alias("det")).agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"), F.sum("d").alias("d_sum"))


@query
def cluster_forced_top(spark, folder):
    return clusters.forced_components(lattice.hits(spark, folder), unit_graph(spark, folder))


@query
def cluster_shape(spark, folder):
    members = _members(spark, folder)[1]
    heads = members.groupBy("shot", "level", "root").agg(F.count("*").alias("size"))
    widths = heads.groupBy("shot", "level").agg(F.count("*").alias("width"), F.sum("size").alias("covered"), F.max("size").alias("largest"))
    return widths.groupBy("shot").agg(
        F.sum("width").alias("clusters"), F.sum("covered").alias("covered"), F.max("largest").alias("largest"),
        F.max("level").cast("long").alias("max_level"), F.max("width").alias("peak_width"),
    )


@query
def ready_time(spark, folder):
    graph, rooted = _chained(spark, folder)
    return clusters.ready_times(rooted, pairs_within(rooted, graph, CHAIN))


@query
def first_external(spark, folder):
    graph, rooted = _chained(spark, folder)
    return clusters.first_external(rooted, regions.meetings_to_the_end(rooted, graph))


@query
def cluster_members_text(spark, folder):
    rows = sinks.member_rows(_members(spark, folder)[1])
    return rows.select("shot", F.col("level").cast("long").alias("level"), "root", "active_detectors", "members")


@query
def cluster_members_exploded(spark, folder):
    return sinks.assignment_rows(_members(spark, folder)[1]).select("shot", F.col("level").cast("long").alias("level"), "root", "active_detector")


def _regions(spark: SparkSession, folder: str, step: int = 2) -> tuple[Graph, DataFrame, DataFrame]:
    graph, members = _members(spark, folder)
    members = members.withColumn("bound", (F.col("level") + 1) * step)
    return graph, members, cut(hierarchy.influence(members, graph, ["shot", "level", "root"], "bound"))


@query
def influence_vertices(spark, folder):
    regions = _regions(spark, folder)[2]
    return regions.groupBy("shot", F.col("level").cast("long").alias("level"), "root").agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))


@query
def cluster_parent(spark, folder):
    found = hierarchy.parents(_regions(spark, folder, 6)[2])  # wide enough to reach over the level-1 buffer
    return found.select("shot", F.col("level").cast("long").alias("level"), "root", F.col("parent_level").cast("long").alias("parent_level"), "parent_root")


@query
def greedy_cover(spark, folder):
    _, members, regions = _regions(spark, folder)
    sizes = members.groupBy("shot", "level", "root").agg(F.count("*").alias("size"))
    owners = hierarchy.greedy_cover(regions, sizes).withColumnRenamed("node", "det")
    covered = members.select("shot", "det").join(owners, ["shot", "det"])
    return covered.select("shot", "det", F.col("level").cast("long").alias("level"), "root")


@query
def cluster_subgraph(spark, folder):
    graph, _, regions = _regions(spark, folder)
    inside = hierarchy.restrict(graph.edges, regions, ["shot", "level", "root"])
    return inside.groupBy("shot", F.col("level").cast("long").alias("level"), "root").agg(
        F.count("*").alias("n_edges"), F.count_if(F.col("v").isNull()).alias("n_rim"), F.sum("w").alias("weight")
    )


@query
def upper_targets(spark, folder):
    heads = _members(spark, folder)[1].select("shot", "level", "root").distinct()
    return hierarchy.upper_targets(heads).select("shot", F.col("level").cast("long").alias("level"), "root", "targets")


@query
def short_pairs_mutual(spark, folder):
    pairs = pairs_within(lattice.hits(spark, folder), unit_graph(spark, folder), 10)
    return clusters.mutual_nearest(pairs, 10)


@query
def short_pairs_accepted(spark, folder):
    """Short pairs among the hits that level 1 leaves, guarded against all hits of the shot."""
    hits = cut(lattice.hits(spark, folder))
    left = cut(cluster_residual(spark, folder))
    return clusters.accept_short_pairs(left, hits, unit_graph(spark, folder), 30, 40, 4, mutual=False)


@query
def parent_cover(spark, folder):
    """Regions of four levels of clusters, widened to hold all that lie below them."""
    graph = unit_graph(spark, folder)
    members = cut(clusters.cluster_levels(cut(lattice.hits(spark, folder)), graph, NARROW))
    reach = members.select("shot", "level", "root", "det", (F.col("level") * 8).alias("bound"))
    own = cut(hierarchy.influence(reach, graph, ["shot", "level", "root"], "bound"))
    wide, whole = hierarchy.cover_descendants(own, cut(hierarchy.parents(own)), graph.nodes().count())
    sums = wide.groupBy("shot", "level", "root").agg(F.count("*").alias("n"), F.sum("node").alias("node_sum"))
    out = sums.unionByName(whole.select("*", F.lit(None).cast("long").alias("n"), F.lit(None).cast("long").alias("node_sum")))
    return out.withColumn("level", F.col("level").cast("long"))


@query
def bounds_schedule(spark, folder):
    first = edges.heaviest_plus_one(edges.discretise(lattice.edges(spark, folder))).first()["first_diameter"]
    levels = schedules.bounds_table(spark, schedules.parameter_schedule(int(first)))
    return levels.select(F.col("level").cast("long").alias("level"), "d", "b", r9("phi"), "phi_needs", "clamped")


# Matching ------------------------------------------------------------------


def _groups(spark: SparkSession, folder: str, **options) -> tuple[Graph, DataFrame]:
    graph = unit_graph(spark, folder)
    return graph, matching.pair_groups(lattice.hits(spark, folder), graph, **options)


@query
def match_weight(spark, folder):
    return matching.per_shot(_groups(spark, folder)[1]).select("shot", "n_hits", "weight", "status")


@query
def match_pairs_check(spark, folder):
    pairs = matching.matches(_groups(spark, folder)[1])
    return pairs.groupBy("shot").agg(
        F.sum(F.when(F.col("v").isNull(), 1).otherwise(2)).alias("n_hits"), F.sum("d").alias("weight")
    )


@query
def match_weight_noisy(spark, folder):
    graph = noisy_graph(spark, folder)
    return matching.per_shot(matching.pair_groups(lattice.hits(spark, folder), graph)).select("shot", "n_hits", "weight", "status")


@query
def match_path_stats(spark, folder):
    pairs = matching.matches(_groups(spark, folder)[1])
    kinds = pairs.select(F.explode(F.when(F.col("v").isNull(), F.array(F.lit("all"))).otherwise(F.array(F.lit("all"), F.lit("pair")))).alias("kind"), "d")
    kinds = cut(kinds)
    basic = kinds.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.avg("d"), 6).alias("mean"), F.min("d").alias("min"), F.max("d").alias("max"))
    return basic.join(stats.quantiles(kinds, ["kind"], "d", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, lower=True), "kind")


@query
def global_event_counts(spark, folder):
    return matching.per_shot(_groups(spark, folder)[1]).select("shot", "event_count", "stop_time", "obs_mask")


def _isolated(spark: SparkSession, folder: str) -> tuple[Graph, DataFrame, DataFrame]:
    """Every cluster paired up on its own: keys of clusters stand in for shots."""
    graph, members = _members(spark, folder)
    heads, alone = matching.pair_clusters(members, graph)
    return graph, heads, alone


@query
def cluster_weights(spark, folder):
    """The clusters of the narrow levels, each decoded alone."""
    decoder = Decoder(lattice.edges(spark, folder))
    hits = cut(lattice.hits(spark, folder))
    members = cut(decoder.clusters(hits.select("shot").distinct(), hits, NARROW))
    found = decoder.decode_clusters(members)
    return found.select("shot", F.col("level").cast("long").alias("level"), "root", "size", "weight", "status")


@query
def isolated_vs_global(spark, folder):
    graph, heads, alone = _isolated(spark, folder)
    apart = matching.per_shot(alone).select(F.col("shot").alias("key"), "weight").join(heads, "key").groupBy("shot").agg(F.sum("weight").alias("isolated"))
    whole = matching.per_shot(matching.pair_groups(lattice.hits(spark, folder), graph)).select("shot", F.col("weight").alias("whole"))
    return apart.join(whole, "shot").where("isolated <> whole")


@query
def decode_mistakes(spark, folder):
    """Groups grown level by level against the split of whole shots; they must agree on every shot."""
    graph = unit_graph(spark, folder)
    hits = cut(lattice.hits(spark, folder))
    grown = matching.per_shot(matching.pair_groups(hits, graph, limit=0, first_horizon=16)).select("shot", F.col("weight").alias("grown"), F.col("status").alias("grown_status"))
    whole = matching.per_shot(matching.pair_groups(hits, graph)).select("shot", "weight")
    both = whole.join(grown, "shot", "left")
    return both.agg(
        F.count("*").alias("shots"),
        F.count_if(~F.col("weight").eqNullSafe(F.col("grown"))).alias("mistakes"),
        F.count_if(F.coalesce("grown_status", F.lit("missing")) != "ok").alias("exceptions"),
    )


@query
def root_totals(spark, folder):
    _, heads, alone = _isolated(spark, folder)
    results = matching.per_shot(alone).withColumnRenamed("shot", "key").join(heads, "key").select("shot", "root", "level", "weight", "obs_mask")
    superseded = results.where("level = 2").select("shot", "root")
    return hierarchy.root_totals(results, superseded).select("shot", "weight")


# Accounting ----------------------------------------------------------------


def _costs(spark: SparkSession, folder: str) -> DataFrame:
    return accounting.cluster_costs(lattice.event_log(spark, folder))


@query
def cluster_event_costs(spark, folder):
    out = accounting.cluster_paths(_costs(spark, folder))
    return out.select("shot", F.col("level").cast("long").alias("level"), "cluster", "n", "before", "after", "base", "critical")


@query
def critical_path(spark, folder):
    out = accounting.critical_levels(_costs(spark, folder))
    return out.select("shot", F.col("level").cast("long").alias("level"), "critical", "stop")


@query
def shot_costs(spark, folder):
    return accounting.shot_costs(_costs(spark, folder)).withColumn("max_level", F.col("max_level").cast("long"))


@query
def adaptive_level_cost(spark, folder):
    return accounting.level_after_prior(_costs(spark, folder))


@query
def slowest_cluster(spark, folder):
    out = accounting.slowest(_costs(spark, folder), F.col("n"))
    return out.select("shot", F.col("level").cast("long").alias("level"), "slowest", "time")


@query
def makespan_lpt(spark, folder):
    out = accounting.makespan(_costs(spark, folder), ["shot", "level"], "n", 3)
    return out.select("shot", F.col("level").cast("long").alias("level"), "makespan")


# Summaries -----------------------------------------------------------------


@query
def sem_by_case(spark, folder):
    items = table(spark, folder, "lineitem")
    x = F.col("l_quantity")
    sums = F.sum(x), F.sum(x * x), F.count(x)
    return items.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.avg(x), 9).alias("mean"), F.round(stats.standard_error(x), 9).alias("sem"),
        F.round(stats.standard_error_from_sums(*sums), 6).alias("sem_from_sums"),
    )


@query
def percentile_linear(spark, folder):
    out = stats.quantiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99})
    return out.select("l_returnflag", *[F.round(c, 6).alias(c) for c in ("p50", "p90", "p99")])


@query
def percentile_lower(spark, folder):
    return stats.quantiles(table(spark, folder, "lineitem"), ["l_returnflag"], "l_extendedprice", {"p50": 0.5, "p90": 0.9, "p99": 0.99}, lower=True)


def _cluster_table(spark: SparkSession, folder: str) -> DataFrame:
    """Cluster rows of the event log: case by user, two repetitions by event number."""
    case = F.when(F.col("shot") % 2 == 0, F.lit("r9_d9_p1")).otherwise(F.lit("r13_d13_p1"))
    log = lattice.event_log(spark, folder)
    return log.groupBy(case.alias("case"), (F.col("seq") % 2).alias("rep"), "shot", "level", "cluster").agg(
        F.count("*").alias("events"), F.count_distinct("t").alias("size"), (F.max("t") - F.min("t")).alias("diameter"), F.max("t").alias("buffer")
    )


@query
def level_stats(spark, folder):
    out = stats.level_statistics(_cluster_table(spark, folder))
    rounded = ["median_events_per_cluster", "p90_events_per_cluster", "mean_events_per_cluster", "mean_active_detectors_per_cluster",
               "mean_diameter_per_cluster", "mean_buffer_bound_per_cluster", "avg_clusters_per_shot"]
    kept = ["case", "shots", "nonempty_shots", "total_clusters", "max_clusters_in_shot", "total_events", "min_events_per_cluster", "max_events_per_cluster"]
    return out.select(*kept, F.col("level").cast("long").alias("level"), *[F.round(c, 6).alias(c) for c in rounded])


def _level_table(spark: SparkSession, folder: str) -> DataFrame:
    """One row per non-empty level."""
    return _cluster_table(spark, folder).groupBy("case", F.lit("event_log").alias("method"), "rep", "shot", "level").agg(
        F.count("*").alias("cluster_count"), F.sum("size").alias("assigned_active_detector_count"),
        F.max("size").alias("max_cluster_active_detectors"), F.max("events").alias("max_cluster_event_count"),
        F.max("events").alias("max_cluster_critical_path_event_count"),
    )


@query
def level_counts_zero_filled(spark, folder):
    out = stats.level_distribution(_level_table(spark, folder))
    whole = {"shots", "nonempty_shots", "case", "method"}
    return out.select(
        *[F.col(c).cast("long").alias(c) if c == "level" or c.startswith("max_") else F.col(c) if c in whole else F.round(c, 6).alias(c) for c in out.columns]
    )


@query
def level_count_histogram(spark, folder):
    out = stats.level_histogram(_level_table(spark, folder))
    return out.select("case", "method", F.col("level").cast("long").alias("level"), "cluster_count", "shots", r9("fraction"))


@query
def level_parameter_rows(spark, folder):
    costs = accounting.cluster_paths(_costs(spark, folder)).withColumn("size", F.col("before") + 1)
    rows = sinks.level_rows(costs)
    return rows.withColumn("level", F.col("level").cast("long"))


def _summary(spark: SparkSession, folder: str) -> DataFrame:
    points = lattice.bench_points(spark, folder)
    return points.groupBy("noise", "distance").agg(
        F.avg("y").alias("per_shot"), (F.sum("y") / F.sum(F.col("distance") * F.col("distance"))).alias("per_round")
    )


@query
def power_law_fit(spark, folder):
    fits = stats.fit_set(_summary(spark, folder), ["noise"], "distance", ["per_shot", "per_round"])
    return fits.select(
        F.col("noise").cast("long").alias("noise"), "metric", "fit_range",
        F.col("x_min").cast("long").alias("x_min"), F.col("x_max").cast("long").alias("x_max"),
        F.round("coefficient", 3).alias("coefficient"), F.round("exponent", 7).alias("exponent"), F.round("r2", 7).alias("r2"),
    )


@query
def speedup_pairing(spark, folder):
    out = stats.pair_runs(lattice.bench_points(spark, folder))
    return out.select("case", "global_y", "parallel_y", "parallel_mode", F.round("speedup", 6).alias("speedup"))


@query
def best_trial(spark, folder):
    log = lattice.event_log(spark, folder)
    trials = log.groupBy("shot", "cluster").agg(
        F.count("*").alias("clusters"), F.count_distinct("level").alias("active"), F.max("t").alias("residual")
    )
    best = stats.best_trial(trials, ["shot"], [F.col("clusters"), F.col("active"), -F.col("residual"), F.col("cluster")])
    return best.select("shot", "cluster", "clusters", "active", "residual")


@query
def spaced_sample(spark, folder):
    return stats.spaced_sample(lattice.event_log(spark, folder), ["shot"], "t", 8)


@query
def bench_rows(spark, folder):
    costs = accounting.shot_costs(_costs(spark, folder))
    case = F.when(F.col("shot") % 2 == 0, F.lit("r9_d9_p1")).otherwise(F.lit("r13_d13_p1"))
    shots = costs.select(
        case.alias("case"), F.col("events").alias("global_events"), F.col("events").alias("cluster_events"), F.col("critical").alias("critical_events"),
        "stop", "nonempty_levels", F.col("clusters").alias("imports"), "clusters", "max_level", "peak_width", F.col("peak_width").alias("max_cluster_size"),
        F.lit(0).cast("long").alias("mistake"), F.lit(0).cast("long").alias("failed"),
    )
    return sinks.bench_rows(shots, "parallel_fixed")


# Sampling and files --------------------------------------------------------


@query
def error_sampling(spark, folder):
    """A shot for each customer."""
    shots = table(spark, folder, "customer").count()
    fired = cut(sampling.fired_edges(lattice.edges(spark, folder, "noisy"), shots, 20260101))
    hits = sampling.syndromes(fired)
    flips = sampling.flipped_observables(fired)
    counted = hits.groupBy("shot").agg(F.count("*").alias("n_hits"), F.sum("det").alias("det_sum"))
    return counted.join(flips, "shot", "left").select("shot", "n_hits", "det_sum", F.coalesce("obs_mask", F.lit(0)).alias("obs_mask"))


@query
def case_decode(spark, folder):
    """The unit lattice and its shots written as a case file, read back and decoded."""
    shots = lattice.hits(spark, folder).groupBy("shot").agg(F.array_sort(F.collect_list("det")).alias("hits"))
    path = f"{shared_folder(spark)}/case-{uuid.uuid4().hex}"
    shots = cut(shots.withColumn("obs_mask", F.lit(0).cast("long")))
    lines = casefile.case_lines(cut(lattice.edges(spark, folder)), shots, 9, 9, 0.001)
    casefile.write_case(lines, path)
    return decode_case(casefile.read_cases(spark, path)).select("shot", "n_hits", "weight", "status")


def _two_cases(spark: SparkSession, folder: str):
    """Shots dealt over two case files: the unit lattice, and one of weight 3 with a flag on
    every boundary edge, so that the flag of a shot is the parity of its hits."""
    base = f"{shared_folder(spark)}/cases-{uuid.uuid4().hex}"
    shots = lattice.hits(spark, folder).groupBy("shot").agg(F.array_sort(F.collect_list("det")).alias("hits")).withColumn("obs_mask", F.col("shot") % 3 % 2)
    flag = F.when(F.col("v").isNull(), F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    edge = lattice.edges(spark, folder).withColumn("obs", flag)
    for k, name in enumerate(("unit", "threefold")):
        own = shots.where(F.col("shot") % 2 == k)
        casefile.write_case(casefile.case_lines(edge.withColumn("w", F.lit(1.0 + 2 * k)), own, 9, 9, 0.001), f"{base}/{name}")
    return cases.run_cases(casefile.read_cases(spark, f"{base}/*"))


def _case_name():
    return F.regexp_extract("case", "[^/]+$", 0).alias("case")


@query
def case_run(spark, folder):
    return _two_cases(spark, folder).results.select(_case_name(), "shot", "n_hits", "weight", "obs_mask", "status", "true_mask")


@query
def case_mistakes(spark, folder):
    return _two_cases(spark, folder).mistakes.withColumn("case", _case_name())


@query
def case_totals(spark, folder):
    return _two_cases(spark, folder).totals.select(_case_name(), "shots", "mistakes", "exceptions", F.round("mean_weight", 6).alias("mean_weight"))


@query
def observables_many(spark, folder):
    """200 observables, one for each class of nodes: an edge flips those of its two ends, so
    whatever the paths, a shot flips the observables with an odd number of its hits."""
    end = [F.pmod(x, F.lit(200)).cast("int") for x in ("u", "v")]
    flags = F.when(F.col("v").isNull(), F.array(end[0])).when(end[0] == end[1], F.array().cast("array<int>")).otherwise(F.array(*end))
    decoder = Decoder(lattice.edges(spark, folder).withColumn("obs", flags), options=Options(masks=False))
    hits = cut(lattice.hits(spark, folder))
    found = decoder.decode_observables(hits.select("shot").distinct(), hits)
    return found.select("shot", "weight", F.array_join(F.col("obs").cast("array<string>"), ";").alias("obs"), F.size("words").cast("long").alias("n_words"))


@query
def case_roundtrip(spark, folder):
    shots = lattice.hits(spark, folder).groupBy("shot").agg(F.array_sort(F.collect_list("det")).alias("hits"))
    shots = shots.select("shot", (F.col("shot") % 4).alias("obs_mask"), "hits")
    path = f"{shared_folder(spark)}/case-{uuid.uuid4().hex}"
    # Written first: the header counts them, and parting the lines by ranges reads them twice.
    lines = casefile.case_lines(cut(lattice.edges(spark, folder, "noisy")), cut(shots), 9, 9, 0.001)
    casefile.write_case(lines, path)
    case = casefile.read_cases(spark, path)
    facts = {
        "edges": (case.edges, F.count("*")),
        "inner_edges": (case.edges, F.count("v")),
        "u_sum": (case.edges, F.sum("u")),
        "p_sum_1e6": (case.edges, F.round(F.sum("p") * 1e6)),
        "observables": (case.edges, F.sum(F.size("obs"))),
        "shots": (case.shots, F.count("*")),
        "mask_sum": (case.shots, F.sum("obs_mask")),
        "hits": (case.shots, F.sum(F.size("hits"))),
        "det_sum": (case.hits, F.sum("det")),
        "header_detectors": (case.header, F.sum("num_detectors")),
        "header_edges": (case.header, F.sum("num_edges")),
        "header_shots": (case.header, F.sum("num_shots")),
    }
    # The facts of one table are taken in one pass over the text.
    parts = []
    for df in (case.edges, case.shots, case.hits, case.header):
        own = {name: value for name, (of, value) in facts.items() if of is df}
        wide = df.agg(*[value.cast("long").alias(name) for name, value in own.items()])
        pairs = F.array(*[F.struct(F.lit(name).alias("fact"), F.col(name).alias("value")) for name in own])
        parts.append(wide.select(F.explode(pairs).alias("x")).select("x.*"))
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


# Bounds chosen from the data, correlated and signed decoding -----------------


@query
def adaptive_diameter_candidates(spark, folder):
    graph = unit_graph(spark, folder)
    hits = cut(lattice.hits(spark, folder))
    return adaptive.diameter_candidates(pairs_within(hits, graph, 9), matching.rim_of(hits, graph), 3)


@query
def adaptive_buffer_candidates(spark, folder):
    graph = unit_graph(spark, folder)
    hits = cut(lattice.hits(spark, folder))
    widest = landmarks.component_spans(graph).agg(F.max("span")).first()[0]
    return adaptive.buffer_candidates(pairs_within(hits, graph, widest, masks=False), matching.rim_of(hits, graph), 1.0, 10)


@query
def adaptive_breakpoints(spark, folder):
    """Bounds of level 2 for the hits that level 1 leaves."""
    graph = unit_graph(spark, folder)
    left = cut(cluster_residual(spark, folder))
    return adaptive.breakpoint_bounds(left, matching.rim_of(left, graph), graph, LEVELS[0])


@query
def adaptive_level1(spark, folder):
    """Per shot the best of the certified bounds for diameters 3, 5 and 7."""
    graph = unit_graph(spark, folder)
    hits = cut(lattice.hits(spark, folder))
    d = F.explode(F.array(*[F.lit(x).cast("long") for x in (3, 5, 7)]))
    trials = hits.select("shot").distinct().select("shot", d.alias("d")).withColumn("b", adaptive.buffer_for(F.col("d"), 1.0))
    return adaptive.choose(adaptive.try_bounds(hits, matching.rim_of(hits, graph), graph, cut(trials), 17))


@query
def observables_from_paths(spark, folder):
    """Per shot, whether the flags along the matched paths give the mask carried through the search."""
    graph, groups = _groups(spark, folder)
    groups = cut(groups)
    flags = correlated.observables_on_paths(matching.matches(groups), graph, lattice.edges(spark, folder).select("u", "v", "obs"))
    walked = flags.groupBy("shot").agg(F.bit_xor(F.expr("shiftleft(1L, obs)")).alias("walked"))
    carried = matching.per_shot(groups).select("shot", "obs_mask").join(walked, "shot", "left")
    return carried.select("shot", (F.col("obs_mask") == F.coalesce("walked", F.lit(0))).alias("agree"))


@query
def match_weight_signed(spark, folder):
    """Every thousandth node has a negative edge to its right."""
    few = F.col("ord") % 4000 == 28
    decoder = Decoder(lattice.edges(spark, folder, "noisy").withColumn("w", F.when(few, -F.col("w")).otherwise(F.col("w"))))
    hits = cut(lattice.hits(spark, folder))
    return decoder.decode(hits.select("shot").distinct(), hits).select("shot", "weight", "status")


@query
def match_weight_correlated(spark, folder):
    """Errors that fire the edge to the right and the edge below a node together."""
    base = lattice.edges(spark, folder, "noisy").where("v IS NOT NULL")
    pieces = base.select(F.col("u").alias("error"), F.col("v").alias("piece"), "u", "v", (F.col("p") / 4).alias("p"))
    norm = edges.normaliser(lattice.edges(spark, folder, "noisy")).first()["norm"]
    implied = edges.implied_to_integer(edges.implied_weights(edges.joint_probabilities(pieces)), F.lit(norm))
    out = correlated.correlated_groups(lattice.hits(spark, folder), noisy_graph(spark, folder), cut(implied))
    return matching.per_shot(out).select("shot", "n_hits", "weight", "status")
