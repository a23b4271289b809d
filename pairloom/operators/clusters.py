"""Clusters of hits, level by level.

On each level the hits not yet taken are joined into threshold components
(distance at most the level's buffer bound b). A component is accepted when its
diameter is at most d and, if it has an odd number of hits, when its farthest
boundary distance is at most d too. The rest goes on to the next level; the top
level accepts everything.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators import overlay
from pairloom.operators.blocks import spans_few_hops
from pairloom.operators.components import components
from pairloom.operators.landmarks import component_spans, graph_components
from pairloom.operators.matching import rim_of
from pairloom.operators.pairs import by_size, pairs_within
from pairloom.operators.paths import Graph, pair_distances
from pairloom.operators.regions import meetings, owned
from pairloom.operators.whole_shots import levels_of_shots
from pairloom.session import cut


# One node in so many is a post of far links.
POSTS = 256


@dataclass(frozen=True)
class Level:
    """Diameter bound d and buffer bound b of a level."""

    d: int
    b: int


def threshold_components(hits: DataFrame, graph: Graph, b: int, shortcut: bool = False) -> DataFrame:
    """shot, det, root: hits of a shot chained by steps of at most ``b``,
    which the touching regions of a common growth show as well as all pairs would.

    With ``shortcut`` a graph component that b covers as a whole makes its hits
    one group without looking at any pair; only the others search for pairs.
    """
    hits = hits.select("shot", "det")
    if not shortcut:
        return _chained(hits, graph, b)
    spans = component_spans(graph)
    tagged = hits.join(graph_components(graph).withColumnRenamed("id", "det"), "det")
    narrow = spans.where(F.col("span") > b).select("comp")
    covered = tagged.join(spans.where(F.col("span") <= b).select("comp"), "comp", "left_semi")
    roots = covered.groupBy("shot", "comp").agg(F.min("det").alias("root"))
    covered = covered.join(roots, ["shot", "comp"]).select("shot", "det", "root")
    if narrow.isEmpty():
        return covered
    return _chained(tagged.join(narrow, "comp", "left_semi").select("shot", "det"), graph, b).unionByName(covered)


def _chained(hits: DataFrame, graph: Graph, b: int) -> DataFrame:
    # Regions grow shot by shot; a graph that is no array in the task is searched by node instead.
    if graph.flat is None:
        pairs = pairs_within(hits, graph, b, masks=False)
    elif spans_few_hops(graph, b):
        pairs = meetings(hits, graph, b)
    else:
        small, large = by_size(hits)
        linked = (lambda: pairs_within(small, graph, b, masks=False)) if overlay.reachable(graph) else (lambda: _far_links(small, graph, b))
        pairs = meetings(large, graph, b) if small is None else linked()
        if small is not None and large is not None:
            pairs = pairs.unionByName(meetings(large, graph, b).select("shot", "u", "v"))
    found = components(pairs.select("shot", F.col("u").alias("a"), F.col("v").alias("b")), ["shot"])
    return hits.join(found.withColumnRenamed("node", "det"), ["shot", "det"], "left").select(
        "shot", "det", F.coalesce("root", "det").alias("root")
    )


def _far_links(hits: DataFrame, graph: Graph, b: int) -> DataFrame:
    """shot, u, v: links that chain the hits of ordinary shots as all steps of at most ``b``
    would, where b spans so many hops that searching around every hit is too much.

    One node in ``POSTS`` is a post. A pair is linked when the way over the posts nearest
    to both is at most b, which is proof; only pairs that this leaves in different groups
    are measured.
    """
    posts = cut(graph.nodes().where(F.pmod(F.xxhash64("id"), F.lit(POSTS)) == 0))
    near = owned(posts.select(F.lit(0).cast("long").alias("shot"), F.col("id").alias("det")), graph, b // 2)
    near = graph.once(f"posts {b}", lambda: near.select(F.col("node").alias("det"), F.col("owner").alias("post"), F.col("d").alias("off")))
    p, q = posts.select(F.col("id").alias("u")), posts.select(F.col("id").alias("v"))
    # Both ways round, and a post with itself, so that any two hits find theirs.
    apart = pair_distances(graph, p.join(q, F.col("u") <= F.col("v")).select("u", "v", F.lit(b).alias("cap"))).select("u", "v", "d")
    apart = cut(apart.unionByName(apart.where("u <> v").select(F.col("v").alias("u"), F.col("u").alias("v"), "d")))
    placed = cut(hits.join(near, "det", "left").select("shot", "det", "post", "off"))
    x = placed.select("shot", F.col("det").alias("u"), F.col("post").alias("pu"), F.col("off").alias("ou"))
    y = placed.select("shot", F.col("det").alias("v"), F.col("post").alias("pv"), F.col("off").alias("ov"))
    over = apart.select(F.col("u").alias("pu"), F.col("v").alias("pv"), "d")
    sure = cut(x.join(y, "shot").where("u < v").join(over, ["pu", "pv"]).where(F.expr("ou + d + ov") <= b).select("shot", "u", "v"))
    found = components(sure.select("shot", F.col("u").alias("a"), F.col("v").alias("b")), ["shot"]).withColumnRenamed("node", "det")
    parts = cut(hits.join(found, ["shot", "det"], "left").select("shot", "det", F.coalesce("root", "det").alias("part")))
    split = cut(parts.groupBy("shot").agg(F.count_distinct("part").alias("parts")).where("parts > 1").select("shot"))
    if split.isEmpty():
        return sure
    left = cut(parts.join(split, "shot", "left_semi"))
    x = left.select("shot", F.col("det").alias("u"), F.col("part").alias("pu"))
    y = left.select("shot", F.col("det").alias("v"), F.col("part").alias("pv"))
    asked = cut(x.join(y, "shot").where("u < v AND pu <> pv").select("shot", "u", "v", F.lit(b).alias("cap")))
    measured = pair_distances(graph, asked.select("u", "v", "cap"))
    return sure.unionByName(asked.join(measured, ["u", "v"]).select("shot", "u", "v"))


def diameters(rooted: DataFrame, graph: Graph, cap: int | Column, keys: list[str] | None = None) -> DataFrame:
    """shot, root, size, diameter: largest distance inside each group, NULL when above ``cap``
    (a number, or a column of ``rooted`` that is one number for each group). Groups are
    told apart by ``keys``, shot and root where none are given.

    A group is first measured from its smallest hit only, one row per hit. A
    group that passes lies inside one ball of radius ``cap``, and only then are
    its inner pairs looked at, so their number per hit is limited by the ball.
    """
    keys = keys or ["shot", "root"]
    rooted = rooted.select(*keys, "det", (F.lit(cap) if isinstance(cap, int) else cap).cast("long").alias("cap"))
    sizes = cut(rooted.groupBy(*keys).agg(F.count("*").alias("size"), F.min("det").alias("anchor"), F.max("cap").alias("cap")))
    members = rooted.drop("cap").join(sizes, keys)
    spokes = members.where("det <> anchor").select(*keys, F.col("anchor").alias("u"), F.col("det").alias("v"), "cap")
    reach = spokes.join(pair_distances(graph, spokes.select("u", "v", "cap")), ["u", "v"]).where("d <= cap")
    reach = reach.groupBy(*keys).agg(F.count("*").alias("reached"), F.max("d").alias("spoke"))
    local = sizes.join(reach, keys, "left").where("size = 1 OR reached = size - 1")
    local = cut(local.select(*keys, "size", "spoke"))
    inside = members.drop("size").join(local.where("size > 2"), keys).where("det <> anchor")
    a = inside.select(*keys, F.col("det").alias("u"), "cap")
    b = inside.select(*keys, F.col("det").alias("v"))
    pairs = a.join(b, keys).where("u < v").select(*keys, "u", "v", "cap")
    measured = pairs.join(pair_distances(graph, pairs.select("u", "v", "cap")), ["u", "v"], "left").groupBy(*keys).agg(
        F.max("d").alias("inner"), F.bool_or(F.col("d").isNull() | (F.col("d") > F.col("cap"))).alias("over")
    )
    known = local.join(measured, keys, "left").where("NOT coalesce(over, false)").select(
        *keys, F.greatest(F.coalesce("spoke", F.lit(0)), F.coalesce("inner", F.lit(0))).alias("diameter")
    )
    return sizes.select(*keys, "size").join(known, keys, "left")


def judge(
    rooted: DataFrame, rim: DataFrame, graph: Graph, level: Level, size_cap: int = 0, forced: bool = False
) -> DataFrame:
    """shot, root, size, diameter, near_rim, far_rim, accepted for every component of a level.

    Components that fail the cheap tests (size cap, odd and too far from the
    boundary) are never measured.
    """
    rims = rooted.join(rim, ["shot", "det"]).groupBy("shot", "root").agg(
        F.count("*").alias("size"), F.min("rim").alias("near_rim"), F.max("rim").alias("far_rim")
    )
    if forced:
        return rims.select("shot", "root", "size", F.lit(None).cast("long").alias("diameter"), "near_rim", "far_rim", F.lit(True).alias("accepted"))
    rims = cut(rims)
    fits = (F.col("size") % 2 == 0) | (F.col("far_rim") <= level.d)
    if size_cap:
        fits = fits & (F.col("size") <= size_cap)
    candidates = cut(rooted.join(rims.where(fits).select("shot", "root"), ["shot", "root"], "left_semi"))
    measured = diameters(candidates, graph, level.d).select("shot", "root", "diameter", F.lit(True).alias("fits"))
    return rims.join(measured, ["shot", "root"], "left").select(
        "shot", "root", "size", "diameter", "near_rim", "far_rim",
        (F.coalesce("fits", F.lit(False)) & F.col("diameter").isNotNull()).alias("accepted"),
    )


def residual(hits: DataFrame, accepted_members: DataFrame) -> DataFrame:
    return hits.join(accepted_members.select("shot", "det"), ["shot", "det"], "left_anti")


def cluster_levels(
    hits: DataFrame,
    graph: Graph,
    levels: list[Level],
    forced_top: bool = False,
    size_caps: list[int] | None = None,
    residual_root: bool = True,
    shots: DataFrame | None = None,
) -> DataFrame:
    """shot, level, root, det, size, diameter, forced: every hit in exactly one cluster.

    ``forced_top`` accepts every component on the last level. Otherwise hits left
    over become one root cluster per shot, one level above the highest level the
    shot has used. Shots of ``shots`` without hits get one empty cluster on level 0.

    The pairs of a shot of ordinary size are measured once, and all its levels are one
    row of work; larger shots go level by level over all tasks.
    """
    rim = cut(rim_of(hits.select("shot", "det").distinct(), graph).where("shot IS NOT NULL"))
    widest = max([max(level.d, level.b) for level in levels], default=0)
    parts: list[DataFrame] = []
    small, large = by_size(rim) if levels and (spans_few_hops(graph, widest) or overlay.reachable(graph)) else (None, rim)
    if small is not None:
        pairs = pairs_within(small.select("shot", "det"), graph, widest, masks=False)
        parts.append(levels_of_shots(small.select("shot", "det", "rim"), pairs, [(x.d, x.b) for x in levels], size_caps, forced_top, residual_root))
    if large is not None:
        parts.append(_level_by_level(cut(large), graph, levels, forced_top, size_caps, residual_root))
    parts = [x for x in parts if x is not None]
    if shots is not None:
        parts.append(
            shots.select("shot").distinct().join(rim.select("shot").distinct(), "shot", "left_anti").select(
                "shot", F.lit(0).alias("level"), F.lit(None).cast("long").alias("root"), F.lit(None).cast("long").alias("det"),
                F.lit(0).cast("long").alias("size"), F.lit(0).cast("long").alias("diameter"), F.lit(False).alias("forced"),
            )
        )
    taken = parts[0] if parts else None
    for more in parts[1:]:
        taken = taken.unionByName(more)
    return taken


def _level_by_level(
    rim: DataFrame, graph: Graph, levels: list[Level], forced_top: bool, size_caps: list[int] | None, residual_root: bool
) -> DataFrame | None:
    left = rim.select("shot", "det")
    taken: DataFrame | None = None
    for number, level in enumerate(levels, start=1):
        rooted = cut(threshold_components(left, graph, level.b, shortcut=True))
        top = forced_top and number == len(levels)
        cap = size_caps[number - 1] if size_caps else 0
        verdicts = judge(rooted, rim, graph, level, cap, top).where("accepted")
        members = rooted.join(verdicts, ["shot", "root"]).select(
            "shot", F.lit(number).alias("level"), "root", "det", "size", "diameter", F.lit(top).alias("forced")
        )
        members = cut(members)
        taken = members if taken is None else taken.unionByName(members)
        left = cut(residual(left, members))
        if left.isEmpty():
            break
    if residual_root and not left.isEmpty():
        used = F.lit(0) if taken is None else None
        sizes = left.groupBy("shot").agg(F.min("det").alias("root"), F.count("*").alias("size"))
        if taken is not None:
            highest = taken.groupBy("shot").agg(F.max("level").alias("highest"))
            sizes = sizes.join(highest, "shot", "left")
            used = F.coalesce("highest", F.lit(0))
        roots = left.join(sizes, "shot").select(
            "shot", (used + 1).alias("level"), "root", "det", "size", F.lit(None).cast("long").alias("diameter"), F.lit(True).alias("forced")
        )
        taken = roots if taken is None else taken.unionByName(roots)
    return taken


def forced_components(hits: DataFrame, graph: Graph, certified: bool = True) -> DataFrame:
    """shot, root, det on a forced top level: by graph component, or one cluster when not certified."""
    if not certified:
        roots = hits.groupBy("shot").agg(F.min("det").alias("root"))
        return hits.join(roots, "shot").select("shot", "root", "det")
    tagged = hits.join(graph_components(graph).withColumnRenamed("id", "det"), "det")
    roots = tagged.groupBy("shot", "comp").agg(F.min("det").alias("root"))
    return tagged.join(roots, ["shot", "comp"]).select("shot", "root", "det")


def ready_times(rooted: DataFrame, pairs: DataFrame) -> DataFrame:
    """shot, root, ready: when a component is first joined, half its largest needed step.

    The needed steps are those of a minimum spanning tree. A hit joins by its
    shortest step, and contraction repeats this on whole parts, so each round
    only keeps the lightest step per part.
    """
    state = cut(rooted.select("shot", "root", "det", F.col("det").alias("part")))
    steps = cut(pairs.select("shot", "u", "v", "d"))
    picked = steps.where("false").select("shot", F.col("u").alias("det"), "d")
    while not steps.isEmpty():
        part_u = state.select("shot", F.col("det").alias("u"), F.col("part").alias("pu"))
        part_v = state.select("shot", F.col("det").alias("v"), F.col("part").alias("pv"))
        cross = cut(steps.join(part_u, ["shot", "u"]).join(part_v, ["shot", "v"]).where("pu <> pv"))
        if cross.isEmpty():
            break
        both = cross.select("shot", F.col("pu").alias("p"), "d", "u", "v", "pu", "pv").unionByName(
            cross.select("shot", F.col("pv").alias("p"), "d", "u", "v", "pu", "pv")
        )
        light = cut(both.groupBy("shot", "p").agg(F.min(F.struct("d", "u", "v", "pu", "pv")).alias("e")))
        picked = picked.unionByName(light.select("shot", F.col("e.u").alias("det"), "e.d"))
        merged = components(light.select("shot", F.col("e.pu").alias("a"), F.col("e.pv").alias("b")), ["shot"])
        state = cut(
            state.join(merged.select("shot", F.col("node").alias("part"), F.col("root").alias("to")), ["shot", "part"], "left").select(
                "shot", "root", "det", F.coalesce("to", "part").alias("part")
            )
        )
        steps = cross.select("shot", "u", "v", "d")
    longest = picked.join(rooted, ["shot", "det"]).groupBy("shot", "root").agg(F.max("d").alias("d"))
    return rooted.select("shot", "root").distinct().join(longest, ["shot", "root"], "left").select(
        "shot", "root", F.floor(F.coalesce("d", F.lit(0)) / 2).cast("long").alias("ready")
    )


def first_external(rooted: DataFrame, pairs: DataFrame) -> DataFrame:
    """shot, root, external: half the distance to the nearest hit of another component."""
    u = rooted.select("shot", F.col("det").alias("u"), F.col("root").alias("ru"))
    v = rooted.select("shot", F.col("det").alias("v"), F.col("root").alias("rv"))
    cross = pairs.join(u, ["shot", "u"]).join(v, ["shot", "v"]).where("ru <> rv")
    sides = cross.select("shot", F.explode(F.array("ru", "rv")).alias("root"), "d")
    return sides.groupBy("shot", "root").agg(F.floor(F.min("d") / 2).cast("long").alias("external"))


def mutual_nearest(pairs: DataFrame, cap: int) -> DataFrame:
    """shot, u, v, d: pairs that are each other's nearest hit, unambiguously, at most ``cap`` apart.

    A pair counts only when no third hit is as near to either end.
    """
    pairs = cut(pairs.select("shot", "u", "v", "d"))
    ends = pairs.select("shot", F.col("u").alias("det"), F.col("v").alias("other"), "d").unionByName(
        pairs.select("shot", F.col("v").alias("det"), F.col("u").alias("other"), "d")
    )
    best = ends.groupBy("shot", "det").agg(F.min("d").alias("best"))
    near = ends.join(best, ["shot", "det"]).where("d = best")
    single = near.groupBy("shot", "det").agg(F.min("other").alias("other"), F.count("*").alias("n"), F.min("d").alias("d")).where("n = 1")
    back = single.select("shot", F.col("other").alias("det"), F.col("det").alias("other"))
    return single.join(back, ["shot", "det", "other"]).where((F.col("det") < F.col("other")) & (F.col("d") <= cap)).select(
        "shot", F.col("det").alias("u"), F.col("other").alias("v"), "d"
    )


def accept_short_pairs(
    left: DataFrame, hits: DataFrame, graph: Graph, farthest: int, diameter: int, guard: int | None = None, mutual: bool = True
) -> DataFrame:
    """shot, u, v, d: pairs among the hits in ``left`` that are taken as clusters of two.

    A pair counts when it is at most ``farthest`` and ``diameter`` apart, when both are
    as near to each other as to any other hit left (``mutual``), and when no other of
    the shot's ``hits`` lies within ``guard`` (``farthest`` if not given, 0 for none) of
    either. Pairs are taken by (d, u, v) and a hit once: in every round the pairs that
    come first at both of their ends, which is what going through them in order gives.
    """
    guard = farthest if guard is None else guard
    left, hits = cut(left.select("shot", "det").distinct()), cut(hits.select("shot", "det").distinct())
    pairs = cut(pairs_within(left, graph, max(farthest, guard)))
    ends = pairs.select("shot", F.explode(F.array("u", "v")).alias("det"), "d")
    nearest = ends.groupBy("shot", "det").agg(F.min("d").alias("nearest"))
    asked = pairs.where(F.col("d") <= min(farthest, diameter))
    if mutual:
        for end in ("u", "v"):
            asked = asked.join(nearest.withColumnsRenamed({"det": end, "nearest": f"near_{end}"}), ["shot", end]).where(F.col(f"near_{end}") == F.col("d"))
    if guard:
        # Hits within the guard of each other; a pair's own two ends are such hits of each other as well.
        around = pairs_within(hits, graph, guard).select("shot", "u", "v")
        near = around.unionByName(around.select("shot", F.col("v").alias("u"), F.col("u").alias("v")))
        known = cut(near.groupBy("shot", F.col("u").alias("det")).agg(F.count("*").alias("n")))
        for end in ("u", "v"):
            asked = asked.join(known.withColumnsRenamed({"det": end, "n": f"n_{end}"}), ["shot", end], "left")
        own = F.when(F.col("d") <= guard, 1).otherwise(0)
        asked = asked.where((F.coalesce("n_u", F.lit(0)) == own) & (F.coalesce("n_v", F.lit(0)) == own))
    asked = cut(asked.select("shot", "u", "v", "d"))
    taken = asked.where("false")
    while not asked.isEmpty():
        rank = F.struct("d", "u", "v")
        first = asked.select("shot", F.explode(F.array("u", "v")).alias("det"), rank.alias("rank")).groupBy("shot", "det").agg(F.min("rank").alias("first"))
        wins = asked.withColumn("rank", rank)
        for end in ("u", "v"):
            wins = wins.join(first.withColumnRenamed("det", end), ["shot", end]).where("rank = first").drop("first")
        wins = cut(wins.select("shot", "u", "v", "d"))
        taken = taken.unionByName(wins)
        used = cut(wins.select("shot", F.explode(F.array("u", "v")).alias("det")))
        for end in ("u", "v"):
            asked = asked.join(used.withColumnRenamed("det", end), ["shot", end], "left_anti")
        asked = cut(asked.select("shot", "u", "v", "d"))
    return taken
