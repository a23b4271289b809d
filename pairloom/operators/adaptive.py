"""Choosing a level's bounds per shot by trying several."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from pairloom.operators import overlay
from pairloom.operators.clusters import Level, diameters
from pairloom.operators.components import components
from pairloom.operators.landmarks import component_spans
from pairloom.operators.pairs import SMALL_SHOT, by_size, pairs_within
from pairloom.operators.paths import FAR, Graph
from pairloom.operators.regions import meetings_to_the_end
from pairloom.operators.stats import best_trial, spaced_sample
from pairloom.operators.whole_shots import groups_of_shots
from pairloom.session import cut

_CAP = int(FAR) // 2


def buffer_for(d: Column, phi: float) -> Column:
    """Smallest buffer that certifies diameter ``d`` when the share left is ``phi``."""
    return F.greatest(F.ceil(1 + 2 * (d + 1) / F.lit(float(phi))), F.lit(2)).cast("long")


def diameter_candidates(pairs: DataFrame, rim: DataFrame, fixed: int, ratio: float = 3.0, limit: int = 0) -> DataFrame:
    """shot, d: the fixed diameter and the shot's pair and boundary distances up to ``ratio`` times it."""
    seen = pairs.select("shot", "d").unionByName(rim.select("shot", F.col("rim").alias("d")))
    seen = seen.where((F.col("d") > 0) & (F.col("d") <= ratio * fixed)).unionByName(
        rim.select("shot", F.lit(fixed).cast("long").alias("d"))
    ).distinct()
    return spaced_sample(seen, ["shot"], "d", limit) if limit else seen


def buffer_candidates(pairs: DataFrame, rim: DataFrame, phi: float, previous: int) -> DataFrame:
    """shot, b: each pair distance, one less, the buffer certified for it, boundary distances, the previous b and b+1."""
    around = pairs.select("shot", F.explode(F.array(F.col("d"), F.col("d") - 1, buffer_for(F.col("d"), phi))).alias("b"))
    sides = rim.select("shot", F.explode(F.array(F.col("rim"), F.lit(previous).cast("long"), F.lit(previous + 1).cast("long"))).alias("b"))
    return around.unionByName(sides).where(F.col("b") >= max(2, previous)).distinct()


def try_bounds(hits: DataFrame, rim: DataFrame, graph: Graph, trials: DataFrame, widest: int, limit: int = SMALL_SHOT) -> DataFrame:
    """shot, d, b, clusters, active, residual of every trial; ``trials``: shot, d, b with b <= ``widest``.

    Pairs are measured once, up to the widest buffer, and every trial reuses
    them. A component is accepted when all its pairs are within d, which is
    counted, and the parity rule holds.
    """
    pairs = cut(pairs_within(hits, graph, widest, limit))
    linked = pairs.withColumnRenamed("d", "dist").join(trials, "shot").where("dist <= b")
    keys = ["shot", "d", "b"]
    found = components(linked.select(*keys, F.col("u").alias("a"), F.col("v").alias("b2")).withColumnsRenamed({"b": "buffer"}).withColumnRenamed("b2", "b"), ["shot", "d", "buffer"])
    found = found.withColumnsRenamed({"buffer": "b", "node": "det"})
    members = rim.select("shot", "det", "rim").join(trials, "shot").join(found, [*keys, "det"], "left")
    members = cut(members.select(*keys, "det", "rim", F.coalesce("root", "det").alias("root")))
    parts = members.groupBy(*keys, "root").agg(F.count("*").alias("size"), F.max("rim").alias("far_rim"))
    close = pairs.withColumnRenamed("d", "dist").join(trials, "shot").where("dist <= d").select(*keys, "u", "v")
    own = close.join(members.select(*keys, F.col("det").alias("u"), F.col("root").alias("root")), [*keys, "u"]).join(
        members.select(*keys, F.col("det").alias("v"), F.col("root").alias("root_v")), [*keys, "v"]
    )
    counted = own.where("root = root_v").groupBy(*keys, "root").agg(F.count("*").alias("close"))
    judged = parts.join(counted, [*keys, "root"], "left").withColumn(
        "accepted",
        (F.coalesce("close", F.lit(0)) == F.col("size") * (F.col("size") - 1) / 2) & ((F.col("size") % 2 == 0) | (F.col("far_rim") <= F.col("d"))),
    )
    return judged.groupBy(*keys).agg(
        F.count_if("accepted").alias("clusters"),
        F.sum(F.when(F.col("accepted"), F.col("size")).otherwise(0)).alias("active"),
        F.sum(F.when(F.col("accepted"), 0).otherwise(F.col("size"))).alias("residual"),
    )


def _diameter_for(b: Column, phi: float) -> Column:
    """Largest diameter that buffer ``b`` certifies when the share left is ``phi``."""
    return F.floor(F.lit(phi / 2) * (b - 1) - 1 + F.lit(1e-12)).cast("long")


def lasting_clusters(hits: DataFrame, rim: DataFrame, graph: Graph, phi: float = 1.0) -> DataFrame:
    """shot, root, size, far, near, start, stop: every group that some buffer bound makes
    a component and certifies, with the range start <= b < stop of those bounds (stop
    NULL: no end). ``far`` is the bound on the diameter that it needs, its boundary
    distance included where its size is odd; ``near`` uses the nearest such distance.

    A group lives from its longest inner step to its nearest outside hit. To be
    certified its diameter must be less than half of where it ends, so its life spans
    a power of two, and the components at powers of two hold all of them: a merge tree
    cut at a few heights, all heights in one job, whatever the distances are. In shots of
    ordinary size the pairs are measured once, and the tree is one row of work.
    """
    hits = cut(hits.select("shot", "det").distinct())
    small, large = by_size(hits) if overlay.reachable(graph) else (None, hits)
    parts = []
    if small is not None:
        known = rim.select("shot", "det", "rim").distinct().join(small, ["shot", "det"], "left_semi")
        pairs = pairs_within(known.select("shot", "det"), graph, _CAP // 2, masks=False)
        parts.append(groups_of_shots(known, pairs).where(F.col("stop").isNull() | (F.col("diameter") <= _diameter_for(F.col("stop") - 1, phi))))
    if large is not None:
        parts.append(_groups_at_heights(large, rim, graph, phi))
    rims = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    odd = F.col("size") % 2 == 1
    lives = rims.select(
        "shot", "root", "size", "stop",
        F.when(odd, F.greatest("diameter", "far_rim")).otherwise(F.col("diameter")).alias("far"),
        F.when(odd, F.greatest("diameter", "near_rim")).otherwise(F.col("diameter")).alias("near"),
    )
    lives = lives.where(F.col("far") < _CAP).withColumn("start", buffer_for(F.col("far"), phi))
    return lives.where("stop IS NULL OR start < stop").select("shot", "root", "size", "far", "near", "start", "stop")


def _groups_at_heights(hits: DataFrame, rim: DataFrame, graph: Graph, phi: float) -> DataFrame:
    """shot, root, size, stop, diameter, far_rim, near_rim of the groups that can be certified."""
    steps = cut(meetings_to_the_end(hits, graph))
    top = steps.agg(F.max("d")).first()[0] or 0
    heights = [1 << k for k in range(max(1, top).bit_length() + 1)]
    cuts = steps.select("shot", "u", "v", "d", F.explode(F.array(*[F.lit(h).cast("long") for h in heights])).alias("height"))
    found = components(cuts.where("d <= height").select("shot", "height", F.col("u").alias("a"), F.col("v").alias("b")), ["shot", "height"])
    every = hits.select("shot", "det", F.explode(F.array(*[F.lit(h).cast("long") for h in heights])).alias("height"))
    members = every.join(found.withColumnRenamed("node", "det"), ["shot", "height", "det"], "left")
    members = cut(members.select("shot", "height", F.coalesce("root", "det").alias("root"), "det"))
    # Groups are nested, so one that stands unchanged at several heights is known by root and size.
    sizes = members.groupBy("shot", "height", "root").agg(F.count("*").alias("size"))
    kept = cut(sizes.groupBy("shot", "root", "size").agg(F.min("height").alias("height")))
    members = cut(members.join(kept, ["shot", "height", "root"]))
    at = [members.select("shot", "height", F.col("det").alias(x), F.col("root").alias(f"root_{x}")) for x in ("u", "v")]
    sides = cuts.join(at[0], ["shot", "height", "u"], "left").join(at[1], ["shot", "height", "v"], "left").where("NOT root_u <=> root_v")
    outside = sides.select("shot", "height", F.explode(F.array("root_u", "root_v")).alias("root"), "d").where("root IS NOT NULL")
    ends = cut(outside.groupBy("shot", "height", "root").agg(F.min("d").alias("stop")))
    # A group must fit a diameter that some bound below its end certifies.
    ended = members.join(ends, ["shot", "height", "root"], "left")
    widest = component_spans(graph).agg(F.max("span")).first()[0] or 0
    cap = F.coalesce(_diameter_for(F.col("stop") - 1, phi), F.lit(widest))
    alive = cut(ended.withColumn("cap", cap).where("cap >= 0"))
    keys = ["shot", "height", "root"]
    wide = diameters(alive, graph, F.col("cap"), keys).where("diameter IS NOT NULL").select(*keys, "diameter")
    rims = alive.join(rim.select("shot", "det", "rim"), ["shot", "det"]).groupBy(*keys, "size", "stop").agg(F.max("rim").alias("far_rim"), F.min("rim").alias("near_rim"))
    return rims.join(wide, keys).select("shot", "root", "size", "stop", "diameter", "far_rim", "near_rim")


def breakpoint_bounds(hits: DataFrame, rim: DataFrame, graph: Graph, previous: Level, phi: float = 1.0) -> DataFrame:
    """shot, d, b, clusters, active, residual: the best bounds of the next level over all
    buffer bounds from the previous one on, each with the largest diameter that it
    certifies, shrunk to what the accepted groups need. Best is: most clusters, most
    hits taken, fewest left, smallest d, smallest b. Shots where no bound accepts a
    group have no row.

    Between two ends of lives nothing changes, so the bounds at which a group begins
    or ends to be accepted (and the previous bound) stand for all distances.
    """
    lives = cut(lasting_clusters(hits, rim, graph, phi))
    lives = lives.where(F.col("stop").isNull() | (F.col("stop") > previous.b)).withColumn("start", F.greatest("start", F.lit(previous.b)))
    same = cut(lives.groupBy("shot", "start", "stop", "far", "near").agg(F.count("*").alias("n"), F.sum("size").alias("hits")))
    tries = same.select("shot", F.explode(F.array("start", "stop")).alias("b")).where("b IS NOT NULL").distinct()
    tries = tries.where(_diameter_for(F.col("b"), phi) >= previous.d)
    live = tries.join(same, "shot").where("start <= b AND (stop IS NULL OR b < stop)")
    asked = live.groupBy("shot", "b").agg(F.greatest(F.max("near"), F.lit(previous.d)).alias("d"))
    fits = live.join(asked, ["shot", "b"]).where("far <= d AND d > 0")
    sizes = hits.groupBy("shot").agg(F.count_distinct("det").alias("hits_of_shot"))
    scored = fits.groupBy("shot", "b", "d").agg(F.sum("n").alias("clusters"), F.sum("hits").alias("active")).join(sizes, "shot")
    return choose(scored.withColumn("residual", F.col("hits_of_shot") - F.col("active")))


def choose(scored: DataFrame) -> DataFrame:
    """The trial with most clusters, then most hits taken, fewest left, smallest d, smallest b."""
    order = [F.col("clusters"), F.col("active"), -F.col("residual"), -F.col("d"), -F.col("b")]
    return best_trial(scored, ["shot"], order).select("shot", "d", "b", "clusters", "active", "residual")
