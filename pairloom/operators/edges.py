"""Edge tables: merging, discretising, negative weights, correlations.

User edges: u, v (NULL = boundary), w DOUBLE, p DOUBLE, obs ARRAY<INT>, ord.
Discrete edges: u, v, w LONG (absolute, even), sign, obs_mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from pairloom.functions.masks import mask_from_indices
from pairloom.functions.weights import log_odds, merge_log_odds_of_all, xor_probability_of_all

# 2^24 distinct half weights; the largest weight a user may give.
DISTINCT_WEIGHTS = 2**24
LARGEST_WEIGHT = float(DISTINCT_WEIGHTS - 1)

STRATEGIES = ("disallow", "independent", "smallest_weight", "keep_original", "replace")


def canonical(edges: DataFrame) -> DataFrame:
    """Order end points so that u <= v; the boundary stays NULL in v."""
    return edges.withColumns(
        {
            "u": F.least("u", F.coalesce("v", "u")),
            "v": F.when(F.col("v").isNotNull(), F.greatest("u", "v")),
        }
    )


def merge_parallel(edges: DataFrame, strategy: str = "independent") -> DataFrame:
    """One row per end-point pair. Every strategy is a combinable aggregate."""
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy!r}")
    groups = canonical(edges).groupBy("u", "v")
    whole = F.struct("w", "p", "obs")
    if strategy == "independent":
        # A lone edge keeps its exact numbers: whole weights must stay whole.
        lone = F.count("*") == 1
        return groups.agg(
            F.when(lone, F.min("w")).otherwise(merge_log_odds_of_all(F.col("w"))).alias("w"),
            F.when(lone, F.min("p")).otherwise(xor_probability_of_all(F.col("p"))).alias("p"),
            F.min_by("obs", "ord").alias("obs"),
            F.count("*").alias("parallel"),
        )
    picked: Column = {
        "disallow": F.min_by(whole, "ord"),
        "keep_original": F.min_by(whole, "ord"),
        "replace": F.max_by(whole, "ord"),
        "smallest_weight": F.min_by(whole, F.struct("w", "ord")),
    }[strategy]
    merged = groups.agg(picked.alias("e"), F.count("*").alias("parallel"))
    if strategy == "disallow":
        merged = merged.withColumn(
            "parallel",
            F.when(F.col("parallel") > 1, F.raise_error(F.lit("parallel edges are not allowed")).cast("long")).otherwise(
                F.col("parallel")
            ),
        )
    return merged.select("u", "v", "e.w", "e.p", "e.obs", "parallel")


def graph_size(edges: DataFrame) -> DataFrame:
    """num_nodes and num_observables implied by an edge table."""
    return edges.agg(
        (F.max(F.greatest("u", F.coalesce("v", "u"))) + 1).alias("num_nodes"),
        F.coalesce((F.max(F.array_max("obs")) + 1).cast("long"), F.lit(0).cast("long")).alias("num_observables"),
    )


def normaliser(edges: DataFrame, implied: DataFrame | None = None, distinct: int = DISTINCT_WEIGHTS) -> DataFrame:
    """One row: largest, integral, norm. ``implied`` adds a column ``w`` of implied weights."""
    weights = edges.select("w")
    if implied is not None:
        weights = weights.unionByName(implied.select("w"))
    row = weights.agg(
        F.max(F.abs("w")).alias("largest"), F.bool_and(F.col("w") == F.round("w")).alias("integral")
    )
    norm = (
        F.when(
            F.col("largest") > LARGEST_WEIGHT,
            F.raise_error(F.lit("maximum absolute edge weight exceeded")).cast("double"),
        )
        .when(F.col("integral"), 1.0)
        .otherwise(float(distinct - 1) / F.col("largest"))
    )
    return row.withColumn("norm", norm)


def discretise(edges: DataFrame, boundary: DataFrame | None = None, distinct: int = DISTINCT_WEIGHTS, masks: bool = True) -> DataFrame:
    """Even integer weights, signs and masks; without ``masks`` the numbers of the
    observables stay a column ``obs`` and may be any, and the mask is 0.

    An edge into a boundary node (``boundary.id``) becomes a boundary edge, one
    between two boundary nodes is dropped, and of several boundary edges of a
    node the lightest stays.
    """
    norm = normaliser(edges, distinct=distinct).select("norm").scalar()
    flags = ["obs_mask"] if masks else ["obs_mask", "obs"]
    mask = mask_from_indices(F.col("obs")) if masks else F.lit(0).cast("long")
    out = edges.select("u", "v", (F.round(F.col("w") * norm).cast("long") * 2).alias("w"), mask.alias("obs_mask"), *flags[1:])
    if boundary is not None:
        rim = boundary.select("id").distinct()
        out = (
            out.join(rim.select(F.col("id").alias("u"), F.lit(True).alias("bu")), "u", "left")
            .join(rim.select(F.col("id").alias("v"), F.lit(True).alias("bv")), "v", "left")
            .where("NOT (coalesce(bu, false) AND (coalesce(bv, false) OR v IS NULL))")
            .select(
                F.when(F.col("bu"), F.col("v")).otherwise(F.col("u")).alias("u"),
                F.when(~F.coalesce("bu", F.lit(False)) & ~F.coalesce("bv", F.lit(False)), F.col("v")).alias("v"),
                "w",
                *flags,
            )
        )
    inner = out.where("v IS NOT NULL")
    rim_edges = (
        out.where("v IS NULL")
        .groupBy("u")
        .agg(F.min(F.struct("w", *flags)).alias("e"))
        .select("u", F.lit(None).cast("long").alias("v"), "e.*")
    )
    return inner.select("u", "v", "w", *flags).unionByName(rim_edges).select(
        "u", "v", F.abs("w").alias("w"), F.when(F.col("w") < 0, -1).otherwise(1).alias("sign"), *flags
    )


def search_ready(dedges: DataFrame) -> DataFrame:
    """The discrete edges a path or matching may use: self loops never do."""
    return dedges.where("v IS NULL OR u <> v")


def negative_totals(dedges: DataFrame) -> DataFrame:
    """One row: total negative weight and the mask toggled by negative edges (self loops count)."""
    return dedges.where("sign < 0").agg(
        F.coalesce(-F.sum("w"), F.lit(0).cast("long")).alias("negative_weight"),
        F.coalesce(F.bit_xor("obs_mask"), F.lit(0).cast("long")).alias("negative_mask"),
        F.count("*").alias("negative_edges"),
    )


def negative_toggles(dedges: DataFrame) -> DataFrame:
    """Nodes (id) that an odd number of negative edge ends touch."""
    ends = dedges.where("sign < 0").select(F.explode(F.array("u", "v")).alias("id")).where("id IS NOT NULL")
    return ends.groupBy("id").count().where("count % 2 = 1").select("id")


def toggled_observables(edges: DataFrame) -> DataFrame:
    """Observable numbers an odd number of negative edges (user or discrete ones) carry."""
    negative = F.col("sign") < 0 if "sign" in edges.columns else F.col("w") < 0
    flags = edges.where(negative).select(F.explode("obs").alias("obs"))
    return flags.groupBy("obs").count().where("count % 2 = 1").select("obs")


def lookup(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """Weight of each wanted (u, v); v NULL asks for the boundary edge. No row: no edge."""
    keyed = canonical(edges).select("u", "v", "w")
    asked = canonical(wanted)
    match = asked["u"].eqNullSafe(keyed["u"]) & asked["v"].eqNullSafe(keyed["v"])
    return asked.join(keyed, match, "inner").select(asked["u"], asked["v"], keyed["w"])


def existing(edges: DataFrame, wanted: DataFrame) -> DataFrame:
    """The wanted pairs that are edges."""
    keyed = canonical(edges)
    asked = canonical(wanted)
    match = asked["u"].eqNullSafe(keyed["u"]) & asked["v"].eqNullSafe(keyed["v"])
    return asked.join(keyed, match, "left_semi").select("u", "v")


def heaviest_plus_one(dedges: DataFrame) -> DataFrame:
    """One row: first diameter bound, the largest discrete weight plus one."""
    row = dedges.agg(F.max("w").alias("w_max"))
    return row.withColumn(
        "first_diameter",
        F.when(F.col("w_max") > 0, F.col("w_max") + 1).otherwise(
            F.raise_error(F.lit("no positive edge weight")).cast("long")
        ),
    )


# Correlated errors ---------------------------------------------------------


def joint_probabilities(pieces: DataFrame) -> DataFrame:
    """Joint probability of two edges fired by the same error.

    ``pieces``: error, piece, u, v, p. Result: u, v, other_u, other_v, joint,
    where the row with equal pairs is the marginal. The pieces of one error, whose number
    is a property of the model text, are brought together once and meet in one row; a
    pair of different edges has the same value either way round and is added up once.
    """
    ends = canonical(pieces.select("error", "piece", "u", "v", "p"))
    own = ends.groupBy("error").agg(F.collect_list(F.struct("piece", F.struct("u", "v").alias("edge"), "p")).alias("own"))
    one = own.select("error", "own", F.posexplode("own").alias("i", "a"))
    two = one.select("error", "i", "a", F.posexplode("own").alias("j", "b"))
    apart = F.col("error").isNotNull() & (F.col("a.piece") != F.col("b.piece")) & (F.col("a.edge") <= F.col("b.edge"))
    both = two.where((F.col("i") == F.col("j")) | apart).select(F.col("a.edge").alias("edge"), F.col("b.edge").alias("other"), F.col("a.p").alias("p"))
    joint = both.select("edge.u", "edge.v", F.col("other.u").alias("other_u"), F.col("other.v").alias("other_v"), "p")
    joint = joint.groupBy("u", "v", "other_u", "other_v").agg(xor_probability_of_all(F.col("p")).alias("joint"))
    there = F.struct("u", "v", "other_u", "other_v")
    back = F.struct(F.col("other_u").alias("u"), F.col("other_v").alias("v"), F.col("u").alias("other_u"), F.col("v").alias("other_v"))
    same = F.col("u").eqNullSafe(F.col("other_u")) & F.col("v").eqNullSafe(F.col("other_v"))
    return joint.select(F.explode(F.when(same, F.array(there)).otherwise(F.array(there, back))).alias("x"), "joint").select("x.*", "joint")


def implied_weights(joint: DataFrame) -> DataFrame:
    """u, v, other_u, other_v, w: weight of the other edge once (u, v) is known to have fired."""
    same = F.col("u").eqNullSafe(F.col("other_u")) & F.col("v").eqNullSafe(F.col("other_v"))
    known = joint.withColumn("same", same).withColumn("own", F.max(F.when(same, F.col("joint"))).over(Window.partitionBy("u", "v")))
    share = F.least(F.lit(0.5), F.col("joint") / F.col("own"))
    return known.where("NOT same AND own <> 0").select("u", "v", "other_u", "other_v", log_odds(share).alias("w"))


def reweight(dedges: DataFrame, fired: DataFrame, implied: DataFrame) -> DataFrame:
    """Per shot, discrete edges lowered by the edges already known to have fired.

    ``fired``: shot, u, v; ``implied``: u, v, other_u, other_v, w LONG. Returns
    shot, u, v, w for the lowered edges only: the base table is never changed,
    so there is nothing to undo.
    """
    rules = implied.select("u", "v", "other_u", "other_v", F.col("w").alias("new_w"))
    hit = fired["u"].eqNullSafe(rules["u"]) & fired["v"].eqNullSafe(rules["v"])
    lowered = (
        fired.join(rules, hit)
        .groupBy("shot", F.col("other_u").alias("eu"), F.col("other_v").alias("ev"))
        .agg(F.min("new_w").alias("new_w"))
    )
    match = lowered["eu"].eqNullSafe(dedges["u"]) & lowered["ev"].eqNullSafe(dedges["v"])
    return lowered.join(dedges, match).where("new_w < w").select("shot", "u", "v", F.col("new_w").alias("w"))


def implied_to_integer(implied: DataFrame, norm: Column) -> DataFrame:
    """Implied weights on the discrete scale: absolute, even, same factor as the edges."""
    return implied.withColumn("w", F.abs(F.round(F.col("w") * norm).cast("long") * 2))
