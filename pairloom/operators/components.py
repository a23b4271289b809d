"""Connected components by contraction."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pairloom.session import cut, ship, spread

# A key with at most this many links is one row of work; larger ones contract.
SMALL_LINKS = 4096
# Hooks beyond so many are joined by a shuffle. Spark would send them to the driver, as
# large as all nodes, in every round of pointer doubling.
BROADCAST_HOOKS = 50_000


def components(links: DataFrame, keys: list[str], small: int = SMALL_LINKS) -> DataFrame:
    """Smallest member of the component of every linked node.

    ``links``: the key columns plus a, b. Result: keys, node, root. Keys with few
    links are labelled one key at a time; a key with many links is contracted
    over all tasks, see :func:`contract`.
    """
    links = links.select(*keys, "a", "b").where("a <> b")
    if not keys:
        return contract(links, keys)
    links = cut(links)
    sizes = links.groupBy(*keys).agg(F.count("*").alias("n_links"))
    if (sizes.agg(F.max("n_links")).first()[0] or 0) <= small:
        return _label_small(links, keys)
    sized = links.join(sizes, keys)
    return _label_small(sized.where(F.col("n_links") <= small), keys).unionByName(
        contract(sized.where(F.col("n_links") > small), keys)
    )


def _label_small(links: DataFrame, keys: list[str]) -> DataFrame:
    ship(links.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            a, b = batch.column("a"), batch.column("b")
            count = np.diff(a.offsets.to_numpy())
            group = np.repeat(np.arange(batch.num_rows), count)
            a, b = a.flatten().to_numpy(zero_copy_only=False), b.flatten().to_numpy(zero_copy_only=False)
            group, node, root = label(group, a, b)
            columns = [batch.column(k).take(pa.array(group)) for k in keys]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(node), pa.array(root)], names=[*keys, "node", "root"])

    rows = spread(links, *keys).groupBy(*keys).agg(F.collect_list("a").alias("a"), F.collect_list("b").alias("b"))
    kinds = ", ".join(f"{k} {links.schema[k].dataType.simpleString()}" for k in keys)
    return rows.mapInArrow(run, f"{kinds}, node long, root long")


def label(group: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Smallest member per component for many groups of links at once: group, node, root."""
    ends = np.stack([np.concatenate([group, group]), np.concatenate([a, b])])
    nodes, at = np.unique(ends, axis=1, return_inverse=True)
    at = at.ravel()
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(nodes.shape[1])
    while True:
        before = root.copy()
        low = np.minimum(root[x], root[y])
        np.minimum.at(root, root[x], low)
        np.minimum.at(root, root[y], low)
        root = root[root]
        if (root == before).all():
            return nodes[0], nodes[1], nodes[1][root]


def contract(links: DataFrame, keys: list[str]) -> DataFrame:
    """:func:`components` by contraction, for keys of any size. Every round
    hooks each root to its smallest neighbour, flattens the hooks by pointer
    doubling and contracts the links to what still joins two roots, so the work
    shrinks from round to round and no component is ever gathered in one task.
    """
    left = cut(
        links.select(*keys, F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
    )
    ends = left.select(*keys, F.explode(F.array("a", "b")).alias("node")).distinct()
    label = ends.select(*keys, "node", F.col("node").alias("root"))
    while True:
        hooks = left.groupBy(*keys, F.col("b").alias("node")).agg(F.min("a").alias("up"))
        hooks = cut(hooks)
        many = hooks.count() > BROADCAST_HOOKS
        hooks = _flatten(hooks, keys, many)
        hooks = hooks.hint("merge") if many else hooks
        follow = hooks.select(*keys, F.col("node").alias("root"), "up")
        label = cut(
            label.join(follow, [*keys, "root"], "left").select(*keys, "node", F.coalesce("up", "root").alias("root"))
        )
        up_a = hooks.select(*keys, F.col("node").alias("a"), F.col("up").alias("to_a"))
        up_b = hooks.select(*keys, F.col("node").alias("b"), F.col("up").alias("to_b"))
        moved = left.join(up_a, [*keys, "a"], "left").join(up_b, [*keys, "b"], "left")
        moved = moved.select(*keys, F.coalesce("to_a", "a").alias("x"), F.coalesce("to_b", "b").alias("y"))
        left = cut(
            moved.where("x <> y").select(*keys, F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
        )
        if left.isEmpty():
            return label


def _flatten(hooks: DataFrame, keys: list[str], many: bool = False) -> DataFrame:
    """Follow hooks to the end: after k rounds every pointer spans 2^k hooks. Where there
    are ``many``, they are joined by a shuffle."""
    while True:
        ahead = hooks.select(*keys, F.col("node").alias("up"), F.col("up").alias("further"))
        joined = hooks.join(ahead.hint("merge") if many else ahead, [*keys, "up"], "left")
        hooks = cut(
            joined.select(*keys, "node", F.coalesce("further", "up").alias("up"), F.col("further").isNotNull().alias("moved"))
        )
        if hooks.where("moved").isEmpty():
            return hooks.select(*keys, "node", "up")
        hooks = hooks.select(*keys, "node", "up")
