"""Connected components of a link table, by repeated hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of ``links`` (a, b), root the least node reachable.

    Each round every node hooks onto its least neighbour, hooks are followed
    twice, and the links are rewritten between what remains; a node that has a
    lesser neighbour disappears from the links, so that the table shrinks
    geometrically. Rounds are written to the shared folder: nothing is
    collected, and lineage stays short. Nodes may be of any orderable type.
    Null ends and self-links are ignored; no links give no rows.
    """
    live = materialize(
        links.select("a", "b").where("a is not null and b is not null and a <> b").distinct(), "cc-links"
    )
    roots = None
    for _ in range(max_rounds):
        if live.isEmpty():
            break
        both = live.unionByName(live.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
        hook = hook.select("node", F.least("node", "to").alias("to"))
        for _ in range(2):
            hook = (
                hook.alias("h")
                .join(hook.select(F.col("node").alias("to"), F.col("to").alias("next")), "to", "left")
                .select("node", F.coalesce("next", "to").alias("to"))
            )
        hook = materialize(hook, "cc-hooks")
        if roots is None:
            roots = hook.select("node", F.col("to").alias("root"))
        else:
            step = hook.select(F.col("node").alias("root"), F.col("to").alias("next"))
            roots = roots.join(step, "root", "left").select("node", F.coalesce("next", "root").alias("root"))
        roots = materialize(roots, "cc-roots")
        to = hook.select(F.col("node").alias("a"), F.col("to").alias("ra"))
        live = live.join(to, "a").join(to.toDF("b", "rb"), "b")
        live = materialize(
            live.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).where("a <> b").distinct(),
            "cc-links",
        )
    else:
        raise RuntimeError(f"components are still linked after {max_rounds} rounds")
    if roots is None:
        return live.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots
