"""Connected components of an edge table, by contraction on DataFrames."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import discard, materialize


def spanning_forest(pairs: np.ndarray) -> np.ndarray:
    """For edges that one task holds: an edge from each id to the smallest one of its component."""
    pairs = np.asarray(pairs, np.int64).reshape(-1, 2)
    ids, at = np.unique(pairs, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    label = np.arange(len(ids))
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        np.minimum.at(label, before[a], label[b])
        np.minimum.at(label, before[b], label[a])
        label = label[label]
        if (label == before).all():
            break
    far = label != np.arange(len(ids))
    return np.stack([ids[far], ids[label[far]]], 1)


BROADCAST_ROWS = 200_000


def _hint(table: DataFrame):
    """What to do with the side of a join that comes from a written table: broadcast it if that is small."""
    return F.broadcast if table.count() <= BROADCAST_ROWS else lambda t: t


def connected_components(edges: DataFrame) -> DataFrame:
    """edges: src, dst long. Returns id, label (the smallest id reachable) for each id with an edge.

    The graph is contracted: each round a vertex goes to the least of itself and its neighbours, that
    one's choice is followed once more, and the edges are rewritten to what is left, without loops and
    repeats; then the maps of the rounds are composed. Vertices are compared by a bijective hash, so long
    chains of ascending ids shrink by a factor as well, and the edges of a hub are gone after a round or
    two. Edges and vertices fall from round to round, so all rounds together read a few times the edges.
    Maps of at most BROADCAST_ROWS vertices are broadcast, so that nothing is dealt by a hub; larger ones
    are joined, and the adaptive planner splits the hub's rows.
    Rounds are written to the shared folder and deleted at the end. Self-edges, nulls and repeated edges
    do no harm; an empty table gives an empty one.
    """
    named = edges.where("src IS NOT NULL AND dst IS NOT NULL AND src <> dst").select("src", "dst")
    named = materialize(named.distinct(), "edges")
    vertex = named.select(F.col("src").alias("id")).union(named.select(F.col("dst").alias("id"))).distinct().select("id", F.xxhash64("id").alias("vertex"))
    e = materialize(named.select(F.xxhash64("src").alias("u"), F.xxhash64("dst").alias("v")).select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "contracted")
    steps, old = [], [named, e]
    while not e.isEmpty():
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        choice = materialize(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("at"), F.least("u", "m").alias("to")), "choice")
        hint = _hint(choice)
        further = hint(choice.select(F.col("at").alias("by"), F.col("to").alias("last")))
        step = materialize(choice.join(further, F.col("to") == F.col("by")).select("at", F.col("last").alias("to")), "step")
        a, b = (hint(step.select(F.col("at").alias(f"at_{x}"), F.col("to").alias(f"to_{x}"))) for x in "uv")
        moved = e.join(a, F.col("u") == F.col("at_u")).select("to_u", "v").join(b, F.col("v") == F.col("at_v"))
        e = materialize(moved.where("to_u <> to_v").select(F.least("to_u", "to_v").alias("u"), F.greatest("to_u", "to_v").alias("v")).distinct(), "contracted")
        steps.append((step, hint))
        old += [choice, step, e]
    if not steps:
        return vertex.select("id", F.col("id").alias("label"))
    root, hint = steps[-1]
    for step, wider in reversed(steps[:-1]):
        later = hint(root.select(F.col("at").alias("by"), F.col("to").alias("last")))
        root, hint = step.join(later, F.col("to") == F.col("by"), "left").select("at", F.coalesce("last", "to").alias("to")), wider
    rooted = materialize(vertex.join(root, F.col("vertex") == F.col("at")).select("id", "to"), "rooted")
    least = materialize(rooted.groupBy("to").agg(F.min("id").alias("label")), "least")
    out = materialize(rooted.join(_hint(least)(least), "to").select("id", "label"), "components")
    discard(*old, rooted, least)
    return out
