"""Connected components and greedy merging."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.session import cut


def label_components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, component) for edges (a, b) of one type: the smallest id of each component.

    Minimum labels spread along edges and every label takes over its own label, so paths shrink fast; each round is
    checkpointed to the shared folder. The driver sees only whether anything changed."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), forget=True)
    label = cut(both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("g")), forget=True)
    for _ in range(max_rounds):
        near = both.join(label.select(F.col("a").alias("b"), "g"), "b").groupBy("a").agg(F.min("g").alias("m"))
        up = label.select(F.col("a").alias("g"), F.col("g").alias("gg"))
        new = cut(label.join(up, "g", "left").join(near, "a").select("a", F.least("g", "m", F.coalesce("gg", "g")).alias("g"), F.col("g").alias("old")), forget=True)
        label = new.select("a", "g")
        if not new.where("g < old").limit(1).count():
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return label.select(F.col("a").alias("id"), F.col("g").alias("component"))


def _greedy(pdf: pd.DataFrame) -> pd.DataFrame:
    """Larger entities absorb smaller ones they are similar to, each entity once: by size, then by key."""
    size = dict(zip(pdf["a"], pdf["size_a"])) | dict(zip(pdf["b"], pdf["size_b"]))
    near: dict = {}
    for a, b, s in zip(pdf["a"], pdf["b"], pdf["sim"]):
        near.setdefault(a, {})[b] = s
        near.setdefault(b, {})[a] = s
    owner: dict = {}
    for a in sorted(size, key=lambda x: (-size[x], x)):
        if a in owner:
            continue
        owner[a] = a
        for b, _ in sorted(near.get(a, {}).items(), key=lambda t: (-t[1], t[0])):
            if b not in owner and size[b] <= size[a]:
                owner[b] = a
    return pd.DataFrame({"group": pdf["group"].iloc[0], "id": list(owner), "into": list(owner.values())})


def merge_greedy(edges: DataFrame) -> DataFrame:
    """(group, id, into) for edges (group, a, size_a, b, size_b, sim): order-sensitive absorption within each group."""
    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("group", "a", "size_a", "b", "size_b", "sim").groupBy("group").applyInPandas(_greedy, f"group string, id {kind}, into {kind}")


def merge_components(edges: DataFrame) -> DataFrame:
    """(id, into): transitive merge of edges (a, b); the smallest id of a component takes the others in."""
    return label_components(edges).withColumnRenamed("component", "into")
