"""Documents packed into containers of fixed capacity by bound-certified repacking.

Every partition packs its documents by best-fit decreasing and computes lower bounds on its number of containers by
dual feasible functions. Where the count meets the bound the partition is certified and done. Where it does not,
full containers stay and the documents of containers with gaps are released; partitions then exchange them - released
documents of several partitions meet in one - and best-fit decreasing runs again.

A partition holds about ``items`` documents in every round, since the number of partitions follows what was released.
A spec is done when one partition is left, or when a round released more than ``SHRINK`` of its documents: then
exchanging gains nothing (sizes that leave a gap in nearly every container), and its containers stay as they are. So
rounds end after the logarithm of the documents. ``report`` holds the containers against the bound over all documents.

Defined results: null texts and texts of no tokens need no container and give no row; a document larger than the
capacity is split into pieces that fill containers, the rest being an item; ties in size go to the smaller document
id and part; a document repeated in several rows is one document; empty tables give an empty result.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.llm.tokens import NAMES, TOKENIZER_DIR, token_counts
from mentionloom.session import cut

#: Documents a partition holds on average, and the largest share of its documents that a round may release to go on.
ITEMS, SHRINK = 20_000, 0.8
SCHEMA = "spec_id int, container string, doc_id long, part int, size long, capacity long, shards long, open boolean"


def best_fit_decreasing(sizes: np.ndarray, capacity: int) -> list[int]:
    """The container of each item (given in decreasing size): always the fullest one that still has room.

    Open containers are kept by free room; a bit set of the rooms in use finds the best fit in one step."""
    rooms: dict[int, list[int]] = defaultdict(list)
    used, out, n = 0, [], 0
    for s in sizes.tolist():
        above = used >> s
        if above:
            room = s + (above & -above).bit_length() - 1
            b = rooms[room].pop()
            if not rooms[room]:
                used &= ~(1 << room)
        else:
            room, b = capacity, n
            n += 1
        left = room - s
        if left:
            rooms[left].append(b)
            used |= 1 << left
        out.append(b)
    return out


def lower_bound(sizes: np.ndarray, capacity: int, counts: np.ndarray | None = None) -> int:
    """No packing needs fewer containers: the best of the dual feasible functions u_k and f_eps over the sizes, of each of
    which there are ``counts``."""
    if not len(sizes):
        return 0
    values, n = np.unique(sizes, return_counts=True) if counts is None else (sizes, counts)
    best = -(-int((values * n).sum()) // capacity)
    for k in range(1, 21):  # u_k: x -> floor((k + 1) x) / k, but x where (k + 1) x is whole
        whole = (values * (k + 1)) % capacity == 0
        total = int((np.where(whole, values * k, ((values * (k + 1)) // capacity) * capacity) * n).sum())
        best = max(best, -(-total // (k * capacity)))
    for eps in values[values * 2 <= capacity].tolist():  # f_eps: above 1 - eps counts whole, below eps not at all
        f = np.where(values > capacity - eps, capacity, np.where(values >= eps, values, 0))
        best = max(best, -(-int((f * n).sum()) // capacity))
    return best


def _packer(stage: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    return lambda key, pdf: _pack(pdf, stage, int(key[1]))


def _pack(pdf: pd.DataFrame, stage: int, shard: int) -> pd.DataFrame:
    pdf = pdf.sort_values(["size", "doc_id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
    capacity, sizes = int(pdf["capacity"].iloc[0]), pdf["size"].to_numpy("i8")
    bins = np.array(best_fit_decreasing(sizes, capacity))
    certified = bins.max() + 1 <= lower_bound(sizes, capacity)
    fill = np.bincount(bins, sizes)
    gap = (capacity - fill) * 50 > capacity  # more than 2 % free
    # a certified partition can still lend its last, mostly empty container
    free = (fill * 2 < capacity) if certified else gap
    pdf["open"] = free[bins] & (pdf["shards"].to_numpy() > 1)
    pdf["container"] = [f"{stage}-{shard}-{b}" for b in bins]
    return pdf[["spec_id", "container", "doc_id", "part", "size", "capacity", "shards", "open"]]


def items_of(sizes: DataFrame) -> DataFrame:
    """(spec_id, doc_id, size, capacity) to pieces: what exceeds the capacity is split into full pieces and a rest."""
    n = F.ceil(F.col("size") / F.col("capacity"))
    parts = sizes.where("size > 0").withColumn("part", F.explode(F.sequence(F.lit(0), (n - 1).cast("int"))))
    return parts.withColumn("size", F.least(F.col("capacity"), F.col("size") - F.col("part") * F.col("capacity")))


def _shared_out(rest: DataFrame, items: int, stage: int) -> DataFrame:
    """``rest`` with the number of partitions of its spec, and its own by a hash that changes from round to round."""
    n = rest.groupBy("spec_id").agg(F.ceil(F.count("*") / items).cast("long").alias("shards"))
    return rest.join(n, "spec_id").withColumn("shard", F.pmod(F.xxhash64("doc_id", "part", F.lit(stage)), F.col("shards")))


def pack(sizes: DataFrame, items: int = ITEMS, shrink: float = SHRINK) -> DataFrame:
    """(spec_id, container, doc_id, part, size) for (spec_id, doc_id, size, capacity)."""
    pieces = items_of(sizes)
    columns = ["spec_id", "container", "doc_id", "part", "size"]
    out = pieces.where("size = capacity").withColumn("container", F.concat_ws("-", F.lit("f"), "doc_id", "part")).select(columns)
    now, stage = pieces.where("size < capacity").select("spec_id", "doc_id", "part", "size", "capacity"), 0
    while True:
        packed = cut(_shared_out(now, items, stage).groupBy("spec_id", "shard").applyInPandas(_packer(stage), SCHEMA))
        # one row for each spec
        after = packed.groupBy("spec_id").agg(F.sum(F.col("open").cast("long")).alias("open"), F.count("*").alias("n")).collect()
        going = [r["spec_id"] for r in after if 0 < r["open"] <= shrink * r["n"]]
        released = F.col("open") & F.col("spec_id").isin(going)
        out = out.unionByName(packed.where(~released).select(columns))
        if not going:
            return out
        now, stage = packed.where(released).select("spec_id", "doc_id", "part", "size", "capacity"), stage + 1


def _bound(pdf: pd.DataFrame) -> pd.DataFrame:
    capacity = int(pdf["capacity"].iloc[0])
    full = pdf["size"].to_numpy() == capacity
    rest = pdf[~full].sort_values("size")
    return pd.DataFrame({"spec_id": pdf["spec_id"].iloc[:1], "capacity": [capacity], "bound": [
        int(pdf["n"][full].sum()) + lower_bound(rest["size"].to_numpy("i8"), capacity, rest["n"].to_numpy("i8"))]})


def report(containers: DataFrame, capacities: DataFrame) -> DataFrame:
    """(spec_id, capacity, items, tokens, containers, bound, unused): the containers of each spec, the least number that any
    packing of its items needs, and the share of room unused. ``capacities`` has (spec_id, capacity). A spec's sizes
    are counted first: at most as many rows as its capacity."""
    n = containers.groupBy("spec_id", "size").agg(F.count("*").alias("n")).join(capacities.select("spec_id", "capacity").distinct(), "spec_id")
    bound = n.groupBy("spec_id").applyInPandas(_bound, "spec_id int, capacity long, bound long")
    c = containers.groupBy("spec_id").agg(F.count("*").alias("items"), F.sum("size").alias("tokens"), F.count_distinct("container").alias("containers"))
    unused = F.round(1 - F.col("tokens") / (F.col("containers") * F.col("capacity")), 6).alias("unused")
    return c.join(bound, "spec_id").select("spec_id", "capacity", "items", "tokens", "containers", "bound", unused)


def pack_documents(documents: DataFrame, specs: DataFrame, folder: str = TOKENIZER_DIR, **limits: int) -> DataFrame:
    """The containers of every row of ``specs`` (spec_id, tokenizer, capacity), sizes in its tokenizer's tokens."""
    counts = cut(token_counts(documents, folder=folder).groupBy("doc_id").agg(*[F.max(n).alias(n) for n in NAMES]))
    long = counts.select("doc_id", F.explode(F.map_from_arrays(F.array(*map(F.lit, NAMES)), F.array(*NAMES))).alias("tokenizer", "size"))
    s = specs.select("spec_id", "tokenizer", F.col("capacity").cast("long").alias("capacity")).where("capacity > 0").distinct()
    return pack(long.join(s, "tokenizer").select("spec_id", "doc_id", "size", "capacity"), **limits)
