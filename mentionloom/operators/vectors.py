"""Vectors: means, cosines, pair features, and clustering of bounded groups."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity, 0 for a vector of length 0."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n).otherwise(F.lit(0.0))


def mean_vector(df: DataFrame, by: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """(by, vector): weighted mean by dimension; only sums travel in the shuffle."""
    w = (weight if weight is not None else F.lit(1.0)).alias("w")
    e = df.select(*by, w, F.posexplode(vector).alias("i", "v"))
    m = e.groupBy(*by, "i").agg((F.sum(F.col("v").cast("double") * F.col("w")) / F.sum("w")).alias("x"))
    return m.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias(vector))


#: Vectors of a group compared in one task.
BLOCK = 2000


def similar_pairs(df: DataFrame, by: str, key: str, vector: str, least: float, block: int = BLOCK) -> DataFrame:
    """(by, a, b, sim), a < b: pairs of a group's vectors whose cosine is at least ``least``, exactly. A group is cut into
    blocks, and every pair of blocks is compared by one matrix product; only pairs that reach ``least`` are made."""
    kinds = dict(df.dtypes)
    n = df.groupBy(by).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    j = df.select(by, key, vector).join(n, by).withColumn("own", F.pmod(F.xxhash64(key), F.col("blocks")).cast("int"))
    with_ = F.explode(F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("lo"), F.greatest(o, F.col("own")).alias("hi"))))
    j = j.select(by, key, vector, "own", with_.alias("x")).select(by, key, vector, "own", "x.lo", "x.hi")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        length = np.linalg.norm(x, axis=1, keepdims=True)
        unit = np.divide(x, length, out=np.zeros_like(x), where=length > 0)
        keys, own, lo, hi = pdf[key].to_numpy(), pdf["own"].to_numpy(), pdf["lo"].iloc[0], pdf["hi"].iloc[0]
        left, right = np.flatnonzero(own == lo), np.flatnonzero(own == hi)
        i, k = np.nonzero((sim := unit[left] @ unit[right].T) >= least)
        s, i, k = sim[i, k], left[i], right[k]
        keep = i < k if lo == hi else np.ones(len(i), bool)
        first, second = np.minimum(i, k)[keep], np.maximum(i, k)[keep]
        return pd.DataFrame({by: pdf[by].iloc[[0] * len(first)].reset_index(drop=True), "a": keys[first], "b": keys[second], "sim": s[keep]})

    return j.groupBy(by, "lo", "hi").applyInPandas(run, f"`{by}` {kinds[by]}, a {kinds[key]}, b {kinds[key]}, sim double")


def pair_features(a: Column, b: Column) -> Column:
    """[a, b, a - b, a * b] of two vectors."""
    d = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    m = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    as_double = lambda v: F.transform(v, lambda x: x.cast("double"))
    return F.concat(as_double(a), as_double(b), d, m)


def average_linkage(x: np.ndarray, threshold: float, weight: np.ndarray | None = None) -> np.ndarray:
    """Cluster numbers by average linkage on cosine distance, merging while the least distance is within the threshold; a
    row of weight n stands for n equal ones."""
    n = len(x)
    length = np.linalg.norm(x, axis=1, keepdims=True)
    unit = np.divide(x, length, out=np.zeros_like(x, dtype=float), where=length > 0)
    d = 1 - unit @ unit.T
    np.fill_diagonal(d, np.inf)
    size, label, live = np.ones(n) if weight is None else weight.astype(float), np.arange(n), np.ones(n, bool)
    while live.sum() > 1:
        i, j = divmod(int(np.argmin(d)), n)
        if d[i, j] > threshold:
            break
        i, j = min(i, j), max(i, j)
        row = (d[i] * size[i] + d[j] * size[j]) / (size[i] + size[j])
        size[i] += size[j]
        d[i], d[:, i] = row, row
        d[i, i] = np.inf
        d[j], d[:, j] = np.inf, np.inf
        live[j] = False
        label[label == j] = i
    return label


def affinity_propagation(x: np.ndarray, damping: float = 0.7, rounds: int = 200, still: int = 15) -> np.ndarray:
    """Exemplar of each row by message passing on negative squared distances, preference the median."""
    n = len(x)
    if n == 1:
        return np.zeros(1, int)
    s = -((x[:, None, :] - x[None, :, :]) ** 2).sum(2)
    s[np.diag_indices(n)] = np.median(s[~np.eye(n, dtype=bool)])
    s = s + 1e-12 * np.arange(n)[None, :]  # ties go to the later row, always the same way
    r, a, same, last = np.zeros((n, n)), np.zeros((n, n)), 0, None
    for _ in range(rounds):
        t = a + s
        first = t.argmax(1)
        top = t[np.arange(n), first]
        t[np.arange(n), first] = -np.inf
        new = s - top[:, None]
        new[np.arange(n), first] = s[np.arange(n), first] - t.max(1)
        r = damping * r + (1 - damping) * new
        p = np.maximum(r, 0)
        p[np.diag_indices(n)] = r[np.diag_indices(n)]
        total = p.sum(0)
        new = np.minimum(0, total[None, :] - p)
        new[np.diag_indices(n)] = total - p[np.diag_indices(n)]
        a = damping * a + (1 - damping) * new
        ex = np.flatnonzero(np.diag(a + r) > 0)
        same = same + 1 if last is not None and np.array_equal(ex, last) else 0
        last = ex
        if same >= still and len(ex):
            break
    if last is None or not len(last):
        return np.zeros(n, int)
    out = last[s[:, last].argmax(1)]
    out[last] = last
    return out


def best_pair_agglomeration(score: np.ndarray, stop: float) -> np.ndarray:
    """Cluster numbers by merging the pair of clusters of the best mean pair score while it exceeds ``stop``; the mean of
    a merged cluster is updated from its parts, so no pair is scored twice."""
    n = len(score)
    total, size, label = score.astype(float).copy(), np.ones(n), np.arange(n)
    live = np.ones(n, bool)
    np.fill_diagonal(total, -np.inf)
    while live.sum() > 1:
        mean = np.where(np.isfinite(total), total / np.outer(size, size), -np.inf)
        i, j = divmod(int(np.argmax(mean)), n)
        if mean[i, j] <= stop:
            break
        i, j = min(i, j), max(i, j)
        row = total[i] + total[j]
        total[i], total[:, i] = row, row
        total[i, i] = -np.inf
        total[j], total[:, j] = -np.inf, -np.inf
        size[i] += size[j]
        live[j] = False
        label[label == j] = i
    return label


def clusters_within(df: DataFrame, group: str, key: str, vector: str, method: str, weight: str | None = None, **params: float) -> DataFrame:
    """(group, key, cluster) by "linkage", "affinity" or "pairs" inside each group, groups being blocks of bounded size
    (a topic, a type within a topic). The cluster is named by its smallest key. ``weight``, for "linkage", is the number
    of equal rows that a row stands for."""
    kinds = {c: t for c, t in df.dtypes}

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key).reset_index(drop=True)
        x = np.stack(pdf[vector].to_numpy()).astype(float)
        if method == "linkage":
            label = average_linkage(x, weight=pdf[weight].to_numpy() if weight else None, **params)
        elif method == "affinity":
            label = affinity_propagation(x, **params)
        else:
            unit = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            label = best_pair_agglomeration((unit @ unit.T + 1) / 2, **params)
        first = pdf.groupby(label)[key].transform("min")
        return pd.DataFrame({group: pdf[group], key: pdf[key], "cluster": first})

    return df.select(group, key, vector, *([weight] if weight else [])).groupBy(group).applyInPandas(run, f"`{group}` {kinds[group]}, `{key}` {kinds[key]}, cluster {kinds[key]}")
