"""Scalar expressions shared by operators: strings, numbers, arrays and JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance; texts equal without their dots are at distance 0."""
    same = F.replace(a, F.lit("."), F.lit("")) == F.replace(b, F.lit("."), F.lit(""))
    return F.when(same, 0).otherwise(F.levenshtein(a, b))


def is_ordered_subsequence(inner: Column, outer: Column) -> Column:
    """Whether the words of one array occur in another in the same order."""
    state = F.aggregate(outer, F.lit(0), lambda i, w: F.when(F.get(inner, i) == w, i + 1).otherwise(i))
    return state == F.size(inner)


def ordered_intersection(a: Column, b: Column) -> Column:
    """The words of one array found in another, in order, each after the one before."""
    empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(s: Column, w: Column) -> Column:
        rest = F.slice(b, s["at"] + 1, F.size(b))
        i = F.array_position(rest, w).cast("int")
        return F.when(i > 0, F.struct((s["at"] + i).alias("at"), F.concat(s["out"], F.array(w)).alias("out"))).otherwise(s)

    return F.aggregate(a, empty, step, lambda s: s["out"])


def trim_offsets(text: Column) -> tuple[Column, Column]:
    """How many white-space characters were at the beginning and the end."""
    return F.length(text) - F.length(F.ltrim(text)), F.length(text) - F.length(F.rtrim(text))


def singular(word: Column) -> Column:
    """A word without a trailing s or number sign."""
    return F.regexp_replace(F.regexp_replace(word, "s$", ""), "#", "")


def overlap_threshold(n: Column, low: float = 0.5, high: float = 0.7, base: float = 5000.0) -> Column:
    """The logarithm of a size to a base, rounded to one decimal and held between two bounds."""
    return F.least(F.greatest(F.round(F.log(n) / F.log(F.lit(base)), 1), F.lit(low)), F.lit(high))


def phrase_relevance(length: Column, count: Column) -> Column:
    """ln(length) * ln(length * log2(1 + count)), 0 where undefined."""
    inner = length * F.log2(1 + count)
    return F.when((length > 0) & (inner > 0), F.log(length) * F.log(inner)).otherwise(0.0)


def wordset_relevance(length: Column, support: Column) -> Column:
    """ln(1 + length) * log2(support)."""
    return F.log(1 + length) * F.log2(support)


def hours_minutes_seconds(seconds: Column) -> Column:
    """A duration as h:mm:ss."""
    s = seconds.cast("long")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def recode(value: Column, table: dict[str, str], default: str = "OTHER") -> Column:
    """A category by a fixed table."""
    return F.coalesce(F.get(F.transform(F.filter(F.map_entries(F.create_map(*[F.lit(x) for kv in table.items() for x in kv])), lambda e: e["key"] == value), lambda e: e["value"]), F.lit(0)), F.lit(default))
