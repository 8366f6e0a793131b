"""Text cut off by field limits, by a backward character n-gram model.

The model is trained on every title, description and text: for each position it knows whether a statement or line
ends there or goes on, given the last 4, 8, 16 and 32 characters read backward. A value's final context - what stands
before any mark or transfer debris - is compared under both: the shorter contexts smooth the longer ones, the shortest
is smoothed by the rate of ends in the value's language, and the score is the log-odds of an end in the context against
the log-odds at any position of the language. A whole value that has no mark at its end is a line without one, so
for most open values only such ends count as ends; headlines, which descriptions are at times, end as statements do.

The threshold of a score is the log-odds of a cut in its group of values: language, column and kind of ending, values
whose length piles up in their source and column apart. The shares of cuts are estimated from the scores themselves by
expectation maximisation (a value's chance of being cut follows from its score and its group's share, the share is the
mean of these chances), a small group's drawn towards that of its column and kind in all languages. Scores are ratios
of rates, so thresholds do not move with the size of the corpus.

Only contexts that some value ends with are counted, found by a Bloom filter sized by their number; beyond ``MOST_BITS``
the contexts are split by hash and the texts passed over once for each part. Counts are summed over all texts.
A value's own end is taken out of what it is compared with, so a cut value does not vouch for itself, while a page
line that ends many texts does.

Defined results: null, empty and blank values are no cases; repeated rows give one row; a null language is a language
of its own; texts of any length are read whole.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from mentionloom.llm.residue import COVERED, coverage, repeats, terms
from mentionloom.session import cut

ORDERS = (4, 8, 16, 32)
#: Weight of the shorter contexts beside each longer one.
SMOOTH = (1.0, 1.0, 0.5, 0.1)
#: Bits of the filter: at least LEAST_BITS, PER_CONTEXT to twice as many for each context, at most MOST_BITS in one pass.
LEAST_BITS, PER_CONTEXT, MOST_BITS = 1 << 22, 8, 1 << 30
_BLOCK = 1 << 17
_U = np.uint64
_BASE = 0x9E3779B97F4A7C15

#: Marks and debris after a cut, longest first.
_MARKS = re.compile(
    r"(?P<hard>\s*(?:\[\s?(?:\.\.\.|…)\s?\]|\(\s?(?:\.\.\.|…)\s?\)|(?:…|\.\.\.)?\s*\[\+\d+ chars?\]|(?:…|\.\.\.)?\s*(?:Read on|Read more|Continue reading|Weiterlesen|Mehr lesen|Lire la suite|Leer más|Seguir leyendo|Читать далее|阅读全文)\s?(?:»|→|>+)?|�+|&#?\w{0,8}|<[^<>\n]{0,20}))\s*$"
    r"|(?P<attached>(?<=\S)(?:…|\.{3,}))\s*$|(?P<spaced>\s+(?:…|\.{3,}))\s*$")  # fmt: skip
#: No mark with its debris is longer.
_REACH = 80
_ENDED = re.compile(r"[.!?…。！？．۔।][\"'”’»“)\]」』]*$")
_ABBREVIATED = re.compile(r"(?:^|[\s(])[^\W\d_]{1,4}\.$|\.[^\W\d_]{1,3}\.$|(?:^|\s)\d{1,3}\.$")
_INNER = re.compile(r"[.!?。！？][\"'”’»)\]」』]*(?:\s+[^\Wa-zß-öø-ÿа-яё]|\s+[\"“„«¿¡—(]|(?<=[。！？])\S)")
#: Values of its column and kind in all languages that a group's share of cuts is drawn to, and steps of the estimate.
DRAWN, MOST_STEPS = 20, 200
#: Scores are counted in steps of this size to estimate the shares.
STEP = 0.125
#: No limit is this short; headlines are.
SHORTEST_LIMIT = 100


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of each code point: 1 space, 2 line end, 3 closing mark, 4 closer, 5 capital, opener or figure, 6 ellipsis."""
    out = np.zeros(0x11000, np.uint8)
    for c in range(0x80, len(out)):
        k = unicodedata.category(chr(c))
        out[c] = 1 if k == "Zs" else 5 if k in ("Lu", "Lt", "Lo", "Ps", "Pi") else 4 if k in ("Pe", "Pf") else 0
    for c in range(0x80):
        out[c] = 5 if chr(c).isupper() else 0
    for chars, k in ((" \t", 1), ("\n\r\0", 2), (".!?。！？．۔।", 3), ("\"')]”’»“」』", 4), ("¿¡„«“‘(—–-", 5), ("…", 6)):
        for ch in chars:
            out[ord(ch)] = k
    return out


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


@lru_cache(1)
def folded() -> np.ndarray:
    """What a code point is hashed as: lower case, figures as 0, line ends as spaces."""
    out = np.arange(0x11000, dtype=np.uint32)
    for c in range(0x530):
        low = chr(c).lower()
        out[c] = ord(low) if len(low) == 1 else c
    out[48:58] = 48
    out[[10, 13]] = 32
    return out


def rolling(codes: np.ndarray) -> dict[int, np.ndarray]:
    """For each order, a hash of the characters up to and with each position; line ends count as spaces."""
    c = np.where(codes < 0x11000, folded()[np.minimum(codes, 0x10FFF)], codes).astype(_U)
    h = (c + _U(1)) * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(29)
    out, size, power = {}, 1, _U(_BASE)
    with np.errstate(over="ignore"):
        while size < ORDERS[-1]:
            longer = h.copy()
            longer[size:] += h[:-size] * power
            h, size, power = longer, size * 2, power * power
            if size in ORDERS:
                x = h ^ (h >> _U(31))
                out[size] = x * _U(0x94D049BB133111EB)
    return out


def ends(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """1 where a statement or line may end after a position, 0 where it goes on; and the same for lines only."""
    k = classes()[np.minimum(codes, 0x10FFF)]
    pad = np.r_[k, np.full(6, 2, np.uint8)]
    n = len(k)
    k1, k2, k3, k5 = pad[1 : n + 1], pad[2 : n + 2], pad[3 : n + 3], pad[5 : n + 5]
    here_end = (k == 3) | (k == 4) | (k == 6)
    stop = (k1 == 3) & ((k2 == 1) | (k2 == 2) | (k2 == 4) | (codes > 0x2E80))
    after = here_end & (k1 == 1) & ((k2 == 5) | (k2 == 2))
    dots = np.r_[codes, np.zeros(6, codes.dtype)]
    spaced = (k1 == 1) & (((k2 == 6) & ((k3 == 2) | (k3 == 4))) | ((dots[2 : n + 2] == 46) & (dots[3 : n + 3] == 46) & ((k5 == 2) | (k5 == 4))))
    return ((k1 == 2) | (~here_end & stop) | after | spaced).astype(np.int64), (k1 == 2).astype(np.int64)


def ending(value: str) -> tuple[str, str] | None:
    """(kind of ending, what stands before mark and debris), or None for a value that plainly ends."""
    v = value.rstrip()
    if not v:
        return None
    if m := _MARKS.search(v[-_REACH:]):
        kind = "hard" if m["hard"] else "attached" if m["attached"] else "spaced"
        rest = v[: max(0, len(v) - _REACH) + m.start()].rstrip()
        if not rest:
            return None
        return ("ended" if kind == "hard" and _ENDED.search(rest[-16:]) else kind), rest
    if _ENDED.search(v[-16:]):
        return ("ended", v) if _ABBREVIATED.search(v[-8:]) else None
    tail = v.rsplit("\n", 1)[-1].strip()
    if _SIGNED.match(tail) or _is_residue(tail):
        return None
    if _INNER.search(tail):
        return "open, several", v
    # a statement of this length ends with a mark in a body; in a description it may be a headline
    return ("open, long" if "\n" in v and (tail.count(" ") >= 8 or (len(tail) > 24 and " " not in tail)) else "open, one"), v


#: A line that only names its author.
_SIGNED = re.compile(r"[—–-]\s*\S+(?:\s\S+){0,3}$")


def _is_residue(line: str) -> bool:
    """A line of filler or of an error page is whole, however it ends."""
    words = terms(line)
    return repeats(words) or coverage(words, {}, 1.0) >= COVERED


def context_hashes(texts: list[str]) -> np.ndarray:
    """The hashes of the final contexts of each text, one column per order."""
    n = ORDERS[-1]
    h = rolling(_codes("".join(("\0" * n + x[-n:])[-n:] for x in texts)))
    return np.stack([h[o][n - 1 :: n] for o in ORDERS], 1).view(np.int64)


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows, rests = [], []
        for k, s, g, d, t in pdf.itertuples(index=False):
            for field, value in (("description", d), ("text", t)):
                if value and (e := ending(value)):
                    kind = "open, several" if e[0] == "open, one" and field == "description" and value[-1].isspace() else e[0]
                    rows.append((k, field, s, g, kind, len(value)))
                    rests.append(e[1])
        out = pd.DataFrame(rows, columns=["id", "field", "source", "language", "kind", "length"])
        out["contexts"] = list(context_hashes(rests)) if rests else []
        yield out


def probes(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The two places of a hash in the filter; ``bits`` is a power of two."""
    return (h & _U(bits - 1)).astype(np.int64), ((h >> _U(33)) & _U(bits - 1)).astype(np.int64)


def _placed(bits: int):  # noqa: ANN202
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at = np.concatenate(probes(pdf["context"].to_numpy(np.int64).view(_U), bits))
            yield pd.DataFrame({"block": (at // _BLOCK).astype(np.int32), "bit": (at % _BLOCK).astype(np.int32)})

    return run


def _joined(pdf: pd.DataFrame) -> pd.DataFrame:
    block = np.zeros(_BLOCK, np.uint8)
    block[pdf["bit"].to_numpy()] = 1
    return pd.DataFrame({"block": pdf["block"].iloc[:1], "bits": [np.packbits(block, bitorder="little").tobytes()]})


def filter_of(contexts: DataFrame, bits: int) -> np.ndarray:
    """The filter of distinct contexts, made block by block; at most ``MOST_BITS`` / 8 bytes reach the driver."""
    out = np.zeros(bits // 8, np.uint8)
    rows = contexts.mapInPandas(_placed(bits), "block int, bit int").groupBy("block").applyInPandas(_joined, "block int, bits binary")
    for r in rows.toLocalIterator():
        out[r["block"] * (_BLOCK // 8) : (r["block"] + 1) * (_BLOCK // 8)] = np.frombuffer(r["bits"], np.uint8)
    return out


def part_of(h: np.ndarray, parts: int) -> np.ndarray:
    return (h >> _U(20)) % _U(parts)


def _counter(wanted: np.ndarray, part: int, parts: int):  # noqa: ANN202
    """Ends and continuations of the wanted contexts (of one part of the hashes) and, with the first part, of each language."""
    bits = len(wanted) * 8

    def counted(language: str, parts_: list[str]) -> Iterator[pd.DataFrame]:
        sep = "\0" * ORDERS[-1]
        for a in range(0, len(parts_), 2000):
            codes = _codes(sep + sep.join(parts_[a : a + 2000]) + sep)
            end, bare = ends(codes)
            # no event at the end of a description (marked by 0, 1), between values, or inside a number
            figure = (codes >= 48) & (codes <= 57)
            live = (codes > 1) & ~(figure & np.r_[figure[1:], [False]]) & ~np.r_[(codes[1:] == 0) & (np.r_[codes[2:], [0]] == 1), [True]]
            if not part:
                yield pd.DataFrame({"language": [language], "context": pd.array([None], "Int64"), "ends": [int(end[live].sum())], "bare": [int(bare[live].sum())], "n": [int(live.sum())]})
            for h in rolling(codes).values():
                one, two = probes(h, bits)
                hit = np.flatnonzero(live & ((wanted[one >> 3] >> (one & 7).astype(np.uint8)) & 1).astype(bool))
                hit = hit[((wanted[two[hit] >> 3] >> (two[hit] & 7).astype(np.uint8)) & 1).astype(bool)]
                if parts > 1:
                    hit = hit[part_of(h[hit], parts) == part]
                keys, inverse = np.unique(h[hit], return_inverse=True)
                e, b = (np.bincount(inverse, x[hit], len(keys)).astype(np.int64) for x in (end, bare))
                yield pd.DataFrame({"language": None, "context": pd.array(keys.view(np.int64), "Int64"), "ends": e, "bare": b, "n": np.bincount(inverse, minlength=len(keys))})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for language, own in pdf.groupby("language"):
                values = zip(own["title"], own["description"], own["text"])
                yield from counted(language, [v for t, d, x in values for v in (t, d and d + "\0\1", x and x.rstrip()) if v])

    return run


def statistics(texts: DataFrame, asked: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """(language, context, ends, bare, n): of the asked contexts (language null), and of each language (context null)."""
    n = asked.count()
    parts = max(1, -(-n * PER_CONTEXT // most_bits))
    bits = max(_BLOCK, min(most_bits, max(LEAST_BITS, 1 << (max(1, -(-n // parts) * PER_CONTEXT) - 1).bit_length())))
    out = None
    for part in range(parts):
        own = asked.where(F.pmod(F.shiftrightunsigned("context", 20), F.lit(parts)) == part) if parts > 1 else asked
        one = texts.mapInPandas(_counter(filter_of(own, bits), part, parts), "language string, context long, ends long, bare long, n long")
        out = one if out is None else out.union(one)
    return out.groupBy("language", "context").agg(*[F.sum(x).alias(x) for x in ("ends", "bare", "n")])


def log_odds(ends_: Column, rate: Column) -> Column:
    """Log-odds of an end: each longer context smoothed by the shorter ones (the longer, the less), the shortest by the rate.

    The shares of ends and of continuations are smoothed apart: of a context that only ends, seen often, the first is 1 in
    floating point and one less it would be 0, by which the session may refuse to divide."""
    share = lambda of, first: F.aggregate(ends_, first, lambda p, x: (of(x) + p * x["k"]) / (x["n"] + x["k"]))
    return F.log(share(lambda x: x["ends"], rate)) - F.log(share(lambda x: x["n"] - x["ends"], 1.0 - rate))


def thresholds(counts: dict[tuple[str, str, str], dict[float, int]]) -> dict[tuple[str, str, str], float]:
    """The score below which a value is more likely cut than not, for each group (language, column, kind), from how often
    each score occurs in it."""
    groups = sorted(counts)
    above = {g: (g[1:]) for g in groups}
    scores = {g: np.array(sorted(counts[g].items()), float) for g in groups}
    size = {g: scores[g][:, 1].sum() for g in groups}
    share = {g: 0.5 for g in groups}
    for _ in range(MOST_STEPS):
        cuts = {g: float((scores[g][:, 1] / (1 + np.exp(np.clip(scores[g][:, 0] - np.log(share[g] / (1 - share[g])), -500, 500)))).sum()) for g in groups}
        whole: dict[tuple, list[float]] = {}
        for g in groups:
            w = whole.setdefault(above[g], [0.5, 1.0])
            w[0], w[1] = w[0] + cuts[g], w[1] + size[g]
        new = {g: (cuts[g] + DRAWN * whole[above[g]][0] / whole[above[g]][1]) / (size[g] + DRAWN) for g in groups}
        still = max((abs(new[g] - share[g]) for g in groups), default=0.0) < 1e-9
        share = new
        if still:
            break
    return {g: float(np.log(x / (1 - x))) for g, x in share.items()}


def truncated(articles: DataFrame, key: str = "article_id", source: str = "source_domain", language: str = "language") -> DataFrame:
    """(key, field, source, language, kind, log_odds, threshold, cut) of every value whose end is in question; ``log_odds``
    are those of an end in its context against any position of its language."""
    kind = articles.schema[key].dataType.simpleString()
    own_language = F.coalesce(language, F.lit("")).alias("language")
    found = articles.select(F.col(key), F.col(source), own_language, "description", "text").mapInPandas(
        _candidates, f"id {kind}, field string, source string, language string, kind string, length int, contexts array<long>")
    found = cut(found.groupBy("id", "field", "source", "language", "kind", "length", "contexts").agg(F.count("*").alias("rows")))
    # distinct contexts: a common ending is one row of the join
    asked = found.select(F.explode("contexts").alias("context")).distinct()
    counts = cut(statistics(articles.select(own_language, "title", "description", "text"), asked))
    rates = counts.where("context IS NULL").select("language", *[((F.col(x) + 1.0) / (F.col("n") + 100.0)).alias(f"rate_{x}") for x in ("ends", "bare")])
    known = asked.join(counts.drop("language"), "context")
    # the events of the value's own end, once for each row that repeats it
    own = F.when((F.col("kind") == "spaced") | ((F.col("field") == "text") & F.col("kind").isin("open, one", "open, long", "open, several", "ended")), F.col("rows")).otherwise(0)
    bare = (F.col("kind").startswith("open") & ~((F.col("kind") == "open, one") & (F.col("field") == "description"))).alias("as_line")
    at = found.select("id", "field", "source", "language", "kind", bare, "length", own.alias("own"), F.posexplode("contexts").alias("o", "context"))
    less = lambda x: F.greatest(F.coalesce(x, F.lit(0)) - F.col("own"), F.lit(0))
    seen = F.struct("o", less(F.when(F.col("as_line"), F.col("bare")).otherwise(F.col("ends"))).alias("ends"), less(F.col("n")).alias("n"))
    j = at.join(known, "context", "left").groupBy("id", "field", "source", "language", "kind", "as_line", "length").agg(
        F.transform(F.array_sort(F.collect_list(seen)), lambda x: F.struct(x["ends"].alias("ends"), x["n"].alias("n"), F.element_at(F.array(*map(F.lit, SMOOTH)), x["o"] + 1).alias("k"))).alias("c"))
    # lengths at which open values of a source and column pile up: far more than at the lengths around
    lengths = found.where("kind LIKE 'open%'").groupBy("source", "field", "length").agg(F.count("*").alias("m"))
    around = Window.partitionBy("source", "field").orderBy("length").rangeBetween(-10, 10)
    piled = lengths.withColumn("near", (F.sum("m").over(around) - F.col("m")) / 20.0).where((F.col("length") >= SHORTEST_LIMIT) & (F.col("m") >= 3) & (F.col("m") > 5 * F.col("near")))
    piled = piled.select(F.col("source").alias("s"), F.col("field").alias("f"), F.col("length").alias("n"), F.lit(True).alias("piled"))
    j = j.join(piled, j["source"].eqNullSafe(F.col("s")) & (j["field"] == F.col("f")) & (j["length"] == F.col("n")), "left").join(rates, "language")
    j = j.withColumn("rate", F.when(F.col("as_line"), F.col("rate_bare")).otherwise(F.col("rate_ends")))
    score = log_odds(F.col("c"), F.col("rate")) - F.log(F.col("rate") / (1.0 - F.col("rate")))
    group = F.when(F.col("piled"), F.concat("kind", F.lit(", at a limit"))).otherwise(F.col("kind"))
    scored = cut(j.select("id", "field", "source", "language", "kind", group.alias("group"), score.alias("log_odds")))
    # how often each score occurs in each group: bounded by the languages and the steps of a score
    steps = F.round(F.greatest(F.lit(-60.0), F.least(F.lit(60.0), "log_odds")) / STEP).alias("step")
    often: dict[tuple[str, str, str], dict[float, int]] = {}
    for r in scored.groupBy("language", "field", "group", steps).agg(F.count("*").alias("m")).toLocalIterator():
        often.setdefault((r["language"], r["field"], r["group"]), {})[r["step"] * STEP] = r["m"]
    limits = articles.sparkSession.createDataFrame([(*k, v) for k, v in thresholds(often).items()], "language string, field string, group string, threshold double")
    out = scored.join(F.broadcast(limits), ["language", "field", "group"])
    return out.select(F.col("id").alias(key), "field", "source", "language", "kind", "log_odds", "threshold", (F.col("log_odds") < F.col("threshold")).alias("cut"))


def truncation_by_source(articles: DataFrame, key: str = "article_id", source: str = "source_domain") -> DataFrame:
    """(source, field, n_values, n_cut, share) over distinct articles with a non-blank value."""
    values = articles.select(F.col(key), F.col(source).alias("source"), F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), (F.length(F.trim(F.col(f))) > 0).alias("has")) for f in ("description", "text")])).alias("x"))
    n = values.where("x.has").select("source", key, "x.field").distinct().groupBy("source", "field").agg(F.count("*").alias("n_values"))
    c = truncated(articles, key, source).where("cut").groupBy(F.col("source").alias("s"), F.col("field").alias("f")).agg(F.count("*").alias("n_cut"))
    j = n.join(c, n["source"].eqNullSafe(c["s"]) & (n["field"] == c["f"]), "left")
    return j.select("source", "field", "n_values", F.coalesce("n_cut", F.lit(0)).alias("n_cut"),
                    F.round(F.coalesce("n_cut", F.lit(0)) / F.col("n_values"), 6).alias("share"))
