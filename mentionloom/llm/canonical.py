"""One consistent form of text whose characters only look like the usual ones.

A token is a run of letters, digits, marks and invisible characters. Tokens that hold a wide, styled or joined
letter, a separate accent, an invisible character or letters of several scripts are looked up in the vocabulary of
the corpus' own clean tokens: tries are walked by a weighted edit automaton in which look-alikes, ignorables, styled forms
and accents of their letter cost nothing and a letter of a foreign script that looks like no other costs 1, and
the most frequent spelling reached at the least cost within the budget is the canonical one. The automaton reads the token
as it is written and keeps a trace of the steps that were not plain; a token that it reads by plain steps alone is no
case. Tokens without a match are read by table, with a trace of their own. Spaces other than U+0020 become U+0020.

Tokens and vocabulary are sharded by skeleton (look-alikes folded to one letter), which zero-cost edits never change, so
a shard's trie holds every spelling its tokens can reach. A token with foreign letters is a member of the shards of
its patterns, in which each of them stands for any letter, too; words of the vocabulary are placed there by the same rule.

The contract of p5_found names characters, and each of them is a step of the trace: the vocabulary decides what a
token's canonical form is, the trace whether its field is a case.

Defined results: null fields give no row, empty and clean ones their own text; repeated rows give one row; ties between
spellings go to the smaller one; texts of any length are handled whole.
"""

from __future__ import annotations

import re
import unicodedata as U
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.llm.frames import frame
from mentionloom.session import cut

# Look-alike letters of Greek and Cyrillic and the Latin letters they are taken for.
LOOK_ALIKES = {
    "Α": "A", "Β": "B", "Ε": "E", "Ζ": "Z", "Η": "H", "Ι": "I", "Κ": "K", "Μ": "M", "Ν": "N", "Ο": "O", "Ρ": "P", "Τ": "T", "Υ": "Y", "Χ": "X",
    "α": "a", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "υ": "u", "χ": "x", "ϲ": "c", "ϳ": "j", "ε": "e", "γ": "y", "η": "n", "τ": "t",
    "А": "A", "В": "B", "Е": "E", "К": "K", "М": "M", "Н": "H", "О": "O", "Р": "P", "С": "C", "Т": "T", "У": "Y", "Х": "X", "І": "I", "Ј": "J", "Ѕ": "S", "Ѵ": "V",
    "а": "a", "е": "e", "о": "o", "р": "p", "с": "c", "у": "y", "х": "x", "і": "i", "ј": "j", "ѕ": "s", "һ": "h", "ԁ": "d", "ԛ": "q", "ԝ": "w", "к": "k", "м": "m", "т": "t", "ѵ": "v", "в": "b", "н": "h", "ё": "ë", "Ё": "Ë", "ї": "ï", "Ї": "Ï",
}
SPACES = "\xa0\u1680\u2000-\u200a\u202f\u205f\u3000"
INVISIBLE = "\xad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b-\u180f\u200b-\u200f\u202a-\u202e\u2060-\u206f\u3164\ufe00-\ufe0f\ufeff\uffa0\ufff9-\ufffb"
ACCENTS = "\u0300-\u034e\u0350-\u036f\u1ab0-\u1aff\u1dc0-\u1dff\u20d0-\u20ff\ufe20-\ufe2f"
STYLED = "\u0132\u0133\u013f\u0140\u0149\u01c4-\u01cc\u01f1-\u01f3\u2070\u2071\u2074-\u2079\u207f-\u2089\u2090-\u209c\u2102\u210a-\u2113\u2115\u2119-\u211d\u2124\u2128\u212a-\u212d\u212f-\u2134\u2139\u2160-\u217f\u2460-\u24ff\ufb00-\ufb06\ufb13-\ufb17\ufb1d-\ufb4f\ufb50-\ufdff\ufe70-\ufefc\uff10-\uff19\uff21-\uff3a\uff41-\uff5a\uff66-\uff9f\uffa1-\uffdc\U0001d400-\U0001d7ff\U0001f130-\U0001f149\U0001f150-\U0001f169\U0001f170-\U0001f189\U0001fbf0-\U0001fbf9"
_LATIN, _GREEK, _CYRILLIC = (re.compile(f"[{x}]") for x in ("A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f\u1e00-\u1eff", "\u0370-\u0373\u0376\u0377\u0386\u0388-\u03ff\u1f00-\u1ffe", "\u0400-\u0481\u048a-\u052f\u1c80-\u1c8a\ua640-\ua66d\ua680-\ua69b"))
_BAD = re.compile(f"[{INVISIBLE}{ACCENTS}{STYLED}]")
_INVISIBLE = re.compile(f"[{INVISIBLE}]")
_SPACES = re.compile(f"[{SPACES}]")
_ODD = re.compile(f"[{SPACES}{INVISIBLE}{ACCENTS}{STYLED}]")
TOKEN = re.compile(rf"[\w{INVISIBLE}{ACCENTS}{STYLED}]+")

#: Letters of two scripts side by side: whether a text can hold a mixed word at all.
_EASTERN = re.compile("[\u0370-\u03ff\u0400-\u052f\u1c80-\u1c8a\u1f00-\u1ffe\ua640-\ua69b]")
_NEXT_TO = re.compile("[A-Za-z\u00c0-\u024f\u1e00-\u1eff]\\d*[\u0370-\u052f]|[\u0370-\u052f]\\d*[A-Za-z\u00c0-\u024f\u1e00-\u1eff]|[\u0370-\u03ff]\\d*[\u0400-\u052f]|[\u0400-\u052f]\\d*[\u0370-\u03ff]|[\u1c80-\u1c8a\u1f00-\u1ffe\ua640-\ua69b]")


def scripts(token: str) -> int:
    """How many of Latin, Greek and Cyrillic a token has."""
    return sum(bool(p.search(token)) for p in (_LATIN, _GREEK, _CYRILLIC))


def is_dirty(token: str) -> bool:
    return bool(_BAD.search(token)) or (not token.isascii() and scripts(token) > 1)


@lru_cache(1 << 16)
def by_table(token: str) -> str:
    """Compatibility forms folded, accents composed, invisible characters dropped, look-alikes put into the token's main script."""
    t = U.normalize("NFC", U.normalize("NFKC", _INVISIBLE.sub("", token)))
    if t.isascii() or scripts(t) < 2:
        return t
    own = [sum(bool(p.match(c)) and c not in LOOK_ALIKES and c not in _TO_CYRILLIC for c in t) for p in (_LATIN, _GREEK, _CYRILLIC)]
    if own[2] > own[0] or (own[2] == own[0] and sum(bool(_CYRILLIC.match(c)) for c in t) > sum(bool(_LATIN.match(c)) for c in t)):
        return "".join(_TO_CYRILLIC.get(LOOK_ALIKES.get(c, c), c) if not _CYRILLIC.match(c) else c for c in t)
    return "".join(LOOK_ALIKES.get(c, c) for c in t)


# н and в are small capitals that look like Latin capitals only: no Latin small letter is taken for them
_TO_CYRILLIC = {v: k for k, v in LOOK_ALIKES.items() if _CYRILLIC.match(k) and k not in "ԁԛԝһѕјѴѵЅЈнв"}


def skeleton(token: str) -> str:
    """The class of a token under zero-cost edits."""
    return "".join(LOOK_ALIKES.get(c, c) for c in U.normalize("NFC", U.normalize("NFKC", _INVISIBLE.sub("", token))))


def is_suspect(text: str) -> bool:
    """Whether a text can hold a dirty token; cheap, and never false for one that does."""
    return not text.isascii() and bool(_BAD.search(text) or (_EASTERN.search(text) and _NEXT_TO.search(text)))


def normalize_text(text: str) -> str:
    """The consistent form of a text by table alone."""
    if text.isascii() or not (_ODD.search(text) or (_EASTERN.search(text) and _NEXT_TO.search(text))):
        return text
    text = _SPACES.sub(" ", text)
    return TOKEN.sub(lambda m: by_table(m[0]) if is_dirty(m[0]) else m[0], text) if is_suspect(text) else text


#: Steps of the automaton that are not plain.
LOOK_ALIKE, IGNORABLE, STYLE, ACCENT, FOREIGN = "look-alike", "ignorable", "styled", "accent", "foreign letter"
_STYLE = re.compile(f"[{STYLED}]")
_ACCENT = re.compile(f"[{ACCENTS}]")
_SCRIPT_OF = (_LATIN, _GREEK, _CYRILLIC)


def script_of(c: str) -> int:
    """0, 1, 2 for a Latin, Greek or Cyrillic letter, else -1."""
    return next((i for i, p in enumerate(_SCRIPT_OF) if p.match(c)), -1)


def units(token: str) -> tuple[list[tuple[str, str]], frozenset[str]]:
    """What the automaton reads: (letter, kind of step) of a token, and the kinds that were not plain.

    Styled forms are read as what they stand for, accents with the letter before them, and ignorables not at all. A
    letter that is not of the token's main script is a look-alike, or foreign where it looks like no letter of that."""
    steps, kinds = [], set()
    for c in token:
        if _INVISIBLE.match(c):
            kinds.add(IGNORABLE)
            continue
        k = ACCENT if _ACCENT.match(c) else STYLE if _STYLE.match(c) else ""
        if k:
            kinds.add(k)
        for x in U.normalize("NFKC", c) if k == STYLE else c:
            both = U.normalize("NFC", steps[-1][0] + x) if steps and U.combining(x) else ""
            if len(both) == 1:
                steps[-1] = (both, k or steps[-1][1])
            else:
                steps.append((x, k))
    if not token.isascii():
        seen = [script_of(c) for c, _ in steps]
        own = {s for s in seen if s >= 0}
        if len(own) > 1:
            # the script of the letters that look like no others; of equals the more frequent one
            main = max(own, key=lambda i: (sum(s == i and c not in LOOK_ALIKES and c not in _TO_CYRILLIC for s, (c, _) in zip(seen, steps)), seen.count(i)))
            for n, (s, (c, k)) in enumerate(zip(seen, steps)):
                if s >= 0 and s != main:
                    plain = LOOK_ALIKES.get(c, c)
                    known = _TO_CYRILLIC.get(plain, "") if main == 2 else plain
                    k = LOOK_ALIKE if known and script_of(known) == main else FOREIGN
                    kinds.add(k)
                    steps[n] = (c, k)
    return steps, frozenset(kinds)


def patterns(token: str) -> list[str]:
    """The skeleton of a token, and with each of its foreign letters for any letter."""
    steps, kinds = units(token)
    out = [skeleton(token)]
    if FOREIGN in kinds:
        plain = [LOOK_ALIKES.get(c, c) for c, _ in steps]
        out += ["".join([*plain[:n], "*", *plain[n + 1 :]]) for n, (_, k) in enumerate(steps) if k == FOREIGN]
    return out


class Trie:
    """Vocabulary trie walked by a weighted edit automaton."""

    def __init__(self) -> None:
        self.root: dict = {}

    def add(self, word: str, count: int) -> None:
        node = self.root
        for c in word:
            node = node.setdefault(c, {})
        node[""] = (count, word)

    def best(self, token: str, budget: int = 0) -> str | None:
        """The spelling of least cost, then of most occurrences, then the smallest."""
        return self.walk(token, budget)[0][2]

    def walk(self, token: str, budget: int = 0, foreign_only: bool = False) -> tuple[tuple[int, int, str | None], frozenset[str]]:
        """(cost, occurrences, spelling) of the best spelling, and the trace: the kinds of step by which the token was
        read. Edits cost 1, with ``foreign_only`` only those of foreign letters are tried."""
        steps, kinds = units(token)
        states, found = [(self.root, 0, 0)], []
        seen: dict[tuple[int, int], int] = {}
        while states:
            node, i, cost = states.pop()
            if seen.get((id(node), i), budget + 1) <= cost:
                continue
            seen[id(node), i] = cost
            if i == len(steps):
                if "" in node:
                    n, word = node[""]
                    found.append((cost, -n, word))
            else:
                c, kind = steps[i]
                proto = LOOK_ALIKES.get(c, c)
                free = not foreign_only or kind == FOREIGN
                if cost < budget and not foreign_only:
                    states.append((node, i + 1, cost + 1))
                for edge, child in node.items():
                    if edge:
                        if edge == c or LOOK_ALIKES.get(edge, edge) == proto:
                            states.append((child, i + 1, cost))
                        elif cost < budget and free:
                            states.append((child, i + 1, cost + 1))
            if cost < budget and not foreign_only:
                states += [(child, i, cost + 1) for edge, child in node.items() if edge]
        if not found:
            return (budget + 1, 0, None), kinds
        cost, n, word = min(found)
        return (cost, -n, word), kinds


def _fields(articles: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    return articles.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select(
        key, "x.*").where("value IS NOT NULL")


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One pass over the fields: dirty tokens and odd spaces by field, and the batch's clean words with their counts."""
    for pdf in batches:
        rows, words, name = [], Counter(), pdf.columns[0]
        for k, f, v in zip(pdf.iloc[:, 0], pdf["field"], pdf["value"]):
            tokens = TOKEN.findall(v)
            if is_suspect(v):
                dirty = {t for t in tokens if is_dirty(t)}
                rows += [(k, f, t, p, None) for t in dirty for p in patterns(t)]
                tokens = [t for t in tokens if t not in dirty]
            if not v.isascii() and _SPACES.search(v):
                rows.append((k, f, None, None, None))
            words.update(tokens)
        rows += [(None, None, w, skeleton(w), n) for w, n in words.items()]
        out = frame(rows, [name, "field", "token", "skeleton", "n"], {"n"} | ({name} if pdf[name].dtype.kind == "i" else set()))
        yield out


def scan(articles: DataFrame, key: str, fields: tuple[str, ...]) -> DataFrame:
    """(key, field, token, skeleton, n): dirty tokens and odd spaces (n null), and clean words (key null); written once."""
    kind = articles.schema[key].dataType.simpleString()
    return cut(_fields(articles, key, fields).mapInPandas(_scan, f"`{key}` {kind}, field string, token string, skeleton string, n long"))


#: Foreign letters of a token that may stand for any letter of a known spelling.
BUDGET = 1


def _resolve(key: tuple, tokens: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    trie = Trie()
    for w, n in zip(words["word"], words["n"]):
        trie.add(w, int(n))
    rows = []
    for t in tokens["token"]:
        (cost, n, hit), trace = trie.walk(t, BUDGET, foreign_only=True)
        rows.append((t, cost, n, by_table(t) if hit is None else hit, hit is not None, sorted(trace)))
    return pd.DataFrame(rows, columns=["token", "cost", "n", "canonical", "in_vocabulary", "trace"])


def token_forms(scanned: DataFrame, shards: int | None = None) -> DataFrame:
    """(token, canonical, in_vocabulary, trace) of each distinct token that is not plain."""
    tokens = scanned.where("n IS NULL AND token IS NOT NULL").select("token", "skeleton").distinct()
    words = scanned.where("n IS NOT NULL").groupBy("token", "skeleton").agg(F.sum("n").alias("n"))
    if tokens.where(F.contains("skeleton", F.lit("*"))).limit(1).count():
        at = F.explode(F.sequence(F.lit(1), F.length("skeleton")))
        masked = words.where("skeleton <> ''").withColumn("i", at).withColumn("skeleton", F.expr("concat(substring(skeleton, 1, i - 1), '*', substring(skeleton, i + 1))"))
        words = words.union(masked.select("token", "skeleton", "n"))
    n = shards or int(scanned.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    shard = F.pmod(F.xxhash64("skeleton"), F.lit(n)).alias("shard")
    words = words.join(tokens.select("skeleton").distinct(), "skeleton", "left_semi")
    words = words.select(F.col("token").alias("word"), "n", shard).distinct()
    found = tokens.select("token", shard).distinct().groupBy("shard").cogroup(words.groupBy("shard")).applyInPandas(
        _resolve, "token string, cost long, n long, canonical string, in_vocabulary boolean, trace array<string>")
    # a token of several shards: the least cost, then the most frequent spelling
    best = found.groupBy("token").agg(F.min(F.struct("cost", (-F.col("n")).alias("o"), "canonical", "in_vocabulary", "trace")).alias("x"))
    return best.select("token", "x.canonical", "x.in_vocabulary", "x.trace")


def disguised_fields(articles: DataFrame, key: str = "article_id", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """(key, field) of every field with a token that was not read by plain steps alone, or a space other than U+0020."""
    scanned = scan(articles, key, fields)
    changed = token_forms(scanned).where(F.size("trace") > 0)
    at = scanned.where("n IS NULL")
    by_token = at.where("token IS NOT NULL").join(changed, "token").select(key, "field")
    return by_token.union(at.where("token IS NULL").select(key, "field")).distinct()


def _replace(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        out = []
        for v, forms in zip(pdf["value"], pdf["forms"]):
            if v.isascii():
                out.append(v)
                continue
            own = {x["token"]: x["canonical"] for x in forms} if forms is not None else {}
            out.append(TOKEN.sub(lambda m: own.get(m[0], m[0]), _SPACES.sub(" ", v)))
        yield pd.DataFrame({pdf.columns[0]: pdf.iloc[:, 0], "field": pdf["field"], "value": out})


def canonical_fields(articles: DataFrame, key: str = "article_id", fields: tuple[str, ...] = ("title", "text")) -> DataFrame:
    """(key, field, value): the consistent form of every non-null field, each article once."""
    kind = articles.schema[key].dataType.simpleString()
    scanned = scan(articles, key, fields)
    at = scanned.where("n IS NULL AND token IS NOT NULL").select(key, "field", "token").distinct()
    own = at.join(token_forms(scanned).select("token", "canonical"), "token").groupBy(key, "field").agg(F.collect_list(F.struct("token", "canonical")).alias("forms"))
    whole = _fields(articles, key, fields).groupBy(key, "field").agg(F.max("value").alias("value"))
    return whole.join(own, [key, "field"], "left").mapInPandas(_replace, f"`{key}` {kind}, field string, value string")
