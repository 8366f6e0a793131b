"""One pass over articles for both template residue and near-duplicates: each text is read and cut into words once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.llm import near_duplicates, residue
from mentionloom.llm.canonical import normalize_text

_LONG, _LONGS = pa.int64(), pa.list_(pa.int64())
_TYPES = {"kind": pa.string(), "id": _LONG, "source": pa.string(), "text": pa.string(), "n": _LONG, "d1": _LONG, "d2": _LONG, "lines": _LONGS, "shingles": pa.binary()}
_SCHEMA = "kind string, id long, source string, text string, n long, d1 long, d2 long, lines array<long>, shingles binary"


def _batch(kind: str, **columns: list) -> pa.RecordBatch:
    """Rows of one kind; columns not given are null."""
    n = len(next(iter(columns.values())))
    columns["kind"] = [kind] * n
    return pa.RecordBatch.from_arrays([pa.array(columns[c], t) if c in columns else pa.nulls(n, t) for c, t in _TYPES.items()], list(_TYPES))


def scan(articles: DataFrame, width: int) -> DataFrame:
    """The rows of a residue scan, and (kind "sign") the signature of every article's title and text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = near_duplicates.Hasher()
        for b in batches:
            s, docs, (keys, sources, titles, texts) = residue.Scan(), [], (c.to_pylist() for c in b.columns)
            for k, source, title, text in zip(keys, sources, titles, texts):
                text = text or ""
                plain = normalize_text(text)
                words = near_duplicates.WORD.findall(plain.lower())
                # the terms of a residue scan are the same words with figures as 0, where nothing sets them apart
                same = plain is text and "_" not in text and (text.isascii() or not residue.has_han(text))
                terms = [w if w.isalpha() else residue.DIGITS.sub("0", w) for w in words] if same else None
                s.add(k, source, text, None, terms)
                docs.append(near_duplicates.words_of(title) + words if title else words)
            where = dict(zip(keys, sources))
            k, d1, d2, n, shingles = zip(*near_duplicates.signed(hasher, keys, docs, width)) if any(len(d) >= width for d in docs) else ((),) * 5
            yield _batch("sign", id=list(k), source=[where[x] for x in k], d1=list(d1), d2=list(d2), n=list(n), shingles=list(shingles))
            yield _batch("text", id=[x[0] for x in s.found], source=[x[1] for x in s.found], text=[x[2] for x in s.found])
            yield _batch("term", text=list(s.terms), n=list(s.terms.values()))
            yield _batch("docs", id=[x[0] for x in s.docs], source=[x[1] for x in s.docs], lines=[x[2] for x in s.docs])

    return articles.select(F.col("article_id").cast("long").alias("id"), F.coalesce("source_domain", F.lit("")).alias("source"), "title", "text").mapInArrow(run, _SCHEMA)
