"""Encoding with public tokenizers.

Byte-level BPE is encoded by prefix dynamic programming: every prefix of a piece of bytes has exactly one valid last
token, so storing that token for each prefix gives the encoding by walking back from the end, an append only adds
prefixes, and an edit recomputes the prefixes after it. A token may follow another if merging their joined bytes
would give the two tokens back; this is decided on the two merge trees alone.

Text is cut at white space into chunks whose encodings are independent of each other, and chunks seen before are
looked up (a cache only: it is emptied when full and never changes a result).

Defined results: null and empty texts have no ids; blank texts are encoded as they are; strings that spell a special
token are ordinary text; texts of any length are encoded whole; one row per row of the input.
"""

from __future__ import annotations

import base64
import os
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the vocabulary files.
TOKENIZER_DIR = os.environ.get("MENTIONLOOM_TOKENIZERS", "/opt/tokenizers")
WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_CHUNK = re.compile(f"[{WHITE}]*[^{WHITE}]+|[{WHITE}]+")
#: The public split pattern, its white space spelled out so that every engine reads it alike.
BYTE_PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{WHITE}\p{{L}}\p{{N}}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"
_CACHE = 1 << 20
_INF = 1 << 60


class Vocabulary:
    """Ranks of a byte-level BPE with what prefix dynamic programming needs of them."""

    def __init__(self, path: str) -> None:
        import ahocorasick

        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.token = {r: t for t, r in self.rank.items()}
        self.ends = ahocorasick.Automaton()
        for t, r in self.rank.items():
            self.ends.add_word(t.decode("latin-1"), (len(t), r))
        self.ends.make_automaton()
        self.longest = max(map(len, self.rank))
        self._parts: dict[int, tuple[int, int] | None] = {}
        self._valid: dict[tuple[int, int], bool] = {}

    def parts(self, r: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes ``r``; None for a single byte."""
        if r not in self._parts:
            t = self.token[r]
            if len(t) == 1:
                self._parts[r] = None
            else:
                seq = [t[i : i + 1] for i in range(len(t))]
                while len(seq) > 2:
                    best = min(range(len(seq) - 1), key=lambda i: self.rank.get(seq[i] + seq[i + 1], _INF))
                    if self.rank.get(seq[best] + seq[best + 1], _INF) >= r:
                        break
                    seq[best : best + 2] = [seq[best] + seq[best + 1]]
                self._parts[r] = (self.rank[seq[0]], self.rank[seq[1]]) if len(seq) == 2 else None
        return self._parts[r]

    def follows(self, a: int, b: int) -> bool:
        """Whether token ``b`` may stand after token ``a``: no merge across their border comes first."""
        key = (a, b)
        if (known := self._valid.get(key)) is not None:
            return known
        # r on the right spine of a, taken up at time p; l on the left spine of b, taken up at time q
        r, p, l, q, ok = a, _INF, b, _INF, True
        while True:
            m = self.rank.get(self.token[r] + self.token[l], _INF)
            if m < p and m <= q:
                ok = False
                break
            born_r = r if len(self.token[r]) > 1 else -1
            born_l = l if len(self.token[l]) > 1 else -1
            if born_r < 0 and born_l < 0:
                break
            if born_r > born_l:
                if (x := self.parts(r)) is None:
                    break
                r, p = x[1], born_r
            else:
                if (x := self.parts(l)) is None:
                    break
                l, q = x[0], born_l
        if len(self._valid) > _CACHE:
            self._valid.clear()
        self._valid[key] = ok
        return ok


class PrefixEncoder:
    """The last token of every prefix of one piece of bytes."""

    def __init__(self, vocabulary: Vocabulary, data: bytes = b"") -> None:
        self.v, self.data, self.last, self.computed = vocabulary, b"", [-1], 0
        self.append(data)

    def append(self, data: bytes) -> None:
        """Add bytes at the end; the prefixes before stay as they are."""
        start, self.data = len(self.data), self.data + data
        self._fill(start, len(self.data))

    def _fill(self, start: int, stop: int) -> None:
        """The last tokens of the prefixes longer than ``start`` and up to ``stop``; those before are there already."""
        last, follows = self.last, self.v.follows
        last += [-1] * (stop + 1 - len(last))
        self.computed += stop - start  # prefixes computed so far
        # matches that end in the new part may begin up to the longest token before it
        back = max(0, start - self.v.longest)
        for end, (n, r) in self.v.ends.iter(self.data[back:stop].decode("latin-1")):
            i = back + end + 1
            if i > start and last[i] < 0:
                j = i - n
                if j >= back and (j == 0 or (last[j] >= 0 and follows(last[j], r))):
                    last[i] = r

    def edit(self, begin: int, end: int, data: bytes) -> None:
        """Replace data[begin:end]. Prefixes are recomputed from ``begin`` on until as many of them in a row as the longest
        token has bytes end as they did before: a prefix' last token depends on no others, so the rest stays."""
        old, shift = self.last, len(data) - (end - begin)
        self.data, self.last = self.data[:begin] + data + self.data[end:], self.last[: begin + 1]
        at, same, step = begin, 0, self.v.longest
        first = begin + len(data) + 1  # the first prefix with bytes of the old tail
        while at < len(self.data):
            stop = min(len(self.data), at + step)
            self._fill(at, stop)
            for i in range(max(at + 1, first), stop + 1):
                same = same + 1 if self.last[i] == old[i - shift] else 0
                if same >= self.v.longest:
                    self.last = self.last[: i + 1] + old[i + 1 - shift :]
                    return
            at = stop

    def ids(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            r = self.last[i]
            out.append(r)
            i -= len(self.v.token[r])
        return out[::-1]


class ByteEncoder:
    """Ids of whole texts; pieces of the split pattern by prefix dynamic programming, chunks by cache."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> None:
        import regex

        self.v = Vocabulary(f"{folder}/{name}.tiktoken")
        self._find = regex.compile(BYTE_PATTERN).findall
        self._piece: dict[str, bytes] = {}
        self._chunk: dict[str, bytes] = {}

    def piece(self, piece: str) -> bytes:
        if (known := self._piece.get(piece)) is not None:
            return known
        raw = piece.encode("utf-8", "surrogatepass")
        r = self.v.rank.get(raw)
        out = np.array([r] if r is not None else PrefixEncoder(self.v, raw).ids(), "<i4").tobytes()
        if len(piece) <= 64:
            if len(self._piece) > _CACHE:
                self._piece.clear()
            self._piece[piece] = out
        return out

    def chunk(self, chunk: str) -> bytes:
        if (known := self._chunk.get(chunk)) is not None:
            return known
        out = b"".join(map(self.piece, self._find(chunk)))
        if len(chunk) <= 48:
            if len(self._chunk) > _CACHE:
                self._chunk.clear()
            self._chunk[chunk] = out
        return out

    def encode(self, text: str) -> bytes:
        """The ids of a text as little-endian 32-bit integers."""
        return b"".join(map(self.chunk, _CHUNK.findall(text)))

    def ids(self, text: str) -> list[int]:
        return np.frombuffer(self.encode(text), "<i4").tolist()


@lru_cache(8)
def encoder(name: str, folder: str) -> ByteEncoder:
    return ByteEncoder(name, folder)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, ids): one row per document, without a shuffle."""
    kind = documents.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(tokenizer, folder).encode
        for b in batches:
            found = [e(t) if t else b"" for t in b.column(1).to_pylist()]
            offsets = np.zeros(len(found) + 1, "<i4")
            np.cumsum([len(x) // 4 for x in found], out=offsets[1:])
            values = pa.array(np.frombuffer(b"".join(found), "<i4"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(offsets), values)], [key, "ids"])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind.simpleString()}, ids array<int>")


# -- sizes in the tokens of several tokenizers at once ---------------------------------------------------------------

NAMES = ("byte_bpe_50k", "byte_bpe_multi_50k", "word_bpe_49k", "piece_bpe_32k")
_BITS = 48
_SIGMA = str.maketrans({"Σ": "σ"})


class Counter:
    """Token counts of a text in the public tokenizers, summed over chunks; libraries count chunks not seen before."""

    def __init__(self, names: tuple[str, ...] = NAMES, folder: str = TOKENIZER_DIR) -> None:
        self.names = names
        self._count: list[Callable[[str], int]] = [self._counter(n, folder) for n in names]
        self._piece = names.index("piece_bpe_32k") if "piece_bpe_32k" in names else -1
        self._memo: dict[str, int] = {}
        self._first: dict[str, int] = {}

    def _counter(self, name: str, folder: str) -> Callable[[str], int]:
        if name.startswith("byte_bpe"):
            import tiktoken

            with open(f"{folder}/{name}.tiktoken", "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding(name, pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
            return lambda s: len(e.encode_ordinary(s))
        if name.startswith("piece"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_file=f"{folder}/{name}.model")
            self._sp = lambda s: len(sp.encode(s, num_threads=1))
            return lambda s: self._sp("\n" + s) - 2  # without the space that every text begins with
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        t = Tokenizer.from_file(f"{folder}/{name}.json")
        t.encode_special_tokens = True
        return lambda s: len(t.encode(s, add_special_tokens=False).ids)

    def _packed(self, chunk: str) -> int:
        if (known := self._memo.get(chunk)) is not None:
            return known
        out = 0
        for i, c in enumerate(self._count):
            out |= c(chunk) << (_BITS * i)
        if len(chunk) <= 48:
            if len(self._memo) > _CACHE:
                self._memo.clear()
            self._memo[chunk] = out
        return out

    def counts(self, text: str) -> list[int]:
        """The number of tokens in each tokenizer."""
        if not text:
            return [0] * len(self.names)
        chunks = _CHUNK.findall(text)
        if len(text) > 20 * len(chunks) or (self._piece >= 0 and "\r" in text):
            # scripts without spaces, or line ends that pieces may span: no chunks for those
            if len(text) > 20 * len(chunks):
                return [self._sp(text) if i == self._piece else c(text) for i, c in enumerate(self._count)]
        total = sum(map(self._packed, chunks))
        out = [(total >> (_BITS * i)) & ((1 << _BITS) - 1) for i in range(len(self.names))]
        if self._piece >= 0:
            if "\r" in text:
                out[self._piece] = self._lines(text)
            else:
                first = chunks[0]
                if first not in self._first:
                    if len(self._first) > _CACHE:
                        self._first.clear()
                    self._first[first] = self._sp(first) - self._count[self._piece](first)
                out[self._piece] += self._first[first]
        return out

    def _lines(self, text: str) -> int:
        """Pieces of a text with carriage returns: lines end at U+000A, which no piece holds, so they are independent."""
        lines = text.split("\n")
        return (self._sp(lines[0]) if lines[0] else 1) + sum(1 + (self._count[self._piece](x) if x else 0) for x in lines[1:])


@lru_cache(4)
def counter(names: tuple[str, ...], folder: str) -> Counter:
    return Counter(names, folder)


def token_counts(documents: DataFrame, names: tuple[str, ...] = NAMES, key: str = "doc_id", text: str = "text", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(key, one long column per tokenizer); null and empty texts count 0."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = counter(names, folder).counts
        for b in batches:
            found = np.array([c(t or "") for t in b.column(1).to_pylist()], "i8").reshape(b.num_rows, len(names))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(found[:, i].copy()) for i in range(len(names)))], [key, *names])

    return documents.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, " + ", ".join(f"`{n}` long" for n in names))
