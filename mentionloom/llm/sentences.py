"""Sentence units by cascading tables of break and no-break rules.

A rule is a pair of regular expressions, one for the text before a position and one for the text after it, and says
whether the position is a break. The table of a language is its own rules, then those of its script, then the common
ones; at each position the first rule that matches decides. Positions are looked at only after a closing mark with
its closing quotes and brackets (and, in Thai, at spaces between letters); line breaks always end a sentence.

The script of a text decides its table; among languages in Latin script the text's own function words do, the
``lang`` column only settling ties, since it may be missing or wrong.

Positions count code points, begin inclusive and end exclusive, without surrounding white space. Defined results:
null, empty and blank texts give no row; a text without any mark is one sentence per line; repeated rows give equal
rows; texts of any length are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE = r"[^\S\n]"
_END = ".!?…。！？．｡।॥؟۔"
_CLOSE = "\"'”’»›“‘)\\]」』）】》〉］"
_OPEN = "\"'“‘«‹„‚(\\[「『（【《〈［¿¡—–-"
_UP = r"(?:[A-ZÀ-ÖØ-ÞĀĂĄĆĈĊČĎĐĒĔĖĘĚĜĞĠĢĤĦĨĪĬĮİĴĶĹĻĽĿŁŃŅŇŌŎŐŒŔŖŘŚŜŞŠŢŤŦŨŪŬŮŰŲŴŶŸŹŻŽА-ЯЁ])"
_LOW = r"(?:[a-zß-öø-ÿāăąćĉċčďđēĕėęěĝğġģĥħĩīĭįıĵķĺļľŀłńņňōŏőœŕŗřśŝşšţťŧũūŭůűųŵŷźżžа-яё])"

#: Words whose full stop ends nothing when something of the statement follows. "any" stands before
#: anything, "number" before a figure, "name" before a capital; others end a sentence before a capital.
ABBREVIATIONS = {
    "en": {
        "any": "Mr Mrs Ms Messrs Dr Prof Gen Sen Rep Gov Lt Col Capt Cmdr Sgt Maj Adm Rev Hon Pres St Mt Ft vs approx cf viz incl esp e.g i.e al",
        "number": "No Nos Sec Art Fig p pp vol ch Jan Feb Mar Apr Jun Jul Aug Sep Sept Oct Nov Dec para ca",
    },
    "de": {
        "any": "Dr Prof Hr Fr Frl St bzw z.B d.h u.a o.ä i.d.R vgl ca ggf evtl sog inkl bspw z B d h Dipl Ing Mag Abg Gen Hrn Abs Art geb zzgl max min",
        "number": "Nr S Bd Kap Art Abs Ziff Tel Str Jan Feb Apr Aug Sept Okt Nov Dez",
    },
    "fr": {
        "any": "M MM Mme Mmes Mlle Dr Pr Me St Ste Mgr c.-à-d p.ex cf env av boul art ex",
        "number": "no n° p pp art vol chap janv févr avr juil sept oct nov déc",
    },
    "es": {
        "any": "Sr Sra Sres Srta Dr Dra Dres Prof Profa Ing Lic Gral Cap D Da Dña Ud Uds St Sto Sta p.ej ej aprox Excmo Av Avda EE OO UU RR cf vs",
        "number": "núm nº art pág págs p vol cap ene feb mar abr jun jul ago sept oct nov dic",
    },
    "ru": {
        "any": "г гг ул пл им т.е т.к т.н т е св проф акад доц ген тов гр см ср напр англ нем обл р-н просп пер корп стр",
        "number": "д руб коп тыс млн млрд рис табл с стр п пп гл ст № т кв",
    },
}
#: Verbs of reporting clauses that may follow a quotation after a name.
REPORTING = {
    "en": "said says asked asks wondered wonders shouted shouts cried cries replied replies added adds wrote told whispered called yelled answered exclaimed demanded insisted warned noted remarked",
    "de": "sagte fragte rief schrie antwortete meinte erklärte flüsterte",
    "fr": "dit demande demanda crie cria répond répondit ajoute ajouta",
    "es": "dijo preguntó gritó respondió añadió exclamó",
    "hi": "कहा पूछा बोला बोली बोले बताया चिल्लाया",
    "ar": "قال قالت سأل سألت صاح أضاف",
    "ru": "сказал сказала спросил спросила крикнул крикнула ответил ответила добавил добавила",
}


Rule = tuple[bool, "regex.Pattern | None", "re.Pattern | None"]


def _any(words: str) -> str:
    return "|".join(sorted((re.escape(w) for w in words.split()), key=len, reverse=True))


def _rule(is_break: bool, before: str, after: str) -> Rule:
    """Both sides are matched at the position itself, the one before it backward: as far as the rule goes, and no further."""
    return is_break, regex.compile(f"(?r)(?:{before})") if before else None, re.compile(after) if after else None


#: Rules of every script: quotations, dashes and whatever goes on in lower case belong to the same statement.
COMMON = [
    _rule(False, r"", rf"{SPACE}*[,;:]"),
    _rule(False, rf"[{_CLOSE}]", rf"{SPACE}*[—–]{SPACE}*(?!{_UP})"),
    _rule(False, r"[!?…]", rf"{SPACE}*[—–]{SPACE}*{_LOW}"),
    _rule(False, r"", rf"{SPACE}+[{_OPEN}]*{_LOW}"),
    _rule(True, r"", r""),
]


def _latin(lang: str) -> list[Rule]:
    a = ABBREVIATIONS[lang]
    out = [
        _rule(False, rf"(?:^|[\s{_OPEN}])(?:{_any(a['number'])})\.", rf"{SPACE}*[#№]?\d"),
        _rule(False, rf"(?:^|[\s{_OPEN}])(?:{_any(a['any'])})\.", rf"{SPACE}+\S"),
        # initials: a single capital before a name; letters with stops between them close a statement before a capital
        _rule(False, rf"(?:^|[\s{_OPEN}]){_UP}\.", rf"{SPACE}+{_UP}"),
        # a quotation and the clause that reports it, after a name
        _rule(False, rf"[!?…][{_CLOSE}]+", rf"{SPACE}+(?:{_UP}[\w'’.-]*{SPACE}+|(?:the|der|die|das|le|la|el){SPACE}+\w+{SPACE}+){{1,4}}(?:{_any(REPORTING[lang])})\b"),
        # dots of hesitation with a space before them, inside a statement
        _rule(False, rf"{SPACE}\.\.\.|{SPACE}…", rf"{SPACE}+{_LOW}"),
    ]
    if lang == "de":
        out.insert(0, _rule(False, rf"(?:^|[\s{_OPEN}])\d{{1,3}}\.", rf"{SPACE}+(?:{_UP}|{_LOW}|\d)"))  # ordinals, dates
    return out


TABLES: dict[str, list[Rule]] = {x: [*_latin(x), *COMMON] for x in ABBREVIATIONS}
TABLES["han"] = [
    # a clause before the quotation reports it, so the quotation ends the statement
    _rule(True, r"[:：][“「『‘][^“”「」『』‘’]*[」』”’]", r""),
    # what follows a closing quote without a space reports the quotation
    _rule(False, r"[」』”’]", r"[^\s“‘「『（(]"),
    _rule(False, r"\d\.|[A-Za-z]\.", rf"{SPACE}*[\w]"),
    *COMMON,
]
TABLES["thai"] = [
    _rule(False, r"(?:^|[\s(])[฀-๿]{1,4}\.(?:[฀-๿]{1,3}\.)*", rf"{SPACE}*[\w]"),
    *COMMON,
]
TABLES["arabic"] = [
    _rule(False, r"(?:^|\s)[\u0600-\u06ff]\.(?:[\u0600-\u06ff]\.)*", rf"{SPACE}*[\w]"),
    _rule(False, rf"[!?؟…][{_CLOSE}]+", rf"{SPACE}+(?:{_any(REPORTING['ar'])})\b"),
    *COMMON,
]
TABLES["devanagari"] = [
    _rule(False, r"(?:^|\s)(?:[\u0900-\u097f]{1,3}\.)+", rf"{SPACE}*[\w]"),
    _rule(False, rf"[!?।…][{_CLOSE}]+", rf"{SPACE}+(?:[^\s।!?]+{SPACE}+){{1,4}}(?:{_any(REPORTING['hi'])})(?=[\s।,])"),
    *COMMON,
]

#: A closing mark with its closers; in French a space may stand before a closing guillemet.
_MARK = re.compile(rf"[{_END}]+(?:{SPACE}?[»›]|[{_CLOSE}])*(?=\s|$)")
_CLOSE_HAN = _CLOSE.replace("“", "").replace("‘", "")
_MARK_HAN = re.compile(rf"[。！？｡]+[{_CLOSE_HAN}]*|[{_END}]+[{_CLOSE_HAN}]*(?=\s|$)")
_MARK_THAI = re.compile(rf"[{_END}]+[{_CLOSE}]*(?=\s|$)|(?<=[\u0e01-\u0e3a\u0e40-\u0e4e])(?=[^\S\n]+[\u0e01-\u0e3a\u0e40-\u0e4e])")
#: A number or bullet at the start of a line belongs to the heading or item it starts.
_ITEM = re.compile(rf"{SPACE}*(?:[-–—•*·▪‣]{SPACE}+)?(?:\(?\d{{1,3}}(?:\.\d{{1,3}})*[.)]|\(?[A-Za-z][.)]|[IVXLC]{{1,6}}[.)])(?={SPACE}+\S)")
_SCRIPTS = [("thai", re.compile("[฀-๿]")), ("han", re.compile("[぀-ヿ㐀-鿿]")), ("devanagari", re.compile("[ऀ-ॿ]")), ("arabic", re.compile("[؀-ۿ]")), ("ru", re.compile("[а-яА-ЯёЁ]")), ("latin", re.compile("[A-Za-zÀ-ɏ]"))]
_FUNCTION_WORDS = {"en": (" the ", " of ", " and ", " said "), "de": (" der ", " die ", " das ", " und "), "fr": (" le ", " les ", " et ", " des "), "es": (" el ", " los ", " y ", " del ")}


def table_of(text: str, lang: str | None) -> str:
    """The rule table of a text."""
    n = {name: len(p.findall(text)) for name, p in _SCRIPTS[:-1] if p.search(text)} if not text.isascii() else {}
    if n:
        n["latin"] = len(_SCRIPTS[-1][1].findall(text))
        best = max(n, key=lambda k: n[k] * (3 if k == "han" else 1))
        if best != "latin":
            return best
    score = {k: sum(map(text.count, words)) for k, words in _FUNCTION_WORDS.items()}
    top = max(score.values())
    winners = [k for k, v in score.items() if v == top]
    return winners[0] if len(winners) == 1 else lang if lang in winners else winners[0] if top else (lang if lang in ABBREVIATIONS else "en")


def _is_break(table: list, line: str, at: int) -> bool:
    for is_break, b, a in table:
        if (a is None or a.match(line, at)) and (b is None or b.match(line, 0, at)):
            return is_break
    return True


def spans(text: str, lang: str | None = None) -> list[tuple[int, int]]:
    """(begin, end) of every sentence of a text."""
    name = table_of(text, lang)
    table = TABLES[name]
    mark = _MARK_HAN if name == "han" else _MARK_THAI if name == "thai" else _MARK
    out, begin = [], 0
    for line in re.split(r"(?<=[\n\r\v\f\u0085  ])", text):
        end_of_line = begin + len(line)
        start, item = begin, _ITEM.match(line)
        for m in mark.finditer(line, item.end() if item else 0):
            at = begin + m.end()
            if m.end() < len(line.rstrip()) and _is_break(table, line, m.end()):
                _add(out, text, start, at)
                start = at
        _add(out, text, start, end_of_line)
        begin = end_of_line
    return out


def _add(out: list[tuple[int, int]], text: str, a: int, b: int) -> None:
    s = text[a:b]
    t = s.lstrip()
    if t:
        out.append((a + len(s) - len(t), a + len(s.rstrip())))


def split_sentences(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """(key, begin_char, end_char): one row per sentence, without a shuffle."""
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [spans(t, g) if t else [] for t, g in zip(b.column(1).to_pylist(), b.column(2).to_pylist())]
            flat = np.array([x for f in found for x in f], "i4").reshape(-1, 2)
            which = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(which), pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], [key, "begin_char", "end_char"])

    return documents.select(F.col(key), F.col(text), F.col(lang)).mapInArrow(run, f"`{key}` {kind}, begin_char int, end_char int")


@lru_cache(1)
def tables() -> dict[str, int]:
    """The number of rules in each table."""
    return {k: len(v) for k, v in TABLES.items()}
