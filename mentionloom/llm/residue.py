"""Template residue and error-page text.

Labelled exemplars of residue (errors, notices that scripts are needed, filler) are kept in an inverted index from
term to exemplar. For each passage window of a text - a line - the exemplars whose TF-IDF mass the window
contains are retrieved; the share of the window's own mass that they explain is its coverage. A text is residue
when its windows, apart from page lines and at most an opening paragraph, have high coverage, or when it holds an
unfilled placeholder. Document frequencies are counted over all texts; only texts that contain most of some
exemplar, a placeholder or one word over and over travel to the scoring.

Page lines are lines repeated over a source's articles, and short lines that are no statement (bylines, labels).

Defined results: null, empty and blank texts are no cases; repeated rows give one row; texts of any length are read
whole; a null source is a source of its own.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from operator import eq

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mentionloom.llm.frames import frame
from mentionloom.session import cut

# Labelled exemplars. "~" marks a weak one: it explains words but makes no text residue alone.
EXEMPLARS = {
    "error": """
404 Not Found|403 Forbidden|401 Unauthorized|400 Bad Request|500 Internal Server Error|Internal Server Error|502 Bad Gateway|503 Service Unavailable|503 Service Temporarily Unavailable|Service Unavailable|504 Gateway Timeout|Gateway time-out|Access denied|Too many requests|Request timed out|Connection refused|Connection timed out|Database connection failed|Error establishing a database connection|Your session has expired|Page not found|Error 404: page not found|Oops! That page can't be found.|Something went wrong|An unexpected error occurred|Bad Gateway|The site is down for maintenance|This site can't be reached
The page you asked for may have moved or no longer exists.|The page you are looking for does not exist.|The server could not complete your request.|Upstream host did not answer in 515 ms.|~Please try again in a few minutes.|~Please try again later.|~Go back to the home page or try a search.|~Reference #1.2|~Request ID: 1|~nginx/1.2|~Apache Server at port|Traceback: KeyError 'article_1'|Traceback (most recent call last)|Fatal error: uncaught exception|~Error code
Fehler 404 – Seite nicht gefunden|Seite nicht gefunden|Zugriff verweigert|Interner Serverfehler|Dienst nicht verfügbar|Ihre Sitzung ist abgelaufen|Die gesuchte Seite existiert nicht mehr.|Zu viele Anfragen|~Bitte versuchen Sie es später erneut.|~Zurück zur Startseite|Datenbankverbindung fehlgeschlagen|Diese Website ist nicht erreichbar|Zeitüberschreitung der Anfrage|~Referenz 1
Accès refusé|Service indisponible|Page introuvable|Erreur 404 : page introuvable|Erreur interne du serveur|La page demandée n'existe plus.|Votre session a expiré|Trop de requêtes|~Veuillez réessayer plus tard.|~Retour à l'accueil|~Référence 1|Délai d'attente dépassé|Ce site est inaccessible
Acceso denegado|Servicio no disponible|Página no encontrada|Error 404: página no encontrada|Error interno del servidor|La página solicitada ya no existe.|Su sesión ha caducado|Demasiadas solicitudes|~Vuelva a intentarlo más tarde.|~Volver a la portada|~Referencia 1|Tiempo de espera agotado|No se puede acceder a este sitio
Страница не найдена|Доступ запрещён|Ошибка 404: страница не найдена|Внутренняя ошибка сервера|Сервис временно недоступен|Запрошенная страница больше не существует|Сессия истекла|Слишком много запросов|~Попробуйте позже|~Вернуться на главную
页面不存在|找不到页面|访问被拒绝|服务器内部错误|服务不可用|会话已过期|~请稍后再试|~返回首页""",
    "scripts": """
Please enable JavaScript to view this page.|You need to enable JavaScript to run this app.|JavaScript is disabled in your browser.|JavaScript is required|This website requires scripts to be turned on.|Scripts are disabled in your browser.|Checking your browser before you go on...|Checking your browser before accessing|Your browser does not support JavaScript|~Turn it on in your settings and reload.|~Then refresh this page.|~If you use a blocker, add to its list.|~Need help?|~See the support pages of|~Code 1.|Please enable cookies to continue|Verify you are human|We have detected that scripts are blocked.
Bitte aktivieren Sie JavaScript, um diese Seite zu sehen.|Für diese Anwendung werden Skripte benötigt.|JavaScript ist in Ihrem Browser deaktiviert.|Diese Website benötigt JavaScript.|~Danach laden Sie die Seite neu.|Ihr Browser wird überprüft|Wir haben festgestellt, dass Skripte blockiert sind.
Les scripts sont désactivés dans votre navigateur.|Veuillez activer JavaScript pour afficher cette page.|Ce site nécessite JavaScript.|Cette application a besoin de scripts.|~Rechargez ensuite la page.|~Code 1.|Vérification de votre navigateur|Nous avons détecté que les scripts sont bloqués.
Active JavaScript para ver esta página.|Este sitio necesita que los scripts estén permitidos.|JavaScript está desactivado en su navegador.|Esta aplicación requiere scripts.|~Después recargue la página.|~Código 1.|Comprobando su navegador|Hemos detectado que los scripts están bloqueados.
Включите JavaScript, чтобы просмотреть страницу.|В вашем браузере отключён JavaScript.|Для работы сайта нужны скрипты.|~Затем обновите страницу.|~Код 1.
请启用JavaScript以查看此页面|您的浏览器已禁用脚本|本网站需要启用脚本|~然后刷新页面""",
    "filler": """
Your summary here.|Test test test.|Insert a second sentence here.|This is a sample paragraph.|Headline goes here.|Replace this text with your own.|Dummy entry, do not publish.|Caption placeholder.|Body copy goes here.|Sample text|Placeholder text|Lorem ipsum dolor sit amet|Your text here|Insert headline here|Type your text here|Subheading goes here|Intro text to come
Blindtext, bitte ersetzen.|Hier steht der Text.|Mustertext für den Artikel.|Überschrift hier einfügen.|Nur ein Test, nicht veröffentlichen.|Platzhaltertext|Testeintrag, nicht veröffentlichen|Testeintrag, nicht freigeben.|Vorspann hier einfügen|Beispielabsatz
Texte à remplacer.|Paragraphe d'essai.|Insérer le titre ici.|Ne pas publier, test.|Votre chapeau ici.|Texte d'exemple|Texte de remplissage|Le texte vient ici.|Légende à compléter
Texto de relleno.|Inserte el titular aquí.|Prueba, no publicar.|Escriba aquí el cuerpo.|Párrafo de muestra.|Texto de ejemplo|Sustituya este texto.|Su resumen aquí.|Pie de foto pendiente
Текст для замены.|Вставьте заголовок сюда.|Тест, не публиковать.|Пример абзаца.|Здесь будет текст|Текст-заполнитель
此处为示例文字|请替换此文本|测试内容请勿发布|在此插入标题""",
}
#: Words of pseudo-Latin filler, one exemplar that is contained by degrees.
FILLER_WORDS = frozenset("lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum aliquo arcanis candor fugia ligna mapis metor nostril orbita pelum praem quorum sedum sentum tempora velunt vexum".split())
#: Unfilled placeholders of the usual template languages.
_NAME = r"[A-Za-z_][\w.\-]*(?:\[\d+\])?(?:\.[\w\[\]]+)*"
PLACEHOLDER = re.compile(
    rf"\{{\{{[^{{}}\n]{{1,60}}\}}\}}|[$#]?\{{\s?{_NAME}\s?\}}|\[\[\s?{_NAME}\s?\]\]|<<\s?{_NAME}\s?>>|<%[^%\n]{{1,60}}%>|\{{%[^%\n]{{1,60}}%\}}"
    rf"|@@{_NAME}@@|\b__[A-Z][A-Z0-9_.]*__|(?<![\w%])%{_NAME}%(?!\w)|\${{0}}(?<!\w)\$[A-Z][A-Z0-9_.]*\$|\[[^\[\]\n]{{1,40}} to come\]|\[INSERT [^\]\n]{{1,40}}\]|\bTK \S+ TK\b|##{_NAME}##|\*\|{_NAME}\|\*")  # fmt: skip
_HINTS = ("{", "[[", "[INSERT ", " to come]", "<<", "<%", "@@", "__", "##", "*|", "TK ")
_SIGN = re.compile(r"[$%][A-Za-z_]")
_WORD = re.compile(r"[^\W_]+")
DIGITS = re.compile(r"\d+")
_CJK = re.compile("[㐀-鿿]+")
#: Quotation marks, and for each the opening marks it ends.
_MARK = re.compile("[\"“”„«»]")
_ENDS = {'"': '"„', "”": "“„", "“": "„", "»": "«", "«": "»", "„": ""}

#: Share of an exemplar's mass that retrieves it, and coverage that makes a window, and a text, residue.
CONTAINED, COVERED, WHOLE = 0.8, 0.6, 0.85
LABEL_WORDS = 9


def folded(text: str) -> str:
    """Lower case, figures as 0."""
    return DIGITS.sub("0", text.lower())


def has_han(text: str) -> bool:
    return bool(_CJK.search(text))


def terms_of(folded_text: str) -> list[str]:
    """Words of a folded text, Han text as pairs of characters."""
    out = _WORD.findall(folded_text)
    if not folded_text.isascii() and _CJK.search(folded_text):
        out = [x for w in out for x in ([w[i : i + 2] for i in range(len(w) - 1)] if _CJK.match(w) else [w])]
    return out


def terms(text: str) -> list[str]:
    """Lower-cased words, numbers as 0, Han text as pairs of characters."""
    return terms_of(folded(text))


@lru_cache(1)
def index() -> tuple[list[tuple[str, bool, frozenset[str]]], dict[str, list[int]]]:
    """The exemplars (kind, weak, terms) and the inverted index from term to exemplar."""
    rows, at = [], defaultdict(list)
    for kind, block in EXEMPLARS.items():
        for e in re.split(r"[|\n]", block.strip()):
            rows.append((kind, e.startswith("~"), frozenset(terms(e.lstrip("~")))))
            for t in rows[-1][2]:
                at[t].append(len(rows) - 1)
    return rows, dict(at)


def _quoted(text: str, at: int) -> bool:
    """Whether a quotation that begins on the line of ``at`` is still open there."""
    begun: list[str] = []
    for m in _MARK.finditer(text, text.rfind("\n", 0, at) + 1, at):
        c, k = m[0], m.start()
        ended = [i for i, x in enumerate(begun) if x in _ENDS[c]]
        before, after = text[k - 1 : k].strip(), text[k + 1 : k + 2].strip()
        if ended:
            del begun[ended[-1] :]
        elif c != "”" and (after or (not before and c != "»")):  # else the end of something begun before the line, or an inch
            begun.append(c)
    return bool(begun)


def has_placeholder(text: str) -> bool:
    """An unfilled placeholder that is not inside a quotation."""
    hinted = any(h in text for h in _HINTS) or (("$" in text or "%" in text) and _SIGN.search(text))
    return bool(hinted) and any(not _quoted(text, m.start()) for m in PLACEHOLDER.finditer(text))


def repeats(words: list[str]) -> bool:
    """One word, or two in turn, over and over."""
    return len(words) >= 4 and len(set(words)) <= max(1, min(2, len(words) // 4))


def retrieved(own: set[str]) -> tuple[list[int], frozenset[str]]:
    """The exemplars that a window retrieves by number of terms - most of all its terms, and of its rare ones - and their
    terms. None, if no strong one is among them or they are too small a part of the window."""
    rows, at = index()
    rare, need = anchors()
    hits, rare_hits = Counter(e for t in own & at.keys() for e in at[t]), Counter(e for t in own & rare.keys() for e in rare[t])
    full = [e for e, n in hits.items() if n >= 0.6 * len(rows[e][2]) and (rows[e][1] or rare_hits[e] >= need[e])]
    if not full:
        return [], frozenset()
    explained = frozenset().union(*(rows[e][2] for e in full))
    return (full, explained) if 4 * len(own & explained) >= len(own) else ([], frozenset())


def _touched(line: str) -> bool:
    """Whether a line retrieves a strong exemplar; what it does not retrieve, its coverage does not count either."""
    return any(not index()[0][e][1] for e in retrieved(set(terms(line)))[0])


@lru_cache(1)
def anchors() -> tuple[dict[str, list[int]], list[int]]:
    """The inverted index without terms of many exemplars, and how many of an exemplar's terms in it retrieve it."""
    rows, at = index()
    rare = {t: e for t, e in at.items() if len(e) <= 12}
    of = [len(r[2] & rare.keys()) for r in rows]
    lone = {e for e, n in enumerate(of) if not n}
    rare |= {t: [e for e in es if e in lone] for t, es in at.items() if t not in rare and lone.intersection(es)}
    need = [math.ceil(0.6 * (n or len(r[2]))) for r, n in zip(rows, of)]
    return {t: [e for e in es if not rows[e][1]] for t, es in rare.items() if any(not rows[e][1] for e in es)}, need


def is_candidate(text: str, words: list[str], own: set[str] | None = None) -> bool:
    """Whether a line retrieves an exemplar, or the text has much filler or a placeholder: never false for a case, since
    coverage counts exemplars retrieved by the same rule only. ``own``: its distinct words."""
    at, need = anchors()
    own = set(words) if own is None else own
    hits = Counter([e for t in at.keys() & own for e in at[t]])
    if any(n >= need[e] for e, n in hits.items()) and any(_touched(x) for x in text.split("\n")):
        return True
    if len(own & FILLER_WORDS) >= 3 or len(own) * 4 <= len(words) + 3:
        return True
    # the same word again at once, or two words in turn: only then can a line repeat itself
    again = b"\1\1" in bytes(map(eq, words, words[1:])) or b"\1\1\1" in bytes(map(eq, words, words[2:]))
    if again and any(repeats(terms(x)) for x in text.split("\n")):
        return True
    return has_placeholder(text)


def coverage(words: list[str], idf: dict[str, float], top: float) -> float:
    """Share of a window's TF-IDF mass explained by the exemplars it contains."""
    return window(words, idf, top)[0]


def window(words: list[str], idf: dict[str, float], top: float) -> tuple[float, bool]:
    """The coverage of a window, and whether more than weak exemplars make it."""
    if not words:
        return 0.0, False
    rows, at = index()
    own = set(words)
    weight = lambda t: idf.get(t, top)
    explained, strong = set(), False
    for e in retrieved(own)[0]:
        if sum(map(weight, own & rows[e][2])) >= CONTAINED * sum(map(weight, rows[e][2])):
            explained |= rows[e][2]
            strong = strong or not rows[e][1]
    filler = [t for t in words if t in FILLER_WORDS]
    if len(set(filler)) >= 3 and len(filler) >= 0.7 * len(words):
        explained |= FILLER_WORDS
        strong = True
    if repeats(words):
        return 1.0, True
    total = sum(map(weight, words))
    return (sum(weight(t) for t in words if t in explained) / total if total else 0.0), strong


def is_residue(text: str, page: set[int], idf: dict[str, float], top: float) -> bool:
    """The decision for one text; ``page`` has the numbers of its page lines."""
    if has_placeholder(text):
        return True
    windows, covered = [], False
    for i, line in enumerate(text.split("\n")):
        words = terms(line)
        if not words:
            continue
        if i in page:
            c, strong = window(words, idf, top)
            covered = covered or (strong and c >= COVERED)
            continue
        c, strong = window(words, idf, top)
        label = c < COVERED and len(words) <= LABEL_WORDS and not re.search(r"[.!?。！？…][\s”»\"')\]]*$", line)
        if not label:
            windows.append((len(line), c, strong))
    if not windows:
        return covered  # page lines alone: an error page may be the same in many articles
    for skip in (0, 1):  # at most an opening paragraph
        rest = windows[skip:]
        size = sum(n for n, *_ in rest)
        if size and sum(n for n, c, _ in rest if c >= COVERED) >= WHOLE * size and any(strong and c >= COVERED for _, c, strong in rest):
            return True
    return False


def _line_key(folded_line: str, of: int) -> int:
    """A line's key within its source, whose hash is ``of``."""
    return (xxhash.xxh64_intdigest(" ".join(folded_line.split())) ^ of) - (1 << 63)


class Scan:
    """What one pass over texts finds: candidates with their text, and of a batch every article's source and distinct lines
    and the document frequencies of the exemplars' terms."""

    def __init__(self) -> None:
        self.terms, self.docs, self.found = Counter(), [], []

    def add(self, key: object, source: str, text: str | None, low: str | None = None, words: list[str] | None = None) -> None:
        """``low`` and ``words`` are the folded text and its terms, where a caller has them."""
        if not text:
            self.docs.append((key, source, []))
            return
        low = folded(text) if low is None else low
        words = terms_of(low) if words is None else words
        own = set(words)
        self.terms.update(index()[1].keys() & own)
        of = xxhash.xxh64_intdigest(source)
        self.docs.append((key, source, list({_line_key(x, of) for x in low.split("\n") if x and not x.isspace()})))
        if is_candidate(text, words, own):
            self.found.append((key, source, text))

    def rows(self) -> Iterator[tuple]:
        """(kind, id, source, text, lines, n)."""
        yield from (("text", k, s, t, None, None) for k, s, t in self.found)
        yield from (("term", None, None, t, None, c) for t, c in self.terms.items())
        yield from (("docs", k, s, None, x, None) for k, s, x in self.docs)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        s = Scan()
        for row in zip(pdf.iloc[:, 0], pdf["source"], pdf["text"]):
            s.add(*row)
        yield frame(list(s.rows()), ["kind", "id", "source", "text", "lines", "n"], {"n"} | ({"id"} if pdf.iloc[:, 0].dtype.kind == "i" else set()))


def _numbered(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(k, s, i, _line_key(x, xxhash.xxh64_intdigest(s))) for k, s, t in zip(pdf["id"], pdf["source"], pdf["text"]) for i, x in enumerate(folded(t).split("\n")) if x and not x.isspace()]
        yield pd.DataFrame(rows, columns=["id", "source", "line_no", "line"])


def residue(articles: DataFrame, key: str = "article_id", source: str = "source_domain", text: str = "text") -> DataFrame:
    """(key): the documents to exclude, distinct."""
    kind = articles.schema[key].dataType.simpleString()
    scanned = articles.select(F.col(key).alias("id"), F.coalesce(source, F.lit("")).alias("source"), F.col(text).alias("text")).mapInPandas(
        _scan, f"kind string, id {kind}, source string, text string, lines array<long>, n long")
    return decide(cut(scanned), key)


def decide(scanned: DataFrame, key: str, min_articles: int = 4, min_share: float = 0.02) -> DataFrame:
    """The documents to exclude, from the rows of a scan."""
    kind = scanned.schema["id"].dataType.simpleString()
    texts = scanned.where("kind = 'text'").groupBy("id").agg(F.first("source").alias("source"), F.first("text").alias("text"))
    # document frequencies of the exemplars' own terms: bounded by the exemplars
    freq = {r["text"]: r["n"] for r in scanned.where("kind = 'term'").groupBy("text").agg(F.sum("n").alias("n")).collect()}
    rows = scanned.where("kind = 'docs'").select("source", F.struct("id").alias("article"), "lines")
    total = rows.count() or 1  # of rows, as the frequencies are
    docs = rows.groupBy("source").agg(F.count_distinct("article").alias("docs"))
    idf = {t: math.log((1 + total) / (1 + n)) for t, n in freq.items()}
    top = math.log(1 + total)
    own = texts.mapInPandas(_numbered, f"id {kind}, source string, line_no int, line long")
    wanted = own.select("line").distinct()
    counts = rows.select("article", F.explode("lines").alias("line")).join(wanted, "line", "left_semi").groupBy("line").agg(F.count_distinct("article").alias("n"))
    paged = own.join(counts, "line").join(docs, "source").where((F.col("n") >= min_articles) & (F.col("n") >= F.col("docs") * min_share))
    paged = paged.groupBy("id").agg(F.collect_set("line_no").alias("page"))

    def chosen(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [is_residue(t, set() if p is None else set(p), idf, top) for t, p in zip(pdf["text"], pdf["page"])]
            yield pdf.loc[keep, ["id"]].rename(columns={"id": key})

    return texts.join(paged, "id", "left").select("id", "text", "page").mapInPandas(chosen, f"`{key}` {kind}")
