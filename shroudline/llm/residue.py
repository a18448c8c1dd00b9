"""Template residue, filler and error pages instead of content.

One automaton (Aho-Corasick) holds all that is looked for: phrases of error pages and script notices in several
languages, the words of filler texts, words of keys struck at random, values that were never filled in, and the openers
of template placeholders.  Every match is verified where it stands: phrases and words by their edges, an opener by the
placeholder it opens, filler words by the run they form.  A phrase covers itself; a placeholder or a run of filler covers
its sentence, as nothing of that sentence was meant to be read; technical remains (codes, paths, reference numbers) are
covered beside a phrase.  A text is residue when what is covered is at least COVERED (or SENTENCES) of its letters and digits.

Defined results: null and blank texts are content (nothing was matched); letter case does not matter for phrases; a
``[TYPE_n]`` token is never a placeholder; placeholders in texts that speak about templates cover nothing; repeated rows
are judged one by one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Share of a text's letters and digits that matches must cover; less is enough where whole sentences are residue, as a
#: heading above filler text is made up as well.
COVERED, SENTENCES = 0.6, 0.3

#: What error pages, script notices and filler say, by language.
PHRASES = """
404 not found|not found|page not found|error 404|the page you asked for does not exist|the page you requested could not be found|this page could not be found
the page you are looking for does not exist|403 forbidden|forbidden|401 unauthorized|access denied|you don't have permission to view this resource|you do not have permission to access
500 internal server error|internal server error|request id|502 bad gateway|bad gateway|503 service temporarily unavailable|503 service unavailable|service temporarily unavailable|service unavailable
please try again later|504 gateway timeout|gateway timeout|gateway time-out|upstream did not answer|upstream request timeout|this site can't be reached|this site can’t be reached
the connection was reset|the connection has timed out|connection refused|connection timed out|err_connection_reset|the requested url was rejected|your support id is|please consult with your administrator
session expired|your session has expired|reload the page to go on|please log in again|too many requests|slow down and retry in|rate limit exceeded|retry in|seconds
oops! something went wrong on our side|oops! something went wrong|something went wrong|an error occurred|an unexpected error occurred|an error has occurred|application error|a client-side exception has occurred
see the browser console for more information|unhandled exception|uncaught exception|uncaught typeerror|nullreference at|nullreferenceexception|at renderwidget|stack trace|traceback (most recent call last)|fatal error
warning: undefined variable|undefined variable|undefined index|undefined array key|on line|segmentation fault|syntax error|parse error|database connection failed|error establishing a database connection
checking your browser before you proceed|checking your browser before accessing|this takes a few seconds|this may take a few seconds|verifying you are human|please complete the security check|ddos protection by|reference
please enable javascript to continue using this application|please enable javascript to continue|please enable javascript|enable javascript and cookies to continue|you need to enable javascript to run this app
your browser does not support javascript, so this content cannot be shown|your browser does not support javascript|javascript is disabled|javascript is required|javascript required|this content cannot be shown
you need to turn on scripts in your browser to view this page|turn on scripts in your browser|to view this page|this page requires javascript|this site requires javascript|please turn javascript on
bitte aktivieren sie javascript, um diese seite anzuzeigen|bitte aktivieren sie javascript|javascript ist deaktiviert|um diese seite anzuzeigen|seite nicht gefunden|fehler 404|zugriff verweigert|interner serverfehler
dienst nicht verfügbar|javascript est désactivé|veuillez l'activer pour afficher la page|veuillez activer javascript|page introuvable|page non trouvée|erreur 404|accès refusé|erreur interne du serveur|service indisponible
active javascript en su navegador para continuar|active javascript|habilite javascript|javascript está desactivado|en su navegador para continuar|página no encontrada|error interno del servidor|acceso denegado|servicio no disponible
ative o javascript|página não encontrada|erro interno do servidor|acesso negado|включите javascript|пожалуйста, включите javascript|страница не найдена|ошибка 404|доступ запрещён|доступ запрещен|внутренняя ошибка сервера
कृपया इस पृष्ठ को देखने के लिए जावास्क्रिप्ट चालू करें|जावास्क्रिप्ट चालू करें|पृष्ठ नहीं मिला|javascriptを有効にしてください|ページが見つかりません|ページが見つかりませんでした|アクセスが拒否されました|请启用javascript|页面未找到
η σελίδα δεν βρέθηκε|ενεργοποιήστε τη javascript|todo write copy|todo: write copy|todo|tbd|to be determined|insert headline here|insert text here|insert title here|your text here|your title here|your headline here|title goes here
headline goes here|text goes here|description goes here|sample paragraph|sample text|replace me|placeholder description for this block|placeholder text|placeholder description|placeholder|add a short description of your|here
untitled block|untitled document|untitled section|untitled|enter text here|type your text here|click to add text|click to edit|edit this text|asdf|asdfasdf|qwerty|xxxxx|xxxx|xxx|test test|test|dummy text
null null|undefined undefined|undefined|null|nan|[object object]|nan items in your|nan items|undefined was saved|was saved|undefined items
""".strip().replace("\n", "|").split("|")
#: Phrases that are everyday words: they cover text, but never make it residue alone.
WEAK = {"here", "seconds", "request id", "reference", "on line", "to view this page", "please try again later", "was saved", "retry in", "this takes a few seconds", "forbidden", "not found", "test", "null", "nan", "placeholder", "untitled", "replace me", "reload the page to go on", "your support id is", "en su navegador para continuar", "um diese seite anzuzeigen", "qwerty", "this may take a few seconds", "please log in again", "xxx"}
#: Weak phrases that are residue when they are the whole text.
ALONE = {"test", "null", "nan", "placeholder", "untitled", "replace me", "not found", "forbidden", "qwerty", "xxx"}
#: Words of the usual filler text.
FILLER = set(
    "lorem ipsum dolor sit amet consectetur adipiscing adipisicing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation "
    "ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum".split()
)
_RARE = {w for w in FILLER if len(w) > 2} - {"est", "non", "sed", "duis", "sunt", "anim", "qui", "sint", "aute"}
#: Openers of placeholders and the pattern of the whole placeholder they open.
PLACEHOLDERS = {
    "{{": r"\{\{\s*[\w.\[\]'\"]+(?:\s*\|[^{}]*)?\s*\}\}",
    "{%": r"\{%-?\s*[^{}%]+?\s*-?%\}",
    "${": r"\$\{\s*[\w.]+\s*\}",
    "#{": r"#\{\s*[\w.]+\s*\}",
    "%(": r"%\([\w.]+\)[sdfr]",
    "[[": r"\[\[\s*[\w.]+\s*\]\]",
    "*|": r"\*\|[\w.:]+\|\*",
    "<%": r"<%[=-]?\s*[\w.()]+\s*%>",
    "__": r"(?<!\w)__[A-Z][A-Z0-9_.]*?__(?!\w)",
    "{": r"(?<![\w{$#%])\{(?:\d{1,2}|[a-z_][\w.]*)\}(?!\})",
    "%": r"(?<![\w%])%(?:\d+\$)?[sd](?!\w)",
    "<": r"<(?!(?:br|b|i|p|a|em|hr|li|ul|ol|h[1-6]|div|span|strong|code|img|table|tr|td)>)[a-z][a-z_.]*>",
}
#: Words of texts that speak about templates instead of being one.
TALK = re.compile(r"\b(?:templates?|format string|braces|brackets|placeholders?|syntax|interpolat\w+|to print a value|escape sequence|Vorlagen?|gabarits?|plantillas?)\b", re.I)
_TECH = re.compile(r"(?:/[\w.-]+)+|\$\w+|[\w-]+\.(?:js|php|py|ts|jsx|html?|aspx?)\b|#?\b(?=[0-9a-f]*\d)[0-9a-f]{6,}\b|\b\d+(?::\d+)*\b|\b[A-Z]\w*(?:Exception|Error)\b", re.I)
#: What a script prints for a value it does not have, as it is spelled; with a few words after it, that is the text.
UNFILLED = ("undefined", "NaN", "null", "[object Object]")
_VALUE = re.compile(r"\W*(?:undefined|NaN|null|\[object Object\])\W+\w+(?:\W+\w+){0,4}\W*")
#: Keys struck at random and the like, and the pattern of such a word.
STRUCK = ("asdf", "qwerty", "xx", "test", "bla", "foo", "bar", "aaa", "abc", "123")
_STRUCK = re.compile(r"\W*(?:(?:asdf|qwerty|xx+|test|bla|foo|bar|aaa+|abc|123)+\W*)+")
_WORD = re.compile(r"\w")
_LETTERS = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"[.!?\u3002\uff01\uff1f\u0964][\"'\u201d\u00bb)\]]*\s+|\n+")


@lru_cache(maxsize=1)
def automaton():
    import ahocorasick

    kinds: dict[str, list[tuple[str, str]]] = {}
    for word in _RARE:  # the everyday words among the filler are looked at only where rare ones stand
        kinds.setdefault(word, []).append(("filler", word))
    for word in STRUCK:
        kinds.setdefault(word, []).append(("struck", word))
    for word in UNFILLED:
        kinds.setdefault(word.lower(), []).append(("value", word))
    for opener in PLACEHOLDERS:
        kinds.setdefault(opener, []).append(("opener", opener))
    for phrase in PHRASES:
        kinds.setdefault(phrase, []).append(("phrase", phrase))
    found = ahocorasick.Automaton()
    for key, uses in kinds.items():
        found.add_word(key, (key, uses))
    found.make_automaton()
    return found


_PLACEHOLDER = {opener: re.compile(pattern) for opener, pattern in PLACEHOLDERS.items()}


def _edge(text: str, start: int, end: int) -> bool:
    """The match does not begin or end inside a word (scripts without word spaces have no such edges)."""
    before = start == 0 or not (text[start - 1].isalnum() and text[start].isalnum()) or ord(text[start]) > 0x2E80
    after = end == len(text) or not (text[end].isalnum() and text[end - 1].isalnum()) or ord(text[end - 1]) > 0x2E80
    return before and after


def _runs(low: str, places: list[tuple[int, int]]) -> Iterator[tuple[int, int]]:
    """Runs of four filler words one after the other, three of them no everyday words of a living language."""
    run: list[tuple[int, int]] = []
    for a, b in [*places, (len(low) + 2, len(low) + 2)]:
        if run and (a > len(low) or _LETTERS.search(low, run[-1][1], a)):
            if len(run) >= 4 and sum(low[x:y] in _RARE for x, y in run) >= 3:
                yield run[0][0], run[-1][1]
            run = []
        run.append((a, b))


def _sentence(text: str, start: int, end: int) -> tuple[int, int]:
    first = 0
    for m in _SENTENCE.finditer(text, 0, start):
        first = m.end()
    m = _SENTENCE.search(text, end)
    return first, m.start() + 1 if m else len(text)


def coverage(text: str) -> tuple[float, bool]:
    """(the share of the text's letters and digits that verified matches cover, whether whole sentences are)."""
    low = text.lower()
    if len(low) != len(text):  # a letter whose lower case is longer: positions would shift
        text = low
    covered = bytearray(len(low))
    strong = False
    filler, struck = 0, False
    talks, sentences = None, False

    def cover(a: int, b: int) -> None:
        covered[a:b] = b"\1" * (b - a)

    for last, (key, uses) in automaton().iter(low):
        start, end = last - len(key) + 1, last + 1
        for kind, what in uses:
            if kind == "opener":
                m = _PLACEHOLDER[what].match(text, start)
                if m is not None:
                    if talks is None:
                        talks = TALK.search(text) is not None
                    if not talks:
                        strong = sentences = True
                        cover(*_sentence(text, start, m.end()))
            elif kind == "struck":
                struck = True
            elif not _edge(low, start, end):
                continue
            elif kind == "phrase":
                strong |= what not in WEAK
                cover(start, end)
            elif kind == "filler":
                filler += 1
            elif not _WORD.search(text, 0, start) and _VALUE.fullmatch(text):
                strong = True
                cover(0, len(text))
    if talks:  # a text about templates may quote what it speaks of
        return 0.0, False
    for a, b in _runs(low, [m.span() for m in _LETTERS.finditer(low) if m.group() in FILLER]) if filler >= 3 else ():
        strong = sentences = True
        cover(_sentence(text, a, a)[0], _sentence(text, b, b)[1])
    if struck and _STRUCK.fullmatch(low):
        strong = True
        cover(0, len(low))
    if not any(covered) or not strong and low.strip(" .!:\n\t\xa0") not in ALONE:
        return 0.0, False
    for m in _TECH.finditer(text):
        cover(*m.span())
    total = matched = 0
    for i, ch in enumerate(low):
        if ch.isalnum() or not ch.isascii() and _WORD.match(ch):
            total += 1
            matched += covered[i]
    return matched / total if total else float(any(covered)), sentences


def residue(text: str | None) -> bool:
    """True if the text is template residue, filler, an error page or a script notice."""
    if not text or text.isspace():
        return False
    share, sentences = coverage(text)
    return share >= (SENTENCES if sentences else COVERED)


def flags(df: DataFrame, key: str, text: str) -> DataFrame:
    """(rec_id, residue) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, bool] = {}
        for batch in batches:
            out = []
            for t in batch.column(1).to_pylist():
                got = memo.get(t)
                if got is None:
                    got = residue(t)
                    if t is not None and len(t) < 64:
                        if len(memo) >= 100_000:
                            memo.clear()
                        memo[t] = got
                out.append(got)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.bool_())], names=["rec_id", "residue"])

    return df.select(F.col(key).cast("bigint").alias("rec_id"), F.col(text).alias("text")).mapInArrow(run, "rec_id bigint, residue boolean")


def page_meta_texts(bodies: DataFrame) -> DataFrame:
    """(entry_id, text): title and toasts of each readable body."""
    from shroudline.operators.shred import _unwrap, _whole_object, norm

    def field(holder: dict, name: str):
        for key, value in holder.items():
            if value is not None and norm(key) == name:
                return value
        return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = [], []
            for entry_id, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                top = _whole_object(body)
                meta = _unwrap(field(top, "pagemeta")) if top else None
                if isinstance(meta, list) and len(meta) == 1:
                    meta = meta[0]
                if not isinstance(meta, dict):
                    continue
                toasts = field(meta, "toasts")
                if isinstance(toasts, str) and toasts.lstrip()[:1] == "[":
                    toasts = _unwrap(toasts)
                for t in [field(meta, "title"), *(toasts if isinstance(toasts, list) else [toasts])]:
                    if isinstance(t, str):
                        ids.append(entry_id)
                        texts.append(t)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(texts, pa.string())], names=["entry_id", "text"])

    return bodies.where("entry_id is not null").select("entry_id", "body").mapInArrow(run, "entry_id bigint, text string")


def found(nodes: DataFrame, bodies: DataFrame) -> DataFrame:
    """(src_field, rec_id) of nodes and entries with residue."""
    of_nodes = flags(nodes.where("text is not null and node_pk is not null"), "node_pk", "text").where("residue").select(F.lit("node_text").alias("src_field"), "rec_id")
    of_meta = flags(page_meta_texts(bodies), "entry_id", "text").where("residue").select(F.lit("page_meta").alias("src_field"), "rec_id").distinct()
    return of_nodes.unionByName(of_meta)


def content(nodes: DataFrame) -> DataFrame:
    """The nodes without those whose text is residue."""
    marked = flags(nodes.where("text is not null"), "node_pk", "text").where("residue").select("rec_id")
    return nodes.join(marked, nodes["node_pk"] == marked["rec_id"], "left_anti")
