"""Tolerant HTML scan: elements in document order with role, own text, address and form state."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that are looked at and the role each has without its own.
ROLES = {
    "a": "link", "button": "button", "input": "textbox", "textarea": "textbox", "select": "combobox", "img": "img", "h1": "heading", "h2": "heading", "h3": "heading", "h4": "heading",
    "li": "listitem", "p": "paragraph", "article": "article", "td": "cell", "th": "cell", "label": "label", "option": "option", "summary": "button",
}
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_SILENT = frozenset(("script", "style", "noscript", "template"))
#: Elements that end an open one of the same kind although it was never closed.
_ENDS = {"li": ("li",), "p": ("p",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tr": ("td", "th")}


def hidden(style: str, attrs: dict) -> bool:
    s = style.replace(" ", "").lower()
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or "display:none" in s or "visibility:hidden" in s or "opacity:0;" in s + ";" or "font-size:0" in s or "font-size:1px" in s


class Scan(HTMLParser):
    """Collects (pos, tag, role, text, href, value, interactive) of each element; text of hidden and silent parts is left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.found: list[dict] = []
        self.open: list[tuple[str, dict | None, bool]] = []  # tag, its record, hidden or silent

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        while self.open and self.open[-1][0] in _ENDS.get(tag, ()):
            self.open.pop()
        off = bool(self.open and self.open[-1][2]) or tag in _SILENT or hidden(a.get("style", ""), a)
        record = None
        role = a.get("role") or ROLES.get(tag)
        if role and not off and a.get("type") not in ("hidden", "file"):
            if tag == "input" and a.get("type") in ("checkbox", "radio", "submit", "button"):
                role = {"checkbox": "checkbox", "radio": "radio"}.get(a["type"], "button")
            record = {"pos": len(self.found), "tag": tag, "role": role, "text": a.get("alt", "") if tag == "img" else "", "href": a.get("href"), "value": a.get("value"), "interactive": role in ("link", "button", "textbox", "combobox", "checkbox", "radio")}
            self.found.append(record)
        if tag == "br" and self.open:
            self.handle_data(" · ")
        if tag not in _VOID:
            self.open.append((tag, record, off))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and self.open[-1][2]:
            return
        for _, record, _ in reversed(self.open):
            if record is not None:
                record["text"] += data
                return


def scan(html: str | None) -> list[dict]:
    """Elements of a page; broken markup never raises; elements without text that cannot be used are left out."""
    if not html:
        return []
    parser = Scan()
    parser.feed(html)
    parser.close()
    out = []
    for r in parser.found:
        r["text"] = " ".join(r["text"].split()).strip(" ·")
        if r["text"] or r["interactive"]:
            out.append(r)
    return out


_FIELDS = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("tag", pa.string()), ("role", pa.string()), ("text", pa.string()), ("href", pa.string()), ("value", pa.string()), ("interactive", pa.bool_())])


def html_nodes(pages: DataFrame, key: str, html: str) -> DataFrame:
    """One row per element of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, found = [], []
            for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                elements = scan(h)
                keys += [k] * len(elements)
                found += elements
            columns = [keys, *[[r[f.name] for r in found] for f in list(_FIELDS)[1:]]]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _FIELDS)], schema=_FIELDS)

    schema = "key bigint, pos int, tag string, role string, text string, href string, value string, interactive boolean"
    return pages.select(F.col(key).cast("bigint").alias("key"), F.col(html)).mapInArrow(run, schema).withColumnRenamed("key", key)


# text by blocks -------------------------------------------------------------------------------------------------------
#: Elements that stand on lines of their own, those whose text is never shown, and the longest block scanned
#: for its place on the screen.
BLOCKS = frozenset("address article aside blockquote body dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
SHOWN_NEVER = frozenset("script style noscript template option head title".split())
_CONTENT = re.compile(r"(?:([^{}]*?)::?(before|after)\s*\{[^{}]*?content\s*:\s*(\"[^\"]*\"|'[^']*')[^{}]*\})", re.I | re.S)


class Blocks(HTMLParser):
    """Visible text grouped by the nearest block around it, with the place of each piece; SVG texts are blocks of their own."""

    def __init__(self, line: str) -> None:
        super().__init__(convert_charrefs=True)
        self.line = line
        self.blocks: list[dict] = []
        self.open: list[tuple[str, int, bool]] = []  # tag, number of its block, hidden
        self.rules: list[tuple[str, str, str]] = []
        self.classes: list[tuple[str, set[str]]] = []
        self.style = False

    def _new(self) -> int:
        self.blocks.append({"text": "", "parts": [], "broken": False})
        return len(self.blocks) - 1

    def handle_starttag(self, tag: str, attrs) -> None:
        a = {k: v or "" for k, v in attrs}
        while self.open and (self.open[-1][0] in _ENDS.get(tag, ()) or self.open[-1][0] == "p" and tag in BLOCKS):
            self.open.pop()  # a block ends an open paragraph
        off = bool(self.open and self.open[-1][2]) or tag in SHOWN_NEVER or hidden(a.get("style", ""), a)
        if tag == "style":
            self.style = True
        if not off:
            self.classes.append((tag, set(a.get("class", "").split())))
        if tag == "br" and self.open:
            block = self.blocks[self.open[-1][1]]
            block["broken"] = bool(block["text"])
        if tag not in _VOID:
            own = tag in BLOCKS or tag == "text" or not self.open
            self.open.append((tag, self._new() if own else self.open[-1][1], off))

    def handle_endtag(self, tag: str) -> None:
        if tag == "style":
            self.style = False
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.style:
            self.rules += [(m[0].strip().split()[-1] if m[0].strip() else "*", m[1].lower(), m[2][1:-1]) for m in _CONTENT.findall(data)]
        if not data.strip() or self.open and self.open[-1][2]:
            return
        if not self.open:
            self.open.append(("", self._new(), False))
        block = self.blocks[self.open[-1][1]]
        if block["broken"]:
            block["text"] += self.line
            block["broken"] = False
        block["parts"].append(len(block["text"]))
        block["text"] += data

    def shown(self) -> list[tuple[str, str]]:
        """(text, before or after) of literal content that style rules put beside elements of the page."""
        out = []
        for selector, side, content in self.rules:
            tag, _, name = selector.partition(".")
            if content.strip() and any((tag in ("", "*", t)) and (not name or name in classes) for t, classes in self.classes):
                out.append((content, side))
        return out


def _blocks(html: str | None, line: str) -> Blocks | None:
    if not html:
        return None
    parser = Blocks(line)
    parser.feed(html)
    parser.close()
    return parser


def text_blocks(html: str | None) -> list[str]:
    """Own text of every block in order of the page, line breaks as a visible mark; shorter than two characters is no text."""
    parser = _blocks(html, " \u00b7 ")
    found = [" ".join(b["text"].split()) for b in parser.blocks] if parser else []
    return [t for t in found if len(t) >= 2]


def screen_blocks(html: str | None) -> list[dict]:
    """(text, parts, kind) of every block as it is, with the place of each text node in it, and of literal content put beside elements."""
    parser = _blocks(html, "\n")
    if parser is None:
        return []
    blocks = [{"text": b["text"], "parts": b["parts"], "kind": "text"} for b in parser.blocks if b["text"].strip()]
    return blocks + [{"text": t, "parts": [0], "kind": side} for t, side in parser.shown()]


_TEXTS = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("text", pa.string())])
_SCREEN = pa.schema([("key", pa.int64()), ("pos", pa.int32()), ("kind", pa.string()), ("text", pa.string()), ("parts", pa.list_(pa.int32()))])


def _scanned(pages: DataFrame, key: str, html: str, rows, arrow: pa.Schema, schema: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [{"key": k, "pos": i, **r} for k, h in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) for i, r in enumerate(rows(h))]
            yield pa.RecordBatch.from_pylist(out, schema=arrow)

    return pages.select(F.col(key).cast("bigint").alias("key"), F.col(html)).mapInArrow(run, schema).withColumnRenamed("key", key)


def block_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, text): the text blocks of every page."""
    return _scanned(pages, key, html, lambda h: [{"text": t} for t in text_blocks(h)], _TEXTS, "key bigint, pos int, text string")


def screen_rows(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, kind, text, parts): blocks as they stand on the screen, and content of pseudo-elements."""
    return _scanned(pages, key, html, screen_blocks, _SCREEN, "key bigint, pos int, kind string, text string, parts array<int>")
