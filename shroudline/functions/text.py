"""Scalar text functions as native columns: no Python in the row path."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as browsers define it (Java's \\s has ASCII only).
SPACE_CLASS = r"[\t\n\x0B\f\r \u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000\ufeff]"
#: Devanagari digits.
DEVANAGARI = "०१२३४५६७८९"
#: Cyrillic and Greek look-alikes and the Latin letters they stand for.
HOMOGLYPHS = "аеорсхуіѕјАВЕКМНОРСТХοΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
HOMOGLYPHS_TO = "aeopcxyisjABEKMHOPCTXoABEZHIKMNOPTYX"
#: Full-width forms mirror ASCII at a fixed distance; the ideographic space mirrors a space.
FULLWIDTH = "".join(map(chr, range(0xFF01, 0xFF5F))) + "\u3000"
FULLWIDTH_TO = "".join(map(chr, range(0x21, 0x7F))) + " "
#: Zero-width characters and directional controls.
ZERO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u180e"
BIDI = "\u202c\u202a\u202b\u202d\u2066\u2067\u2068\u2069"


def devanagari_digits(c: Column) -> Column:
    """Devanagari digits as ASCII digits; the length stays."""
    return F.translate(c, DEVANAGARI, "0123456789")


def fold_homoglyphs(c: Column) -> Column:
    return F.translate(c, HOMOGLYPHS, HOMOGLYPHS_TO)


def fold_fullwidth(c: Column) -> Column:
    return F.translate(c, FULLWIDTH, FULLWIDTH_TO)


def strip_zero_width(c: Column) -> Column:
    return F.translate(c, ZERO_WIDTH + BIDI, "")


def scan_form(c: Column) -> Column:
    """All foldings at once, without the reversal of right-to-left runs (that needs offsets)."""
    drop = ZERO_WIDTH + BIDI
    return F.translate(c, HOMOGLYPHS + DEVANAGARI + FULLWIDTH + drop, HOMOGLYPHS_TO + "0123456789" + FULLWIDTH_TO)


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, SPACE_CLASS + "+", " "))


def clean_text(c: Column, limit: int = 300) -> Column:
    """White space collapsed, trimmed, cut to the limit."""
    return F.left(collapse_spaces(c), F.lit(limit))


def visible_text(c: Column, limit: int = 300) -> Column:
    """Line breaks become a visible separator first."""
    return clean_text(F.regexp_replace(c, "\\n+", " · "), limit)


_SCHEME_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*"


def origin(url: Column) -> Column:
    """Scheme and host in lower case; empty where there is none."""
    return F.lower(F.regexp_extract(url, _SCHEME_HOST, 0))


def url_path(url: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(url, _SCHEME_HOST, ""), r"^[^?#]*", 0)


def safe_url(url: Column) -> Column:
    """Only the origin, with a mark that something follows; empty for what is no URL."""
    return F.when(origin(url) != "", F.concat(origin(url), F.lit("/…"))).otherwise("")


def normalize_url(url: Column) -> Column:
    """Without fragment and one trailing slash, scheme and host in lower case."""
    bare = F.regexp_extract(F.coalesce(url, F.lit("")), r"^[^#]*", 0)
    host = origin(bare)
    return F.regexp_replace(F.when(host != "", F.concat(host, F.regexp_replace(bare, _SCHEME_HOST, ""))).otherwise(bare), "/$", "")


def frame_url(url: Column) -> Column:
    """Origin and path."""
    return F.concat(origin(url), url_path(url))


def host_from_url(url: Column) -> Column:
    host = F.split_part(F.regexp_replace(F.coalesce(url, F.lit("")), "^https?://", ""), F.lit("/"), F.lit(1))
    return F.when(host == "", "unknown").otherwise(host)


def filename_part(c: Column, limit: int = 40) -> Column:
    kept = F.regexp_replace(F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), "[^a-zA-Z0-9_ -]", "")), " +", "_")
    cut = F.left(kept, F.lit(limit))
    return F.when(cut == "", "untitled").otherwise(cut)


def image_extension(url: Column) -> Column:
    found = F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?i)\.(jpg|jpeg|png|gif|webp|svg)(?:[?#]|$)", 1))
    return F.when(found == "", "jpg").otherwise(found)


def csv_cell(c: Column) -> Column:
    """Quoted only where a comma, quote or line break makes it necessary."""
    s = F.coalesce(c, F.lit(""))
    return F.when(s.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(s, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(s)


def escape_html(c: Column) -> Column:
    pairs = (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;"))
    return reduce(lambda x, p: F.replace(x, F.lit(p[0]), F.lit(p[1])), pairs, c)


def truncate(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.left(c, F.lit(limit)), F.lit("…"))).otherwise(c)


def _inline(safe: Column) -> Column:
    code = F.regexp_replace(safe, r"`([^`]+)`", "<code>$1</code>")
    link = F.regexp_replace(code, r"\[([^\]]*)\]\((https?://[^\s)]+)\)", '<a href="$2" target="_blank" rel="noopener noreferrer">$1</a>')
    bold = F.regexp_replace(link, r"\*\*([^*]+)\*\*", "<strong>$1</strong>")
    return F.regexp_replace(bold, r"\*([^*]+)\*", "<em>$1</em>")


def markdown_inline(c: Column) -> Column:
    """Inline markdown after escaping: code, http(s) links, bold, italic."""
    return _inline(escape_html(c))


def markdown(c: Column) -> Column:
    """Markdown with lists and paragraphs: lines of one kind in a row are one block, an empty line ends it."""
    lines = F.transform(F.split(escape_html(F.coalesce(c, F.lit(""))), "\\r?\\n"), lambda x: F.trim(F.regexp_replace(x, r"^\s+|\s+$", "")))
    kinds = F.transform(lines, lambda x: F.when(x == "", "").when(x.rlike(r"^[-*]\s+"), "ul").when(x.rlike(r"^\d+\.\s+"), "ol").otherwise("p"))
    closed = lambda k: F.when(F.coalesce(k, F.lit("")) == "", "").otherwise(F.concat(F.lit("</"), k, F.lit(">")))

    def piece(line: Column, i: Column) -> Column:
        kind, before = F.get(kinds, i), F.coalesce(F.get(kinds, i - 1), F.lit(""))
        item = F.concat(F.lit("<li>"), _inline(F.regexp_replace(line, r"^(?:[-*]|\d+\.)\s+", "")), F.lit("</li>"))
        body = F.when(kind == "", "").when(kind == "p", _inline(line)).otherwise(item)
        start = F.when(kind == before, F.when(kind == "p", "<br>").otherwise("")).otherwise(F.concat(closed(before), F.when(kind == "", "").otherwise(F.concat(F.lit("<"), kind, F.lit(">")))))
        return F.concat(start, body)

    return F.concat(F.array_join(F.transform(lines, piece), ""), closed(F.element_at(kinds, -1)))


def frame_target(c: Column) -> Column:
    """struct(frame_id, local_id) of an element's id: f3_n0001 lies in frame 3, others in the top page."""
    pattern = r"^f(\d+)_(.+)$"
    return F.struct(F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 1).cast("int")).otherwise(0).alias("frame_id"), F.when(c.rlike(pattern), F.regexp_extract(c, pattern, 2)).otherwise(c).alias("local_id"))


def target_count(prompt: Column) -> Column:
    """How many items a prompt asks to collect: at most 50, 0 if it asks for none."""
    top = F.regexp_extract(prompt, r"(?i)\btop\s+(\d{1,3})\b", 1)
    of = F.regexp_extract(prompt, r"(?i)\b(\d{1,3})\s+(?:posts|items|results|articles|tweets|links|stories)\b", 1)
    found = F.coalesce(F.nullif(top, F.lit("")), F.nullif(of, F.lit("")))
    return F.coalesce(F.least(F.lit(50), found.cast("int")), F.lit(0))


def json_from_prose(c: Column) -> Column:
    """The JSON value of a text, or of the widest braces in it; null if neither parses."""
    return F.coalesce(F.try_parse_json(c), F.try_parse_json(F.regexp_extract(c, r"(?s)\{.*\}", 0)))


def word_chunks(c: Column, words: int = 100) -> Column:
    """Number of chunks of at most that many words."""
    n = F.regexp_count(c, F.lit(r"\S+"))
    return F.ceil(n / words).cast("int")


def chunk_texts(c: Column, words: int = 100) -> Column:
    """array<struct<start,text>>: the text in chunks of at most that many words, each with its place; all between its words belongs to a chunk."""
    pieces = F.regexp_extract_all(c, F.lit(r"(\s*\S+)"), F.lit(1))
    ends = F.aggregate(pieces, F.array(F.lit(0)), lambda acc, p: F.concat(acc, F.array(F.element_at(acc, -1) + F.length(p).cast("int"))))
    count = F.ceil(F.size(pieces) / words).cast("int")
    one = lambda k: (F.array_join(F.slice(pieces, k * words + 1, F.lit(words)), ""), F.get(ends, k * words))

    def chunk(k: Column) -> Column:
        text, at = one(k)
        lead = F.length(text) - F.length(F.regexp_replace(text, r"^\s+", ""))
        return F.struct((at + lead).cast("int").alias("start"), F.regexp_replace(text, r"^\s+", "").alias("text"))

    return F.when(count > 0, F.transform(F.sequence(F.lit(0), F.greatest(count - 1, F.lit(0))), chunk)).otherwise(F.array().cast("array<struct<start:int,text:string>>"))


def rgb(c: Column) -> Column:
    """Red, green and blue of a CSS colour; null if it is none."""
    pattern = r"rgba?\(\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)"
    parts = F.array(*[F.regexp_extract(c, pattern, i).cast("int") for i in (1, 2, 3)])
    return F.when(c.rlike(pattern), parts)


def fnv1a(c: Column) -> Column:
    """FNV-1a over code points in 32 bits; fits in BIGINT."""
    codes = F.transform(F.filter(F.split(c, ""), lambda ch: ch != ""), lambda ch: F.ascii(ch).cast("bigint"))
    return F.aggregate(codes, F.lit(2166136261).cast("bigint"), lambda h, ch: (h.bitwiseXOR(ch) * 16777619).bitwiseAND(F.lit(0xFFFFFFFF)))
