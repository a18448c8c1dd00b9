"""Personal information in free text, found by bootstrapped contextual extraction and replaced by typed placeholders.

1. Seeds: mail addresses, telephone numbers and postal addresses are known by their shape, document numbers only where
   they are named as such (passport no., national ID, social security number); the parts of mail addresses and words
   after a title seed the names.
2. Every task counts edges between lexical patterns (the words around a candidate) and instances (a name's family part,
   a number's shape), each under its 64-bit digest.
3. Spark scores the graphs in rounds: a pattern is as sure as the share of its instances that are known, an instance as
   sure as the patterns that hold it.  High-confidence patterns bring in family names and the shapes of document numbers
   that no seed had: numbers that stand where named ones stand.
4. Spans are taken in order of kind (EMAIL, ADDRESS, ID, PHONE, NAME) and never overlap.

Defined results: null and blank texts hold nothing; placeholders such as ``[EMAIL_1]`` and handles are left alone; equal
values get one number in a text; everything outside the spans stays byte for byte; repeated rows are judged alike; items
that are no JSON object or have no text field give no rows.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.session import cut

KINDS = ("EMAIL", "ADDRESS", "ID", "PHONE", "NAME")
#: Trusted patterns and known names that may come to the driver and be broadcast, of each kind; more is an error, never a cut.
MOST_KNOWN = 1_000_000
ROUNDS = 3
#: Least share of known instances, and least number of different ones, that make a pattern trusted.
PATTERN_SHARE, PATTERN_DISTINCT = 0.8, 4
INSTANCE_SCORE = 0.5

_S = r"[\s ]"
EMAIL = re.compile(
    rf"(?<![\w@.])(?:mailto:)?[\w.+'-]+(?:@|{_S}@{_S}|＠)[\w-]+(?:\.[\w-]+)+"
    rf"|(?<![\w@.])[\w.+-]+{_S}*(?:\[at\]|\(at\)|\{{at\}}|<at>){_S}*[\w-]+(?:{_S}*(?:\.|\[dot\]|\(dot\)|\{{dot\}}){_S}*[\w-]+)+"
    rf"|(?<![\w@.])(?!(?:me|us|him|her|them|it|you|is|be|are|or|and|to|look|mail|email|write|reach)\b)[\w+-]+(?:{_S}+dot{_S}+[\w+-]+){{0,4}}{_S}+at{_S}+[\w-]+(?:{_S}+dot{_S}+[\w-]+)+",
    re.I,
)
#: Words for a street, by language, and what stands before a flat or house number.
_STREET = r"(?i:Lane|Ln|Street|St|Road|Rd|Avenue|Ave|Close|Crescent|Drive|Dr|Row|Way|Court|Ct|Place|Pl|Square|Sq|Terrace|Boulevard|Blvd|Gardens|Grove|Walk|Mews|Parade|Highway|Hwy)\b\.?"
_CITY = r"[A-ZÀ-ÞŁŚŻŠČ][\w'’-]+(?:[ -](?:sur|del?|am|an|la|le|[A-ZÀ-Þ])[\w'’-]*){0,3}"
ADDRESS = re.compile(
    rf"(?i:House{_S}+No\.?){_S}*\d+(?:/\d+)?[,.]?{_S}*\d+\w*{_S}+(?i:Cross|Main)[,.]?{_S}*[\w'’-]+{_S}+(?i:Nagar|Colony|Layout|Puram|Vihar|Marg)[,.]?{_S}*(?:[A-Za-z][\w'’-]+{_S}*,?{_S}*\d{{6}}|{_CITY})?"
    rf"|(?:(?i:Flat|Apt|Unit|Suite)\.?{_S}*\w+,{_S}*)?(?<![\w.,/-])\d{{1,5}}(?:[-/]\d+)?\w?{_S}+[A-ZÀ-Þ][\w'’-]+(?:{_S}+[A-ZÀ-Þ][\w'’-]+)?{_S}+{_STREET}(?:,?{_S}*(?i:Apt|Flat|Unit|Suite|\#)\.?{_S}*\w+)?(?:,?{_S}*{_CITY})?(?:,?{_S}*\d{{5,6}})?"
    rf"|(?:[A-ZÀ-Þ][\w-]+(?:straße|strasse|weg|gasse|platz|allee|ring|damm|ufer)|(?:Am|An der|Im|Zum|Zur){_S}+[A-ZÀ-Þ][\w-]+){_S}+\d+\w?,?{_S}*\d{{5}}{_S}+{_CITY}"
    rf"|(?<![\w.,/-])\d{{1,4}}(?:{_S}?(?:bis|ter))?,?{_S}+(?i:rue|allée|avenue|boulevard|place|chemin|impasse|quai|route|cours){_S}+[\w'’ -]{{2,40}}?,{_S}*\d{{5}}{_S}+{_CITY}"
    rf"|(?i:Calle|Avenida|Avda\.?|Plaza|Paseo|Camino|Rua|Ulica|ul\.){_S}+[\w'’ -]{{2,40}}?{_S}+\d+\w?,?{_S}*\d{{2}}-?\d{{3}}{_S}+{_CITY}",
)
#: Document numbers that are named as such: the seeds of all others.
ID = re.compile(
    r"(?i:passport(?:\s+(?:no\.?|number|nr\.?))?\s*[:#]?\s*)(?P<p>[A-Za-z]{1,2}\d{6,8})\b"
    r"|(?i:national\s+ID\s*[:#]?\s*)(?P<n>\d{6}-\d{4}-[A-Za-z])\b"
    r"|(?i:social\s+security\s+(?:number|no\.?)\s*[:#]?\s*|\bSSN\s*[:#]?\s*)(?P<s>\d{3}[\s\u00a0-]?\d{2}[\s\u00a0-]?\d{4})\b"
)
PHONE = re.compile(
    r"(?<![\w.+/-])(?:\+|00)\d{1,3}(?:[\s .-]{0,2}\(?\d{1,5}\)?){2,6}(?:\s*(?:ext\.?|x)\s*\d{1,5})?(?!\w)"
    r"|(?<![\w.+/-])\(\d{2,5}\)\s?\d{3,4}[-.\s ]\d{3,4}(?:\s*(?:ext\.?|x)\s*\d{1,5})?(?!\w)"
    r"|(?<![\w.+/-])\d{3}\.\d{3}\.\d{4}(?![\w.]\d)|(?<![\w.+/-])\d{3}-\d{3}-\d{4}(?![\w-])|(?<![\w.+/-])0\d{1,4}\s?/\s?\d{3,8}(?:[-\s]\d{1,5})?(?!\w)"
    r"|(?<![\w.+/-])0\d{2,4}[\s ]\d{3,4}[\s ]\d{3,4}(?!\w)|(?<![\w.+/-])0\d(?:[\s .]\d{2}){4}(?!\w)|(?<![\w.+/-])\d{3}[\s ]\d{3}[\s ]\d{4}(?!\w)"
)
#: Words before a number that say it is of goods, orders or books.
_GOODS = re.compile(r"(?i:order|isbn|batch|tracking(?:\s+code)?|case(?:\s+number)?|reference|request id|support id|sku|release|version|invoice no\.?|serial)\W{0,3}$")
TITLES = frozenset("mr mrs ms miss dr prof shri smt sir herr frau señor señora sr sra mme mlle madame monsieur don doña mx".split())
_HINDI = re.compile(r"(?:श्रीमती|श्री|सुश्री|डॉ\.?)\s+[ऀ-ॿ]+(?:\s+(?!(?:से|को|ने|का|की|के|है|हैं|और|पर|द्वारा)(?![ऀ-ॿ]))[ऀ-ॿ]+)?")
_TOKEN = re.compile(r"[^\W\d_](?:[\w'’-]*[^\W_])?\.?")
_HELD = re.compile(r"\[[A-Z]+_\d+\]")
_NUMBER = re.compile(r"(?<![\w.,+/#@-])[A-Za-z]{0,5}\d[\dA-Za-z]*(?:[ \u00a0/-]?\d[\dA-Za-z]*){0,4}(?:[/-][A-Za-z])?(?![\w-])(?!\.\d)")


def fold(word: str) -> str:
    """A name's word as mail addresses spell it."""
    if word.isascii():
        return word.lower().replace("-", "").replace("'", "").rstrip(".")
    flat = unicodedata.normalize("NFD", word.lower().replace("ø", "o").replace("ł", "l").replace("ß", "ss").replace("æ", "ae"))
    return "".join(c for c in flat if c.isalnum())


def _h(s: str) -> int:
    return int.from_bytes(blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _pattern(text: str, start: int, end: int) -> str:
    """The two words before and the word after a candidate."""
    before = re.findall(r"\w+|[^\w\s]", text[max(0, start - 30) : start])[-2:]
    after = re.findall(r"\w+|[^\w\s]", text[end : end + 16])[:1]
    return " ".join("0" if w.isdigit() else w for w in before) + " | " + "".join("0" if w.isdigit() else w for w in after)


def _shape(value: str) -> str:
    return re.sub(r"[A-Za-z]", "A", re.sub(r"\d", "9", re.sub(r"\s", " ", value)))


def _numbers(text: str) -> Iterator[tuple[int, int]]:
    """Places of numbers that may be a document's: four digits and eight letters or digits at least, not of goods or orders."""
    for m in _NUMBER.finditer(text):
        value = m.group(0)
        if sum(map(str.isalnum, value)) >= 8 and _digits(value) >= 4:
            yield m.span()


def _of_goods(text: str, start: int) -> bool:
    return _GOODS.search(text[max(0, start - 20) : start]) is not None


class Lexicon:
    """What the rounds have learned: digests of the known family names, given names, shapes of document numbers, and trusted patterns."""

    def __init__(self, family: frozenset[int], given: frozenset[int], name_patterns: frozenset[int], id_patterns: frozenset[int], id_shapes: frozenset[int] = frozenset()) -> None:
        self.family, self.given, self.name_patterns, self.id_patterns, self.id_shapes = family, given, name_patterns, id_patterns, id_shapes
        self.some_names, self.some_ids = bool(name_patterns), bool(id_shapes or id_patterns)
        self.memo: dict[str, int] = {}
        self.held: dict[str, bool] = {}

    def named(self, text: str) -> bool:
        """Some token of the text is a known name or a title; no token holds white space."""
        get = self.held.get
        for word in text.split():
            got = get(word)
            if got is None:
                if len(self.held) > 300_000:
                    self.held.clear()
                got = self.held[word] = any([self.flags(t) for t in _TOKEN.findall(word)])
            if got:
                return True
        return False

    def flags(self, word: str) -> int:
        """1: known family name, 2: known given name, 4: a title."""
        got = self.memo.get(word)
        if got is None:
            if len(self.memo) > 300_000:
                self.memo.clear()
            key = fold(word.strip(".,;:!?\"'“”«»()[]"))
            got = 0
            if len(key) > 2 and key.isalpha():
                at = _h(key)
                got = int(at in self.family) | 2 * int(at in self.given)
            if key in TITLES or word.rstrip(".").lower() in TITLES:
                got |= 4
            self.memo[word] = got
        return got


EMPTY = Lexicon(frozenset(), frozenset(), frozenset(), frozenset())


def _cap(word: str) -> bool:
    return word[0].isupper() and len(word.rstrip(".")) > 1


def _initial(word: str) -> bool:
    return len(word.rstrip(".")) == 1 and word[0].isupper()


_GAP = re.compile(r"[\s  .·_–-]{1,6}$")
_COMMA = re.compile(r"[\s ]*,[\s ]*$")


def _names(text: str, known: Lexicon) -> list[tuple[int, int]]:
    words = [(m.group(0), m.start(), m.end()) for m in _TOKEN.finditer(text)]
    n, i, out = len(words), 0, []
    flags = [known.flags(w) for w, _, _ in words]
    gap = lambda a: text[words[a][2] : words[a + 1][1]]
    near = lambda a: a + 1 < n and _GAP.match(gap(a) or " ") is not None
    while i < n:
        word, start, end = words[i]
        last = None
        bare = word.rstrip(".").lower()
        if bare in TITLES and word[0].isupper() and near(i):
            j = i + 1
            while j < n and j < i + 4 and (_cap(words[j][0]) or _initial(words[j][0]) or flags[j]):
                last = j
                if flags[j] & 1 and not flags[j] & 2 or words[j][0].endswith(".") and not _initial(words[j][0]) or not near(j):
                    break
                j += 1
            if last is not None and _initial(words[last][0]):
                last = None
            if last is not None and last + 1 < n and flags[last] & 1 and flags[last + 1] & 2 and _COMMA.match(gap(last)):
                last += 1
        elif flags[i] & 1 and i + 1 < n and flags[i + 1] & 2 and _COMMA.match(gap(i)):
            last = i + 1
            if last + 1 < n and _initial(words[last + 1][0]) and near(last):
                last += 1
        elif (flags[i] & 2 or _initial(word) or _cap(word) and not word.endswith(".")) and near(i):
            j = i + 1
            while j < n and j < i + 4 and _initial(words[j][0]) and near(j):
                j += 1
            backwards = flags[j] & 1 and j + 1 < n and flags[j + 1] & 2 and _COMMA.match(gap(j)) and not flags[i] & 2
            if flags[j] & 1 and not backwards and (flags[i] & 2 or _initial(word) or words[j][0][0].isupper() and not text[end : words[j][1]].strip()):
                last = j
        if last is None and known.some_names and _cap(word) and i + 1 < n:
            j = i + 1
            while j < n and j < i + 3 and _initial(words[j][0]):
                j += 1
            if j < n and _cap(words[j][0]) and re.fullmatch(r"[\s ](?:[A-Z]\.[\s ])*|,[\s ]", text[end : words[j][1]]):
                stop = words[j][2] - words[j][0].endswith(".")
                if text[:start].strip(" \0") and _h(_pattern(text, start, stop)) in known.name_patterns:
                    last = j
        if last is not None:
            out.append((start, words[last][2] - (words[last][0].endswith(".") and not _initial(words[last][0]))))
            i = last + 1
        else:
            i += 1
    return out


# Gates: each holds for every text its pattern can match, and for few others.
#: Parts of the words that addresses hold, as low() writes them; a text without any needs no search.
_PLACES = ("nagar", "colony", "layout", "puram", "vihar", "marg", "lane", " ln", "street", " st", "road", " rd", " ave", "close", "cresc", "drive", " dr", " row", " way", "court", " ct", "place", " pl",
           "square", " sq", "terrace", "boulev", "blvd", "garden", "grove", " walk", "mews", "parade", "highway", "hwy", "straße", "strasse", "weg ", "gasse", "platz", "allee", "ring ", "damm", "ufer",
           "am ", "an der", "im ", "zum ", "zur ", "rue ", "allée", "chemin", "impasse", "quai", "route", "cours", "calle", "avenida", "avda", "plaza", "paseo", "camino", "rua ", "ulica", "ul.")
_WHITE = re.compile(r"[^\S ]")


def _low(text: str) -> str:
    """Lower case as patterns without regard to case see it, any white space as a blank."""
    low = text.lower()
    if not low.isascii():
        low = low.replace("i\u0307", "i").replace("ı", "i").replace("ſ", "s")
    return _WHITE.sub(" ", low)


def _may_mail(low: str) -> bool:
    return "@" in low or "＠" in low or "at]" in low or "at)" in low or "at}" in low or "at>" in low or " dot " in low


def _may_id(text: str, digits: int) -> bool:
    return digits >= 4


def _digits(s: str) -> int:
    """Decimal digits of any script (and the few other signs str.isdigit takes)."""
    return sum(map(s.count, "0123456789")) if s.isascii() else sum(map(str.isdigit, s))


def spans(text: str | None, known: Lexicon = EMPTY) -> list[tuple[int, int, str]]:
    """(start, end, kind) of all personal information, in order, without overlaps."""
    if not text or text.isspace():
        return []
    found: list[tuple[int, int, str]] = []
    masked = text

    def take(kind: str, pieces) -> None:
        nonlocal masked
        for a, b in pieces:
            found.append((a, b, kind))
            masked = masked[:a] + "\0" * (b - a) + masked[b:]

    if "[" in text:
        for m in _HELD.finditer(text):
            masked = masked[: m.start()] + "\0" * (m.end() - m.start()) + masked[m.end() :]
    low = _low(text)
    digits = _digits(text)
    if _may_mail(low):
        take("EMAIL", [m.span() for m in EMAIL.finditer(masked)])
    if digits:
        if any([w in low for w in _PLACES]):
            view = masked.title() if text.islower() or text.swapcase().istitle() or text.isupper() else masked
            take("ADDRESS", [m.span() for m in ADDRESS.finditer(view if len(view) == len(masked) else masked)])
        if _may_id(text, digits):
            take("ID", [m.span() for m in ID.finditer(masked) if not _of_goods(masked, m.start())])
            if known.some_ids:
                take("ID", [(a, b) for a, b in _numbers(masked) if (_h(_shape(masked[a:b])) in known.id_shapes or _h(_pattern(masked, a, b)) in known.id_patterns) and not _of_goods(masked, a)])
        if digits >= 8:
            take("PHONE", [m.span() for m in PHONE.finditer(masked) if 8 <= _digits(re.split(r"(?i)\s*(?:ext|x)", m.group(0))[0]) <= 15 and not _GOODS.search(masked[max(0, m.start() - 20) : m.start()])])
    if "श्री" in text or "डॉ" in text or "सुश्री" in text:
        take("NAME", [m.span() for m in _HINDI.finditer(masked)])
    if known.named(masked) or known.some_names and _PAIR.search(masked):
        take("NAME", _names(masked, known))
    return sorted(found)


#: Two words after the start of a text that may be capitals, which is all that a name found by its pattern must be.
_PAIR = re.compile(r"(?<=[\s\S])(?<![^\W\d_])[^\W\d_a-zß-öø-ÿ][\w'’-]+\.?,?\s(?:[A-Z]\.\s)*[^\W\d_a-zß-öø-ÿ][\w'’-]")
#: Texts that names are learned from: a name inside a sentence.
_CAPS = re.compile(r"(?:[a-zß-ÿ]|[:.?!])\s+[A-ZÀ-Þ][\w'’-]+,?\s+(?:[A-Z]\.\s+)?[A-ZÀ-Þ][\w'’-]")


def redact(text: str | None, known: Lexicon = EMPTY) -> str | None:
    """The text with typed placeholders; equal values share a number."""
    if text is None:
        return None
    numbers: dict[str, dict[str, int]] = {}
    out, at = [], 0
    for a, b, kind in spans(text, known):
        seen = numbers.setdefault(kind, {})
        value = fold(re.sub(r"\W+", "", text[a:b]))
        out += [text[at:a], f"[{kind}_{seen.setdefault(value, len(seen) + 1)}]"]
        at = b
    return "".join([*out, text[at:]])


def _candidates(text: str) -> Iterator[tuple[str, str, int, int]]:
    """(family, given, start, end) of runs of words that could be a name in a sentence."""
    for m in re.finditer(r"(?<![\w@.])([A-ZÀ-ÞŁŚŻŠČ][\w'’-]+)(,?) (?:[A-Z]\. )?([A-ZÀ-ÞŁŚŻŠČ][\w'’-]+)(?! ?[A-ZÀ-Þ])", text):
        first, comma, second = m.groups()
        if first.lower() in TITLES:
            yield second, "", m.start(), m.end()
        elif comma:
            yield first, second, m.start(), m.end()
        else:
            yield second, first, m.start(), m.end()


#: What an edge row says: seeds of family and given names, name edges, named document numbers, other numbers, and numbers that are something else.
_EDGES = "what string, pattern bigint, instance bigint, n bigint"


def edges(texts: DataFrame) -> DataFrame:
    """Edges of the pattern-instance graph, summed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def rows() -> pa.RecordBatch:
            keys = list(total)
            return pa.RecordBatch.from_arrays(
                [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()), pa.array([k[2] for k in keys], pa.int64()), pa.array([total[k] for k in keys], pa.int64())],
                names=["what", "pattern", "instance", "n"],
            )

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if _may_mail(_low(t)):
                    for m in EMAIL.finditer(t):
                        local = re.split(r"@|＠|\[at\]|\(at\)|\{at\}|<at>|\sat\s", m.group(0).lower().removeprefix("mailto:"))[0]
                        parts = [p for p in re.split(r"[._+\d\s]+|\bdot\b", local) if len(p) > 3]
                        if len(parts) == 2:
                            total["given", 0, _h(parts[0])] += 1
                            total["family", 0, _h(parts[1])] += 1
                if _CAPS.search(t):
                    for family, given, a, b in _candidates(t):
                        p = _h(_pattern(t, a, b))
                        total["name", p, _h(fold(family))] += 1
                        if given:
                            total["first", p, _h(fold(given))] += 1
                if _may_id(t, _digits(t)):
                    named = [(m.span(), m.group(m.lastgroup)) for m in ID.finditer(t)]
                    for (a, b), number in named:
                        total["id", _h(_pattern(t, a, b)), _h(_shape(number))] += 1
                    phones = None
                    for a, b in _numbers(t):
                        if not any(x < b and a < y for (x, y), _ in named):
                            phones = [m.span() for m in PHONE.finditer(t)] if phones is None else phones
                            other = _of_goods(t, a) or any(x < b and a < y for x, y in phones)
                            total["other" if other else "number", _h(_pattern(t, a, b)), _h(_shape(t[a:b]))] += 1
            if len(total) > 200_000:
                yield rows()
                total.clear()
        yield rows()

    return texts.select("text").where("text is not null").mapInArrow(run, _EDGES).groupBy("what", "pattern", "instance").agg(F.sum("n").alias("n"))


def _round(graph: DataFrame, scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Trusted patterns under the scores of instances, and the instances' new scores (a seed keeps its own)."""
    rated = graph.join(scores, "instance", "left").fillna(0.0, ["score"])
    patterns = (
        rated.groupBy("pattern")
        .agg((F.sum(F.col("n") * F.col("score")) / F.sum("n")).alias("sure"), F.count(F.when(F.col("score") >= INSTANCE_SCORE, 1)).alias("known"))
        .where((F.col("sure") >= PATTERN_SHARE) & (F.col("known") >= PATTERN_DISTINCT))
        .select("pattern", "sure")
    )
    held = graph.join(patterns, "pattern", "left").groupBy("instance").agg(
        (1 - F.exp(F.sum(F.when(F.col("sure").isNotNull(), F.log(1 - 0.95 * F.col("sure"))).otherwise(0.0)))).alias("by_patterns"),
        (F.sum(F.when(F.col("sure").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("within"),
    )
    fresh = held.select("instance", (F.col("by_patterns") * F.col("within")).alias("found"))
    joined = fresh.join(scores, "instance", "full").select("instance", F.greatest(F.coalesce("found", F.lit(0.0)), F.coalesce("score", F.lit(0.0))).alias("score"))
    return patterns, joined.where("score > 0.05")


def _keys(rows: DataFrame) -> frozenset[int]:
    found = rows.limit(MOST_KNOWN + 1).collect()
    if len(found) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known {rows.columns[0]} digests")
    return frozenset([r[0] for r in found])


def bootstrap(spark: SparkSession, texts: DataFrame, rounds: int = ROUNDS) -> Lexicon:
    """Score the graph in rounds and keep the sure patterns and instances.

    The graph stays in Spark; what comes to the driver are the digests of trusted patterns and known names, checked against MOST_KNOWN.
    """
    all_edges = cut(edges(texts))
    graph = all_edges.where("what = 'name'").select("pattern", "instance", "n")
    seeds = all_edges.where("what in ('family', 'given')").groupBy("instance").agg(F.sum(F.when(F.col("what") == "family", F.col("n")).otherwise(0)).alias("f"), F.sum(F.when(F.col("what") == "given", F.col("n")).otherwise(0)).alias("g"))
    scores = seeds.where("f > g and f >= 2").select("instance", F.lit(1.0).alias("score"))
    patterns = None
    for _ in range(rounds):
        patterns, scores = _round(graph, scores)
        scores = cut(scores)
    sure = patterns.select("pattern")
    first = all_edges.where("what = 'first'").join(sure, "pattern", "left_semi").groupBy("instance").agg(F.sum("n").alias("n")).where("n >= 3").select("instance")
    given = seeds.where("g > f and g >= 2").select("instance").union(first).distinct()
    family = scores.where(F.col("score") >= INSTANCE_SCORE).select("instance")
    ids, shapes = _documents(all_edges, rounds)
    return Lexicon(_keys(family), _keys(given), _keys(sure), _keys(ids), _keys(shapes))


#: Least number of different shapes that make a number's pattern trusted, of trusted patterns that make a shape known, and of seeds of a shape.
SHAPES, CONTEXTS, NAMED = 2, 3, 2


def _documents(edges: DataFrame, rounds: int) -> tuple[DataFrame, DataFrame]:
    """(trusted patterns of document numbers, their known shapes), by rounds over the graph of patterns and shapes.

    A pattern is sure when nearly all its numbers that are judged (of a known shape, or of goods and telephones) are of a
    known shape; numbers of unknown shape say nothing.  A shape is known when most of its numbers stand in trusted
    patterns, and in several of them.
    """
    graph = cut(edges.where("what in ('id', 'number', 'other')").groupBy("pattern", "instance").agg(
        F.sum("n").alias("n"), F.sum(F.when(F.col("what") == "id", F.col("n")).otherwise(0)).alias("named"), F.sum(F.when(F.col("what") == "other", F.col("n")).otherwise(0)).alias("other")))
    known = graph.groupBy("instance").agg(F.sum("named").alias("named")).where(F.col("named") >= NAMED).select("instance")
    sure = known.limit(0).withColumnRenamed("instance", "pattern")
    for _ in range(rounds):
        rated = graph.join(known.withColumn("is_known", F.lit(True)), "instance", "left")
        good = F.when(F.col("is_known"), F.col("n") - F.col("other")).otherwise(0)
        sure = (
            rated.groupBy("pattern").agg(F.sum(good).alias("good"), F.sum("other").alias("bad"), F.count(F.when(F.col("is_known") & (F.col("n") > F.col("other")), 1)).alias("shapes"))
            .where((F.col("good") >= PATTERN_SHARE * (F.col("good") + F.col("bad"))) & (F.col("shapes") >= SHAPES)).select("pattern")
        )
        within = graph.join(sure.withColumn("is_sure", F.lit(True)), "pattern", "left").groupBy("instance").agg(
            (F.sum(F.when(F.col("is_sure"), F.col("n") - F.col("other")).otherwise(0)) / F.sum("n")).alias("within"), F.count(F.when(F.col("is_sure"), 1)).alias("contexts"), F.sum("named").alias("named"))
        known = cut(within.where((F.col("named") >= NAMED) | (F.col("within") >= INSTANCE_SCORE) & (F.col("contexts") >= CONTEXTS)).select("instance"))
    return sure, known


def item_texts(items: DataFrame) -> DataFrame:
    """(src_field, rec_id, text) of the items' text field, read on the JVM."""
    parsed = F.try_variant_get(F.try_parse_json("item_json"), "$.text", "string")
    return items.select(F.lit("item_text").alias("src_field"), F.col("item_id").alias("rec_id"), parsed.alias("text"))


def all_texts(nodes: DataFrame, messages: DataFrame, items: DataFrame) -> DataFrame:
    """(src_field, rec_id, text) of the three fields."""
    of_nodes = nodes.select(F.lit("node_text").alias("src_field"), F.col("node_pk").alias("rec_id"), "text")
    of_prompts = messages.select(F.lit("prompt").alias("src_field"), F.col("msg_id").alias("rec_id"), F.col("prompt").alias("text"))
    return of_nodes.unionByName(of_prompts).unionByName(item_texts(items)).where("rec_id is not null and text is not null")


_known: dict[str, Lexicon] = {}


def _share(spark: SparkSession, known: Lexicon):
    shared = spark.sparkContext.broadcast((known.family, known.given, known.name_patterns, known.id_patterns, known.id_shapes))
    token = uuid.uuid4().hex

    def get() -> Lexicon:
        if token not in _known:
            _known.clear()
            _known[token] = Lexicon(*shared.value)
        return _known[token]

    return get


def occurrences(texts: DataFrame, known: Lexicon) -> DataFrame:
    """(src_field, rec_id, kind, occ): one row per occurrence, counted by kind within a text."""
    get = _share(texts.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = get()
        memo: dict[str, tuple] = {}
        for batch in batches:
            at, kinds, occs = [], [], []
            for row, t in enumerate(batch.column(2).to_pylist()):
                got = memo.get(t)
                if got is None:
                    got = tuple(k for _, _, k in spans(t, lexicon))
                    if len(t) < 100:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[t] = got
                counts: dict[str, int] = {}
                for kind in got:
                    counts[kind] = counts.get(kind, 0) + 1
                    at.append(row)
                    kinds.append(kind)
                    occs.append(counts[kind])
            picked = batch.select([0, 1]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, pa.array(kinds, pa.string()), pa.array(occs, pa.int64())], names=["src_field", "rec_id", "kind", "occ"])

    return texts.mapInArrow(run, "src_field string, rec_id bigint, kind string, occ bigint")


def redacted(texts: DataFrame, known: Lexicon) -> DataFrame:
    """(src_field, rec_id, text) with typed placeholders in place of personal information."""
    get = _share(texts.sparkSession, known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = get()
        for batch in batches:
            done = [redact(t, lexicon) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(done, pa.string())], names=["src_field", "rec_id", "text"])

    return texts.mapInArrow(run, "src_field string, rec_id bigint, text string")
