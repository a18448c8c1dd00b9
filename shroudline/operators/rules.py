"""Detection of personal data by rules: one vectorised pass gives all spans of a text, overlaps resolved.

A rule names a type, a pattern over the scan form of the text, the group that holds the value, a check of the value,
and what must not stand before it.  The scan form undoes full-width letters, look-alikes, Devanagari digits, zero-width
characters and right-to-left overrides, and keeps for every character its place in the original, so spans are offsets
(code points) in the original text.
"""

from __future__ import annotations

import base64
import binascii
import re
from bisect import bisect_left
from collections.abc import Callable
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.functions import checks
from shroudline.functions.text import BIDI, DEVANAGARI, FULLWIDTH, FULLWIDTH_TO, HOMOGLYPHS, HOMOGLYPHS_TO, ZERO_WIDTH

SPAN = "struct<start:int,`end`:int,type:string,value:string,source:string,weak:boolean>"

#: Fine types and the coarse token each becomes without a vault.
COARSE = {
    "EMAIL": "EMAIL", "PHONE": "PHONE", "CC": "CC", "CVV": "CC", "SSN": "SSN", "AADHAAR": "ID", "PAN": "ID", "PASSPORT": "ID", "VOTER_ID": "ID",
    "DRIVING_LICENSE": "ID", "GSTIN": "ID", "BANK_ACCOUNT": "ID", "UPI": "ID", "ID": "ID", "OTP": "ID", "SECRET": "ID", "PASSWORD": "ID", "IP": "ID",
    "DOB": "ID", "ADDRESS": "ADDRESS", "PINCODE": "ADDRESS", "NAME": "NAME", "LOCATION": "LOCATION",
}
#: Types whose presence after redaction is a leak.
HIGH_RISK = ("EMAIL", "PHONE", "CC", "SSN", "AADHAAR", "PAN", "GSTIN", "SECRET")

_PLAIN = {**dict(zip(HOMOGLYPHS, HOMOGLYPHS_TO)), **dict(zip(DEVANAGARI, "0123456789")), **dict(zip(FULLWIDTH, FULLWIDTH_TO))}
_PLAIN_TABLE = str.maketrans(_PLAIN)
_RLO, _PDF = "\u202e", "\u202c"
_SPECIAL = re.compile(f"[{ZERO_WIDTH}{BIDI}{_RLO}]")


def scan_form(text: str) -> tuple[str, list[int] | None]:
    """(the folded text, place of each character in the original, or None where both have the same places)."""
    if text.isascii():
        return text, None
    if not _SPECIAL.search(text):
        return text.translate(_PLAIN_TABLE), None
    places: list[int] = []
    i = 0
    while i < len(text):
        if text[i] == _RLO:  # the run up to the mark (or the end) is stored backwards
            stop = text.find(_PDF, i)
            stop = len(text) if stop < 0 else stop
            places.extend(k for k in range(stop - 1, i, -1) if text[k] not in ZERO_WIDTH)
            i = stop + 1
            continue
        if text[i] not in BIDI and text[i] not in ZERO_WIDTH:
            places.append(i)
        i += 1
    return "".join([_PLAIN.get(text[k], text[k]) for k in places]), places


# checks of single values (the column versions are in functions.checks)
def luhn(value: str) -> bool:
    d = [int(c) for c in value if "0" <= c <= "9"]
    doubled = [sum(divmod(2 * x, 10)) for x in d[-2::-2]]
    return 13 <= len(d) <= 19 and (sum(d[-1::-2]) + sum(doubled)) % 10 == 0


def verhoeff(value: str) -> bool:
    c = 0
    for i, x in enumerate(reversed([int(ch) for ch in value if "0" <= ch <= "9"])):
        c = int(checks.VERHOEFF_D[c][int(checks.VERHOEFF_P[i % 8][x])])
    return c == 0


def aadhaar(value: str) -> bool:
    d = re.sub("[^0-9]", "", value)
    return len(d) == 12 and d[0] in "23456789" and verhoeff(d)


def gstin(value: str) -> bool:
    s = value.upper()
    if not re.match(checks.GSTIN, s, re.ASCII):
        return False
    total = sum(sum(divmod(checks.MOD36.index(c) * (1 + i % 2), 36)) for i, c in enumerate(s[:14]))
    return checks.MOD36[-total % 36] == s[14]


@dataclass(frozen=True)
class Rule:
    type: str
    pattern: re.Pattern
    group: int = 0
    valid: Callable[[str, re.Match, str], bool] | None = None
    not_after: re.Pattern | None = None
    weak: bool = False

    hindi: bool = False


def _r(type_: str, pattern: str, group: int = 0, valid=None, not_after: str | None = None, weak: bool = False, ignore_case: bool = False, hindi: bool = False) -> Rule:
    flags = re.ASCII | (re.IGNORECASE if ignore_case else 0)
    return Rule(type_, re.compile(pattern, flags), group, valid, re.compile(not_after, re.ASCII | re.IGNORECASE) if not_after else None, weak, hindi)


#: Fixed value: a change of the kind of character; changes do not overlap.
SWITCH = r"[a-z][A-Z]|[A-Z][a-z]|[A-Za-z]\d|\d[A-Za-z]"
_SWITCH = re.compile(SWITCH, re.ASCII)


def _switches(v: str) -> bool:
    return len(_SWITCH.findall(v)) >= 6 and not re.fullmatch(r"[A-Z][a-z]+(?:[A-Z][a-z]+)+\d*", v, re.ASCII)


def _few_digits(least: int):
    return lambda v, m, t: len(re.sub("[^0-9]", "", v)) >= least


def _address(v: str, m: re.Match, t: str) -> bool:
    return len(v.split()) >= 3 or re.search(r"[1-9]\d{2}\s?\d{3}", v) is not None


def _landline(v: str, m: re.Match, t: str) -> bool:
    n = len(re.sub("[^0-9]", "", v))
    marked, spaced = re.search(r"[+()\-]", v), re.search(r"\s", v)
    return 10 <= n <= 15 and bool(marked or spaced and n <= 13) and not re.match(r"\d{4}-\d{2}-\d{2}", v.strip())


# The words and patterns below must be these for results to agree.
_HOUSE = r"(?:(?:Flat|House|Plot|Door|Shop|Qtr|H|D)\.?\s*(?:No\.?)?\s*[:#.]?\s*\d[\w/-]*|#\s?[\w/-]+|\d{1,5}[A-Za-z]?(?:/\d+)?)"
_STREET = r"(?:Road|Rd|Marg|Nagar|Colony|Street|St|Lane|Ln|Sector|Layout|Cross|Main|Block|Phase|Society|Apartments?|Apts?|Enclave|Vihar|Puram|Chowk|Bazaar|Bazar|Avenue|Ave|Boulevard|Blvd|Drive|Dr|Court|Ct|Way|Place|Pl|Square|Sq|Terrace|Parkway|Pkwy|Highway|Hwy|Gali|Mohalla|Extension|Ext|Tower|Residency|Heights|Park)"
_REFERENCE = r"(?:\b(?:PNR|order|invoice|ref(?:erence)?|txn|transaction(?: id)?|UTR|tracking|AWB|ticket|booking|train|flight)\s*(?:no\.?|number|id)?\s*[:#]?|(?:पीएनआर|ऑर्डर|चालान|संदर्भ|लेनदेन|ट्रैकिंग|टिकट|बुकिंग|ट्रेन)\s*(?:नंबर|सं\.?)?\s*[:#]?)\s*$"
_REFERENCE_LATIN = r"\b(?:ISBN(?:-1[03])?|PNR|order|invoice|ref(?:erence)?|txn|transaction(?: id)?|UTR|tracking|AWB|ticket|booking)\s*(?:no\.?|number|id)?\s*[:#]?\s*$"
_HI = r"[ऀ-ॣ॰-ॿ]+"
_HI_TITLE = r"(?:श्रीमती|श्री|सुश्री|कुमारी|डॉ\.?|डॉक्टर)"
_HI_STOP = r"(?:का|की|के|ने|को|से|में|पर|है|हैं|था|थी|और|या|यह|वह|तथा|एवं|साथ)"
_HI_HOUSE = r"(?:मकान|प्लॉट|फ्लैट|दुकान)\s*(?:नंबर|नं\.?|सं\.?)?\s*[:#]?\s*\d[\wऀ-ॣ॰-ॿ/-]*"
_HI_STREET = r"(?:मार्ग|नगर|गली|सड़क|कॉलोनी|चौक|विहार|पुरम|सेक्टर|गांव|गाँव|जिला|ज़िला|तहसील|ब्लॉक|अपार्टमेंट|सोसाइटी|रोड|एन्क्लेव|टावर)"
_HI_CITY = r"(?:मुंबई|मुम्बई|दिल्ली|नई\s*दिल्ली|बेंगलुरु|बैंगलोर|चेन्नई|कोलकाता|हैदराबाद|पुणे|अहमदाबाद|जयपुर|लखनऊ|कोच्चि|इंदौर|भोपाल|चंडीगढ़|नागपुर|सूरत|पटना|गुवाहाटी|वाराणसी|देहरादून|मैसूरु|रांची|भुवनेश्वर|तिरुवनंतपुरम)"

RULES = (
    _r("SECRET", r"\b(?:sk-[A-Za-z0-9_-]{20,}|AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{30,}|xox[baprs]-[A-Za-z0-9-]{10,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,})\b"),
    _r("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}\b"),
    _r("UPI", r"\b[A-Za-z0-9][A-Za-z0-9._-]{1,63}@(?:ok)?[A-Za-z]{2,15}\b(?![.@-]\w)", valid=lambda v, m, t: not re.search(r"@(?:gmail|yahoo|outlook|hotmail)$", v, re.I)),
    _r("PASSWORD", r"\b(?:password|passwd|pwd|passcode|pin)\s*(?:is\s*|:\s*|=\s*|-\s*|\s)(?:being\s+)?(\S{4,64}(?:\s\S{1,32}){0,3})", 1, lambda v, m, t: bool(re.search(r"[^A-Za-z]|[a-z][A-Z]", v)), ignore_case=True),
    _r("SECRET", r"\b(?=[A-Za-z0-9_]*[a-z])(?=[A-Za-z0-9_]*[A-Z])(?=[A-Za-z0-9_]*\d)[A-Za-z0-9_]{10,40}\b", valid=lambda v, m, t: _switches(v), weak=True),
    _r("OTP", r"\b(?:OTP|one[- ]time (?:password|code)|verification code|security code|auth(?:entication)? code)\b[^0-9\n]{0,24}(\d{4,8})\b", 1, ignore_case=True),
    _r("OTP", r"\b(\d{4,8})\s+is\s+(?:your|the)\s+(?:OTP|one[- ]time|verification code|code)", 1, ignore_case=True),
    _r("CVV", r"\b(?:CVV|CVC|CVV2|card verification(?: value| code)?|security code)\b\s*(?:no\.?|number|code)?\s*(?:is|being|:|=|-|\()?\s*(\d{3,4})\b", 1, ignore_case=True),
    _r("GSTIN", r"\b\d{2}[A-Z]{5}\d{4}[A-Z][1-9A-Z]Z[0-9A-Z]\b", valid=lambda v, m, t: gstin(v)),
    _r("PAN", r"\b[A-Z]{3}[ABCFGHLJPT][A-Z]\d{4}[A-Z]\b"),
    _r("DRIVING_LICENSE", r"\b[A-Z]{2}[-\s]?\d{2}[-\s]?(?:19|20)\d{2}[-\s]?\d{7}\b"),
    _r("PASSPORT", r"\b(?:passport)\b[^A-Z0-9\n]{0,20}([A-PR-WY][1-9]\d\s?\d{4}[1-9])\b", 1, ignore_case=True),
    _r("PASSPORT", r"\b[A-PR-WY][1-9]\d{5}[1-9]\b", valid=lambda v, m, t: bool(re.search("passport|travel|visa", t, re.I))),
    _r("VOTER_ID", r"\b(?:voter\s*id|EPIC)\b[^A-Z0-9\n]{0,20}([A-Z]{3}\d{7})\b", 1, ignore_case=True),
    _r("SSN", r"\b\d{3}-\d{2}-\d{4}\b"),
    _r("CC", r"\b(?:\d[ -]?){12,18}\d\b", valid=lambda v, m, t: luhn(v) and not aadhaar(v), not_after=r"\bISBN(?:-1[03])?:?\s*$"),
    _r("CC", r"\b(?:card|credit|debit|visa|master ?card|maestro|amex|discover|rupay)\b[^0-9\n]{0,32}((?:\d[ -]?){12,18}\d)\b", 1, lambda v, m, t: not aadhaar(v), ignore_case=True),
    _r("AADHAAR", r"\b[2-9]\d{3}[\s-]?\d{4}[\s-]?\d{4}\b", valid=lambda v, m, t: aadhaar(v)),
    _r("AADHAAR", r"\b[Xx*]{4}[\s-]?[Xx*]{4}[\s-]?\d{4}\b"),
    _r("BANK_ACCOUNT", r"\b(?:a/c|acct|account)\b[^0-9\n]{0,24}?(?:no\.?|number|#)?\s*(?:is|ending(?: in)?|:|-|=|\()?\s*((?:[Xx*]{2,}\s?)?\d[\d\s-]{2,20}\d)\b", 1, _few_digits(6), ignore_case=True),
    _r("DOB", r"\b(?:DOB|D\.O\.B\.?|date of birth|born(?: on)?|birth ?date)\s*[:\-]?\s*(\d{1,2}[/\-. ](?:\d{1,2}|[A-Za-z]{3,9})[/\-. ]\d{2,4})\b", 1, ignore_case=True),
    _r("IP", r"(?<![\w.:])[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}(?![\w:])", ignore_case=True),
    _r("IP", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)", valid=lambda v, m, t: not re.search(r"(?:v|version|ver\.?)\s*$", t[max(0, m.start() - 10) : m.start()], re.I)),
    _r("PHONE", r"(?<![\w+])(?:\+91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5}(?!\d)", not_after=_REFERENCE),
    _r("PHONE", r"(?<![\w])\+?\d[\d\s().-]{7,}\d(?!\d)", valid=_landline, not_after=_REFERENCE_LATIN),
    _r("ADDRESS", rf"\b{_HOUSE},?\s+(?:[A-Z0-9][\w.'-]*,?\s+){{0,5}}?{_STREET}\b(?:\s+\d{{1,3}}[A-Z]?\b)?\.?(?:,\s*[A-Z0-9][\w'-]*(?:\s+[A-Z][\w'-]*){{0,2}}){{0,5}}(?:,?\s*(?:-\s*)?[1-9]\d{{2}}\s?\d{{3}}\b)?", valid=_address),
    _r("PINCODE", r"\b(?:PIN|Pincode|Postal|ZIP)(?:\s*code)?\s*[:\-]?\s*([1-9]\d{2}\s?\d{3})\b", 1, ignore_case=True),
    _r("OTP", r"(?:ओटीपी|वन[- ]टाइम\s*(?:पासवर्ड|कोड)|सत्यापन\s*कोड)[^0-9\n]{0,24}(\d{4,8})", 1, hindi=True),
    _r("CVV", r"(?:सीवीवी|सुरक्षा\s*कोड)[^0-9\n]{0,20}(\d{3,4})", 1, hindi=True),
    _r("DOB", r"(?:जन्म\s*तिथि|जन्मतिथि|डीओबी)\s*[:\-]?\s*(\d{1,2}[/\-. ]\d{1,2}[/\-. ]\d{2,4})", 1, hindi=True),
    _r("PINCODE", r"(?:पिन\s*कोड|डाक\s*कोड|पिनकोड)\s*[:\-]?\s*([1-9]\d{2}\s?\d{3})", 1, hindi=True),
    _r("BANK_ACCOUNT", r"(?:खाता\s*(?:संख्या|नंबर|क्रमांक)|अकाउंट\s*नंबर)\s*[:\-]?\s*(\d[\d\s-]{5,20}\d)", 1, _few_digits(6), hindi=True),
    _r("NAME", rf"{_HI_TITLE}\s+({_HI}(?:\s+(?!{_HI_STOP}(?:\s|$|[।॥,.])|{_HI_CITY}){_HI}){{0,1}})", 1, hindi=True),
    _r("ADDRESS", rf"{_HI_HOUSE}[,\s]+(?:{_HI}[,\s]+){{0,6}}?{_HI_STREET}(?:[,\s]+{_HI}){{0,3}}(?:[,\s]+[1-9]\d{{2}}\s?\d{{3}})?", valid=_address, hindi=True),
    _r("LOCATION", _HI_CITY, hindi=True),
)
_TRAILING = re.compile(r"[\s,.;:-]+$")

Span = tuple[int, int, str, str, str, bool]


def matches(text: str | None, rules: tuple[Rule, ...] = RULES) -> list[Span]:
    """All valid matches of the rules in their order, overlaps included."""
    if not text:
        return []
    flat, places = scan_form(text)
    digits, low = sum(map(flat.count, "0123456789")), flat.lower()
    hindi = not flat.isascii() and _DEVANAGARI.search(flat) is not None
    found: list[Span] = []
    for rule in rules:
        # what every match of the rule must hold, tested before its pattern is searched
        if digits < _LEAST_DIGITS.get(rule.type, 0) or rule.type in _MARKS and not any([m in low for m in _MARKS[rule.type]]) or rule.hindi and not hindi:
            continue
        for m in rule.pattern.finditer(flat):
            value = m.group(rule.group)
            if not value:
                continue
            # a value repeated inside its match is taken at its last place
            start = m.start() + m.group(0).rfind(value) if rule.group else m.start()
            value = _TRAILING.sub("", value)
            if not value or rule.valid and not rule.valid(value, m, flat):
                continue
            if rule.not_after and rule.not_after.search(flat[max(0, start - 24) : start]):
                continue
            if places is None:
                a, b = start, start + len(value)
            else:
                held = places[start : start + len(value)]
                a, b = min(held), max(held) + 1
            found.append((a, b, rule.type, value, "rule", rule.weak))
    return found


def rule_spans(text: str | None) -> list[Span]:
    """Spans of all rules, overlaps resolved."""
    return resolve(matches(text))


_DEVANAGARI = re.compile("[\u0900-\u097f]")
#: Digits (or, for IPv6, colons) and words without which no rule of a type can match.
_LEAST_DIGITS = {"OTP": 4, "CVV": 3, "GSTIN": 6, "PAN": 4, "DRIVING_LICENSE": 13, "PASSPORT": 6, "VOTER_ID": 7, "SSN": 9, "CC": 13, "AADHAAR": 4, "BANK_ACCOUNT": 6, "DOB": 3, "PHONE": 9, "ADDRESS": 1, "PINCODE": 6}
_MARKS = {
    "EMAIL": ("@",), "UPI": ("@",), "PASSWORD": ("password", "passwd", "pwd", "passcode", "pin"), "IP": (".", ":"), "VOTER_ID": ("voter", "epic"),
    "NAME": tuple(title.replace("\\.?", "") for title in _HI_TITLE[3:-1].split("|")),
}


def resolve(spans: list[Span]) -> list[Span]:
    """Greedy choice without overlaps: sure rules first, then the longer, then the earlier in the list; in order of place.

    The kept spans are held in order of place, so each candidate is tested against its two neighbours only.
    """
    if len(spans) < 2:
        return list(spans)
    ranked = sorted(range(len(spans)), key=lambda i: (spans[i][4] != "rule" or spans[i][5], spans[i][0] - spans[i][1], i))
    kept: list[Span] = []
    for i in ranked:
        s = spans[i]
        at = bisect_left(kept, s[0], key=lambda k: k[0])
        if (at == len(kept) or s[1] <= kept[at][0]) and (at == 0 or kept[at - 1][1] <= s[0]):
            kept.insert(at, s)
    return kept


_LETTER = re.compile(r"[^\W_]")


def known_value_spans(text: str, known: list[tuple[str, str]]) -> list[Span]:
    """Places of (type, value) pairs, without regard to case, as whole words; values of less than three letters or digits are left out."""
    out = []
    for type_, value in known:
        if len(_LETTER.findall(value)) < 3:
            continue
        for m in re.finditer(re.escape(value), text, re.IGNORECASE):
            before, after = text[m.start() - 1 : m.start()], text[m.end() : m.end() + 1]
            if not _LETTER.match(before) and not _LETTER.match(after):
                out.append((m.start(), m.end(), type_, m.group(0), "vault", False))
    return out


def known_places(c: Column, known: list[tuple[str, str]]) -> Column:
    """array<string>: the places of known values in a text, as they are spelled there."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s[3] for s in known_value_spans(t, known)] if t else [])

    return run(c)


def custom_term_spans(text: str, terms: list[tuple[str, str, bool]]) -> list[Span]:
    """Places of (label, term, is a pattern); broken patterns are left out."""
    out = []
    for label, term, is_pattern in terms:
        type_ = re.sub("[^A-Z0-9]+", "_", (label or "CUSTOM").upper()).strip("_") or "CUSTOM"
        try:
            pattern = re.compile(term if is_pattern else re.escape(term), re.IGNORECASE)
        except re.error:
            continue
        out += [(m.start(), m.end(), type_, m.group(0), "custom", False) for m in pattern.finditer(text) if m.end() > m.start()]
    return out


def term_places(c: Column, terms: list[tuple[str, str, bool]]) -> Column:
    """array<string>: the types of all places of user terms in a text, before any overlap is resolved."""

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s[2] for s in custom_term_spans(t, terms)] if t else [])

    return run(c)


_BASE64, _HEX = re.compile(r"\b[A-Za-z0-9+/]{16,}={0,2}", re.ASCII), re.compile(r"\b(?:[0-9a-fA-F]{2}){8,}\b", re.ASCII)


def encoded_spans(text: str) -> list[Span]:
    """Base64 and hex runs that decode to printable ASCII, more than two fifths of which is personal data."""
    out = []
    for pattern, decode in ((_BASE64, lambda s: base64.b64decode(s, validate=True) if len(s) % 4 == 0 else b"\0"), (_HEX, bytes.fromhex)):
        for m in pattern.finditer(text):
            try:
                plain = decode(m.group(0)).decode("ascii")
            except (binascii.Error, ValueError):
                continue
            if not plain or not all(" " <= c <= "~" for c in plain):
                continue
            inner = rule_spans(plain)
            if inner and sum(s[1] - s[0] for s in inner) / len(plain) > 0.4:
                out.append((m.start(), m.end(), inner[0][2], plain, "encoded", False))
    return out


#: What a tagger's labels become; others are left out.
NER_LABELS = {"PER": "NAME", "PERSON": "NAME", "NAME": "NAME", "LOC": "LOCATION", "LOCATION": "LOCATION"}


def tagged_spans(text: str, tags: list[tuple[int, int, str]]) -> list[Span]:
    """Spans of a tagger's (start, end, label), by the labels that name a person or a place."""
    return [(a, b, NER_LABELS[label.upper()], text[a:b], "ner", False) for a, b, label in tags if (label or "").upper() in NER_LABELS and 0 <= a < b <= len(text)]


def all_spans(text: str | None, known=(), terms=(), ner: Callable[[str], list[Span]] | None = None) -> list[Span]:
    """Union of all producers; known values and terms rank with the rules, a tagger's spans after them."""
    if not text:
        return []
    spans = rule_spans(text)
    extra = known_value_spans(text, list(known)) + custom_term_spans(text, list(terms)) + encoded_spans(text)
    tagged = ner(text) if ner and len(text) >= 3 and re.search(r"[^\W\d_]{2}", text) else []
    if not extra and not tagged:
        return spans
    ranked = [(*s[:4], "rule", s[5]) for s in extra]
    sources = {s[:4]: s[4] for s in extra}
    return [(*s[:4], sources.get(s[:4], s[4]), s[5]) for s in resolve(spans + ranked + tagged)]


def detect(c: Column, known: list[tuple[str, str]] = (), terms: list[tuple[str, str, bool]] = (), ner: Column | None = None) -> Column:
    """array of spans of a text column; ``ner`` is a column of a tagger's array<struct<start,end,label>>."""
    fields = ("start", "end", "type", "value", "source", "weak")

    @F.pandas_udf(f"array<{SPAN}>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [dict(zip(fields, s)) for s in all_spans(t, known, terms)])

    @F.pandas_udf(f"array<{SPAN}>")
    def with_tags(texts: pd.Series, tags: pd.Series) -> pd.Series:
        read = lambda held: [(t["start"], t["end"], t["label"]) for t in held] if held is not None else []
        return pd.Series([[dict(zip(fields, s)) for s in all_spans(t, known, terms, lambda text, g=g: tagged_spans(text, read(g)))] for t, g in zip(texts, tags)])

    return run(c) if ner is None else with_tags(c, ner)


def matched(c: Column, which: tuple[int, ...]) -> Column:
    """array<string>: the values of all valid matches of some rules (numbers in RULES), overlaps included."""
    rules = tuple(RULES[i] for i in which)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [s[3] for s in matches(t, rules)])

    return run(c)


def exploded(df: DataFrame, key: str, text: str, keep: tuple[str, ...] = (), **options) -> DataFrame:
    """One row per span: (key, *keep, ord, start, end, type, value, source, weak); detection runs once a row, and what is kept needs no join."""
    found = df.select(key, *keep, detect(F.col(text), **options).alias("spans")).where(F.size("spans") > 0)
    return found.select(key, *keep, F.posexplode("spans").alias("ord", "s")).select(key, *keep, "ord", "s.*")


def apply_tokens(text: Column, spans: Column, token: Callable[[Column], Column]) -> Column:
    """The text with each span replaced: what lies between the spans is sliced once and joined with the tokens."""
    ends = F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"]))
    piece = lambda s, end: F.concat(F.substr(text, end + 1, F.coalesce(s["start"] - end, F.length(text))), F.when(s.isNotNull(), token(s)).otherwise(""))
    return F.when(F.size(spans) > 0, F.array_join(F.zip_with(spans, ends, piece), "")).otherwise(text)


def coarse_token(s: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in COARSE.items() for x in pair])
    return F.concat(F.lit("[REDACTED_"), F.coalesce(table[s["type"]], F.lit("ID")), F.lit("]"))


def has_residual(spans: Column) -> Column:
    """A high-risk span is left; masked numbers do not count."""
    return F.exists(spans, lambda s: s["type"].isin(*HIGH_RISK) & ~s["value"].rlike(r"^[Xx*]{4}"))


def resolve_overlaps(spans: Column) -> Column:
    """Native version of resolve() over array<struct<start,end,type,value,source,weak>>."""
    numbered = F.transform(spans, lambda s, i: F.struct((F.when((s["source"] == "rule") & ~s["weak"], 0).otherwise(1)).alias("r"), (s["start"] - s["end"]).alias("l"), i.alias("i"), s.alias("s")))
    empty = F.filter(spans, lambda s: F.lit(False))
    kept = F.aggregate(F.array_sort(numbered), empty, lambda k, x: F.when(F.exists(k, lambda y: (x["s"]["start"] < y["end"]) & (y["start"] < x["s"]["end"])), k).otherwise(F.array_append(k, x["s"])))
    return F.array_sort(kept)


