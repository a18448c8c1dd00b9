"""One query per detection rule, over probe texts made of customer numbers, checked by DuckDB's own pattern engine and arithmetic.

A probe is an expression both engines read alike: texts that match, texts that nearly match, and texts whose value fails
its check.  The query runs the rule engine on it; the SQL searches the pattern and tests the value by itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.functions import checks, text
from shroudline.operators import rules, scrub
from shroudline.sources.tables import table

_K = "c_custkey"


def _pad(number: str, width: int) -> str:
    return f"lpad(cast({number} as string), {width}, '0')"


def _pick(*texts: str) -> str:
    """One of several texts by the customer's number."""
    return f"CASE {_K} % {len(texts)} " + " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(texts)) + " END"


_N4, _N5, _N6, _N10, _N12 = (_pad(f"({_K} * 7919) % {10**w}", w) for w in (4, 5, 6, 10, 12))
_CARD = f"concat('4', {_pad(f'({_K} * 7919) % 1000000000', 14)}, cast({_K} % 10 as string))"
_AADHAAR = f"concat('2', {_pad(f'({_K} * 104729) % 10000000000', 11)})"
_GSTIN = f"concat('29ABCPK', {_N4}, 'F1Z', substr('{checks.MOD36}', cast({_K} % 36 + 1 as int), 1))"

#: Probe of each rule, by its number in RULES.
PROBES = {
    0: _pick(f"concat('key sk-', repeat('aB3', cast(6 + {_K} % 3 as int)), ' end')", f"concat('AKIA', {_pad(_K, 16)}, '.')", f"concat('ghp_', repeat('a1B', cast(9 + {_K} % 3 as int)))", f"concat('x AIza', {_pad(_K, 35)})", f"concat('AKIA', {_N10})"),
    1: _pick(f"concat('to u', {_K}, '@mail.example now')", f"concat('u.', {_K}, '+x@a-b.mail.example, or v@z.example')", f"concat('u', {_K}, '@host')", f"concat('<U_', {_K}, '@Mail.Example.org>')"),
    2: _pick(f"concat('pay u', {_K}, '@okaxis now')", f"concat('u', {_K}, '@gmail')", f"concat('u', {_K}, '@bank.example')", f"concat('to u', {_K}, '@ybl.')", f"concat('u', {_K}, '@bank-x')"),
    3: _pick(f"concat('Password: hunter', {_K}, ' now')", "'the pin is soft'", f"concat('pwd = aB', {_N4}, '; thanks')", "'passcode being letterOnly'"),
    4: _pick(f"concat('id aB3dE6gH9jK', {_K}, ' x')", "'userId2Name9 and MyVar1Name2'", "'CamelCaseWordsAndMore12'", f"concat('x9Yz8Wv7Ut6sR', {_N4})", f"concat('only_lower_', {_K})"),
    5: _pick(f"concat('Your OTP is ', {_N6})", f"concat('verification code: ', {_N4}, '.')", f"concat('code ', {_N6})", f"concat('OTP will come to your house soon, not ', {_N6})"),
    6: _pick(f"concat({_N6}, ' is your OTP')", f"concat({_N4}, ' is the verification code')", f"concat({_N6}, ' is your order')"),
    7: _pick(f"concat('CVV: ', {_pad(f'{_K} % 1000', 3)})", f"concat('security code is ', {_N4}, ' here')", f"concat('cvv x ', {_N4})"),
    8: _pick(f"concat('GSTIN ', {_GSTIN})", f"concat({_GSTIN}, ', ', 'x')"),
    9: _pick(f"concat('PAN ABCPK', {_N4}, 'F.')", f"concat('ABCXK', {_N4}, 'F')", f"concat('abcpk', {_N4}, 'f')", f"concat('ABCPK', {_N4}, 'FX')"),
    10: _pick(f"concat('DL KA-01-2011-', {_pad(_K, 7)})", f"concat('KA01 1999 ', {_pad(_K, 7)}, '!')", f"concat('KA-01-1811-', {_pad(_K, 7)})"),
    11: _pick(f"concat('Passport no. A', cast(1000001 + {_K} % 9 as string))", f"concat('passport: k12 ', {_N4}, '5')", f"concat('A1', {_N6})"),
    12: _pick(f"concat('visa for A1', {_N5}, '7')", f"concat('ticket A1', {_N5}, '7')", f"concat('travel with Q1', {_N5}, '7')"),
    13: _pick(f"concat('Voter ID: ABC', {_pad(_K, 7)})", f"concat('epic no abc', {_pad(_K, 7)})", f"concat('ABC', {_pad(_K, 7)})"),
    14: _pick(f"concat('SSN 123-45-', {_N4})", f"concat('123-456-', {_N4})", f"concat('x 987-65-', {_N4}, ', y')"),
    15: _pick(f"concat('number ', {_CARD})", f"concat(substr({_CARD}, 1, 4), ' ', substr({_CARD}, 5, 4), ' ', substr({_CARD}, 9, 4), ' ', substr({_CARD}, 13, 4))", f"concat('ISBN: ', {_CARD})"),
    16: _pick(f"concat('my card is ', {_CARD})", f"concat('Visa ', {_CARD}, ' and more')", f"concat('number ', {_CARD})"),
    17: _pick(f"concat('no ', {_AADHAAR})", f"concat(substr({_AADHAAR}, 1, 4), '-', substr({_AADHAAR}, 5, 4), '-', substr({_AADHAAR}, 9, 4))", f"concat('1', substr({_AADHAAR}, 2, 11))"),
    18: _pick(f"concat('XXXX XXXX ', {_N4})", f"concat('is xxxx-xxxx-', {_N4}, '.')", f"concat('XXX XXXX ', {_N4})"),
    19: _pick(f"concat('account number ', {_N12}, ' today')", f"concat('a/c no. XX', {_N6})", f"concat('account ', {_N4})", f"concat('acct ending in ', {_N6}, ', x')"),
    20: _pick(f"concat('DOB: ', {_K} % 28 + 1, '/04/1990')", f"concat('born on ', {_K} % 28 + 1, ' March 1988.')", f"concat('date ', {_K} % 28 + 1, '/04/1990')"),
    21: _pick(f"concat('at 2001:db8:0:0:0:0:0:', {_K} % 10000, ' now')", f"concat('2001:db8:0:0:0:', {_K} % 10000)", f"concat('x:2001:db8:0:0:0:0:0:', {_K} % 10000)"),
    22: _pick(f"concat('host 10.0.', {_K} % 300, '.7 up')", f"concat('version 1.2.', {_K} % 200, '.4')", f"concat('1.2.3.4.', {_K} % 9)", f"concat('192.168.1.', {_K} % 250, '.')"),
    23: _pick(f"concat('call 98765', {_N5})", f"concat('+91 9', {_N4}, ' ', {_N5}, ' today')", f"concat('order no 98765', {_N5})", f"concat('x98765', {_N5})", f"concat('PNR: 98765', {_N5})"),
    24: _pick(f"concat('call (022) 2345-', {_N4})", f"concat('+44 20 ', {_N4}, ' ', {_N4}, '.')", f"concat('ISBN 978-3-16-', {_N6}, '-0')", f"concat('on 2024-03-05 ', {_N4})", f"concat('sum ', {_N12})"),
    25: _pick(f"concat('Flat No. ', {_K} % 90, ', MG Road, Bengaluru 560', {_pad(f'{_K} % 1000', 3)})", f"concat({_K} % 90 + 1, ' Green Park Street, Pune')", f"concat({_K} % 90, ' apples on the Road')", "'House No. 7 Road'"),
    26: _pick(f"concat('zip code 560', {_pad(f'{_K} % 1000', 3)})", f"concat('PIN: 11', {_N4})", f"concat('pin 01', {_N4})", f"concat('Pincode - 400 ', {_pad(f'{_K} % 1000', 3)}, '.')"),
    27: _pick(f"concat('मेरा ओटीपी ', {_N6}, ' है')", f"concat('सत्यापन कोड: ', {_N4})", f"concat('कोड ', {_N6})"),
    28: _pick(f"concat('सीवीवी ', {_pad(f'{_K} % 1000', 3)})", f"concat('सुरक्षा कोड है ', {_N4}, '।')", f"concat('संख्या ', {_N4})"),
    29: _pick(f"concat('जन्म तिथि: ', {_K} % 28 + 1, '/04/1990')", f"concat('जन्मतिथि ', {_K} % 28 + 1, '-11-85 है')", f"concat('तिथि ', {_K} % 28 + 1, '/04/1990')"),
    30: _pick(f"concat('पिन कोड 560', {_pad(f'{_K} % 1000', 3)})", f"concat('डाक कोड: 11', {_N4})", f"concat('पिन 560', {_pad(f'{_K} % 1000', 3)})"),
    31: _pick(f"concat('खाता संख्या ', {_N12}, ' में')", f"concat('अकाउंट नंबर: ', {_N10})", f"concat('खाता ', {_N12})"),
    32: _pick("'श्री रोहन मेहता का फोन'", "'श्रीमती मीरा ने कहा'", "'डॉ. देव दिल्ली में'", "'कुमारी सना'", f"concat('रोहन ', {_K})"),
    33: _pick(f"concat('मकान नंबर ', {_K} % 90, ', गांधी मार्ग, जयपुर 302', {_pad(f'{_K} % 1000', 3)})", f"concat('फ्लैट ', {_K} % 90 + 1, ' शांति नगर')", "'मार्ग पर मकान'"),
    34: _pick("'दिल्ली में'", "'नई दिल्ली और मुंबई'", "'गांव में'", f"concat('पुणे ', {_K})"),
}

_LUHN = "list_sum(list_transform(range(length(d)), lambda i: CASE WHEN i % 2 = 0 THEN CAST(d[length(d) - i] AS INTEGER) ELSE (2 * CAST(d[length(d) - i] AS INTEGER)) % 10 + (2 * CAST(d[length(d) - i] AS INTEGER)) // 10 END)) % 10 = 0 AND length(d) BETWEEN 13 AND 19"
_D = "[" + ", ".join("[" + ", ".join(r) + "]" for r in checks.VERHOEFF_D) + "]"
_P = "[" + ", ".join("[" + ", ".join(r) + "]" for r in checks.VERHOEFF_P) + "]"
_VERHOEFF = f"length(d) = 12 AND d[1] BETWEEN '2' AND '9' AND list_reduce(list_prepend(0, list_transform(range(12), lambda i: ({_P})[i % 8 + 1][CAST(d[12 - i] AS INTEGER) + 1])), lambda c, x: ({_D})[c + 1][x + 1]) = 0"
_GSTIN_SUM = f"list_sum(list_transform(range(14), lambda i: ((instr('{checks.MOD36}', v[i + 1]) - 1) * (1 + i % 2)) // 36 + ((instr('{checks.MOD36}', v[i + 1]) - 1) * (1 + i % 2)) % 36))"
_WORDS = r"len(regexp_extract_all(v, '[^\t\n\x0B\f\r ]+'))"


def _quoted(s: str) -> str:
    return s.replace("'", "''")


_REFERENCE = _quoted(rules.RULES[23].not_after.pattern.removesuffix(r"\s*$"))
_REFERENCE_LATIN = _quoted(rules.RULES[24].not_after.pattern.removesuffix("$"))
#: What SQL tests of a value v (its digits are d, the text is t); every other rule's values need no test.
TESTS = {
    2: "NOT regexp_matches(v, '(?i)@(?:gmail|yahoo|outlook|hotmail)$')",
    3: "regexp_matches(v, '[^A-Za-z]|[a-z][A-Z]')",
    4: f"regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]') AND len(regexp_extract_all(v, '{rules.SWITCH}')) >= 6 AND NOT regexp_full_match(v, '[A-Z][a-z]+(?:[A-Z][a-z]+)+\\d*')",
    8: f"substr('{checks.MOD36}', CAST((36 - {_GSTIN_SUM} % 36) % 36 + 1 AS INTEGER), 1) = v[15]",
    12: "regexp_matches(t, '(?i)passport|travel|visa')",
    15: f"{_LUHN} AND NOT regexp_matches(t, '(?i)\\bISBN(?:-1[03])?:?\\s*' || regexp_escape(v))",
    17: _VERHOEFF,
    19: "length(d) >= 6",
    22: r"NOT regexp_matches(t, '(?i)(?:v|version|ver\.?)\s*' || regexp_escape(v))",
    23: f"NOT regexp_matches(t, '(?i)' || '{_REFERENCE}' || '\\s*' || regexp_escape(v))",
    24: rf"length(d) BETWEEN 10 AND 15 AND (regexp_matches(v, '[+()\-]') OR regexp_matches(v, '\s') AND length(d) <= 13) AND NOT regexp_matches(v, '^\d{{4}}-\d{{2}}-\d{{2}}') AND NOT regexp_matches(t, '(?i)' || '{_REFERENCE_LATIN}' || regexp_escape(v))",
    25: _WORDS + r" >= 3 OR regexp_matches(v, '[1-9]\d{2}\s?\d{3}')",
    31: "length(d) >= 6",
    33: _WORDS + r" >= 3 OR regexp_matches(v, '[1-9]\d{2}\s?\d{3}')",
}
#: Patterns with look-around, said with the neighbours as part of the match; the value is group 1.
_AROUND = {
    2: r"\b([A-Za-z0-9][A-Za-z0-9._-]{1,63}@(?:ok)?[A-Za-z]{2,15})(?:$|[^A-Za-z0-9_.@-]|[.@-](?:$|[^A-Za-z0-9_]))",
    4: r"\b([A-Za-z0-9_]{10,40})\b",
    21: r"(?:^|[^A-Za-z0-9_.:])([0-9a-fA-F]{1,4}(?::[0-9a-fA-F]{1,4}){7})(?:$|[^A-Za-z0-9_:])",
    22: r"(?:^|[^A-Za-z0-9_.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?:$|[^A-Za-z0-9_.]|\.(?:$|[^0-9]))",
    23: r"(?:^|[^A-Za-z0-9_+])((?:\+91[\s-]?|0)?[6-9]\d{4}[\s-]?\d{5})(?:$|[^0-9])",
    24: r"(?:^|[^A-Za-z0-9_])(\+?\d[\d\s().-]{7,}\d)(?:$|[^0-9])",
}
_TAIL = r"[\s,.;:-]+$"


def _values_sql(i: int) -> str:
    """The list of a rule's values in the text t."""
    rule = rules.RULES[i]
    if i == 32:  # one or two words; the second is none of the words that go on with the sentence, and no city
        first, second = f"{rules._HI_TITLE}\\s+({rules._HI})", f"{rules._HI_TITLE}\\s+{rules._HI}\\s+({rules._HI})"
        a, b = f"regexp_extract(t, '{first}', 1)", f"regexp_extract(t, '{second}', 1)"
        return f"CASE WHEN {a} = '' THEN [] WHEN {b} = '' OR regexp_full_match({b}, '{rules._HI_STOP}') OR regexp_matches({b}, '^{rules._HI_CITY}') THEN [{a}] ELSE [{a} || ' ' || {b}] END"
    pattern, group = (_AROUND[i], 1) if i in _AROUND else (rule.pattern.pattern, rule.group)
    flags = "(?i)" if rule.pattern.flags & 2 else ""
    return f"regexp_extract_all(t, '{_quoted(flags + pattern)}', {group})"


def _rule_sql(i: int) -> str:
    test = f"WHERE {TESTS[i]}" if i in TESTS else ""
    values = f"SELECT {_K}, t, regexp_replace(unnest({_values_sql(i)}), '{_TAIL}', '') AS v FROM (SELECT {_K}, {PROBES[i]} AS t FROM customer)"
    return f"SELECT {_K}, v AS \"value\", count(*) AS n FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM ({values}) WHERE v <> '') {test} GROUP BY ALL"


def _probe(spark: SparkSession, d: str, probe: str) -> DataFrame:
    return table(spark, d, "customer").select(_K, F.expr(probe).alias("t"))


def _rule(i: int):
    def query(spark: SparkSession, d: str) -> DataFrame:
        found = _probe(spark, d, PROBES[i]).select(_K, F.explode(rules.matched(F.col("t"), (i,))).alias("value"))
        return found.groupBy(_K, "value").agg(F.count("*").alias("n"))

    return query


def _name(i: int) -> str:
    return f"rule_{i:02d}_{rules.RULES[i].type.lower()}"


QUERIES = {_name(i): _rule(i) for i in PROBES}
ORACLE = {_name(i): _rule_sql(i) for i in PROBES}


# the union of all producers, offsets, known values and terms -----------------------------------------------------
def reversed_run(spark: SparkSession, d: str) -> DataFrame:
    """A mail address stored backwards behind a right-to-left override is read in order; its place is in the original."""
    hidden = _probe(spark, d, f"concat('to \u202e', reverse(concat('u', {_K}, '@mail.example')), '\u202c now')")
    return hidden.select(_K, F.explode(rules.detect(F.col("t"))).alias("s")).select(_K, "s.value", "s.start", F.col("s.end").alias("stop"))


def offset_map(spark: SparkSession, d: str) -> DataFrame:
    """Zero-width characters inside a value widen its place, not the value."""
    split = _probe(spark, d, f"concat('tö u\u200b', {_K}, '\u200d@mail.example now')")
    return split.select(_K, F.explode(rules.detect(F.col("t"))).alias("s")).select(_K, "s.value", "s.start", F.col("s.end").alias("stop"))


#: Values known beforehand and user terms of the queries below.
KNOWN = [("NAME", "lantern"), ("LOCATION", "red"), ("NAME", "no")]
TERMS = [("Code name", "falcon", False), ("ticket id", r"ZX\d{4}QT", True), ("broken", "(", True)]
_UNION = _pick(f"concat('Lantern and lanterns, x', {_K}, '@mail.example')", f"concat('red tape, ZX', {_N4}, 'QT, falcons')", f"concat('FALCON: ', base64(cast(concat('u', {_pad(_K, 5)}, '@mail.example') as binary)))", "'no redder light'")
_UNION_DUCK = _UNION.replace("cast(concat(", "encode(concat(").replace(" as binary)", ")")


def detect_union(spark: SparkSession, d: str) -> DataFrame:
    """Rules, known values, user terms and encoded values together."""
    found = _probe(spark, d, _UNION).select(_K, F.explode(rules.detect(F.col("t"), known=KNOWN, terms=TERMS)).alias("s"))
    return found.select(_K, "s.type", "s.value", "s.source")


def residual_check(spark: SparkSession, d: str) -> DataFrame:
    """Texts in which high-risk data is left; masked numbers do not count."""
    t = _probe(spark, d, _pick(f"concat('mail x', {_K}, '@mail.example')", f"concat('XXXX XXXX ', {_N4})", f"concat('zip code 560', {_pad(f'{_K} % 1000', 3)})", f"concat('SSN 123-45-', {_N4})", "'[EMAIL_1] said so'"))
    return t.select(_K, rules.has_residual(rules.detect(F.col("t"))).alias("is_left"))


def coarse_tokens(spark: SparkSession, d: str) -> DataFrame:
    """Every span becomes the coarse token of its type, all else stays."""
    t = _probe(spark, d, _COARSE)
    return t.select(_K, rules.apply_tokens(F.col("t"), rules.detect(F.col("t")), rules.coarse_token).alias("redacted"))


_COARSE = _pick(f"concat('A: x', {_K}, '@mail.example, PAN ABCPK', {_N4}, 'F; zip code 560', {_pad(f'{_K} % 1000', 3)}, '!')", f"concat('SSN 123-45-', {_N4}, ' / 987-65-', {_N4})", f"concat('nothing in ', {_K})")

_SCRUB = _pick(f"concat('mail x', {_K}, '@mail.example and y@z.example')", f"concat('id 123-45-', {_N4}, '.')", f"concat('card ', {_CARD}, '.')", f"concat('number ', {_AADHAAR}, ' x')", f"concat('ABCPK', {_N4}, 'F')", f"concat('pay u', {_K}, '@okaxis')", f"concat('ring 98765', {_N5}, '!')", f"concat('ring +1 (555) 010-', {_N4})", f"concat('only ', {_N4})")


def scrub_chain(spark: SparkSession, d: str) -> DataFrame:
    """The whole chain of the scrub over probes of every step, with its counts."""
    done = _probe(spark, d, _SCRUB).select(_K, scrub.scrub(F.col("t")).alias("s"))
    return done.select(_K, F.col("s.text").alias("scrubbed"), F.coalesce(F.aggregate(F.map_values("s.hits"), F.lit(0), lambda a, b: a + b), F.lit(0)).alias("hits"))


QUERIES |= {"n5_reversed_run": reversed_run, "n6_offset_map": offset_map, "detect_union": detect_union, "residual_check": residual_check, "coarse_tokens": coarse_tokens, "scrub_chain": scrub_chain}
_MAIL = f"'u' || {_K} || '@mail.example'"
ORACLE |= {
    "n5_reversed_run": f"SELECT {_K}, {_MAIL} AS \"value\", 4 AS start, CAST(4 + length({_MAIL}) AS INTEGER) AS stop FROM customer",
    "n6_offset_map": f"SELECT {_K}, {_MAIL} AS \"value\", 3 AS start, CAST(3 + length({_MAIL}) + 2 AS INTEGER) AS stop FROM customer",
    "detect_union": f"""WITH t AS (SELECT {_K}, {_UNION_DUCK} AS t FROM customer)
        SELECT {_K}, 'NAME' AS type, 'Lantern' AS "value", 'vault' AS source FROM t WHERE {_K} % 4 = 0 UNION ALL SELECT {_K}, 'EMAIL', regexp_extract(t, 'x\\d+@mail\\.example'), 'rule' FROM t WHERE {_K} % 4 = 0
        UNION ALL SELECT {_K}, 'LOCATION', 'red', 'vault' FROM t WHERE {_K} % 4 = 1 UNION ALL SELECT {_K}, 'TICKET_ID', regexp_extract(t, 'ZX\\d+QT'), 'custom' FROM t WHERE {_K} % 4 = 1
        UNION ALL SELECT {_K}, 'CODE_NAME', regexp_extract(t, '(?i)falcon'), 'custom' FROM t WHERE {_K} % 4 IN (1, 2) UNION ALL SELECT {_K}, 'EMAIL', decode(from_base64(regexp_extract(t, '[A-Za-z0-9+/=]+$'))), 'encoded' FROM t WHERE {_K} % 4 = 2""",
    "residual_check": f"SELECT {_K}, {_K} % 5 IN (0, 3) AS is_left FROM customer",
    "coarse_tokens": f"SELECT {_K}, CASE {_K} % 3 WHEN 0 THEN 'A: [REDACTED_EMAIL], PAN [REDACTED_ID]; zip code [REDACTED_ADDRESS]!' WHEN 1 THEN 'SSN [REDACTED_SSN] / [REDACTED_SSN]' ELSE 'nothing in ' || {_K} END AS redacted FROM customer",
    "scrub_chain": f"""SELECT {_K}, CASE WHEN k = 0 THEN 'mail [REDACTED_EMAIL] and [REDACTED_EMAIL]' WHEN k = 1 THEN 'id [REDACTED_SSN].' WHEN k = 2 AND luhn THEN 'card [REDACTED_CC].' WHEN k = 3 AND verhoeff THEN 'number [REDACTED_AADHAAR] x' WHEN k = 4 THEN '[REDACTED_PAN]'
        WHEN k = 5 THEN 'pay [REDACTED_UPI]' WHEN k = 6 THEN 'ring [REDACTED_PHONE]!' WHEN k = 7 THEN 'ring [REDACTED_PHONE]' ELSE t END AS scrubbed,
        CASE WHEN k = 0 THEN 2 WHEN k IN (1, 4, 5, 6, 7) OR k = 2 AND luhn OR k = 3 AND verhoeff THEN 1 ELSE 0 END AS hits
        FROM (SELECT *, {_LUHN} AS luhn, {_VERHOEFF} AS verhoeff FROM (SELECT {_K}, {_K} % 9 AS k, {_SCRUB} AS t, CASE WHEN {_K} % 9 = 2 THEN {_CARD} ELSE {_AADHAAR} END AS d FROM customer))""",
}


# all rules together over free text, by the other engine -----------------------------------------------------------
_SPECIALS = "".join(sorted(set(text.ZERO_WIDTH + text.BIDI)))
_FOLD = f"'{_quoted(text.HOMOGLYPHS + text.DEVANAGARI + text.FULLWIDTH + text.ZERO_WIDTH + text.BIDI)}', '{_quoted(text.HOMOGLYPHS_TO + '0123456789' + text.FULLWIDTH_TO)}'"


def _places_sql(i: int) -> str:
    """Rows (k, s, v, r) of one rule's values with their place in the flat text t: what lies before a match is counted from the pieces between matches."""
    rule = rules.RULES[i]
    pattern, group = (_AROUND[i], 1) if i in _AROUND else (rule.pattern.pattern, rule.group)
    if i == 32:  # the second word is looked at by itself
        pattern, group = f"{rules._HI_TITLE}\\s+({rules._HI}(?:\\s+{rules._HI})?)", 1
    p = _quoted(("(?i)" if rule.pattern.flags & 2 else "") + pattern)
    rows = f"SELECT k, t, unnest(regexp_extract_all(t, '{p}')) AS m, unnest(regexp_extract_all(t, '{p}', {group})) AS v0, unnest(list_transform(range(1, len(ps)), lambda x: CAST(coalesce(list_sum(list_transform(ps[1:x], lambda q: length(q))), 0) + coalesce(list_sum(list_transform(ms[1:x - 1], lambda q: length(q))), 0) AS BIGINT))) AS b FROM (SELECT k, t, regexp_split_to_array(t, '{p}') AS ps, regexp_extract_all(t, '{p}') AS ms FROM texts WHERE regexp_matches(t, '{p}'))"
    value = "v0"
    if i == 32:
        second = f"regexp_extract(v0, '\\s+({rules._HI})$', 1)"
        value = f"CASE WHEN {second} <> '' AND (regexp_full_match({second}, '{rules._HI_STOP}') OR regexp_matches({second}, '^{rules._HI_CITY}')) THEN regexp_extract(v0, '^{rules._HI}') ELSE v0 END"
    placed = f"SELECT k, t, CAST(b + length(m) - instr(reverse(m), reverse(v0)) - length(v0) + 1 AS BIGINT) AS s, regexp_replace({value}, '{_TAIL}', '') AS v FROM ({rows}) WHERE v0 <> ''"
    test = f" AND ({TESTS[i]})" if i in TESTS else ""
    return f"SELECT k, s, v, {i} AS r FROM (SELECT *, regexp_replace(v, '[^0-9]', '', 'g') AS d FROM ({placed})) WHERE v <> ''{test}"


def spans_sql(source: str) -> str:
    """CTEs up to ``spans`` (k, ord, start, "end", type, "value", weak): all rules over a relation (k, body), overlaps resolved.

    Encoded values and right-to-left runs, which need bytes and reversal, are left to the tests.
    """
    every = " UNION ALL ".join(_places_sql(i) for i in range(len(rules.RULES)))
    types, weak = [r.type for r in rules.RULES], [r.weak for r in rules.RULES]
    kept = f"CASE WHEN body = t OR length(body) = length(t) THEN range(0, length(body)) ELSE list_filter(range(0, length(body)), lambda i: instr('{_SPECIALS}', substr(body, i + 1, 1)) = 0) END"
    return f"""texts AS (SELECT k, translate(body, {_FOLD}) AS t, body FROM ({source})), found AS ({every}), lists AS (SELECT k, list([{{a: s, b: s + length(v), r: r, v: v}}] ORDER BY {weak}[r + 1], -length(v), r, s) AS l FROM found GROUP BY k),
        chosen AS (SELECT k, list_reduce(l, lambda acc, x: CASE WHEN len(list_filter(acc, lambda y: x[1].a < y.b AND y.a < x[1].b)) > 0 THEN acc ELSE list_concat(acc, x) END) AS c FROM lists), each AS (SELECT k, unnest(c) AS x FROM chosen), places AS (SELECT k, {kept} AS origin FROM texts WHERE k IN (SELECT k FROM chosen)),
        spans AS (SELECT e.k, CAST(row_number() OVER (PARTITION BY e.k ORDER BY x.a) - 1 AS INTEGER) AS ord, CAST(origin[x.a + 1] AS INTEGER) AS start, CAST(origin[x.b] + 1 AS INTEGER) AS "end", {types}[x.r + 1] AS type, x.v AS "value", {weak}[x.r + 1] AS weak FROM each e JOIN places p ON p.k = e.k)"""
