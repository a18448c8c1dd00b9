import base64

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from shroudline.operators import rules


def kinds(text, **options):
    return [s[2] for s in rules.all_spans(text, **options)]


#: A number with the right check digit.
AADHAAR = next(f"2341 2341 234{c}" for c in "0123456789" if rules.aadhaar(f"23412341234{c}"))


@pytest.mark.parametrize(
    "text, want",
    [
        ("mail priya@example.com now", ["EMAIL"]), ("card 4111 1111 1111 1111", ["CC"]), ("number 4111 1111 1111 1112", []), ("aadhaar " + AADHAAR, ["AADHAAR"]), ("123412341234", []), ("PAN ABCPK1234F", ["PAN"]),
        ("pay to priya@okaxis today", ["UPI"]), ("OTP is 482913", ["OTP"]), ("DL KA-01-2011-1234567", ["DRIVING_LICENSE"]), ("order no 9876543210", []), ("call +91 98765 43210", ["PHONE"]), ("ISBN: 978-3-16-148410-0", []),
        ("at 10.0.0.1, version 1.2.3.4", ["IP"]), ("zip code 560001", ["PINCODE"]), ("born on 12/04/1990", ["DOB"]), ("Flat No. 12, MG Road, Bengaluru 560001", ["ADDRESS"]), ("é123-45-6789", ["SSN"]), ("मेरा ओटीपी ४८२९१३ है", ["OTP"]),
        ("श्री रोहन मेहता का फोन", ["NAME"]), ("दिल्ली में", ["LOCATION"]), ("", []), (None, []), ("XXXX XXXX 1234", ["AADHAAR"]), ("account number 123456789012", ["BANK_ACCOUNT"]), ("password is hunter2 horse", ["PASSWORD"]),
    ],
)
def test_goldens(text, want):
    assert kinds(text) == want


@pytest.mark.parametrize("text", ["pri​ya@ex​ample.com", "рriуа@example.com", "ｐｒｉｙａ＠ｅｘａｍｐｌｅ．ｃｏｍ", "‮moc.elpmaxe@ayirp‬"])
def test_evasions(text):
    (span,) = rules.all_spans(text)
    assert span[2] == "EMAIL" and span[3] == "priya@example.com"
    assert span[1] - span[0] >= len("priya@example.com")


def test_encoded_known_and_custom():
    hidden = base64.b64encode(b"priya@example.com").decode()
    assert rules.all_spans("x " + hidden)[0][2:5] == ("EMAIL", "priya@example.com", "encoded")
    assert rules.all_spans("x " + b"priya@example.com".hex())[0][4] == "encoded"
    assert kinds("Falcon meets falcons", known=[("NAME", "falcon")]) == ["NAME"]
    assert kinds("नमस्ते देवराज", known=[("NAME", "देवराज")]) == ["NAME"]
    assert kinds("Project Falcon, falconry E-1234", terms=[("code name", "falcon", False), ("badge", r"E-\d+", True), ("bad", "(", True)]) == ["CODE_NAME", "CODE_NAME", "BADGE"]
    ner = lambda t: [(0, 9, "NAME", t[:9], "ner", False)]
    assert kinds("ab@cd.example", ner=ner) == ["EMAIL"]


def test_tags_of_a_column_become_spans(spark):
    df = spark.createDataFrame([(1, "Rohan met ab@cd.example in Pune", [(0, 5, "PER"), (10, 23, "person"), (27, 31, "loc"), (6, 9, "MISC"), (5, 99, "PER")]), (2, "x", None), (3, None, None)], "id int, t string, tags array<struct<start:int,`end`:int,label:string>>")
    got = {r.id: [(s.type, s.value, s.source) for s in r.s or []] for r in df.select("id", rules.detect(F.col("t"), ner=F.col("tags")).alias("s")).collect()}
    assert got == {1: [("NAME", "Rohan", "ner"), ("EMAIL", "ab@cd.example", "rule"), ("LOCATION", "Pune", "ner")], 2: [], 3: []}


@pytest.mark.parametrize("text", ["Ab1Cd2Ef3", "userId2Name9", "x9Yz8Wv7Ut6", "MyVar1Name2"])
def test_changes_of_kind_do_not_overlap(text):
    assert "SECRET" not in kinds(text)
    assert kinds("aB3dE6gH9jK2") == ["SECRET"]


def test_tokens_are_put_in_by_slices(spark):
    df = spark.createDataFrame([("a x@y.example b x@z.example",), ("none",), ("",), ("x@y.example",)], "t string")
    spans = rules.detect(F.col("t"))
    got = [r.r for r in df.select(rules.apply_tokens(F.col("t"), spans, rules.coarse_token).alias("r")).collect()]
    assert got == ["a [REDACTED_EMAIL] b [REDACTED_EMAIL]", "none", "", "[REDACTED_EMAIL]"]


def test_checks_agree_with_columns(spark):
    from shroudline.functions import checks

    values = ["4111111111111111", "4111 1111 1111 1112", "234123412346", "123412341234", "", "00", "29ABCPK1234F1Z5", "x"]
    df = spark.createDataFrame([(v,) for v in values], "v string")
    for row in df.select("v", checks.luhn_valid(F.col("v")).alias("l"), checks.verhoeff_valid(F.col("v")).alias("w"), checks.aadhaar_valid(F.col("v")).alias("a"), checks.gstin_valid(F.col("v")).alias("g")).collect():
        assert (row.l, row.w, row.a, row.g) == (rules.luhn(row.v), rules.verhoeff(row.v), rules.aadhaar(row.v), rules.gstin(row.v)), row.v


spans = st.lists(st.tuples(st.integers(0, 30), st.integers(1, 10), st.booleans(), st.sampled_from(["rule", "ner"])), max_size=8)


@settings(max_examples=100, deadline=None)
@given(spans)
def test_resolution_leaves_no_overlap_and_nothing_that_fits(raw):
    given_spans = [(a, a + n, "X", "v", source, weak) for a, n, weak, source in raw]
    kept = rules.resolve(given_spans)
    assert all(x[1] <= y[0] for x, y in zip(kept, kept[1:]))
    for s in given_spans:
        assert any(s[0] < k[1] and k[0] < s[1] for k in kept)


def test_native_resolution_is_the_same(spark):
    import random

    random.seed(4)
    rows = []
    for i in range(60):
        rows.append((i, [(a := random.randint(0, 30), a + random.randint(1, 10), "X", str(k), random.choice(["rule", "ner"]), random.random() < 0.3) for k in range(random.randint(0, 7))]))
    df = spark.createDataFrame(rows, f"id int, spans array<{rules.SPAN}>")
    for row, (_, given_spans) in zip(df.select("id", rules.resolve_overlaps(F.col("spans")).alias("k")).orderBy("id").collect(), rows):
        assert [tuple(s) for s in row.k] == rules.resolve(given_spans)


def test_tokens_replace_right_to_left(spark):
    df = spark.createDataFrame([("a@b.example and c@d.example, 123-45-6789",), ("nothing",), (None,)], "t string").withColumn("spans", rules.detect(F.col("t")))
    got = [r.x for r in df.select(rules.apply_tokens(F.col("t"), F.col("spans"), rules.coarse_token).alias("x")).collect()]
    assert got == ["[REDACTED_EMAIL] and [REDACTED_EMAIL], [REDACTED_SSN]", "nothing", None]
    assert [r.x for r in df.select(rules.has_residual(F.col("spans")).alias("x")).collect()] == [True, False, False]


plain = st.text(alphabet=st.characters(codec="ascii", exclude_categories=("Cc",)), max_size=80)


@settings(max_examples=150, deadline=None)
@given(plain)
def test_span_values_are_slices_of_plain_text(text):
    for start, end, _, value, source, _ in rules.all_spans(text):
        if source == "rule":
            assert text[start:end] == value
