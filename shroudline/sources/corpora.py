"""Gold corpora made by rule: sentences with known personal data, and hard negatives that only look like it.

Sentences are templates whose slots are filled from a generator with a fixed seed, so the corpus is the same everywhere;
every slot's place is known, so no gold is ever written by hand.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shroudline.functions import checks
from shroudline.operators import rules

#: Sentences of the first corpus: slots in braces are gold, all else is not.
INDIAN = (
    "Please write to {EMAIL} before Friday.", "My new number is {PHONE}, call after six.", "PAN of the firm: {PAN}.", "Her Aadhaar is {AADHAAR}, kindly verify.", "Send the rent to {UPI} by the fifth.", "GSTIN {GSTIN} stands on the bill.",
    "The OTP is {OTP} and ends in ten minutes.", "Use card {CC} for the tickets.", "His passport {PASSPORT} was renewed for the travel.", "Licence {DRIVING_LICENSE} was seized.", "Deliver to {ADDRESS}", "The account number {BANK_ACCOUNT} gets the refund.",
    "She was born on {DOB} in the hills.", "The server answers at {IP} only.", "zip code {PINCODE} is served.", "{NAME} will chair the meeting.", "Ask {NAME} about the keys.", "The parcel for {NAME} came back.", "{LOCATION} gets rain today.", "We moved to {LOCATION} last year.",
    "Reach {NAME} at {EMAIL} or {PHONE}.", "{NAME} of {LOCATION} signed twice.", "CVV {CVV} stands on the back.", "Voter ID {VOTER_ID} was on the list.",
)
#: Sentences that hold nothing personal although they look like it.
INDIAN_NEGATIVE = (
    "Order no {n10} left the store.", "The film got {n6} views in a day.", "ISBN 978-3-16-{n6}-0 is out of print.", "Version 10.{d}.{d}.{d} fixes it.", "Flight AI-{n3} leaves at 10:{d}5.", "The mission flew on 2023-08-2{d}.",
    "Train {n5} runs late by {d} hours.", "IFSC codes have four letters first.", "A score of {d}{d} out of 100.", "Room {n3} on floor {d}.", "The invoice ref {n10} is paid.", "It weighs {n4} grams, costs {n3} rupees.",
)
HINDI = (
    "मेरा फोन {PHONE} है।", "कृपया {EMAIL} पर लिखें।", "आधार {AADHAAR} की जाँच करें।", "आपका ओटीपी {OTP} है।", "सीवीवी {CVV} किसी को न बताएँ।", "जन्म तिथि {DOB} लिखी है।", "पिन कोड {PINCODE} में वितरण है।", "श्री {NAME} आज आएँगे।", "श्रीमती {NAME} ने कहा।", "{LOCATION} में वर्षा है।", "खाता संख्या {BANK_ACCOUNT} में भेजें।", "पैन {PAN} लगेगा।",
)
HINDI_NEGATIVE = ("पुस्तक के {n3} पृष्ठ हैं।", "ऑर्डर नंबर {n10} भेज दिया।", "मैच में {n3} रन बने।", "गाड़ी {n5} देर से चली।", "कमरा {n3} खाली है।")
_FIRST, _LAST = ("Asha", "Rohan", "Divya", "Kabir", "Meera", "Nikhil"), ("Gupta", "Nair", "Reddy", "Joshi", "Kapoor", "Thakur")
_HI_NAME, _HI_CITY = ("रोहन मेहता", "मीरा जोशी", "देव कपूर", "सना नायर"), ("दिल्ली", "मुंबई", "पुणे", "जयपुर")
_CITY = ("Pune", "Kochi", "Indore", "Mysuru")
_SLOT = re.compile(r"\{(\w+)\}")


class Draws:
    """Numbers of a multiplicative generator with a fixed seed."""

    def __init__(self, seed: int) -> None:
        self.state = seed

    def below(self, n: int) -> int:
        self.state = self.state * 48271 % 2147483647
        return self.state % n

    def digits(self, n: int, first: str = "0123456789") -> str:
        return first[self.below(len(first))] + "".join(str(self.below(10)) for _ in range(n - 1))

    def pick(self, values) -> str:
        return values[self.below(len(values))]


def _checked(stem: str, alphabet: str, valid) -> str:
    return next(stem + c for c in alphabet if valid(stem + c))


def value(kind: str, d: Draws, hindi: bool = False) -> str:
    """A made-up value of a kind; checksums hold."""
    if kind == "AADHAAR":
        v = _checked(d.digits(11, "23456789"), "0123456789", rules.aadhaar)
        return f"{v[:4]} {v[4:8]} {v[8:]}"
    if kind == "CC":
        return _checked("4" + d.digits(14), "0123456789", rules.luhn)
    if kind == "GSTIN":
        return _checked(f"29ABCPK{d.digits(4)}F1Z", checks.MOD36, rules.gstin)
    made = {
        "EMAIL": lambda: f"{d.pick(_FIRST)}.{d.pick(_LAST)}{d.below(90)}@mail.example".lower(), "PHONE": lambda: f"+91 {d.digits(5, '6789')} {d.digits(5)}", "PAN": lambda: f"ABCPK{d.digits(4)}{d.pick('ABCDEF')}", "UPI": lambda: f"{d.pick(_FIRST).lower()}{d.below(99)}@okaxis",
        "OTP": lambda: d.digits(6, "123456789"), "CVV": lambda: d.digits(3), "PASSPORT": lambda: f"K{d.digits(6, '123456789')}{d.digits(1, '123456789')}", "DRIVING_LICENSE": lambda: f"KA-{d.digits(2)}-2011-{d.digits(7)}", "ADDRESS": lambda: f"Flat No. {d.below(90) + 1}, MG Road, {d.pick(_CITY)} {d.digits(6, '123456789')}",
        "BANK_ACCOUNT": lambda: d.digits(12, "123456789"), "DOB": lambda: f"{d.below(28) + 1:02d}/{d.below(12) + 1:02d}/19{d.below(40) + 60}", "IP": lambda: f"10.{d.below(255)}.{d.below(255)}.{d.below(255)}", "PINCODE": lambda: d.digits(6, "12345678"), "VOTER_ID": lambda: f"ABC{d.digits(7)}",
        "NAME": lambda: d.pick(_HI_NAME) if hindi else f"{d.pick(_FIRST)} {d.pick(_LAST)}", "LOCATION": lambda: d.pick(_HI_CITY if hindi else _CITY), "d": lambda: str(d.below(10)), "n3": lambda: d.digits(3, "123456789"), "n4": lambda: d.digits(4, "123456789"), "n5": lambda: d.digits(5, "123456789"), "n6": lambda: d.digits(6, "123456789"), "n10": lambda: d.digits(10, "6789"),
    }
    return made[kind]()


def sentences(name: str, count: int, templates: tuple[str, ...], d: Draws) -> list[tuple]:
    """(corpus, sent_id, text, gold) of ``count`` sentences, the templates in turn."""
    out = []
    for i in range(count):
        text, gold, at = "", [], 0
        template = templates[i % len(templates)]
        for m in _SLOT.finditer(template):
            text += template[at : m.start()]
            v = value(m[1], d, name == "hindi")
            if m[1].isupper():
                gold.append((len(text), len(text) + len(v), m[1]))
            text += v
            at = m.end()
        out.append((name, i, text + template[at:], gold))
    return out


GOLD = "corpus string, sent_id int, text string, gold array<struct<start:int,`end`:int,type:string>>"


def corpora(spark: SparkSession, seed: int = 26171) -> DataFrame:
    """Both corpora: 360 and 150 sentences, a third of them hard negatives."""
    d = Draws(seed)
    return spark.createDataFrame(sentences("indian", 360, INDIAN + INDIAN_NEGATIVE, d) + sentences("hindi", 150, HINDI + HINDI_NEGATIVE, d), GOLD)


def read_corpus(spark: SparkSession, path: str, first: int, schema: str = GOLD) -> DataFrame:
    """The first lines of a JSON-lines corpus in the order of the file, lines that cannot be read left out."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).limit(first)


def write_corpus(corpus: DataFrame, path: str) -> None:
    corpus.write.mode("overwrite").json(path)


def predictions(corpus: DataFrame) -> DataFrame:
    """(corpus, sent_id, text, gold, found) with the spans of all rules."""
    found = F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["type"].alias("type")))
    return corpus.withColumn("spans", rules.detect(F.col("text"))).withColumn("found", found).drop("spans")
