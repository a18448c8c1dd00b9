"""One consistent form for texts that look the same.

Steps: compatibility normalisation of width, ligatures and kinds of space (superscripts, fractions, circled and styled
forms look different and stay); deletion of ignorable characters; composition of accents; then a Viterbi search over
each token's lattice of look-alike letters.  A letter's candidates are all letters of its look-alike class, so two
tokens that look the same have the same lattice; the path is scored by script-wise character bigrams counted over the
whole corpus, with a penalty for every change of script and a bonus for the script of the text's unambiguous letters.
Path and scores depend on the lattice only, hence equal lattices always come out as equal tokens.

Defined results: a null text stays null; a text of ignorable characters and spaces only becomes empty and takes part in
no pair; runs of spaces keep their length; case, accents and words count; an empty corpus gives an empty model, with
which Latin letters win.  Only the named columns are read.
"""

from __future__ import annotations

import math
import unicodedata
import uuid
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudline.session import cut

#: Letters of the same shape, Latin letter first, then its Cyrillic and Greek twins.
LOOKALIKES = """
aа cсϲ dԁ eе gɡ hһ iі jјϳ oоο pрρ qԛ sѕ vνѵ wԝ xх yу
AАΑ BВΒ CСϹ EЕΕ FϜ HНΗ IІΙӀ JЈͿ KКΚ MМΜ NΝ OОΟ PРΡ QԚ SЅ TТΤ VѴ WԜ XХΧ YҮΥ ZΖ
""".split()
#: Characters without width or effect on a line of text.
IGNORABLE = "".join(map(chr, [0x00AD, 0x034F, 0x061C, 0x115F, 0x1160, 0x17B4, 0x17B5, *range(0x180B, 0x1810), *range(0x200B, 0x2010), *range(0x202A, 0x202F), *range(0x2060, 0x2070), 0x3164, *range(0xFE00, 0xFE10), 0xFEFF, 0xFFA0]))
_SPACES = "\t\n\v\f\r\u0085\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
#: Decompositions that change width, joining or space but not what is read.
_SAME = ("<wide>", "<narrow>", "<noBreak>")
_LIGATURES = range(0xFB00, 0xFB07)
_HYPHENS = {0x2010: "-", 0x2011: "-"}
_MEMO = 200_000

CLASS = {letter: group[0] for group in LOOKALIKES for letter in group}
MEMBERS = {group[0]: tuple(group) for group in LOOKALIKES}


@lru_cache(maxsize=8192)
def script(letter: str) -> str:
    """L, C, G for the scripts with look-alikes, O for other letters, empty for the rest."""
    if not letter.isalpha():
        return ""
    name = unicodedata.name(letter, "")
    return {"LATIN": "L", "CYRILLIC": "C", "GREEK": "G"}.get(name.split(" ")[0], "O")


class _Simple(dict):
    """Character -> plain form, filled as characters are met."""

    def __missing__(self, code: int) -> str:
        ch = chr(code)
        if ch in _SPACES:
            out = " "
        elif ch in IGNORABLE:
            out = ""
        elif code in _HYPHENS:
            out = _HYPHENS[code]
        elif code in _LIGATURES or unicodedata.decomposition(ch).split(" ")[0] in _SAME:
            out = unicodedata.normalize("NFKC", ch)
        else:
            out = ch
        self[code] = out
        return out


_simple = _Simple()


def plain(text: str) -> str:
    """Width, ligatures, spaces and ignorable characters out of the way; accents decomposed."""
    if text.isascii():
        return text if text.isprintable() else text.translate(_simple)
    return unicodedata.normalize("NFD", text.translate(_simple))


def skeleton(token: str) -> str:
    return "".join([CLASS.get(c, c) for c in token])


class Lattice:
    """Viterbi over look-alike lattices under script-wise character bigrams."""

    SWITCH, HOME = -9.0, 6.0

    def __init__(self, counts: dict[str, int]) -> None:
        totals: Counter = Counter()
        for pair, n in counts.items():
            totals[pair[0]] += n
        self.logs = {pair: math.log((n + 0.1) / (totals[pair[0]] + 10.0)) for pair, n in counts.items()}
        self.unseen = {c: math.log(0.1 / (n + 10.0)) for c, n in totals.items()}
        self.memo: dict[tuple[str, str], str] = {}

    def _step(self, a: str, b: str) -> float:
        found = self.logs.get(a + b)
        return found if found is not None else self.unseen.get(a, -6.0)

    def path(self, shape: str, home: str) -> str:
        """The best spelling of a skeleton token in a text whose unambiguous letters are of the script ``home``."""
        bonus = self.HOME if all(c in MEMBERS or not script(c) for c in shape) else 0.0  # a sure letter decides by itself
        states: dict[str, tuple[float, str, str]] = {"": (0.0, "", "^")}  # last script -> score, spelling, last letter
        for ch in shape:
            nxt: dict[str, tuple[float, str, str]] = {}
            for letter in MEMBERS.get(ch, (ch,)):
                own = script(letter)
                for before, (score, spelt, last) in states.items():
                    new = score + (self._step(last, letter) if own else 0.0)
                    if own and before and own != before:
                        new += self.SWITCH
                    if own and own == home:
                        new += bonus
                    now = own or before
                    if now not in nxt or new > nxt[now][0]:
                        nxt[now] = (new, spelt + letter, letter if own else last)
            states = nxt
        return max(states.items(), key=lambda s: (s[1][0], s[0]))[1][1]

    def canonical(self, text: str) -> str:
        shapes = [skeleton(w) for w in plain(text).split(" ")]
        sure = Counter(script(c) for w in shapes for c in w if c not in MEMBERS and script(c) in ("L", "C", "G")) if not text.isascii() else {"L": 1}
        home = max(sorted(sure), key=sure.get) if sure else "L"
        memo, out = self.memo, []
        for shape in shapes:
            got = memo.get((shape, home))
            if got is None:
                if len(memo) >= _MEMO:
                    memo.clear()
                got = memo[shape, home] = self.path(shape, home)
            out.append(got)
        joined = " ".join(out)
        return joined if joined.isascii() else unicodedata.normalize("NFC", joined)


def _token_pairs(tokens: Counter) -> Counter:
    pairs: Counter = Counter()
    for token, n in tokens.items():
        letters = unicodedata.normalize("NFD", token) if not token.isascii() else token
        scripts = {script(c) for c in letters} - {""}
        if len(scripts) == 1:  # only tokens of one script tell what is usual in that script
            last = "^"
            for c in letters:
                if script(c):
                    pairs[last + c] += n
                    last = c
    return pairs


def bigram_counts(texts: DataFrame, text: str = "text") -> DataFrame:
    """(pair, n) over all texts: partial counts in every task, one small aggregation."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs: Counter = Counter()
        for batch in batches:
            tokens: Counter = Counter()
            for t in batch.column(0).to_pylist():
                tokens.update(t.split())
            pairs.update(_token_pairs(tokens))
        yield pa.RecordBatch.from_arrays([pa.array(pairs.keys(), pa.string()), pa.array(pairs.values(), pa.int64())], names=["pair", "n"])

    return texts.select(F.col(text).alias("text")).where("text is not null").mapInArrow(count, "pair string, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


#: Pairs of letters of one script: bounded by the alphabets, not by the rows; checked all the same.
MOST_PAIRS = 2_000_000


def train(texts: DataFrame, text: str = "text") -> dict[str, int]:
    rows = bigram_counts(texts, text).take(MOST_PAIRS + 1)
    if len(rows) > MOST_PAIRS:
        raise ValueError("more letter pairs than any set of alphabets has")
    return {r.pair: r.n for r in rows}


_lattices: dict[str, Lattice] = {}


def _lattice(shared) -> Lattice:
    """One lattice (with its memo) per Python worker and model."""
    if shared.id not in _lattices:
        _lattices.clear()
        _lattices[shared.id] = Lattice(shared.counts.value)
    return _lattices[shared.id]


class _Shared:
    def __init__(self, spark, counts: dict[str, int]) -> None:
        self.counts = spark.sparkContext.broadcast(counts)
        self.id = uuid.uuid4().hex


def canonical_texts(df: DataFrame, counts: dict[str, int], keys: list[str], text: str = "text") -> DataFrame:
    """The key columns, the text, and its consistent form ``canonical``."""
    shared = _Shared(df.sparkSession, counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = _lattice(shared)
        for batch in batches:
            done = [None if t is None else lattice.canonical(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(done, pa.string())], names=[*batch.schema.names, "canonical"])

    source = df.select(*keys, F.col(text).alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema.fields)
    return source.mapInArrow(run, f"{schema}, canonical string")


def spellings(nodes: DataFrame, counts: dict[str, int], key: str = "node_pk", group: str = "page_id", text: str = "text") -> DataFrame:
    """(node, grp, form, spelling) of every node whose form is spelled in more than one way in its group.

    The corpus is searched once: digests of 64 bits, compared only within one group, are written, and forms spelled in
    one way only are dropped before anything is paired.
    """
    rows = nodes.where(F.col(key).isNotNull() & F.col(group).isNotNull() & F.col(text).isNotNull()).select(F.col(key).alias("node"), F.col(group).alias("grp"), F.col(text).alias("text"))
    done = canonical_texts(rows, counts, ["node", "grp"]).where(F.trim("canonical") != "")
    slim = cut(done.select("node", "grp", F.xxhash64("canonical").alias("form"), F.xxhash64("text").alias("spelling")))
    several = slim.groupBy("grp", "form").agg(F.min("spelling").alias("s0"), F.max("spelling").alias("s1")).where("s0 != s1").select("grp", "form")
    return slim.join(several, ["grp", "form"], "left_semi")


def same_looking(nodes: DataFrame, counts: dict[str, int], key: str = "node_pk", group: str = "page_id", text: str = "text") -> DataFrame:
    """(node_a, node_b): nodes of one group whose texts differ and have one consistent form.

    Classes of equal spellings are paired, and only then are their members put in: copies of one spelling never meet.
    """
    kept = cut(spellings(nodes, counts, key, group, text))
    classes = kept.groupBy("grp", "form", "spelling").agg(F.count("*").alias("members"))
    other = classes.select("grp", "form", F.col("spelling").alias("other"))
    pairs = classes.join(other, ["grp", "form"]).where("spelling < other").select("grp", "form", "spelling", "other")
    second = kept.select("grp", "form", F.col("spelling").alias("other"), F.col("node").alias("b"))
    met = pairs.join(kept, ["grp", "form", "spelling"]).join(second, ["grp", "form", "other"])
    return met.select(F.least("node", "b").alias("node_a"), F.greatest("node", "b").alias("node_b")).where("node_a < node_b")
