"""Text decoded with the wrong character encoding.

A multinomial classifier on hashed byte bigrams predicts the exact chain of a passage's wrong decoding, or that it is
clean.  It is fitted here on the corpus' own words, all of them, as they stand and garbled synthetically by every chain:
Spark counts the words of all rows, and then the hashed n-grams of each class, a table of fixed size.  The predicted
chain is inverted and counts only if every step decodes strictly and the outcome is made of letters and marks a text in
European languages would hold.  Where no chain gives that, a chain with a UTF-8 step may give assigned letters, marks,
digits and signs of any script (two of them are proof enough); a word of letters in a regular case must then be as
surely garbled as for a single-byte chain.  Passages are whole words with characters outside ASCII.

Chains of single-byte encodings, for which any word decodes, need more: log-odds above what held-out clean words of the
corpus reach for that chain, a word whose restored form the corpus holds more often than the word as it stands, and two
such words of one document that agree (or one very sure word).  Words as they stand whose restored form is the more usual
one are not taught as clean.

Defined results: null, empty and ASCII texts are clean; a text with replacement characters inside or instead of words is
garbled but cannot be restored there, so those characters stay; a garbled word that does not invert strictly stays as it
is, its document is found by its other words; in a document found by a single-byte chain, words whose restored form the
corpus does not hold are restored too, those that stand more often than they are restored are not; repeated rows are
judged one by one; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
import unicodedata
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shroudline.session import cut

DIMS = 1 << 14
#: Words one worker remembers, and the longest it remembers.
_MEMO, _MEMO_WORD = 200_000, 100

#: Chains: the encodings a text was written in and wrongly read as, step by step.
CHAINS = {
    "utf8>latin1": (("utf-8", "latin-1"),),
    "utf8>cp1252": (("utf-8", "cp1252"),),
    "utf8>cp437": (("utf-8", "cp437"),),
    "utf8>cp850": (("utf-8", "cp850"),),
    "utf8>mac_roman": (("utf-8", "mac_roman"),),
    "utf8>cp1251": (("utf-8", "cp1251"),),
    "utf8>cp1250": (("utf-8", "cp1250"),),
    "utf8>koi8_r": (("utf-8", "koi8_r"),),
    "utf8>cp866": (("utf-8", "cp866"),),
    "utf8>latin1 twice": (("utf-8", "latin-1"), ("utf-8", "latin-1")),
    "utf8>cp1252 twice": (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "utf8>cp1252>latin1": (("utf-8", "cp1252"), ("utf-8", "latin-1")),
    "utf8>latin1>cp1252": (("utf-8", "latin-1"), ("utf-8", "cp1252")),
    "utf8>cp1252 thrice": (("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")),
    "cp1251>cp1252": (("cp1251", "cp1252"),),
    "koi8_r>cp1252": (("koi8_r", "cp1252"),),
    "koi8_r>cp1251": (("koi8_r", "cp1251"),),
    "cp1251>koi8_r": (("cp1251", "koi8_r"),),
    "cp866>cp1251": (("cp866", "cp1251"),),
    "cp1251>cp866": (("cp1251", "cp866"),),
    "cp1250>cp1252": (("cp1250", "cp1252"),),
    "latin2>latin1": (("iso8859_2", "latin-1"),),
    "cp1252>cp1250": (("cp1252", "cp1250"),),
    "latin1>cp437": (("latin-1", "cp437"),),
    "cp1252>mac_roman": (("cp1252", "mac_roman"),),
    "mac_roman>cp1252": (("mac_roman", "cp1252"),),
}
CLEAN = "clean"
NAMES = (CLEAN, *CHAINS)
#: Chains with a UTF-8 step reveal themselves by decoding strictly; the others need more evidence.
_SURE = frozenset(name for name in CHAINS if name.startswith("utf8"))
#: Log-odds a single-byte chain needs over clean: for two words of a document together, and for one alone.
TOGETHER, ALONE = 6.0, 14.0


@lru_cache(maxsize=32)
def _table(encoding: str) -> tuple[tuple[str, ...], dict[str, int]]:
    """Bytes as characters, undefined bytes as control characters, and the inverse."""
    chars = tuple(bytes([b]).decode(encoding, "ignore") or chr(b) for b in range(256))
    return chars, {c: b for b, c in enumerate(chars)}


def garble(text: str, chain: str) -> str | None:
    for source, wrong in CHAINS[chain]:
        try:
            raw = text.encode(source)
        except UnicodeEncodeError:
            return None
        chars, _ = _table(wrong)
        text = "".join([chars[b] for b in raw])
    return text


def invert(text: str, chain: str) -> str | None:
    """The text before the chain; null unless every step encodes and decodes strictly."""
    for source, wrong in reversed(CHAINS[chain]):
        _, back = _table(wrong)
        try:
            text = bytes([back[c] for c in text]).decode(source)
        except (KeyError, UnicodeDecodeError):
            return None
    return text


@lru_cache(maxsize=8192)
def _usual(c: str) -> bool:
    """A character that a text in European languages may hold."""
    code = ord(c)
    if code < 0x80:
        return code >= 0x20 or c in "\t\n\r"
    kind = unicodedata.category(c)
    if kind[0] == "L":
        return code < 0x530 and kind != "Lm" and not 0x1BB <= code <= 0x24F and not 0x460 <= code <= 0x48F or 0x1E00 <= code < 0x2000
    return kind[0] in "PSZ" and (code < 0x2600 or 0x3000 <= code < 0x3020) or 0x300 <= code < 0x370 or code >= 0x1F300


def plausible(text: str) -> bool:
    return all(_usual(c) for c in text) and any(ord(c) > 0x7F for c in text)


def natural(word: str) -> bool:
    """Letters alone, in a regular case: a word that stands as it is, though its bytes may decode."""
    letters = "".join([c for c in word if c.isalpha() or c > "\x7f"])
    return letters.isalpha() and (letters.islower() or letters.isupper() or letters.istitle())


def assigned(text: str) -> bool:
    """Holds characters outside ASCII, all of them assigned letters, marks after something, digits or signs of any script."""
    before = "Z"
    for c in text:
        kind = unicodedata.category(c)[0]
        if kind == "C" and c not in "\t\n\r\u200b\u200c\u200d\u200e\u200f\ufeff" or kind == "M" and before == "Z":
            return False
        before = kind
    return not text.isascii()


_FOREIGN = re.compile(r"[^\x00-\x7f]+")
_SPACE = re.compile(r"[ \t\n\r]")


def passages(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of every word with characters outside ASCII."""
    at = 0
    while (m := _FOREIGN.search(text, at)) is not None:
        begin = max(text.rfind(" ", at, m.start()), text.rfind("\n", at, m.start()), text.rfind("\t", at, m.start()), text.rfind("\r", at, m.start()), at - 1) + 1
        stop = _SPACE.search(text, m.end())
        at = stop.start() if stop else len(text)
        yield begin, at


def core(word: str) -> str:
    """The word's part around its characters outside ASCII, with up to three ASCII letters on either side."""
    first = _FOREIGN.search(word)
    last = len(word)
    while last and word[last - 1] < "\x80":
        last -= 1
    return word[max(0, first.start() - 3) : last + 3]


def hashed(word: str) -> list[int]:
    raw = b"\x02" + core(word).encode("utf-8", "surrogatepass") + b"\x03"
    return [zlib.crc32(raw[i : i + 2]) & (DIMS - 1) for i in range(len(raw) - 1)] + [zlib.crc32(raw[i : i + 4]) & (DIMS - 1) for i in range(len(raw) - 3)]


class Classifier:
    """Multinomial naive Bayes over hashed byte n-grams; rows are the chains.  ``least`` are the log-odds over clean a chain needs."""

    def __init__(self, logs: np.ndarray, least: dict[str, float] | None = None) -> None:
        self.logs, self.least = logs, least or {}

    def scores(self, word: str) -> np.ndarray:
        return self.logs[:, hashed(word)].sum(axis=1)


def suspicious(word: str) -> bool:
    """Words not to be taught as clean: controls, replacement characters, or strictly invertible by a UTF-8 chain."""
    if "�" in word or any("\x80" <= c <= "\x9f" for c in word):
        return True
    return any((back := invert(word, name)) is not None and (plausible(back) or assigned(back) and not natural(word)) for name in ("utf8>latin1", "utf8>cp1252", "utf8>cp437", "utf8>mac_roman", "utf8>cp1251", "utf8>cp850", "utf8>cp1250", "utf8>koi8_r", "utf8>cp866"))


def taught(word: str, n: int) -> Iterator[tuple[int, list[int], float]]:
    """(class, cells, weight) of what one word teaches: as it stands, and garbled by every chain."""
    weight = 1.0 + math.log(n)
    yield 0, hashed(word), weight
    for k, name in enumerate(NAMES[1:], 1):
        wrong = garble(word, name)
        if wrong is not None and wrong != word:
            yield k, hashed(wrong), weight


#: What a cell of the n-gram counts holds before any word is counted.
_SMOOTH = 0.02


def classifier_of(counts: np.ndarray, least: dict[str, float] | None = None) -> Classifier:
    counts = counts + _SMOOTH
    return Classifier(np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32), least)


def fit(words: dict[str, int]) -> Classifier:
    """The classifier of a few words at hand."""
    counts = np.zeros((len(NAMES), DIMS))
    for word, n in words.items():
        if not suspicious(word):
            for k, cells, weight in taught(word, n):
                np.add.at(counts[k], cells, weight)
    return classifier_of(counts)


def single_byte(word: str) -> Iterator[tuple[int, str]]:
    """(class, word before the chain) for every single-byte chain that may have given the word."""
    for k, name in enumerate(NAMES[1:], 1):
        if name not in _SURE:
            back = invert(word, name)
            if back is not None and back != word and plausible(back) and sum(map(str.isalpha, back)) > 1:
                yield k, back


def corpus_words(documents: DataFrame, text: str = "text") -> DataFrame:
    """(word, n): how often each word with characters outside ASCII occurs in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(found.keys(), pa.string()), pa.array(found.values(), pa.int64())], names=["word", "n"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                if not t.isascii():
                    found.update([t[a:b] for a, b in passages(t)])
            if len(found) > 100_000:
                yield rows()
                found.clear()
        yield rows()

    texts = documents.where(F.col(text).isNotNull()).select(F.col(text).alias("text"))
    return texts.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def clean_words(words: DataFrame) -> DataFrame:
    """The words (word, n) that may be taught as clean: not suspicious, and no single-byte chain leads to a more usual word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep, sources, backs, ns = [], [], [], []
            for i, (word, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                if suspicious(word):
                    continue
                keep.append(i)
                for back in {b for _, b in single_byte(word)}:
                    sources.append(word)
                    backs.append(back)
                    ns.append(n)
            picked = batch.take(pa.array(keep, pa.int64()))
            size = len(keep) + len(sources)
            yield pa.RecordBatch.from_arrays(
                [pa.concat_arrays([picked.column(0), pa.array(sources, pa.string())]), pa.concat_arrays([picked.column(1), pa.array(ns, pa.int64())]), pa.array([None] * len(keep) + backs, pa.string())], names=["word", "n", "back"]
            ) if size else pa.RecordBatch.from_arrays([pa.array([], pa.string()), pa.array([], pa.int64()), pa.array([], pa.string())], names=["word", "n", "back"])

    rows = words.mapInArrow(run, "word string, n bigint, back string")
    usual = words.select(F.col("word").alias("u_word"), F.col("n").alias("u_n"))
    judged = rows.join(usual, F.col("back") == F.col("u_word"), "left").groupBy("word", "n").agg(F.max(F.coalesce("u_n", F.lit(0))).alias("most"))
    return judged.where("most <= n").select("word", "n")


#: Share of held-out clean words that may pass a single-byte chain's threshold.
HELD_OUT = 0.001


def corpus_classifier(words: DataFrame) -> Classifier:
    """Fitted on all words of the corpus: n-gram counts by class and fold come to the driver, 2 x 27 x DIMS numbers at most whatever the corpus."""
    clean = cut(clean_words(words))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, len(NAMES), DIMS))
        for batch in batches:
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                fold = _fold(word)
                for k, cells, weight in taught(word, n):
                    np.add.at(counts[fold, k], cells, weight)
        flat = counts.ravel()
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(flat[at], pa.float64())], names=["at", "n"])

    counts = np.zeros(2 * len(NAMES) * DIMS)
    for r in clean.mapInArrow(count, "at bigint, n double").groupBy("at").agg(F.sum("n").alias("n")).toLocalIterator():
        counts[r["at"]] = r["n"]
    counts = counts.reshape(2, len(NAMES), DIMS)
    return classifier_of(counts.sum(axis=0), _least(clean, counts))


def _fold(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "surrogatepass")) & 1


def _least(clean: DataFrame, counts: np.ndarray) -> dict[str, float]:
    """The log-odds only HELD_OUT of the clean words reach by each single-byte chain, judged by the counts of the other fold's words."""
    shared = clean.sparkSession.sparkContext.broadcast([classifier_of(counts[1 - fold]).logs for fold in (0, 1)])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models = [Classifier(logs) for logs in shared.value]
        seen: Counter = Counter()
        for batch in batches:
            for word in batch.column(0).to_pylist():
                scores = models[_fold(word)].scores(word)
                for k, _ in single_byte(word):
                    seen[k, max(0, math.ceil(scores[k] - scores[0]))] += 1
        yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in seen], pa.int32()), pa.array([o for _, o in seen], pa.int32()), pa.array(seen.values(), pa.int64())], names=["k", "odds", "n"])

    tallies: dict[int, Counter] = {}
    for r in clean.mapInArrow(score, "k int, odds int, n bigint").groupBy("k", "odds").agg(F.sum("n").alias("n")).collect():
        tallies.setdefault(r["k"], Counter())[r["odds"]] = r["n"]
    least = {}
    for k, tally in tallies.items():
        room = HELD_OUT * tally.total()
        for odds in sorted(tally, reverse=True):
            room -= tally[odds]
            if room < 0:
                least[NAMES[k]] = float(odds)
                break
    return least


class Judge:
    """Chain of a word, with a memo."""

    def __init__(self, classifier: Classifier) -> None:
        self.classifier = classifier
        self.memo: dict[str, tuple[str, float, str | None]] = {}

    def word(self, word: str) -> tuple[str, float, str | None]:
        """(chain or clean, log-odds over clean, the word before the chain)."""
        got = self.memo.get(word)
        if got is None:
            got = self._judge(word)
            if len(word) <= _MEMO_WORD:
                if len(self.memo) >= _MEMO:
                    self.memo.clear()
                self.memo[word] = got
        return got

    def _judge(self, word: str) -> tuple[str, float, str | None]:
        backs, wide = {}, {}
        for k, name in enumerate(NAMES[1:], 1):
            back = invert(word, name)
            if back is None or back == word:
                continue
            if plausible(back) and (name in _SURE or sum(map(str.isalpha, back)) > 1):
                backs[k] = back
            elif name in _SURE and assigned(back):
                wide[k] = back
        least = -4.0
        if not any(NAMES[k] in _SURE for k in backs) and wide and not natural(word):
            backs = {k: b for k, b in wide.items() if len(b) - len(_FOREIGN.sub("", b)) > 1} or wide
            least = -4.0 if backs is wide else -math.inf  # two characters that decode are no chance
        elif not backs and wide:
            backs, least = wide, TOGETHER / 2
        if not backs:
            return CLEAN, 0.0, None
        scores = self.classifier.scores(word)
        best = max(backs, key=lambda k: scores[k] + (8.0 if NAMES[k] in _SURE else 0.0))
        name, odds = NAMES[best], float(scores[best] - scores[0])
        if name in _SURE and odds > least or name not in _SURE and odds > max(TOGETHER / 2, self.classifier.least.get(name, 0.0)):
            return name, odds, backs[best]
        return CLEAN, odds, None

    def places(self, text: str) -> tuple[bool, list[tuple], dict[str, list[tuple]]]:
        """(surely garbled, places (start, end, word before) of sure chains, places (start, end, word before, log-odds) by single-byte chain)."""
        found: list[tuple[int, int, str]] = []
        weak: dict[str, list[tuple[int, int, str, float]]] = {}
        for a, b in passages(text):
            name, odds, back = self.word(text[a:b])
            if name in _SURE:
                found.append((a, b, back))
            elif name != CLEAN:
                weak.setdefault(name, []).append((a, b, back, odds))
        return "�" in text or bool(found), found, weak

    def document(self, text: str) -> tuple[bool, str]:
        """(garbled, the text with every strictly invertible garbled word restored), without a corpus that could support single-byte chains."""
        sure, found, weak = self.places(text)
        for places in weak.values():
            total = sum(min(odds, ALONE) for *_, odds in places)
            if total >= ALONE or total >= 2 * TOGETHER and len({text[a:b] for a, b, *_ in places}) > 1:
                sure = True
                found += [p[:3] for p in places]
        return sure, splice(text, found)


def splice(text: str, places: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, back in sorted(places):
        out += [text[at:a], back]
        at = b
    return "".join([*out, text[at:]])


_judges: dict[str, Judge] = {}
_CANDIDATES = "doc_id bigint, sure boolean, text string, weak array<struct<chain:string,word:string,back:string,odds:double,k:int>>"


def candidates(documents: DataFrame, classifier: Classifier, key: str = "doc_id", text: str = "text", keep_text: bool = True) -> DataFrame:
    """Documents with a garbled passage, or with words that a single-byte chain may have given (``weak``: the distinct words and how often)."""
    get = _share(documents, classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = get()
        for batch in batches:
            at, sures, weaks = [], [], []
            for i, t in enumerate(batch.column(1).to_pylist()):
                if t.isascii():
                    continue
                sure, _, weak = judge.places(t)
                if sure or weak:
                    held = Counter((chain, t[a:b], back, odds) for chain, places in weak.items() for a, b, back, odds in places)
                    at.append(i)
                    sures.append(sure)
                    weaks.append([{"chain": c, "word": w, "back": b, "odds": o, "k": k} for (c, w, b, o), k in held.items()])
            picked = batch.take(pa.array(at, pa.int64()))
            texts = picked.column(1) if keep_text else pa.nulls(len(at), pa.string())
            yield pa.RecordBatch.from_arrays([picked.column(0), pa.array(sures, pa.bool_()), texts, pa.array(weaks, _WEAK)], names=["doc_id", "sure", "text", "weak"])

    source = documents.where(F.col(text).isNotNull()).select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return source.mapInArrow(run, _CANDIDATES)


_WEAK = pa.list_(pa.struct([("chain", pa.string()), ("word", pa.string()), ("back", pa.string()), ("odds", pa.float64()), ("k", pa.int32())]))


def _share(df: DataFrame, classifier: Classifier):
    shared = df.sparkSession.sparkContext.broadcast((classifier.logs, classifier.least))
    token = uuid.uuid4().hex

    def get() -> Judge:
        if token not in _judges:
            _judges.clear()
            _judges[token] = Judge(Classifier(*shared.value))
        return _judges[token]

    return get


def supported(found: DataFrame, words: DataFrame) -> DataFrame:
    """(rid, approved, give): documents whose single-byte chains the corpus bears out, and the (chain, word) to restore in them."""
    weak = found.select("rid", F.explode("weak").alias("w")).select("rid", "w.*")
    stands = words.select(F.col("word").alias("s_word"), F.col("n").alias("stands"))
    usual = words.select(F.col("word").alias("u_word"), F.col("n").alias("usual"))
    held = weak.join(stands, F.col("word") == F.col("s_word"), "left").join(usual, F.col("back") == F.col("u_word"), "left").withColumn("usual", F.coalesce("usual", F.lit(0)))
    better = F.col("usual") > F.coalesce("stands", F.lit(0))
    chains = held.groupBy("rid", "chain").agg(
        F.sum(F.when(better, F.col("k") * F.least("odds", F.lit(ALONE))).otherwise(0.0)).alias("total"), F.count(F.when(better, 1)).alias("distinct"),
        F.collect_list(F.when(better | (F.col("usual") == 0), F.struct("chain", "word"))).alias("give"),
    )
    sure = (F.col("total") >= ALONE) | (F.col("total") >= 2 * TOGETHER) & (F.col("distinct") > 1)
    return chains.where(sure).groupBy("rid").agg(F.flatten(F.collect_list("give")).alias("give"))


def judged(documents: DataFrame, classifier: Classifier, words: DataFrame, key: str = "doc_id", text: str = "text", restore: bool = True) -> DataFrame:
    """(doc_id, restored) of every garbled document; ``words`` are the corpus' (see corpus_words).

    Only documents with a candidate are written and joined; their texts only where they are to be restored.
    """
    found = cut(candidates(documents, classifier, key, text, restore).withColumn("rid", F.monotonically_increasing_id()))
    approved = supported(found, words).withColumnRenamed("rid", "a_rid")
    garbled = found.drop("weak").join(approved, F.col("rid") == F.col("a_rid"), "left").where(F.col("sure") | F.col("a_rid").isNotNull())
    if not restore:
        return garbled.select("doc_id", F.lit(None).cast("string").alias("restored"))
    get = _share(documents, classifier)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = get()
        for batch in batches:
            texts = []
            for t, give in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                _, found, weak = judge.places(t)
                given = {(g["chain"], g["word"]) for g in give or ()}
                found += [(a, b, back) for chain, places in weak.items() for a, b, back, _ in places if (chain, t[a:b]) in given]
                texts.append(splice(t, found))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "restored"])

    return garbled.select("doc_id", "text", "give").mapInArrow(run, "doc_id bigint, restored string")
