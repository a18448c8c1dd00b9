"""Texts that lost their ending.

Two kinds of evidence are combined.

Length: for every source (a host's field) a log-normal length distribution, a share q of it right-censored at a candidate
limit, is fitted by maximum likelihood; the candidate limits are the lengths at which the source's texts pile up far
above their neighbourhood.  A text at such a limit has the censoring posterior q S(limit) / (q S(limit) + p(limit)), a
text at no limit that of a broken transfer.  Only histograms (source, length, count) are grouped by source, so a source
with a third of all rows is as small as any other.

Ending: what follows the cut (ellipsis, broken character, half an entity or tag) is set aside, and a logistic model on
hashed features of the ending and of the last sentence's frame tells whether such an ending is complete.  How often all
other texts hold the last word, its neighbour, words that begin so and the whole text is counted by Spark over all rows
and joined to each ending.  Only the model's weights are fitted on a bounded sample of the corpus: the texts as they are,
and the same texts cut at random places.

A node is found when the sum of both log-odds exceeds a threshold.

Defined results: null and blank texts are never cut; a text that ends in a final mark is complete whatever its length;
a source without pile-up has no limit; a null host is a source of its own; repeated rows are judged alike; an empty
table gives no rows.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shroudline.functions.text import scan_form
from shroudline.llm.lookalikes import plain, skeleton
from shroudline.llm.residue import residue
from shroudline.operators.groups import sorted_groups
from shroudline.session import cut

#: Texts the ending model is fitted on at most (chosen by a hash of the text); documented bound of the training sample.
SAMPLE = 30_000
BITS = 18
#: Shorter texts are labels; no cut copies are made of them.
SHORTEST = 24
THRESHOLD = 0.3
#: Log-odds that a text at no limit of its source was cut, by a break of its transfer, beside what its ending tells.
BREAK = -0.4
#: Log-odds of an ending that its mark completes.
COMPLETE = -99.0
_SUFFIX = re.compile(r"(?:\s*(?:…|\.{3,}|\[\s*(?:…|\.\.\.)\s*\]|\(\s*(?:…|\.\.\.)\s*\)|�|\s[>»]|&[a-z#]\w{0,6}|</?\w{0,10}(?:\s[^<>]*)?|\\u?[0-9a-fA-F]{0,3}|%[0-9A-Fa-f]?))+\s*$")
_PUTS = re.compile(r"[….�><&\\%\[(]")
_MORE = re.compile(r"\s*(?:[\[(]\s*)?(?:…|\.\.\.)\s*(?:read more|show more|see more|more|mehr(?: lesen)?|weiterlesen|lire la suite|(?:leer|ver) más|читать далее|続きを読む)\s*[\])]?\s*$", re.I)
#: Final marks, what may stand behind them, and quotes that close by themselves.
_FINAL, _BEHIND, _QUOTES = frozenset(".!?。।．！？"), "\"”“»’')]}（） \t\n\r\f\v\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", frozenset("\"”“»")
_HELD = re.compile(r"(?:[}>]|\|\*|\]\]|__|%[sd]|\w\)s)$")
_MARKS = frozenset(".!?。।．！？")
_TAGS = re.compile(r"(?:\s#\w+)+\s*$")


def closed(text: str) -> bool:
    """The text ends in a final mark, whatever quotes, brackets and spaces stand behind it, or in a closing quote."""
    return text.rstrip(_BEHIND)[-1:] in _FINAL or text.rstrip()[-1:] in _QUOTES


def split_suffix(text: str) -> tuple[str, str]:
    """(the text, what was put after a cut)."""
    start = max(0, len(text) - 32)
    tail = text[start:]
    for pattern in (_MORE, _SUFFIX) if _PUTS.search(tail) else ():
        found = pattern.search(tail)
        if found and start + found.start():
            return text[: start + found.start()], tail[found.start() :].strip()
    return text, ""


def _hash(s: str) -> int:
    return zlib.crc32(s.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


_WORDS = re.compile(r"[\u3040-\u30ff\u4e00-\u9fff]|\d+|(?:(?![\d_\u3040-\u30ff\u4e00-\u9fff])[\w\u0900-\u0903\u093a-\u094f\u0300-\u036f])+")
#: The same for texts of ASCII.
_ASCII = re.compile(r"[a-z]+|[0-9]+")
_INNER = re.compile(r"[.!?。।！？][\"”“»’')\]]*\s+(?=[^a-z\s])|[。।](?=.)")


@lru_cache(maxsize=8)
def words_of(text: str) -> list[str]:
    """Words in one spelling: plain forms, look-alikes merged, lower case, numbers as 0, ideographs one by one."""
    flat = plain(text)
    if flat.isascii():
        return [w if w >= "a" else "0" for w in _ASCII.findall(flat.lower())]
    return ["0" if w.isdigit() else w for w in _WORDS.findall(skeleton(flat).lower())]


#: A text that occurs so often as a whole is taught as complete, whatever a model of other texts says.
REPEATED = 8
#: Longer texts are not counted as wholes.
LABEL = 60


def taught(text: str) -> tuple[list[str], list[tuple[str, str]]]:
    """The words and neighbours a text teaches: all but its last word, which may be cut."""
    found = words_of(text)
    last = found[-1:] if found and closed(text) else []
    return found[:-1] + last, list(zip(found[:-2], found[1:-1]))


class Vocabulary:
    """What words, neighbours and beginnings of words some texts hold."""

    def __init__(self, texts: list[str]) -> None:
        self.words, self.pairs, self.prefixes, self.pair_prefixes = Counter(), Counter(), Counter(), Counter()
        self.whole = Counter(t for t in texts if len(t) <= LABEL)
        for t in texts:
            words, pairs = taught(t)
            self.words.update(words)
            self.pairs.update(pairs)
        for w, n in self.words.items():
            for i in range(1, len(w)):
                self.prefixes[w[:i]] += n
        for (a, w), n in self.pairs.items():
            for i in range(1, len(w)):
                self.pair_prefixes[a, w[:i]] += n

    def counts(self, text: str, before: str, word: str, source: str | None = None) -> tuple[int, ...]:
        """How often the word, words that begin so, both with the neighbour, and the whole text occur; the source's own are taken off."""
        own = own_counts(source, text, before, word) if source is not None else (0,) * 5
        held = (self.words[word], self.prefixes[word], self.pairs[before, word], self.pair_prefixes[before, word], self.whole[text])
        return tuple([max(0, n - o) for n, o in zip(held, own)])


def own_counts(source: str, text: str, before: str, word: str) -> tuple[int, ...]:
    """What a source itself adds to the counts of an ending."""
    words, pairs = taught(source)
    longer = [w for w in words if len(w) > len(word) and w.startswith(word)] if word else []
    beside = [w for a, w in pairs if a == before and len(w) > len(word) and w.startswith(word)] if word else []
    return words.count(word), len(longer), pairs.count((before, word)), len(beside), int(text == source and len(text) <= LABEL)


def _bucket(n: int) -> int:
    return n.bit_length()


def ending(text: str, role: str | None) -> tuple[list[str], tuple] | None:
    """(features that need no counts, (last word but one, last word, what else the others need)); None where the ending is complete by its mark or there is nothing to judge."""
    stripped = text.rstrip()
    if stripped[-1:] in _MARKS and not stripped.endswith("..."):
        return None
    body, suffix = split_suffix(text)
    stripped = body.rstrip()
    if not stripped or closed(stripped):
        return None
    at = 0
    for m in _INNER.finditer(stripped):
        at = m.end()
    last = stripped[at:]
    tokens = words_of(last)[-24:] or [""]
    whole = tokens if not at else words_of(stripped[:80])
    n, more = len(tokens), "m" if at else "1"
    e1, e2, e3 = tokens[-1], tokens[-2] if n > 1 else "^", tokens[-3] if n > 2 else "^"
    first = f"{tokens[0]} {tokens[1] if n > 1 else '$'}"
    begin = f"{whole[0]} {whole[1] if len(whole) > 1 else '$'}" if whole else "$"
    kind = "" if not suffix else "e" if suffix[0] in "….[(" else "x"
    shape = " ".join([t if len(t) < 4 or not t.isascii() and len(t) < 3 else "W" for t in tokens])
    inside = stripped[-1].isalnum()
    quotes = f"{last.count(chr(34)) % 2}{last.count('(') > last.count(')')}{last.count('«') > last.count('»')}{'„' in last and '“' not in last or '“' in last and '”' not in last and '„' not in last}"
    r = role or ""
    out = [
        f"1 {e1}", f"2 {e2} {e1}", f"3 {e3} {e2} {e1}", f"f {first} {more}", f"fn {first} {n} {more}", f"b {begin} {more}", f"sh {shape} {more}", f"s4 {shape[-12:]}",
        f"k {kind} {r} {more}", f"x {e1[-3:]} {inside} {min(len(e1), 6)}",
        f"q {quotes}", f"t {_TAGS.search(stripped) is not None} {more}", f"w {' '.join(tokens) if n < 9 else ' '.join(tokens[-5:])}", f"r {r} {more} {body != stripped and not suffix}",
        f"ph {_HELD.search(stripped) is not None}",
    ]
    return out, (e2, e1, r, more, min(n, 5), kind)


def counted(role: str, more: str, n: int, kind: str, counts: tuple[int, ...]) -> list[str]:
    """Features of an ending's counts."""
    word, prefix, pair, pair_prefix, whole = [_bucket(c) for c in (*counts[:4], counts[4] // 2)]
    return [f"v {word} {prefix}", f"vr {word} {prefix} {role}", f"vb {pair} {pair_prefix}", f"vs {word} {pair} {pair_prefix} {more}", f"wh {whole}", f"whl {whole} {n} {kind}"]


def features(text: str, role: str | None, known: Vocabulary, source: str | None = None) -> list[int] | None:
    """Hashed features of an ending; None where the ending is complete by its mark or there is nothing to judge."""
    got = ending(text, role)
    if got is None:
        return None
    plain_ones, (before, word, *rest) = got
    return [_hash(s) for s in plain_ones + counted(*rest, known.counts(text, before, word, source))]


_PUT = ("", "", "", "", "…", "...", "�")


def cut_copies(texts: list[tuple[str, str | None]], seed: int = 7) -> list[tuple[str, str | None]]:
    """Each text cut at a random place before its end, with something a site may put after the cut."""
    rng = np.random.default_rng(seed)
    out = []
    for t, role in texts:
        if len(t) >= SHORTEST:
            at = int(rng.integers(8, len(t)))
            out.append((t[:at] + _PUT[int(rng.integers(len(_PUT)))], role))
    return out


class Model:
    """Logistic regression on hashed binary features."""

    def __init__(self, weights: np.ndarray, bias: float, known: Vocabulary) -> None:
        self.weights, self.bias, self.known = weights, bias, known

    def score(self, text: str, role: str | None = None) -> float:
        """Log-odds that the ending is not complete; very low if its mark completes it."""
        found = features(text, role, self.known)
        if found is None:
            return COMPLETE
        return float(self.weights[found].sum()) + self.bias


def _descend(x: np.ndarray, y: np.ndarray, epochs: int, rate: float = 0.25, decay: float = 1e-3) -> tuple[np.ndarray, float]:
    """AdaGrad over rows of feature numbers."""
    weights, squares, bias = np.zeros(1 << BITS), np.full(1 << BITS, 1e-4), 0.0
    rng = np.random.default_rng(3)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for start in range(0, len(y), 512):
            part = order[start : start + 512]
            z = weights[x[part]].sum(axis=1) + bias
            g = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]
            unique, inverse = np.unique(x[part].ravel(), return_inverse=True)
            summed = np.bincount(inverse, weights=np.repeat(g, x.shape[1])) + decay * weights[unique]
            squares[unique] += summed * summed
            weights[unique] -= rate * summed / np.sqrt(squares[unique])
            bias -= 0.05 * g.mean()
    return weights, bias


def fit(texts: list[tuple[str, str | None]], epochs: int = 5, known: Vocabulary | None = None) -> Model:
    """Texts as they are count as complete, their cut copies as not.

    Taught is every other text.  With the corpus' counts known, each is seen with the counts of all others; else the
    vocabulary comes from the other half of the texts.

    Some texts of the sample are cut themselves: each is judged by a model of other texts first, and those that look
    cut are not taught as complete.
    """
    whole = known is not None
    known, learned = known if whole else Vocabulary([t for t, _ in texts[::2]]), texts[1::2]
    rows, labels, folds, sure = [], [], [], []
    for group, label in ((learned, 0.0), (cut_copies(learned), 1.0)):
        sources = [t for t, _ in learned if not label or len(t) >= SHORTEST]
        for (t, role), source in zip(group, sources, strict=True):
            found = features(t, role, known, source if whole else None)
            if found is not None:
                rows.append(found)
                labels.append(label)
                sure.append(known.whole[t] >= REPEATED)
                folds.append(zlib.crc32(t[:8].encode("utf-8", "surrogatepass")) & 1)
    if not rows:
        return Model(np.zeros(1 << BITS, dtype=np.float32), COMPLETE, known)
    x, y, fold = np.array(rows, dtype=np.int64), np.array(labels), np.array(folds)
    keep, sure = np.ones(len(y), dtype=bool), np.array(sure)
    for side in (0, 1):
        if (fold != side).any():
            weights, bias = _descend(x[fold != side], y[fold != side], 2)
            keep &= ~((fold == side) & (y == 0) & ~sure & (weights[x].sum(axis=1) + bias > 0.5))
    weights, bias = _descend(x[keep], y[keep], epochs)
    return Model(weights.astype(np.float32), bias, known)


def training_texts(nodes: DataFrame, rows: int, sample: int = SAMPLE) -> list[tuple[str, str | None]]:
    """A bounded sample by a hash of the key: never more than 2 * sample rows come to the driver."""
    share = max(1, rows // sample)
    picked = nodes.where("text is not null and trim(text) != ''").where(F.pmod(F.xxhash64("node_pk"), F.lit(share)) == 0).select("text", "node_role")
    return sorted(((r.text, r.node_role or "") for r in picked.take(2 * sample)), key=lambda r: (zlib.crc32(r[0].encode()), r))


def corpus_counts(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((before, word, n), (text, n)) over all rows: words (before is empty) and neighbours, and short texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        singles: Counter = Counter()
        beside: Counter = Counter()

        def rows() -> pa.RecordBatch:
            before = [""] * len(singles) + [a for a, _ in beside]
            return pa.RecordBatch.from_arrays([pa.array(before, pa.string()), pa.array([*singles, *[w for _, w in beside]], pa.string()), pa.array([*singles.values(), *beside.values()], pa.int64())], names=["before", "word", "n"])

        for batch in batches:
            held, pairs = [], []
            for t, n in Counter(batch.column(0).to_pylist()).items():  # neighbouring rows often hold one text
                found = words_of(t)
                if found:
                    last = len(found) if closed(t) else len(found) - 1
                    held += found[:last] * n
                    pairs += list(zip(found[:-2], found[1:-1])) * n
            singles.update(held)
            beside.update(pairs)
            if len(singles) + len(beside) > 200_000:
                yield rows()
                singles.clear()
                beside.clear()
        yield rows()

    texts = nodes.where("text is not null").select("text")
    words = texts.mapInArrow(run, "before string, word string, n bigint").groupBy("before", "word").agg(F.sum("n").alias("n"))
    return cut(words), texts.where(F.length("text") <= LABEL).groupBy("text").agg(F.count("*").alias("n"))


def lookup(words: DataFrame) -> DataFrame:
    """(before, word, exact, longer): how often the word, and longer words that begin so, occur."""
    begun = words.where(F.length("word") > 1).select("before", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", F.lit(1), i))).alias("word"), F.lit(0).cast("bigint").alias("exact"), F.col("n").alias("longer"))
    return words.select("before", "word", F.col("n").alias("exact"), F.lit(0).cast("bigint").alias("longer")).unionByName(begun).groupBy("before", "word").agg(F.sum("exact").alias("exact"), F.sum("longer").alias("longer"))


def known_of(texts: list[tuple[str, str | None]], counts: tuple[DataFrame, DataFrame]) -> Vocabulary:
    """The corpus' counts of the endings of a bounded sample and of its cut copies."""
    known, words, whole = Vocabulary([]), *counts
    spark = words.sparkSession
    group = texts[1::2] + cut_copies(texts[1::2])
    keys = {got[1][:2] for t, role in group if (got := ending(t, role)) is not None}
    asked = sorted(keys | {("", w) for _, w in keys})
    wanted = F.broadcast(spark.createDataFrame(asked, "before string, word string"))
    begun = F.broadcast(spark.createDataFrame(sorted({(b, w[:1]) for b, w in asked}), "b string, head string"))
    # words that begin with no asked letter beside their neighbour need not be spelled out
    near = words.join(begun, (F.col("before") == F.col("b")) & (F.left("word", F.lit(1)) == F.col("head")), "left_semi")
    for r in lookup(near).join(wanted, ["before", "word"], "left_semi").collect():
        at = (r.before, r.word) if r.before else r.word
        (known.pairs if r.before else known.words)[at], (known.pair_prefixes if r.before else known.prefixes)[at] = r.exact, r.longer
    labels = spark.createDataFrame(sorted({(t,) for t, _ in group if len(t) <= LABEL}), "text string")
    known.whole.update({r.text: r.n for r in whole.join(F.broadcast(labels), "text", "left_semi").collect()})
    return known


def _survival(log_n: float, mu: float, sigma: float) -> float:
    return 0.5 * math.erfc((log_n - mu) / (sigma * math.sqrt(2)))


def fit_censored(lengths: np.ndarray, counts: np.ndarray, limit: int) -> tuple[float, float, float]:
    """(mu, sigma, share) of a log-normal length, a share of which is right-censored at ``limit``, by expectation-maximisation of the likelihood.

    Texts above the limit were not under it; how many at the limit were longer is what each step expects.
    """
    logs = np.log(np.maximum(lengths, 1))
    at, above = lengths == limit, lengths > limit
    free = counts * ~at
    n_free, n_at, n_above, total = free.sum(), counts[at].sum(), counts[above].sum(), counts.sum()
    s1, s2 = (logs * free).sum(), (logs**2 * free).sum()
    c = math.log(limit)
    mu = s1 / n_free if n_free else c
    sigma = max(0.2, math.sqrt(max(s2 / n_free - mu * mu, 0.0))) if n_free else 1.0
    share = 0.5 if n_above else 1.0
    for _ in range(60):
        a = (c - mu) / sigma
        tail = max(0.5 * math.erfc(a / math.sqrt(2)), 1e-12)
        mills = math.exp(-a * a / 2) / math.sqrt(2 * math.pi) / tail
        longer = _censored(limit, mu, sigma, share) * n_at
        first = mu + sigma * mills
        second = mu * mu + sigma * sigma + sigma * (c + mu) * mills
        here = n_at - longer
        new_mu = (s1 + here * c + longer * first) / total
        new_sigma = math.sqrt(max((s2 + here * c * c + longer * second) / total - new_mu * new_mu, 1e-3))
        share = longer / (longer + n_above) if longer + n_above else 1.0
        done = abs(new_mu - mu) < 1e-6
        mu, sigma = new_mu, new_sigma
        if done:
            break
    return mu, sigma, share


def _censored(limit: int, mu: float, sigma: float, share: float) -> float:
    """The chance that a text at the limit was longer."""
    inside = max(_survival(math.log(limit - 0.5), mu, sigma) - _survival(math.log(limit + 0.5), mu, sigma), 1e-9)
    beyond = share * _survival(math.log(limit + 0.5), mu, sigma)
    return beyond / (beyond + inside)


def source_limits(rows: list[tuple]) -> list[tuple]:
    """(src, at, posterior) from one source's histogram (src, length, texts): the lengths at which texts pile up, with the chance that a text there was cut.

    The neighbourhood of every length comes from running sums, the likelihood is fitted at the piles only.
    """
    lengths, counts = np.array([r[1] for r in rows]), np.array([r[2] for r in rows])
    sums, out = np.concatenate([[0], counts.cumsum()]), []
    low, high = np.searchsorted(lengths, lengths - NEAR), np.searchsorted(lengths, lengths + NEAR, side="right")
    near = (sums[high] - sums[low] - counts) / (2 * NEAR)
    for i in np.flatnonzero((lengths >= SHORTEST) & (counts >= 4) & (counts >= 3 * near + 3)):
        n, c = int(lengths[i]), counts[i]
        longer = min(_censored(n, *fit_censored(lengths, counts, n)), 1 - near[i] / c, 1 - 1 / (c + 2))  # never surer than the pile above its neighbours
        if longer > 0.5:
            out.append((rows[0][0], n, float(longer)))
    return out


#: Lengths on either side that are a length's neighbourhood.
NEAR = 6


def _source() -> Column:
    """A field limit belongs to a field of a site: the host and the node's role."""
    return F.concat_ws("|", F.coalesce(F.col("host"), F.lit("")), F.coalesce(F.col("node_role"), F.lit("")))


def limits(nodes: DataFrame) -> DataFrame:
    """(src, at, posterior) of every source that has a limit; copies of one text, in whatever letters and case, count once."""
    same = F.lower(scan_form(F.col("text")))
    distinct = nodes.where("text is not null").select(_source().alias("src"), F.length("text").alias("n"), F.xxhash64(same).alias("h")).where(F.col("n") >= 8).groupBy("src", "n", "h").agg(F.lit(1).alias("one"))
    histogram = distinct.groupBy("src", "n").agg(F.count("*").alias("c"))
    return sorted_groups(histogram, ["src"], ["n"], source_limits, "src string, at int, posterior double")


def scored(nodes: DataFrame, model: Model) -> DataFrame:
    """(node_pk, host, site_config_id, src, n, ending) by the counts the model holds."""
    shared = nodes.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        memo: dict[tuple, float] = {}
        for batch in batches:
            scores, sizes = [], []  # residue of templates and error pages is whole as it is
            for role, t in zip(batch.column(4).to_pylist(), batch.column(5).to_pylist()):
                got = memo.get((t, role)) if len(t) < 80 else None
                if got is None:
                    got = model.score(t, role)
                    if got > -4 and residue(t):
                        got = COMPLETE
                    if len(t) < 80:
                        if len(memo) > 200_000:
                            memo.clear()
                        memo[t, role] = got
                scores.append(got)
                sizes.append(len(t))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sizes, pa.int32()), pa.array(scores, pa.float64())], names=["node_pk", "host", "site_config_id", "src", "n", "ending"])

    return _sources(nodes).mapInArrow(run, "node_pk bigint, host string, site_config_id string, src string, n int, ending double")


def _sources(nodes: DataFrame) -> DataFrame:
    return nodes.where("text is not null").select(F.col("node_pk").cast("bigint").alias("node_pk"), "host", "site_config_id", _source().alias("src"), "node_role", "text")


_IDS = "node_pk bigint, host string, site_config_id string, src string, n int"
_ENDS = _IDS + ", base double, role string, more string, size int, kind string, before string, word string, label string, own array<bigint>"


def scored_by_corpus(nodes: DataFrame, model: Model, counts: tuple[DataFrame, DataFrame]) -> DataFrame:
    """(node_pk, host, site_config_id, src, n, ending) by the corpus' counts of each ending, joined by its key.

    Rows that no count can make a cut text are left out: endings complete by their mark, and residue, which is whole or scores below -4.
    """
    shared = nodes.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = shared.value
        memo: dict[tuple, tuple] = {}
        for batch in batches:
            at, rows = [], []
            for i, (role, t) in enumerate(zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())):
                got = memo.get((t, role), 0) if len(t) < 80 else 0
                if got == 0:
                    end = ending(t, role)
                    if end is None or residue(t):
                        got = None
                    else:
                        plain_ones, (before, word, *rest) = end
                        got = (len(t), float(weights[[_hash(s) for s in plain_ones]].sum()) + bias, *rest, before, word, t if len(t) <= LABEL else None, own_counts(t, t, before, word))
                    if len(t) < 80:
                        if len(memo) > 100_000:
                            memo.clear()
                        memo[t, role] = got
                if got is not None:
                    at.append(i)
                    rows.append(got if got[8] is not None else (*got[:8], f"\0{i % 997}", got[9]))  # keys that meet nothing, spread evenly
            types = (pa.int32(), pa.float64(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.int64()))
            columns = list(zip(*rows)) if rows else [()] * len(types)
            picked = batch.select([0, 1, 2, 3]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*picked.columns, *[pa.array(c, kind) for c, kind in zip(columns, types)]], names=[f.split()[0] for f in _ENDS.split(", ")])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, _ = shared.value
        memo: dict[tuple, float] = {}
        for batch in batches:
            texts = [batch.column(i).dictionary_encode() for i in (6, 7, 9)]  # role, more, kind
            held = np.stack([batch.column(i).fill_null(0).to_numpy() for i in range(11, 16)], axis=1) - batch.column(10).flatten().to_numpy().reshape(-1, 5)
            bits = np.where(held > 0, np.floor(np.log2(np.maximum(held, 1))) + 1, 0).astype(np.int64)
            key = np.column_stack([*[t.indices.to_numpy() for t in texts], batch.column(8).to_numpy(), bits])
            packed = key @ np.array([1 << 45, 1 << 43, 1 << 40, 1 << 36, *[1 << 7 * i for i in range(5)]], dtype=np.int64)
            _, first, where = np.unique(packed, return_index=True, return_inverse=True)
            role, more, kind = (t.dictionary.to_pylist() for t in texts)
            parts = np.zeros(len(first))
            for j, row in enumerate(key[first].tolist()):
                at = (role[row[0]], more[row[1]], row[3], kind[row[2]], *[1 << n >> 1 for n in row[4:]])
                part = memo.get(at)
                if part is None:
                    if len(memo) > 200_000:
                        memo.clear()
                    part = memo[at] = float(weights[[_hash(s) for s in counted(*at[:4], at[4:])]].sum())
                parts[j] = part
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(batch.column(5).to_numpy() + parts[where])], names=["node_pk", "host", "site_config_id", "src", "n", "ending"])

    words, labels = counts
    table = lookup(words)
    pairs = table.where("before != ''").select("before", "word", F.col("exact").alias("c2"), F.col("longer").alias("c3"))
    singles = table.where("before = ''").select("word", F.col("exact").alias("c0"), F.col("longer").alias("c1"))
    ends = _sources(nodes).mapInArrow(split, _ENDS).join(pairs, ["before", "word"], "left").join(singles, "word", "left").join(labels.select(F.col("text").alias("label"), F.col("n").alias("c4")), "label", "left")
    held = ends.select("node_pk", "host", "site_config_id", "src", "n", "base", "role", "more", "size", "kind", "own", "c0", "c1", "c2", "c3", "c4")
    return held.mapInArrow(score, _IDS + ", ending double")


def judged(nodes: DataFrame, model: Model, threshold: float = THRESHOLD, counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(node_pk, host, site_config_id, cut) of every node with a text; with the corpus' counts given, of every node they can make a cut text."""
    ends = scored(nodes, model) if counts is None else scored_by_corpus(nodes, model, counts)
    bounds = limits(nodes).select(F.col("src").alias("l_src"), "at", "posterior")
    joined = ends.join(bounds, (F.col("src") == F.col("l_src")) & (F.col("n") == F.col("at")), "left")
    censor = F.coalesce(F.log(F.col("posterior") / (1 - F.col("posterior"))), F.lit(BREAK))
    return joined.select("node_pk", "host", "site_config_id", "ending", censor.alias("censor"), (F.col("ending") + censor > threshold).alias("cut"))


def shares_of(nodes: DataFrame, cut: DataFrame, source: str) -> DataFrame:
    """The shares where only rows that may be cut were judged."""
    texts = nodes.where("text is not null").groupBy(source).agg(F.count("*").alias("n_texts"))
    found = cut.where("cut").groupBy(F.col(source).alias("c_source")).agg(F.count("*").alias("n_cut"))
    joined = texts.join(found, F.col(source).eqNullSafe(F.col("c_source")), "left").select(source, "n_texts", F.coalesce("n_cut", F.lit(0).cast("bigint")).alias("n_cut"))
    return joined.withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))


def shares(cut: DataFrame, source: str) -> DataFrame:
    """Number of texts, of cut texts, and their share by source."""
    return cut.groupBy(source).agg(F.count("*").alias("n_texts"), F.count(F.when(F.col("cut"), 1)).alias("n_cut")).withColumn("share", F.round(F.col("n_cut") / F.col("n_texts"), 6))
