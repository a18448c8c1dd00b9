"""Whole-corpus encoding with a public byte-level BPE vocabulary.

Texts longer than a chunk are cut into overlapping chunks that are pre-tokenised in parallel; neighbouring chunks are
stitched at the first pre-token boundary both of them found in their overlap (from a common boundary on, the pattern
sees the same text, so the pre-tokens agree), and the pieces between stitches are encoded.  Chunks that share no
boundary are joined before encoding, so the result never depends on the chunk size.  Decoding concatenates raw bytes.

Defined results: a null text and an empty text give an empty list; every row gives one row, repeated or null ids
included; special-token strings are ordinary text.  Only the id and text columns are read.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Where the vocabulary file lies on every machine; never copied into the repository.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the pre-token pattern published with the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CHUNK, OVERLAP = 16_384, 512
#: A boundary this near to the cut end of a chunk may be caused by the cut.
_UNSURE = 4
_MEMO, _MEMO_TEXT = 300_000, 48


def _ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class Encoder:
    """Ids of texts; words met before come from a bounded memo."""

    def __init__(self, path: str) -> None:
        import tiktoken

        self.core = tiktoken.Encoding("public", pat_str=PATTERN, mergeable_ranks=_ranks(path), special_tokens={})
        self.memo: dict[str, bytes] = {}

    def __missing(self, word: str) -> bytes:
        ids = array("i", self.core.encode_ordinary(word)).tobytes()
        if len(word) <= _MEMO_TEXT:
            if len(self.memo) >= _MEMO:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def packed(self, text: str) -> bytes:
        """The ids as 32-bit integers.

        A space before a character that is no white space always begins a pre-token, so the words between such places
        are encoded on their own.
        """
        words = text.split(" ")
        get, missing = self.memo.get, self.__missing
        out, held = [], words[0]
        for word in words[1:]:
            if word and not word[0].isspace():
                if held:
                    out.append(get(held) or missing(held))
                held = " " + word
            else:
                held += " " + word
        if held:
            out.append(get(held) or missing(held))
        return b"".join(out)

    def ids(self, text: str | None) -> list[int]:
        return list(array("i", self.packed(text))) if text else []

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.core.decode_single_token_bytes(i) for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per Python worker and vocabulary."""
    return Encoder(path)


def _encode_column(texts: pa.Array, path: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in one array, number of ids of each text)."""
    coder = encoder(path)
    packed = [coder.packed(t) if t else b"" for t in texts.to_pylist()]
    counts = np.fromiter((len(p) // 4 for p in packed), dtype=np.int64, count=len(packed))
    return np.frombuffer(b"".join(packed), dtype=np.int32), counts


def _list_array(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.zeros(len(counts) + 1, dtype=np.int32)
    np.cumsum(counts, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def _encode(df: DataFrame, keys: str, path: str) -> DataFrame:
    """The columns of ``keys`` (first columns of df) with ids of the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = _list_array(*_encode_column(batch.column(batch.num_columns - 1), path))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], names=[*batch.schema.names[:-1], "ids"])

    return df.mapInArrow(run, f"{keys}, ids array<int>")


def _boundaries(df: DataFrame, chunk: int, overlap: int, key_type: str) -> DataFrame:
    """For each chunk the pre-token boundaries inside its overlaps, as offsets in the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pattern = regex.compile(PATTERN)
        for batch in batches:
            heads, tails = [], []
            for k, n, text in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                start = max(0, k * chunk - overlap)
                sure = start + len(text) if start + len(text) >= n else start + len(text) - _UNSURE
                found = [start + m.start() for m in pattern.finditer(text)]
                heads.append([p for p in found if k and k * chunk <= p < k * chunk + overlap and p <= sure])
                tails.append([p for p in found if (k + 1) * chunk <= p < (k + 1) * chunk + overlap and p <= sure])
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(heads, pa.list_(pa.int64())), pa.array(tails, pa.list_(pa.int64()))],
                names=[*batch.schema.names, "heads", "tails"],
            )

    return df.mapInArrow(run, f"row bigint, k bigint, n bigint, slice string, doc_id {key_type}, heads array<bigint>, tails array<bigint>")


def _long_pieces(df: DataFrame, chunk: int, overlap: int, key_type: str = "bigint") -> DataFrame:
    """(row, run, doc_id, piece) of texts longer than a chunk, cut only at stitched boundaries."""
    n = F.length("text").cast("bigint")
    chunks = df.select("row", "doc_id", n.alias("n"), "text", F.explode(F.sequence(F.lit(0).cast("bigint"), ((n - 1) / chunk).cast("bigint"))).alias("k"))
    start = F.greatest(F.lit(0), F.col("k") * chunk - overlap)
    sliced = chunks.select("row", "k", "n", F.col("text").substr((start + 1).cast("int"), ((F.col("k") + 1) * chunk + overlap - start).cast("int")).alias("slice"), "doc_id")
    in_order = Window.partitionBy("row").orderBy("k")
    marked = (
        _boundaries(sliced.repartition("row", "k"), chunk, overlap, key_type)
        .withColumn("stitch", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.array_min(F.array_intersect(F.lag("tails").over(in_order), "heads"))))
        .withColumn("run", F.count("stitch").over(in_order))
    )
    head = F.greatest(F.lit(0), F.col("k") * chunk - overlap)
    core = F.col("slice").substr((F.col("k") * chunk - head + 1).cast("int"), F.lit(chunk + overlap))
    runs = (
        marked.select("row", "run", "doc_id", "k", "n", "stitch", core.alias("core"))
        .groupBy("row", "run")
        .agg(F.max("doc_id").alias("doc_id"), F.min("k").alias("k0"), F.max("n").alias("n"), F.max("stitch").alias("stitch"), F.array_sort(F.collect_list(F.struct("k", "core"))).alias("parts"))
    )
    last = F.element_at("parts", -1)["core"]
    fronts = F.transform(F.slice("parts", F.lit(1), F.size("parts") - 1), lambda p: F.substring(p["core"], 1, chunk))
    until = F.coalesce(F.lead("stitch").over(Window.partitionBy("row").orderBy("run")), F.col("n"))
    return runs.select(
        "row", "run", "doc_id", F.concat(F.array_join(fronts, ""), last).substr((F.col("stitch") - F.col("k0") * chunk + 1).cast("int"), (until - F.col("stitch")).cast("int")).alias("piece")
    )


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, ids) of every row."""
    source = df.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    short = _encode(source.where(F.col("text").isNull() | (F.length("text") <= chunk)), "doc_id bigint", vocabulary)
    rows = source.where(F.length("text") > chunk).withColumn("row", F.monotonically_increasing_id())
    pieces = _encode(_long_pieces(rows, chunk, overlap), "row bigint, run bigint, doc_id bigint", vocabulary)
    long = pieces.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("run", "ids"))), lambda p: p["ids"])).alias("ids"))
    return short.unionByName(long.select("doc_id", "ids")).withColumnRenamed("doc_id", key)


def token_counts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key, tokens, digest) of every row: the number of its ids, long texts by their stitched pieces; digest is a 64-bit hash of the text."""

    def count(df: DataFrame, keys: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                _, counts = _encode_column(batch.column(batch.num_columns - 1), vocabulary)
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts)], names=[*batch.schema.names[:-1], "tokens"])

        return df.mapInArrow(run, f"{keys}, tokens bigint")

    source = df.select(F.col(key).cast("bigint").alias("doc_id"), F.xxhash64(text).alias("digest"), F.col(text).alias("text"))
    short = count(source.where(F.col("text").isNull() | (F.length("text") <= chunk)), "doc_id bigint, digest bigint")
    rows = source.where(F.length("text") > chunk).select(F.monotonically_increasing_id().alias("row"), F.struct("doc_id", "digest").alias("doc_id"), "text")
    pieces = _long_pieces(rows, chunk, overlap, "struct<doc_id:bigint,digest:bigint>").select("row", "doc_id.*", "piece")
    long = count(pieces, "row bigint, doc_id bigint, digest bigint").groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("digest").alias("digest"), F.sum("tokens").alias("tokens"))
    return short.unionByName(long.drop("row")).select(F.col("doc_id").alias(key), "tokens", "digest")
