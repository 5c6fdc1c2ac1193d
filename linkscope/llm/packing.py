"""Operator 7, packing along a space-filling curve.

Token counts of a document, hashed into a few hundred buckets, are projected to four dimensions; the point's place on a Hilbert curve is
the sort key, so neighbours on the curve share vocabulary. Documents are laid end to end in that order and cut every ``capacity`` tokens,
so only the very last sequence is short.

The tokens are written once, with their keys. Range bounds come from quantiles of the keys alone; one shuffle then brings each range
together in order, and a running position, which starts from the sums of the ranges before it, gives every piece its sequence. Ties on
the curve are told apart by a hash of the id, so that copies of one text, however many, spread over ranges.

Defined results: a null or empty text is the closing token alone; repeated rows are packed one by one; a null id is kept as it is; empty
tables give no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import quoted, written

#: Bytes of tokens to a range, and the most ranges: their bounds and sums are all that the driver holds. Tasks stream their range and sort it
#: outside memory, so ranges that grow beyond that number take longer, not more memory.
RANGE_BYTES, MAX_RANGES = 16 << 20, 1 << 16
#: Characters of a long text that are encoded at a time, and bytes of tokens of a text or of pieces that are handed on at a time.
BLOCK, HANDED_ON = 1 << 18, 4 << 20


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@dataclass(frozen=True)
class PackingRules:
    capacity: int = 1024
    end_id: int = 0
    vocabulary: str = "byte_bpe_50k.json"
    buckets: int = 512
    dimensions: int = 4
    bits: int = 12


class Encoder:
    """Tokens of a text as little-endian 16-bit integers.

    The encoder that has the vocabulary as ranks is the faster one. For texts of the characters in ``plain`` its pattern means what the
    tokenizers library's does; other texts, those with a special token and those with a very long run of white space, which its pattern
    cannot take, go to the library, which is loaded for the first of them. Long texts are encoded in blocks, cut before a single space
    between other characters, which no token reaches over.
    """

    plain = re.compile("[^\t\n\r\x20-\x7e\u00c0-\u024f\u2013-\u201d\u2026\u20ac]")
    gap = re.compile(r"\s{2000}")
    cut = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, vocabulary: str) -> None:
        import base64
        import json

        import public_tokenizers
        import tiktoken

        self.vocabulary = vocabulary
        with open(_vocabulary(vocabulary), encoding="utf-8") as file:
            spec = json.load(file)
        self.special = [t["content"] for t in spec["added_tokens"]]
        if len(spec["model"]["vocab"]) + len(self.special) > 1 << 16:
            raise ValueError("token ids take more than 16 bits")
        with open(_vocabulary(vocabulary.removesuffix(".json") + ".tiktoken"), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.ordinary = tiktoken.Encoding("parts", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_file(_vocabulary(self.vocabulary))

    def blocks(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > BLOCK and (found := self.cut.search(text, at + BLOCK)):
            yield text[at : found.start()]
            at = found.start()
        yield text[at:] if at else text

    def encode(self, text: str) -> bytes:
        if self.plain.search(text) or self.gap.search(text) or any(t in text for t in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()
        return b"".join(np.array(self.ordinary(block), dtype="<u2").tobytes() for block in self.blocks(text))


@cache
def _tokens(vocabulary: str) -> Encoder:
    return Encoder(vocabulary)


@cache
def _projection(rules: PackingRules) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of each token id, and the directions of the buckets."""
    ids = np.arange(1 << 16, dtype=np.uint32)
    bucket = (ids * np.uint32(2654435761)) >> np.uint32(16)
    return bucket % rules.buckets, np.random.default_rng(7).standard_normal((rules.buckets, rules.dimensions))


def hilbert(points: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of each row of unsigned coordinates below 2 ** bits."""
    x = points.astype(np.uint64).T.copy()
    n = len(x)
    for b in range(bits - 1, 0, -1):
        q = np.uint64(1 << b)
        low = q - np.uint64(1)
        for i in range(n):
            turn = (x[i] & q) != 0
            swap = np.where(turn, np.uint64(0), (x[0] ^ x[i]) & low)
            x[0] ^= np.where(turn, low, swap)
            x[i] ^= swap
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for b in range(bits - 1, 0, -1):
        flip ^= np.where((x[n - 1] >> np.uint64(b)) & np.uint64(1), np.uint64((1 << b) - 1), np.uint64(0))
    x ^= flip
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << np.uint64(1)) | ((x[i] >> np.uint64(b)) & np.uint64(1))
    return key


def curve_keys(texts: list[np.ndarray], rules: PackingRules) -> np.ndarray:
    """texts: token ids of each document. Coordinates are brought to an even spread by the normal distribution's shape."""
    bucket, directions = _projection(rules)
    vectors = np.zeros((len(texts), rules.buckets))
    for row, ids in zip(vectors, texts, strict=True):
        np.sqrt(np.bincount(bucket[ids], minlength=rules.buckets), out=row)
    vectors /= np.maximum(np.linalg.norm(vectors, axis=1, keepdims=True), 1e-9)
    spread = 1 / (1 + np.exp(-1.702 * (vectors @ directions)))
    return hilbert(np.minimum(spread * (1 << rules.bits), (1 << rules.bits) - 1).astype(np.uint64), rules.bits)


def tokenised(docs: DataFrame, id_col: str, text_col: str, rules: PackingRules) -> DataFrame:
    """(doc_id, ids, n, key): 16-bit ids with the closing one, their number, and the place on the curve with the id's hash below it."""
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    tie_bits = 63 - rules.bits * rules.dimensions

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces, end = _tokens(rules.vocabulary), np.array([rules.end_id], dtype="<u2").tobytes()
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                made, size = [], 0
                for text in batch.column("text").slice(at, 512):
                    made.append(pieces.encode(text.as_py() or "") + end)
                    size += len(made[-1])
                    if size > HANDED_ON:
                        break
                ids = batch.column("doc_id").slice(at, len(made))
                at += len(made)
                keys = curve_keys([np.frombuffer(m, dtype="<u2") for m in made], rules)
                ties = np.array([zlib.crc32(str(i.as_py()).encode()) >> 17 for i in ids], dtype=np.uint64)
                keys = (keys << np.uint64(tie_bits)) | (ties >> np.uint64(max(0, 15 - tie_bits)))
                yield pa.RecordBatch.from_arrays([ids, pa.array(made, pa.binary()), pa.array([len(m) // 2 for m in made], pa.int64()), pa.array(keys.view(np.int64))], names=["doc_id", "ids", "n", "key"])

    return slim.mapInArrow(run, f"doc_id {dict(slim.dtypes)['doc_id']}, ids binary, n long, key long")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: PackingRules | None = None) -> DataFrame:
    """Per piece: doc_id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    rules = rules or PackingRules()
    made = written(tokenised(docs, id_col, text_col, rules), "tokens")
    total = made.agg(F.sum("n")).first()[0] or 0
    n_ranges = int(min(MAX_RANGES, max(1, 2 * total // RANGE_BYTES)))
    bounds = np.empty(0, dtype=np.int64)
    if n_ranges > 1:
        # Keys are weighed by tokens: one for each unit of them, the rest decided by a hash, so that ranges are even in bytes, not in rows.
        unit = max(1, total // (1000 * n_ranges))
        weight = F.floor(F.col("n") / unit + F.pmod(F.xxhash64("doc_id", "key"), F.lit(1 << 20)) / float(1 << 20)).cast("int")
        weighed = made.select("key", F.explode(F.array_repeat(F.lit(0).cast("byte"), weight)))
        bounds = np.unique(weighed.agg(F.percentile_approx("key", [i / n_ranges for i in range(1, n_ranges)], 10 * n_ranges)).first()[0])

    # A number for each range that hashes to a partition of its own, so that no task gets several ranges by chance.
    spread = made.sparkSession.range(12 * n_ranges).select("id", F.pmod(F.hash("id"), F.lit(n_ranges)).alias("p")).groupBy("p").agg(F.min("id")).collect()
    places = np.arange(n_ranges)
    for p, number in spread:
        places[p] = number

    @F.pandas_udf("int")
    def range_of(key):
        import pandas as pd

        return pd.Series(np.searchsorted(bounds, key.to_numpy(), side="left").astype(np.int32))

    @F.pandas_udf("range int, place long")
    def placed(key):
        import pandas as pd

        at = np.searchsorted(bounds, key.to_numpy(), side="left")
        return pd.DataFrame({"range": at.astype(np.int32), "place": places[at]})

    sums = {r["range"]: r["n"] for r in made.select(range_of("key").alias("range"), "n").groupBy("range").agg(F.sum("n").alias("n")).collect()}  # at most MAX_RANGES rows
    begins, at = {}, 0
    for r in sorted(sums):
        begins[r], at = at, at + sums[r]
    capacity = rules.capacity

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, position = None, 0
        out: dict[str, list] = {c: [] for c in ("row", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")}

        def handed_on(batch: pa.RecordBatch) -> pa.RecordBatch:
            columns = [pa.array(out[c], pa.binary() if c == "ids" else pa.int64()) for c in out]
            for c in out.values():
                c.clear()
            return pa.RecordBatch.from_arrays([batch.column("doc_id").take(columns[0]), *columns[1:]], names=["doc_id", *list(out)[1:]])

        for batch in batches:
            size = 0
            for row, (r, ids) in enumerate(zip(batch.column("range").to_pylist(), batch.column("ids"), strict=True)):
                if r != now:
                    now, position = r, begins[r]
                narrow = np.frombuffer(ids.as_buffer(), dtype="<u2")
                start = 0
                while start < len(narrow):
                    offset = position % capacity
                    length = min(capacity - offset, len(narrow) - start)
                    piece = narrow[start : start + length].astype("<u4").tobytes()
                    for c, v in (("row", row), ("start", start), ("length", length), ("ids", piece), ("doc_tokens", len(narrow)), ("sequence_id", position // capacity), ("offset", offset)):
                        out[c].append(v)
                    start, position, size = start + length, position + length, size + len(piece)
                    if size >= HANDED_ON:
                        yield handed_on(batch)
                        size = 0
            if size:
                yield handed_on(batch)

    ranged = made.select(placed("key").alias("at"), "key", "doc_id", "ids").select("at.range", "at.place", "key", "doc_id", "ids").repartition(n_ranges, "place").sortWithinPartitions("range", "key", "doc_id")
    return ranged.mapInArrow(run, f"doc_id {dict(made.dtypes)['doc_id']}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")


def query(spark, sf_dir: str) -> DataFrame:
    """op7: every document of the table."""
    return digest(pack(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def digest(pieces: DataFrame) -> DataFrame:
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
