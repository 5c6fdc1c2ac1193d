"""Operator 8, language identification by a byte convolutional network trained in numpy.

A window of ``window`` bytes is embedded byte by byte; filters of several widths run over it, the largest answer of each is kept, and a
softmax over them gives the languages. A document is cut into windows from its first byte to its last; its scores are the mean of its
windows' logarithms, weighted by length.

The network is fitted on the driver, on at most ``sample`` labelled documents with the smallest hashes of their ids, and of each on at
most ``windows_each`` windows; these two bound what the driver holds. The weights, some tens of KB, travel with the function.

Defined results: a null text, and one without a letter, is ``und`` with score 0; without labelled rows every text is ``und``; repeated
rows are judged one by one; a null id counts as held out of nothing (held_out is null); empty tables give empty results; other columns
are ignored by ``predict`` and kept by ``confident``.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkscope.llm.common import free_name, quoted

UNKNOWN = "und"


@dataclass(frozen=True)
class LanguageRules:
    window: int = 128
    embedding: int = 8
    widths: tuple[int, ...] = (2, 3, 4)
    filters: int = 12
    sample: int = 2000
    windows_each: int = 3
    epochs: int = 5
    folds: int = 5
    min_score: float = 0.5


def held_out(id_col: Column, folds: int = 5) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % folds == 0


class ByteNetwork:
    """Weights, and what they say of windows (rows of bytes, zero beyond the end)."""

    def __init__(self, rules: LanguageRules, classes: list[str], seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.rules, self.classes = rules, classes
        self.embed = rng.normal(0, 0.3, (256, rules.embedding)).astype(np.float32)
        self.kernels = [rng.normal(0, 1 / np.sqrt(w * rules.embedding), (w * rules.embedding, rules.filters)).astype(np.float32) for w in rules.widths]
        self.shifts = [np.zeros(rules.filters, dtype=np.float32) for _ in rules.widths]
        self.out = rng.normal(0, 0.1, (rules.filters * len(rules.widths), len(classes))).astype(np.float32)
        self.bias = np.zeros(len(classes), dtype=np.float32)

    def weights(self) -> list[np.ndarray]:
        return [self.embed, *self.kernels, *self.shifts, self.out, self.bias]

    def _spans(self, embedded: np.ndarray, width: int) -> np.ndarray:
        n, length, e = embedded.shape
        a, b, c = embedded.strides
        return np.lib.stride_tricks.as_strided(embedded, (n, length - width + 1, width * e), (a, b, c)).reshape(-1, width * e)

    def forward(self, windows: np.ndarray) -> tuple[np.ndarray, list]:
        embedded, pooled, kept = self.embed[windows], [], []
        for width, kernel, shift in zip(self.rules.widths, self.kernels, self.shifts, strict=True):
            spans = self._spans(embedded, width)
            answers = (spans @ kernel).reshape(len(windows), -1, kernel.shape[1])
            where = answers.argmax(axis=1)
            best = np.maximum(np.take_along_axis(answers, where[:, None, :], axis=1)[:, 0, :] + shift, 0)
            pooled.append(best)
            kept.append((spans, where, best))
        return np.concatenate(pooled, axis=1), kept

    def log_softmax(self, windows: np.ndarray) -> np.ndarray:
        hidden, _ = self.forward(windows)
        z = hidden @ self.out + self.bias
        z -= z.max(axis=1, keepdims=True)
        return z - np.log(np.exp(z).sum(axis=1, keepdims=True))

    def gradients(self, windows: np.ndarray, labels: np.ndarray) -> list[np.ndarray]:
        hidden, kept = self.forward(windows)
        z = hidden @ self.out + self.bias
        p = np.exp(z - z.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        p[np.arange(len(labels)), labels] -= 1
        p /= len(labels)
        d_hidden, f, e = p @ self.out.T, self.rules.filters, self.rules.embedding
        d_embed, d_kernels, d_shifts = np.zeros_like(self.embed), [], []
        for k, (width, kernel, (spans, where, best)) in enumerate(zip(self.rules.widths, self.kernels, kept, strict=True)):
            d = d_hidden[:, k * f : (k + 1) * f] * (best > 0)
            rows = np.arange(len(windows))[:, None] * (windows.shape[1] - width + 1) + where
            picked = spans[rows]  # windows, filters, width * embedding
            d_kernels.append(np.einsum("nfs,nf->sf", picked, d))
            d_shifts.append(d.sum(axis=0))
            d_spans = (d[:, :, None] * kernel.T[None]).reshape(*where.shape, width, e)
            for j in range(width):
                np.add.at(d_embed, windows[np.arange(len(windows))[:, None], where + j], d_spans[:, :, j, :])
        return [d_embed, *d_kernels, *d_shifts, hidden.T @ p, p.sum(axis=0)]

    def fit(self, windows: np.ndarray, labels: np.ndarray, seed: int = 2, rate: float = 0.01, batch: int = 64) -> None:
        """Adam, the rate falling to nothing over the epochs."""
        rng, steps = np.random.default_rng(seed), 0
        first, second = [np.zeros_like(w) for w in self.weights()], [np.zeros_like(w) for w in self.weights()]
        total = self.rules.epochs * -(-len(labels) // batch)
        for _ in range(self.rules.epochs):
            order = rng.permutation(len(labels))
            for at in range(0, len(order), batch):
                some = order[at : at + batch]
                steps += 1
                for w, g, m, v in zip(self.weights(), self.gradients(windows[some], labels[some]), first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    w -= rate * (1 - steps / (total + 1)) * (m / (1 - 0.9**steps)) / (np.sqrt(v / (1 - 0.99**steps)) + 1e-8)


def windows_of(text: str, size: int) -> np.ndarray:
    """The bytes of the whole text as rows of ``size``; the last is filled up with zeros."""
    data = np.frombuffer(text.encode("utf-8", "surrogatepass"), dtype=np.uint8)
    rows = np.zeros(-(-len(data) // size) * size, dtype=np.uint8)
    rows[: len(data)] = data
    return rows.reshape(-1, size)


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: LanguageRules | None = None) -> ByteNetwork | None:
    """A network for the labels of the documents that are not held out, or None if there are none."""
    rules = rules or LanguageRules()
    slim = docs.select(quoted(id_col).alias("id"), quoted(text_col).alias("text"), quoted(lang_col).alias("lang"))
    labelled = slim.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("id").isNotNull() & ~held_out(F.col("id"), rules.folds))
    # Windows from even places of the text, so that the driver gets windows_each short strings a document.
    step = rules.window * rules.windows_each
    pieces = F.transform(F.sequence(F.lit(0), F.lit(rules.windows_each - 1)), lambda k: F.substring(F.col("text"), (k * F.length("text") / rules.windows_each).cast("int") + 1, F.lit(rules.window)))
    # Only rows whose hash is small enough for some three times the sample are sent, so that what tasks send does not grow with their number.
    order = F.pmod(F.xxhash64(F.col("id").cast("string")), F.lit(1 << 40))
    n = slim.where(F.col("lang").isNotNull() & F.col("id").isNotNull()).count()
    few = labelled.where(order < int((1 << 40) * min(1.0, 3 * rules.sample / max(1, n))))
    picked = few.select(order.alias("h"), F.col("id").cast("string").alias("id"), "lang", F.when(F.length("text") <= step, F.array(F.col("text"))).otherwise(pieces).alias("pieces"))
    rows = picked.orderBy("h", "id", "lang").limit(rules.sample).collect()
    classes = sorted({r["lang"] for r in rows})
    if not classes:
        return None
    windows, labels = [], []
    for r in rows:
        for piece in r["pieces"]:
            for w in windows_of(piece, rules.window)[: rules.windows_each]:
                if np.count_nonzero(w) >= min(16, rules.window):
                    windows.append(w)
                    labels.append(classes.index(r["lang"]))
    network = ByteNetwork(rules, classes)
    if windows:
        network.fit(np.stack(windows), np.array(labels))
    return network


def _has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def _score(texts: list[str | None], network: ByteNetwork) -> tuple[list[str], list[float]]:
    """Windows of many texts go through the network together, a bounded number at a time."""
    names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
    sums = np.zeros((len(texts), len(network.classes)))
    weights = np.zeros(len(texts))
    size, held, owner, n = network.rules.window, [], [], 0

    def flush() -> None:
        if held:
            rows, who = np.concatenate(held), np.concatenate(owner)
            filled = (rows != 0).sum(axis=1)
            np.add.at(sums, who, network.log_softmax(rows) * filled[:, None])
            np.add.at(weights, who, filled)

    for i, text in enumerate(texts):
        if text and _has_letter(text):
            rows = windows_of(text, size)
            for at in range(0, len(rows), 1024):
                held.append(rows[at : at + 1024])
                owner.append(np.full(len(held[-1]), i))
                n += len(held[-1])
                if n >= 1024:
                    flush()
                    held, owner, n = [], [], 0
    flush()
    for i in np.flatnonzero(weights):
        p = np.exp(sums[i] / weights[i] - (sums[i] / weights[i]).max())
        best = int(p.argmax())
        names[i], scores[i] = network.classes[best], float(p[best] / p.sum())
    return names, scores


def predict(docs: DataFrame, network: ByteNetwork | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: the id as doc_id, lang_pred and score."""
    slim = docs.select(quoted(id_col).alias("doc_id"), quoted(text_col).alias("text"))
    if network is None:
        return slim.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                names, scores = _score(some.column("text").to_pylist(), network)
                yield pa.RecordBatch.from_arrays([some.column("doc_id"), pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return slim.mapInArrow(run, f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def confident(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rules: LanguageRules | None = None) -> DataFrame:
    """The rows whose language is known with at least min_score, with all their columns."""
    rules = rules or LanguageRules()
    network = train(docs, id_col, text_col, lang_col, rules)
    name = free_name(docs, "row")
    packed = docs.select(F.struct(*[quoted(c) for c in docs.columns]).alias(name), quoted(text_col).alias("text"))
    sure = predict(packed, network, name, "text").where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= rules.min_score))
    return sure.select(*[F.col("doc_id").getField(c).alias(c) for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    """op8: every document of the table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return predict(docs, train(docs)).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def in_fold(doc_id: object, folds: int = 5) -> bool:
    """As held_out, for tests."""
    return zlib.crc32(str(doc_id).encode()) % folds == 0
