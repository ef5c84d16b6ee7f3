"""Operator 4: toxicity by a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

Presence counts of character n-grams (4 to 6 letters, within a word and its edges; told apart by ``BITS``-bit hashes) are
gathered from every labelled training text. Each n-gram's log-count ratio scales its feature; n-grams whose ratio isn't
clear of its own standard error are scaled to 0, all others stay. A logistic model with an L2 penalty is fitted on at most
about ``FIT_ROWS`` labelled rows (a documented bound); the counts come from all of them. The weights share a common slope,
from which each n-gram's own deviates as far as the fitted rows show: a clear n-gram that none of them has keeps the slope
times its ratio.

Defined results: null and empty texts get the score of a text without features; only the text is an input of a score, so
equal texts get equal scores; repeated rows each get a row; other columns are ignored; without labelled rows of both
classes every score is the share of class 1 (0 without any rows); empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm import flat, labelled

ORDERS = (4, 5, 6)
BITS = 40
HELD = 1 << 21
FILTER_BITS = 22
BLOCK = 1 << 18
CLEAR = 4.0
FIT_ROWS = 20_000
PENALTY = 1.0
#: Share of the first gradient's (scaled, squared) length at which the fit ends.
CLOSE = 1e-10
_U = np.uint64


def grams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order (text number, slot) of every character n-gram of every text."""
    points, offsets = flat.code_points([f" {x} " for x in texts])
    seq = flat.letters(points)
    owner = np.repeat(np.arange(len(texts)), np.diff(offsets))
    blank = seq == 32
    value = (seq.astype(_U) + _U(1)) * _U(0x9E3779B97F4A7C15)
    key = value.copy()
    inner = np.ones(len(seq), bool)
    for k in range(1, max(ORDERS)):
        n = len(seq) - k
        if n <= 0:
            return
        key = key[:n] * _U(0xD6E8FEB86659FD93) + value[k:]
        inner = inner[:n] if k == 1 else inner[:n] & ~blank[k - 1 : k - 1 + n]
        if k + 1 in ORDERS:
            at = np.flatnonzero(inner & (owner[:n] == owner[k:]))
            yield owner[at], (flat.mix(key[at] + _U(k)) >> _U(64 - BITS)).astype(np.int64)


def _distinct(owner: np.ndarray, slot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text number, slot) without repeats."""
    pairs = np.unique(owner << BITS | slot)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


def _merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    slot, zeros, ones = (np.concatenate(x) for x in zip(*parts))
    unique, where = np.unique(slot, return_inverse=True)
    return unique, np.bincount(where, zeros, len(unique)).astype(np.int64), np.bincount(where, ones, len(unique)).astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class per slot, added up to about ``HELD`` slots at a time; slot -1 counts all texts."""
    parts: list[tuple[np.ndarray, ...]] = []
    for batch in flat.slices(batches):
        label = np.asarray(batch.column("label")).astype(np.int64)
        parts.append((np.array([-1]), np.array([(label == 0).sum()]), np.array([(label == 1).sum()])))
        for owner, slot in grams(flat.texts_of(batch)):
            owner, slot = _distinct(owner, slot)
            parts.append((slot, 1 - label[owner], label[owner]))
        if sum(len(x[0]) for x in parts) > HELD:
            parts = [_merged(parts)]
            if len(parts[0][0]) > HELD // 2:
                yield from _counted(parts.pop())
    if parts:
        yield from _counted(_merged(parts))


def _counted(merged: tuple[np.ndarray, ...]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(merged[0]), 1 << 17):
        yield pa.RecordBatch.from_arrays([pa.array(x[at : at + (1 << 17)]) for x in merged], names=["slot", "n0", "n1"])


@dataclass
class Features:
    """Sorted slots, found by number."""

    slots: np.ndarray

    def __post_init__(self) -> None:
        self.near = np.zeros(1 << FILTER_BITS, bool)
        self.near[self.slots >> (BITS - FILTER_BITS)] = True

    def present(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Distinct (text number, feature number) of the features that texts have, by text."""
        parts = [np.zeros((2, 0), np.int64)]
        for owner, slot in grams(texts) if len(self.slots) else ():
            maybe = np.flatnonzero(self.near[slot >> (BITS - FILTER_BITS)])
            owner, slot = _distinct(owner[maybe], slot[maybe])
            at = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            hit = self.slots[at] == slot
            parts.append(np.stack([owner[hit], at[hit]]))
        owner, number = np.concatenate(parts, axis=1)
        order = np.lexsort((number, owner))
        owner, number = owner[order], number[order]
        new = np.ones(len(owner), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (number[1:] != number[:-1])
        return owner[new], number[new]


@dataclass
class Model:
    """Weights of hashed n-grams (their log-count ratios multiplied in) and the intercept."""

    slots: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, texts: list[str], features: Features | None = None) -> np.ndarray:
        owner, number = (features or Features(self.slots)).present(texts)
        total = np.bincount(owner, weights=self.weights[number], minlength=len(texts))
        return 1 / (1 + np.exp(-np.clip(total + self.intercept, -30, 30)))


def fit(ratios: np.ndarray, sizes: np.ndarray, columns: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights of n-grams with these log-count ratios and the intercept of a penalised logistic model: Newton steps, each
    solved by conjugate gradients as far as the distance from the optimum is worth.

    ``columns`` has the n-grams of all rows, ``sizes`` how many each row has. The parameters are what each n-gram adds to
    the common slope, that slope, and the intercept.
    """
    n, ends = len(ratios), np.concatenate([[0], np.cumsum(sizes)])
    cuts = np.unique(np.searchsorted(ends, np.arange(0, ends[-1] + BLOCK, BLOCK)).clip(0, len(label)))
    blocks = list(zip(cuts[:-1], cuts[1:]))
    ridge = np.full(n + 2, PENALTY)
    ridge[n + 1] = 1e-6

    def times(w: np.ndarray) -> np.ndarray:
        each, out = ratios * (w[:n] + w[n]), np.full(len(label), w[n + 1])
        for low, high in blocks:
            full = low + np.flatnonzero(sizes[low:high])
            if len(full):
                out[full] += np.add.reduceat(each[columns[ends[low] : ends[high]]], ends[full] - ends[low])
        return out

    def gathered(r: np.ndarray) -> np.ndarray:
        out = np.zeros(n)
        for low, high in blocks:
            out += np.bincount(columns[ends[low] : ends[high]], np.repeat(r[low:high], sizes[low:high]), n)
        return out

    def back(r: np.ndarray) -> np.ndarray:
        own = ratios * gathered(r)
        return np.concatenate([own, [own.sum(), r.sum()]])

    def loss(z: np.ndarray, w: np.ndarray) -> float:
        return float((np.logaddexp(0, z) - label * z).sum() + (ridge * w * w).sum() / 2)

    common = times(np.concatenate([np.zeros(n), [1.0, 0.0]]))
    w, z, start = np.zeros(n + 2), np.zeros(len(label)), 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        curve = p * (1 - p) + 1e-9
        gradient = back(label - p) - ridge * w
        scale = 1 / (np.concatenate([ratios**2 * gathered(curve), [(common**2 * curve).sum(), curve.sum()]]) + ridge)
        step, left = np.zeros(n + 2), gradient.copy()
        toward = scale * left
        size = first = left @ toward
        start = start or first
        if first <= CLOSE * start:
            break
        enough = first * min(0.01, max(1e-4, first / start))
        for _ in range(200):
            if size <= enough:
                break
            curved = back(curve * times(toward)) + ridge * toward
            far = size / (toward @ curved)
            step += far * toward
            left -= far * curved
            before, size = size, left @ (scale * left)
            toward = scale * left + size / before * toward
        now, moved, share = loss(z, w), times(step), 1.0
        while share > 1e-6 and loss(z + share * moved, w + share * step) > now:
            share /= 2
        w, z = w + share * step, z + share * moved
    return (w[:n] + w[n]) * ratios, float(w[n + 1])


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from the labelled rows outside the held-out fifth."""
    rows = labelled.training_rows(docs, labels, "toxic")
    counts = flat.map_batches(rows.select("text", "label"), _count, "slot bigint, n0 bigint, n1 bigint").groupBy("slot").agg(F.sum("n0").alias("n0"), F.sum("n1").alias("n1")).persist()
    total = counts.where(F.col("slot") == -1).first()
    zeros, ones = (total.n0, total.n1) if total else (0, 0)
    if not zeros or not ones:
        counts.unpersist()
        share = ones / max(zeros + ones, 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(max(share, 1e-9) / max(1 - share, 1e-9))))
    ratio = F.log((F.col("n1") + 1) / (ones + 2.0)) - F.log((F.col("n0") + 1) / (zeros + 2.0))
    clear = F.abs(ratio) / F.sqrt(1 / (F.col("n1") + 1) + 1 / (F.col("n0") + 1))
    best = counts.where((F.col("slot") >= 0) & (clear >= CLEAR)).select("slot", ratio.alias("ratio")).toArrow().sort_by("slot").combine_chunks()
    counts.unpersist()
    slots, ratios = np.asarray(best["slot"]).astype(np.int64), np.asarray(best["ratio"]).astype(float)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features(slots)
        for batch in flat.slices(batches):
            owner, number = known.present(flat.texts_of(batch))
            bounds = np.searchsorted(owner, np.arange(batch.num_rows + 1)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("label"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(number.astype(np.int32)))], names=["label", "features"])

    sample = labelled.bounded_sample(rows, FIT_ROWS, zeros + ones).select("text", "label")
    fitted = flat.map_batches(sample, features, "label int, features array<int>").toArrow()
    label = np.asarray(fitted["label"]).astype(float)
    sizes = np.asarray(pc.list_value_length(fitted["features"])).astype(np.int64)
    columns = np.asarray(pc.list_flatten(fitted["features"])).astype(np.int32)
    del fitted
    weights, intercept = fit(ratios, sizes, columns, label)
    return Model(slots, weights, intercept)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        features = Features(model.slots)
        for batch in flat.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.scores(flat.texts_of(batch), features))], names=["doc_id", "score"])

    scored = flat.map_batches(docs.select("doc_id", "text"), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
