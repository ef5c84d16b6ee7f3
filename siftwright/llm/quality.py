"""Operator 6: document quality by a factorisation machine.

Features of a text: hashed words, bins of structure statistics (length, symbols, case, digits, white space, repeated words
and lines, word length) and of metadata (whether the stored length fits). The pairwise interactions of all features are
low-rank and are scored in linear time by the sum-of-squares identity. The machine is fitted by Adam on at most about
``FIT_ROWS`` labelled rows (a documented bound).

Defined results: null and empty texts get the score of their bins alone; labels, lang, source and doc_id are never inputs;
repeated rows each get a row; an n_chars that is missing or no number has a bin of its own; without labelled rows every score is 0.5; empty tables
give no rows. Whole texts are scored, whatever their length.
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

WORD_BITS = 14
RANK = 8
FIT_ROWS = 6_000
EPOCHS = 12
#: Batches that a fit takes at least, however few its rows.
LEAST_STEPS = 600
BATCH = 128
THRESHOLD = 0.3
_INSIDE = np.ones(256, bool)
_INSIDE[[9, 10, 11, 12, 13, 32]] = False
# Classes of bytes: 0 other letters, 1 upper case, 2 digit, 3 common marks, 4 other marks, 5 white space, 6 newline, 7 not ASCII.
_CLASS = np.zeros(256, np.int64)
_CLASS[0x21:0x7F] = 4
_CLASS[[ord(c) for c in ".,;:'\"?()-"]] = 3
_CLASS[0x30:0x3A], _CLASS[0x41:0x5B], _CLASS[0x61:0x7B] = 2, 1, 0
_CLASS[[9, 11, 12, 13, 32]], _CLASS[10], _CLASS[0x80:] = 5, 6, 7
_EDGES = {
    "length": [1, 20, 60, 200, 600, 2000, 6000, 20000, 100000],
    "symbols": [0.002, 0.01, 0.02, 0.04, 0.07, 0.12, 0.2, 0.3],
    "upper": [0.005, 0.02, 0.04, 0.08, 0.15, 0.3, 0.5],
    "digits": [0.001, 0.01, 0.05, 0.1, 0.3],
    "blank": [0.05, 0.1, 0.14, 0.18, 0.22, 0.3],
    "lines": [0.5, 2, 5, 10, 20, 50],
    "distinct": [0.02, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9],
    "word": [3, 3.8, 4.4, 5, 5.6, 6.2, 7, 8, 10],
    "foreign": [0.001, 0.02, 0.05, 0.1, 0.2, 0.4],
    "stored": [0.5, 1.5],
}
_PLACE = {name: (1 << WORD_BITS) + 16 * k for k, name in enumerate(_EDGES)}
SIZE = (1 << WORD_BITS) + 16 * len(_EDGES)


def features(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, feature, value) of every feature of every text, by text number."""
    data, offsets = flat.bytes_of(batch)
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    classes = np.bincount(owner * 8 + _CLASS[data], minlength=8 * n).reshape(n, 8)
    starts, ends, hashes, bounds = flat.words_of(data, offsets, _INSIDE)
    words = np.diff(bounds)
    word_owner = np.repeat(np.arange(n), words)
    order = np.lexsort((hashes, word_owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order][1:] != hashes[order][:-1]) | (word_owner[order][1:] != word_owner[order][:-1])
    kept = order[new]
    row, bucket = word_owner[kept], (hashes[kept] & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64)
    distinct = np.bincount(row, minlength=n)
    letters = np.maximum(classes[:, 0] + classes[:, 1] + classes[:, 7], 1)
    size, some = np.maximum(np.diff(offsets), 1), np.maximum(words, 1)
    stored = np.asarray(pc.fill_null(batch.column("n_chars"), -1)) if "n_chars" in batch.schema.names else np.full(n, -1)
    points = np.diff(offsets) - flat.segment_sums(((data & 0xC0) == 0x80).astype(np.int64), offsets)
    statistics = {
        "length": np.diff(offsets),
        "symbols": classes[:, 4] / size,
        "upper": classes[:, 1] / letters,
        "digits": classes[:, 2] / size,
        "blank": (classes[:, 5] + classes[:, 6]) / size,
        "lines": 100 * classes[:, 6] / some,
        "distinct": distinct / some,
        "word": (size - classes[:, 5] - classes[:, 6]) / some,
        "foreign": classes[:, 7] / size,
        "stored": np.where(stored < 0, 0, np.where(stored == points, 1, 2)),
    }
    rows, columns, values = [row], [bucket], [1 / np.sqrt(np.maximum(distinct, 1))[row]]
    for name, x in statistics.items():
        rows.append(np.arange(n))
        columns.append(_PLACE[name] + np.searchsorted(_EDGES[name], x, "right"))
        values.append(np.ones(n))
    row, column, value = np.concatenate(rows), np.concatenate(columns), np.concatenate(values)
    order = np.argsort(row, kind="stable")
    return row[order], column[order], value[order]


@dataclass
class Machine:
    """A factorisation machine: bias, linear weights and low-rank factors."""

    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def raw(self, row: np.ndarray, column: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Log-odds by the sum-of-squares identity, and the sums of the factors."""
        bounds = np.searchsorted(row, np.arange(n + 1))
        part = self.factors[column] * value[:, None]
        sums = flat.segment_sums(part, bounds)
        squares = flat.segment_sums((part * part).sum(axis=1), bounds)
        return self.bias + flat.segment_sums(self.linear[column] * value, bounds) + 0.5 * ((sums * sums).sum(axis=1) - squares), sums

    def scores(self, batch: pa.RecordBatch) -> np.ndarray:
        raw, _ = self.raw(*features(batch), batch.num_rows)
        return 1 / (1 + np.exp(-np.clip(raw, -30, 30)))


def fit(row: np.ndarray, column: np.ndarray, value: np.ndarray, label: np.ndarray, seed: int = 5) -> Machine:
    """Adam over batches of rows, logistic loss with weight decay."""
    random = np.random.default_rng(seed)
    n = len(label)
    share = np.clip(label.mean() if n else 0.5, 0.02, 0.98)
    machine = Machine(float(np.log(share / (1 - share))), np.zeros(SIZE), random.normal(0, 0.05, (SIZE, RANK)))
    bounds = np.searchsorted(row, np.arange(n + 1))
    weights = np.concatenate([machine.linear[:, None], machine.factors], axis=1)
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    step = 0
    batches = max(1, n // BATCH)
    for _ in range(max(EPOCHS, -(-LEAST_STEPS // batches))):
        for chosen in np.array_split(random.permutation(n), batches):
            if not len(chosen):
                continue
            lengths = bounds[chosen + 1] - bounds[chosen]
            at = flat.ranges(bounds[chosen], lengths)
            own, cols, x = np.repeat(np.arange(len(chosen)), lengths), column[at], value[at]
            machine.linear, machine.factors = weights[:, 0], weights[:, 1:]
            raw, sums = machine.raw(own, cols, x, len(chosen))
            error = (1 / (1 + np.exp(-np.clip(raw, -30, 30))) - label[chosen]) / len(chosen)
            machine.bias -= 0.05 * error.sum()
            slope = np.concatenate([x[:, None], x[:, None] * (sums[own] - machine.factors[cols] * x[:, None])], axis=1) * error[own][:, None]
            used, where = np.unique(cols, return_inverse=True)
            gradient = np.zeros((len(used), RANK + 1))
            np.add.at(gradient, where, slope)
            gradient += 1e-5 * weights[used]
            step += 1
            first[used] = 0.9 * first[used] + 0.1 * gradient
            second[used] = 0.999 * second[used] + 0.001 * gradient**2
            weights[used] -= 0.02 * (first[used] / (1 - 0.9**step)) / (np.sqrt(second[used] / (1 - 0.999**step)) + 1e-8)
    machine.linear, machine.factors = weights[:, 0].copy(), weights[:, 1:].copy()
    return machine


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fit on about FIT_ROWS labelled rows outside the held-out fifth."""
    rows = labelled.training_rows(docs, labels, "quality")
    total = labels.where(F.col("quality").isin(0, 1) & ~labelled.held_out()).count()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches):
            row, column, value = features(batch)
            bounds = pa.array(np.searchsorted(row, np.arange(batch.num_rows + 1)).astype(np.int32))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), pa.ListArray.from_arrays(bounds, pa.array(column.astype(np.int32))), pa.ListArray.from_arrays(bounds, pa.array(value.astype(np.float32)))], names=["doc_id", "label", "columns", "values"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    sample = labelled.bounded_sample(rows, FIT_ROWS, total)
    found = flat.map_batches(sample, run, f"doc_id {kind}, label int, columns array<int>, values array<float>").toArrow().sort_by("doc_id").combine_chunks()
    columns, values = found["columns"].combine_chunks(), found["values"].combine_chunks()
    row = np.repeat(np.arange(found.num_rows), np.asarray(pc.list_value_length(columns)).astype(np.int64)) if found.num_rows else np.zeros(0, np.int64)
    return fit(row, np.asarray(columns.flatten()).astype(np.int64), np.asarray(values.flatten()).astype(float), np.asarray(found["label"]).astype(float))


def score(docs: DataFrame, machine: Machine) -> DataFrame:
    """doc_id, held_out, score and predicted of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in flat.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(shared.value.scores(batch))], names=["doc_id", "score"])

    inputs = docs.select("doc_id", "text", *([F.col("n_chars").try_cast("bigint").alias("n_chars")] if "n_chars" in docs.columns else []))
    scored = flat.map_batches(inputs, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", labelled.held_out().alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
