"""Operator 1: language identification by interpolated Kneser-Ney character models.

Per language, n-grams of ``ORDER`` letters are counted over every training text (all rows outside the held-out fifth with a
language). Everything else is aggregation over those counts: continuation counts of the lower orders, discounts, masses of
contexts, and the probabilities, each order interpolated with the next lower one. N-grams of less than a share ``PRUNE`` of
their order's weight give it to the lower order, so that probabilities still add up to one and a language has at most
1 / PRUNE entries an order, in fact far fewer; only the entries kept reach the driver and the tasks. There a model is a
sorted array of 64-bit n-gram hashes with log probabilities, and one of context hashes with back-off weights.

A text gets the language of the lowest cross-entropy per letter. Rejection and score are calibrated on a tenth of the
training rows, scored by a second model that has not counted them: a text is rejected where its cross-entropy lies above
``MARGIN`` times the ``QUANTILE`` of such rows of the language and of about its length, and the score is a softmax of the
sharpness that fits those rows best. Lengths without such rows take the language's highest limit, languages without any
the highest limit of all.

Defined results: null texts and texts without letters are ``und`` with score 0 and are rejected; ties go to the
alphabetically first language; repeated rows each get a row; the text is the only input of a prediction; without training
rows everything is ``und``; without rows to calibrate on only ``und`` is rejected; an empty table gives no rows. Whole
texts are scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftwright.llm import flat, labelled
from siftwright.session import materialise

ORDER = 4
PRUNE = 1e-7
QUANTILE = 0.999
MARGIN = 1.25
#: Bounds of the length classes, in letters, that have a rejection limit of their own.
LENGTHS = (20, 100, 1000)
SHARPNESS = (1.0, 2.0, 3.0, 5.0, 8.0, 12.0, 18.0, 27.0, 40.0)
USUAL_SHARPNESS = 12.0
UNKNOWN = "und"
#: Codes up to which a table of all codes is used instead of sorting, and n-grams whose probabilities a task remembers.
TABLE = 1 << 21
REMEMBERED = 1 << 18
#: N-grams that a task works on at a time, and partitions of the input whose counts one task adds up.
TASK_GRAMS = 100_000
TASK_PARTITIONS = 8
_BITS = 15
_U = np.uint64


def sequence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of all texts, each text led by ORDER - 1 spaces, runs of other characters one space; and the offsets."""
    points, offsets = flat.code_points([" " * (ORDER - 1) + x for x in texts])
    seq = flat.letters(points)
    blank = seq == 32
    keep = np.ones(len(seq), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    lead = offsets[:-1]
    for k in range(ORDER - 1):
        keep[lead + k] = True
    ends = np.concatenate([[0], np.cumsum(keep)])
    return seq[keep], ends[offsets]


def scored_places(offsets: np.ndarray, seq: np.ndarray) -> np.ndarray:
    """Places of the letters that count: all but the spaces put before each text."""
    keep = np.ones(len(seq), bool)
    for k in range(ORDER - 1):
        keep[offsets[:-1] + k] = False
    return np.flatnonzero(keep)


def _numbered(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct codes, number of each code among them); all codes are below ``size``."""
    if size > TABLE:
        return np.unique(codes, return_inverse=True)
    seen = np.zeros(size, bool)
    seen[codes] = True
    values = np.flatnonzero(seen)
    number = np.zeros(size, np.int32)
    number[values] = np.arange(len(values), dtype=np.int32)
    return values, number[codes]


def _counted(codes: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted distinct codes, how often each occurs)."""
    if size > TABLE:
        return np.unique(codes, return_counts=True)
    counts = np.bincount(codes, minlength=size)
    values = np.flatnonzero(counts)
    return values, counts[values]


def grams_at(seq: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(letters of the distinct 4-grams, one row each; number of the 4-gram that ends at each place)."""
    letters, own = _numbered(seq, 0x110000)
    pairs, pair = _numbered(own[:-1].astype(np.int64) * len(letters) + own[1:], len(letters) ** 2)
    found, number = _numbered(pair[place - 3].astype(np.int64) * len(pairs) + pair[place - 1], len(pairs) ** 2)
    two = np.stack([pairs[found // len(pairs)], pairs[found % len(pairs)]], axis=1)
    return letters[np.stack([two // len(letters), two % len(letters)], axis=2).reshape(-1, ORDER)], number


def hashes(letters: np.ndarray) -> np.ndarray:
    """64-bit hashes of n-grams, given as rows of letters."""
    key = np.full(len(letters), 0x51ED2701 + letters.shape[1], _U)
    for k in range(letters.shape[1]):
        key = flat.mix(key * _U(0x9E3779B97F4A7C15) + letters[:, k].astype(_U) + _U(1))
    return key


def _as_text(letters: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(letters.astype(np.uint32)).view(f"<U{letters.shape[1]}")[:, 0].tolist(), pa.string())


class _Counts:
    """Counts of 4-grams per group of texts, for one task: sorted keys of letters numbered as they are met."""

    def __init__(self) -> None:
        self.number = np.full(0x110000, -1, np.int64)
        self.letters = np.zeros(0, np.int64)
        self.held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

    def room_for(self, seq: np.ndarray) -> bool:
        new = np.unique(seq[self.number[seq] < 0])
        if len(self.letters) + len(new) > 1 << _BITS:
            return False
        self.number[new] = len(self.letters) + np.arange(len(new))
        self.letters = np.concatenate([self.letters, new])
        return True

    def add(self, group: int, letters: np.ndarray, counts: np.ndarray) -> None:
        key = np.zeros(len(letters), np.int64)
        for k in range(ORDER):
            key = key << _BITS | self.number[letters[:, k]]
        parts = self.held.setdefault(group, [])
        parts.append((key, counts))
        if sum(len(x[0]) for x in parts) > 1 << 20:
            self.held[group] = [_merged(parts)]

    def batches(self) -> Iterator[pa.RecordBatch]:
        for group, parts in self.held.items():
            keys, counts = _merged(parts)
            for at in range(0, len(keys), 1 << 16):
                key = keys[at : at + (1 << 16)]
                letters = self.letters[np.stack([key >> _BITS * (ORDER - 1 - k) & (1 << _BITS) - 1 for k in range(ORDER)], axis=1)]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(key), group, np.int32)), _as_text(letters), pa.array(counts[at : at + (1 << 16)])], names=["group", "gram", "count"])


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    keys, where = np.unique(np.concatenate([x[0] for x in parts]), return_inverse=True)
    return keys, np.bincount(where, weights=np.concatenate([x[1] for x in parts])).astype(np.int64)


def _count(names: list[str]):
    """Counts of the 4-grams of every group: twice the language's number, and one more for the rows to calibrate on."""
    at = {x: k for k, x in enumerate(names)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = _Counts()
        for batch in flat.slices(batches):
            seq, offsets = sequence(flat.texts_of(batch))
            place = scored_places(offsets, seq)
            group = np.array([2 * at[x] for x in batch.column("lang").to_pylist()]) + np.asarray(batch.column("apart")).astype(np.int64)
            group = np.repeat(group, np.diff(offsets))[place]
            # a part of a slice has few enough letters for a fresh table
            step = len(place) if total.room_for(seq) else 1 << 12
            for low in range(0, len(place), max(step, 1)):
                here = place[low : low + step]
                part = seq[here[0] - ORDER + 1 : here[-1] + 1]
                if not total.room_for(part):
                    yield from total.batches()
                    total = _Counts()
                    total.room_for(part)
                letters, number = grams_at(part, here - here[0] + ORDER - 1)
                codes, counts = _counted(group[low : low + step] * len(letters) + number, 2 * len(names) * len(letters))
                ends = np.searchsorted(codes, np.arange(2 * len(names) + 1) * len(letters))
                for g in np.flatnonzero(np.diff(ends)).tolist():
                    here_of = slice(ends[g], ends[g + 1])
                    total.add(g, letters[codes[here_of] - g * len(letters)], counts[here_of])
        yield from total.batches()

    return run


def _stored(df: DataFrame, tasks: int) -> DataFrame:
    """A table of n-grams in the shared folder, made by as many tasks as its counted rows (or its input) need."""
    return materialise(df.coalesce(max(1, tasks)))


def probabilities(grams: DataFrame, prune: float = PRUNE) -> tuple[DataFrame, int]:
    """Kneser-Ney entries of (language, gram, weight) counts of 4-grams, and the size of the alphabet (with one letter for
    all unseen ones): language, kind (``gram`` or ``context``), text, value (log probability or log back-off weight)."""
    tasks = -(-grams.count() // TASK_GRAMS)
    weights = {ORDER: grams}  # counts of the highest order; of the lower ones, how many different letters stand before
    for n in range(1, ORDER):
        longer = grams.select("language", F.substring("gram", ORDER - n, n + 1).alias("longer")).distinct()
        weights[n] = longer.groupBy("language", F.substring("longer", 2, n).alias("gram")).agg(F.count("*").alias("weight"))
    alphabet = weights[1].select("gram").distinct().count() + 1
    parts, lower = [], None
    for n in range(1, ORDER + 1):
        d, w, context = F.col("discount"), F.col("weight"), Window.partitionBy("language", "context")
        once, twice = F.count_if(w == 1), F.count_if(w == 2)
        share = F.least(F.lit(0.95), F.greatest(F.lit(0.1), once / F.greatest(once + 2 * twice, F.lit(1))))
        per = weights[n].groupBy("language").agg(share.alias("discount"), F.sum("weight").alias("total"))
        kept = F.lit(True) if n == 1 else w >= prune * F.col("total")
        rows = weights[n].join(F.broadcast(per), "language").select("language", "gram", "weight", d, kept.alias("kept"), F.substring("gram", 1, n - 1).alias("context"), F.substring("gram", 2, n - 1).alias("suffix"))
        # a context has at most as many rows as there are letters
        freed = F.sum(F.when(F.col("kept"), F.least(d, w)).otherwise(w)).over(context)
        rows = rows.select("language", "gram", "kept", "context", "suffix", "weight", d, F.sum("weight").over(context).alias("mass"), freed.alias("freed"))
        below: Column = F.lit(1.0 / alphabet)
        if lower is not None:
            rows, below = rows.join(lower, ["language", "suffix"]), F.col("below")
        backoff = F.col("freed") / F.col("mass")
        chance = F.when(F.col("kept"), F.greatest(w - d, F.lit(0.0)) / F.col("mass")).otherwise(0.0) + backoff * below
        rows = _stored(rows.select("language", "gram", "kept", "context", chance.alias("chance"), backoff.alias("backoff")), tasks)
        lower = rows.select("language", F.col("gram").alias("suffix"), F.col("chance").alias("below"))
        parts.append(rows.where("kept").select("language", F.lit("gram").alias("kind"), F.col("gram").alias("text"), F.log("chance").alias("value")))
        parts.append(rows.where("kept").groupBy("language", "context").agg(F.log(F.max("backoff")).alias("value")).select("language", F.lit("context").alias("kind"), F.col("context").alias("text"), "value"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out, alphabet


@dataclass
class Voice:
    """One language: sorted hashes of n-grams with log probabilities, and of contexts with log back-off weights."""

    grams: np.ndarray
    chances: np.ndarray
    contexts: np.ndarray
    backoffs: np.ndarray

    def of(self, hashed: list[np.ndarray], before: list[np.ndarray], unseen: float) -> np.ndarray:
        """Log probabilities of last letters. ``hashed[n - 1]`` has the hashes of the last n letters, ``before[n - 1]``
        those of the n - 1 letters before the last."""
        out, rest = np.zeros(len(hashed[0])), np.arange(len(hashed[0]))
        for n in range(ORDER, 0, -1):
            at = np.minimum(np.searchsorted(self.grams, hashed[n - 1][rest]), len(self.grams) - 1)
            hit = self.grams[at] == hashed[n - 1][rest] if len(self.grams) else np.zeros(len(rest), bool)
            out[rest[hit]] += self.chances[at[hit]]
            rest = rest[~hit]
            at = np.minimum(np.searchsorted(self.contexts, before[n - 1][rest]), len(self.contexts) - 1)
            known = self.contexts[at] == before[n - 1][rest] if len(self.contexts) else np.zeros(len(rest), bool)
            out[rest[known]] += self.backoffs[at[known]]
        out[rest] += unseen
        return out


@dataclass
class Model:
    """Languages in order of their names, rejection limits per language and length class, and the score's sharpness."""

    names: list[str]
    voices: list[Voice] = field(default_factory=list)
    unseen: float = 0.0
    limits: dict[str, np.ndarray] = field(default_factory=dict)
    sharpness: float = USUAL_SHARPNESS

    def chances(self, letters: np.ndarray) -> np.ndarray:
        """Log probability of the last letter of every 4-gram in every language."""
        hashed = [hashes(letters[:, ORDER - n :]) for n in range(1, ORDER + 1)]
        before = [hashes(letters[:, ORDER - n : ORDER - 1]) for n in range(1, ORDER + 1)]
        return np.stack([v.of(hashed, before, self.unseen) for v in self.voices], axis=1).astype(np.float32)


class Reader:
    """Scores texts by a model; remembers the probabilities of n-grams that it has met."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.keys, self.rows = np.zeros(0, _U), np.zeros((0, len(self.model.names)), np.float32)

    def _chances(self, letters: np.ndarray) -> np.ndarray:
        key = hashes(letters)
        at = np.searchsorted(self.keys, key)
        new = np.ones(len(key), bool)
        inside = at < len(self.keys)
        new[inside] = self.keys[at[inside]] != key[inside]
        if new.any():
            if len(self.keys) + new.sum() > REMEMBERED:
                self._forget()
                new[:] = True
            keys, rows = np.concatenate([self.keys, key[new]]), np.concatenate([self.rows, self.model.chances(letters[new])])
            order = np.argsort(keys)
            self.keys, self.rows = keys[order], rows[order]
            at = np.searchsorted(self.keys, key)
        return self.rows[at]

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(cross-entropy per letter of every text and language, scored letters of every text)."""
        seq, offsets = sequence(texts)
        place = scored_places(offsets, seq)
        bounds = np.searchsorted(place, offsets)
        letters, sums = np.diff(bounds), np.zeros((len(texts), len(self.model.names)))
        full = np.flatnonzero(letters)
        if len(full):
            grams, number = grams_at(seq, place)
            chances = self._chances(grams)
            for k in range(len(self.model.names)):
                sums[full, k] = np.add.reduceat(chances[:, k][number], bounds[:-1][full], dtype=np.float64)
        return -sums / np.maximum(letters, 1)[:, None], letters


def _letters_of(texts: pa.Array) -> np.ndarray:
    """Code points of all texts, one after the other, without a Python value per text."""
    data, _ = flat.bytes_of(pa.RecordBatch.from_arrays([texts], names=["text"]))
    return np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)


def _voices(entries: pa.Table, languages: int) -> list[Voice]:
    """Sorted hash arrays of every language from its entries."""
    language, value = np.asarray(entries["language"]), np.asarray(entries["value"]).astype(np.float32)
    is_gram = np.asarray(pc.equal(entries["kind"], "gram"))
    texts = entries["text"].combine_chunks()
    sizes = np.asarray(pc.utf8_length(texts)).astype(np.int64)
    letters, starts = _letters_of(texts), np.cumsum(sizes) - sizes
    key = np.zeros(len(texts), _U)
    for n in range(ORDER + 1):
        own = np.flatnonzero(sizes == n)
        key[own] = hashes(letters[starts[own][:, None] + np.arange(n)])
    out = []
    for k in range(languages):
        parts = []
        for chosen in (is_gram, ~is_gram):
            at = np.flatnonzero((language == k) & chosen)
            at = at[np.argsort(key[at])]
            parts += [key[at], value[at]]
        out.append(Voice(*parts))
    return out


def estimated(grams: DataFrame, names: list[str], calibrating: bool = False) -> list[Model]:
    """Models of (language number, gram, weight) counts: languages from len(names) on belong to a second model."""
    entries, alphabet = probabilities(grams)
    wide = len(names)
    voices = _voices(entries.toArrow().combine_chunks(), 2 * wide if calibrating else wide)
    unseen = float(-np.log(alphabet))
    return [Model(names, voices[k : k + wide], unseen) for k in range(0, len(voices), wide)]


def train(docs: DataFrame) -> Model:
    """Learn from all rows outside the held-out fifth that have a language and a text."""
    rows = docs.where(~labelled.held_out() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang", (F.pmod(F.xxhash64("doc_id", "text"), F.lit(10)) == 0).alias("apart"))
    names = sorted(r.lang for r in rows.select("lang").distinct().collect())
    if not names:
        return Model([])
    counts = flat.map_batches(rows, _count(names), "group int, gram string, count bigint")
    summed = counts.groupBy("group", "gram").agg(F.sum("count").alias("count"))
    grams = _stored(_both(summed, len(names)), max(16, rows.rdd.getNumPartitions() // TASK_PARTITIONS))
    if grams.isEmpty():
        return Model([])
    model, other = estimated(grams, names, calibrating=True)
    return calibrated(rows.where("apart").select("text", "lang"), model, other)


def _both(summed: DataFrame, languages: int) -> DataFrame:
    """language, gram, weight of a model that counts all rows and, numbered after it, of one without those kept apart."""
    number = (F.col("group") / 2).cast("int")
    both = F.array(number, F.when(F.col("group") % 2 == 0, number + languages))
    return summed.select("gram", "count", F.explode(both).alias("language")).where("language IS NOT NULL").groupBy("language", "gram").agg(F.sum("count").alias("weight"))


def calibrated(rows: DataFrame, model: Model, other: Model) -> Model:
    """Set the rejection limits and the sharpness of ``model`` by rows that ``other`` has not counted."""
    shared = rows.sparkSession.sparkContext.broadcast(other)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, reader = {x: k for k, x in enumerate(shared.value.names)}, Reader(shared.value)
        for batch in flat.slices(batches):
            entropy, letters = reader.entropies(flat.texts_of(batch))
            language = np.array([number[x] for x in batch.column("lang").to_pylist()])
            own = entropy[np.arange(batch.num_rows), language]
            fits = [pa.array(-np.log(np.exp(np.clip(s * (own[:, None] - entropy), -50, 50)).sum(axis=1))) for s in SHARPNESS]
            keep = pa.array(letters > 0)
            yield pa.RecordBatch.from_arrays([batch.column("lang"), pa.array(np.searchsorted(LENGTHS, letters, "right")), pa.array(own), *fits], names=["lang", "length", "entropy", *_FITS]).filter(keep)

    scored = flat.map_batches(rows, run, "lang string, length bigint, entropy double, " + ", ".join(f"{x} double" for x in _FITS))
    found = scored.groupBy("lang", "length").agg(F.percentile_approx("entropy", QUANTILE, 100_000).alias("most"), *(F.sum(x).alias(x) for x in _FITS)).collect()
    shared.destroy()
    limits = {x: np.full(len(LENGTHS) + 1, np.nan) for x in model.names}
    for r in found:
        limits[r.lang][r.length] = MARGIN * r.most
    highest = np.nanmax([r.most * MARGIN for r in found]) if found else np.inf
    for x in limits.values():
        x[np.isnan(x)] = np.nanmax(x) if not np.isnan(x).all() else highest
    model.limits = limits
    if found:
        model.sharpness = max(zip((sum(r[x] for r in found) for x in _FITS), SHARPNESS))[1]
    return model


_FITS = [f"fit{k}" for k in range(len(SHARPNESS))]


def identify(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), prefix: str = "") -> DataFrame:
    """``keep`` columns, lang_pred, score, cross_entropy and rejected of every row. The added names get the prefix, which
    must keep them apart from those of ``keep``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    added = [prefix + x for x in ("lang_pred", "score", "cross_entropy", "rejected")]
    columns = [c for c in keep if c not in added]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, reader = shared.value, Reader(shared.value)
        names = [*m.names, UNKNOWN]
        limits = np.array([*(m.limits.get(x, np.full(len(LENGTHS) + 1, np.inf)) for x in m.names), np.full(len(LENGTHS) + 1, np.inf)])
        for batch in flat.slices(batches):
            n = batch.num_rows
            texts = flat.texts_of(batch)
            spoken = np.array([bool(m.names) and any(map(str.isalpha, x)) for x in texts])
            best, score, entropy, letters = np.full(n, len(names) - 1), np.zeros(n), np.full(n, np.nan), np.zeros(n, np.int64)
            if spoken.any():
                found, letters = reader.entropies(texts)
                first = found.argmin(axis=1)
                low = found[np.arange(n), first]
                near = 1 / np.exp(np.clip(m.sharpness * (low[:, None] - found), -50, 0)).sum(axis=1)
                best, score, entropy = np.where(spoken, first, best), np.where(spoken, near, 0.0), np.where(spoken, low, np.nan)
            rejected = ~spoken | (np.nan_to_num(entropy) > limits[best, np.searchsorted(LENGTHS, letters, "right")])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array([names[k] for k in best.tolist()], pa.string()), pa.array(score), pa.array(entropy, from_pandas=True), pa.array(rejected)], names=[*columns, *added])

    schema = flat.schema_of(docs, columns, ", ".join(f"{name} {kind}" for name, kind in zip(added, ("string", "double", "double", "boolean"))))
    return flat.map_batches(docs.select(*dict.fromkeys([*columns, "text"])), run, schema)
