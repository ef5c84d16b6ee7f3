"""Operator 3: benchmark decontamination by training suffix arrays.

Every shard of training documents gets a word-level suffix array; every suffix of the benchmark items is binary-searched
in it. That gives each suffix's longest verbatim match with its location, and the range of all places where a window of
13 item words occurs. Shards are slices of a Spark task, documents never cross a shard, so no row is shuffled.

A word takes its rank in the benchmark's vocabulary and 0 outside it; 0 also ends documents and items, so no match runs
through it. Several ranks are packed into one 64-bit key, and suffixes are ordered by their keys, ties by the next keys.
The benchmark is dealt into compressed blocks of bounded size, which go to every task; a task unpacks one at a time and
searches it in all the documents that it holds, so documents pass once. Benchmarks of more than ``PASS_CHARS`` characters
take several passes.

Defined results: a null or empty text has no words and no hits; a null or word-free item has no window; items that share
an id count once; repeated rows and ties each give their own row; columns other than text are carried along untouched;
empty tables give no rows or no hits. Texts of any length are searched whole.
"""

from __future__ import annotations

import hashlib
import pickle
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwright.llm import flat

WINDOW = 13
BLOCK_CHARS = 4_000_000
PASS_CHARS = 1_000_000_000
SHARD_BYTES = 1 << 20
#: Shards that a task holds while it goes through several blocks.
SHARDS = 16
_WORD = np.zeros(256, bool)
_WORD[0x30:0x3A] = _WORD[0x41:0x5B] = _WORD[0x61:0x7B] = _WORD[0x80:] = True


@dataclass
class Items:
    """A block of benchmark items: their words as ranks, 0 after each item."""

    ids: list[str]
    vocabulary: np.ndarray
    ranks: np.ndarray
    owner: np.ndarray
    window: np.ndarray
    longest: int

    @property
    def bits(self) -> int:
        return max(1, int(len(self.vocabulary)).bit_length())

    @property
    def packed(self) -> int:
        return max(1, 63 // self.bits)


def items_of(rows: list[tuple[str, str]], window: int = WINDOW) -> Items:
    """Arrays of (id, text) rows. ``window`` holds, for each place, the words of the window that begins there, or 0."""
    ids = sorted({i for i, _ in rows})
    number = {x: k for k, x in enumerate(ids)}
    batch = pa.RecordBatch.from_arrays([pa.array([t for _, t in rows], pa.string())], names=["text"])
    data, offsets = flat.bytes_of(batch)
    *_, hashes, bounds = flat.words_of(data, offsets, _WORD)
    vocabulary = np.unique(hashes)
    counts = np.diff(bounds)
    spread = flat.ranges(bounds[:-1] + np.arange(len(rows)), counts)
    ranks, owner, windows = (np.zeros(len(hashes) + len(rows), np.int64) for _ in range(3))
    ranks[spread] = np.searchsorted(vocabulary, hashes) + 1
    owner[spread] = np.repeat([number[i] for i, _ in rows], counts) if rows else 0
    left = np.repeat(counts, counts) - flat.ranges(np.zeros(len(counts), np.int64), counts)
    whole = np.repeat(np.minimum(counts, window), counts)
    windows[spread] = np.where(left >= whole, whole, 0)
    return Items(ids, vocabulary, ranks, owner, windows, int(counts.max(initial=0)))


def keys_of(ranks: np.ndarray, bits: int, packed: int) -> tuple[np.ndarray, np.ndarray]:
    """(packed keys, words up to the next 0, ``packed`` at most) of every place."""
    n = len(ranks)
    wide = np.concatenate([ranks, np.zeros(packed, np.int64)])
    keys, run, alive = np.zeros(n, np.int64), np.zeros(n, np.int64), np.ones(n, bool)
    for k in range(packed):
        at = wide[k : k + n]
        alive &= at > 0
        keys |= np.where(alive, at, 0) << bits * (packed - 1 - k)
        run += alive
    return keys, run


class Suffixes:
    """A suffix array of a shard: places with a word of the vocabulary, in the order of what follows them."""

    def __init__(self, ranks: np.ndarray, items: Items):
        self.bits, self.packed = items.bits, items.packed
        self.keys, self.run = keys_of(ranks, self.bits, self.packed)
        self.item_keys, self.item_run = keys_of(items.ranks, self.bits, self.packed)
        places = np.flatnonzero(ranks)
        order = np.argsort(self.keys[places])
        places = places[order]
        keys = self.keys[places]
        new = np.ones(len(places), bool)
        new[1:] = keys[1:] != keys[:-1]
        at = np.arange(len(places))
        depth = 1
        while depth * self.packed < items.longest:
            group = np.cumsum(new)
            tied = ~new
            tied[:-1] |= ~new[1:]
            tied &= self.run[np.minimum(places[at] + (depth - 1) * self.packed, len(ranks) - 1)] == self.packed
            if not tied.any():
                break
            at, group = at[tied], group[tied]
            deeper = self._key(self.keys, places[at] + depth * self.packed)
            order = np.lexsort((deeper, group))
            places[at] = places[at][order]
            deeper = deeper[order]
            new = np.ones(len(at), bool)
            new[1:] = (group[1:] != group[:-1]) | (deeper[1:] != deeper[:-1])
            depth += 1
        self.places = places

    @staticmethod
    def _key(keys: np.ndarray, at: np.ndarray) -> np.ndarray:
        return np.where(at < len(keys), keys[np.minimum(at, len(keys) - 1)], 0)

    def _masks(self, words: np.ndarray) -> np.ndarray:
        kept = np.clip(words, 0, self.packed)
        return ~((np.int64(1) << self.bits * (self.packed - kept)) - 1)

    def compare(self, suffix: np.ndarray, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        """-1, 0 or 1: how the text at ``places`` stands to the first ``words`` words of item suffixes."""
        out = np.zeros(len(suffix), np.int8)
        todo, depth = np.arange(len(suffix)), 0
        while len(todo):
            step = depth * self.packed
            mask = self._masks(words[todo] - step)
            a, b = self._key(self.keys, places[todo] + step) & mask, self._key(self.item_keys, suffix[todo] + step) & mask
            out[todo] = np.sign(a - b)
            todo = todo[(a == b) & (words[todo] > step + self.packed)]
            depth += 1
        return out

    def bounds(self, suffix: np.ndarray, words: np.ndarray, after: bool) -> np.ndarray:
        """Binary search: the first place of the array that isn't before (with ``after``: is behind) the words."""
        low, high = np.zeros(len(suffix), np.int64), np.full(len(suffix), len(self.places))
        while (todo := np.flatnonzero(low < high)).size:
            middle = (low[todo] + high[todo]) // 2
            sign = self.compare(suffix[todo], self.places[middle], words[todo])
            right = sign <= 0 if after else sign < 0
            low[todo[right]] = middle[right] + 1
            high[todo[~right]] = middle[~right]
        return low

    def shared(self, suffix: np.ndarray, places: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Words that item suffixes and the text at ``places`` have in common at their start."""
        out = np.zeros(len(suffix), np.int64)
        todo, depth = np.arange(len(suffix)), 0
        while len(todo):
            step = depth * self.packed
            a, b = self._key(self.keys, places[todo] + step), self._key(self.item_keys, suffix[todo] + step)
            same = np.zeros(len(todo), np.int64)
            for k in range(1, self.packed + 1):
                same += (a ^ b) >> self.bits * (self.packed - k) == 0
            same = np.minimum(same, np.minimum(words[todo] - step, np.where(places[todo] + step < len(self.run), self.run[np.minimum(places[todo] + step, len(self.run) - 1)], 0)))
            out[todo] += same
            todo = todo[same == self.packed]
            depth += 1
        return np.minimum(out, words)


def search(data: np.ndarray, offsets: np.ndarray, items: Items) -> dict[str, object]:
    """Words, hit intervals, items and longest match of every document of a shard."""
    *_, hashes, bounds = flat.words_of(data, offsets, _WORD)
    n, counts = len(offsets) - 1, np.diff(bounds)
    spread = flat.ranges(bounds[:-1] + np.arange(n), counts)
    ranks, document = np.zeros(len(hashes) + n, np.int64), np.zeros(len(hashes) + n, np.int64)
    if len(items.vocabulary) and len(hashes):
        at = np.minimum(np.searchsorted(items.vocabulary, hashes), len(items.vocabulary) - 1)
        ranks[spread] = np.where(items.vocabulary[at] == hashes, at + 1, 0)
    document[spread] = np.repeat(np.arange(n), counts)
    begin = bounds[:-1] + np.arange(n)
    best, best_item, best_at = np.zeros(n, np.int64), np.full(n, -1, np.int64), np.full(n, -1, np.int64)
    starts = ends = pair_document = pair_item = np.zeros(0, np.int64)
    if ranks.any():
        array = Suffixes(ranks, items)
        suffix = np.flatnonzero(items.ranks)
        stop = np.flatnonzero(items.ranks == 0)
        words = stop[np.searchsorted(stop, suffix)] - suffix
        near = array.bounds(suffix, words, False)
        for side in (near - 1, near):
            ok = (side >= 0) & (side < len(array.places))
            place = array.places[np.clip(side, 0, len(array.places) - 1)]
            length = np.where(ok, array.shared(suffix, place, words), 0)
            order = np.lexsort((-suffix, length))
            owner = document[place[order]]
            longer = length[order] > best[owner]
            order, owner = order[longer], owner[longer]
            best[owner], best_item[owner], best_at[owner] = length[order], items.owner[suffix[order]], place[order] - begin[owner]
        size = items.window[suffix]
        whole = suffix[size > 0]
        size = size[size > 0]
        low, high = array.bounds(whole, size, False), array.bounds(whole, size, True)
        found = high > low
        low, count, size, owner = low[found], (high - low)[found], size[found], items.owner[whole[found]]
        # equal windows have the same range of the array; those of one size have no place in common
        window, first, which = np.unique(low * (items.longest + 1) + size, return_index=True, return_inverse=True)
        low, count, size = low[first], count[first], size[first]
        place = array.places[flat.ranges(low, count)]
        edge = np.bincount(place, minlength=len(ranks) + 1) - np.bincount(place + np.repeat(size, count), minlength=len(ranks) + 1)
        hit = np.zeros(len(ranks) + 1, bool)
        hit[1:] = np.cumsum(edge)[:-1] > 0
        starts, ends = np.flatnonzero(hit[1:] & ~hit[:-1]), np.flatnonzero(hit[:-1] & ~hit[1:])
        ends = np.append(ends, len(ranks)) if len(ends) < len(starts) else ends
        pair_document, pair_item = _items_of_documents(np.unique(document[place] * len(window) + np.repeat(np.arange(len(window)), count)), len(window), which, owner, len(items.ids))
    of = document[starts]
    return {"n_words": counts, "starts": starts - begin[of], "ends": ends - begin[of], "interval_bounds": np.searchsorted(of, np.arange(n + 1)), "items": pair_item, "item_bounds": np.searchsorted(pair_document, np.arange(n + 1)), "longest": best, "longest_item": best_item, "longest_at": best_at}


def _items_of_documents(seen: np.ndarray, windows: int, which: np.ndarray, owner: np.ndarray, many: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document, item) of distinct (document, window) codes; ``which`` and ``owner`` have the windows' items."""
    pairs = np.unique(which * many + owner)
    bounds = np.searchsorted(pairs // many, np.arange(windows + 1))
    document, window = seen // windows if windows else seen, seen % windows if windows else seen
    each = np.diff(bounds)[window]
    out = [np.zeros(0, np.int64)]
    cuts = np.searchsorted(np.cumsum(each), np.arange(1 << 20, int(each.sum()) + (1 << 20), 1 << 20), "right")
    for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(seen)]):
        if b > a:
            item = pairs[flat.ranges(bounds[window[a:b]], each[a:b])] % many
            out.append(np.unique(np.repeat(document[a:b], each[a:b]) * many + item))
    found = np.unique(np.concatenate(out))
    return found // max(many, 1), found % max(many, 1)


def merged(intervals: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open intervals."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(intervals):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _passes(benchmark: DataFrame) -> Iterator[list[bytes]]:
    """The benchmark in lists of compressed blocks: about BLOCK_CHARS characters a block, PASS_CHARS a list."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    blocks, rows, size = [], [], 0
    for r in items.toLocalIterator():
        rows.append((r.id, r.text))
        size += len(r.text)
        if size >= BLOCK_CHARS:
            blocks.append(_packed(rows))
            rows, size = [], 0
        if len(blocks) * BLOCK_CHARS >= PASS_CHARS:
            yield blocks
            blocks = []
    if rows:
        blocks.append(_packed(rows))
    if blocks:
        yield blocks


def _packed(rows: list[tuple[str, str]]) -> bytes:
    return zlib.compress(pickle.dumps(rows), 1)


def _tasks_over(batches: Iterator[pa.RecordBatch], blocks: int) -> Iterator[list[pa.RecordBatch]]:
    """Shards in the groups that a task goes through at once: one by one while there is a single block."""
    held = []
    for batch in flat.slices(batches, most=SHARD_BYTES):
        held.append(batch)
        if len(held) >= (SHARDS if blocks > 1 else 1):
            yield held
            held = []
    if held:
        yield held


def find_overlaps(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, into: str = "overlap") -> DataFrame:
    """All columns of ``docs`` and a struct column ``into`` (a column of that name is replaced): n_words, hit (intervals of word places), items (their ids),
    longest, longest_item and longest_at (length, item and place of the longest verbatim match)."""
    overlap = f"{into} struct<n_words:bigint,hit:array<struct<start:bigint,end:bigint>>,items:array<string>,longest:bigint,longest_item:string,longest_at:bigint>"
    kind = pa.struct([("n_words", pa.int64()), ("hit", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string())), ("longest", pa.int64()), ("longest_item", pa.string()), ("longest_at", pa.int64())])
    plain = [c for c in docs.columns if c != into]
    schema = flat.schema_of(docs, plain, overlap)
    out = docs.select(*plain)
    for blocks in list(_passes(benchmark)) or [[_packed([])]]:
        shared = docs.sparkSession.sparkContext.broadcast(blocks)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            packed = shared.value
            items = items_of(pickle.loads(zlib.decompress(packed[0])), window)
            for held in _tasks_over(batches, len(packed)):
                rows = [batch.column(into).to_pylist() if into in batch.schema.names else [None] * batch.num_rows for batch in held]
                for k, block in enumerate(packed):
                    items = items if len(packed) == 1 else items_of(pickle.loads(zlib.decompress(block)), window)
                    rows = [_overlaps(batch, items, earlier) for batch, earlier in zip(held, rows)]
                for batch, found in zip(held, rows):
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), pa.array(found, kind)], names=[*plain, into])

        out = flat.map_batches(out, run, schema)
    return out


def _overlaps(batch: pa.RecordBatch, items: Items, earlier: list[dict | None]) -> list[dict]:
    """What every document of a shard has in common with a block, put together with what earlier blocks gave."""
    found = search(*flat.bytes_of(batch), items)
    rows = []
    for k, old in enumerate(earlier):
        a, b = found["interval_bounds"][k : k + 2]
        hit = list(zip(found["starts"][a:b].tolist(), found["ends"][a:b].tolist()))
        a, b = found["item_bounds"][k : k + 2]
        ids = [items.ids[i] for i in found["items"][a:b]]
        longest = int(found["longest"][k])
        best = (longest, items.ids[found["longest_item"][k]] if longest else None, int(found["longest_at"][k]) if longest else None)
        if old:
            hit, ids = merged(hit + [(x["start"], x["end"]) for x in old["hit"]]), sorted({*ids, *old["items"]})
            best = max(best, (old["longest"], old["longest_item"], old["longest_at"]), key=lambda x: x[0])
        rows.append({"n_words": int(found["n_words"][k]), "hit": [{"start": x, "end": y} for x, y in hit], "items": ids, "longest": best[0], "longest_item": best[1], "longest_at": best[2]})
    return rows


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Per document: words, hit words, items with occurring windows, their digest, the verdict, and the longest match."""
    o = F.col("overlap")
    n_hit = F.aggregate(o["hit"], F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    found = find_overlaps(docs.select(docs["doc_id"], docs["text"]), benchmark)
    out = found.select("doc_id", o["n_words"].alias("n_words"), n_hit.alias("n_hit"), F.size(o["items"]).cast("bigint").alias("n_items"), F.sha2(F.array_join(F.array_sort(o["items"]), ","), 256).alias("items_sha256"), o["longest"].alias("longest"), o["longest_item"].alias("longest_item"), o["longest_at"].alias("longest_at"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def decontaminate(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents of which at least a twentieth of the words lie in benchmark windows."""
    into = flat.free_name(docs, "overlap")
    o = F.col(into)
    n_hit = F.aggregate(o["hit"], F.lit(0).cast("bigint"), lambda a, x: a + x["end"] - x["start"])
    return find_overlaps(docs, benchmark, into=into).where(~((n_hit > 0) & (20 * n_hit >= o["n_words"]))).drop(into)


def items_digest(ids: list[str]) -> str:
    """The digest that ``contamination`` reports for a list of item ids."""
    return hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


ORACLE = """
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), sized AS (
  SELECT id, w, least(len(w), 13) AS n FROM items WHERE len(w) > 0
), windows AS (
  SELECT DISTINCT id, n, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM sized)
), sizes AS (
  SELECT DISTINCT n FROM windows
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)
), found AS (
  SELECT p.doc_id, p.i, p.n, v.id FROM places p JOIN windows v ON p.n = v.n AND p.win = v.win
), hits AS (
  SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS place FROM found) GROUP BY doc_id
), matched AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, id FROM found) GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(h.n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(m.n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(m.ids, '')) AS items_sha256, coalesce(h.n_hit, 0) > 0 AND 20 * coalesce(h.n_hit, 0) >= len(w.w) AS contaminated
FROM words w LEFT JOIN hits h USING (doc_id) LEFT JOIN matched m USING (doc_id)
"""
