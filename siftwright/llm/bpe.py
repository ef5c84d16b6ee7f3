"""Operator 9: SentencePiece BPE encoding and decoding by vectorised merge rounds.

The symbols of many words lie in one flat numpy array. In every round each word merges its leftmost pair of lowest rank,
all words at once; then the array is compacted and words without a mergeable pair leave it. Words are cut wherever no
piece of the vocabulary holds the two neighbouring characters, so no merge can cross a cut, and equal words of a slice
are encoded once. A word of over ``LONG`` symbols (no cuts in hundreds of characters) has rounds of its own, which merge
all its pairs of the lowest rank that do not overlap, from the left as far as no merge makes a pair of that rank or a
lower one: the same merges in the same order, in few rounds.

Defined results: null and empty texts give only the begin and end ids and decode to the empty text; every row is encoded
by itself, so repeated rows, ties and other columns have no effect; an empty table gives no rows. Texts of any length are
encoded whole. Characters outside the vocabulary become byte pieces.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftwright.llm import flat

SPACE = "▁"
LONG = 256
NONE = np.int32(2**31 - 1)
_U = np.uint64
_EMPTY = _U(2**64 - 1)


class Pieces:
    """A SentencePiece BPE vocabulary with byte fallback, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = len(model)
        names = [model.id_to_piece(i) for i in range(size)]
        plain = [i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.size, self.begin, self.end = size, model.bos_id(), model.eos_id()
        by_name = {names[i]: i for i in plain}
        bytes_at = {int(names[i][3:5], 16): i for i in range(size) if model.is_byte(i)}
        if len(bytes_at) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.byte_ids = np.array([bytes_at[b] for b in range(256)], np.int32)
        scores = np.array([model.get_score(i) for i in range(size)])
        self.rank = (np.unique(-scores, return_inverse=True)[1]).astype(np.int32)
        symbol = lambda s: by_name.get(s, size + ord(s) if len(s) == 1 else None)
        pairs, neighbours, letters = {}, set(), set()
        for name, i in by_name.items():
            letters.update(name)
            neighbours.update(zip(name, name[1:]))
            for k in range(1, len(name)):
                left, right = symbol(name[:k]), symbol(name[k:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = i
        self._pairs(pairs)
        ordered = sorted(letters)
        self.kind = np.zeros(0x110000, np.uint16)
        self.kind[[ord(x) for x in ordered]] = np.arange(1, len(ordered) + 1)
        at = {x: k + 1 for k, x in enumerate(ordered)}
        self.joins = np.zeros((len(ordered) + 1, len(ordered) + 1), bool)
        for a, b in neighbours:
            self.joins[at[a], at[b]] = True
        self.symbol = np.array([0] + [symbol(x) for x in ordered], np.int32)
        control = {i for i in range(size) if model.is_control(i)}
        self.starts_with_space = np.zeros(size, bool)
        self.starts_with_space[[i for i in plain if names[i].startswith(SPACE)]] = True
        self.is_control = np.zeros(size, bool)
        self.is_control[sorted(control)] = True
        as_bytes = [b"" if i in control else bytes([int(x[3:5], 16)]) if model.is_byte(i) else x.replace(SPACE, " ").encode() for i, x in enumerate(names)]
        self.piece_at = np.concatenate([[0], np.cumsum([len(x) for x in as_bytes])])
        self.piece_bytes = np.frombuffer(b"".join(as_bytes), np.uint8)

    def _pairs(self, pairs: dict[int, int]) -> None:
        bits = max(12, (len(pairs) * 6).bit_length())
        self._shift, self._mask = _U(64 - bits), (1 << bits) - 1
        self._keys, self._ids = np.full(1 << bits, _EMPTY, _U), np.full(1 << bits, -1, np.int32)
        left = np.fromiter(pairs, _U, len(pairs))
        ids = np.fromiter(pairs.values(), np.int32, len(pairs))
        slot = self._slot(left)
        while len(left):
            free = self._keys[slot] == _EMPTY
            _, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self._keys[slot[take]], self._ids[slot[take]] = left[take], ids[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, ids, slot = left[rest], ids[rest], (slot[rest] + 1) & self._mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * _U(0x9E3779B97F4A7C15)) >> self._shift).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the pieces that the pairs form; -1 where they form none."""
        keys = left.astype(_U) << _U(32) | right.astype(_U)
        slot = self._slot(keys)
        found = self._keys[slot]
        out = np.where(found == keys, self._ids[slot], np.int32(-1))
        todo = np.flatnonzero((found != keys) & (found != _EMPTY))
        at = slot[todo]
        while len(todo):
            at = (at + 1) & self._mask
            found = self._keys[at]
            hit = found == keys[todo]
            out[todo[hit]] = self._ids[at[hit]]
            go = ~hit & (found != _EMPTY)
            todo, at = todo[go], at[go]
        return out


@lru_cache(maxsize=2)
def pieces(model: str) -> Pieces:
    """The vocabulary of a model file, or of a public tokenizer by its name, looked up where the task runs."""
    if "/" in model:
        return Pieces(model)
    import public_tokenizers

    return Pieces(public_tokenizers.path(model))


def _rounds(p: Pieces, symbols: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Merged symbols of many short words and their counts, in order of the words."""
    word = np.repeat(np.arange(len(lengths)), lengths)
    sym = symbols[flat.ranges(starts, lengths)]
    made = np.full(len(sym), -1, np.int32)
    inner = np.flatnonzero(word[:-1] == word[1:])
    made[inner] = p.merged(sym[inner], sym[inner + 1])
    rank = np.where(made >= 0, p.rank[made], NONE)
    done_words, done_symbols = [], []
    while len(sym):
        heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        sizes = np.diff(np.append(heads, len(sym)))
        least = np.minimum.reduceat(rank, heads)
        least_each = np.repeat(least, sizes)
        over = least_each == NONE
        if over.any():
            done_words.append(word[over])
            done_symbols.append(sym[over])
            keep = ~over
            sym, word, made, rank, least_each = sym[keep], word[keep], made[keep], rank[keep], least_each[keep]
            if not len(sym):
                break
        hits = np.flatnonzero(rank == least_each)
        own = word[hits]
        at = hits[np.concatenate([[True], own[1:] != own[:-1]])]
        sym[at] = made[at]
        keep = np.ones(len(sym), bool)
        keep[at + 1] = False
        place = at - np.arange(len(at))
        sym, word, made, rank = sym[keep], word[keep], made[keep], rank[keep]
        for side in (place, place - 1):
            left = side[side >= 0]
            right = np.minimum(left + 1, len(sym) - 1)
            same = (left + 1 < len(sym)) & (word[left] == word[right])
            new = np.where(same, p.merged(sym[left], sym[right]), np.int32(-1))
            made[left] = new
            rank[left] = np.where(new >= 0, p.rank[new], NONE)
    owner, out = np.concatenate(done_words or [np.zeros(0, np.int64)]), np.concatenate(done_symbols or [np.zeros(0, np.int32)])
    order = np.argsort(owner, kind="stable")
    return out[order], np.bincount(owner, minlength=len(lengths))


def _long_rounds(p: Pieces, sym: np.ndarray) -> np.ndarray:
    """Merged symbols of one long word."""
    n = len(sym)
    sym = sym.copy()
    after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
    made = np.append(p.merged(sym[:-1], sym[1:]), np.int32(-1))
    rank = np.where(made >= 0, p.rank[made], NONE)
    alive = np.ones(n, bool)
    gone = 0
    while True:
        least = rank.min(initial=NONE)
        if least == NONE:
            return sym[alive]
        hits = np.flatnonzero(rank == least)
        # pairs that follow one another share a symbol: every other one of such a run can merge
        new = np.ones(len(hits), bool)
        new[1:] = after[hits[:-1]] != hits[1:]
        hits = hits[(np.arange(len(hits)) - np.maximum.accumulate(np.where(new, np.arange(len(hits)), 0))) % 2 == 0]
        second, third = after[hits], np.minimum(after[np.minimum(after[hits], n - 1)], n)
        left = before[hits]
        left_symbol = sym[left]
        joined = np.zeros(len(hits), bool)  # the pair before was merged in this round and ends here
        joined[1:] = after[second[:-1]] == hits[1:]
        left_symbol[1:][joined[1:]] = made[hits[:-1]][joined[1:]]
        over = lambda found, ok: np.where(ok & (found >= 0), p.rank[found], NONE)
        low = np.minimum(over(p.merged(left_symbol, made[hits]), left >= 0), over(p.merged(made[hits], sym[np.minimum(third, n - 1)]), third < n))
        stop = np.flatnonzero(low <= least)
        if len(stop):
            hits, second, third = hits[: stop[0] + 1], second[: stop[0] + 1], third[: stop[0] + 1]
        sym[hits] = made[hits]
        alive[second], rank[second] = False, NONE
        after[hits] = third
        before[third[third < n]] = hits[third < n]
        left = before[hits]
        for side in (hits, left[left >= 0]):
            right = after[side]
            found = np.where(right < n, p.merged(sym[side], sym[np.minimum(right, n - 1)]), np.int32(-1))
            made[side] = found
            rank[side] = np.where(found >= 0, p.rank[found], NONE)
        gone += len(second)
        if 2 * gone > n:  # compact
            keep = np.flatnonzero(alive)
            sym, made, rank = sym[keep], made[keep], rank[keep]
            n, gone = len(keep), 0
            after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)


def encode(p: Pieces, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(ids, offsets): ids of every text with begin and end ids, as one array."""
    points, offsets = flat.code_points([(SPACE + x).replace(" ", SPACE) if x else "" for x in texts])
    n = len(points)
    ids_each, counts, text_of = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if n:
        kind = p.kind[points]
        cut = np.ones(n, bool)
        cut[1:] = ~p.joins[kind[:-1], kind[1:]]
        cut[offsets[:-1][offsets[:-1] < n]] = True
        starts = np.flatnonzero(cut)
        ends = np.append(starts[1:], n)
        symbols = np.where(kind > 0, p.symbol[kind], (p.size + points).astype(np.int32))
        hashes = flat.segment_hashes(points.astype(_U) + _U(1), starts, ends)
        _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
        at, lengths = starts[first], (ends - starts)[first]
        short = lengths <= LONG
        out, size = _rounds(p, symbols, at[short], lengths[short])
        begin = np.zeros(len(at), np.int64)
        sizes = np.zeros(len(at), np.int64)
        sizes[short] = size
        begin[short] = np.cumsum(size) - size
        tail, used = [out], len(out)
        for k in np.flatnonzero(~short):
            found = _long_rounds(p, symbols[at[k] : at[k] + lengths[k]])
            begin[k], sizes[k] = used, len(found)
            used += len(found)
            tail.append(found)
        out = np.concatenate(tail)
        out, begin, sizes = _fallback(p, out, begin, sizes)
        ids_each, counts = out[flat.ranges(begin[which], sizes[which])], sizes[which]
        text_of = np.searchsorted(offsets, starts, "right") - 1
    per_text = np.bincount(text_of, weights=counts, minlength=len(texts)).astype(np.int64)
    bounds = np.concatenate([[0], np.cumsum(per_text + 2)])
    ids = np.empty(bounds[-1], np.int32)
    ids[bounds[:-1]], ids[bounds[1:] - 1] = p.begin, p.end
    body = np.ones(len(ids), bool)
    body[bounds[:-1]] = body[bounds[1:] - 1] = False
    ids[body] = ids_each
    return ids, bounds


def _fallback(p: Pieces, out: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols outside the vocabulary become the byte pieces of their UTF-8 form."""
    odd = np.flatnonzero(out >= p.size)
    if not len(odd):
        return out, begin, sizes
    as_bytes = [chr(x - p.size).encode("utf-8", "surrogatepass") for x in out[odd].tolist()]
    width = np.ones(len(out), np.int64)
    width[odd] = [len(x) for x in as_bytes]
    at = np.concatenate([[0], np.cumsum(width)])
    wide = np.empty(at[-1], np.int32)
    plain = out < p.size
    wide[at[:-1][plain]] = out[plain]
    wide[flat.ranges(at[odd], width[odd])] = p.byte_ids[np.frombuffer(b"".join(as_bytes), np.uint8)]
    return wide, at[begin], at[begin + sizes] - at[begin]


def decode(p: Pieces, ids: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes, offsets) of the texts that the ids stand for; the space put before a text is taken off again."""
    lengths = p.piece_at[ids + 1] - p.piece_at[ids]
    data = p.piece_bytes[flat.ranges(p.piece_at[ids], lengths)]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    offsets = ends[bounds]
    # the first piece that is not a control piece
    firsts = bounds[:-1] + (bounds[1:] > bounds[:-1]) * p.is_control[ids[np.minimum(bounds[:-1], max(len(ids) - 1, 0))]]
    led = firsts < bounds[1:]
    led[led] = p.starts_with_space[ids[firsts[led]]]
    keep = np.ones(len(data), bool)
    keep[ends[firsts[led]]] = False
    return data[keep], offsets - np.concatenate([[0], np.cumsum(led)])


def encode_documents(docs: DataFrame, model: str, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Token ids and decoded text of every row: ``keep`` columns, ids array<int>, decoded string."""
    schema = flat.schema_of(docs, keep, "ids array<int>, decoded string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in flat.slices(batches, "_text"):
            ids, bounds = encode(p, flat.texts_of(batch, "_text"))
            data, offsets = decode(p, ids, bounds)
            decoded = pa.LargeStringArray.from_buffers(batch.num_rows, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids)), decoded], names=[*keep, "ids", "decoded"])

    return flat.map_batches(docs.select(*keep, docs[text].alias("_text")), run, schema)


def digest_documents(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pieces(model)
        for batch in flat.slices(batches):
            ids, bounds = encode(p, flat.texts_of(batch))
            data, offsets = decode(p, ids, bounds)
            raw, text = memoryview(ids.astype("<u4").view(np.uint8)), memoryview(data)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(np.diff(bounds)),
                    pa.array([hashlib.sha256(raw[4 * a : 4 * b]).hexdigest() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]),
                    pa.array([hashlib.sha256(text[a:b]).hexdigest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]),
                ],
                names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return flat.map_batches(docs.select("doc_id", "text"), run, "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string")
