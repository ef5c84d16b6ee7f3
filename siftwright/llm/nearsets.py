"""Operator 10: near-duplicate documents by a chosen-path set similarity join.

Documents become sets of word shingles; equal sets form one class, and only classes are compared. A class has a minhash
signature of ``PLACES`` tokens. Each of ``TREES`` independent trees sends a class down the ``BRANCHES`` paths of its lowest
tokens under the tree's own order; at a node that is too large to compare, classes branch again by a new order. Two
classes of similarity 0.8 share a path of one tree with a chance of over 0.9, of any of five trees with one of over 0.99999.

Nodes are worked on in two passes. The first compares every class of a node with two pivots of it and confirms candidates
on their full sets: linear work that takes a group of many near copies together. The second looks at the components so far
that share a node. Signature estimates tell which classes of a node may be linked to a class of another component, and
those classes are compared on their full sets, node by node. A node of few classes outside its largest component is
compared exhaustively, the largest component dealt over tasks; another large node branches again, unless branching left more
than half of it together or it is ``DEPTH`` levels deep: then it is dealt into blocks and all pairs of blocks are compared,
so nothing is dropped. Tasks tell spanning forests of the
links that they find, never all pairs. Components come from alternating large-star and small-star steps.

Everything is DataFrame joins and aggregations with partial sums; Python tasks see slices of texts, signatures or sets
of bounded size. No links, components or signatures reach the driver.

Defined results: null, empty and word-free texts have an empty set and are linked with nothing; a text with fewer words
than a shingle has one shingle; rows with equal sets are one class, so repeated rows share a component; a row without a
doc_id is linked with nothing and has no component id; rows that share a doc_id but not their text are classes of their
own, linked through their own texts. An empty table gives no rows. Other columns don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.llm import flat
from siftwright.session import materialise

TREES = 5
BRANCHES = 2
PLACES = 64
DEPTH = 6
#: A node is compared exhaustively when a task has at most this many pairs of it outside its largest component; above
#: NODE_ROWS classes that component is dealt over several tasks, each with all classes of the others.
NODE_PAIRS = 1 << 22
NODE_ROWS = 4096
#: Least share of equal signature bytes for a candidate: four standard deviations below the similarity sought.
ESTIMATE = 0.6
SIMILAR = 80
SEND_AT_MOST = 1_000_000
#: Classes and shingles of a block when classes are compared on their full sets, and columns of a slice of the membership
#: matrix. Every two classes of a larger node meet in a block of twice that size.
BLOCK = 512
BLOCK_SHINGLES = 1 << 22
SLICE_COLUMNS = 4096
#: Rows of small tables (pairs, links, labels) that one task handles, so that few rows don't make many files.
TASK_ROWS = 50_000
#: Texts that one task makes sets of, so that small partitions of the input are taken together.
TASK_TEXTS = 4096
_U = np.uint64
_SPACE = np.ones(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
_random = np.random.default_rng(101)
_FACTORS = _random.integers(1, 2**31, PLACES).astype(np.uint32) * np.uint32(2) + np.uint32(1)
_SHIFTS = _random.integers(0, 2**32, PLACES, dtype=np.uint32)


def shingle_sets(batch: pa.RecordBatch, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit shingle hashes, offsets): the sorted distinct shingles of every text."""
    data, offsets = flat.bytes_of(batch)
    *_, hashes, bounds = flat.words_of(data, offsets, _SPACE)
    words = np.diff(bounds)
    many = np.where(words >= width, words - width + 1, np.minimum(words, 1))
    starts = flat.ranges(bounds[:-1], many)
    owner = np.repeat(np.arange(len(words)), many)
    found = flat.segment_hashes(hashes, starts, starts + np.minimum(words, width)[owner])
    order = np.lexsort((found, owner))
    found = found[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
    return found[new], np.searchsorted(owner[new], np.arange(len(words) + 1))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in flat.slices(batches):
        for at in range(0, batch.num_rows, 1 << 15):
            yield batch.slice(at, 1 << 15)


def signatures(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Minhash signatures, one row of PLACES 32-bit tokens per non-empty set (zeros for empty ones)."""
    out = np.zeros((len(offsets) - 1, PLACES), np.uint32)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        low = (flat.mix(sets) >> _U(32)).astype(np.uint32)
        at = offsets[:-1][full]
        for k in range(PLACES):
            turned = low * _FACTORS[k]
            turned += _SHIFTS[k]
            turned ^= turned >> np.uint32(15)
            turned *= np.uint32(0x2C1B3C6D)
            out[full, k] = np.minimum.reduceat(turned, at)
    return out


def digests(sets: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Two longs per set, equal for equal sets."""
    out = []
    for seed in (3, 5):
        sums = np.zeros(len(sets) + 1, _U)
        np.cumsum(flat.mix(sets ^ flat.mix(np.array([seed], _U))), out=sums[1:])
        out.append(flat.mix(sums[offsets[1:]] - sums[offsets[:-1]]).view(np.int64))
    return out


_ROW_KEY = ("doc_id", "t1", "t2")


def _described(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, a 128-bit text hash (t1, t2), set size n, set digest (c1, c2), signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets, offsets = shingle_sets(batch, width)
            one, two = digests(sets, offsets)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in _ROW_KEY), pa.array(np.diff(offsets)), pa.array(one), pa.array(two), _binary(signatures(sets, offsets))], names=[*_ROW_KEY, "n", "c1", "c2", "sign"])

    keyed = docs.select("doc_id", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"), "text")
    return flat.map_batches(keyed, run, "doc_id bigint, t1 bigint, t2 bigint, n bigint, c1 bigint, c2 bigint, sign binary")


def _binary(rows: np.ndarray) -> pa.Array:
    raw = np.ascontiguousarray(rows).view(np.uint8).reshape(len(rows), -1)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * raw.shape[1]), pa.py_buffer(raw)])


def _signs(batch: pa.RecordBatch | pa.Table, name: str = "sign", kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), kind).reshape(-1, PLACES)


def paths(tokens: np.ndarray, origin: np.ndarray, trees: int) -> np.ndarray:
    """Nodes of every signature, ``trees * BRANCHES`` columns: in each tree those of the lowest tokens by its order."""
    placed = tokens.astype(_U) | (np.arange(PLACES, dtype=_U) << _U(40))
    out = []
    for tree in range(trees):
        order = flat.mix(placed ^ flat.mix(origin + _U((tree + 1) * 0xA24BAED4963EE407 & (1 << 64) - 1))[:, None])
        lowest = np.partition(order, BRANCHES - 1, axis=1)[:, :BRANCHES]
        out.append(flat.mix(lowest + origin[:, None] + _U(tree)).view(np.int64))
    return np.concatenate(out, axis=1)


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The signature of every class, its bytes for estimates, and its nodes in the first level of the trees."""
    for batch in batches:
        if batch.num_rows:
            tokens = _signs(batch)
            plain = ["cid", "doc_id", "c1", "c2", "n", "sign"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in plain), _binary(tokens.astype(np.uint8)), _binary(paths(tokens, np.zeros(len(tokens), _U), TREES))], names=[*plain, "bytes", "nodes"])


def _first_nodes(classes: DataFrame) -> DataFrame:
    """Rows (node, cid, n) of the first level."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = np.frombuffer(b"".join(batch.column("nodes").to_pylist()), np.int64)
                at = pa.array(np.repeat(np.arange(batch.num_rows), TREES * BRANCHES))
                yield pa.RecordBatch.from_arrays([pa.array(nodes), batch.column("cid").take(at), batch.column("n").take(at)], names=["node", "cid", "n"])

    return flat.map_batches(classes.select("cid", "n", "nodes"), run, "node bigint, cid bigint, n bigint")


def _deeper(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """Rows (node, cid, comp, above) one level below rows of large nodes, by a new order; above are the rows of their node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                nodes = paths(_signs(batch), np.asarray(batch.column("node")).view(_U), 1)
                for k in range(BRANCHES):
                    yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(nodes[:, k])), batch.column("cid"), batch.column("comp"), batch.column("rows")], names=["node", "cid", "comp", "above"])

    inside = rows.select("node", "cid", "comp", "rows").join(classes.select("cid", "sign"), "cid").select("node", "cid", "comp", "rows", "sign")
    return flat.map_batches(inside, run, "node bigint, cid bigint, comp bigint, above bigint")


def _sized(small: str, large: str):
    return 100 * F.least(small, large) >= SIMILAR * F.greatest(small, large)


def _active(classes: DataFrame, rows: int) -> DataFrame:
    """First-level rows of nodes with several classes, and the two pivots of the node (by a hash order)."""
    nodes, rank = _first_nodes(classes), F.xxhash64("cid")
    stats = nodes.groupBy("node").agg(F.count("*").alias("rows"), F.min_by("cid", rank).alias("p1"), F.min_by("n", rank).alias("n1"), F.max_by("cid", rank).alias("p2"), F.max_by("n", rank).alias("n2"))
    return _stored(nodes.join(stats.where("rows > 1").drop("rows"), "node"), rows)


def _star(active: DataFrame) -> DataFrame:
    """Pairs (a, b): each class of a node and the node's pivots, where their sizes allow the similarity sought."""
    ends = active.select("cid", "n", F.explode(F.array(F.struct(F.col("p1").alias("p"), F.col("n1").alias("pn")), F.struct(F.col("p2").alias("p"), F.col("n2").alias("pn")))).alias("e")).select("cid", "n", "e.*")
    return ends.where((F.col("cid") != F.col("p")) & _sized("n", "pn")).select(F.least("cid", "p").alias("a"), F.greatest("cid", "p").alias("b")).distinct()


def _spread(nodes: DataFrame) -> DataFrame:
    """Nodes with more than one component: node, rows, major (the largest component), and pairs: how many a task would compare
    of the classes outside it, each with all that the task holds."""
    per = nodes.groupBy("node", "comp").agg(F.count("*").alias("k"))
    spread = per.groupBy("node").agg(F.sum("k").alias("rows"), F.max("k").alias("largest"), F.max_by("comp", F.struct("k", "comp")).alias("major"), F.count("*").alias("comps")).where(F.col("comps") > 1)
    return spread.select("node", "rows", "major", (F.least("rows", F.lit(NODE_ROWS)) * (F.col("rows") - F.col("largest"))).alias("pairs"))


def _estimated(pairs: DataFrame, classes: DataFrame) -> DataFrame:
    """Pairs whose signatures allow the similarity sought."""
    slim = classes.select("cid", "bytes")
    both = pairs.join(slim.select(F.col("cid").alias("a"), F.col("bytes").alias("sa")), "a").join(slim.select(F.col("cid").alias("b"), F.col("bytes").alias("sb")), "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = (_signs(batch, "sa", np.uint8) == _signs(batch, "sb", np.uint8)).mean(axis=1) >= ESTIMATE
                yield batch.select(["a", "b"]).filter(pa.array(near))

    return flat.map_batches(both.select("a", "b", "sa", "sb"), run, "a bigint, b bigint")


def _tasks(rows: int) -> int:
    return max(1, -(-rows // TASK_ROWS))


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, width: int, rows: int) -> DataFrame:
    """Pairs whose full shingle sets have the similarity sought."""
    pairs = _stored(pairs, rows)
    many = pairs.count()
    pairs = pairs.coalesce(_tasks(many))
    sets = _sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), 2 * many, width)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("ma"), batch.column("mb")):
                one, two = np.frombuffer(x.as_buffer(), _U), np.frombuffer(y.as_buffer(), _U)
                common = len(np.intersect1d(one, two, assume_unique=True))
                keep.append(100 * common >= SIMILAR * (len(one) + len(two) - common) and common > 0)
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("members").alias("ma")), "a").join(sets.select(F.col("cid").alias("b"), F.col("members").alias("mb")), "b")
    return flat.map_batches(both.select("a", "b", "ma", "mb"), compare, "a bigint, b bigint")


def _sets(docs: DataFrame, classes: DataFrame, wanted: DataFrame, many: int, width: int) -> DataFrame:
    """cid and members (sorted shingle hashes) of the wanted classes, from one document of each."""
    keys = classes.join(wanted, "cid", "left_semi").select("doc_id", "c1", "c2", "cid")
    keys = F.broadcast(keys) if many <= SEND_AT_MOST else keys

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets, offsets = shingle_sets(batch, width)
            raw = memoryview(sets.view(np.uint8))
            one, two = digests(sets, offsets)
            members = pa.array([bytes(raw[8 * a : 8 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(one), pa.array(two), members], names=["doc_id", "c1", "c2", "members"])

    texts = docs.select("doc_id", "text").join(keys.select("doc_id"), "doc_id", "left_semi")
    found = flat.map_batches(texts, sets_of, "doc_id bigint, c1 bigint, c2 bigint, members binary").join(keys, ["doc_id", "c1", "c2"])
    return found.groupBy("cid").agg(F.first("members").alias("members"))  # repeated rows have equal sets


def _in_runs(key: str, function):
    """A mapInArrow function that hands over the rows of whole runs of equal keys; its input is sorted by the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = np.asarray(batch.column(key))
            rows = pa.Table.from_batches([batch])
            first = int(np.searchsorted(keys != keys[0], True))
            last = int(np.searchsorted(keys == keys[-1], True))
            if held and held[-1][key][-1].as_py() != keys[0]:
                yield from function(pa.concat_tables(held))
                held = []
            if keys[0] == keys[-1]:
                held.append(rows)
                continue
            if held:
                yield from function(pa.concat_tables([*held, rows.slice(0, first)]))
                rows = rows.slice(first)
                last -= first
            if last:
                yield from function(rows.slice(0, last))
            held = [rows.slice(last)]
        if held:
            yield from function(pa.concat_tables(held))

    return run


def _promising(nodes: DataFrame, classes: DataFrame, rows: int) -> DataFrame:
    """Of ``nodes`` (node, cid, comp) the rows with a class of another component in their node whose signature allows the
    similarity sought; nodes left with the same classes count once."""
    full = nodes.join(classes.select("cid", "n", "bytes"), "cid").select("node", "cid", "comp", "n", "bytes")
    dealt = full.repartition("node").sortWithinPartitions("node")
    found = _stored(flat.map_batches(dealt, _in_runs("node", _estimates), "node bigint, cid bigint, comp bigint, n bigint"), rows)
    print_ = F.sum(F.xxhash64("cid").cast("decimal(20,0)")).alias("print")
    once = found.groupBy("node").agg(F.count("*").alias("rows"), F.sum("n").alias("shingles"), print_).groupBy("rows", "shingles", "print").agg(F.min("node").alias("node"))
    return found.drop("n").join(once.select("node", "rows", "shingles"), "node")


class Forest:
    """Union-find over numbers; ``links`` are the unions that joined something."""

    def __init__(self) -> None:
        self.parent: dict[int, int] = {}
        self.links: list[tuple[int, int]] = []

    def find(self, x: int) -> int:
        up = self.parent
        while (p := up.get(x, x)) != x:
            up[x] = x = up.get(p, p)
        return x

    def join(self, x: int, y: int) -> None:
        a, b = self.find(x), self.find(y)
        if a != b:
            self.parent[max(a, b)] = min(a, b)
            self.links.append((min(x, y), max(x, y)))

    def batch(self) -> Iterator[pa.RecordBatch]:
        if self.links:
            found = np.array(self.links)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(found[:, 0])), pa.array(np.ascontiguousarray(found[:, 1]))], names=["a", "b"])


def _estimates(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    """The rows of each node with a near one of another component, by signature estimates."""
    node, comp, size = (np.asarray(rows[c]) for c in ("node", "comp", "n"))
    signs = _signs(rows, "bytes", np.uint8)
    heads = np.append(np.flatnonzero(np.append(True, node[1:] != node[:-1])), len(node))
    near = np.zeros(len(node), bool)
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
        own = comp[a:b]
        if b - a < 2 or (own == own[0]).all():
            continue
        kinds, many = np.unique(own, return_counts=True)
        for i in np.flatnonzero(own != kinds[many.argmax()]).tolist():
            at = np.flatnonzero((own != own[i]) & (100 * np.minimum(size[a:b], size[a + i]) >= SIMILAR * np.maximum(size[a:b], size[a + i])))
            at = at[(signs[a + at] == signs[a + i]).mean(axis=1) >= ESTIMATE]
            near[a + at] = True
            near[a + i] |= len(at) > 0
    keep = np.flatnonzero(near)
    if len(keep):
        yield pa.RecordBatch.from_arrays([pa.array(node[keep]), pa.array(np.asarray(rows["cid"])[keep]), pa.array(comp[keep]), pa.array(size[keep])], names=["node", "cid", "comp", "n"])


def _near(active: DataFrame, classes: DataFrame, labels: DataFrame, rows: int) -> DataFrame:
    """Rows (node, cid, comp, rows, shingles) of classes that may be linked to another component of their node.

    Each large node decides for itself: it branches again unless it kept more than half of the node above it (a dense group,
    which branches don't take apart) or is deep enough; then all pairs of its blocks meet.
    """
    nodes = active.select("node", "cid").join(labels, "cid").select("node", "cid", "comp", F.lit(None).cast("bigint").alias("above"))
    ready = []
    for level in range(DEPTH + 1):
        live = _stored(nodes.join(_spread(nodes), "node"), rows)
        ready.append(_dealt(live.where(F.col("pairs") <= NODE_PAIRS)))
        large = live.where(F.col("pairs") > NODE_PAIRS)
        dense = F.lit(True) if level == DEPTH else F.coalesce(2 * F.col("rows") > F.col("above"), F.lit(False))
        counts = large.agg(F.count_if(dense).alias("dense"), F.count_if(~dense).alias("branching")).first()
        if counts.dense:
            blocks = F.ceil(F.col("rows") / (NODE_ROWS // 2)).cast("bigint")
            ready.append(_block_pairs(large.where(dense), "node", blocks).select(F.col("block").alias("node"), "cid", "comp"))
        if not counts.branching:
            break
        nodes = _deeper(large.where(~dense), classes)
    return _promising(reduce(DataFrame.unionByName, ready), classes, rows)


def _dealt(live: DataFrame) -> DataFrame:
    """Rows (node, cid, comp) of light nodes. The largest component of a node with many classes is dealt over tasks, and
    the few others go to each of them."""
    parts = F.ceil(F.col("rows") / NODE_ROWS).cast("bigint")
    own = F.array(F.pmod(F.xxhash64("cid"), parts))
    part = F.explode(F.when(F.col("comp") == F.col("major"), own).otherwise(F.sequence(F.lit(0).cast("bigint"), parts - 1)))
    few, many = live.where(F.col("rows") <= NODE_ROWS), live.where(F.col("rows") > NODE_ROWS)
    split = many.select("node", "cid", "comp", part.alias("part")).select(F.xxhash64("node", "part").alias("node"), "cid", "comp")
    return few.select("node", "cid", "comp").unionByName(split)


def _block_pairs(rows: DataFrame, group: str, blocks: Column) -> DataFrame:
    """Rows dealt to all pairs of the blocks of their group, so that every two rows of a group meet in one."""
    dealt = rows.withColumn("blocks", blocks).withColumn("own", F.pmod(F.xxhash64("cid"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    return dealt.withColumn("block", F.xxhash64(group, F.least("own", "other"), F.greatest("own", "other"))).drop("blocks", "own", "other")


def _links_between(near: DataFrame, classes: DataFrame, docs: DataFrame, width: int, rows: int) -> DataFrame:
    """Confirmed links between the components of nodes: their classes are compared on full sets, in blocks; of the links
    found in a block a spanning forest is told."""
    near = _stored(near, rows)
    many = near.count()
    near = near.coalesce(_tasks(many))
    sets = _sets(docs, classes, near.select("cid").distinct(), many, width)
    blocks = F.greatest(F.ceil(F.col("rows") / BLOCK), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("bigint")
    dealt = _block_pairs(near, "node", blocks).select("block", "cid", "comp").join(sets, "cid")
    return flat.map_batches(dealt.repartition("block").sortWithinPartitions("block"), _in_runs("block", _linked), "a bigint, b bigint").distinct()


def _linked(rows: pa.Table) -> Iterator[pa.RecordBatch]:
    blocks = np.asarray(rows["block"])
    heads = np.append(np.flatnonzero(np.append(True, blocks[1:] != blocks[:-1])), len(blocks))
    cid, comp, members = np.asarray(rows["cid"]), np.asarray(rows["comp"]), rows["members"].to_pylist()
    forest = Forest()
    for a, b in zip(heads[:-1].tolist(), heads[1:].tolist()):
        if (comp[a:b] == comp[a]).all():
            continue
        common, sizes = shared_counts([np.frombuffer(m, _U) for m in members[a:b]])
        union = sizes[:, None] + sizes[None, :] - common
        one, two = np.nonzero(np.triu(100 * common >= SIMILAR * union, 1) & (comp[a:b][:, None] != comp[a:b][None, :]))
        local = Forest()
        for x, y in zip(one.tolist(), two.tolist()):
            local.join(int(comp[a + x]), int(comp[a + y]))
        for x, y in local.links:
            forest.join(x, y)
    yield from forest.batch()


def shared_counts(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(common members of every two sets, sizes), by products of slices of the membership matrix."""
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, column, many = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    keep = many[column] > 1
    owner, column = owner[keep], np.cumsum(many > 1)[column[keep]] - 1
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    common = np.diag(sizes).astype(np.float32)
    np.fill_diagonal(common, 0)
    for low in range(0, int((many > 1).sum()), SLICE_COLUMNS):
        a, b = np.searchsorted(column, (low, low + SLICE_COLUMNS))
        part = np.zeros((len(sets), SLICE_COLUMNS), np.float32)
        part[owner[a:b], column[a:b] - low] = 1
        common += part @ part.T
    return common.round().astype(np.int64), sizes


def components(links: DataFrame, rows: int | None = None) -> DataFrame:
    """Connected components of links (a, b): one row (u, v) per linked id other than its component's smallest, v. ``rows``
    tells about how many links there are."""
    links = materialise(links if rows is None else links.coalesce(_tasks(rows)))
    few = _tasks(links.count())
    edges = materialise(links.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct().coalesce(few))
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).coalesce(few)
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where(F.col("v") > F.col("u")).join(lowest, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).coalesce(few).distinct().coalesce(few)
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialise(small.unionByName(least.select("u", F.col("m").alias("v"))).coalesce(few).distinct().coalesce(few))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state or not now[0]:
            return edges
        state = now


def _resolved(docs: DataFrame, width: int) -> DataFrame:
    """Per row: doc_id, t1, t2, n, and comp (the component) and component_id (its smallest doc_id), null for rows that are
    linked with nothing. Components may share a component_id where documents share a doc_id."""
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    rows = texts.count()
    described = materialise(_described(texts.coalesce(max(1, -(-rows // TASK_TEXTS))), width).withColumn("rid", F.monotonically_increasing_id()))
    filled = described.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    # a class goes by a row number, as documents with different texts may share a doc_id
    keys = [F.min("rid").alias("cid"), F.min("doc_id").alias("doc_id")]
    groups = filled.groupBy("c1", "c2").agg(*keys, F.min("n").alias("n"), F.max("sign").alias("sign"))
    classes = _stored(flat.map_batches(groups, _summaries, "cid bigint, doc_id bigint, c1 bigint, c2 bigint, n bigint, sign binary, bytes binary, nodes binary"), 4 * rows)  # wide rows
    spots = rows * TREES * BRANCHES
    active = _active(classes, spots)
    joined = components(_confirmed(_estimated(_star(active), classes), classes, texts, width, spots), rows)
    labels = _stored(_labels(classes, joined), rows)
    between = _links_between(_near(active, classes, labels, spots), classes, texts, width, spots)
    joined = components(joined.select(F.col("u").alias("a"), F.col("v").alias("b")).unionByName(between), rows)
    members = joined.unionByName(joined.select(F.col("v").alias("u"), "v").distinct()).withColumnsRenamed({"u": "cid", "v": "comp"})
    linked = members.join(classes.select("cid", "doc_id"), "cid")
    lowest = linked.join(linked.groupBy("comp").agg(F.min("doc_id").alias("lowest")), "comp").select("cid", "comp", "lowest")
    lowest = _stored(lowest, rows)
    own = filled.groupBy("c1", "c2").agg(*keys).join(lowest, "cid", "left").select("c1", "c2", F.coalesce("comp", "cid").alias("comp"), F.coalesce("lowest", "doc_id").alias("component_id"))
    inside = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    whole = described.select(*_ROW_KEY, "n", "c1", "c2").join(own, ["c1", "c2"], "left")
    return whole.select(*_ROW_KEY, "n", *(F.when(inside, F.col(c)).alias(c) for c in ("comp", "component_id")))


def _stored(df: DataFrame, rows: int) -> DataFrame:
    """A table of at most about ``rows`` rows in the shared folder, in few files where that isn't many."""
    return materialise(df.coalesce(_tasks(rows)))


def near_duplicates(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable over links) and kept of every row."""
    out = _resolved(docs, width).select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _labels(classes: DataFrame, joined: DataFrame) -> DataFrame:
    """cid and comp: the component known so far."""
    return classes.select("cid").join(joined, classes["cid"] == joined["u"], "left").select("cid", F.coalesce("v", "cid").alias("comp"))


def keep_one(docs: DataFrame, width: int = 5) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: the one with the smallest id; of several rows with that
    id the one with the smallest text hash, and of equal ids and texts the one with the smallest hash of all its columns.
    Rows that share an id but are no near duplicates all stay, as do rows without an id or words."""
    own = [flat.free_name(docs, x) for x in ("_id", "_t1", "_t2")]
    key, renamed = F.struct(*_ROW_KEY), dict(zip(_ROW_KEY, own))
    many = docs.count()
    rows = _stored(_resolved(docs, width).where("component_id IS NOT NULL"), many)
    first = rows.groupBy("comp").agg(F.min(key).alias("first"), F.count("*").alias("rows")).where("rows > 1")
    dropped = rows.join(first.drop("rows"), "comp").where(key != F.col("first")).select(*_ROW_KEY).distinct()
    repeated = rows.groupBy(*_ROW_KEY).agg(F.count("*").alias("rows")).where("rows > 1").select(*_ROW_KEY)
    gone, again = (_stored(x.withColumnsRenamed(renamed), many) for x in (dropped, repeated))
    keyed = docs.withColumns(dict(zip(own, (F.col("doc_id").cast("bigint"), F.xxhash64("text"), F.xxhash64(F.lit(1), "text")))))
    left = keyed.join(_small(gone), own, "left_anti")
    if again.isEmpty():
        return left.select(*docs.columns)
    hashed = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    whole = F.min_by(F.struct(*docs.columns), F.xxhash64(*hashed)).alias("whole")
    once = left.join(_small(again), own, "left_semi").groupBy(*own).agg(whole).select("whole.*")
    return left.join(_small(again), own, "left_anti").select(*docs.columns).unionByName(once)


def _small(rows: DataFrame) -> DataFrame:
    """Keys, sent to every task while they are few."""
    return F.broadcast(rows) if rows.count() <= SEND_AT_MOST else rows
