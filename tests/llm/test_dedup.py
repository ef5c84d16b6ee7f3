import collections
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftwright.llm import decontaminate, flat, lines, nearsets, pipeline, substring


def shingles(text, width):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1)) if len(words) >= width else frozenset([tuple(words)] if words else [])


def components(texts, width):
    sets = {i: shingles(t, width) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.fixture(scope="module")
def corpus():
    random.seed(11)
    vocabulary = ["w%d" % i for i in range(400)]
    texts = {}
    for g in range(60):
        base = [random.choice(vocabulary) for _ in range(random.randint(3, 120))]
        for _ in range(random.choice([1, 1, 2, 5, 12])):
            copy = list(base)
            for _ in range(random.randint(0, 4)):
                copy[random.randrange(len(copy))] = random.choice(vocabulary)
            texts[len(texts)] = " ".join(copy).upper() if random.random() < 0.2 else " ".join(copy)
    texts |= {1000: None, 1001: "", 1002: " \n ", 1003: "one", 1004: "ONE", 1005: "one two", 1006: "ONE\ttwo"}
    return texts


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_equal_brute_force(spark, corpus, width):
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string").repartition(5)
    wanted = components(corpus, width)
    rows = nearsets.near_duplicates(df, width).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == wanted
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows)
    assert {r.doc_id for r in nearsets.keep_one(df, width).collect()} == {i for i, (_, c) in wanted.items() if i == c}


def test_deep_branches_and_blocks(spark, corpus, monkeypatch):
    monkeypatch.setattr(nearsets, "NODE_PAIRS", 3)
    monkeypatch.setattr(nearsets, "NODE_ROWS", 6)
    monkeypatch.setattr(nearsets, "DEPTH", 1)
    monkeypatch.setattr(nearsets, "BLOCK", 3)
    monkeypatch.setattr(nearsets, "_star", lambda active: active.select(F.col("cid").alias("a"), F.col("cid").alias("b")).where("false"))
    texts = dict(list(corpus.items())[:120])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in nearsets.near_duplicates(df, 2).collect()}
    assert found == {i: c for i, (_, c) in components(texts, 2).items()}


def test_each_node_decides_whether_it_branches_again(spark, monkeypatch):
    """One node of equal signatures can't be taken apart, another can: only rows of the first meet in blocks."""
    monkeypatch.setattr(nearsets, "NODE_PAIRS", 8)
    monkeypatch.setattr(nearsets, "NODE_ROWS", 8)
    rng = np.random.default_rng(2)
    same, own = rng.integers(0, 2**32, nearsets.PLACES, dtype=np.uint32), rng.integers(0, 2**32, (40, nearsets.PLACES), dtype=np.uint32)
    signs = [*(same for _ in range(30)), *own]
    classes = spark.createDataFrame([(k, 50, s.tobytes(), s.astype(np.uint8).tobytes()) for k, s in enumerate(signs)], "cid long, n long, sign binary, bytes binary")
    active = spark.createDataFrame([(1 if k < 30 else 2, k) for k in range(70)], "node long, cid long")
    labels = classes.select("cid", F.col("cid").alias("comp"))
    paired, before = [], nearsets._block_pairs
    monkeypatch.setattr(nearsets, "_block_pairs", lambda rows, *rest: paired.append({r.cid for r in rows.select("cid").distinct().collect()}) or before(rows, *rest))
    near = nearsets._near(active, classes, labels, 70).collect()
    assert paired and set.union(*paired) == set(range(30))
    assert {r.cid for r in near} == set(range(30)) and max(r.rows for r in near) <= 2 * nearsets.NODE_ROWS


def test_one_class_outside_a_huge_component_is_linear(spark):
    nodes = spark.createDataFrame([(1, k, 0 if k else -1) for k in range(20_000)], "node long, cid long, comp long")
    assert nearsets._spread(nodes).first().pairs == nearsets.NODE_ROWS


def test_large_components_are_dealt(spark, corpus, monkeypatch):
    monkeypatch.setattr(nearsets, "NODE_ROWS", 4)
    monkeypatch.setattr(nearsets, "BLOCK", 2)
    df = spark.createDataFrame(list(corpus.items()), "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in nearsets.near_duplicates(df, 2).collect()}
    assert found == {i: c for i, (_, c) in components(corpus, 2).items()}
    live = spark.createDataFrame([(1, k, 7 if k < 20 else k, 23, 7) for k in range(23)], "node long, cid long, comp long, rows long, major long")
    dealt = nearsets._dealt(live).collect()
    assert sorted(r.cid for r in dealt if r.comp == 7) == list(range(20))
    assert all(sum(r.cid == k for r in dealt) == 6 for k in (20, 21, 22)) and len({r.node for r in dealt}) == 6


def true_links(docs, width):
    """All pairs of different sets with the similarity sought, from an inverted index over all documents."""
    sets, by = {}, collections.defaultdict(list)
    for r in docs.select("doc_id", "text").collect():
        found = shingles(r.text, width)
        if found and found not in sets:
            sets[found] = r.doc_id
    members = list(sets)
    for k, m in enumerate(members):
        for x in m:
            by[x].append(k)
    links = []
    for k, m in enumerate(members):
        common = collections.Counter(j for x in m for j in by[x] if j < k)
        links += [(sets[m], sets[members[j]]) for j, n in common.items() if 100 * n >= 80 * (len(m) + len(members[j]) - n)]
    return links


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates_recall_on_documents(spark, width):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = {r.doc_id: r.component_id for r in nearsets.near_duplicates(docs, width).collect()}
    links = true_links(docs, width)
    recall = sum(found[a] == found[b] for a, b in links) / len(links)
    print(f"width {width}: {len(links)} true links, recall {recall:.4f}")
    assert len(links) >= 5 and recall >= 0.99


def test_keep_one_keeps_unrelated_texts_of_one_id(spark):
    base = [passage(60, k) for k in range(4)]
    rows = [(1, base[0], "a"), (1, base[1], "b"), (2, base[0] + " more", "c"), (3, base[2], "d"), (3, base[2], "e"), (3, base[2], "e"), (4, base[3], "f"), (4, base[3] + " end", "g"), (None, base[0], "h"), (5, None, "i"), (5, "", "j")]
    for parts in (1, 4):
        df = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(parts)
        kept = [(r.doc_id, r.text) for r in nearsets.keep_one(df, 5).collect()]
        assert sorted((i, t) for i, t in kept if i in (1, 2, 3)) == sorted([(1, base[0]), (1, base[1]), (3, base[2])])
        assert sum(i == 4 for i, _ in kept) == 1 and (None, base[0]) in kept and sum(i == 5 for i, _ in kept) == 2
        assert [r.note for r in nearsets.keep_one(df, 5).where("doc_id = 3").collect()] == [r.note for r in nearsets.keep_one(df.repartition(2), 5).where("doc_id = 3").collect()]


def test_runs_of_equal_keys():
    rng = random.Random(3)
    for _ in range(30):
        keys = sorted(rng.randrange(6) for _ in range(rng.randrange(1, 40)))
        batches, at = [], 0
        while at < len(keys):
            step = rng.randrange(0, 9)
            batches.append(pa.RecordBatch.from_arrays([pa.array(keys[at : at + step], pa.int64())], names=["k"]))
            at += step
        seen = [t["k"].to_pylist() for t in nearsets._in_runs("k", lambda t: [t])(iter(batches))]
        assert [x for run in seen for x in run] == keys
        assert all(not set(a) & set(b) for i, a in enumerate(seen) for b in seen[:i])


def test_shared_counts():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 60, rng.integers(1, 40))).astype(np.uint64) for _ in range(25)]
    common, sizes = nearsets.shared_counts(sets)
    assert sizes.tolist() == [len(s) for s in sets]
    assert all(common[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(25) for j in range(25))


def test_near_duplicates_odd_rows(odd, empty):
    rows = nearsets.near_duplicates(odd, 2).collect()
    assert len(rows) == odd.count()
    by = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by[10].component_id == 1 and by[3].component_id == 3 and by[3].n_shingles == 0 and by[4].kept
    assert all(r.kept and r.component_id is None for r in rows if r.doc_id is None)
    kept = nearsets.keep_one(odd, 2)
    assert kept.columns[0] == "doc_id" and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 5, 7, 8, 9]
    assert nearsets.near_duplicates(empty, 2).count() == 0 and nearsets.keep_one(empty).count() == 0


def test_components_of_chains(spark):
    links = [(k, k + 1) for k in range(40)] + [(100, 50), (50, 70), (3, 3)]
    found = {r.u: r.v for r in nearsets.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {**{k: 0 for k in range(1, 41)}, 70: 50, 100: 50}


def brute_contamination(text, items):
    inside = lambda c: c.isascii() and c.isalnum() or ord(c) >= 0x80
    split = lambda t: "".join((c.lower() if c.isascii() else c) if inside(c) else " " for c in t or "").split(" ")
    words = [w for w in split(text) if w]
    hit, ids = set(), set()
    for ident, item in items:
        need = [w for w in split(item) if w]
        n = min(13, len(need))
        windows = {tuple(need[i : i + n]) for i in range(len(need) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i : i + n]) in windows:
                hit.update(range(i, i + n))
                ids.add(ident)
    return len(words), len(hit), decontaminate.items_digest(list(ids))


def test_contamination_equals_brute_force(spark, monkeypatch):
    random.seed(5)
    vocabulary = ["w%d" % i for i in range(12)]
    make = lambda n: " ".join(random.choice(vocabulary) for _ in range(n))
    items = [("a", make(20)), ("b", make(13)), ("c", "w1, W2"), ("d", ""), ("e", make(40)), ("f", "w3 w4 w5 w6 w7"), ("a", "w1 w1 w1"), ("long", make(30))]
    texts = [None, "", "w1 w2", items[0][1], "x " + items[4][1].upper() + " y " + items[1][1], items[7][1] * 2] + [make(random.randint(0, 80)) for _ in range(60)] + [make(10) + " " + items[4][1][10:90] + " " + make(5) for _ in range(20)]
    docs = spark.createDataFrame([(k, t, 1) for k, t in enumerate(texts)], "doc_id long, text string, overlap int")
    bench = spark.createDataFrame(items + [("z", None)], "item_id string, text string")
    for block in (decontaminate.BLOCK_CHARS, 60):
        monkeypatch.setattr(decontaminate, "BLOCK_CHARS", block)
        rows = decontaminate.contamination(docs, bench).collect()
        assert {r.doc_id: (r.n_words, r.n_hit, r.items_sha256) for r in rows} == {k: brute_contamination(t, items) for k, t in enumerate(texts)}
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {r.doc_id for r in rows if not r.contaminated}


def test_items_that_share_a_short_window(spark):
    items = [(f"i{k}", "the") for k in range(300)] + [("long", "the " * 40)]
    texts = ["the " * 3000, "nothing", "the end"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in decontaminate.contamination(docs, spark.createDataFrame(items, "item_id string, text string")).collect()}
    assert [(rows[k].n_hit, rows[k].n_items) for k in range(3)] == [(3000, 301), (0, 0), (1, 300)]


def test_longest_matches():
    items = decontaminate.items_of([("a", "one two three four five"), ("b", "four five six")])
    batch = pa.RecordBatch.from_arrays([pa.array(["zero two three four nine", "five six", "nothing here"])], names=["text"])
    found = decontaminate.search(*flat.bytes_of(batch), items)
    assert found["longest"].tolist() == [3, 2, 0] and found["longest_at"].tolist()[:2] == [1, 0]
    assert [items.ids[k] for k in found["longest_item"][:2]] == ["a", "b"]


def test_contamination_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "the lazy dog and then"), (None, "lone"), (2, None)], "item_id long, text string")
    rows = decontaminate.contamination(odd, bench).collect()
    assert len(rows) == odd.count() and {r.contaminated for r in rows if r.doc_id in (1, 6, 10)} == {True}
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.decontaminate(odd, bench.where("false")).count() == odd.count()


def test_line_dedup(spark, odd, empty):
    rows = [(k, f"shared line\nown {k}\n\nnear", f"s{k % 6}") for k in range(12)] + [(20, "shared line", None), (21, None, "s1"), (22, "", "s1")]
    rows += [(30 + k, f"four sites\nown {k}", f"t{k}") for k in range(4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = {r.doc_id: (r.text, r.n_lines_removed) for r in lines.remove_boilerplate(df).collect()}
    sites = collections.defaultdict(set)
    for _, t, s in rows:
        for x in (t or "").split("\n"):
            sites[x].add(s)
    for i, t, _ in rows:
        kept = None if t is None else [x for x in t.split("\n") if not x.strip() or len(sites[x]) < lines.LEAST_SITES]
        assert found[i] == (t if t is None else "\n".join(kept), 0 if t is None else len(t.split("\n")) - len(kept))
    again = lines.remove_boilerplate(odd)
    assert again.count() == odd.count() and lines.remove_boilerplate(empty).count() == 0


def test_line_dedup_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(lines, "SEND_AT_MOST", -1)
    df = spark.createDataFrame([(k, f"shared\nown {k}", f"s{k}") for k in range(8)], "doc_id long, text string, source string")
    assert {r.text for r in lines.remove_boilerplate(df).collect()} == {f"own {k}" for k in range(8)}


def passage(n, seed):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(n))


def test_substring_dedup_finds_passages(spark):
    shared = passage(60, 1)
    rows = [(k, f"{passage(80 + k, 100 + k)} {shared} {passage(50, 200 + k)}") for k in range(6)] + [(10 + k, passage(150, 300 + k)) for k in range(10)] + [(30, None), (31, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in substring.describe(df).collect()}
    assert all(found[k].repeated for k in range(6)) and not any(found[k].repeated or found[k].spans for k in (*range(10, 20), 30, 31))
    assert sum(found[k].spans == "" for k in range(6)) == 1
    cut = {r.doc_id: r.text for r in substring.remove_repeats(df).collect()}
    for k, t in rows:
        assert cut[k] == t if not found[k].spans else len(cut[k].encode()) == found[k].n_bytes - found[k].n_removed_bytes


def plain_cuts(raw):
    """Chunk starts in plain Python: hashes lower than all within REACH bytes, at the start of a character."""
    gear = substring._gear().tolist()
    whole = (1 << 32) - 1
    rolled = [sum(gear[raw[i - k]] << k for k in range(min(substring.GEAR, i + 1))) & whole for i in range(len(raw))]
    rolled = [h if raw[i] & 0xC0 != 0x80 else whole for i, h in enumerate(rolled)]
    r = substring.REACH
    return [i for i, h in enumerate(rolled) if i == 0 or h < whole and all(h < x for x in rolled[max(0, i - r) : i]) and all(h <= x for x in rolled[i + 1 : i + r + 1])]


def test_substring_spans_match_plain_python(spark):
    rng = random.Random(6)
    shared = [passage(n, n) for n in (9, 30, 60)]
    texts = [" é ".join(rng.choice([passage(rng.randint(1, 40), 50 + rng.randint(0, 30)), rng.choice(shared)]) for _ in range(rng.randint(0, 6))) for _ in range(40)]
    rows = list(enumerate(texts)) + [(3, texts[3])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keys = {r.doc_id: (r.row, r.row2) for r in df.select("doc_id", *substring._row_key()).collect()}
    chunks = {}
    for k, t in enumerate(texts):
        raw = t.encode()
        starts = plain_cuts(raw)
        chunks[k] = [(a, b, raw[a:b]) for a, b in zip(starts, [*starts[1:], len(raw)])]
        assert all(b - a <= substring.MOST for a, b, _ in chunks[k])
    where = collections.defaultdict(list)
    for k, own in chunks.items():
        for a, _, piece in own:
            where[piece].append((keys[k], a))
    where[None] = []
    for a, _, piece in chunks[3]:
        where[piece].append((keys[3], a))  # the repeated row

    def runs(pieces):
        out = []
        for a, b in pieces:
            if out and out[-1][1] == a:
                out[-1][1] = b
            else:
                out.append([a, b])
        return [(a, b) for a, b in out if b - a >= substring.LEAST_RUN]

    found = {r.doc_id: r for r in substring.describe(df).collect()}
    assert any(r.spans for r in found.values())
    for k, own in chunks.items():
        drop = runs([(a, b) for a, b, piece in own if len(where[piece]) > 1 and min(where[piece]) != (keys[k], a)])
        common = runs([(a, b) for a, b, piece in own if len({key for key, _ in where[piece]}) > 1])
        assert found[k].spans == ",".join(f"{a}:{b}" for a, b in drop) and found[k].n_shared_bytes == sum(b - a for a, b in common)


def test_substring_joins_without_broadcast(spark, monkeypatch):
    shared = passage(60, 1)
    df = spark.createDataFrame([(k, f"{passage(30, 100 + k)} {shared}") for k in range(8)], "doc_id long, text string")
    wanted = sorted(map(tuple, substring.describe(df).collect()))
    monkeypatch.setattr(substring, "SEND_AT_MOST", -1)
    monkeypatch.setattr(substring, "FREQUENT", 2)
    assert sorted(map(tuple, substring.describe(df).collect())) == wanted
    monkeypatch.setattr(nearsets, "SEND_AT_MOST", -1)
    assert sorted(r.doc_id for r in nearsets.keep_one(df.unionByName(df), 2).collect()) == list(range(8))


def test_chunks_resist_shifts():
    text = passage(2000, 9)
    cuts = []
    for t in (text, "inserted words " + text):
        data, offsets = flat.bytes_of(pa.RecordBatch.from_arrays([pa.array([t])], names=["text"]))
        starts, ends = substring.cuts(data, offsets)
        cuts.append({data[a:b].tobytes() for a, b in zip(starts, ends)})
    assert len(cuts[0] - cuts[1]) <= 2


def test_substring_odd_rows(odd, empty):
    rows = substring.describe(odd).collect()
    assert len(rows) == odd.count() and all(r.n_removed_bytes > 50_000 for r in rows if r.doc_id == 6)
    cut = substring.remove_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == odd.count()
    assert substring.describe(empty).count() == 0 and substring.remove_repeats(empty).count() == 0


def test_pipeline_stages_on_odd_rows(spark, odd, empty, tmp_path):
    bench = spark.createDataFrame([(1, "some words of a benchmark that nobody else has written down so far in any text here")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (odd, empty):
        docs = table
        for name, stage in pipeline.STAGES:
            before = docs.count()
            docs = stage(spark, docs, str(tmp_path)).cache()
            assert docs.count() <= before
            assert docs.columns == table.columns or name == "sentencepiece"
    assert [n for n, _ in pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "decontamination", "sentencepiece"]


def test_pipeline_run(spark, tmp_path):
    rng = random.Random(4)
    vocabulary = [passage(1, k) for k in range(300)]
    text = lambda: " ".join(rng.choice(vocabulary) for _ in range(60))
    own = [text() for _ in range(60)]
    item = " ".join(passage(1, 1000 + k) for k in range(20))
    line = "the same line on every site"
    rows = [(k, f"{t}\n{line}", "xx", f"s{k % 7}") for k, t in enumerate(own)]
    rows += [(100, own[0] + " more", "xx", "s1"), (101, f"{text()} {item}", "xx", "s2"), (102, None, "xx", "s3"), (103, "123 456", "xx", "s4"), (104, own[1], "xx", "s5")]
    spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("q", item)], "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    found = {r.doc_id: r for r in pipeline.run(spark, str(tmp_path)).collect()}
    assert sorted(found) == list(range(60))
    import public_tokenizers
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(pipeline.TOKENIZER))
    for k, r in found.items():
        assert r.ids == library.encode(own[k], add_bos=True, add_eos=True) and r.n_tokens == len(r.ids)
