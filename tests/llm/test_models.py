import collections
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest

from pyspark.sql import functions as F

from siftwright.llm import labelled, language, quality, toxicity

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def accuracy(found, truth):
    rows = found.where("held_out").join(truth, "doc_id").collect()
    return sum(r.predicted == r.truth for r in rows) / len(rows)


def test_language_held_out(tables):
    docs, _ = tables
    model = language.train(docs)
    rows = language.identify(docs, model, ("doc_id", "lang")).collect()
    held = [r for r in rows if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.lang is not None]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert sum(r.rejected for r in rows) <= 2
    entropy, letters = language.Reader(model).entropies(["Привет мир как твои дела сегодня"])
    assert entropy.min() > max(x[np.searchsorted(language.LENGTHS, letters[0], "right")] for x in model.limits.values())
    sure = [r for r in held if r.score > 0.9]
    assert sum(r.lang == r.lang_pred for r in sure) / len(sure) > 0.98  # the score is calibrated


def plain_sequence(text):
    out = ""
    for c in text:
        c = c.lower() if c.isalpha() else " "
        out += "" if c == " " and (out[-1:] or " ") == " " else c
    return "   " + out


def plain_kneser_ney(texts, alphabet):
    """A function from three letters and a next one to its probability, in plain Python."""
    weights = {4: collections.Counter(s[i - 3 : i + 1] for s in map(plain_sequence, texts) for i in range(3, len(s)))}
    for n in (3, 2, 1):
        weights[n] = collections.Counter(g[1:] for g in weights[n + 1])

    def chance(n, context, letter):
        if n == 0:
            return 1 / alphabet
        context = context[len(context) - n + 1 :] if n > 1 else ""
        own = {g: w for g, w in weights[n].items() if g[: n - 1] == context}
        if not own:
            return chance(n - 1, context, letter)
        once, twice = (sum(w == k for w in weights[n].values()) for k in (1, 2))
        d = min(0.95, max(0.1, once / max(once + 2 * twice, 1)))
        mass = sum(own.values())
        return max(own.get(context + letter, 0) - d, 0) / mass + sum(min(d, w) for w in own.values()) / mass * chance(n - 1, context, letter)

    return lambda context, letter: chance(4, context, letter)


CORPUS = {"xx": ["abcab cab", "bca abc, CAB!", "cabbage", "abba a"], "yy": ["zu zuzu", "uzz baz", "zab"]}


def corpus_rows(spark):
    return spark.createDataFrame([(k, t, x) for k, (x, t) in enumerate((x, t) for x, texts in CORPUS.items() for t in texts * 3)], "doc_id long, text string, lang string")


def test_language_equals_plain_kneser_ney(spark):
    rows = corpus_rows(spark)
    model = language.train(rows)
    counted = [(r.text, r.lang) for r in rows.where(~labelled.held_out()).collect()]
    alphabet = len({c for t, _ in counted for c in plain_sequence(t)}) + 1
    texts = ["abc", "cab zu", "uzz", "q?a", "zzz abba", "b"]
    entropy, letters = language.Reader(model).entropies(texts)
    for k, name in enumerate(model.names):
        chance = plain_kneser_ney([t for t, x in counted if x == name], alphabet)
        for i, text in enumerate(texts):
            s = plain_sequence(text)
            wanted = -sum(np.log(chance(s[j - 3 : j], s[j])) for j in range(3, len(s))) / (len(s) - 3)
            assert letters[i] == len(s) - 3 and np.isclose(entropy[i, k], wanted, rtol=1e-5)
    # probabilities of the next letter add up to one; a letter that was never seen has the last share
    known = sorted({c for t, _ in counted for c in plain_sequence(t)})
    for context in ("   ", "  a", "cab", "qqq"):
        rows = np.array([[ord(c) for c in context + x] for x in [*known, "q"]])
        assert np.allclose(np.exp(model.chances(rows).astype(float)).sum(axis=0), 1, atol=1e-4)


def test_language_pruned_probabilities_sum_to_one(spark):
    grams = collections.Counter((0, s[i - 3 : i + 1]) for s in map(plain_sequence, CORPUS["xx"]) for i in range(3, len(s)))
    counts = spark.createDataFrame([(k, g, n) for (k, g), n in grams.items()], "language int, gram string, weight long")
    entries, alphabet = language.probabilities(counts, prune=0.05)
    model = language.Model(["xx"], language._voices(entries.toArrow().combine_chunks(), 1), -np.log(alphabet))
    assert entries.count() < language.probabilities(counts)[0].count()
    letters = sorted({c for _, g in grams for c in g})
    for context in ("   ", "cab", "abb"):
        rows = np.array([[ord(c) for c in context + x] for x in [*letters, "q"]])
        assert np.isclose(np.exp(model.chances(rows).astype(float)).sum(), 1, atol=1e-4)


def test_language_counts_match_plain_python(monkeypatch):
    random.seed(8)
    texts = ["".join(random.choices("abcé漢字 \n.", k=random.randint(0, 80))) for _ in range(40)] + [None, "".join(map(chr, range(0x4E00, 0x4E00 + 9000)))]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(["l%d" % (k % 2) for k in range(len(texts))]), pa.array([k % 3 == 0 for k in range(len(texts))])], names=["text", "lang", "apart"])
    wanted = collections.Counter()
    for k, t in enumerate(texts):
        s = plain_sequence(t or "")
        wanted.update((2 * (k % 2) + (k % 3 == 0), s[i - 3 : i + 1]) for i in range(3, len(s)))
    for bits, table in ((15, 1 << 22), (13, 1 << 22), (15, 16)):
        monkeypatch.setattr(language, "_BITS", bits)
        monkeypatch.setattr(language, "TABLE", table)
        got = collections.Counter()
        for out in language._count(["l0", "l1"])(iter([batch.slice(0, 20), batch.slice(20)])):
            for g, gram, n in zip(*(out.column(c).to_pylist() for c in ("group", "gram", "count"))):
                got[g, gram] += n
        assert got == wanted


def test_language_every_language_can_reject(spark):
    rows = [(k, "the cat sat on the mat", "en") for k in range(60)] + [(k, "der hund lief nach haus", "de") for k in range(60, 70)] + [(k, "123 456", "nn") for k in range(70, 90)]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["de", "en", "nn"] == sorted(model.limits)
    assert all(np.isfinite(x).all() for x in model.limits.values()) and model.limits["nn"].max() == max(x.max() for x in model.limits.values())


def test_language_one_wrong_label_moves_no_limit(spark):
    random.seed(3)
    words = ["".join(random.choices("aeioulmnrst", k=5)) for _ in range(60)]
    rows = [(k, " ".join(random.choices(words, k=30)), "en") for k in range(12_000)]
    wrong = [(20_000 + k, "zxq qzx xzq zzq" * 10, "en") for k in range(2)]
    limits = [language.train(spark.createDataFrame(r, "doc_id long, text string, lang string").repartition(4)).limits["en"][2] for r in (rows, rows + wrong)]
    assert limits[1] < 1.05 * limits[0]


def test_language_odd_rows(odd, empty, spark):
    model = language.train(odd)
    rows = language.identify(odd, model).collect()
    assert len(rows) == odd.count()
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 9)} == {"und"} and all(r.rejected and r.score == 0 for r in rows if r.doc_id in (3, 4, 5, 9))
    assert {r.lang_pred for r in rows if r.doc_id == 6} == {"en"} and all(0 <= r.score <= 1 for r in rows)
    none = language.train(empty)
    assert language.identify(empty, none).count() == 0
    assert {r.lang_pred for r in language.identify(odd, none).collect()} == {"und"}


def average_precision(rows):
    """Mean precision at the rows of class 1, by falling score."""
    hits, total = 0, 0.0
    for k, r in enumerate(sorted(rows, key=lambda r: -r.score), 1):
        if r.truth:
            hits += 1
            total += hits / k
    return total / hits


def test_toxicity(tables):
    docs, labels = tables
    found = toxicity.score(docs, toxicity.train(docs, labels))
    assert accuracy(found, labels.selectExpr("doc_id", "toxic AS truth")) > 0.9
    assert found.where("score < 0 OR score > 1").count() == 0


def test_toxicity_of_rows_that_no_model_has_seen(spark):
    """Ranking, recall and precision of class 1, which few rows have."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet") for name in ("documents", "labels"))
    found = toxicity.score(docs, toxicity.train(docs, labels)).where("held_out").join(labels.selectExpr("doc_id", "toxic AS truth"), "doc_id")
    rows = found.where("truth IS NOT NULL").select("score", "predicted", "truth").collect()
    ones, told = [r for r in rows if r.truth], [r for r in rows if r.predicted]
    assert average_precision(rows) > 0.94
    assert sum(r.predicted for r in ones) > 0.85 * len(ones) and sum(r.truth for r in told) > 0.93 * len(told)


def test_toxicity_keeps_every_clear_ngram(spark):
    random.seed(5)
    word = lambda: "".join(random.choices("abcdefghijklmnopqrstuvwxyz", k=9))
    bad, plain = [word() for _ in range(40)], [word() for _ in range(400)]
    texts = [" ".join([*random.choices(plain, k=6), x]) for x in bad for _ in range(40)]
    clean = [" ".join(random.choices(plain, k=7)) for _ in range(6000)]
    docs = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(k, int(k < len(texts))) for k in range(len(texts) + len(clean))], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert len(model.slots) > 700
    assert (model.scores(bad) > 0.5).all() and (model.scores([*plain, ""]) < 0.5).all()


def test_toxicity_fit(monkeypatch):
    monkeypatch.setattr(toxicity, "BLOCK", 64)
    rng = np.random.default_rng(4)
    sizes = rng.integers(0, 6, 300)
    rows, label, ratios = np.repeat(np.arange(300), sizes), rng.integers(0, 2, 300).astype(float), rng.normal(size=40)
    columns = rng.integers(0, 40, len(rows)).astype(np.int32)
    weights, b = toxicity.fit(ratios, sizes, columns, label)
    # where the penalised likelihood is highest, each n-gram's gradient is the penalty of what it adds to the slope
    p = 1 / (1 + np.exp(-(np.bincount(rows, weights[columns], 300) + b)))
    gradient = ratios * np.bincount(columns, (label - p)[rows], 40)
    slope = gradient.sum() / toxicity.PENALTY
    assert np.allclose(gradient, toxicity.PENALTY * (weights / ratios - slope), atol=1e-4) and abs((label - p).sum()) < 1e-3
    # the last n-gram is in no fitted row
    weights, _ = toxicity.fit(np.array([2.0, -1.5, 3.0]), np.ones(200, int), (np.arange(200) % 2).astype(np.int32), (np.arange(200) % 2 == 0).astype(float))
    assert weights[0] > 0 > weights[1] and weights[2] > 0


def test_quality(tables):
    docs, labels = tables
    found = quality.score(docs, quality.train(docs, labels))
    assert accuracy(found, labels.selectExpr("doc_id", "quality AS truth")) > 0.93


def test_quality_of_tables_with_other_columns(spark, tables):
    """A column n_chars that holds no numbers is a missing one."""
    docs, labels = tables
    odd = docs.withColumn("n_chars", F.when(F.col("doc_id") % 2 == 0, "n/a").otherwise("12.5"))
    found = quality.score(odd, quality.train(odd, labels))
    assert found.count() == docs.count() and found.where("score IS NULL").count() == 0


def test_quality_fit_goes_down_the_gradient(monkeypatch):
    """One step of the fit changes each weight against the loss's slope, told by differences of the loss."""
    rng = np.random.default_rng(6)
    n, wide = 12, 9
    row = np.repeat(np.arange(n), 4)
    column = np.concatenate([rng.choice(wide, 4, replace=False) for _ in range(n)])
    value, label = rng.normal(size=4 * n), rng.integers(0, 2, n).astype(float)
    monkeypatch.setattr(quality, "SIZE", wide)
    monkeypatch.setattr(quality, "EPOCHS", 0)
    monkeypatch.setattr(quality, "LEAST_STEPS", 0)
    before = quality.fit(row, column, value, label)
    monkeypatch.setattr(quality, "LEAST_STEPS", 1)
    after = quality.fit(row, column, value, label)

    def loss(machine):
        raw, _ = machine.raw(row, column, value, n)
        return float(np.mean(np.logaddexp(0, raw) - label * raw))

    for name in ("linear", "factors"):
        old, new = getattr(before, name), getattr(after, name)
        for at in np.ndindex(old.shape):
            moved = {name: old.copy()}
            moved[name][at] += 1e-6
            slope = (loss(quality.Machine(before.bias, **({"linear": before.linear, "factors": before.factors} | moved))) - loss(before)) / 1e-6
            if abs(slope) > 1e-3:
                assert np.sign(new[at] - old[at]) == -np.sign(slope)
    assert loss(after) < loss(before)


def test_pairwise_interactions_matter():
    """Labels that only a pair of features tells: the machine learns them, its linear part alone doesn't."""
    rng = np.random.default_rng(8)
    n = 1500
    bits = rng.integers(0, 2, (n, 2))
    label = (bits[:, 0] ^ bits[:, 1]).astype(float)
    row, column = np.repeat(np.arange(n), 2), (np.array([0, 2]) + bits).ravel()
    machine = quality.fit(row, column, np.ones(2 * n), label)
    raw, _ = machine.raw(row, column, np.ones(2 * n), n)
    linear, _ = quality.Machine(machine.bias, machine.linear, np.zeros_like(machine.factors)).raw(row, column, np.ones(2 * n), n)
    assert ((raw > 0) == label).mean() > 0.95 > 0.7 > ((linear > 0) == label).mean()


def test_sum_of_squares_identity():
    rng = np.random.default_rng(3)
    machine = quality.Machine(0.3, rng.normal(size=quality.SIZE), rng.normal(size=(quality.SIZE, quality.RANK)))
    columns, values = rng.choice(quality.SIZE, 12, replace=False), rng.normal(size=12)
    raw, _ = machine.raw(np.zeros(12, int), columns, values, 1)
    pairs = sum(machine.factors[columns[i]] @ machine.factors[columns[j]] * values[i] * values[j] for i in range(12) for j in range(i))
    assert np.isclose(raw[0], 0.3 + machine.linear[columns] @ values + pairs)


@pytest.mark.parametrize("operator", [toxicity, quality])
def test_classifiers_odd_rows(operator, odd, empty, spark):
    labels = spark.createDataFrame([(1, 0, 0), (2, 1, 1), (2, 1, 1), (6, 1, 0), (7, None, None), (None, 1, 1), (10, 0, 1)], "doc_id long, quality int, toxic int")
    model = operator.train(odd, labels)
    rows = operator.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 and r.predicted in (0, 1) for r in rows)
    assert operator.score(empty, model).count() == 0
    nothing = operator.train(empty, labels.where("false"))
    assert len({r.score for r in operator.score(odd.select("doc_id", "text"), nothing).collect()}) >= 1


def test_held_out_rule(spark):
    ids = [1, 2, 33, 4567, -8]
    rows = spark.createDataFrame([(i,) for i in ids] + [(None,)], "doc_id long").select("doc_id", labelled.held_out().alias("h")).collect()
    assert all(r.h == (r.doc_id is None or zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)


def test_grams_match_plain_python():
    random.seed(2)
    texts = ["Hello, World!", "", "abcdefg hi", "x", "ßÄ é"]
    got = sum(len(owner) for owner, _ in toxicity.grams(texts))
    wanted = 0
    for t in texts:
        s = "".join(c.lower() if c.isalpha() else " " for c in f" {t} ")
        wanted += sum(" " not in s[i + 1 : i + n - 1] for n in toxicity.ORDERS for i in range(len(s) - n + 1))
    assert got == wanted


def plain_grams(text):
    s = "".join(c.lower() if c.isalpha() else " " for c in f" {text} ")
    return {s[i : i + n] for n in toxicity.ORDERS for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1]}


def test_toxicity_ratios_match_plain_python(spark):
    random.seed(12)
    words = ["".join(random.choices("abcdef", k=5)) for _ in range(25)]
    texts = [(k, " ".join(random.choices(words[:15] if k % 3 else words[10:], k=8)), int(k % 3 == 0)) for k in range(600)]
    docs = spark.createDataFrame([(k, t) for k, t, _ in texts], "doc_id long, text string").repartition(3)
    model = toxicity.train(docs, spark.createDataFrame([(k, x) for k, _, x in texts], "doc_id long, toxic int"))
    train = [(t, x) for k, t, x in texts if zlib.crc32(str(k).encode()) % 5]
    counts = [collections.Counter(g for t, x in train if x == y for g in plain_grams(t)) for y in (0, 1)]
    sizes = [sum(x == y for _, x in train) for y in (0, 1)]
    ratios = {g: np.log((counts[1][g] + 1) / (sizes[1] + 2)) - np.log((counts[0][g] + 1) / (sizes[0] + 2)) for g in {*counts[0], *counts[1]}}
    clear = {g: r for g, r in ratios.items() if abs(r) / np.sqrt(1 / (counts[1][g] + 1) + 1 / (counts[0][g] + 1)) >= toxicity.CLEAR}
    assert len(model.slots) == len(clear) > 50
    for t, _ in train[:20]:
        owner, at = toxicity.Features(model.slots).present([t])
        assert len(at) == len(plain_grams(t) & set(clear)) == len(set(at.tolist()))
        assert np.isclose(model.scores([t])[0], 1 / (1 + np.exp(-(model.weights[at].sum() + model.intercept))))


def test_quality_features_match_plain_python():
    texts = ["The Cat sat on the MAT.\nThe cat sat!", "", "  \n", "ÀB 12 @@## été " * 9, "one"]
    chars = [None, 0, 3, len(texts[3]), 99]
    batch = pa.RecordBatch.from_arrays([pa.array(texts), pa.array(chars, pa.int64())], names=["text", "n_chars"])
    row, column, value = quality.features(batch)
    for k, text in enumerate(texts):
        raw = text.encode()
        words = [w for w in re.split(rb"[ \t\n\r\x0b\x0c]+", raw) if w]
        distinct = {w.lower() for w in words}
        own = {c: v for r, c, v in zip(row.tolist(), column.tolist(), value.tolist()) if r == k and c >= 1 << quality.WORD_BITS}
        hashed = [v for r, c, v in zip(row.tolist(), column.tolist(), value.tolist()) if r == k and c < 1 << quality.WORD_BITS]
        assert len(hashed) == len(distinct) and np.allclose(hashed, 1 / np.sqrt(max(len(distinct), 1)))
        size, upper, lower = max(len(raw), 1), sum(65 <= b <= 90 for b in raw), sum(97 <= b <= 122 for b in raw)
        foreign, blank, newline = sum(b >= 128 for b in raw), sum(b in b" \t\r\x0b\x0c" for b in raw), raw.count(b"\n")
        marks = sum(33 <= b < 127 and not chr(b).isalnum() and chr(b) not in ".,;:'\"?()-" for b in raw)
        some = max(len(words), 1)
        stated = {
            "length": len(raw), "symbols": marks / size, "upper": upper / max(upper + lower + foreign + sum(b < 32 and b not in b"\t\n\r\x0b\x0c" for b in raw), 1), "digits": sum(48 <= b <= 57 for b in raw) / size,
            "blank": (blank + newline) / size, "lines": 100 * newline / some, "distinct": len(distinct) / some, "word": (size - blank - newline) / some, "foreign": foreign / size,
            "stored": 0 if chars[k] is None else 1 if chars[k] == len(text) else 2,
        }
        assert own == {quality._PLACE[n] + sum(x >= e for e in quality._EDGES[n]): 1.0 for n, x in stated.items()}
