import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from siftwright.functions import embedders, predicates, scalars, texts, vectors


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'double' if isinstance(v, float) else 'bigint' if isinstance(v, int) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], schema).select(column.alias("x")).first().x


@pytest.mark.parametrize(("a", "b", "bits"), [("0" * 64, "0" * 64, 0), ("0" * 63 + "1", "0" * 64, 1), ("0" * 64, "f" * 64, 256), ("", "0" * 64, None), ("zz", "0" * 64, None)])
def test_hamming(spark, a, b, bits):
    assert one(spark, vectors.hamming(F.col("a"), F.col("b")), a=a, b=b) == bits
    assert one(spark, vectors.hamming(F.col("b"), F.col("a")), a=a, b=b) == bits


def test_cosine_edges(spark):
    df = spark.createDataFrame([([1.0, 0.0], [1.0, 0.0]), ([0.0, 0.0], [1.0, 0.0]), ([1.0], [1.0, 2.0]), (None, [1.0])], "a array<double>, b array<double>")
    assert [r.s for r in df.select(vectors.cosine(F.col("a"), F.col("b")).alias("s")).collect()] == [1.0, None, None, None]


ITEMS = [("p1", {"Age": "(25-32)", "Gender": "Female"}), ("p2", {"age": "(0-2)", "Gender": "female "}), ("p3", {"Gender": "Male", "score": "0.9"}), ("p4", {}), ("p5", None), ("p1", {"Age": "unknown", "k": "x"})]


@pytest.mark.parametrize(
    ("criteria", "strict", "paths"),
    [
        ("", False, ["p1", "p2", "p3", "p4", "p5"]),
        (None, False, ["p1", "p2", "p3", "p4", "p5"]),
        ("Age < 18", False, ["p2", "p1"]),
        ("Age <= 32, Gender:FEMALE", False, ["p1", "p2"]),
        ("AGE >= 20", False, ["p1"]),
        ("score > 0.5", False, ["p3"]),
        ("score > many", False, []),
        ("k = x", False, ["p1"]),
        ("k = X", False, []),
        ("Age:>20", False, ["p1"]),
        ("Age:>20", True, []),
        ("no clause", False, ["p1", "p2", "p3", "p4", "p5"]),
        ("Age: 32", False, ["p1"]),
        ("gender:male", False, ["p3"]),
    ],
)
def test_metadata_filter(spark, criteria, strict, paths):
    df = spark.createDataFrame([(k, p, m) for k, (p, m) in enumerate(ITEMS)], "ordinal int, path string, metadata map<string,string>")
    rows = predicates.filter_by_metadata(df, criteria, strict).orderBy("ordinal").collect()
    assert [r.path for r in rows] == paths


def test_age_gender_gate(spark):
    df = spark.createDataFrame([(m,) for _, m in ITEMS], "metadata map<string,string>")
    assert predicates.has_age_gender(df).first().present
    assert not predicates.has_age_gender(df.where("size(metadata) = 0")).first().present


@pytest.mark.parametrize(("pattern", "hits"), [("5..10", [5.0, 10.0]), (">=10", [10.0, 11.5]), ("<5", [-1.0]), ("==5", [5.0]), ("a..b", []), (">x", []), ("plain", [])])
def test_ranges(spark, pattern, hits):
    df = spark.createDataFrame([(x,) for x in (-1.0, 5.0, 10.0, 11.5)], "v double")
    assert [r.v for r in df.where(predicates.range_predicate(F.col("v"), pattern)).collect()] == hits


def test_pattern_parser():
    assert predicates.parse_pattern(" 5..10 ") == ("range", "5..10") and predicates.parse_pattern(">=0.5") == ("range", ">=0.5")
    assert predicates.parse_pattern("7") == ("number", 7) and predicates.parse_pattern("7.5") == ("number", 7.5) and predicates.parse_pattern("cat") == ("substring", "cat")


def test_output_filter(spark):
    df = spark.createDataFrame([("a Cat 7",), ("dog -0.5",), (None,)], "t string")
    kept = lambda *a, **k: [r.t for r in df.where(predicates.output_filter(F.col("t"), *a, **k)).collect()]
    assert len(kept([])) == 3 and kept(["cat"]) == [] and kept(["cat"], case_sensitive=False) == ["a Cat 7"]
    assert kept(["C.t|g -"], "regex") == ["a Cat 7", "dog -0.5"] and kept(["("], "regex") == [] and kept(["5..8"], "numeric_range") == ["a Cat 7"]
    assert kept(["<0", "5..8"], "numeric_range") == ["a Cat 7", "dog -0.5"]


@pytest.mark.parametrize(("text", "reason"), [("/help me", "internal_command"), ("find Images", "keyword_match"), ("look in /data/x", "path_detected"), ("the weather?", "non_forensic"), ("hello", "no_match")])
def test_request_gate(spark, text, reason):
    assert one(spark, predicates.request_gate(F.col("t"), ["images"], ["weather"])["reason"], t=text) == reason
    assert one(spark, predicates.request_gate(F.col("t"), [], [], enabled=False)["allowed"], t=text)


@pytest.mark.parametrize(
    ("column", "value", "wanted"),
    [
        (lambda c: scalars.truncate(c, 3), " abcdef ", "abc..."),
        (scalars.title, "x" * 60, "x" * 50 + "..."),
        (scalars.preview, "y" * 281, "y" * 277 + "…"),
        (scalars.basename_key, "/A/B/File.TXT", "file.txt"),
        (scalars.extension, "/a/.hidden", ""),
        (scalars.extension, "/a/x.tar.GZ", ".gz"),
        (scalars.normalised_path, " /a/./b//../c/ ", "/a/c"),
        (scalars.normalised_path, "\\\\?\\C:\\x", "/C:/x"),
        (scalars.segment, "a b/é.txt", "a_b_é.txt"),
        (scalars.segment, "", "unknown"),
        (scalars.demo_scope, "/home/Documents/Demo12/x", "demo12"),
        (scalars.demo_scope, "/home/x", None),
        (scalars.endpoint_slug, "a/b c", "a_b_c"),
        (scalars.action_status, " Completed", "Success"),
        (scalars.action_status, None, "Unknown"),
        (scalars.job_status, "other", "Running"),
        (scalars.ground_truth_name, "ann_lee_12.jpg", "ann_lee"),
        (scalars.after_think, "<think>no</think> yes ", "yes"),
        (scalars.after_think, " plain ", "plain"),
        (scalars.source_image, "/o/a.png.txt", "/o/a.png"),
        (scalars.source_image, "/o/a.txt", None),
        (scalars.integer_box, "[1, 2.0, 3, 4]", [1, 2, 3, 4]),
        (scalars.integer_box, "[1, -2, 3, 4]", None),
        (scalars.integer_box, "junk", None),
        (scalars.chain_list, '["a","b"]', ["a", "b"]),
        (scalars.chain_list, "junk", None),
        (scalars.parent, "/a/b/c", "/a/b"),
    ],
)
def test_scalars(spark, column, value, wanted):
    df = spark.createDataFrame([(value,)], "v string")
    assert df.select(column(F.col("v")).alias("x")).first().x == wanted


def test_titles_and_chains(spark):
    df = spark.createDataFrame([(["a", "b", "a"], "c"), (None, "c"), (None, None)], "chain array<string>, endpoint string")
    rows = df.select(scalars.results_title(F.col("chain"), F.col("endpoint")).alias("t"), scalars.pipeline_endpoints(F.col("chain"), F.col("endpoint")).alias("e")).collect()
    assert [(r.t, r.e) for r in rows] == [("Results for: a → b → c", ["a", "b", "c"]), ("Results for: c", ["c"]), ("Results", ["unknown"])]


def test_log_lines(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05 | INFO  | job_id=J1 x | eng.mod | hello | there",), ("broken",)], "v string")
    good, bad = (r.r for r in df.select(scalars.log_record(F.col("v")).alias("r")).collect())
    assert (good.level, good.job_id, good.message, good.timestamp.year) == ("INFO", "J1", "hello | there", 2024) and bad is None


def test_bands(spark):
    df = spark.createDataFrame([(0.1,), (0.5,), (0.7,), (0.9,)], "p double")
    assert [r.b for r in df.select(scalars.probability_band(F.col("p")).alias("b")).collect()] == ["likely fake", "uncertain", "weakly real", "likely real"]
    df = spark.createDataFrame([(2.0, 0.0), (0.0, 0.6), (0.1, 0.0)], "a double, b double")
    assert [r.b for r in df.select(scalars.softmax_band(F.col("a"), F.col("b"))["prediction"].alias("b")).collect()] == ["likely real", "weakly fake", "uncertain"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab \n.", max_size=900), st.integers(20, 80))
def test_chunker_invariants(text, size):
    chunks = texts.split_recursively(text, size, size // 5)
    assert all(0 < len(c) <= size for c in chunks)
    assert set("".join(text.split())) == set("".join("".join(chunks).split()))
    at = 0
    for c in chunks:
        found = text.find(c, max(0, at - size))
        assert found >= 0
        at = found + len(c)


def test_chunk_rows(spark):
    df = spark.createDataFrame([("a", "word " * 200), ("b", ""), ("c", None)], "path string, text string")
    rows = texts.chunk_table(df).collect()
    assert {r.path for r in rows} == {"a"} and [r.chunk_index for r in rows] == list(range(len(rows)))
    assert texts.chunk_table(df, whole=True).count() == 1


def test_tool_calls():
    call = {"name": "a", "arguments": '{"x": {"y": 1}}'}
    body = '{"name": "a", "arguments": {"x": {"y": 1}}}'
    assert texts.tool_calls(f"t <tool_code>{body}</tool_code> <tool_code>[{body}]</tool_code>") == [call, call]
    assert texts.tool_calls(f'{{"calls": [{body}]}}') == [call] and texts.tool_calls(body) == [call]
    assert texts.tool_calls(f"so: {body} done") == [call] and texts.tool_calls("<tool_code>{bad</tool_code>") == []
    assert texts.tool_calls("") == [] and texts.tool_calls(None) == []


def test_argument_names(spark):
    df = spark.createDataFrame([({"path": "x.ufdr", "mount_dir": "m"},)], "a map<string,string>")
    get = lambda endpoint: df.select(texts.normalised_arguments(F.col("a"), endpoint).alias("n")).first().n
    assert get("ufdr_mounter/mount") == {"ufdr_file": "x.ufdr", "mount_name": "m"}
    assert get("") == {"input_dir": "x.ufdr", "mount_dir": "m"} and get("age-gender/predict")["image_directory"] == "x.ufdr"


def test_visible_text(spark):
    html = '<html><head><title>t</title></head><body>x<div class="a markdown-body b"><p>Hi &amp; <b>you</b></p><script>no()</script></div></body></html>'
    assert one(spark, texts.visible_text(F.col("h")), h=html) == "x Hi & you"
    assert one(spark, texts.contained_text()(F.col("h")), h=html) == "Hi & you"
    assert texts.container_text('<div class="markdown-body">one <div>two</div> three</div> four') == "one two three"
    assert texts.container_text("<div>plain</div>") is None and texts.container_text('<div class="markdown-body">open <b>end') == "open end"
    assert one(spark, texts.visible_text(F.col("h")), h="<p>a</p> b") == "a b"


def test_embedder_is_deterministic():
    a, b = embedders.hash_embed(["one two", ""]), embedders.hash_embed(["two one", "x"])
    assert (a[0] == b[0]).all() and not a[1].any()
