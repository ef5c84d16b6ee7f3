"""Operator 7: personal data, with DataFrame functions only.

Regular expressions propose spans, checksums confirm them (Luhn for cards, mod-97 for bank account numbers, octet ranges
for addresses), and words close to a span move its score. Matches come from ``regexp_extract_all`` and their places from
the lengths of the pieces that ``split`` leaves between them, so every text is scanned a fixed number of times, whatever
its length. Repeats inside the patterns are possessive where nothing that follows could use a shorter one, and a run is
tried from its start alone (or where the last match ended): the same matches, in linear time and with no stack growth on
long runs.

Defined results: null and empty texts have no spans; each row stands by itself, so repeated rows and ties have no effect;
other columns are carried along; an empty table gives no rows. Offsets are code points, end exclusive.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Patterns of the base kinds and of the added kind, in the order in which they are reported.
PATTERNS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
}
BASE = ("email", "ip", "card", "phone")
# A cheap test that every text with a match passes.
HINTS = {"email": "@", "ip": ".", "phone": "+"}
#: Words near a span that raise or lower its score, and the characters on each side that count as near.
RAISING = {
    "email": r"(?i)e-?mail|mail|contact|write|reach",
    "ip": r"(?i)\bip\b|address|host|server|login",
    "card": r"(?i)card|visa|master|credit|debit|payment",
    "phone": r"(?i)phone|call|tel|mobile|fax|contact",
    "iban": r"(?i)iban|account|bank|konto|compte|cuenta",
}
LOWERING = r"(?i)example|sample|test|version|dummy|order|isbn"
NEAR = 40
#: Matches whose places are summed up at a time.
GROUP = 256
#: Score of a span that its pattern and checksum confirm, before context.
CONFIRMED = {"email": 0.7, "ip": 0.5, "card": 0.8, "phone": 0.5, "iban": 0.9}
_OCTETS = r"0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])(?:\.0*(?:[0-9]|[1-9][0-9]|1[0-9][0-9]|2[0-4][0-9]|25[0-5])){3}"


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def mod97(x: Column) -> Column:
    """Whether an account number (letters and digits) leaves 1 modulo 97, country and check digits moved to the end."""
    plain = F.replace(x, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    step = lambda rest, c: F.when(c.rlike("[0-9]"), (rest * 10 + c.cast("int")) % 97).otherwise((rest * 100 + F.ascii(c) - 55) % 97)
    return F.aggregate(F.split(turned, "(?<=.)(?=.)"), F.lit(0), step) == 1


def confirmed(kind: str, x: Column) -> Column:
    """Whether a match of a kind passes its checks."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return x.rlike(f"^{_OCTETS}$")
    if kind == "card":
        size = F.length(_digits(x))
        return F.when(size.between(13, 19), F.call_function("luhn_check", _digits(x))).otherwise(False)
    if kind == "phone":
        return F.length(_digits(x)).between(9, 15)
    return F.when(F.length(F.replace(x, F.lit(" "), F.lit(""))).between(15, 34), mod97(x)).otherwise(False)


def _score(kind: str, before: Column, after: Column) -> Column:
    around = F.concat_ws(" ", F.substring(before, -NEAR, NEAR), F.substring(after, 1, NEAR))
    moved = F.lit(CONFIRMED[kind]) + F.when(around.rlike(RAISING[kind]), 0.2).otherwise(0.0) - F.when(around.rlike(LOWERING), 0.3).otherwise(0.0)
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), moved)), 2)


def _once(value: Column, function) -> Column:
    """``function`` of a value that is worked out once, however often the function uses it."""
    return F.element_at(F.transform(F.array(value), function), 1)


def _matches(text: Column, kind: str) -> Column:
    """Confirmed matches of a kind as an array of (kind, start, end, value, score), by start.

    The context of a match ends at the neighbouring matches of its kind.
    """
    values, pieces = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0)), F.split(text, PATTERNS[kind], -1)
    many = F.size(values)
    gaps = F.zip_with(F.slice(pieces, 1, many), F.slice(pieces, 2, many), lambda p, q: F.struct(p.alias("before"), q.alias("after")))
    paired = F.zip_with(values, gaps, lambda v, g: F.struct(v.alias("value"), g["before"].alias("before"), g["after"].alias("after")))
    empty = F.array().cast("array<struct<kind:string,start:int,end:int,value:string,score:double>>")
    width = lambda m: F.length(m["before"]) + F.length(m["value"])

    def step(state: Column, m: Column) -> Column:
        start = state["at"] + F.length(m["before"])
        end = start + F.length(m["value"])
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), m["value"].alias("value"), _score(kind, m["before"], m["after"]).alias("score"))
        return F.struct(end.alias("at"), F.when(confirmed(kind, m["value"]), F.concat(state["found"], F.array(span))).otherwise(state["found"]).alias("found"))

    def placed(groups: Column) -> Column:
        sizes = F.transform(groups, lambda g: F.aggregate(g, F.lit(0), lambda a, m: a + width(m)))
        begins = F.aggregate(sizes, F.array(F.lit(0)), lambda a, n: F.concat(a, F.array(F.element_at(a, -1) + n)))
        return F.flatten(F.zip_with(groups, F.slice(begins, 1, F.size(groups)), lambda g, at: F.aggregate(g, F.struct(at.alias("at"), empty.alias("found")), step, lambda state: state["found"])))

    # places are sums of what stands before: of whole groups of matches first, then within each group
    grouped = _once(paired, lambda p: F.transform(F.sequence(F.lit(0), F.floor((F.size(p) - 1) / GROUP).cast("int")), lambda g: F.slice(p, g * GROUP + 1, F.lit(GROUP))))
    within = _once(grouped, placed)
    likely = F.contains(text, F.lit(HINTS[kind])) if kind in HINTS else F.lit(True)
    return F.when(likely & (many > 0), within).otherwise(empty)


def find_personal_data(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with an array column per kind (email, ip, card, phone, iban): struct<kind, start, end, value, score>."""
    whole = F.coalesce(F.col(text), F.lit(""))
    return docs.withColumns({k: _matches(whole, k) for k in PATTERNS})


def masked(docs: DataFrame, least: float = 0.5, text: str = "text") -> DataFrame:
    """``docs`` with every span of at least that score replaced by its kind in angle brackets.

    Spans that overlap an earlier one are left to it; of spans with the same start the longest is taken.
    """
    found = find_personal_data(docs, text)
    spans = F.array_sort(F.filter(F.concat(*PATTERNS), lambda s: s["score"] >= least), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(b["end"] - a["end"]))
    whole = F.coalesce(F.col(text), F.lit(""))
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(state: Column, s: Column) -> Column:
        put = F.concat(state["out"], F.substr(whole, state["at"] + 1, s["start"] - state["at"]), F.lit("<"), s["kind"], F.lit(">"))
        return F.when(s["start"] < state["at"], state).otherwise(F.struct(s["end"].alias("at"), put.alias("out")))

    done = F.aggregate(spans, first, step, lambda state: F.concat(state["out"], F.substr(whole, state["at"] + 1)))
    return found.withColumn(text, F.when(F.col(text).isNotNull(), done)).drop(*PATTERNS)


def _written(spans: Column) -> Column:
    return F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string")))


def digest_documents(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base kinds, digest of the base spans, all spans, and the scores of all spans."""
    found = find_personal_data(docs.select("doc_id", "text"))
    base = F.concat(*(_written(F.col(k)) for k in BASE))
    return found.select(
        "doc_id",
        *(F.size(k).cast("bigint").alias(f"n_{k}") for k in BASE),
        F.sha2(F.array_join(base, ","), 256).alias("base_sha256"),
        F.array_join(F.concat(base, _written(F.col("iban"))), ",").alias("spans"),
        F.array_join(F.transform(F.concat(*PATTERNS), lambda s: s["score"].cast("string")), ",").alias("scores"),
    )
