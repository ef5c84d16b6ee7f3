"""Filter mini-languages compiled to Column predicates on the driver."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The forms of numbers and clauses.
_NUMBER = r"[-+]?\d*\.\d+|\d+"
_CLAUSE = r"^\s*(\S+)\s*(<=|>=|<|>)\s*(.+)\s*$"
_OPS = {"<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "==": lambda a, b: a == b}


def age_upper(bucket: Column) -> Column:
    """Upper bound of an ``(a-b)`` age bucket, 0 for anything else."""
    return F.coalesce(F.regexp_extract(F.trim(bucket), r"^\((\d+)-(\d+)\)", 2).try_cast("double"), F.lit(0.0))


def metadata_value(metadata: Column, key: str) -> Column:
    """Value of a key: exactly, or else of the first key that differs in case only."""
    folded = F.map_values(F.map_filter(metadata, lambda k, _: F.lower(k) == key.lower()))
    return F.coalesce(F.try_element_at(metadata, F.lit(key)), F.try_element_at(folded, F.lit(1)))


def _number(text: str) -> float | None:
    try:
        return float(text)
    except ValueError:
        return None


def parse_clause(clause: str, strict: bool = False) -> tuple[str, str | None, str] | None:
    """(key, operator or None, value) of one clause; None for a clause without an operator, which holds for all rows.

    ``Age:>5`` and ``Age=>5`` compare. With ``strict`` the operator binds first, the key keeps its colon or equals sign,
    and such a clause holds for no row.
    """
    if m := re.match(_CLAUSE, clause):
        key = m[1] if strict else m[1].rstrip(":=")
        return key.strip(), m[2], m[3].strip()
    for mark in ":=":
        if mark in clause:
            key, value = clause.split(mark, 1)
            return key.strip(), None, value.strip()
    return None


def clause_predicate(metadata: Column, clause: str, strict: bool = False) -> Column:
    """Predicate of one clause over a map column."""
    parsed = parse_clause(clause, strict)
    if parsed is None:
        return F.lit(True)
    key, op, wanted = parsed
    value = metadata_value(metadata, key)
    number = _number(wanted)
    is_age = key.lower() == "age"
    if op is not None:
        if number is None:
            return F.lit(False)
        held = age_upper(value) if is_age else value.try_cast("double")
        return F.coalesce(value.isNotNull() & _OPS[op](held, F.lit(number)), F.lit(False))
    if is_age and number is not None:
        return F.coalesce(value.isNotNull() & (age_upper(value) == number), F.lit(False))
    if key.lower() == "gender":
        return F.coalesce(F.lower(F.trim(value)) == wanted.lower(), F.lit(False))
    return F.coalesce(value == wanted, F.lit(False))


def metadata_predicate(metadata: Column, criteria: str | None, strict: bool = False) -> Column:
    """AND of comma-separated clauses; empty criteria hold for all rows."""
    clauses = [c.strip() for c in (criteria or "").split(",") if c.strip()]
    return reduce(lambda a, b: a & b, (clause_predicate(metadata, c, strict) for c in clauses), F.lit(True))


def filter_by_metadata(items: DataFrame, criteria: str | None, strict: bool = False) -> DataFrame:
    """Ordered distinct paths of items (ordinal, path, metadata) that meet the criteria: path, ordinal of its first item."""
    return items.where(metadata_predicate(F.coalesce("metadata", F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))), criteria, strict)).groupBy("path").agg(F.min("ordinal").alias("ordinal"))


def has_age_gender(items: DataFrame, *by: str) -> DataFrame:
    """``present``: whether any item has age or gender metadata, in one row, or one for each group ``by`` columns."""
    return items.groupBy(*by).agg(F.coalesce(F.bool_or(F.exists(F.map_keys("metadata"), lambda k: F.lower(k).isin("age", "gender"))), F.lit(False)).alias("present"))


def compose_age_gender(gender: str | None, op: str | None, age: str | None) -> str:
    """Criteria text from form fields."""
    return ", ".join([*([f"Gender:{gender}"] if gender else []), *([f"Age {op or '>='} {age}"] if age else [])])


def range_predicate(value: Column, pattern: str) -> Column:
    """``lo..hi`` inclusive, or an operator and a number; anything else holds for no value."""
    low, dots, high = pattern.partition("..")
    if dots:
        bounds = [_number(low), _number(high)]
        return F.lit(False) if None in bounds else value.between(*bounds)
    found = re.match(r"([<>]=?|==)(.*)", pattern, re.S)
    number = _number(found[2]) if found else None
    return F.lit(False) if number is None else _OPS[found[1]](value, F.lit(number))


def parse_pattern(text: str) -> tuple[str, str | float | int]:
    """("range", text), ("number", value) or ("substring", text)."""
    s = text.strip()
    if ".." in s or s.startswith((">=", "<=", ">", "<", "==")):
        return "range", s
    try:
        return "number", float(s) if "." in s else int(s)
    except ValueError:
        return "substring", s


def first_number(text: Column) -> Column:
    """The first number that a text holds."""
    return F.regexp_extract(text, _NUMBER, 0).try_cast("double")


def pattern_predicate(text: Column, pattern: str, mode: str = "substring", case_sensitive: bool = True) -> Column:
    """Whether a text meets one pattern: substring, regex, or numeric_range of its first number."""
    if mode == "numeric_range":
        return F.coalesce(range_predicate(first_number(text), pattern), F.lit(False))
    if mode == "regex":
        try:
            re.compile(pattern)
        except re.error:
            return F.lit(False)
        return text.rlike(pattern if case_sensitive else f"(?i){pattern}")
    hay, need = (text, F.lit(pattern)) if case_sensitive else (F.lower(text), F.lit(pattern.lower()))
    return F.contains(hay, need)


def output_filter(text: Column, patterns: list[str], mode: str = "substring", case_sensitive: bool = True) -> Column:
    """Whether a text meets any pattern; no patterns hold for all texts."""
    if not patterns:
        return F.lit(True)
    return F.coalesce(reduce(lambda a, b: a | b, (pattern_predicate(text, p, mode, case_sensitive) for p in patterns)), F.lit(False))


def pattern_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Non-empty trimmed lines of pattern files: pattern."""
    return lines.select(F.trim(column).alias("pattern")).where(F.col("pattern") != "")


def cached(paths: list[str] | None = None, model: str | None = None, hashes: list[str] | None = None, hashed: bool | None = None) -> Column:
    """Rows of a cache (path, model_name, content_sha256, pdq_hash) that meet every condition that is given: among paths, of a
    model, among content hashes, with or without a perceptual hash. An empty list holds for no row."""
    parts = []
    for name, values in (("path", paths), ("content_sha256", hashes)):
        if values is not None:
            parts.append(F.col(name).isin(*values) if values else F.lit(False))
    if model is not None:
        parts.append(F.col("model_name") == model)
    if hashed is not None:
        parts.append(F.col("pdq_hash") != "" if hashed else F.col("pdq_hash") == "")
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def visible_to(owner: Column, user: str | None) -> Column:
    """Rows without an owner are everybody's; without a user everything shows."""
    return F.lit(True) if user is None else owner.isNull() | (owner == user)


def request_gate(text: Column, keywords: list[str], blocked: list[str], enabled: bool = True) -> Column:
    """struct<allowed, reason> of a request: command, keyword, path, blocked pattern, or no match."""
    if not enabled:
        return F.struct(F.lit(True).alias("allowed"), F.lit("filter_disabled").alias("reason"))
    low = F.lower(F.trim(text))
    known = F.exists(F.array(*map(F.lit, keywords)), lambda k: F.contains(low, k)) if keywords else F.lit(False)
    stopped = reduce(lambda a, b: a | b, (low.rlike(p) for p in blocked), F.lit(False))
    reason = F.when(F.startswith(F.trim(text), F.lit("/")), "internal_command").when(known, "keyword_match").when(text.rlike(r"[/\\][\w\-\.]+[/\\]?"), "path_detected").when(stopped, "non_forensic").otherwise("no_match")
    return F.struct(reason.isin("internal_command", "keyword_match", "path_detected").alias("allowed"), reason.alias("reason"))


def metadata_columns(items: DataFrame, known: list[str] | None = None) -> DataFrame:
    """One column per metadata key, in sorted order. ``known`` names the keys; else the distinct ones are looked up."""
    keys = known if known is not None else [r.k for r in items.select(F.explode(F.map_keys("metadata")).alias("k")).distinct().orderBy("k").collect()]
    return items.select("path", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in sorted(keys)))


def ordered_distinct(items: DataFrame, key: str, ordinal: str) -> DataFrame:
    """The first row of every key by ordinal."""
    return items.withColumn("_rn", F.row_number().over(Window.partitionBy(key).orderBy(ordinal))).where("_rn = 1").drop("_rn")
