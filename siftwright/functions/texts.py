"""Text functions that need a small parser per value: chunks, tool calls, visible text of pages."""

from __future__ import annotations

import json
import re
from bisect import bisect_left, bisect_right
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwright.functions import scalars
from siftwright.session import bounded_batches

CHUNK_SIZE, CHUNK_OVERLAP = 300, 60
SEPARATORS = ("\n\n", "\n", " ", "")


def split_recursively(text: str, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters, cut at the first separator that a text has, merged with a tail of at most
    ``overlap`` characters of the chunk before."""
    mark = next((s for s in separators if s == "" or s in text), "")
    finer = separators[separators.index(mark) + 1 :] if mark in separators else ()
    if mark == "":
        step = max(1, size - overlap)
        return [x for x in (text[k : k + size].strip() for k in range(0, max(1, len(text) - overlap), step)) if x]
    # a separator stays before the part that follows it, so that chunks are verbatim pieces of the text
    places = [0, *(m.start() for m in re.finditer(f"(?={re.escape(mark)})", text) if m.start()), len(text)]
    out: list[str] = []
    first = 0
    for k, (a, b) in enumerate(zip(places, places[1:])):
        if b - a > size:
            out += _merged(text, places[first : k + 1], size, overlap)
            out += split_recursively(text[a:b], size, overlap, finer) if finer else [text[a:b]]
            first = k + 1
    return out + _merged(text, places[first:], size, overlap)


def _merged(text: str, places: list[int], size: int, overlap: int) -> list[str]:
    """Chunks of neighbouring parts, given by where they begin and the last one ends; no part is longer than ``size``."""
    out, first, last = [], 0, len(places) - 1
    while first < last:
        end = max(first + 1, bisect_right(places, places[first] + size) - 1)
        if chunk := text[places[first] : places[end]].strip():
            out.append(chunk)
        if end == last:
            break
        # what stays is short enough to repeat, and to take the next part
        first = min(end, bisect_left(places, max(places[end] - overlap, places[end + 1] - size), first))
    return out


def chunks(size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP):
    """A pandas UDF text -> array of chunks."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: split_recursively(t or "", size, overlap))

    return cut


def chunk_table(docs: DataFrame, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP, whole: bool = False, chunkless: bool = False) -> DataFrame:
    """path, chunk_index, chunk_text of documents (path, text); ``whole`` keeps each text as one chunk, ``chunkless`` gives a
    document without chunks a row with nulls."""
    bounded_batches(docs.sparkSession)
    cut = F.filter(F.array(F.trim("text")), lambda x: x != "") if whole else chunks(size, overlap)("text")
    listed = F.posexplode_outer if chunkless else F.posexplode
    return docs.select("path", listed(cut).alias("chunk_index", "chunk_text"))


def tool_calls(text: str | None) -> list[dict[str, str]]:
    """Tool calls of a model answer: inside tool_code tags, else the whole answer as JSON, else every outer brace span."""
    if not text or not text.strip():
        return []
    found = [c for inner in re.findall(r"<tool_code>(.*?)</tool_code>", text, re.S) for c in _calls(_loads(inner.strip()))]
    found = found or _calls(_loads(text.strip()))
    return found or [c for span in brace_spans(text) for c in _calls(_loads(span))]


def _loads(text: str):
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        return None


def _calls(value) -> list[dict[str, str]]:
    if isinstance(value, list):
        return [c for x in value for c in _calls(x)]
    if isinstance(value, dict) and isinstance(value.get("calls"), list):
        return _calls(value["calls"])
    if isinstance(value, dict) and "name" in value and "arguments" in value:
        return [{"name": str(value["name"]), "arguments": json.dumps(value["arguments"], sort_keys=True)}]
    return []


def brace_spans(text: str) -> list[str]:
    """Outermost ``{...}`` spans by depth."""
    out, depth, start = [], 0, 0
    for m in re.finditer(r"[{}]", text):
        if m[0] == "{":
            start = m.start() if depth == 0 else start
            depth += 1
        elif depth:
            depth -= 1
            if depth == 0:
                out.append(text[start : m.end()])
    return out


def parse_tool_calls():
    """A pandas UDF text -> array<struct<name, arguments>> of an answer's tool calls."""

    @F.pandas_udf("array<struct<name:string,arguments:string>>")
    def parse(texts: pd.Series) -> pd.Series:
        return texts.map(tool_calls)

    return parse


# Argument names and the parameter that they stand for.
ARGUMENTS = {
    "input_directory": "input_dir",
    "input_path": "input_dir",
    "input": "input_dir",
    "path": "input_dir",
    "directory": "input_dir",
    "folder": "input_dir",
    "output_directory": "output_dir",
    "output_path": "output_dir",
    "output": "output_dir",
    "faces_directory": "directory_path",
    "face_directory": "directory_path",
    "query_path": "query_directory",
    "query": "query_directory",
    "collection": "collection_name",
    "threshold": "similarity_threshold",
    "media_directory": "input_dir",
    "videos": "input_dir",
    "crop": "facecrop",
}


# Endpoints with names of their own.
_ARCHIVES = ("ufdr_path", "file", "archive", "ufdr", "ufdr_file")
_MOUNTS = ("mount_path", "mount_point", "mount_folder", "mount_dir", "mount_name", "path")
_DIRECTORIES = {"age_gender": "image_directory", "age-gender": "image_directory", "bulk_upload": "directory_path", "findface": "query_directory"}


def _archive_name(low: Column, value: Column, new: Column) -> Column:
    is_archive = low.isin(*_ARCHIVES) | ((low == "path") & F.endswith(F.lower(value), F.lit(".ufdr")))
    return F.when(is_archive, "ufdr_file").when(low.isin(*_MOUNTS), "mount_name").otherwise(new)


def _query_name(low: Column, value: Column, new: Column) -> Column:
    return F.when(low == "query", "query").otherwise(new)


def _directory_name(target: str):
    return lambda low, value, new: F.when(new == "input_dir", target).otherwise(new)


#: Parts of endpoint names and their rules; the first that fits counts.
_OWN_NAMES = [("ufdr_mounter", _archive_name), ("text_embeddings", _query_name), ("image_embeddings", _query_name), *((part, _directory_name(target)) for part, target in _DIRECTORIES.items())]


def normalised_arguments(arguments: Column, endpoint: str = "") -> Column:
    """A map of arguments with the parameter names of an endpoint; of names that meet, the last argument counts."""
    table = F.create_map(*(F.lit(x) for kv in ARGUMENTS.items() for x in kv))

    def name(k: Column, v: Column) -> Column:
        low = F.lower(k)
        new = F.coalesce(F.try_element_at(table, low), k)
        own = next((rule for part, rule in _OWN_NAMES if part in endpoint), None)
        return new if own is None else own(low, v, new)

    pairs = F.transform(F.map_entries(arguments), lambda e: F.struct(name(e["key"], e["value"]).alias("key"), e["value"].alias("value")))
    last = F.filter(pairs, lambda p, i: ~F.exists(F.slice(pairs, i + 2, F.size(pairs)), lambda q: q["key"] == p["key"]))
    return F.map_from_entries(last)


def visible_text(html: Column) -> Column:
    """Text of a whole page, without head, scripts, styles and tags, white space folded."""
    bare = F.regexp_replace(F.regexp_replace(html, r"(?is)<(script|style|head)\b.*?</\1>", " "), r"(?s)<[^>]*>", " ")
    for mark, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(mark), F.lit(plain))
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


class _Container(HTMLParser):
    """Text of the first element of a name and class, by depth, so that elements of that name inside it count."""

    def __init__(self, element: str, name: str) -> None:
        super().__init__()
        self.element, self.name, self.depth, self.quiet, self.done, self.parts = element, name, 0, 0, False, []

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if self.done:
            return
        if self.depth:
            self.depth += tag == self.element
            self.quiet += tag in ("script", "style")
        elif tag == self.element and self.name in (dict(attrs).get("class") or "").split():
            self.depth = 1

    def handle_endtag(self, tag: str) -> None:
        if self.depth and not self.done:
            self.quiet -= tag in ("script", "style") and self.quiet > 0
            self.depth -= tag == self.element
            self.done = not self.depth

    def handle_data(self, data: str) -> None:
        if self.depth and not self.done and not self.quiet:
            self.parts.append(data)


def container_text(html: str | None, element: str = "div", name: str = "markdown-body") -> str | None:
    """Trimmed text of the first such element, None where a page has none; an element left open ends with the page."""
    page = _Container(element, name)
    page.feed(html or "")
    page.close()
    return "".join(page.parts).strip() if page.depth or page.done else None


def contained_text(element: str = "div", name: str = "markdown-body"):
    """A pandas UDF html -> text of its container, null where a page has none."""

    @F.pandas_udf("string")
    def read(pages: pd.Series) -> pd.Series:
        return pages.map(lambda x: container_text(x, element, name))

    return read


def page_links(html: Column) -> Column:
    """Link targets of a page, in order."""
    return F.regexp_extract_all(html, F.lit(r'(?i)<a\b[^>]*href="([^"]*)"'), F.lit(1))


def batch_descriptions(answers: DataFrame, files: DataFrame, answer: str = "answer", path: str = "path") -> DataFrame:
    """Descriptions of files from model answers: ``files``' columns, description.

    An answer is a JSON list, after a closing think tag and inside a code fence where there is one; its entries name a file
    (``file`` or ``filename``) and a description (``description`` or ``text``), and are matched by the file's basename. Of
    several files of a basename the last path counts, of several entries of a file the last one; answers that are no list
    give no rows.
    """
    said = scalars.after_think(F.trim(F.coalesce(answer, F.lit(""))))
    fenced = F.regexp_extract(said, r"(?s)```(?:json)?\s*(.*?)\s*```", 1)
    entries = F.from_json(F.when(fenced != "", fenced).otherwise(said), "array<struct<file:string,filename:string,description:string,text:string>>")
    filled = lambda x, one, two: F.when(F.coalesce(x[one], F.lit("")) != "", x[one]).otherwise(x[two])
    said_of = answers.select(F.monotonically_increasing_id().alias("_answer"), F.posexplode(entries).alias("_at", "e"))
    named = said_of.select(scalars.basename(filled(F.col("e"), "file", "filename")).alias("_name"), filled(F.col("e"), "description", "text").alias("description"), F.struct("_answer", "_at").alias("_order"))
    last = named.where((F.col("_name") != "") & F.col("description").isNotNull()).groupBy("_name").agg(F.max_by("description", "_order").alias("description"))
    owner = files.groupBy(scalars.basename(F.col(path)).alias("_name")).agg(F.max(path).alias(path))
    return files.join(owner, path, "left_semi").withColumn("_name", scalars.basename(F.col(path))).join(last, "_name").drop("_name")
