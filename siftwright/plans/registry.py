"""Operators by name with declared inputs, and plans of several steps as composed DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Verbs of the command line and the operator that they call.
SLASH = {"/search": "text_embeddings/search", "/summarize": "text_summarization/summarize", "/transcribe": "audio/transcribe", "/images": "image_embeddings/search_images"}
HIDDEN = ("fs", "docs", "manage")


@dataclass(frozen=True)
class Parameter:
    """A parameter's type, default and bounds."""

    kind: type
    default: object = None
    low: float | None = None
    high: float | None = None
    choices: tuple = ()

    def checked(self, name: str, value):
        """The value, converted; ValueError where it doesn't fit."""
        value = self.default if value is None else value
        if value is None:
            return None
        try:
            value = self.kind(value)
        except (TypeError, ValueError) as error:
            raise ValueError(f"{name}: {value!r} is no {self.kind.__name__}") from error
        if self.choices and value not in self.choices:
            raise ValueError(f"{name}: {value!r} is none of {self.choices}")
        if self.low is not None and value < self.low or self.high is not None and value > self.high:
            raise ValueError(f"{name}: {value!r} is outside {self.low} to {self.high}")
        return value


@dataclass(frozen=True)
class Operator:
    """A function (DataFrame, parameters) -> DataFrame with the columns it needs and the parameters it takes."""

    name: str
    function: Callable[..., DataFrame]
    columns: tuple[str, ...] = ()
    parameters: dict[str, Parameter] = field(default_factory=dict)
    title: str = ""
    order: int = 10_000


class Registry:
    """Operators by name."""

    def __init__(self) -> None:
        self._operators: dict[str, Operator] = {}

    def add(self, operator: Operator) -> None:
        """Register an operator; names are unique."""
        if operator.name in self._operators:
            raise ValueError(f"{operator.name} is registered")
        self._operators[operator.name] = operator

    def remove(self, name: str) -> None:
        """Take an operator out again."""
        self._operators.pop(name, None)

    def listing(self, spark) -> DataFrame:
        """name, title, order of visible operators, in menu order."""
        rows = [(o.name, o.title, o.order) for o in self._operators.values() if o.name.split("/")[0] not in HIDDEN]
        return spark.createDataFrame(rows, "name string, title string, menu_order int").orderBy("menu_order", "name")

    def call(self, name: str, df: DataFrame, arguments: dict | None = None) -> DataFrame:
        """Apply an operator after checking its columns and arguments."""
        operator = self._operators.get(SLASH.get(name, name))
        if operator is None:
            raise ValueError(f"no operator {name!r}")
        if missing := [c for c in operator.columns if c not in df.columns]:
            raise ValueError(f"{name}: missing columns {missing}")
        given = dict(arguments or {})
        if extra := set(given) - set(operator.parameters):
            raise ValueError(f"{name}: unknown parameters {sorted(extra)}")
        return operator.function(df, **{k: p.checked(k, given.get(k)) for k, p in operator.parameters.items()})

    def run(self, plan: list[dict], df: DataFrame, keep_paths: DataFrame | None = None) -> DataFrame:
        """Steps [{name, arguments}] one after another; each gets the last one's rows. ``keep_paths`` restricts what
        enters the first step (None: no restriction)."""
        out = df if keep_paths is None else df.join(keep_paths.select("path").distinct(), "path", "left_semi")
        for step in plan:
            out = self.call(step["name"], out, step.get("arguments"))
        return out


def chained_arguments(arguments: dict, inputs: list[str], output_path: str | None) -> dict:
    """Arguments of the next step with its input (and output) folder set to what the last one wrote."""
    if not output_path:
        return arguments
    into = next((k for k in inputs if "input" in k.lower() and "dir" in k.lower()), None)
    into = into or next((k for k in arguments if "input" in k.lower() and ("dir" in k.lower() or "dataset" in k.lower())), None)
    if not into:
        return arguments
    out = next((k for k in inputs if "output" in k.lower() and "dir" in k.lower()), None)
    return arguments | {into: output_path} | ({out: output_path} if out else {})


def clamped_values(value: Column, most: int, setting: int | None = None) -> Column:
    """``clamped`` for a column: each request's number up to ``most``, without one the setting, or 1."""
    return F.when(value.isNotNull(), F.least(value, F.lit(most))).otherwise(F.coalesce(F.lit(setting), F.lit(1)))


def clamped(value: int | None, most: int, setting: str | None = None) -> int:
    """A batch size or number of workers: the value up to ``most``, else a setting's text, else 1."""
    if value is not None:
        return min(int(value), most)
    return int(setting) if setting is not None and setting.strip() else 1


# Verbs behind which a model stands, their titles and places in the menu.
MODEL_VERBS = {
    "text_summarization/summarize": ("Summarise texts", 90),
    "audio/transcribe": ("Transcribe sound", 100),
    "image_summary/summarize-images": ("Describe images", 110),
    "age-gender/predict": ("Age and gender", 120),
    "deepfake_detection/predict": ("Find forged images", 130),
}


def default_registry(models: dict | None = None) -> Registry:
    """The operators that run without model weights, and those of MODEL_VERBS for which ``models`` has a slot by that name;
    a verb without its slot isn't registered, so that a call says so."""
    from siftwright.functions import embedders, predicates, texts
    from siftwright.operators import collections, similarity

    if unknown := set(models or {}) - set(MODEL_VERBS):
        raise ValueError(f"no verbs {sorted(unknown)}")

    def find(df: DataFrame, query: list, k: int, least: float) -> DataFrame:
        return similarity.search(df, [float(x) for x in query], k, least, "path", "chunk_index")

    def find_text(df: DataFrame, query: str, k: int, least: float) -> DataFrame:
        return find(df, embedders.hash_embed([query])[0].tolist(), k, least)

    def series(df: DataFrame, query: list, query_hash: str, mode: str, k: int, least: float) -> DataFrame:
        return similarity.series_search(df, mode, [float(x) for x in query], query_hash, k, least, "path")

    def faces(df: DataFrame, k: int, least: float) -> DataFrame:
        """Rows of the gallery and of the queries, told apart by ``is_query``."""
        return similarity.batch_neighbours(df.where("is_query"), df.where("NOT is_query"), k, "path", "path", least=least)

    def upload(df: DataFrame) -> DataFrame:
        """What is stored and what is uploaded, told apart by ``is_new``."""
        return collections.upload(df.where("NOT is_new"), df.where("is_new"))

    wanted, best, match = Parameter(list, ()), Parameter(int, 5, 1), Parameter(float, 0.45, -1, 1)
    chunked, text = ("path", "chunk_index", "embedding"), {"term": Parameter(str, "")}
    registry = Registry()
    registry.add(Operator("texts/chunk", lambda df, size, overlap: texts.chunk_table(df, size, overlap), ("path", "text"), {"size": Parameter(int, 300, 1), "overlap": Parameter(int, 60, 0)}, "Cut texts", 10))
    registry.add(Operator("texts/contain", lambda df, term: df.where(F.contains(F.lower("text"), F.lit(term.lower()))), ("text",), text, "Search texts", 20))
    registry.add(Operator("metadata/filter", lambda df, criteria: df.where(predicates.metadata_predicate(F.col("metadata"), criteria)), ("metadata",), {"criteria": Parameter(str, "")}, "Filter by metadata", 30))
    registry.add(Operator("vectors/flag", lambda df, least: similarity.flag_matches(df, least), ("similarity",), {"least": match}, "Flag matches", 40))
    registry.add(Operator("text_embeddings/search", find_text, chunked, {"query": Parameter(str, ""), "k": best, "least": match}, "Search chunks", 50))
    registry.add(Operator("image_embeddings/search_images", find, chunked, {"query": wanted, "k": best, "least": match}, "Search images", 60))
    registry.add(Operator("image_series_similarity/search_series", series, ("path", "embedding", "pdq_hash"), {"query": wanted, "query_hash": Parameter(str, ""), "mode": Parameter(str, "combined", choices=("semantic", "pdq", "combined")), "k": best, "least": match}, "Search image series", 70))
    registry.add(Operator("face-match/findfacebulk", faces, ("path", "embedding", "is_query"), {"k": Parameter(int, 10, 1), "least": match}, "Find faces", 80))
    registry.add(Operator("face-match/bulkupload", upload, ("collection", "path", "embedding", "is_new"), title="Upload faces", order=81))
    registry.add(Operator("face-match/deletecollection", lambda df, name: collections.delete(df, [name]), ("collection",), {"name": Parameter(str, "")}, "Delete a collection", 82))
    for verb, slot in (models or {}).items():
        registry.add(Operator(verb, slot.apply, tuple(slot.columns), title=MODEL_VERBS[verb][0], order=MODEL_VERBS[verb][1]))
    registry.add(Operator("docs/open", lambda df, name: df.where(F.col("name") == name).select("name", "text"), ("name", "text"), {"name": Parameter(str, "")}))
    registry.add(Operator("fs/ls", lambda df: df.select("path", "name"), ("path", "name")))
    registry.add(Operator("fs/head", lambda df, n: df.orderBy("n").limit(n), ("n", "line"), {"n": Parameter(int, 10, 1)}))
    return registry
