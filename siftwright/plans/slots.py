"""Slots for models: a function over Arrow batches with declared input and output columns.

Detectors, transcribers, summarisers and other models need weights that aren't here; a slot is where one goes. It keeps
the input's columns, adds the model's, and checks both when it is applied and for every batch. ``Slot`` gives a row for each
row; ``face_table`` is a table function that gives none, one or many faces for an image, and whose columns depend on the
attributes that are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult

from siftwright.session import bounded_batches


@dataclass(frozen=True)
class Slot:
    """A model: what it adds (DDL), and a function from the lists of its input columns to the lists of the added ones."""

    name: str
    adds: str
    function: Callable[[dict[str, list]], dict[str, list]]
    columns: tuple[str, ...]

    def apply(self, rows: DataFrame) -> DataFrame:
        """``rows`` with the model's columns; ValueError where columns are missing or would clash."""
        added = T.StructType.fromDDL(self.adds)
        if missing := [c for c in self.columns if c not in rows.columns]:
            raise ValueError(f"{self.name}: missing columns {missing}")
        if clash := [c for c in added.names if c in rows.columns]:
            raise ValueError(f"{self.name}: columns {clash} are there already")
        bounded_batches(rows.sparkSession)
        kinds, function, name, inputs = to_arrow_schema(added), self.function, self.name, self.columns

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = function({c: batch.column(c).to_pylist() for c in inputs})
                if sorted(found) != sorted(kinds.names) or any(len(x) != batch.num_rows for x in found.values()):
                    raise ValueError(f"{name}: a batch of {batch.num_rows} rows gave {sorted((k, len(x)) for k, x in found.items())}")
                yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(found[f.name], f.type) for f in kinds)], names=[*batch.schema.names, *kinds.names])

        return rows.mapInArrow(run, T.StructType([*rows.schema.fields, *added.fields]))


#: Faces below this probability don't count, and of faces that overlap more than that the best one does.
LEAST_SCORE = 0.7
OVERLAP = 0.45
HEIGHT_FACTOR = 1.25
_CELL = {"cx", "cy", "w", "h", "score"}
_FRAME = {"scale", "pad_w", "pad_h", "width", "height"}


def decoded_faces(cells: list, frame) -> list[tuple[list[int], float]]:
    """(box, score) of the faces in a detector's output, best first (ties by the order of the cells).

    Cells have centres and sizes in a letterboxed picture; boxes are undone from it, clipped, thinned out where they overlap,
    and squared around their centre by a factor of their height. Cells that are null or hold nulls or NaN don't count.
    """
    told = [c for c in cells or [] if c is not None and all(c[k] is not None and math.isfinite(c[k]) for k in _CELL)]
    if not told or frame is None or not frame["scale"]:
        return []
    clip = lambda x, most: min(max(x, 0.0), most)
    side = lambda c, centre, size, pad, most: [clip((float(c[centre]) + sign * float(c[size]) / 2 - frame[pad]) / frame["scale"], frame[most]) for sign in (-1, 1)]
    left = []
    for c in sorted((c for c in told if c["score"] > LEAST_SCORE), key=lambda c: -c["score"]):  # arrays cost more than they save on few cells
        (x1, x2), (y1, y2) = side(c, "cx", "w", "pad_w", "width"), side(c, "cy", "h", "pad_h", "height")
        left.append((x1, y1, x2, y2, (x2 - x1) * (y2 - y1), float(c["score"])))
    faces = []
    while left:
        x1, y1, x2, y2, area, score = left[0]
        common = [max(0.0, min(x2, o[2]) - max(x1, o[0])) * max(0.0, min(y2, o[3]) - max(y1, o[1])) for o in left[1:]]
        left = [o for o, both in zip(left[1:], common) if both <= OVERLAP * (area + o[4] - both)]
        half, cx, cy = (y2 - y1) * HEIGHT_FACTOR / 2, (x1 + x2) / 2, (y1 + y2) / 2
        box = [clip(cx - half, frame["width"]), clip(cy - half, frame["height"]), clip(cx + half, frame["width"]), clip(cy + half, frame["height"])]
        faces.append(([int(x) for x in box], score))
    return faces


def face_table(models: dict[str, tuple[str, Callable]] | None = None):
    """A table function ``faces(cells, frame, attributes, keep_empty)`` for lateral joins: a row for every face of an image.

    ``cells`` is an array of (cx, cy, w, h, score) and ``frame`` a struct of (scale, pad_w, pad_h, width, height).
    ``attributes``, a constant, names the models whose columns are wanted, comma-joined; ``models`` has the type and a function
    of (box, frame) of each. Columns are face_idx, box (x1, y1, x2, y2), score and one an attribute; an image without a face
    gives no row, or one of nulls where the last argument is true.
    """
    known = {name: (T.StructType.fromDDL(f"{name} {kind}")[0].dataType, function) for name, (kind, function) in (models or {}).items()}

    class Faces:
        @staticmethod
        def analyze(cells: AnalyzeArgument, frame: AnalyzeArgument, attributes: AnalyzeArgument, keep_empty: AnalyzeArgument | None = None) -> AnalyzeResult:
            if not isinstance(cells.dataType, T.ArrayType) or not isinstance(cells.dataType.elementType, T.StructType) or _CELL - set(cells.dataType.elementType.names):
                raise ValueError(f"cells must be an array of structs of {sorted(_CELL)}")
            if not isinstance(frame.dataType, T.StructType) or _FRAME - set(frame.dataType.names):
                raise ValueError(f"frame must be a struct of {sorted(_FRAME)}")
            if not attributes.isConstantExpression:
                raise ValueError("attributes must be constant, as the columns depend on them")
            schema = T.StructType().add("face_idx", T.IntegerType()).add("box", T.ArrayType(T.IntegerType())).add("score", T.DoubleType())
            for name in filter(None, (attributes.value or "").split(",")):
                if name not in known:
                    raise ValueError(f"no model for {name!r}; there are {sorted(known)}")
                schema = schema.add(name, known[name][0])
            return AnalyzeResult(schema)

        def eval(self, cells, frame, attributes, keep_empty=False):
            wanted = list(filter(None, (attributes or "").split(",")))
            found = decoded_faces(cells, frame)
            for i, (box, score) in enumerate(found):
                yield (i, box, score, *(known[name][1](box, frame) for name in wanted))
            if keep_empty and not found:
                yield (None,) * (3 + len(wanted))

    return F.udtf(Faces)


def faces_of(images: DataFrame, table, attributes: str = "", cells: str = "cells", frame: str = "frame", keep_empty: bool = False) -> DataFrame:
    """``images`` joined with their faces; images without one go, or stay with nulls where ``keep_empty``."""
    # not a left join: Spark would make the cells distinct, and join their faces back by them
    return images.lateralJoin(table(F.col(cells).outer(), F.col(frame).outer(), F.lit(attributes), F.lit(keep_empty)))
