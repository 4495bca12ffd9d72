"""Logos from the candidates of a company: the useless ones are told apart, the others get one size."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from payscope.functions import pixels

#: Bytes of PNG data that are handed over together.
_HELD = 1 << 20


def normalised_logos(candidates: DataFrame, key: str = "id", data: str = "image") -> DataFrame:
    """(key, reason, width, height, png) for each row of ``candidates``: why its image is of no use, or its size and PNG data once it is trimmed and
    within the target size.  Images are read one at a time, and their data is handed over in pieces; a null counts as no image."""

    names, kinds = [key, "reason", "width", "height", "png"], [pa.string(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begun, held, made = 0, 0, []
            for k in range(len(batch)):
                picture = pixels.picture_of(batch.column(1)[k].as_py())
                row = (pixels.rejection(picture), None, None, None)
                if row[0] is None:
                    normal = pixels.normalised(picture)
                    row = (None, normal.shape[1], normal.shape[0], pixels.png_bytes(normal))
                    held += len(row[3])
                made.append(row)
                if held >= _HELD or k == len(batch) - 1:
                    columns = (pa.array(x, t) for x, t in zip(zip(*made, strict=True), kinds, strict=True))
                    yield pa.record_batch([batch.column(0).slice(begun, len(made)), *columns], names=names)
                    begun, held, made = k + 1, 0, []

    kind = candidates.schema[key].dataType.simpleString()
    return candidates.select(key, F.col(data).cast("binary").alias(data)).mapInArrow(run, f"`{key}` {kind}, reason string, width int, height int, png binary")


def best_logo(candidates: DataFrame, normal: DataFrame, key: str = "id", place: str = "place") -> DataFrame:
    """The first usable image of each company by its place among the candidates (``candidates``: key, company, place)."""
    usable = candidates.join(normal.where("reason IS NULL"), key)
    rest = [c for c in usable.columns if c != "company"]
    return usable.groupBy("company").agg(F.min_by(F.struct(*rest), F.struct(place, key)).alias("m")).select("company", "m.*")
