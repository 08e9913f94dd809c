"""What the vector operators share: which vectors take part, and their hashes as columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from .crosspolytope import matrix, nearest_axes


def takes_part(embedding: str = "embedding") -> Column:
    """Neither null nor zero, and every component a finite number."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(embedding).isNotNull() & (F.size(embedding) > 0) & finite & F.exists(embedding, lambda x: x != 0), F.lit(False))


def by_width(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The rows of each width and their vectors."""
    sizes = np.diff(column.offsets.to_numpy())
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, matrix(column.take(pa.array(rows)), int(size))


def with_cells(df: DataFrame, tables: int, axes: int, probes: int) -> DataFrame:
    """Add ``cells``: for each table the codes of ``axes`` hashes, in all combinations of each hash's ``probes`` nearest axes."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                cells: list = [None] * batch.num_rows
                for rows, vectors in by_width(batch.column("embedding")):
                    width = 2 << max(0, vectors.shape[1] - 1).bit_length()
                    found = []
                    for table in range(tables):
                        codes = np.zeros((len(rows), 1), np.int64)
                        for axis in range(axes):
                            near = nearest_axes(vectors, 1 + table * axes + axis, probes)
                            codes = (codes[:, :, None] * width + near[:, None, :]).reshape(len(rows), -1)
                        found.append(codes)
                    for row, value in zip(rows.tolist(), np.concatenate(found, axis=1)):
                        cells[row] = value
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cells, pa.list_(pa.int64()))], [*batch.schema.names, "cells"])

    schema = StructType([*df.schema.fields, StructField("cells", ArrayType(LongType()))])
    return df.mapInArrow(hashed, schema)
