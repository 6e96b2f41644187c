"""Rows with a vector column, as the vector operators take them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from thermocline.llm.common import NO_ID


def vectors_of(rows: DataFrame, most: float = float("inf")) -> DataFrame:
    """vec_id (null as NO_ID), v (array of doubles) and fit (v can be used), a row for each row; other columns go.

    A vector is used if it is not null or empty and all its entries are there, finite and below `most` in size.
    """
    v = rows["embedding"].cast("array<double>")
    good = F.forall(v, lambda c: F.coalesce(~F.isnan(c) & (F.abs(c) < most), F.lit(False)))
    return rows.select(F.coalesce(rows["vec_id"].cast("long"), F.lit(NO_ID)).alias("vec_id"), v.alias("v"),
                       (F.coalesce(good, F.lit(False)) & (F.coalesce(F.size(v), F.lit(0)) > 0)).alias("fit"))


def common_length(rows: DataFrame) -> int:
    """The length that most usable vectors have, the longer of two as frequent; 0 without any."""
    sizes = rows.where("fit").groupBy(F.size("v").alias("d")).agg(F.count("*").alias("n"))
    top = sizes.orderBy(F.desc("n"), F.desc("d")).limit(1).collect()
    return top[0].d if top else 0


def matrix(column, length: int) -> np.ndarray:
    """A list column of `length` entries a row as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)
