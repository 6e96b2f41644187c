"""Text to unit vectors."""

from collections.abc import Iterator

import pandas as pd
from pyspark.ml.feature import HashingTF, Normalizer, RegexTokenizer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from thermocline.schema import VECTOR_DIMENSION


def prepare(chunks: DataFrame) -> DataFrame:
    """Text and the metadata record kept with each vector."""
    from thermocline.operators.chunking import with_text
    return with_text(chunks).withColumn("measurement_count", F.size("measurements"))


def encode(df: DataFrame, text_col="text", out="embedding", encoder=None,
           dimension: int = VECTOR_DIMENSION, batch_size: int = 32) -> DataFrame:
    """Add a unit-length float vector per text.

    ``encoder`` is a factory called once per Python worker; what it returns maps a list of texts to
    an (n, dimension) array. Without one, words are hashed to term counts inside the JVM.
    """
    if encoder is None:
        return _hashed(df, text_col, out, dimension)

    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import numpy as np
        model = encoder()
        for texts in batches:
            values = texts.fillna("").tolist()
            parts = [np.asarray(model(values[i:i + batch_size]), dtype=np.float64)
                     for i in range(0, len(values), batch_size)]
            vectors = np.vstack(parts) if parts else np.zeros((0, dimension))
            norms = np.linalg.norm(vectors, axis=1, keepdims=True)
            unit = np.divide(vectors, norms, out=np.zeros_like(vectors), where=norms > 0)
            yield pd.Series(list(unit.astype(np.float32)))

    return df.withColumn(out, F.pandas_udf(encoded, "array<float>")(F.col(text_col)))


def _hashed(df, text_col, out, dimension):
    words = RegexTokenizer(inputCol="__text", outputCol="__words", pattern=r"[^\p{L}\p{N}.]+")
    counts = HashingTF(inputCol="__words", outputCol="__counts", numFeatures=dimension)
    unit = Normalizer(inputCol="__counts", outputCol="__unit")
    staged = df.withColumn("__text", F.coalesce(F.col(text_col), F.lit("")))
    for stage in (words, counts, unit):
        staged = stage.transform(staged)
    return (staged.withColumn(out, vector_to_array("__unit", "float32"))
            .drop("__text", "__words", "__counts", "__unit"))
