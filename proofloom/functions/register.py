"""SQL names for what Spark lacks, for use from ``spark.sql``."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StringType

from proofloom.functions import stems, text
from proofloom.operators.dense import vector_digest


def register(spark: SparkSession) -> None:
    """normalize_text, strip_diacritics, stem, lexical_words, cover_density and vector_digest."""

    @F.pandas_udf(ArrayType(StringType()))
    def lexical_words(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: text.words(text.normalize(t)), na_action="ignore")

    @F.pandas_udf(DoubleType())
    def cover_density(positions: pd.Series) -> pd.Series:
        return positions.map(lambda p: stems.cover_density([list(x) for x in p]), na_action="ignore")

    text.register(spark)
    for name, function in {"stem": stems.stem, "lexical_words": lexical_words, "cover_density": cover_density, "vector_digest": vector_digest}.items():
        spark.udf.register(name, function)
