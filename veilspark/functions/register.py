"""SQL names for what the library finds: a table function over one text, and functions of columns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from veilspark.functions import align, checksums, engine


def register(spark: SparkSession) -> None:
    """pii_detect(text) as a table; pii_labels, pii_tokens, iban_valid and verhoeff_valid as functions."""

    @F.udtf(returnType="start int, `end` int, label string, confidence double, source string, rule string, value string")
    class Detect:
        def eval(self, text: str):
            yield from engine.detect(text)

    @F.pandas_udf("array<string>")
    def labels(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [s.label for s in engine.detect(t)])

    @F.pandas_udf("array<string>")
    def tokens(text: pd.Series) -> pd.Series:
        return text.map(lambda t: [x.low for x in align.tokens(t or "")])

    @F.pandas_udf("boolean")
    def iban_valid(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t is not None and checksums.iban(t))

    @F.pandas_udf("boolean")
    def verhoeff_valid(text: pd.Series) -> pd.Series:
        return text.map(lambda t: t is not None and checksums.verhoeff(t))

    spark.udtf.register("pii_detect", Detect)
    for name, f in (("pii_labels", labels), ("pii_tokens", tokens), ("iban_valid", iban_valid), ("verhoeff_valid", verhoeff_valid)):
        spark.udf.register(name, f)
