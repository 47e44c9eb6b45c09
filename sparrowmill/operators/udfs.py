"""Arrow UDFs around the row helpers."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparrowmill.functions import kernels, markup

def fields(names: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, kind) for n in names.split()])


METRICS = fields("bleu rouge1 rouge2 rougel", T.DoubleType())


@F.pandas_udf(METRICS)
def text_metrics(hypothesis: pd.Series, reference: pd.Series) -> pd.DataFrame:
    rows = [(kernels.bleu4(h, r), kernels.rouge_n(h, r, 1), kernels.rouge_n(h, r, 2), kernels.rouge_l(h, r)) for h, r in zip(hypothesis.fillna(""), reference.fillna(""), strict=True)]
    return pd.DataFrame(rows, columns=["bleu", "rouge1", "rouge2", "rougel"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def element_lines(texts: pd.Series) -> pd.Series:
    return texts.map(markup.element_lines)
