"""Functions for SQL: scalar functions that Spark lacks, model scores, and k-mers as a table function."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf, udtf

from strandlab.functions import mathematics
from strandlab.operators import markov
from strandlab.session import for_python


def register(spark, model: markov.Model | None = None) -> None:
    """log_gamma(x), upper_gamma(a, x), erfc(x); kmers(seq, k) as a table function (pos, kmer); with a model also
    forward_score(codes) in bits and posterior_path(codes)."""
    for_python(spark)
    mathematics.register(spark)

    @udtf(returnType="pos: int, kmer: string")
    class Kmers:
        def eval(self, seq: str, k: int) -> Iterator[tuple[int, str]]:
            for i in range(len(seq or "") - k + 1):
                yield i, seq[i : i + k]

    spark.udtf.register("kmers", Kmers)
    if model is None:
        return

    @pandas_udf("double")
    def forward_score(codes: pd.Series) -> pd.Series:
        x = [np.asarray(c, dtype=np.int64) for c in codes]
        return pd.Series((markov.forward(model, x) - markov.null_score([len(c) for c in x])) / np.log(2))

    @pandas_udf("array<int>")
    def posterior_path(codes: pd.Series) -> pd.Series:
        return codes.map(lambda c: markov.posterior_path(model, np.asarray(c, dtype=np.int64)).tolist())

    spark.udf.register("forward_score", forward_score)
    spark.udf.register("posterior_path", posterior_path)
