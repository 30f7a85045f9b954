"""User functions over batches of rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame


def score_batches(df: DataFrame, make_fn: Callable, schema) -> DataFrame:
    """Run a user function on batches: ``make_fn()`` is called once per partition and returns pandas -> pandas.

    Meant for embeddings, logits or responses of a model that is costly to set up.
    """
    def run(batches):
        fn = None
        for pdf in batches:
            if fn is None:
                fn = make_fn()
            yield fn(pdf)

    return df.mapInPandas(run, schema)
