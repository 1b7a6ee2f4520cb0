"""Matching a stream of titles against a fixed reference table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from titleweave.config import DEFAULT, Config
from titleweave.operators.candidates import build_index
from titleweave.plans.cascade import generate_predictions
from titleweave.sources.titles import with_derived


def match_stream(titles: DataFrame, truth: DataFrame, sink: Callable[[DataFrame, int], None], model=None, config: Config = DEFAULT) -> DataStreamWriter:
    """A writer that runs the cascade on each micro-batch of titles(test_index, title) and hands the result to sink.

    The index is built once. A batch that comes again after a failure gives the same rows, so an idempotent sink makes
    the whole exactly-once.
    """
    index = build_index(truth)

    def each(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            sink(generate_predictions(with_derived(batch, config), truth, model, config, index), number)

    return titles.writeStream.foreachBatch(each)
