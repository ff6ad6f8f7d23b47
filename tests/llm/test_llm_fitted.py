"""Where the classifiers' labelled samples go."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from searchloom.llm import labelled, toxicity


@pytest.fixture
def tables(spark):
    docs = spark.createDataFrame([(i, f"text {i % 7} of {i}" if i else None) for i in range(40)], "doc_id long, text string")
    return docs, spark.createDataFrame([(i, i % 3 == 0) for i in range(50)], "doc_id long, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))


def test_the_machine_is_fitted_in_a_task(tables, monkeypatch):
    def seen(texts, ys, share):
        return toxicity.Machine(np.array([os.getpid()]), texts, ys, share)

    monkeypatch.setattr(toxicity, "fit", seen)
    made = toxicity.train(*tables, F.col("doc_id") % 2 == 0)
    assert made.table[0] != os.getpid()
    assert (made.bias, made.slope, made.shift) == labelled.sample(*tables, "toxic", F.col("doc_id") % 2 == 0)
    assert len(made.bias) == 19 and sum(made.slope) == 6


def test_nothing_to_fit_gives_no_machine(tables):
    docs, labels = tables
    assert toxicity.train(docs.limit(0), labels, F.lit(True)) is None
    assert toxicity.train(docs, labels.where("toxic = 1"), F.lit(True)) is None
