import numpy as np
import pytest
from pyspark.sql import functions as F

from freshet.llm import quality
from freshet.llm.common import remainder


def scores(machine, docs):
    return [r.s for r in docs.select("doc_id", quality.quality_score(machine, F.col("text")).alias("s")).collect()]


def test_linear_time_score_equals_all_pairs():
    random = np.random.default_rng(1)
    width = 60
    machine = quality.Machine(0.3, random.normal(size=width), random.normal(size=(width, 4)) / 4, 40, ())
    at = np.sort(random.choice(width, 12, replace=False))
    x = random.normal(size=12)
    margin = 0.3 + x @ machine.linear[at]
    for i in range(12):
        for j in range(i):
            margin += machine.factors[at[i]] @ machine.factors[at[j]] * x[i] * x[j]
    assert machine.score(at, x) == pytest.approx(1 / (1 + np.exp(-margin)))


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    held = remainder("doc_id", 5) == 0
    machine = quality.fit(docs, labels.where(~held), metadata=("n_chars",))
    rows = (
        docs.join(labels.where(held), "doc_id").select("quality", quality.quality_score(machine, F.col("text")).alias("s")).collect()
    )
    assert all(0 <= r.s <= 1 for r in rows)
    right = sum((r.s >= quality.THRESHOLD) == bool(r.quality) for r in rows)
    assert right >= 0.9 * len(rows)
    assert sum(r.s < quality.THRESHOLD for r in rows if r.quality == 1) <= 0.03 * len(rows)


def test_odd_rows_and_labels(spark, documents):
    labels = spark.createDataFrame([(0, 1), (0, 1), (1, 1), (2, 0), (3, 0), (4, None), (None, 1), (6, 1), (5, 7), (99, 0)], "doc_id long, quality int")
    machine = quality.fit(documents, labels, metadata=("n",))
    out = scores(machine, documents)
    assert len(out) == documents.count() and all(0 <= s <= 1 for s in out)
    again = quality.fit(documents.repartition(5), labels, metadata=("n",))
    assert np.allclose(machine.linear, again.linear) and np.allclose(machine.factors, again.factors)


@pytest.mark.parametrize("label, bound", [(1, (0.99, 1.0)), (0, (0.0, 0.01))])
def test_one_label_only(spark, documents, label, bound):
    machine = quality.fit(documents, spark.createDataFrame([(1, label)], "doc_id long, quality int"))
    assert all(bound[0] <= s <= bound[1] for s in scores(machine, documents))


def test_no_labels_and_no_documents(documents, no_documents, spark):
    machine = quality.fit(no_documents, spark.createDataFrame([], "doc_id long, quality int"))
    assert set(scores(machine, documents)) == {0.5}
    assert scores(machine, no_documents) == []


def test_a_bounded_sample(spark, documents):
    labels = spark.createDataFrame([(i, i % 2) for i in range(9)], "doc_id long, quality int")
    quality.fit(documents, labels, rows=4)
