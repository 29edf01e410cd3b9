from time import sleep

import pytest

from freshet.llm import ngram_join, personal_data

ROWS = [(i, f"mail a{i}@b.example, ip 10.0.{i}.{200 + 10 * i}, see the cat number {i}") for i in range(24)]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, text string")


STEPS = {
    "near copies": lambda s: ngram_join.links(docs(s)),
    "personal data": lambda s: personal_data.fit(docs(s)),
}


@pytest.mark.parametrize("step", STEPS)
def test_leftovers_in_the_driver_are_freed(spark, step):
    jvm = spark._jvm
    block = jvm.java.nio.ByteBuffer.allocate(1 << 20)
    left = jvm.java.lang.ref.WeakReference(block)
    jvm.System.gc()  # an old block stays until all of the heap is collected
    del block
    sleep(2)  # Python lets go of it in the background
    STEPS[step](spark)
    assert left.get() is None
