import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F


@pytest.fixture
def documents(spark):
    """A small table with nulls, empty and odd texts, ties, repeated rows and clashing columns."""
    long = " ".join(f"word{i % 97}" for i in range(20_000))
    texts = [
        "The cat sat on the mat and looked at the bird.", "the cat sat on the mat and looked at the bird.", None, "",
        "   \n\t ", "...!!! 123", long, "Ünï cödé wörds ßind schön", "a", "x" * 5000,
    ]
    rows = [Row(doc_id=i, text=t, lang="en" if i % 2 else None, score=1.5, n=7, ids="clash") for i, t in enumerate(texts)]
    rows += [rows[0], Row(doc_id=None, text="no id at all here now", lang="de", score=None, n=None, ids=None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, n long, ids string")
    # Names that operators might use for columns of their own.
    clashes = ["_id", "id", "label", "_keep", "_n", "_found", "_personal", "_node", "_only", "frame", "slot", "hash", "key", "size"]
    return df.withColumns({name: F.lit("clash") for name in clashes}).repartition(3)


@pytest.fixture
def no_documents(documents):
    return documents.limit(0)
