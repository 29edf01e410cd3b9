import hashlib
import random
import re

import pytest

from freshet.llm import personal_data as personal

PLAIN = [
    ("email", re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")), ("ip", re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")),
    ("card", re.compile(r"[0-9]([\x20-]?[0-9])+")), ("phone", re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")),
]


def passes(kind, s):
    digits = re.sub("[^0-9]", "", s)
    if kind == "ip":
        return all(int(p) <= 255 for p in s.split("."))
    if kind == "card":
        doubled = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
        return 12 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in doubled) % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def base(text):
    return sorted(
        (m.start(), n, m.end(), kind) for n, (kind, pattern) in enumerate(PLAIN) for m in pattern.finditer(text or "") if passes(kind, m.group())
    )


def joined(spans):
    return ",".join(f"{k}:{a}:{b}" for a, _, b, k in spans)


@pytest.fixture(scope="module")
def detector(spark):
    return personal.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


@pytest.fixture(scope="module")
def texts():
    random.seed(4)
    parts = [
        "a", "b", "@", ".", "-", "1", "2", "9", "0", "255", "256", ".1.2.3.4", " ", "+1", "(", "é", "_", "4111111111111111",
        "+44 20 7946 0958", "x@y.z", "\U0001f600", "10.0.0.1", "(at)", "4111 1111 1111 1111", "00",
    ]
    out = ["".join(random.choice(parts) for _ in range(random.randint(0, 30))) for _ in range(1500)]
    return out + [
        "1" * 20_000, "a" * 30_000 + "@b.c", "1-" * 20_000, None, "", "a.b@" * 3000, "+1" + "(" * 20_000, "1.2.3." * 5000,
        "mail a@b.c_d@e.f now", "1.2.3.4.5.6.7.8", "é" * 100 + " x.y@z.org", "+1 (603) 555-8791", "x" * 20_000 + " 10.0.0.1",
    ]


def test_base_spans_equal_brute_force(spark, detector, texts):
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(0, texts[0], None), (None, "a@b.c", None)], "doc_id long, text string, spans string")
    rows = personal.span_report(docs.repartition(4), detector).collect()
    assert len(rows) == len(texts) + 2
    for r in rows:
        want = base("a@b.c" if r.doc_id is None else texts[r.doc_id])
        assert r.base_sha256 == hashlib.sha256(joined(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(s[1] == k for s in want) for k in range(4)]
        every = [s for s in r.spans.split(",") if s]
        assert set(filter(None, joined(want).split(","))) <= set(every)
        places = [(int(s.split(":")[1]), personal.KINDS.index(s.split(":")[0])) for s in every]
        assert places == sorted(places)


def test_trees_score_as_the_model_says(spark, detector):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    assert detector.trees and all(0.5 <= t <= 2 for t in detector.thresholds)
    from pyspark.sql import functions as F

    rows = personal.with_candidates(docs, "text", "c").select(F.explode("c").alias("c")).where("c.strict").select(
        personal.valid(F.col("c")).alias("ok"), detector.score(personal.features(F.col("c"))).alias("s")
    ).collect()
    assert rows and all(0 <= r.s <= 1 for r in rows)
    assert sum((r.s > 0.5) == r.ok for r in rows) > 0.9 * len(rows)


def test_parse_tree():
    lines = """If (feature 3 <= 0.5)
 Predict: -1.0
Else (feature 3 > 0.5)
 If (feature 0 <= 2.0)
  Predict: 0.25
 Else (feature 0 > 2.0)
  Predict: 1.0E-4""".splitlines()
    assert personal.parse_tree(lines) == (3, 0.5, -1.0, (0, 2.0, 0.25, 0.0001))


def test_added_spans_are_apart(spark):
    """A detector that accepts every candidate adds loose ones beside the base ones."""
    every = personal.Detector((5.0,), (1.0,), (0.5,) * 4)
    docs = spark.createDataFrame([
        (1, "write to jane [at] example [dot] org or a@b.c"), (2, "call (603) 555-8791 today"), (3, "nothing here"), (4, "4111 1111 1111 1112"),
    ], "doc_id long, text string")
    out = {r.doc_id: r for r in personal.span_report(docs, every).collect()}
    assert out[1].spans == "email:9:36,email:40:45" and out[1].n_email == 1
    assert out[2].spans == "phone:5:19" and out[2].n_phone == 0
    assert out[3].spans == "" and out[4].spans == "card:0:19"


def test_redaction(spark, detector):
    docs = spark.createDataFrame([(1, "mail é a@b.c, at 10.0.0.1", "x"), (2, None, "y"), (3, "", "z"), (4, "clean", None)], "doc_id long, text string, _spans string")
    out = personal.redacted(docs, detector)
    assert out.columns == docs.columns
    assert {r.doc_id: r.text for r in out.collect()} == {1: "mail é [email], at [ip]", 2: None, 3: "", 4: "clean"}


def test_nothing_to_learn_from(spark, documents, no_documents):
    empty = personal.fit(no_documents)
    assert empty.trees == ()
    assert personal.span_report(no_documents, empty).count() == 0
    rows = personal.span_report(documents, empty).collect()
    assert len(rows) == documents.count()


def test_no_python_in_the_plan(spark, detector, documents):
    plan = personal.span_report(documents, detector)._jdf.queryExecution().toString()
    assert "Python" not in plan.replace("Scan ExistingRDD", "") and "Arrow" not in plan


def test_fit_learns_from_every_candidate(spark, monkeypatch):
    """Four fifths of 30,000 candidates fit the trees: none is left out, as those beyond a sample were."""
    from pyspark.sql import functions as F

    seen = []

    class Spy(personal.GBTClassifier):
        def fit(self, df):
            seen.append(df.agg(F.sum("n")).first()[0] if "n" in df.columns else df.count())
            return super().fit(df)

    monkeypatch.setattr(personal, "GBTClassifier", Spy)
    text = F.concat(F.lit("at "), (F.col("id") % 300).cast("string"), F.lit(".1.2."), F.col("id").cast("string"))
    docs = spark.range(30_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    personal.fit(docs)
    assert 23_000 < seen[0] < 25_000


def test_plans_hold_every_feature_once(spark, monkeypatch):
    """A plan that repeats features at every node of the trees, or all patterns in a filter, fills the driver."""
    leaf = lambda k, depth: (k % 16, 0.5, leaf(k + 1, depth - 1), leaf(k + 2, depth - 1)) if depth else 0.25
    deep = personal.Detector(tuple(leaf(k, 3) for k in range(12)), (0.1,) * 12, (0.5,) * 4)
    docs = spark.createDataFrame([(1, "call (603) 555-8791 or a@b.c")], "doc_id long, text string")
    text = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert text(personal.personal_spans(docs, deep)).count("regexp_replace(") < 60

    plans = []
    monkeypatch.setattr(personal, "materialize", lambda df: plans.append(text(df)) or df)
    personal.fit(docs)
    assert plans[0].count("regexp_extract_all(") == len(personal.GENERATORS)
