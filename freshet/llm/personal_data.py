"""Personal data: overlapping candidate spans, boosted trees, calibrated thresholds.

Everything is DataFrame expressions: generators find candidates by pattern, with their places;
Spark ML's gradient boosted trees learn from all strict candidates, counted by their features, which formats and
contexts go with valid data, and are then written out as one expression over a text's
candidates. Valid candidates of the strict patterns always stay; others are added where their
score reaches the threshold of their kind, set for precision on the part of them that the
trees did not see.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from freshet.durable import materialize
from freshet.llm.common import give_back, unused

KINDS = ["email", "ip", "card", "phone"]
EMAIL, IP, CARD, PHONE = range(4)
# Trees of a fit, and the precision that thresholds aim at.
TREES, DEPTH = 12, 3
PRECISION = 0.99
CONTEXT = 24

# Kind, pattern, what a text must hold for it to match, whether it is strict. The strict ones give
# the leftmost matches of the plain patterns in the docstring of `personal_spans`; possessive
# runs that begin where no run is under way make them linear and free of deep recursion.
GENERATORS = [
    (EMAIL, r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "@", True),
    (IP, r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++", ".", True),
    (CARD, r"(?:\G|(?<![0-9]))(?=[0-9](?:[ -]?[0-9]){11})[0-9]++(?:[ -][0-9]++)*+", "", True),
    (PHONE, r"\+[0-9][ ().0-9-]+[0-9]", "+", True),
    (EMAIL, r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?[\[(](?:at|AT)[\])] ?[A-Za-z0-9-]{1,63}+(?: ?(?:\.|[\[(](?:dot|DOT)[\])]) ?[A-Za-z0-9-]{1,63}+)++", "", False),
    (CARD, r"(?<![0-9])[0-9]{4}([._/])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?![0-9])", "", False),
    (PHONE, r"(?<![0-9+.-])(?:00[ -]?[1-9][0-9]{0,2}[ -]?)?\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}(?![0-9.-])", "", False),
]

FEATURES = [
    "kind", "digits", "length", "digit_share", "dots", "groups", "plus", "parentheses", "last_label", "checksum",
    "largest_part", "word_before", "digit_before", "letter_after", "named_before", "space_before",
]
# Words shortly before a span that speak for personal data.
_NAMED = r"(?i)(?:e-?mail|mail|phone|call|tel|mobile|fax|contact|card|visa|master|account|ip|host|address|server)[^\n]{0,12}$"


def _matches(text: Column) -> list[tuple[int, bool, str, Column]]:
    """Kind, strictness, pattern and matched texts of every generator."""
    every = []
    for kind, pattern, needs, strict in GENERATORS:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        holds = text.contains(needs) if needs else text.rlike("[0-9]" if kind != EMAIL else r"[\[(](?:at|AT)[\])]")
        every.append((kind, strict, pattern, F.when(holds, found)))
    return every


def _placed(matches: Column, pieces: Column, kind: int, strict: bool) -> Column:
    """Spans of one generator, from its matches and the pieces of text between them."""
    parts = F.transform(matches, lambda s, i: F.struct(
        s.alias("s"), F.length(F.get(pieces, i)).alias("gap"), F.length(s).alias("size"),
        F.substring(F.get(pieces, i), -CONTEXT, CONTEXT).alias("before"), F.substring(F.get(pieces, i + 1), 1, 1).alias("after"),
    ))
    empty = F.expr("cast(array() AS array<struct<kind: int, s: string, start: int, end: int, strict: boolean, before: string, after: string>>)")
    step = lambda acc, x: F.struct(
        (acc["at"] + x["gap"] + x["size"]).alias("at"),
        F.concat(acc["out"], F.array(F.struct(
            F.lit(kind).alias("kind"), x["s"].alias("s"), (acc["at"] + x["gap"]).alias("start"),
            (acc["at"] + x["gap"] + x["size"]).alias("end"), F.lit(strict).alias("strict"),
            x["before"].alias("before"), x["after"].alias("after"),
        ))).alias("out"),
    )
    return F.aggregate(parts, F.struct(F.lit(0).alias("at"), empty.alias("out")), step, lambda acc: acc["out"])


def with_candidates(docs: DataFrame, text: str, name: str) -> DataFrame:
    """`docs` with an array of all candidate spans; null text has none.

    A text without matches is searched once per generator; places are worked out only for the rest.
    """
    value = F.coalesce(F.col(text).cast("string"), F.lit(""))
    every = _matches(value)
    names = [unused(docs, f"_{name}_m{i}") for i in range(len(every))]
    found = docs.withColumns({n: m for n, (_, _, _, m) in zip(names, every)})
    spans = []
    for n, (kind, strict, pattern, _) in zip(names, every):
        placed = _placed(F.col(n), F.split(value, pattern, -1), kind, strict)
        spans.append(F.when(F.size(n) > 0, placed).otherwise(F.expr(
            "cast(array() AS array<struct<kind: int, s: string, start: int, end: int, strict: boolean, before: string, after: string>>)"
        )))
    return found.withColumn(name, F.concat(*spans)).drop(*names)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def luhn(s: Column) -> Column:
    """Whether 12 to 19 digits pass the Luhn check."""
    digits = _digits(s)
    number = F.length(digits)
    total = F.aggregate(F.sequence(F.lit(1), number), F.lit(0), lambda acc, i: acc + _luhn_term(digits, number, i))
    return F.when(number.between(12, 19), total % 10 == 0).otherwise(False)


def _luhn_term(digits: Column, number: Column, i: Column) -> Column:
    digit = digits.substr(i, F.lit(1)).cast("int")
    doubled = digit * 2
    return F.when((number - i) % 2 == 0, digit).when(doubled > 9, doubled - 9).otherwise(doubled)


def small_parts(s: Column) -> Column:
    """Whether all four parts of an address are at most 255, leading zeros aside."""
    part = "0*+(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9]?)"
    return s.rlike(f"^{part}\\.{part}\\.{part}\\.{part}$")


def valid(c: Column) -> Column:
    """Whether a candidate is one of the plain patterns' spans."""
    digits = F.length(_digits(c["s"]))
    return c["strict"] & (
        F.when(c["kind"] == EMAIL, True).when(c["kind"] == IP, small_parts(c["s"]))
        .when(c["kind"] == CARD, luhn(c["s"])).otherwise(digits.between(9, 15))
    )


def _normal(c: Column) -> Column:
    """A loose candidate in the strict patterns' form, so that its features are like theirs."""
    s = c["s"]
    address = F.regexp_replace(F.regexp_replace(s, r" ?[\[(](?:at|AT)[\])] ?", "@"), r" ?[\[(](?:dot|DOT)[\])] ?", ".")
    number = F.concat(F.lit("+"), F.regexp_replace(s, "^00", ""))
    return (
        F.when(c["strict"], s).when(c["kind"] == EMAIL, address)
        .when(c["kind"] == CARD, F.regexp_replace(s, "[._/]", " ")).otherwise(number)
    )


def features(c: Column, s: Column | None = None) -> Column:
    """Format and context of a candidate, as a struct of doubles.

    `s` is its text in the strict patterns' form, if that is a column already: most features read it.
    """
    s = _normal(c) if s is None else s
    number, size = F.length(_digits(s)), F.length(s)
    parts = F.transform(F.slice(F.split(s, "[^0-9]+"), 1, 12), lambda p: F.length(F.regexp_replace(p, "^0+", "")))
    values = {
        "kind": c["kind"], "digits": F.least(number, F.lit(40)), "length": F.least(size, F.lit(120)), "digit_share": number / size,
        "dots": F.least(size - F.length(F.regexp_replace(s, r"\.", "")), F.lit(10)),
        "groups": F.least(F.size(F.split(s, "[^0-9]+")), F.lit(12)), "plus": s.startswith("+").cast("int"),
        "parentheses": s.contains("(").cast("int"), "last_label": F.least(F.length(F.regexp_extract(s, r"\.([A-Za-z]+)$", 1)), F.lit(12)),
        "checksum": F.when(c["kind"] == CARD, luhn(s)).when(c["kind"] == IP, small_parts(s)).otherwise(True).cast("int"),
        "largest_part": F.least(F.coalesce(F.array_max(parts), F.lit(0)), F.lit(20)),
        "word_before": c["before"].rlike("[A-Za-z]$").cast("int"), "digit_before": c["before"].rlike("[0-9.+-]$").cast("int"),
        "letter_after": c["after"].rlike("[A-Za-z0-9]").cast("int"), "named_before": c["before"].rlike(_NAMED).cast("int"),
        "space_before": c["before"].rlike(r"(?:^|\s)$").cast("int"),
    }
    return F.struct(*[F.coalesce(values[n].cast("double"), F.lit(0.0)).alias(n) for n in FEATURES])


@dataclass(frozen=True)
class Detector:
    """Trees as nested (feature, threshold, left, right) or values, their weights, thresholds per kind."""

    trees: tuple
    weights: tuple[float, ...]
    thresholds: tuple[float, ...]

    def score(self, f: Column | dict[str, Column]) -> Column:
        """Probability that a candidate with these features is valid.

        `f` is read at every node of a tree, so it should be a struct that is there already, or columns by name.
        """
        margin = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            margin = margin + F.lit(weight) * _tree(tree, f)
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node, f: Column | dict[str, Column]) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    feature, threshold, left, right = node
    return F.when(f[FEATURES[feature]] <= threshold, _tree(left, f)).otherwise(_tree(right, f))


def parse_tree(lines: list[str]):
    """A tree from the lines of a model's description; consumes them."""
    line = lines.pop(0).strip()
    if value := re.match(r"Predict: (\S+)", line):
        return float(value[1])
    split = re.match(r"If \(feature (\d+) <= (\S+)\)", line)
    left = parse_tree(lines)
    lines.pop(0)
    return int(split[1]), float(split[2]), left, parse_tree(lines)


def fit(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 3) -> Detector:
    """Learn from all candidates of the strict patterns, counted by their features.

    Whether a candidate is valid labels it. Four fifths, chosen by a hash of the candidate, so that
    copies are chosen together, fit the trees; the last fifth sets the thresholds:
    per kind the lowest of a hundred at which precision is PRECISION or more, or above 1 if none is.
    Without candidates of both labels the base spans alone remain.
    """
    # Outer, as Spark otherwise puts a filter before it that finds all candidates once more, to see if there are any.
    found = with_candidates(docs.select(F.col(text).alias("text")), "text", "_c").select(F.explode_outer("_c").alias("c")).where("c.strict")
    place = F.pmod(F.xxhash64("c.s", "c.before", F.lit(seed)), F.lit(1 << 30))
    found = found.select((place % 5 == 0).alias("held"), valid(F.col("c")).cast("int").alias("label"), features(F.col("c"), F.col("c.s")).alias("f"))
    # Features are clipped counts and flags: there are few combinations, however many candidates.
    counted = found.groupBy("held", "label", *[F.col(f"f.{n}").alias(n) for n in FEATURES]).agg(F.count(F.lit(1)).cast("double").alias("n"))
    counted = materialize(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(counted))
    learnt, unseen = counted.where("NOT held"), counted.where("held")
    if learnt.select("label").distinct().count() < 2:
        return Detector((), (), (2.0,) * len(KINDS))
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.3, seed=seed, maxBins=32, weightCol="n").fit(learnt.coalesce(4))
    trees = tuple(parse_tree([x for x in t.toDebugString.splitlines()[1:] if x.strip()]) for t in model.trees)
    detector = Detector(trees, tuple(model.treeWeights), ())
    del model
    give_back(docs.sparkSession)
    scored = unseen.select("kind", "label", "n", F.floor(100 * detector.score({n: F.col(n) for n in FEATURES})).cast("int").alias("bin"))
    counts = scored.groupBy("kind", "bin").agg(
        F.sum(F.col("label") * F.col("n")).alias("good"), F.sum("n").alias("n")).collect()
    thresholds = []
    for kind in range(len(KINDS)):
        own = sorted(((r["bin"], r["good"], r["n"]) for r in counts if r["kind"] == kind), reverse=True)
        good = n = 0
        best = 2.0
        for place, right, number in own:
            good, n = good + right, n + number
            if good / n >= PRECISION:
                best = max(place / 100, 0.5)
        thresholds.append(best)
    return Detector(trees, detector.weights, tuple(thresholds))


def personal_spans(docs: DataFrame, detector: Detector, text: str = "text", name: str = "spans") -> DataFrame:
    """`docs` with an array of struct(start, kind, end, base), ordered by start, kind and end.

    Places count code points, ends are exclusive. Base spans are the leftmost non-overlapping
    matches of each plain pattern that pass its check, and all stay:
    email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+; ip four runs of digits joined by
    dots, at most 255; card digits with single spaces or hyphens between, 12 to 19 that pass
    Luhn; phone a plus and 9 to 15 digits with spaces, dots, hyphens and parentheses between.
    Added spans overlap no base span, and of overlapping ones the best scored is kept. Null and
    empty texts have none. Other columns stay; one called `name` is replaced. Nothing is shuffled.
    """
    cand, base, more = (unused(docs, f"_{name}_{part}") for part in "cba")
    found = with_candidates(docs, text, cand)
    found = found.withColumn(cand, F.transform(cand, lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), valid(c).alias("base"), c.alias("c"),
    )))
    found = found.withColumn(base, F.filter(cand, lambda c: c["base"]))
    overlaps = lambda a, b: (a["start"] < b["end"]) & (b["start"] < a["end"])
    if detector.trees:
        table = F.array(*[F.lit(float(t)) for t in detector.thresholds])
        rest = F.filter(cand, lambda c: ~c["base"] & ~F.exists(base, lambda b: overlaps(b, c)))
        # Trees read fields of a finished struct, and its features a finished text: their expressions
        # stand in the plan once, not at every node.
        normal = F.transform(rest, lambda c: F.struct(c.alias("c"), _normal(c["c"]).alias("s")))
        valued = F.transform(normal, lambda x: F.struct(
            *[x["c"][name].alias(name) for name in ("start", "kind", "end", "base")], features(x["c"]["c"], x["s"]).alias("f"),
        ))
        scored = F.transform(valued, lambda c: F.struct(
            c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"), c["base"].alias("base"),
            detector.score(c["f"]).alias("score"),
        ))
        found = found.withColumn(more, F.filter(scored, lambda c: c["score"] >= F.get(table, c["kind"])))
        better = lambda a, b: (a["score"] > b["score"]) | ((a["score"] == b["score"]) & (
            F.struct(a["start"], a["kind"], a["end"]) < F.struct(b["start"], b["kind"], b["end"])))
        added = F.filter(more, lambda c: ~F.exists(more, lambda o: overlaps(o, c) & better(o, c)))
    else:
        found, added = found.withColumn(more, F.lit(None)), F.filter(cand, lambda c: F.lit(False))
    plain = lambda spans: F.transform(spans, lambda c: F.struct(
        c["start"].cast("long").alias("start"), c["kind"].alias("kind"), c["end"].cast("long").alias("end"), c["base"].alias("base")))
    return found.withColumn(name, F.array_sort(F.concat(plain(F.col(base)), plain(added)))).drop(cand, base, more)


def span_text(spans: Column) -> Column:
    """kind:start:end of ordered spans, joined by commas."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda c: F.concat_ws(
        ":", F.get(names, c["kind"]), c["start"].cast("string"), c["end"].cast("string"))), ",")


def span_report(docs: DataFrame, detector: Detector, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, base spans per kind, SHA-256 of the base spans' text, and all spans' text."""
    found = personal_spans(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), detector, "text", "found")
    found = found.select("doc_id", "found", F.filter("found", lambda c: c["base"]).alias("base"))
    count = lambda kind: F.size(F.filter("base", lambda c: c["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[count(k).alias(f"n_{n}") for k, n in enumerate(KINDS)],
        F.sha2(span_text(F.col("base")), 256).alias("base_sha256"), span_text(F.col("found")).alias("spans"),
    )


def redacted(docs: DataFrame, detector: Detector, text: str = "text") -> DataFrame:
    """`docs` with every span of personal data replaced by its kind in brackets; null stays null.

    Overlapping spans become one replacement, named by the first.
    """
    names = F.array(*[F.lit(f"[{k}]") for k in KINDS])
    value, spans = F.col(text), unused(docs, "_personal")

    def step(acc: Column, c: Column) -> Column:
        fresh = c["start"] >= acc["at"]
        kept = F.concat(acc["out"], value.substr((acc["at"] + 1).cast("int"), (c["start"] - acc["at"]).cast("int")), F.get(names, c["kind"]))
        return F.struct(F.greatest(acc["at"], c["end"]).alias("at"), F.when(fresh, kept).otherwise(acc["out"]).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rebuilt = F.aggregate(spans, start, step, lambda acc: F.concat(
        acc["out"], value.substr((acc["at"] + 1).cast("int"), F.length(value))))
    found = personal_spans(docs, detector, text, spans)
    return found.withColumn(text, F.when(F.size(spans) > 0, rebuilt).otherwise(value)).drop(spans)
