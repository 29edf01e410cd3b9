"""Mixing sources to target weights, with no source above a largest number of epochs.

Capped water-filling: every source gets its share of the words by weight; sources above their cap
(`epochs` times their words) are clamped to it and what they give up is shared again by weight
among the others, until none is above. A round is one aggregate over the sources; two sums come
to the driver.

A source's target is then taken as whole repetitions of all its documents and one fractional
repetition: in the order of a seeded hash, documents get one repetition more until the target is
reached, the last of them in part (its first words). The document where that happens is found by
descending into the hash, LEVEL hexadecimal digits at a time: sums per source and digits are
bounded in number and added up before the shuffle, so no source is ever ordered as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from freshet.durable import lookup, materialize

WEIGHTS = (3, 1, 2)
PERCENT = 150
EPOCHS = 2
SEED = "mix-1"
# Hexadecimal digits per descent, and how many descents leave one document of any real table.
LEVEL, LEVELS = 3, 3
# A text's size is the number of such words.
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sources(rows: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """key, source_size, weight: `weights` repeat over the sources by code point, null last."""
    sizes = rows.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    # One row per source is left here.
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(place, F.lit(len(weights))) + 1).cast("int"))
    return sizes.select("key", "source_size", given.alias("weight"))


def water_filled(shares: DataFrame, percent: float = PERCENT, epochs: float = EPOCHS) -> DataFrame:
    """`shares` (key, source_size, weight) with `target`, a double.

    The targets add up to `percent` of all sizes, or to all caps if these are less. Sources of
    weight 0 get nothing.
    """
    shares = materialize(shares)
    cap = F.lit(float(epochs)) * F.col("source_size")
    budget = (shares.agg(F.sum("source_size")).first()[0] or 0) * percent / 100
    level, clamped = 0.0, -1
    while True:
        full = F.col("weight") * F.lit(level) > cap
        row = shares.agg(
            F.count(F.when(full, 1)).alias("clamped"), F.sum(F.when(full, cap).otherwise(0.0)).alias("held"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
        ).first()
        if row["clamped"] == clamped or not row["free"]:
            break
        level, clamped = max(budget - row["held"], 0.0) / row["free"], row["clamped"]
    return shares.withColumn("target", F.when(F.col("weight") * F.lit(level) > cap, cap).otherwise(F.col("weight") * F.lit(level)))


def _boundary(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """`plan` with `digits`, the hash digits where a source's fractional repetition ends, and the words before."""
    found = materialize(plan.select("key", "part", F.lit("").alias("digits"), F.lit(0).cast("long").alias("before")))
    for level in range(1, LEVELS + 1):
        inside = lookup(rows.select("key", "size", "hash"), found, ["key"]).where(
            F.substring("hash", 1, LEVEL * (level - 1)) == F.col("digits")
        )
        sums = inside.groupBy("key", "part", "before", F.substring("hash", 1, LEVEL * level).alias("next")).agg(
            F.sum("size").alias("own")
        )
        # At most 16 ** LEVEL rows a source.
        order = Window.partitionBy("key").orderBy("next").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("low", F.col("before") + F.coalesce(F.sum("own").over(order), F.lit(0)))
        hit = sums.where((F.col("low") <= F.col("part")) & (F.col("part") < F.col("low") + F.col("own")))
        found = materialize(hit.select("key", "part", F.col("next").alias("digits"), F.col("low").alias("before")))
    return found


def mixed(
    docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, percent: float = PERCENT, epochs: float = EPOCHS, seed: str = SEED,
    doc_id: str = "doc_id", text: str = "text", source: str = "source", whole_text: bool = False,
) -> DataFrame:
    """doc_id, size, source_size, target, taken: one row per row of `docs`, and `text` if wanted.

    `taken` counts the words that the mix takes of the row: size for each whole repetition and for
    a fractional one, but at the one document per source where the target is reached, which
    is taken in part. A source's taken words add up to its target, rounded down. The choice depends
    on the seed and on the id and text of a row only. Null and empty texts have size 0; rows without
    source are a source of their own, the last; rows without id are documents like others; equal
    rows share what falls to them in any order. Other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), F.col(text).cast("string").alias("text")
    )
    key = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    mark = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit(""))))
    names = ["doc_id", "source", "key", "size", "hash"] + ["text"] * whole_text
    rows = materialize(
        rows.withColumn("key", key).withColumn("size", size_of(F.col("text"))).withColumn("hash", F.md5(mark)).select(*names)
    )
    plan = water_filled(sources(rows, weights), percent, epochs)
    total = F.floor("target").cast("long")
    whole = F.when(F.col("source_size") > 0, F.floor(total / F.col("source_size"))).otherwise(0).cast("long")
    plan = materialize(plan.select("key", "source_size", "target", whole.alias("whole"), (total - whole * F.col("source_size")).alias("part")))
    found = lookup(plan, _boundary(rows, plan).select("key", "digits", "before"), ["key"])
    joined = lookup(rows.drop("source"), materialize(found), ["key"])
    mine = F.substring("hash", 1, LEVEL * LEVELS)
    at_border = F.coalesce(mine == F.col("digits"), F.lit(False))
    extra = F.when(mine < F.col("digits"), F.col("size")).otherwise(0)
    # Rows that share all digits with a boundary: one, or repetitions of one.
    order = Window.partitionBy("key").orderBy("hash", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    before = F.col("before") + F.coalesce(F.sum("size").over(order), F.lit(0))
    last = F.greatest(F.lit(0), F.least(F.col("size"), F.col("part") - before))
    out = joined.where(~at_border).withColumn("extra", extra.cast("long")).unionByName(
        joined.where(at_border).withColumn("extra", last.cast("long"))
    )
    taken = (F.col("whole") * F.col("size") + F.col("extra")).alias("taken")
    return out.select("doc_id", "size", "source_size", "target", taken, *["text"] * whole_text)


def mixture(docs: DataFrame, **options) -> DataFrame:
    """doc_id, repetition (from 0), text: the mix itself, each repetition a row.

    A text taken in part is cut after its words, which keep what stands between them.
    """
    rows = mixed(docs, whole_text=True, **options).where("taken > 0")
    left = F.col("taken") - F.col("repetition") * F.col("size")
    rows = rows.withColumn("repetition", F.explode(F.expr("sequence(0L, (taken - 1) div size)")))
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.greatest(left, F.lit(0)).cast("int")), "")
    return rows.select("doc_id", "repetition", F.when(left >= F.col("size"), F.col("text")).otherwise(cut).alias("text"))
