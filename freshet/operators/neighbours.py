"""Exact k nearest neighbours and distance-weighted regression.

Reference vectors are assigned to the nearest of a few pivots; a cell is the set
of vectors of one pivot. By the triangle inequality a cell further from a query
than its k-th best bound holds no neighbour. Queries are cut into chunks of bounded
size, of cells that lie side by side. A task holds one chunk; the references of the
cells that can matter to it stream past, nearest cells first, and it keeps k rows
per query: no pair and no interim result is shuffled.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from freshet.durable import materialize

c = F.col
# Queries of a chunk: more for more of them, as the references pass every chunk that wants them.
BLOCK_ROWS, MOST_ROWS = 4096, 32768
# Chunks that keep a cluster busy; beyond them chunks grow first.
CHUNKS = 24
# Queries that are routed at once, and queries whose distances a task holds.
ROUTED_ROWS, SEARCHED_ROWS = 4096, 256
# Pairs whose exact distances are worked out at once.
PAIRS = 16384
# Pivots per root of the number of chunks, and references that a pivot should have.
PIVOTS_PER_ROOT, CELL_ROWS = 16, 2048


def block_math():
    """Array helpers as local functions, so that tasks get them by value."""

    def matrix(column) -> np.ndarray:
        """Vectors of a column as rows; a missing number is not a number."""
        flat = column.flatten().to_numpy(zero_copy_only=False)
        return flat.astype(np.float64).reshape(len(column), -1)

    def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Euclidean distances of every row of a to every row of the shorter b."""
        out = np.empty((len(a), len(b)))
        for i in range(len(b)):
            diff = a - b[i]
            out[:, i] = np.sqrt(np.einsum("ij,ij->i", diff, diff))
        return out

    return matrix, distances


def pick_pivots(vectors: DataFrame, key: str, vector: str, count: int) -> np.ndarray:
    """A few vectors chosen by the hash of their key."""
    known = vectors.where(c(vector).isNotNull())
    rows = known.orderBy(F.xxhash64(key), key).limit(count).select(vector).collect()
    return np.array([r[0] for r in rows], dtype=np.float64)


def assign_cells(refs: DataFrame, vector: str, pivots: np.ndarray) -> DataFrame:
    """Adds the nearest pivot and the distance to it; vectors without a distance are left out."""
    matrix, distances = block_math()

    def assign(batches):
        for batch in batches:
            x = matrix(batch.column(vector))
            kept = np.isfinite(x).all(axis=1)
            d = distances(x[kept], pivots)
            cells, radius = d.argmin(axis=1).astype("int32"), d.min(axis=1)
            whole = batch.filter(pa.array(kept))
            yield pa.RecordBatch.from_arrays(
                [*whole.columns, pa.array(cells), pa.array(radius)], names=[*whole.schema.names, "cell", "radius"]
            )

    fields = ", ".join(f"{name} {kind}" for name, kind in refs.dtypes)
    return refs.mapInArrow(assign, f"{fields}, cell int, radius double")


def side_by_side(centres: np.ndarray) -> list[int]:
    """An order of the pivots in which each is followed by the nearest one that is left."""
    left, order = list(range(1, len(centres))), [0]
    while left:
        away = np.linalg.norm(centres[left] - centres[order[-1]], axis=1)
        order.append(left.pop(int(away.argmin())))
    return order


def nearest(
    queries: DataFrame, refs: DataFrame, key: str, vector: str, k: int, group: str | None = None,
    block_rows: int | None = None, pivots: int | None = None,
) -> DataFrame:
    """(key, ref_key, distance, position): the k nearest references of every query.

    With `group`, references of the query's own group are left out (as the fold of
    a validation row is when a neighbour model is cross-validated).
    """
    matrix, distances = block_math()
    kinds = {dict(df.dtypes)[vector] for df in (queries, refs)}
    numbers = "array<float>" if kinds == {"array<float>"} else "array<double>"
    # A missing group equals no other.
    side = lambda df, none: df.where(c(vector).isNotNull()).select(
        c(key).alias("_id"), c(vector).cast(numbers).alias("_v"),
        F.coalesce((c(group) if group else F.lit(none)).cast("bigint"), F.lit(none)).cast("bigint").alias("_g"),
    )
    own_refs = side(refs, -2)
    id_kind = dict(own_refs.dtypes)["_id"]
    id_type = to_arrow_type(own_refs.schema["_id"].dataType)
    number = refs.count()
    block_rows = block_rows or min(MOST_ROWS, max(BLOCK_ROWS, math.ceil(queries.count() / CHUNKS)))
    pivots = pivots or max(1, min(number // CELL_ROWS, int(PIVOTS_PER_ROOT * math.sqrt(max(1, number // block_rows)))))
    centres = pick_pivots(refs, key, vector, pivots)
    centres = centres[np.isfinite(centres).all(axis=1)] if len(centres) else centres
    if not len(centres):
        return queries.select(c(key), c(key).alias("ref_key"), F.lit(0.0).alias("distance"), F.lit(1).alias("position")).limit(0)
    centres = centres[side_by_side(centres)]
    cells = materialize(assign_cells(own_refs, "_v", centres))
    asked = materialize(assign_cells(side(queries, -1), "_v", centres))
    # One row per cell and group; there are at most `pivots` cells.
    sizes = cells.groupBy("cell", "_g").agg(F.count(F.lit(1)).alias("n"), F.max("radius").alias("r")).toPandas()
    labels = np.sort(sizes["cell"].unique())
    radius = sizes.groupby("cell")["r"].max().reindex(labels).to_numpy(float)
    total = sizes.groupby("cell")["n"].sum().reindex(labels).to_numpy(int)
    centre = centres[labels]
    exclude = group is not None
    groups = np.sort(sizes["_g"].unique()) if exclude else np.array([0])
    counts = np.zeros((len(groups) + 1, len(labels)), int)  # the last row: a group without references
    if exclude:
        counts[np.searchsorted(groups, sizes["_g"]), np.searchsorted(labels, sizes["cell"])] = sizes["n"]

    def bounds(d: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From distances to the cells' pivots: how far the k-th neighbour can be, and which cells have any to offer."""
        row = np.minimum(np.searchsorted(groups, g), len(groups) - 1)
        usable = total - counts[np.where(groups[row] == g, row, len(groups))]
        far = d + radius
        order = np.argsort(far, axis=1)
        some = np.cumsum(np.take_along_axis(usable, order, 1), axis=1)
        enough = np.minimum((some < k).sum(axis=1), len(labels) - 1)
        last = np.take_along_axis(order, enough[:, None], 1)
        return np.take_along_axis(far, last, 1)[:, 0], usable > 0

    def within(bound: np.ndarray) -> np.ndarray:
        return bound * (1 + 1e-9) + 1e-9

    def route(batches):
        """The cells that some query of a chunk may have neighbours in, and how near they come."""
        for batch in batches:
            x, g, chunk = matrix(batch.column("_v")), batch.column("_g").to_numpy(), batch.column("chunk").to_numpy()
            for at in range(0, len(x), ROUTED_ROWS):
                d = distances(x[at:at + ROUTED_ROWS], centre)
                bound, usable = bounds(d, g[at:at + ROUTED_ROWS])
                lower = np.where((d - radius <= within(bound)[:, None]) & usable, d - radius, np.inf)
                here = chunk[at:at + ROUTED_ROWS]
                for one in np.unique(here):
                    least = lower[here == one].min(axis=0)
                    some = np.isfinite(least)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(some.sum(), one, "int32")), pa.array(labels[some].astype("int32")), pa.array(least[some]),
                    ], names=["chunk", "cell", "lower"])

    homes = {r["cell"]: r["count"] for r in asked.groupBy("cell").count().collect()}
    places, before = [], 0
    for cell, n in sorted(homes.items()):
        places += [F.lit(cell), F.struct(F.lit(before).alias("start"), F.lit(n).alias("n"))]
        before += n
    if not homes:
        return queries.select(c(key), c(key).alias("ref_key"), F.lit(0.0).alias("distance"), F.lit(1).alias("position")).limit(0)
    chunks = math.ceil(before / block_rows)
    home = F.create_map(*places)[c("cell")]
    asked = asked.withColumn("chunk", F.floor((home["start"] + F.pmod(F.xxhash64("_id", "radius"), home["n"])) / block_rows).cast("int"))
    wanted = materialize(asked.mapInArrow(route, "chunk int, cell int, lower double").groupBy("chunk", "cell").agg(F.min("lower").alias("lower")))
    parts = ["_id", "_v", "_g"]
    stream = asked.select("chunk", F.lit(False).alias("ref"), F.lit(0.0).alias("lower"), F.lit(-1).alias("cell"), *parts).unionByName(
        cells.join(F.broadcast(wanted), "cell").select("chunk", F.lit(True).alias("ref"), "lower", "cell", *parts)
    )
    whole = pa.types.is_integer(id_type)
    least = np.iinfo(np.int64).min

    def names(column) -> np.ndarray:
        """Keys as numbers or objects that sort as in SQL: a missing one first."""
        if whole:
            return column.cast(pa.int64()).fill_null(least).to_numpy()
        return column.to_numpy(zero_copy_only=False).astype(object)

    def first(ids: np.ndarray) -> np.ndarray:
        """What to sort keys by."""
        if whole or len(ids) == 0 or all(x is not None for x in ids):
            return ids
        known = sorted({x for x in ids if x is not None})
        at = {x: i + 1 for i, x in enumerate(known)}
        return np.array([at.get(x, 0) for x in ids])

    class Chunk:
        """Queries with the best references seen so far."""

        def __init__(self, ids, x, g):
            self.ids, self.x, self.g = np.concatenate(ids), np.concatenate(x), np.concatenate(g)
            self.away = distances(self.x, centre)
            self.bound, _ = bounds(self.away, self.g)
            self.best = np.full((len(self.x), k), np.inf)
            self.near = np.empty((len(self.x), k), self.ids.dtype)
            self.middle = self.x.mean(axis=0)
            left = self.x - self.middle
            self.size = np.einsum("ij,ij->i", left, left)
            self.wide = np.hstack([-2 * left, np.ones((len(left), 1))])
            self.slim = self.wide.astype(np.float32)

        def meet(self, at, ids, x, g):
            """References of one cell, at place `at` of `labels`."""
            rows = np.nonzero(self.away[:, at] - radius[at] <= within(self.bound))[0]
            if not len(rows):
                return
            centred = x - self.middle
            size = np.einsum("ij,ij->i", centred, centred)
            there = np.hstack([centred, size[:, None]])
            # What a product in single precision can be off by; where that is much, in double precision.
            off = (np.sqrt(self.size[rows]) + math.sqrt(size.max())) ** 2 * (x.shape[1] + 16)
            slim = bool(size.max() < 1e30 and self.size[rows].max() < 1e30)
            slim = slim and float(np.mean(off * np.finfo(np.float32).eps > 0.02 * self.bound[rows] ** 2)) < 0.5
            mine = self.slim if slim else self.wide
            off *= np.finfo(mine.dtype).eps
            there = np.ascontiguousarray(there.astype(mine.dtype).T)
            for i in range(0, len(rows), SEARCHED_ROWS):
                self.tile(rows[i:i + SEARCHED_ROWS], off[i:i + SEARCHED_ROWS], mine, there, ids, x, g)

        def tile(self, rows, off, mine, there, ids, x, g):
            rough = mine[rows] @ there  # squared distances less the query's own square
            limit = within(self.bound[rows]) ** 2 + off - self.size[rows]
            found = rough <= limit[:, None].astype(rough.dtype)
            if k < len(ids) and np.count_nonzero(found) > 8 * k * len(rows):
                # No bound worth the name yet: the k-th of this block is one.
                if exclude:
                    rough[self.g[rows][:, None] == g[None, :]] = np.inf
                kth = np.partition(rough, k - 1, axis=1)[:, k - 1]
                found = rough <= np.minimum(limit, kth + 2 * off)[:, None].astype(rough.dtype)
            places = np.flatnonzero(found)
            for i in range(0, len(places), PAIRS):
                q, r = np.divmod(places[i:i + PAIRS], len(ids))
                self.rank(rows[q], r, ids, x, g)

        def rank(self, q, r, ids, x, g):
            """Exact distances of some pairs, added to the best."""
            if exclude:
                other = self.g[q] != g[r]
                q, r = q[other], r[other]
            diff = x[r] - self.x[q]
            d = np.sqrt(np.einsum("ij,ij->i", diff, diff))
            kept = (d <= self.best[q, k - 1]) & (d < np.inf)
            q, r, d = q[kept], r[kept], d[kept]
            if not len(q):
                return
            some = np.unique(q)
            old = np.isfinite(self.best[some])
            rows = np.concatenate([np.repeat(some, old.sum(axis=1)), q])
            d = np.concatenate([self.best[some][old], d])
            near = np.concatenate([self.near[some][old], ids[r]])
            order = np.lexsort((first(near), d, rows))
            rows, d, near = rows[order], d[order], near[order]
            place = np.arange(len(rows)) - np.searchsorted(rows, rows)
            kept = place < k
            self.best[rows[kept], place[kept]] = d[kept]
            self.near[rows[kept], place[kept]] = near[kept]
            self.bound[some] = np.minimum(self.bound[some], self.best[some, k - 1])

        def found(self):
            column = lambda ids: pa.array(ids, mask=ids == least).cast(id_type) if whole else pa.array(ids, type=id_type)
            for at in range(0, len(self.ids), BLOCK_ROWS):
                best, near = self.best[at:at + BLOCK_ROWS], self.near[at:at + BLOCK_ROWS]
                kept = best < np.inf
                yield pa.RecordBatch.from_arrays([
                    column(np.repeat(self.ids[at:at + BLOCK_ROWS], kept.sum(axis=1))), column(near[kept]), pa.array(best[kept]),
                ], names=[key, "ref_key", "distance"])

    def search(batches):
        """The queries of a chunk, then the references of its cells, nearest cells first."""
        number, waiting, chunk = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            chunk_of, ref, cell = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("chunk", "ref", "cell"))
            ids, x, g = names(batch.column("_id")), matrix(batch.column("_v")), batch.column("_g").to_numpy()
            ends = np.flatnonzero((np.diff(chunk_of) != 0) | (np.diff(ref.astype(int)) != 0) | (np.diff(cell) != 0)) + 1
            for a, b in zip([0, *ends], [*ends, len(batch)]):
                if chunk_of[a] != number:
                    if chunk:
                        yield from chunk.found()
                    number, waiting, chunk = chunk_of[a], [], None
                if not ref[a]:
                    waiting.append((ids[a:b], x[a:b], g[a:b]))
                    continue
                if not chunk:
                    chunk = Chunk(*zip(*waiting))
                    waiting = []
                chunk.meet(int(np.searchsorted(labels, cell[a])), ids[a:b], x[a:b], g[a:b])
        if chunk:
            yield from chunk.found()

    found = stream.repartitionById(chunks, "chunk").sortWithinPartitions("chunk", "ref", "lower", "cell").mapInArrow(
        search, f"{key} {id_kind}, ref_key {id_kind}, distance double"
    )
    best = Window.partitionBy(key).orderBy("distance", "ref_key")
    return found.withColumn("position", F.row_number().over(best)).where(c("position") <= k)


def neighbour_regression(
    found: DataFrame, labels: DataFrame, key: str, label: str
) -> DataFrame:
    """(key, pred): mean label of the neighbours weighted by 1/distance.

    Neighbours at distance 0, where there are any, decide alone.
    """
    named = found.join(labels.select(c(key).alias("ref_key"), c(label).cast("double").alias("_y")), "ref_key")
    exact = c("distance") == 0
    sums = named.groupBy(key).agg(
        F.avg(F.when(exact, c("_y"))).alias("_same"),
        F.sum(F.when(~exact, c("_y") / c("distance"))).alias("_top"),
        F.sum(F.when(~exact, 1.0 / c("distance"))).alias("_bottom"),
    )
    return sums.select(key, F.coalesce("_same", c("_top") / c("_bottom")).alias("pred"))
