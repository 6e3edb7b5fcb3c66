"""Embedding near-duplicates by collision counting over sorted one-dimensional projections.

Unit vectors are projected on ``PROJECTIONS`` random directions. Rows of a label are ordered by
their first projection and cut into tiles; a pair of tiles is looked at only if their ranges of it come
within reach, and by the rows that are within reach of the other tile. Within a pair of tiles each projection is
sorted, every row opens a window of half width W around its own value, and a pair's collisions
are the projections in whose window it falls. Pairs with at least T collisions are verified by
cosine in double precision. For cosine c the projections of a pair differ by a normal value of
deviation sqrt(2 (1 - c)); W and T follow from that, so that the count misses a pair at the threshold
with probability under ``MISS``. The reach of tiles is 3.5 deviations, which loses 0.05% of the pairs at
exactly the threshold more: 0.06% together there, and fast less above it.

Equal vectors of a label are one row with a multiplicity. Tile tasks send, for each row, its
number of verified links and the root of its component within the pair of tiles, never pairs. Work still
grows with the square of a label's distinct rows, at a few dozen byte operations a pair: windows wide enough for
the cosine hold a good part of the rows on any one projection.

Defined results: null labels, null or zero vectors, and vectors with null or non-finite
components link with nothing; vectors of different lengths do not link; repeated vec_ids count
as vectors of their own but share one result row's id; a null id is nobody's component unless
alone. Extra columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, arrow_map, batch_of, column_of, connected_components

COSINE = 0.93
PROJECTIONS = 24
WIDTH = 2.0
MISS = 1e-4
TILE = 1024
ROWS = "set_id long, label string, size int, p0 double, unit binary, projections binary"
LINKS = "set_id long, root long, links long"


def threshold(projections: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """Most collisions that a pair at the cosine threshold reaches with probability 1 - miss.

    ``width`` is the window's half width in deviations of such a pair's difference.
    """
    p = math.erf(width / math.sqrt(2))
    below, t = 0.0, 0
    while True:
        below += math.comb(projections, t) * p**t * (1 - p) ** (projections - t)
        if below > miss:
            return t
        t += 1


def directions(size: int, projections: int = PROJECTIONS) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(size)).standard_normal((size, projections))


def half_width(cosine: float = COSINE, width: float = WIDTH) -> float:
    return width * math.sqrt(2 * (1 - cosine))


def _projected(batches):
    for batch in batches:
        rows = []
        for set_id, label, vector in zip(column_of(batch, "set_id").to_pylist(), column_of(batch, "label").to_pylist(), column_of(batch, "embedding")):
            v = np.array(vector.as_py(), dtype=np.float64)
            # Scaled by the largest component first, so that no square is lost to under- or overflow.
            v = v / np.abs(v).max()
            v = v / np.linalg.norm(v)
            p = v @ directions_of(len(v))
            rows.append((set_id, label, len(v), p[0], v.tobytes(), p.tobytes()))
        if rows:
            yield batch_of(ROWS, list(zip(*rows)))


_DIRECTIONS: dict[int, np.ndarray] = {}


def directions_of(size: int) -> np.ndarray:
    if size not in _DIRECTIONS:
        _DIRECTIONS[size] = directions(size)
    return _DIRECTIONS[size]


def collisions(p: np.ndarray, q: np.ndarray, w: float) -> np.ndarray:
    """For each row of p and of q: on how many projections q's value lies in the window around p's.

    q's values are sorted and p's windows are runs of ranks in that order, so a collision is one comparison of small integers.
    """
    kind = np.uint16 if len(q) < 1 << 16 else np.uint32
    out = np.zeros((len(p), len(q)), dtype=np.uint8)
    rank = np.empty(len(q), dtype=kind)
    for j in range(p.shape[1]):
        order = np.argsort(q[:, j])
        values = q[order, j]
        rank[order] = np.arange(len(q), dtype=kind)
        first = np.searchsorted(values, p[:, j] - w, "left").astype(kind)
        size = np.searchsorted(values, p[:, j] + w, "right").astype(kind) - first
        # Ranks below the first wrap around to large numbers.
        out += (rank[None, :] - first[:, None]) < size[:, None]
    return out


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Smallest index of each node's component, by repeated minimum over edges and pointer jumping."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (before == root).all():
            return root


def _tile_links(cosine: float):
    w, t = half_width(cosine), threshold()

    def of(rows):
        ids, sides, times, units, proj = rows
        order = np.argsort(ids, kind="stable")
        ids, sides, times = ids[order], sides[order], times[order]
        v = np.stack([np.frombuffer(units[i]) for i in order])
        p = np.stack([np.frombuffer(proj[i]) for i in order])
        x, y = np.flatnonzero(sides != 1), np.flatnonzero(sides != 0)
        links, a, b = np.zeros(len(ids), dtype=np.int64), [], []
        for start in range(0, len(x), 256):
            i = x[start : start + 256]
            r, c = np.nonzero(collisions(p[i], p[y], w) >= t)
            r, c = i[r], y[c]
            keep = (r < c) if sides[0] == 2 else np.ones(len(r), dtype=bool)
            r, c = r[keep], c[keep]
            good = np.einsum("ij,ij->i", v[r], v[c]) >= cosine
            r, c = r[good], c[good]
            np.add.at(links, r, times[c])
            np.add.at(links, c, times[r])
            a.append(r)
            b.append(c)
        root = _roots(len(ids), np.concatenate(a), np.concatenate(b)) if a else np.arange(len(ids))
        some = links > 0
        return batch_of(LINKS, [ids[some], ids[root[some]], links[some]]) if some.any() else None

    def run(batches):
        key, held = None, []

        def work():
            cols = [np.concatenate([h[i] for h in held]) for i in range(3)] + [[x for h in held for x in h[i]] for i in (3, 4)]
            return of(cols)

        for batch in batches:
            keys = column_of(batch, "tile_pair").to_pylist()
            cols = [column_of(batch, c).to_numpy() for c in ("set_id", "side", "times")] + [column_of(batch, c).to_pylist() for c in ("unit", "projections")]
            start = 0
            for end in range(1, len(keys) + 1):
                if end < len(keys) and keys[end] == keys[start]:
                    continue
                if keys[start] != key:
                    if held and (out := work()):
                        yield out
                    key, held = keys[start], []
                held.append([c[start:end] for c in cols])
                start = end
        if held and (out := work()):
            yield out

    return run


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each row."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "embeddings")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("string").alias("label"), F.col(vector_col).cast("array<double>").alias("embedding"))
    fine = F.expr(
        "label is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(embedding, x -> x <> 0)"
    )
    rows = rows.withColumn("embedding", F.when(F.coalesce(fine, F.lit(False)), F.col("embedding")))
    # -0.0 and 0.0 are one value here.
    same = F.transform("embedding", lambda x: x + F.lit(0.0))
    rows = rows.withColumn("set_id", F.when(F.col("embedding").isNotNull(), F.xxhash64("label", same)))
    # One row for each distinct vector of a label: how often it occurs and its smallest id.
    distinct = rows.where("embedding is not null").groupBy("set_id").agg(
        F.count("*").alias("times"), F.min("vec_id").alias("least_id"), F.first("label").alias("label"), F.first("embedding").alias("embedding")
    )
    distinct = scratch.keep(distinct, "distinct")
    projected = arrow_map(distinct.select("set_id", "label", "embedding"), _projected, ROWS)
    sizes = distinct.select("set_id", "times", "least_id")
    projected = scratch.keep(projected.join(sizes, "set_id"), "projected")

    # Tiles: a label's rows in order of the first projection. Places come from counts of narrow cells, so no task orders a whole label.
    cells = projected.withColumn("cell", F.floor(F.col("p0") * 64))
    counts = cells.groupBy("label", "size", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("label", "size").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # A cell that alone fills several tiles is cut by the set's hash.
    tile = (F.expr(f"before div {TILE}") + F.expr(f"pmod(xxhash64(set_id), (n - 1) div {TILE} + 1)")).cast("long")
    tiled = cells.join(counts, ["label", "size", "cell"]).withColumn("tile", tile).drop("cell", "n", "before")
    w = half_width(cosine)
    spans = tiled.groupBy("label", "size", "tile").agg(F.min("p0").alias("lo"), F.max("p0").alias("hi"))
    x, y = spans.toDF("label", "size", "t", "t_lo", "t_hi"), spans.toDF("label", "size", "u", "u_lo", "u_hi")
    reach = projected_reach(w)
    pairs = x.join(y, ["label", "size"]).where((F.col("t") <= F.col("u")) & (F.col("u_lo") - F.col("t_hi") <= reach) & (F.col("t_lo") - F.col("u_hi") <= reach))
    # A row goes to a pair of tiles only if its first projection is within reach of the other tile.
    ends = pairs.select("label", "size", F.col("t").alias("tile"), "t", "u", F.when(F.col("t") == F.col("u"), 2).otherwise(0).alias("side"), F.col("u_lo").alias("lo"), F.col("u_hi").alias("hi")).unionAll(
        pairs.where("t < u").select("label", "size", F.col("u").alias("tile"), "t", "u", F.lit(1).alias("side"), F.col("t_lo").alias("lo"), F.col("t_hi").alias("hi"))
    )
    sent = tiled.join(ends, ["label", "size", "tile"]).where(F.col("p0").between(F.col("lo") - reach, F.col("hi") + reach))
    sent = sent.select(F.xxhash64("label", "size", "t", "u").alias("tile_pair"), "set_id", "side", "times", "unit", "projections")
    found = scratch.keep(arrow_map(sent.repartition("tile_pair").sortWithinPartitions("tile_pair", "set_id"), _tile_links(cosine), LINKS), "links")

    parts = connected_components(scratch, found.select(F.col("set_id").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("set_id").agg(F.sum("links").alias("links"))
    of_set = distinct.select("set_id", "times", "least_id").join(parts.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("component", F.coalesce("component", "set_id"))
    smallest = of_set.groupBy("component").agg(F.min("least_id").alias("component_id"))
    of_set = of_set.join(smallest, "component").join(links, "set_id", "left")
    of_set = of_set.select("set_id", "component_id", (F.coalesce("links", F.lit(0)) + F.col("times") - 1).cast("long").alias("n_links"))
    out = rows.select("vec_id", "set_id").join(of_set, "set_id", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def projected_reach(w: float) -> float:
    """How far two tiles may lie apart on the first projection: 1.75 windows, 3.5 deviations of a pair at the threshold."""
    return 1.75 * w
