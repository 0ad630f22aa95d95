"""Near-duplicate vectors by dual traversal of cover trees, exact at a cosine threshold.

On the unit sphere a cosine of at least c is a distance of at most sqrt(2 - 2c). Vectors of a label are dealt to
cells around centres; cells too far apart for their covering radii are never compared, and the others meet block by
block. Within two blocks, cover trees of halving radii are walked together: a pair of nodes is dropped when their
centres are further apart than both radii and the distance allow, taken wholly when even their furthest points are near
enough, and opened otherwise. What is left is decided by the cosine in double precision.

Equal unit vectors of a label are one point with a weight, so copies are counted without being compared. What leaves
a block is each point's number of links and one link to its smallest neighbour class, never the pairs themselves.

Vectors that are null, empty, zero or hold a null or non-finite component, and those of a null label, link with
nothing. Vectors of different lengths are never compared. A null vec_id is no component's id unless all are null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skyquill.llm.storage import components, stored

#: Least cosine of a link; points a block holds; centres over all labels, a sample that only shapes the cells.
COSINE, BLOCK, CENTRES = 0.98, 1024, 1024
#: Rounding that bounds on distances leave room for.
SLACK = 1e-7


def _units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unit vectors of the rows that can be linked, as little-endian doubles."""
    for batch in batches:
        keep, units = [], []
        for i, value in enumerate(batch.column(2)):
            if value.is_valid and len(value.values) and not value.values.null_count:
                vector = value.values.to_numpy(zero_copy_only=False).astype(float)
                largest = np.abs(vector).max()
                if np.isfinite(largest) and largest > 0:
                    vector = vector / largest  # squares of very large or small components stay in range
                    keep.append(i)
                    units.append((vector / np.sqrt(vector @ vector) + 0.0).astype("<f8").tobytes())
        at = pa.array(keep, pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), pa.array(units, pa.binary())],
                                         ["vec_id", "label", "unit"])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), "<f8").reshape(len(rows), -1)


class CoverTree:
    """Nested nodes over unit vectors: a node's members lie within its radius of its centre, its children's
    radii are at most half of its level's."""

    def __init__(self, points: np.ndarray, finest: float) -> None:
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.members: list[np.ndarray] = []
        self.children: list[np.ndarray] = []
        self._add(np.arange(len(points)), 2.0, finest)

    def _add(self, members: np.ndarray, level: float, finest: float) -> int:
        node = len(self.centre)
        far = _distances(self.points[members], self.points[members[:1]])[:, 0]
        self.centre.append(int(members[0]))
        self.radius.append(float(far.max()))
        self.members.append(members)
        self.children.append(np.zeros(0, int))
        while len(members) > 1 and level > finest:
            level /= 2
            parts, rest = [], members
            while len(rest):
                near = _distances(self.points[rest], self.points[rest[:1]])[:, 0] <= level
                near[0] = True
                parts.append(rest[near])
                rest = rest[~near]
            if len(parts) > 1:
                self.children[node] = np.array([self._add(part, level, finest) for part in parts])
                break
        return node

    def below(self, node: int) -> np.ndarray:
        return self.children[node] if len(self.children[node]) else np.array([node])


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2 - 2 * (a @ b.T), 0))


def linked_pairs(a: CoverTree, b: CoverTree, cosine: float) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of points of ``a`` and ``b`` with at least that cosine, by walking both trees together."""
    reach = np.sqrt(2 - 2 * cosine)
    out_i, out_j = [np.zeros(0, int)], [np.zeros(0, int)]
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        xs, ys = a.below(x), b.below(y)
        if len(xs) == len(ys) == 1 and xs[0] == x and ys[0] == y:  # two leaves
            p, q = a.members[x], b.members[y]
            i, j = np.nonzero(a.points[p] @ b.points[q].T >= cosine)
            out_i.append(p[i])
            out_j.append(q[j])
            continue
        gap = _distances(a.points[[a.centre[k] for k in xs]], b.points[[b.centre[k] for k in ys]])
        reached = np.add.outer([a.radius[k] for k in xs], [b.radius[k] for k in ys])
        # two points are decided by their cosine; a radius of 0 may still hold several, which rounding sets apart
        single = np.logical_and.outer([len(a.members[k]) == 1 for k in xs], [len(b.members[k]) == 1 for k in ys])
        inside = ~single & (gap + reached <= reach - SLACK)
        for k, m in zip(*np.nonzero(inside), strict=True):
            p, q = a.members[xs[k]], b.members[ys[m]]
            out_i.append(np.repeat(p, len(q)))
            out_j.append(np.tile(q, len(p)))
        k, m = np.nonzero(single & (gap <= reach + SLACK))
        p, q = np.array([a.centre[t] for t in xs])[k], np.array([b.centre[t] for t in ys])[m]
        near = np.einsum("ij,ij->i", a.points[p], b.points[q]) >= cosine
        out_i.append(p[near])
        out_j.append(q[near])
        for k, m in zip(*np.nonzero(~single & ~inside & (gap - reached <= reach + SLACK)), strict=True):
            todo.append((int(xs[k]), int(ys[m])))
    return np.concatenate(out_i), np.concatenate(out_j)


def _smallest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest point that each of ``n`` points reaches over the pairs."""
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, i, low[j])
        np.minimum.at(low, j, low[i])
        low = low[low]
        if (low == before).all():
            return low


def _compare(cosine: float):
    """Links of two blocks (or of one in itself): per point their number, and the class they reach here."""
    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        first, weight = table["first"].to_numpy(), table["weight"].to_numpy()
        points = _matrix(table["unit"])
        finest = np.sqrt(2 - 2 * cosine) / 16
        own = bool(table["own"][0].as_py())
        left = np.arange(len(points)) if own else np.flatnonzero(first)
        right = left if own else np.flatnonzero(~first)
        links, reached = np.zeros(len(points), np.int64), np.arange(len(points))
        if len(left) and len(right):
            tree = CoverTree(points[left], finest)
            i, j = linked_pairs(tree, tree if own else CoverTree(points[right], finest), cosine)
            i, j = left[i], right[j]
            if own:
                i, j = i[i != j], j[i != j]
            np.add.at(links, i, weight[j])
            if not own:
                np.add.at(links, j, weight[i])
            reached = _smallest(len(points), i, j)
        h, g = table["h"].to_numpy(), table["g"].to_numpy()
        some = links > 0
        return pa.table({"h": h[some], "g": g[some], "links": links[some], "h0": h[reached][some], "g0": g[reached][some]})
    return run


def _nearest(centres: dict[tuple, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, far = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows)
            label, size = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy()
            for key, points in centres.items():
                rows = np.flatnonzero((label == key[0]) & (size == key[1]))
                for s in range(0, len(rows), 4096):
                    part = rows[s:s + 4096]
                    gap = _distances(_matrix(batch.column(2).take(pa.array(part))), points)
                    cell[part] = gap.argmin(axis=1)
                    far[part] = gap.min(axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell), pa.array(far)], [*batch.schema.names, "cell", "far"])
    return run


def _cells(points: DataFrame, sizes: list, cosine: float, block: int, most: int) -> tuple[DataFrame, DataFrame]:
    """``points`` with their cell, and the pairs of cells (label, dim, i, j, blocks_i, blocks_j) that may hold links.

    Labels of more than a block get centres, together at most ``most``: their points of least hash, a bounded sample.
    """
    spark = points.sparkSession
    large = [(x["label"], x["dim"], x["n"]) for x in sizes]
    total = sum(n for _, _, n in large) or 1
    quota = [(label, dim, min(-(-n // block), max(1, most * n // total))) for label, dim, n in large]
    quota = [x for x in quota if x[2] > 1]
    centres: dict[tuple, np.ndarray] = {}
    for label, dim, k in quota:
        rows = points.where((F.col("label") == label) & (F.col("dim") == dim)).orderBy("h", "g").limit(k).select("unit").collect()
        centres[label, dim] = np.stack([np.frombuffer(x["unit"], "<f8") for x in rows])
    placed = stored(points.select("label", "dim", "unit", "h", "g", "weight").mapInArrow(
        _nearest(centres), "label string, dim int, unit binary, h long, g long, weight long, cell int, far double"), "cover-points")
    grouped = placed.groupBy("label", "dim", "cell").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    cells = grouped.join(F.broadcast(spark.createDataFrame(quota or [("", -1, 0)], "label string, dim int, k long")), ["label", "dim"])
    known = {(x["label"], x["dim"], x["cell"]): x for x in cells.collect()}  # a row a centre
    reach = float(np.sqrt(2 - 2 * cosine)) + SLACK
    pairs = []
    for (label, dim), at in centres.items():
        gap = _distances(at, at)
        own = [c for c in range(len(at)) if (label, dim, c) in known]
        for x, i in enumerate(own):
            for j in own[x:]:
                p, q = known[label, dim, i], known[label, dim, j]
                if i == j or gap[i, j] - p["radius"] - q["radius"] <= reach:
                    pairs.append((label, dim, i, j, -(-p["n"] // block), -(-q["n"] // block)))
    table = spark.createDataFrame(pairs, "label string, dim int, i int, j int, blocks_i long, blocks_j long") if pairs else None
    # labels of one cell have one pair, made where the data are
    single = (grouped.join(F.broadcast(spark.createDataFrame(quota or [("", -1, 0)], "label string, dim int, k long")),
                           ["label", "dim"], "left_anti")
              .select("label", "dim", F.col("cell").alias("i"), F.col("cell").alias("j"),
                      F.ceil(F.col("n") / block).alias("blocks_i"), F.ceil(F.col("n") / block).alias("blocks_j")))
    return placed, single if table is None else single.unionAll(table)


def near_vectors(vectors: DataFrame, cosine: float = COSINE, block: int = BLOCK, centres: int = CENTRES) -> DataFrame:
    """(vec_id, n_links, component_id, kept) per row of (vec_id, embedding, label); ``kept`` marks a component's smallest."""
    if not 0.5 < cosine < 1:
        raise ValueError("the cosine must be between 0.5 and 1")
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"),
                          F.col("embedding").cast("array<double>").alias("embedding"))
    units = rows.where("label IS NOT NULL").mapInArrow(_units, "vec_id long, label string, unit binary")
    units = stored(units.select("vec_id", "label", "unit", (F.octet_length("unit") / 8).cast("int").alias("dim"),
                                F.xxhash64("label", "unit").alias("h"), F.xxhash64(F.lit(7), "label", "unit").alias("g")), "cover-units")
    points = stored(units.groupBy("label", "dim", "h", "g").agg(
        F.count("*").alias("weight"), F.min("vec_id").alias("low"), F.first("unit").alias("unit")), "cover-classes")
    sizes = points.groupBy("label", "dim").agg(F.count("*").alias("n")).where(F.col("n") > block).collect()  # large labels only
    placed, pairs = _cells(points, sizes, cosine, block, centres)
    pairs = stored(pairs, "cover-pairs")
    rows_i = placed.withColumnRenamed("cell", "i").join(pairs, ["label", "dim", "i"])
    own_block = F.pmod("h", F.col("blocks_i"))
    left = rows_i.withColumn("x", own_block).withColumn("y", F.explode(F.expr("sequence(0L, blocks_j - 1)")))
    same_cell = F.col("i") == F.col("j")
    left = left.select("label", "dim", "i", "j", F.when(same_cell, F.least("x", "y")).otherwise(F.col("x")).alias("x"),
                       F.when(same_cell, F.greatest("x", "y")).otherwise(F.col("y")).alias("y"),
                       (~same_cell | (F.col("x") <= F.col("y"))).alias("first"), (same_cell & (F.col("x") == F.col("y"))).alias("own"),
                       "unit", "h", "g", "weight")
    rows_j = placed.withColumnRenamed("cell", "j").join(pairs.where("i <> j"), ["label", "dim", "j"])
    right = (rows_j.withColumn("y", F.pmod("h", F.col("blocks_j"))).withColumn("x", F.explode(F.expr("sequence(0L, blocks_i - 1)")))
             .select("label", "dim", "i", "j", "x", "y", F.lit(False).alias("first"), F.lit(False).alias("own"), "unit", "h", "g", "weight"))
    met = stored(left.unionAll(right).groupBy("label", "dim", "i", "j", "x", "y").applyInArrow(
        _compare(cosine), "h long, g long, links long, h0 long, g0 long"), "cover-links")
    links = met.groupBy("h", "g").agg(F.sum("links").alias("others"))
    roots = components(met.selectExpr("named_struct('h', h, 'g', g) AS a", "named_struct('h', h0, 'g', g0) AS b"))
    roots = stored(roots.selectExpr("node.h AS h", "node.g AS g", "root"), "cover-roots")
    known = (points.select("h", "g", "weight", "low").join(links, ["h", "g"], "left").join(roots, ["h", "g"], "left")
             .withColumn("root", F.coalesce("root", F.struct("h", "g"))))
    smallest = known.groupBy("root").agg(F.min("low").alias("component_id"))
    known = (known.join(smallest, "root").select("h", "g", "component_id",
             (F.col("weight") - 1 + F.coalesce("others", F.lit(0))).alias("n_links")))
    linked = units.select("vec_id", "h", "g").join(known, ["h", "g"]).select("vec_id", "n_links", "component_id")
    # rows that can't be linked: those whose vector gave no unit
    usable = (F.col("label").isNotNull() & F.col("embedding").isNotNull() & (F.size("embedding") > 0)
              & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("embedding", lambda x: x != 0))
    alone = rows.where(~F.coalesce(usable, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"),
                                                                 F.col("vec_id").alias("component_id"))
    return linked.unionAll(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
