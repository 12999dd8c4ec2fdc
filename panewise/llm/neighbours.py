"""Approximate nearest neighbours by low-dimensional stable projections, kd-trees and a chi-square stopping test.

Unit vectors are projected by a Gaussian matrix. The squared distance of two projections, divided by the squared distance of
the vectors, has a chi-square distribution with as many degrees of freedom as the projection has dimensions. A query takes
its neighbours in the projection one kd-tree leaf after the other, nearest leaves first, and verifies them on the original
vectors, nearest projections first. It stops when the next projected distance is so large that a vector nearer than the worst
one found would lie there only with probability 1 - sure.

The upper levels of the kd-tree are fitted on a bounded sample and deal all rows into cells. Cells with many rows are cut on
along their two widest sides, at quantiles that Spark takes over all their rows, and each block has the lower levels of its
own. A query first searches its own block. The distances found there decide, by the same test against the bounding boxes of
cells and then of blocks, which other blocks it visits. A block's rows are copied for every QUERIES visits that it really gets.

Equal vectors are indexed once, with their smallest ids: more than k + 1 of them can never be needed.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panewise.llm._common import bounded_broadcast, written

#: Dimensions of the projection (even), rows of a block and of a leaf, queries of a block at once.
DIMENSIONS, BLOCK, LEAF, QUERIES = 24, 4096, 64, 4096
#: Rows that fit the upper levels at most, and cells at most: these bound what the driver holds.
SAMPLE, CELLS = 20_000, 1024
#: How sure the stopping test must be that nothing nearer is left: about the recall to expect.
SURE = 0.95
#: Blocks whose boxes are broadcast at most, and projected neighbours that are verified first.
BOXES, FIRST = 16_384, 64


def chi_square_quantile(p: float, degrees: int) -> float:
    """x with P(chi-square of an even number of degrees <= x) = p."""

    def below(x: float) -> float:
        term = total = math.exp(-x / 2)
        for i in range(1, degrees // 2):
            term *= x / 2 / i
            total += term
        return 1 - total

    low, high = 0.0, 10.0 * degrees + 100
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if below(middle) < p else (low, middle)
    return high


def projection(width: int, dimensions: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((width, dimensions))


def kd_order(points: np.ndarray, leaf: int) -> list[np.ndarray]:
    """The rows of each leaf of a kd-tree: halves along the widest dimension until a leaf is small."""
    out, todo = [], [np.arange(len(points))]
    while todo:
        rows = todo.pop()
        if len(rows) <= leaf:
            out.append(rows)
            continue
        part = points[rows]
        axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
        order = np.argpartition(part[:, axis], len(rows) // 2)
        todo += [rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]]
    return out


def kd_splits(sample: np.ndarray, cells: int) -> list[tuple[int, float]]:
    """(axis, value) of a balanced tree's inner nodes in heap order, for a power of two of cells; a point goes right from value on."""
    splits, todo = [], [sample]
    for _ in range(cells - 1):
        part = todo.pop(0)
        if len(part):
            axis = int(np.argmax(part.max(axis=0) - part.min(axis=0)))
            value = float(np.median(part[:, axis]))
        else:
            axis, value = 0, 0.0
        splits.append((axis, value))
        right = part[:, axis] >= value if len(part) else np.zeros(0, dtype=bool)
        todo += [part[~right], part[right]]
    return splits


def cell_of(points: np.ndarray, splits: list[tuple[int, float]]) -> np.ndarray:
    """The cell of each point, for a full tree in heap order."""
    node = np.zeros(len(points), dtype=np.int64)
    if splits:
        axes, values = np.array([a for a, _ in splits]), np.array([v for _, v in splits])
        for _ in range(len(splits).bit_length()):
            node = 2 * node + 1 + (points[np.arange(len(points)), axes[node]] >= values[node])
    return node - len(splits)


def _matrix(column: pa.ChunkedArray | pa.Array, width: int, kind: type) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(flat.flatten().to_numpy(zero_copy_only=False), dtype=kind).reshape(-1, width)


def usable(vectors: DataFrame, width: int, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, embedding) of the rows that take part: an id, `width` finite components, not all zero."""
    x = F.col("embedding")
    inside = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    return rows.where(F.col("vec_id").isNotNull() & x.isNotNull() & (F.size(x) == width)).where(inside)


def distinct_vectors(rows: DataFrame, most: int) -> DataFrame:
    """(embedding, ids): each different vector with its `most` smallest ids; a limit ahead of the shuffle keeps groups small."""
    place = F.dense_rank().over(Window.partitionBy("embedding").orderBy("vec_id"))
    few = rows.withColumn("place", place).where(F.col("place") <= most)
    return few.groupBy("embedding").agg(F.sort_array(F.collect_set("vec_id")).alias("ids"))


class Block:
    """The rows of a block with their kd-tree; searches it for a query."""

    def __init__(self, names: np.ndarray, vectors: np.ndarray, points: np.ndarray, leaf: int):
        rows = kd_order(points, leaf)
        order = np.concatenate(rows)
        self.names, self.vectors, self.points = names[order], vectors[order], points[order]
        self.norms = np.sqrt(np.einsum("ij,ij->i", self.vectors, self.vectors))
        self.sizes = np.array([len(r) for r in rows])
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.low = np.minimum.reduceat(self.points, self.starts, axis=0)
        self.high = np.maximum.reduceat(self.points, self.starts, axis=0)

    def _rows(self, leaves: np.ndarray) -> np.ndarray:
        """Places of the leaves' rows."""
        sizes = self.sizes[leaves]
        return np.arange(sizes.sum()) + np.repeat(self.starts[leaves] - (np.cumsum(sizes) - sizes), sizes)

    def search(self, vector: np.ndarray, point: np.ndarray, k: int, worst: float, quantile: float) -> tuple[list[tuple[float, int]], int]:
        """(-cosine, name) of up to k rows, best first, and how many rows were verified; squared distances beyond `worst` need not be found.

        Leaves are opened in growing numbers, so that a search that finds little to leave out stays one of few steps.
        """
        norm = math.sqrt(np.einsum("i,i->", vector, vector))
        gap = np.maximum(self.low - point, 0) + np.maximum(point - self.high, 0)
        bounds = np.einsum("ij,ij->i", gap, gap)
        order, best, verified, at, step = np.argsort(bounds), [], 0, 0, 1
        while at < len(order) and bounds[order[at]] <= quantile * worst:  # beyond, the test holds for all leaves that follow
            leaves = order[at : at + step]
            rows = self._rows(leaves[bounds[leaves] <= quantile * worst])
            at, step = at + step, 2 * step
            far = self.points[rows] - point
            distance = np.einsum("ij,ij->i", far, far)
            near = np.nonzero(distance <= quantile * worst)[0]
            near, done, take = near[np.argsort(distance[near], kind="stable")], 0, FIRST
            while done < len(near) and distance[near[done]] <= quantile * worst:
                part = near[done : done + take]
                part = rows[part[distance[part] <= quantile * worst]]
                done, take = done + take, 2 * take
                cosine = np.einsum("ij,j->i", self.vectors[part], vector) / (self.norms[part] * norm)
                verified += len(part)
                best = sorted([*best, *zip((-cosine).tolist(), self.names[part].tolist())])[:k]
                if len(best) == k:
                    worst = min(worst, max(0.0, 2 + 2 * best[-1][0]) * (1 + 1e-9) + 1e-12)
        return best, verified


def _boxes(points: DataFrame, dimensions: int, *keys: str) -> DataFrame:
    """(keys, n, low, high): the bounding box of each group of points."""
    edges = lambda f: F.array(*[f(F.col("point")[i]) for i in range(dimensions)])
    return points.groupBy(*keys).agg(F.count("*").alias("n"), edges(F.min).alias("low"), edges(F.max).alias("high"))


def _sliced(points: DataFrame, key: str, axis: str, fan: int, broadcast_rows: int) -> DataFrame:
    """points with their key cut on: `fan` slices of about equal size along the component that the column `axis` names."""
    x = F.element_at("point", F.col(axis) + 1)
    cuts = points.groupBy(key).agg(F.percentile_approx(x, [i / fan for i in range(1, fan)], 20 * fan).alias("_cuts"))
    cuts = bounded_broadcast(written(cuts.withColumnRenamed(key, "_key"), "ann-cuts"), broadcast_rows)
    found = points.join(cuts, F.col(key) == F.col("_key"))
    return found.withColumn(key, F.col(key) * fan + F.size(F.filter("_cuts", lambda c: c <= x))).drop("_key", "_cuts")


def blocks_of(points: DataFrame, block: int, dimensions: int) -> DataFrame:
    """points (with cell, at most CELLS of them) with their block, of about `block` rows at most.

    Cells that have more are cut along their two widest sides. Rows whose projections are equal (vectors of one direction)
    cannot be told apart by cuts; a block that is still large is dealt on by a hash.
    """
    boxes = written(_boxes(points, dimensions, "cell"), "ann-cells-boxes")
    most = boxes.agg(F.max("n")).first()[0] or 0
    points = points.withColumn("block", F.col("cell"))
    if most > 2 * block:
        fan = math.ceil(math.sqrt(most / block))
        sides = F.sort_array(F.transform(F.arrays_zip("low", "high"), lambda e, i: F.struct((e["high"] - e["low"]).alias("side"), i.alias("axis"))), asc=False)
        axes = boxes.select(F.col("cell").alias("_cell"), sides[0]["axis"].alias("_one"), sides[1]["axis"].alias("_two"))
        points = points.join(F.broadcast(axes), F.col("cell") == F.col("_cell")).drop("_cell")  # at most CELLS rows
        points = _sliced(_sliced(points, "block", "_one", fan, BOXES), "block", "_two", fan, BOXES).drop("_one", "_two")
        points = written(points, "ann-sliced")
    sizes = points.groupBy("block").agg(F.ceil(F.count("*") / (2 * block)).alias("_parts")).where("_parts > 1").withColumnRenamed("block", "_of")
    points = points.join(bounded_broadcast(written(sizes, "ann-sizes"), BOXES), F.col("block") == F.col("_of"), "left")
    part = F.pmod(F.xxhash64("name"), F.coalesce("_parts", F.lit(1)))
    # Parts are numbered below the largest size there can be, 2 ** 20 of them.
    return points.withColumn("block", F.col("block") * (1 << 20) + part).drop("_of", "_parts")


def search(vectors: DataFrame, queries_every: int = 50, k: int = 5, width: int | None = None, dimensions: int = DIMENSIONS, sure: float = SURE, block: int = BLOCK, seed: int = 7, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score, n_verified): the k rows of the largest cosine found for each row whose id is divisible by queries_every.

    n_verified is how many different vectors were compared with the query's on their original components.

    A row is no candidate of its own id. Equal scores go by the smaller id. Vectors that are null, all zero, of another width
    than most or that hold a null or non-finite component take no part; nor do rows without id. Repeated rows count once. With
    fewer candidates than k all are returned; an empty table gives no rows. Other columns are not read.
    """
    if dimensions < 2 or dimensions % 2:
        raise ValueError("the projection needs an even number of dimensions")
    if width is None:
        found = vectors.where(F.col(vector_col).isNotNull()).groupBy(F.size(vector_col).alias("w")).count().orderBy(F.desc("count"), "w").first()
        width = found["w"] if found else 1
    matrix, quantile, wanted = projection(width, dimensions, seed), chi_square_quantile(sure, dimensions), k + 1
    rows = usable(vectors, width, id_col, vector_col)
    arrays = "embedding array<double>, point array<double>"

    def projected(given):
        for batch in given:
            x = _matrix(batch.column(0), width, np.float64)
            y = (x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]) @ matrix
            flat = lambda v: pa.FixedSizeListArray.from_arrays(pa.array(v.ravel()), v.shape[1]).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), flat(y)], names=["embedding", "ids", "point"])

    doubles = rows.withColumn("embedding", F.col("embedding").cast("array<double>"))
    points = distinct_vectors(doubles, wanted).mapInArrow(projected, "embedding array<double>, ids array<long>, point array<double>")
    points = written(points.withColumn("name", F.col("ids")[0]), "ann-points")
    n = points.count()

    cells = 1 << max(0, min(CELLS, -(-n // block)) - 1).bit_length()
    share = min(1.0, SAMPLE / max(n, 1))
    sample = points.select("point") if share >= 1 else points.where(F.pmod(F.xxhash64("name"), F.lit(1 << 20)) < int(share * (1 << 20))).select("point").limit(2 * SAMPLE)
    splits = kd_splits(np.array([r[0] for r in sample.toLocalIterator()], dtype=float).reshape(-1, dimensions), cells)

    def dealt(given):
        for batch in given:
            y = _matrix(batch.column(batch.schema.get_field_index("point")), dimensions, np.float64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell_of(y, splits))], names=[*batch.schema.names, "cell"])

    points = points.select("name", "ids", "embedding", "point").mapInArrow(dealt, f"name long, ids array<long>, {arrays}, cell long")
    placed = written(blocks_of(written(points, "ann-cells"), block, dimensions), "ann-blocks")
    cell_boxes = _boxes(placed, dimensions, "cell").collect()  # at most CELLS rows
    low, high = (np.array([r[c] for r in cell_boxes], dtype=float).reshape(-1, dimensions) for c in ("low", "high"))
    names = [r["cell"] for r in cell_boxes]

    asked = doubles.where(F.col("vec_id") % queries_every == 0)
    by_name = asked.join(placed.select("embedding", "name"), "embedding").select(F.col("vec_id").alias("query_id"), "name")
    by_name = written(by_name, "ann-queries")
    queries = placed.join(by_name.select("name").distinct(), "name", "left_semi").select("name", "embedding", "point", "block")
    queries = written(queries, "ann-asked")

    def in_block(left: pa.Table, right: pa.Table) -> pa.Table:
        """left: the block's rows; right: queries with the squared distance beyond which nothing is needed. The last row of each query has its count."""
        found: list[tuple] = []
        if left.num_rows and right.num_rows:
            tree = Block(left["name"].to_numpy(), _matrix(left["embedding"], width, np.float64), _matrix(left["point"], dimensions, np.float64), LEAF)
            asks = zip(right["q_name"].to_pylist(), _matrix(right["q_embedding"], width, np.float64), _matrix(right["q_point"], dimensions, np.float64), right["q_worst"].to_pylist())
            for name, vector, point, worst in asks:
                best, verified = tree.search(vector, point, wanted, worst, quantile)
                found += [(name, other, -score, None) for score, other in best] + [(name, None, None, verified)]
        columns = list(zip(*found)) or [(), (), (), ()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("name", "found", "score", "verified"), columns, (pa.int64(), pa.int64(), pa.float64(), pa.int64()))})

    def in_blocks(visits: DataFrame, asks: DataFrame) -> DataFrame:
        """What the visits (name, block) find; asks: (name, embedding, point, worst)."""
        chunks = visits.groupBy("block").agg(F.ceil(F.count("*") / QUERIES).alias("_chunks")).withColumnRenamed("block", "_of")
        chunks = bounded_broadcast(written(chunks, "ann-chunks"), BOXES)
        data = placed.select("block", "name", "embedding", "point").join(chunks, F.col("block") == F.col("_of"))
        data = data.select("block", "name", "embedding", "point", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_chunks") - 1)).alias("chunk"))
        dealt = visits.join(chunks, F.col("block") == F.col("_of")).select("name", "block", F.pmod(F.xxhash64("name", F.lit(1)), F.col("_chunks")).alias("chunk"))
        dealt = dealt.join(asks, "name").select(*[F.col(c).alias(f"q_{c}") for c in ("block", "chunk", "name", "embedding", "point", "worst")])
        return data.groupBy("block", "chunk").cogroup(dealt.groupBy("q_block", "q_chunk")).applyInArrow(in_block, "name long, found long, score double, verified long")

    home = written(in_blocks(queries.select("name", "block"), queries.select("name", "embedding", "point", F.lit(4.0).alias("worst"))), "ann-home")
    reach = home.where("found is not null").groupBy("name").agg(F.count("*").alias("n"), F.min("score").alias("least"))
    worst = F.when(F.col("n") >= wanted, F.greatest(F.lit(0.0), 2 - 2 * F.col("least")) * (1 + 1e-9) + 1e-12).otherwise(4.0)
    queries = queries.join(reach, "name", "left").withColumn("worst", F.coalesce(worst, F.lit(4.0))).select("name", "embedding", "point", "block", "worst")
    queries = written(queries, "ann-limits")

    def routed(given):
        """A row for each cell that a query has to visit."""
        for batch in given:
            limits = batch.column(3).to_pylist()
            take, to = [], []
            for i, point in enumerate(_matrix(batch.column(1), dimensions, np.float64)):
                gap = np.maximum(low - point, 0) + np.maximum(point - high, 0)
                visits = np.nonzero(np.einsum("ij,ij->i", gap, gap) <= quantile * limits[i])[0].tolist()
                take += [i] * len(visits)
                to += [names[c] for c in visits]
            for k in range(0, len(take), 4096):
                part = batch.take(pa.array(take[k : k + 4096], pa.int64()))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(to[k : k + 4096], pa.int64())], names=["name", "point", "own", "worst", "cell"])

    to_cells = queries.select("name", "point", F.col("block").alias("own"), "worst").mapInArrow(routed, "name long, point array<double>, own long, worst double, cell long")
    boxes = bounded_broadcast(written(_boxes(placed, dimensions, "block", "cell"), "ann-boxes"), BOXES)
    sides = F.zip_with(F.zip_with("low", "point", lambda a, p: F.greatest(a - p, F.lit(0.0))), F.zip_with("point", "high", lambda p, b: F.greatest(p - b, F.lit(0.0))), lambda x, y: x + y)
    visits = to_cells.join(boxes, "cell").where(F.col("block") != F.col("own")).where(F.aggregate(sides, F.lit(0.0), lambda t, v: t + v * v) <= F.lit(quantile) * F.col("worst"))
    away = in_blocks(written(visits.select("name", "block"), "ann-visits"), queries.select("name", "embedding", "point", "worst"))
    every = written(home.unionByName(away), "ann-found")
    counts = every.where("found is null").groupBy("name").agg(F.sum("verified").alias("n_verified"))
    order = Window.partitionBy("name").orderBy(F.desc("score"), "found")
    best = every.where("found is not null").withColumn("place", F.row_number().over(order)).where(F.col("place") <= wanted)
    best = best.join(placed.select(F.col("name").alias("found"), "ids"), "found").select("name", "score", F.explode("ids").alias("vec_id"))
    best = best.join(by_name.distinct().join(counts, "name"), "name").where(F.col("vec_id") != F.col("query_id"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", "n_verified")
