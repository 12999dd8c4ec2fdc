"""Detection strategies: different plans for the same answer.

Each takes points and a query set and returns (window_end, R, k, w, s, outliers). They differ in how neighbours are found and
how much evidence is kept; whichever is chosen, the counts are exact.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from panewise.config import Algorithm, QuerySet, Space
from panewise.errors import UnsupportedSpaceError
from panewise.functions.distance import cell, dense_side, euclid, widths
from panewise.plans import counting as C
from panewise.storage import bounded_broadcast, written

Strategy = Callable[[DataFrame, QuerySet], DataFrame]


#: Points of a pane for each part into which the exhaustive strategy deals them, and panes whose parts are broadcast at most.
PART, PANES = 4_096, 200_000


def naive(points: DataFrame, q: QuerySet) -> DataFrame:
    """Every point against all others that share a window with it: an equality join on the pane, the distance as its condition.

    A point goes to each pane that its windows reach, so that a pair is compared once and not in every window. The points of a
    pane are dealt into as many parts as their number asks for, and those that probe it are copied to all of them: a crowded pane
    is as many tasks' work.
    """
    low, high = widths(points)
    panes, span = C.together(points, q, (low, high)), q.max_window // q.pane
    even, grouped = low == high and low <= 8, "n" in panes.columns
    values = lambda name: [F.col("value")[i].alias(f"{name}{i}") for i in range(low)] if even else [F.col("value").alias(name)]
    parts = panes.groupBy(F.col("pane").alias("other_pane")).agg(F.ceil(F.count("*") / PART).cast("int").alias("_parts"))
    parts = bounded_broadcast(written(parts, "pane-parts"), PANES)
    own = panes.where("flag = 0").select("id", "pane", *values("_a"), F.explode(F.sequence(F.col("pane") - span + 1, F.col("pane") + span - 1)).alias("other_pane"))
    own = own.join(parts, "other_pane").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    own = C.spread(own) if grouped else own
    other = panes.select(F.col("id").alias("other"), F.col("pane").alias("other_pane"), *([F.col("n").alias("other_n")] if grouped else []), *values("_b"))
    other = other.join(parts, "other_pane").withColumn("_part", F.pmod(F.xxhash64("other"), F.col("_parts")).cast("int")).drop("_parts")
    distance = euclid(F.array(*[f"_a{i}" for i in range(low)]), F.array(*[f"_b{i}" for i in range(low)]), low) if even else euclid("_a", "_b", None)
    found = own.join(other, ["other_pane", "_part"]).where("id <> other").withColumn("distance", distance).where(F.col("distance") <= q.max_range)
    return C.outlier_counts(C.window_counts(panes, C.pane_counts(found, q), q), q)


def advanced(points: DataFrame, q: QuerySet) -> DataFrame:
    """New points probe an index of all older ones; a pair is evidence for both, merged by id.

    A pair is found once, from its newer point, and counted for it (a preceding neighbour) and for the older one (a succeeding).
    """
    shape = widths(points)
    panes = C.together(points, q, shape)
    found = C.pairs(panes, q, shape=shape, older_only=True).withColumn("layer", C.layer(F.col("distance"), q))
    n, other_n = (F.col(c) if c in found.columns else F.lit(1) for c in ("n", "other_n"))
    preceding = F.struct("id", "pane", "other_pane", other_n.alias("n"))
    succeeding = F.struct(F.col("other").alias("id"), F.col("other_pane").alias("pane"), F.col("pane").alias("other_pane"), n.alias("n"))
    merged = found.select(F.explode(F.array(preceding, succeeding)).alias("e"), "layer").groupBy("e.id", "e.pane", "e.other_pane", "layer").agg(F.sum("e.n").alias("n"))
    copies = panes.where("flag = 1").select("id").distinct()
    return C.outlier_counts(C.window_counts(panes, merged.join(copies, "id", "left_anti"), q), q)


def advanced_extended(points: DataFrame, q: QuerySet, partition: Callable[[DataFrame, float], DataFrame] | None = None) -> DataFrame:
    """Points are dealt by value with copies for the partitions that a neighbour may be in; each counts its own points' neighbours."""
    from panewise.operators.partitioning import even_grid

    shape = widths(points)
    own = points.where("flag = 0")
    if partition is None:  # a grid goes by value: it deals whole rows of together()
        rows = C.together(own, q, shape)
        panes = even_grid(rows, q.max_range).partition(rows, q.max_range)
    else:
        panes = C.together(partition(own, q.max_range), q, shape, on=("partition",))
    found = C.pairs(panes, q, panes.where("flag = 0"), shape, on=("partition",))
    return C.outlier_counts(C.window_counts(panes, C.pane_counts(found, q), q), q)


def slicing(points: DataFrame, q: QuerySet) -> DataFrame:
    """Neighbours counted by pane once, windows summed from the panes: the core plan."""
    return C.detect(points, q)


def _panes_of_cells(panes: DataFrame, q: QuerySet, width: int) -> DataFrame:
    """(_dense, pane, n): points of each small cell, any two of which are neighbours in every range, by pane."""
    return panes.select(cell("value", dense_side(q.ranges[0], width), width).alias("_dense"), "pane").groupBy("_dense", "pane").agg(F.count("*").alias("n"))


def _in_cell_windows(cells: DataFrame, q: QuerySet, w: int) -> DataFrame:
    found = C._tagged(C.ends(F.col("pane"), F.col("pane"), q, w), w)
    return cells.withColumn("_e", F.explode(found)).select(*cells.columns, "_e.window_end").where(C.due(q))


def _open_ends(cells: DataFrame, q: QuerySet) -> DataFrame:
    """(_dense, pane, open): ends of the windows in which a cell's points of a pane may be outliers.

    In all others more than the largest k points of the cell lie in the shortest window, so that each of its points has enough.
    """
    full = _in_cell_windows(cells, q, q.windows[0]).groupBy("_dense", "window_end").agg(F.sum("n").alias("total")).where(F.col("total") > q.ks[-1])
    rows = _in_cell_windows(cells, q, q.max_window).join(full.select("_dense", "window_end", F.lit(True).alias("full")), ["_dense", "window_end"], "left")
    return rows.groupBy("_dense", "pane").agg(F.collect_set(F.when(F.col("full").isNull(), F.col("window_end"))).alias("open"))


def _open_ends_by_pane(cells: DataFrame, q: QuerySet) -> DataFrame:
    """As _open_ends(), for one window and slide: cells are checked at every reporting time on the panes before it, by a running sum."""
    order = Window.partitionBy("_dense").orderBy("pane")
    span = q.max_window // q.pane
    marks = cells.select("_dense", "pane", F.col("n"), F.explode(C.ends(F.col("pane"), F.col("pane"), q, q.max_window)).alias("window_end"))
    ends = marks.select("_dense", (F.col("window_end") / q.pane - 1).cast("long").alias("pane"), F.lit(0).cast("long").alias("n"), "window_end").distinct()
    both = cells.select("_dense", "pane", "n", F.lit(None).cast("long").alias("window_end")).unionByName(ends)
    sums = both.withColumn("total", F.sum("n").over(order.rangeBetween(-(span - 1), 0))).where("window_end is not null")
    full = sums.where(F.col("total") > q.ks[-1]).select("_dense", "window_end", F.lit(True).alias("full"))
    rows = marks.join(full, ["_dense", "window_end"], "left")
    return rows.groupBy("_dense", "pane").agg(F.collect_set(F.when(F.col("full").isNull(), F.col("window_end"))).alias("open"))


def _pruned(points: DataFrame, q: QuerySet, evidence: Callable[[DataFrame], DataFrame], open_ends: Callable[[DataFrame, QuerySet], DataFrame] = _open_ends) -> DataFrame:
    """Counts neighbours only for points that some window's dense cells do not settle; evidence turns pairs into pane counts."""
    shape = widths(points)
    width = shape[0]
    panes = C.with_panes(points, q)
    if shape[0] != shape[1]:  # distances only use the components that both points have, which need not be those of a cell
        return C.outlier_counts(C.window_counts(panes, evidence(C.pairs(panes, q, panes.where("flag = 0"), shape)), q), q)
    cells = _panes_of_cells(panes, q, width)
    own = panes.where("flag = 0").withColumn("_dense", cell("value", dense_side(q.ranges[0], width), width))
    unsure = own.join(open_ends(cells, q), ["_dense", "pane"]).where(F.size("open") > 0).drop("_dense")
    counts = C.in_windows(evidence(C.pairs(panes, q, unsure.drop("open"), shape)), q, "pane", "other_pane")
    asked = C.in_windows(unsure.select("id", "pane", "open"), q, "pane", "pane").where(F.array_contains("open", F.col("window_end")))
    rows = asked.select("id", "w", "window_end", F.lit(0).alias("layer"), F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked"))
    rows = rows.unionByName(counts.select("id", "w", "window_end", "layer", "n", F.lit(False).alias("asked")))
    rows = rows.groupBy("id", "w", "window_end").agg(*C.within(q), F.max("asked").alias("asked")).where("asked")
    combos = [(i, k) for i in range(len(q.ranges)) for k in q.ks]
    sums = rows.groupBy("window_end", "w").agg(*[F.sum(F.when(F.col(f"n{i}") < k, 1).otherwise(0)).alias(f"c{j}") for j, (i, k) in enumerate(combos)])
    windows = C.in_windows(panes.where("flag = 0").select("pane").distinct(), q, "pane", "pane").select("w", "window_end").distinct()
    all_windows = windows.join(sums, ["w", "window_end"], "left")
    return C.reported(all_windows.select("w", "window_end", *[F.coalesce(f"c{j}", F.lit(0)).alias(f"c{j}") for j in range(len(combos))]), q)


def pmcod(points: DataFrame, q: QuerySet) -> DataFrame:
    """Dense cells first: points of a cell with more than k points in a window are no outliers there and need no neighbours."""
    return _pruned(points, q, lambda found: C.pane_counts(found, q))


def pmcod_net(points: DataFrame, q: QuerySet) -> DataFrame:
    """As pmcod, but cells are checked once for each reporting time, after its new points."""
    return _pruned(points, q, lambda found: C.pane_counts(found, q), _open_ends_by_pane)


def _directed(found: DataFrame, q: QuerySet) -> DataFrame:
    """found with after (the neighbour came in a later pane), age (how late it matters: 0 first) and its layer.

    Preceding neighbours expire oldest first, so that the newest are worth most; succeeding ones never expire before the
    point, and the oldest count in most windows.
    """
    return _aged(found).withColumn("layer", C.layer(F.col("distance"), q))


def _aged(found: DataFrame) -> DataFrame:
    after = F.col("other_pane") > F.col("pane")
    return found.withColumn("after", after).withColumn("age", F.when(after, F.col("other_pane")).otherwise(-F.col("other_pane")))


def k_skyband(found: DataFrame, q: QuerySet) -> DataFrame:
    """Of each point's neighbours those that fewer than the largest k others beat both in layer and in age (ties by id).

    No query of the set can tell them from all neighbours.
    """
    return _beaten(_directed(found, q), q).where(F.col("beaten") < q.ks[-1])


def _beaten(rows: DataFrame, q: QuerySet) -> DataFrame:
    """rows with how many others of the point's beat each."""
    order = Window.partitionBy("id", "after").orderBy("age", "other").rowsBetween(Window.unboundedPreceding, -1)
    beaten = F.lit(0)
    for i in range(len(q.ranges)):
        beaten = F.when(F.col("layer") == i, F.coalesce(F.sum(F.when(F.col("layer") <= i, 1).otherwise(0)).over(order), F.lit(0))).otherwise(beaten)
    return rows.withColumn("beaten", beaten)


def skyband(points: DataFrame, q: QuerySet) -> DataFrame:
    """(id, other, layer) of k_skyband() of all points and their neighbours, without a pair for each of these.

    Points of a value and pane have one skyband but for themselves, who come before all others that they keep from it. So it is
    taken once for all of them, one wider: of panes that enough neighbours in worthier ones leave open, with the smallest ids
    of each row of together(). A point then leaves itself out.
    """
    shape, most = widths(points), q.ks[-1] + 1
    rows = C.together(points, q, shape)
    if "itself" not in rows.columns:
        return k_skyband(C.pairs(rows, q, shape=shape), q).select("id", "other", "layer")
    found = C.pairs(rows, q, shape=shape).select("id", "pane", "other", "other_pane", C.layer(F.col("distance"), q).alias("layer"), F.col("other_n").alias("n"))
    own = rows.where("itself > 0 or n = 1").select("id", "pane", F.col("id").alias("other"), F.col("pane").alias("other_pane"), F.lit(0).alias("layer"), "n")
    found = _before(found.unionByName(own), q).where(F.col("before") < most).select("id", "pane", F.col("other").alias("_row"), "other_pane", "layer")
    members = written(C.each(points, rows, q), "members")
    first = members.withColumn("_n", F.row_number().over(Window.partitionBy("_row").orderBy("id"))).where(F.col("_n") <= most).select("_row", F.col("id").alias("other"))
    found = _beaten(_aged(found.join(first, "_row")), q).where(F.col("beaten") < most)
    band = found.groupBy(F.col("id").alias("_row"), "pane").agg(F.collect_list(F.struct("other", "after", "age", "layer", "beaten")).alias("band"))
    each = members.join(band, "_row").select("id", "pane", F.explode("band").alias("b"))
    itself_first = ~F.col("b.after") & ((F.col("b.age") > -F.col("pane")) | (F.col("b.age") == -F.col("pane")) & (F.col("b.other") > F.col("id")))
    return each.where((F.col("id") != F.col("b.other")) & (F.col("b.beaten") - itself_first.cast("int") < q.ks[-1])).select("id", "b.other", "b.layer")


def amcod(points: DataFrame, q: QuerySet) -> DataFrame:
    """Dense cells of the smallest range and largest k first, checked once for each reporting time; the others keep the k-skyband of their neighbours' panes."""
    return _pruned(points, q, lambda found: _capped(C.pane_counts(found, q), q, cumulative=True), _open_ends_by_pane)


def _capped(counts: DataFrame, q: QuerySet, cumulative: bool) -> DataFrame:
    """Pane counts without the panes that the largest k nearer or equal neighbours in worthier panes make needless.

    cumulative: neighbours of smaller layers count against a pane too (the skyband); else each layer is capped alone.
    """
    if cumulative:
        rows = _before(counts, q)
    else:
        order = Window.partitionBy("id", "after", "layer").orderBy("age").rowsBetween(Window.unboundedPreceding, -1)
        rows = _aged(counts).withColumn("before", F.coalesce(F.sum("n").over(order), F.lit(0)))
    return rows.where(F.col("before") < q.ks[-1]).select("id", "pane", "other_pane", "layer", "n")


def _before(counts: DataFrame, q: QuerySet) -> DataFrame:
    """counts with how many neighbours of the same layer or a smaller one lie in worthier panes."""
    order = Window.partitionBy("id", "after").orderBy("age").rangeBetween(Window.unboundedPreceding, -1)
    before = F.lit(0)
    for i in range(len(q.ranges)):
        before = F.when(F.col("layer") == i, F.coalesce(F.sum(F.when(F.col("layer") <= i, F.col("n")).otherwise(0)).over(order), F.lit(0))).otherwise(before)
    return _aged(counts).withColumn("before", before)


def sop(points: DataFrame, q: QuerySet) -> DataFrame:
    """One join at the largest range; of a point's neighbours the skyband by pane and layer, newest first."""
    shape = widths(points)
    panes = C.together(points, q, shape)
    counts = C.pane_counts(C.pairs(panes, q, panes.where("flag = 0"), shape), q)
    return C.outlier_counts(C.window_counts(panes, _capped(counts, q, cumulative=True), q), q)


def psod(points: DataFrame, q: QuerySet) -> DataFrame:
    """As sop, but each layer keeps its own newest neighbours."""
    shape = widths(points)
    panes = C.together(points, q, shape)
    counts = C.pane_counts(C.pairs(panes, q, panes.where("flag = 0"), shape), q)
    return C.outlier_counts(C.window_counts(panes, _capped(counts, q, cumulative=False), q), q)


def pmcsky(points: DataFrame, q: QuerySet) -> DataFrame:
    """The skyband of sop after the dense cells of the smallest range, largest k and shortest window."""
    return _pruned(points, q, lambda found: _capped(C.pane_counts(found, q), q, cumulative=True))


def by_value(points: DataFrame, q: QuerySet) -> DataFrame:
    """Values against each other instead of points: for data of which many points share a value, on a lattice for example."""
    return C.detect_by_value(points, q)


STRATEGIES: dict[Algorithm, Strategy] = {
    Algorithm.NAIVE: naive, Algorithm.ADVANCED: advanced, Algorithm.ADVANCED_EXTENDED: advanced_extended, Algorithm.SLICING: slicing, Algorithm.PMCOD: pmcod,
    Algorithm.PMCOD_NET: pmcod_net, Algorithm.AMCOD: amcod, Algorithm.SOP: sop, Algorithm.PSOD: psod, Algorithm.PMCSKY: pmcsky, Algorithm.BY_VALUE: by_value,
}


class Detector(ABC):
    """A user's own strategy: say which spaces it answers, turn points into what it works on, and detect."""

    spaces: frozenset[Space] = frozenset({Space.SINGLE})

    def transform(self, points: DataFrame) -> DataFrame:
        return points

    @abstractmethod
    def detect(self, points: DataFrame, queries: QuerySet) -> DataFrame:
        """(window_end, R, k, w, s, outliers) of the transformed points."""

    def __call__(self, points: DataFrame, queries: QuerySet) -> DataFrame:
        if queries.space not in self.spaces:
            raise UnsupportedSpaceError(f"{type(self).__name__} does not answer {queries.space.value} query sets")
        return self.detect(self.transform(points), queries)


def by_window(function: Callable, schema: str = "R double, k int, outliers long", state: bool = False) -> Strategy:
    """A strategy of a function of one window's points: it gets (window_end, w, pandas table of points) and returns a pandas table of `schema`.

    The window's points come to one task, as the function asks for; the function is called for every due slide. On a stream it
    is called when the watermark passes the window's end. With state=True it also gets a dictionary that lasts from window to
    window of a partition; see streaming.stateful.by_window_with_state.
    """

    def strategy(points: DataFrame, q: QuerySet) -> DataFrame:
        if state:
            from panewise.streaming.stateful import by_window_with_state

            return by_window_with_state(points, q, function, schema)
        if points.isStreaming:
            from panewise.streaming.windows import by_window_stream

            return by_window_stream(points, q, function, schema)
        panes = C.with_panes(points, q)
        rows = C.in_windows(panes.select("id", "value", "arrival", "flag", "pane"), q, "pane", "pane").drop("pane")

        def run(key, table):
            w, end = key
            return function(int(end), int(w), table.drop(columns=["w", "window_end"])).assign(w=int(w), window_end=int(end))

        found = rows.groupBy("w", "window_end").applyInPandas(run, f"{schema}, w long, window_end long")
        slides = F.filter(F.array(*[F.lit(s).cast("long") for s in q.slides]), lambda s: F.col("window_end") % s == 0)
        return found.withColumn("s", F.explode(slides)).select("window_end", "R", "k", "w", "s", F.col("outliers").cast("long").alias("outliers"))

    return strategy
