"""Joins: lookups by first match, ranges, distances, nearest points, polygons."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import col
from ..sources.scratch import materialise


def natural_join(a: DataFrame, b: DataFrame, how: str = "inner") -> DataFrame:
    """Join on all columns that both tables have."""
    return a.join(b, [c for c in a.columns if c in b.columns], how)


def join_all(tables, on) -> DataFrame:
    return reduce(lambda a, b: a.join(b, on), tables)


#: Rows of a roster that a task pairs with all of it, rows of the other side in one array, and the largest roster that is broadcast.
PAIR_ROWS, STRETCH, ROSTER = 250, 1000, 2_000_000


def small(roster: DataFrame, rows: int | None = None) -> DataFrame:
    """A roster, marked for a broadcast unless it has more than ``ROSTER`` rows."""
    return F.broadcast(roster) if (roster.count() if rows is None else rows) <= ROSTER else roster


def lookup(df: DataFrame, dim: DataFrame, key: str, dim_key: str, order: str, columns: dict[str, str]) -> DataFrame:
    """Left join of the first match: of a key's rows in ``dim`` the one least by ``order``; ``columns``: dim column -> new name."""
    picked = dim.groupBy(F.col(dim_key).alias("__key")).agg(*[F.min_by(c, order).alias(n) for c, n in columns.items()])
    return df.join(picked, F.col(key) == F.col("__key"), "left").drop("__key")


def double_lookup(pairs: DataFrame, dim: DataFrame, keys: tuple[str, str], dim_key: str, order: str, column: str) -> DataFrame:
    """Look both ends of a pair up: ``<column>_1``, ``<column>_2``; the pairs stay where they are if the roster is small."""
    dim = dim.groupBy(dim_key).agg(F.min_by(column, order).alias(column))
    rows = dim.count()
    for k, key in enumerate(keys, 1):
        pairs = pairs.join(small(dim.select(F.col(dim_key).alias("__key"), F.col(column).alias(f"{column}_{k}")), rows), F.col(key) == F.col("__key"), "left").drop("__key")
    return pairs


def all_pairs(ids: DataFrame, id_col: str, *, diagonal: bool = False, both: bool = False, columns=(), stretches: bool = True) -> DataFrame:
    """All unordered pairs of a set of samples, or with ``both`` all ordered ones (quadratic by definition: for rosters, not for corpora).

    One side is dealt to tasks by id, ``PAIR_ROWS`` rows each, the other is broadcast in stretches of about ``STRETCH`` ids in
    order: a task holds the roster and hands on the pairs of a row and a stretch at a time. Stretches that lie before a row
    are not looked at. Without ``stretches`` (for columns that hold arrays themselves, and for rosters too large to broadcast)
    it is a plain join.
    """
    ids = ids.where(F.col(id_col).isNotNull())
    rows = ids.count()
    tasks = max(1, -(-rows // PAIR_ROWS))
    a = ids.select(F.col(id_col).alias("id1"), *[F.col(c).alias(f"{c}_1") for c in columns]).repartition(tasks, "id1")
    b = ids.select(F.col(id_col).alias("id2"), *[F.col(c).alias(f"{c}_2") for c in columns])
    if both:
        wanted = F.lit(True) if diagonal else F.col("id1") != F.col("id2")
    else:
        wanted = (F.col("id1") <= F.col("id2")) if diagonal else (F.col("id1") < F.col("id2"))
    if rows > ROSTER or not stretches:
        return a.join(small(b, rows), wanted)
    dealt = b.repartitionByRange(max(1, -(-rows // STRETCH)), "id2").withColumn("__stretch", F.spark_partition_id())
    many = dealt.groupBy("__stretch").agg(F.collect_list(F.struct(*b.columns)).alias("__rows"), F.max("id2").alias("__last")).drop("__stretch")
    met = a.join(F.broadcast(many), F.lit(True) if both else F.col("id1") <= F.col("__last"))
    # coalesce moves nothing here; without it Spark makes all pairs of a row before it hands the first one on
    return met.coalesce(tasks).select(*a.columns, F.inline("__rows")).where(wanted)


def looked_up_pairs(ids: DataFrame, id_col: str, dim: DataFrame, dim_key: str, order: str, column: str, *, columns=(), **kind) -> DataFrame:
    """``all_pairs`` with both ends looked up, as ``double_lookup`` does: once for each sample, not once for each pair."""
    dim = dim.groupBy(F.col(dim_key).alias("__key")).agg(F.min_by(column, order).alias("__found"))
    found = ids.join(small(dim), F.col(id_col) == F.col("__key"), "left").drop("__key")
    ends = all_pairs(found, id_col, columns=[*columns, "__found"], **kind)
    return ends.withColumnsRenamed({"__found_1": f"{column}_1", "__found_2": f"{column}_2"})


def to_symmetric(pairs: DataFrame, value: str = "value") -> DataFrame:
    """Both orders of each pair; the diagonal once."""
    flipped = pairs.where("id1 <> id2").select(F.col("id2").alias("id1"), F.col("id1").alias("id2"), value)
    return pairs.select("id1", "id2", value).unionByName(flipped)


def _buckets(x: str, y: str, size: float, reach: int = 0):
    bx, by = F.floor(F.col(x) / size), F.floor(F.col(y) / size)
    if not reach:
        return F.struct(bx.alias("bx"), by.alias("by"))
    around = [F.struct((bx + i).alias("bx"), (by + j).alias("by")) for i in range(-reach, reach + 1) for j in range(-reach, reach + 1)]
    return F.explode(F.array(*around))


def within_distance(a: DataFrame, b: DataFrame, radius: float, *, a_cols=("a_id", "ax", "ay"), b_cols=("b_id", "bx", "by"), keep=()) -> DataFrame:
    """Pairs within ``radius``, with the squared distance: an equi-join on squares of that size and their neighbours.

    ``keep``: columns of either table that a pair keeps.
    """
    (ai, ax, ay), (bi, bx, by) = a_cols, b_cols
    more = lambda df, own: [F.col(c) for c in keep if c in df.columns and c not in own]
    left = a.select(F.col(ai), F.col(ax), F.col(ay), *more(a, a_cols)).withColumn("__sq", _buckets(ax, ay, radius))
    # merged: Spark would broadcast a table whose file is small, however many rows its squares have
    right = b.select(F.col(bi), F.col(bx), F.col(by), *more(b, b_cols)).withColumn("__sq", _buckets(bx, by, radius, 1)).hint("merge")
    d2 = (F.col(ax) - F.col(bx)) * (F.col(ax) - F.col(bx)) + (F.col(ay) - F.col(by)) * (F.col(ay) - F.col(by))
    return left.join(right, "__sq").withColumn("d2", d2).where(F.col("d2") <= radius * radius).select(ai, bi, "d2", *keep)


def points_in_polygons(points: DataFrame, edges: DataFrame, *, band: float = 1.0) -> DataFrame:
    """``id, polygon`` for each polygon that holds a point (even-odd rule); ``edges``: polygon, x1, y1, x2, y2.

    Edges are dealt to bands of y, and meet only the points of their band.
    """
    low, high = F.floor(F.least("y1", "y2") / band), F.floor(F.greatest("y1", "y2") / band)
    banded = edges.withColumn("__band", F.explode(F.sequence(low, high)))
    placed = points.select("id", "x", "y").withColumn("__band", F.floor(F.col("y") / band))
    straddles = (F.col("y1") > F.col("y")) != (F.col("y2") > F.col("y"))
    left_of = F.col("x") < (F.col("x2") - F.col("x1")) * (F.col("y") - F.col("y1")) / F.nullif(F.col("y2") - F.col("y1"), F.lit(0.0)) + F.col("x1")
    return placed.join(banded, "__band").where(straddles & left_of).groupBy("id", "polygon").agg(F.count("*").alias("n")).where("n % 2 = 1").select("id", "polygon")


def segment_cells(segments: DataFrame, *, unit: int = 1024) -> DataFrame:
    """``id, row, col`` of every cell that holds a point of a straight segment (x1, y1) to (x2, y2), ends included.

    A cell holds its lower sides and not its upper ones, so a segment through a corner touches the cell of the corner alone.
    Coordinates are taken to the nearest ``1 / unit``; from there on all is in whole numbers: for each column that a segment
    crosses, the rows between its heights at the column's sides. Products must fit 64 bits.

    Cases: a segment of no length has one cell; segments with a null have none; repeated ids are put together.
    """
    whole = lambda c: F.round(F.col(c) * unit).cast("long")
    s = segments.where("x1 is not null and y1 is not null and x2 is not null and y2 is not null").select("id", *[whole(c).alias(c) for c in ("x1", "y1", "x2", "y2")])
    turn = F.col("x1") > F.col("x2")
    ends = [F.when(turn, F.col(b)).otherwise(F.col(a)).alias(a) for a, b in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))]
    s = s.select("id", *ends).withColumns({"dx": F.col("x2") - F.col("x1"), "dy": F.col("y2") - F.col("y1")})
    below = lambda a, b: F.expr(f"(({a}) div ({b})) - if(({a}) % ({b}) < 0, 1, 0)")  # noqa: E731  floor for b > 0
    column = s.withColumn("col", F.explode(F.sequence(below("x1", f"{unit}L"), below("x2", f"{unit}L"))))
    # heights times dx at the sides of a column's part; the right side is out unless the segment ends there
    left, right = f"greatest(col * {unit}L, x1)", f"least((col + 1) * {unit}L, x2)"
    height = lambda x: f"(y1 * dx + ({x} - x1) * dy)"
    low = F.when(F.col("dx") == 0, below("least(y1, y2)", f"{unit}L")).when(F.col("dy") >= 0, below(height(left), f"(greatest(dx, 1L) * {unit}L)")).otherwise(below(height(right), f"(greatest(dx, 1L) * {unit}L)"))
    out = F.expr(f"x2 >= (col + 1) * {unit}L")
    last = F.when(out & (F.col("dy") > 0), below(f"{height(right)} - 1", f"(greatest(dx, 1L) * {unit}L)")).otherwise(below(height(right), f"(greatest(dx, 1L) * {unit}L)"))
    high = F.when(F.col("dx") == 0, below("greatest(y1, y2)", f"{unit}L")).when(F.col("dy") >= 0, last).otherwise(below(height(left), f"(greatest(dx, 1L) * {unit}L)"))
    rows = column.select("id", "col", low.alias("low"), high.alias("high"))
    return rows.select("id", F.explode(F.sequence("low", F.greatest("low", "high"))).alias("row"), "col").distinct()


def best_overlap(a: DataFrame, b: DataFrame, cell: str = "cell") -> DataFrame:
    """For each region of ``a(cell, child)`` the region of ``b(cell, parent)`` that shares most cells (least id among equals)."""
    shared = a.join(b, cell).groupBy("child", "parent").agg(F.count("*").alias("n"))
    return shared.groupBy("child").agg(F.max_by("parent", F.struct(F.col("n"), -F.col("parent"))).alias("parent"), F.max("n").alias("cells"))


def flag_outliers(df: DataFrame, value: str, by: list[str], limit: float = 2.0) -> DataFrame:
    """Adds ``outlier``: farther from the group's median than ``limit`` scaled median deviations (factor 1.4826)."""
    middle = df.groupBy(*by).agg(F.median(value).alias("__med"))
    with_m = df.join(middle, by)
    spread = with_m.groupBy(*by).agg(F.median(F.abs(F.col(value) - F.col("__med"))).alias("__mad"))
    out = with_m.join(spread, by)
    return out.withColumn("outlier", F.abs(F.col(value) - F.col("__med")) > limit * 1.4826 * F.col("__mad")).drop("__med", "__mad")


def ranked(df: DataFrame, *order, out: str = "place") -> DataFrame:
    """The table with each row's place, from 1, in an order without ties.

    Rows are dealt by ranges of the order to many tasks and written; a task numbers its own and adds the counts of those before.
    """
    dealt = materialise(df.repartitionByRange(*order).withColumn("__task", F.spark_partition_id()), "ranked")
    before = Window.orderBy("__task").rowsBetween(Window.unboundedPreceding, -1)  # a row a task
    sizes = dealt.groupBy("__task").agg(F.count("*").alias("__n")).select("__task", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__task").orderBy(*order))
    return dealt.withColumn("__own", own).join(F.broadcast(sizes), "__task").withColumn(out, F.col("__own") + F.col("__before")).drop("__task", "__own", "__before")


def first_level(df: DataFrame, key: str, order: str) -> DataFrame:
    """Level number of each key by first appearance."""
    return ranked(df.groupBy(key).agg(F.min(order).alias("first")), "first", key, out="level")


def replace_in_fields(df: DataFrame, fields, old: str, new: str) -> DataFrame:
    """Replace a text in every listed string column."""
    return df.withColumns({f: F.replace(col(f), F.lit(old), F.lit(new)) for f in fields})


def coalesce_labels(df: DataFrame, labels: list[tuple[DataFrame, str]], key: str, default: str) -> Column | DataFrame:
    """Label rows by membership in lists; later lists override earlier ones."""
    out = df.withColumn("label", F.lit(default))
    for ids, name in labels:
        marked = ids.select(F.col(key)).distinct().withColumn("__hit", F.lit(True))
        out = out.join(marked, key, "left").withColumn("label", F.when(F.col("__hit"), name).otherwise(F.col("label"))).drop("__hit")
    return out
