"""Ranks, offsets, frames and running values of groups of any size.

Spark's window functions take a group's rows in one task. Here rows are sorted into range partitions by
group and order, so that a group is as many tasks' work as it needs. A partition's first group may have
begun in an earlier one; what it has seen there is carried over, a row for each partition and no
more. With positions known, a group is cut into spans of a fixed number of rows, each with as many rows
of its neighbours as a frame needs, and any window function runs within (group, span).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import written

#: Rows of a group that one task takes together.
SPAN = 1 << 16
#: A column to sort by, with its direction if that isn't upwards.
Ordered = Column | tuple[Column, Callable[[Column], Column]]


def _same(a, b) -> bool:
    """Equal as Spark orders values: null and NaN equal themselves."""
    return all(x == y or (x is None and y is None) or (x != x and y != y) for x, y in zip(a, b, strict=True))


def _carried(pieces: list) -> list[tuple]:
    """For each piece (a group's rows in one partition, in order): rows and different values before it, the rank of
    its first value if that began before it, and how many rows of its last value come after it, and all rows.
    pieces: (first value, last value, rows, different values, rows of the first value, rows of the last value)."""
    out, n, d, last, last_rank = [], 0, 0, None, 0
    for first, final, rows, values, _, n_final in pieces:
        goes_on = last is not None and _same(last, first)
        out.append([n, d, last_rank if goes_on else None, 0])
        if values > 1:
            last_rank = n + rows - n_final + 1
        elif not goes_on:
            last_rank = n + 1
        n, d, last = n + rows, d + values - goes_on, final
    for k in range(len(pieces) - 2, -1, -1):
        after = pieces[k + 1]
        if _same(pieces[k][1], after[0]):
            out[k][3] = after[4] + (out[k + 1][3] if after[3] == 1 else 0)
    return [(*x, n) for x in out]


def ranks(df: DataFrame, by: list[str], order: list[Ordered], ties: list[Column] = ()) -> DataFrame:
    """df with _row (row_number), _rank, _dense, _upto (rows up to the last of equal order) and _rows (the group's rows).

    order: columns, or pairs of a column and its direction (lambda x: x.desc(), say); rows equal in it are peers, numbered
    by ties and then by chance. Null keys are a group. df's columns and those of order and ties must not begin with _.
    """
    names = df.columns
    keyed = df.select("*", *([] if by else [F.lit(0).alias("_all")]))
    keys = by or ["_all"]
    values = [f"_v{k}" for k in range(len(order))]
    directions = [c if isinstance(c, tuple) else (c, lambda x: x.asc()) for c in order]
    keyed = keyed.select("*", *(bare.alias(v) for (bare, _), v in zip(directions, values, strict=True)), F.monotonically_increasing_id().alias("_tie"))
    sort = [d(F.col(v)) for (_, d), v in zip(directions, values, strict=True)]
    placed = written(keyed.repartitionByRange(*keys, *sort, *ties, "_tie").withColumn("_part", F.spark_partition_id()), "ranks")
    within = Window.partitionBy(*keys, "_part")
    peers = within.orderBy(*sort)
    local = {"_lrow": F.row_number().over(peers.orderBy(*sort, *ties, "_tie")), "_lrank": F.rank().over(peers), "_ldense": F.dense_rank().over(peers), "_lrows": F.count(F.lit(1)).over(within)}
    local["_lupto"] = F.count(F.lit(1)).over(peers.rangeBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = placed
    for name, column in local.items():
        ranked = ranked.withColumn(name, column)
    carry = _pieces(placed, keys, values, sort)
    match = F.col("_part") == F.col("_in")
    for k in keys:
        match &= F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    ranked = ranked.join(F.broadcast(carry), match, "left")  # two rows a partition at most
    before, dense = F.coalesce("_before", F.lit(0)), F.coalesce("_before_dense", F.lit(0))
    goes_on = F.col("_first_rank").isNotNull()
    return ranked.select(
        *names,
        (before + F.col("_lrow")).cast("long").alias("_row"),
        F.when(goes_on & (F.col("_ldense") == 1), F.col("_first_rank")).otherwise(before + F.col("_lrank")).cast("long").alias("_rank"),
        (dense + F.col("_ldense") - goes_on.cast("int")).cast("long").alias("_dense"),
        (before + F.col("_lupto") + F.when(F.col("_lupto") == F.col("_lrows"), F.coalesce("_more", F.lit(0))).otherwise(0)).cast("long").alias("_upto"),
        F.coalesce("_all_rows", "_lrows").cast("long").alias("_rows"),
    )


def _pieces(placed: DataFrame, keys: list[str], values: list[str], sort: list[Column]) -> DataFrame:
    """What is carried into each partition for groups that lie in several: _in (partition), the group, and _carried()'s."""
    spark, group = placed.sparkSession, F.struct(*keys)
    edges = placed.groupBy("_part").agg(F.min(group).alias("lo"), F.max(group).alias("hi"))
    ends = edges.select(F.col("lo").alias("g"), "_part").unionByName(edges.select(F.col("hi").alias("g"), "_part"))
    several = ends.distinct().groupBy("g").agg(F.count(F.lit(1)).alias("parts")).filter("parts > 1").select("g")
    mine = F.lit(True)
    for k in keys:
        mine &= F.col(k).eqNullSafe(F.col(f"g.{k}"))
    rows = placed.join(F.broadcast(several), mine, "left_semi")  # a partition ends in one group: as many as partitions at most
    value = F.struct(*values)
    runs = rows.groupBy(*keys, "_part", *values).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys, "_part").orderBy(*sort)
    runs = runs.withColumn("_at", F.row_number().over(w))
    folded = runs.groupBy(*keys, "_part").agg(
        F.min_by(value, "_at").alias("first"), F.max_by(value, "_at").alias("last"), F.sum("_n").alias("n"), F.count(F.lit(1)).alias("d"), F.min_by("_n", "_at").alias("n_first"), F.max_by("_n", "_at").alias("n_last")
    )
    by_group: dict[tuple, list] = {}
    for r in folded.collect():  # two rows a partition at most
        by_group.setdefault(tuple(repr(r[k]) for k in keys), []).append(r)
    out = []
    for found in by_group.values():
        found.sort(key=lambda r: r["_part"])
        told = _carried([(tuple(r["first"]), tuple(r["last"]), r["n"], r["d"], r["n_first"], r["n_last"]) for r in found])
        out += [(r["_part"], *(r[k] for k in keys), *t) for r, t in zip(found, told, strict=True)]
    schema = placed.select(F.col("_part").alias("_in"), *(F.col(k).alias(f"_k_{k}") for k in keys)).schema
    for name in ("_before", "_before_dense", "_first_rank", "_more", "_all_rows"):
        schema = schema.add(name, "long")
    return spark.createDataFrame(out, schema)


def ntile(n: int) -> Column:
    """ntile(n) of a row of ranks(): the first tiles hold one row more where n doesn't divide the group."""
    size, more = F.floor(F.col("_rows") / F.lit(n)), F.col("_rows") % n
    row, wide = F.col("_row") - 1, F.col("_rows") % n * (F.floor(F.col("_rows") / F.lit(n)) + 1)
    return F.when(row < wide, F.floor(row / (size + 1))).otherwise(more + F.floor((row - wide) / F.greatest(size, F.lit(1)))).cast("long") + 1


def percent_rank() -> Column:
    return F.when(F.col("_rows") > 1, (F.col("_rank") - 1) / (F.col("_rows") - 1)).otherwise(0.0)


def cume_dist() -> Column:
    return F.col("_upto") / F.col("_rows")


def spans(df: DataFrame, by: list[str], order: list[Ordered], size: int = SPAN, before: int = 0, after: int = 0, ties: list[Column] = ()) -> DataFrame:
    """df's rows with _row (place in the group, from 1), _rows, _span (each has size rows of a group) and _own.

    A span also gets the last `before` rows of the one before it and the first `after` rows of the next one, with
    _own false: a window by (by, _span) in the order of _row gives every own row the frame that a window by the
    group gives it, as long as the frame reaches no further. before and after: size at most."""
    if max(before, after) > size:
        raise ValueError("a frame must not reach beyond the neighbours of its span")
    placed = ranks(df, by, order, ties).drop("_rank", "_dense", "_upto")
    at, last = (F.col("_row") - 1) % size, F.floor((F.col("_rows") - 1) / F.lit(size))
    own = F.floor((F.col("_row") - 1) / F.lit(size))
    shares = F.array(
        F.struct(own.alias("span"), F.lit(True).alias("own")),
        F.when((at >= size - before) & (own < last), F.struct((own + 1).alias("span"), F.lit(False).alias("own"))),
        F.when((at < after) & (own > 0), F.struct((own - 1).alias("span"), F.lit(False).alias("own"))),
    )
    dealt = placed.withColumn("_share", F.explode(F.array_compact(shares) if before or after else F.slice(shares, 1, 1)))
    return dealt.select(*placed.columns, F.col("_share.span").alias("_span"), F.col("_share.own").alias("_own"))


def carried(rows: DataFrame, by: list[str], totals: dict[str, Column] = {}, lasts: dict[str, Column] = {}, firsts: dict[str, tuple[Column, int]] = {}) -> DataFrame:
    """rows (of spans()) with what their group knew before their span: sums of totals, the last value that isn't
    null of lasts, and the value at the nth row of the group of firsts (of the whole group, not only before).

    It is computed from one row for each span and joined by (group, span), so no task gets a group.
    """
    own = rows.filter("_own")
    aggs = [F.sum(c).alias(n) for n, c in totals.items()]
    aggs += [F.max_by(F.when(c.isNotNull(), c), F.when(c.isNotNull(), F.col("_row"))).alias(n) for n, c in lasts.items()]
    aggs += [F.max(F.when(F.col("_row") == at, F.struct(c.alias("x")))).alias(n) for n, (c, at) in firsts.items()]
    by_span = own.groupBy(*by, "_span").agg(F.count(F.lit(1)).alias("_n"), *aggs)
    group = Window.partitionBy(*by)
    earlier = group.orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    told = by_span.select(
        *(F.col(c).alias(f"_k_{c}") for c in by),
        F.col("_span").alias("_s"),
        *(F.sum(n).over(earlier).alias(n) for n in totals),
        *(F.last(n, ignorenulls=True).over(earlier).alias(n) for n in lasts),
        *(F.max(n).over(group)["x"].alias(n) for n in firsts),
    )
    match = F.col("_span") == F.col("_s")
    for c in by:
        match &= F.col(c).eqNullSafe(F.col(f"_k_{c}"))
    return rows.join(told, match, "left").drop("_s", *(f"_k_{c}" for c in by))


def time_spans(df: DataFrame, by: list[str], at: Column, width: int, before: int) -> DataFrame:
    """df with _at (at as a whole number), _span (at in steps of width) and _own: a row also goes to each later span
    that begins within `before` of it, so that a window by (by, _span) with a range frame that reaches back
    no further is whole for every own row. Rows whose at is null are a span of their own. How many rows a task gets depends on
    how many fall into width, not on how many a group has."""
    rows = df.withColumn("_at", at.cast("long"))
    first = F.floor(F.col("_at") / F.lit(width))
    last = F.floor((F.col("_at") + before) / F.lit(width))
    rows = rows.withColumn("_first", first).withColumn("_span", F.explode_outer(F.sequence("_first", last)))
    return rows.withColumn("_own", F.col("_span").eqNullSafe(F.col("_first"))).drop("_first")
