"""Exact quantiles by distributed radix selection, and running sums over a sorted column, with no holder of all values.

A double is read as the 64-bit number of its bits, which sorts like it. Values are counted by the number's upper bits, for all groups and all
wanted ranks together; only bins that hold a wanted rank are counted again by the next bits, and so on to the last one. Counts are added up
before they are shuffled, so one value that is repeated very often is one row, and no window orders more than 2^22 bins. Each
level reads the values once more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the number that lie below the bins of each level.
LEVELS = (42, 21, 0)
#: Fixed values of doubles: bits of the fraction, the least exponent, and what is added to exponents.
FRACTION, LEAST, BIAS = 52, -1022, 1023


def with_order_key(df: DataFrame, x: str, name: str) -> DataFrame:
    """``df`` with the double column ``x`` as a long that sorts like it: 0.0 and -0.0 alike, NaN above infinity, null for null.

    In steps of a projection each, so that no step's expression is repeated in the next one.
    """
    one, last = f"{float(1 << FRACTION)!r}D", (2 * BIAS + 1) << FRACTION
    low, high = f"(_s < 1 AND _e > {LEAST})", "(_s >= 2)"
    e, scaled = f"CASE WHEN {low} THEN _e - 1 WHEN {high} THEN _e + 1 ELSE _e END", f"CASE WHEN {low} THEN _s * 2 WHEN {high} THEN _s / 2 ELSE _s END"
    steps = (
        # the logarithm may be rounded over a whole number, which the last step puts right
        f"least(greatest(coalesce(floor(log2(abs(`{x}`))), {LEAST}L), {LEAST}L), {BIAS}L) AS _e",
        f"abs(`{x}`) / pow(2D, CAST(_e AS DOUBLE)) AS _s",  # 1 up to 2 but for rounding; below 1 for the smallest numbers
        f"CASE WHEN isnan(`{x}`) THEN {last + 1}L WHEN abs(`{x}`) = double('infinity') THEN {last}L ELSE ({e} + {BIAS - 1}L) * {1 << FRACTION}L + CAST({scaled} * {one} AS LONG) END AS _w",
        f"CASE WHEN `{x}` < 0 THEN -_w ELSE _w END AS `{name}`",
    )
    for step in steps:
        df = df.selectExpr("*", step)
    return df.drop("_e", "_s", "_w")


def joined(left: DataFrame, right: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Inner join on ``keys``, nulls being equal, without the right ones; ``few``: the right side is bounded and broadcast."""
    right = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(F.broadcast(right) if few else right, on).drop(*[f"_r_{k}" for k in keys])


def quantiles(values: DataFrame, keys: list[str], shares: tuple[float, ...], few: bool, value: str = "value") -> DataFrame:
    """(keys, n, q: array<double>): the quantiles of ``value`` at ``shares`` with linear interpolation, in their order.

    Nulls count for nothing, and a group without values gives no row. ``few``: the caller knows that the groups are few (one
    for each column, sensor or split), so that the bins that are looked into can be broadcast; else both sides are shuffled.
    """
    by = [f"`{k}`" for k in keys]
    x = with_order_key(values.filter(F.col(value).isNotNull()).select(*keys, F.col(value).cast("double").alias("_x")), "_x", "_k")
    at = [f"{float(q)!r}D * (_total - 1)" for q in shares]
    places = [f"named_struct('place', {2 * i + up}, 'rank', CAST({f}({h}) AS LONG), 'part', {h} - floor({h}), 'n', _total)" for i, h in enumerate(at) for up, f in enumerate(("floor", "ceil"))]
    all_bins = f"OVER (PARTITION BY {', '.join(by)})" if by else "OVER ()"
    up_to = lambda *parents: f"OVER ({'PARTITION BY ' + ', '.join(parents) if parents else ''} ORDER BY _child)"
    inside, above = None, None  # bins that hold a wanted rank, as _bin and _want: (place, rank in the bin, fraction, n)
    for level in LEVELS:
        if inside is None:
            counted = x.groupBy(*keys, F.shiftright("_k", level).alias("_child")).agg(F.count("*").alias("_n"))
            placed = counted.selectExpr("*", f"sum(_n) {all_bins} AS _total", f"sum(_n) {up_to(*by)} AS _end").selectExpr("*", f"array({', '.join(places)}) AS _want")
        else:
            rows = joined(x.selectExpr("*", f"shiftright(_k, {above}) AS _bin", f"shiftright(_k, {level}) AS _child"), inside, [*keys, "_bin"], few)
            counted = rows.groupBy(*keys, "_bin", "_want", "_child").agg(F.count("*").alias("_n"), F.min("_x").alias("_x"))
            placed = counted.selectExpr("*", f"sum(_n) {up_to(*by, '_bin')} AS _end")
        here = "transform(filter(_want, w -> w.rank >= _end - _n AND w.rank < _end), w -> named_struct('place', w.place, 'rank', w.rank - (_end - _n), 'part', w.part, 'n', w.n))"
        held = placed.selectExpr(*by, "_child AS _bin", f"{here} AS _want", *(["_x"] if level == LEVELS[-1] else []))
        inside, above = held.filter("size(_want) > 0"), level
    pick = lambda p, c: f"max(CASE WHEN _w.place = {p} THEN {c} END)"
    mixed = [f"CASE WHEN {pick(2 * i, '_w.part')} = 0 THEN {pick(2 * i, '_x')} ELSE {pick(2 * i, '_x')} * (1 - {pick(2 * i, '_w.part')}) + {pick(2 * i + 1, '_x')} * {pick(2 * i, '_w.part')} END" for i in range(len(shares))]
    each = inside.select(*keys, "_x", F.explode("_want").alias("_w"))
    return each.groupBy(*keys).agg(F.expr("max(_w.n) AS n"), F.expr(f"array({', '.join(mixed)}) AS q")).filter("n IS NOT NULL")


def running_sums(df: DataFrame, key: str, sums: dict[str, str]) -> DataFrame:
    """Sums of all rows up to each one by ``key`` (a long, unique), the row included; ``sums`` maps a new column to the summed one.

    In three levels like the quantiles: bins among themselves, then inside their parents, so no task orders all rows.
    """
    rows = df.withColumns({f"_b{i}": F.shiftright(key, level) for i, level in enumerate(LEVELS[:-1])})
    for i, parent in enumerate((None, "_b0")):
        bins = rows.groupBy(*([parent] if parent else []), f"_b{i}").agg(*[F.sum(c).alias(f"_t_{n}") for n, c in sums.items()])
        before = (Window.partitionBy(parent) if parent else Window.partitionBy()).orderBy(f"_b{i}").rowsBetween(Window.unboundedPreceding, -1)
        starts = bins.select(f"_b{i}", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_s{i}_{n}") for n in sums])
        rows = rows.join(starts, f"_b{i}")
    inner = Window.partitionBy("_b1").orderBy(key)
    out = rows.withColumns({n: F.sum(c).over(inner) + F.col(f"_s0_{n}") + F.col(f"_s1_{n}") for n, c in sums.items()})
    return out.select(*df.columns, *sums)
