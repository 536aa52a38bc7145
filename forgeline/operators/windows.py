"""Rolling, lag, interpolation and island operators over each machine's time line; none needs a machine in one task.

Frames of time (``rolling_chunked``) are cut by time: rows shortly before a chunk's end are copied to the next one. Frames of rows are cut by
row number: ``ranked`` numbers a machine's rows in two levels (inside chunks of time, then the chunks' counts run on), and ``row_chunks`` gives each
chunk the rows just before it. What has no bound, such as the last known value or a run of nulls, is carried from chunk to chunk as a
summary, one row a chunk. All of this equals one sorted pass over each machine, in any number of tasks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

HOUR = 3_600_000_000
#: Hours and rows of a chunk.
CHUNK_HOURS, CHUNK_ROWS = 168, 4096
#: Rows of a task, where the session's number of shuffle partitions would give larger ones.
TASK_ROWS = 200_000
#: Measures as (column, name in features, has a maximum).
FEATURES = (("temperature_c", "temp", True), ("pressure_bar", "pressure", True), ("voltage_mean_v", "voltage", False), ("rotation_mean_rpm", "rotation", False))


def micros(at: str = "observed_at") -> Column:
    return F.unix_micros(F.col(at))


def line(by: tuple[str, ...] = ("machine_id",), at: str = "observed_at") -> WindowSpec:
    return Window.partitionBy(*by).orderBy(micros(at))


def before(hours: int, by: tuple[str, ...] = ("machine_id",), at: str = "observed_at") -> WindowSpec:
    """The time from ``hours`` before a row up to just before it."""
    return line(by, at).rangeBetween(-hours * HOUR, -1)


def spread(c: Column, w: WindowSpec) -> Column:
    """Sample standard deviation over ``w``; null below two values."""
    return F.when(F.count(c).over(w) >= 2, F.stddev_samp(c).over(w))


def rolling_columns(windows: tuple[int, ...], frame: Callable[[int], WindowSpec], peaks: bool = False, value: Callable[[str], Column] = F.col) -> dict[str, Column]:
    """Rolling mean, deviation and maximum of the measures (``peaks``: of all of them), and the pieces of 24 hours or rows."""
    new = {}
    for h in windows:
        for c, name, peak in FEATURES:
            new |= {f"{name}_mean_{h}h": F.avg(value(c)).over(frame(h)), f"{name}_std_{h}h": spread(value(c), frame(h))}
            if peak or peaks:
                new[f"{name}_max_{h}h"] = F.max(value(c)).over(frame(h))
    return new | {"pieces_produced_sum_24h": F.sum(value("pieces_produced")).over(frame(24))}


def rolling(df: DataFrame, windows: tuple[int, ...] = (6, 12, 24), by: tuple[str, ...] = ("machine_id",)) -> DataFrame:
    """Rolling features over the hours before a row, the current row excluded by time; a machine in one task."""
    return df.withColumns(rolling_columns(windows, lambda h: before(h, by)))


def chunk_of(us: Column, hours: int) -> Column:
    """The number of the chunk of ``hours`` that an instant in microseconds lies in."""
    return F.floor((us - F.pmod(us, F.lit(hours * HOUR))) / (hours * HOUR))


def copied(us: Column, hours: int, chunk_hours: int) -> Column:
    """The chunks of a row that is needed for ``hours`` after it: its own, and the next one if that begins by then."""
    if chunk_hours < hours:
        raise ValueError("a chunk must hold the longest window")
    own = chunk_of(us, chunk_hours)
    return F.when(us >= (own + 1) * chunk_hours * HOUR - hours * HOUR, F.array(own, own + 1)).otherwise(F.array(own))


def rolling_chunked(df: DataFrame, windows: tuple[int, ...] = (6, 12, 24), chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """``rolling`` with each machine cut into chunks of time, so that few machines still give many tasks.

    A row within the longest window before a chunk's end is copied to the next chunk and dropped after the windows.
    """
    places = F.explode(copied(micros(), max(24, *windows), chunk_hours))
    rows = df.withColumn("_own", chunk_of(micros(), chunk_hours)).withColumn("_chunk", places)
    return rolling(rows, windows, ("machine_id", "_chunk")).filter("_own <=> _chunk").drop("_own", "_chunk")


def tasks_for(written: DataFrame) -> int | None:
    """Tasks of ``TASK_ROWS`` rows for a written table, or None where the session's number of shuffle partitions does."""
    tasks = -(-written.count() // TASK_ROWS)
    return tasks if tasks > int(written.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def dealt(df: DataFrame, tasks: int | None, *keys: str | Column) -> DataFrame:
    """``df`` by ``keys`` over ``tasks``, which windows over the keys need no further exchange for; None leaves it to the session."""
    return df.repartition(tasks, *keys) if tasks else df


def with_state(df: DataFrame, keys: list[str], state: DataFrame, names: list[str], tasks: int | None = None) -> DataFrame:
    """``df`` with the columns ``names`` of ``state``, which has a row for each value of ``keys`` at most; null keys are equal.

    State rows travel with the rows of their key and a window spreads them, so windows over ``keys`` need no further exchange.
    """
    own = [c for c in df.columns if c not in keys]
    packed = df.select(*keys, F.struct(*own).alias("_row"))
    both = dealt(packed.unionByName(state.select(*keys, *[F.col(n).alias(f"_s_{n}") for n in names]), allowMissingColumns=True), tasks, *keys)
    whole = Window.partitionBy(*keys)
    spread_out = both.withColumns({f"_v_{n}": F.max(f"_s_{n}").over(whole) for n in names}).filter("_row IS NOT NULL")
    return spread_out.select(*keys, "_row.*", *[F.col(f"_v_{n}").alias(n) for n in names])


def ranked(df: DataFrame, counts: dict[str, Column] | None = None, by: tuple[str, ...] = ("machine_id",), order: tuple[str, ...] = ("observed_at",), chunk_hours: int = CHUNK_HOURS, totals: dict[str, Column] | None = None, tasks: int | None = None) -> DataFrame:
    """``df`` with ``_rank``, the row's number in its machine from 1 on, ``_all``, the machine's rows, and running ``counts`` of conditions.

    In two levels: rows are numbered in chunks of time (by ``order[0]``), and the chunks' counts run on by machine. ``totals`` are sums or counts
    of the whole machine, the same in all its rows.
    """
    counts, totals = counts or {}, totals or {}
    numbers = {n: F.count_if(c) for n, c in counts.items()} | {"_rank": F.count(F.lit(1))}
    keys = [*by, "_part"]
    rows = df.withColumn("_part", chunk_of(F.unix_micros(order[0]), chunk_hours))
    sums = rows.groupBy(*keys).agg(*[c.alias(n) for n, c in (numbers | totals).items()])
    machine = Window.partitionBy(*by)
    so_far = machine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select(*keys, *[F.coalesce(F.sum(n).over(so_far), F.lit(0)).alias(f"_0{n}") for n in numbers], F.sum("_rank").over(machine).alias("_all"), *[F.sum(n).over(machine).alias(n) for n in totals])
    rows = with_state(rows, keys, starts, [*[f"_0{n}" for n in numbers], "_all", *totals], tasks)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumns({n: F.col(f"_0{n}") + c.over(inside) for n, c in numbers.items()}).select(*df.columns, *numbers, "_all", *totals)


def row_chunks(rows: DataFrame, earlier: int, later: int = 0, size: int = CHUNK_ROWS) -> DataFrame:
    """Ranked ``rows`` with ``_own`` and ``_chunk``: chunks of ``size`` rows, each with copies of the rows just before and after it."""
    size = max(size, earlier, later)
    own = F.floor((F.col("_rank") - 1) / size)
    next_one = F.when(F.col("_rank") > (own + 1) * size - earlier, own + 1)
    one_before = F.when((own > 0) & (F.col("_rank") <= own * size + later), own - 1)
    return rows.withColumn("_own", own).withColumn("_chunk", F.explode(F.array_compact(F.array(own, next_one, one_before))))


def over_rows(df: DataFrame, earlier: int, columns: Callable[[WindowSpec], dict[str, Column]], size: int = CHUNK_ROWS, order: tuple[str, ...] = ("observed_at",), later: int = 0, tasks: int | None = None) -> DataFrame:
    """``df`` with ``columns`` of a machine's line of rows, none of which looks further back than ``earlier`` rows or on than ``later``."""
    rows = dealt(row_chunks(ranked(df, order=order, tasks=tasks), earlier, later, size), tasks, "machine_id", "_chunk")
    new = columns(Window.partitionBy("machine_id", "_chunk").orderBy("_rank"))
    return rows.withColumns(new).filter("_own = _chunk").select(*[c for c in df.columns if c not in new], *new)


def rolling_rows(df: DataFrame, windows: tuple[int, ...] = (6, 12, 24), size: int = CHUNK_ROWS) -> DataFrame:
    """Rolling features over the last n rows with the current one, and maxima of all measures."""
    return over_rows(df, max(24, *windows), lambda w: rolling_columns(windows, lambda h: w.rowsBetween(1 - h, 0), peaks=True), size)


def differences(df: DataFrame, size: int = CHUNK_ROWS, tasks: int | None = None) -> DataFrame:
    """Differences to 1, 3 and 6 rows before (rows, not hours)."""
    steps = ((1, "delta_1h"), (3, "delta_3h"), (6, "trend_6h"))
    return over_rows(df, 6, lambda w: {f"{name}_{label}": F.col(c) - F.lag(c, n).over(w) for c, name, _ in FEATURES for n, label in steps}, size, tasks=tasks)


def z_score(c: Column, mean: Column, std: Column) -> Column:
    """Null where the deviation is 0."""
    return (c - mean) / F.nullif(std, F.lit(0.0))


def hour_aggregates(df: DataFrame) -> DataFrame:
    """The features of the hour itself: mean and maximum are the reading, the deviation is null."""
    new = {f"{name}_mean_1h": F.col(c) for c, name, _ in FEATURES}
    new |= {f"{name}_max_1h": F.col(c) for c, name, peak in FEATURES if peak}
    new |= {f"{name}_std_1h": F.lit(None).cast("double") for _, name, peak in FEATURES if peak}
    return df.withColumns(new | {"pieces_produced_sum_1h": F.col("pieces_produced")})


def band(df: DataFrame, columns: list[str], rows: int = 168, least: int = 24, width: float = 2.0, size: int = CHUNK_ROWS) -> DataFrame:
    """For each column: rolling mean and deviation over ``rows`` rows with the current one, from ``least`` values on, and the band around the mean."""

    def of(w: WindowSpec) -> dict[str, Column]:
        w, new = w.rowsBetween(1 - rows, 0), {}
        for c in columns:
            enough, mean, std = F.count(c).over(w) >= least, F.avg(c).over(w), F.stddev_samp(c).over(w)
            new |= {f"{c}_mean": F.when(enough, mean), f"{c}_std": F.when(enough, std)}
        return new

    out = over_rows(df, rows - 1, of, size)
    return out.withColumns({f"{c}_{side}": F.col(f"{c}_mean") + sign * width * F.col(f"{c}_std") for c in columns for side, sign in (("lower", -1), ("upper", 1))})


def interpolate(df: DataFrame, columns: list[str], order: str = "observed_at", by: str = "machine_id", size: int = CHUNK_ROWS) -> DataFrame:
    """Linear interpolation by row position; gaps at either end take the nearest value, all-null stays null.

    Chunks of rows hand on their last and their first known value with its position, each of which runs over the chunks.
    """
    rows = ranked(df, by=(by,), order=(order,)).withColumn("_chunk", F.floor((F.col("_rank") - 1) / size))
    known = {c: F.when(F.col(c).isNotNull(), F.struct(F.col("_rank").alias("n"), F.col(c).cast("double").alias("v"))) for c in columns}
    ends = rows.groupBy(by, "_chunk").agg(*[f(k).alias(f"_{side}_{c}") for c, k in known.items() for side, f in (("first", F.min), ("last", F.max))])
    chunks = Window.partitionBy(by).orderBy("_chunk")
    earlier, later = chunks.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy(by).orderBy(F.desc("_chunk")).rowsBetween(Window.unboundedPreceding, -1)
    carried = {f"_from_{c}": F.last(f"_last_{c}", True).over(earlier) for c in columns} | {f"_to_{c}": F.last(f"_first_{c}", True).over(later) for c in columns}
    rows = with_state(rows, [by, "_chunk"], ends.select(by, "_chunk", *[x.alias(n) for n, x in carried.items()]), list(carried))
    # both directions look back from a row, over rows in either order: a running value, not a frame for each row
    line = Window.partitionBy(by, "_chunk")
    back, ahead = line.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0), line.orderBy(F.desc("_rank")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({f"_a_{c}": F.coalesce(F.last(known[c], True).over(back), F.col(f"_from_{c}")) for c in columns})
    rows = rows.withColumns({f"_b_{c}": F.coalesce(F.last(known[c], True).over(ahead), F.col(f"_to_{c}")) for c in columns})
    filled = {}
    for c in columns:
        a, b = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        inner = a["v"] + (b["v"] - a["v"]) * (F.col("_rank") - a["n"]) / F.nullif(b["n"] - a["n"], F.lit(0))
        filled[c] = F.coalesce(F.col(c).cast("double"), inner, a["v"], b["v"])
    return rows.withColumns(filled).select(*df.columns)


def null_runs(df: DataFrame, columns: list[str]) -> DataFrame:
    """(machine_id, column_name, runs, longest, median_length) of consecutive nulls; each machine for itself.

    A run's rows share the difference of their number and the number of nulls so far, both of which run over chunks. Runs are counted by
    that number and then by length, before anything is shuffled, so that the longest run is a row like any other.
    """
    rows = ranked(df, {f"_null_{c}": F.col(c).isNull() for c in columns})
    at = [F.when(F.col(c).isNull(), F.struct(F.lit(c).alias("column_name"), (F.col("_rank") - F.col(f"_null_{c}")).alias("_run"))) for c in columns]
    runs = rows.select("machine_id", F.explode(F.array_compact(F.array(*at))).alias("_x")).groupBy("machine_id", "_x.column_name", "_x._run").agg(F.count("*").alias("length"))
    keys = ["machine_id", "column_name"]
    lengths = runs.groupBy(*keys, "length").agg(F.count("*").alias("n"))
    group = Window.partitionBy(*keys)
    placed = lengths.withColumns({"_end": F.sum("n").over(group.orderBy("length")), "_all": F.sum("n").over(group)})
    at_rank = lambda r: F.min(F.when(F.col("_end") > r, F.col("length")))
    middle = (at_rank(F.floor((F.col("_all") - 1) / 2)) + at_rank(F.floor(F.col("_all") / 2))) / 2
    return placed.groupBy(*keys).agg(F.sum("n").alias("runs"), F.max("length").alias("longest"), middle.alias("median_length"))


def group_size(df: DataFrame, keys: list[str], name: str = "group_size") -> DataFrame:
    return df.withColumn(name, F.count(F.lit(1)).over(Window.partitionBy(*keys)))


def autocorrelation(df: DataFrame, columns: list[str], lags: int = 48, size: int = CHUNK_ROWS) -> DataFrame:
    """(machine_id, column_name, lag, acf) by row lags with nulls left out; null where the series does not vary.

    Known values are numbered for all columns in one pass over the rows, which also brings each machine's means. Chunks of known values, less
    their mean, each with the ``lags`` values before it, give sums of products that are added up.
    """
    keys = ["machine_id", "column_name"]
    wide = df.select("machine_id", "observed_at", *[F.col(c).cast("double").alias(c) for c in columns])
    totals = {f"_s_{c}": F.sum(c) for c in columns} | {f"_n_{c}": F.count(c) for c in columns}
    rows = ranked(wide, {f"_k_{c}": F.col(c).isNotNull() for c in columns}, totals=totals)
    known = [F.when(F.col(c).isNotNull(), F.struct(F.lit(i).alias("_c"), F.col(f"_k_{c}").alias("_rank"), (F.col(c) - F.col(f"_s_{c}") / F.col(f"_n_{c}")).alias("x"))) for i, c in enumerate(columns)]
    each = rows.select("machine_id", F.explode(F.array_compact(F.array(*known))).alias("_v")).select("machine_id", "_v.*")
    chunks = row_chunks(each, lags, size=size).drop("_own")
    ordered = Window.partitionBy("machine_id", "_c", "_chunk").orderBy("_rank")  # one sort gives all lags
    own = F.floor((F.col("_rank") - 1) / max(size, lags)) == F.col("_chunk")
    pairs = chunks.select("*", *[(F.col("x") * F.lag("x", k).over(ordered)).alias(f"_p{k}") for k in range(1, lags + 1)]).filter(own)
    sums = pairs.groupBy("machine_id", "_c").agg(
        F.count("*").alias("n"), F.sum(F.col("x") * F.col("x")).alias("_p0"), (F.min("x") < F.max("x")).alias("_varies"), *[F.sum(f"_p{k}").alias(f"_p{k}") for k in range(1, lags + 1)]
    )
    lagged = sums.select("machine_id", F.get(F.array(*map(F.lit, columns)), F.col("_c")).alias("column_name"), "n", "_p0", "_varies", F.posexplode(F.array(*[F.col(f"_p{k}") for k in range(lags + 1)])).alias("lag", "_p"))
    return lagged.filter("lag < n").select(*keys, "lag", F.when(F.col("_varies"), F.col("_p") / F.col("_p0")).alias("acf"))
