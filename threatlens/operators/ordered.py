"""Ordered (running and sliding) computations that survive hot keys.

A plain ``Window.partitionBy(key)`` puts every row of a key into one task. Here the rows are dealt into
range partitions by (key, order), which Spark balances by sampling the rows themselves, so a partition is
as large as any other however the times of a key or the values of a column crowd. Each key's part of a
range partition is a window partition of its own. A border between two partitions cuts one key at most, so
what earlier partitions contribute is a table of at most one row per partition, and it is broadcast.

Rows that share key and instant are first counted in cells (key, instant, slice of the id), so a single
busy instant is spread as well. Order within a key is (instant, slice, id), where the slice is the first
two hex digits of the id's MD5. All keys must be non-null. ``parts`` sets the number of range partitions;
the session's number of shuffle partitions is the default.
"""

from __future__ import annotations

from functools import partial
from math import ceil, floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import discard, fresh_folder, settle, settle_parts, sliced, store

SLICE = "_slice"
PART = "_part"


def tie_slice(tie: str) -> Column:
    return F.substring(F.md5(F.col(tie).cast("string")), 1, 2)


def ranged(df: DataFrame, order: list[Column], parts: int | None = None) -> DataFrame:
    """The rows dealt into range partitions, numbered in order by ``_part``; stored."""
    dealt = df.repartitionByRange(*([parts] if parts else []), *order)
    return settle(dealt.withColumn(PART, F.spark_partition_id()), "ranged")


def _over(keys: list[str], *order: Column):
    return Window.partitionBy(*keys).orderBy(*order)


def running(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    sums: dict[str, Column] | None = None,
    maxima: dict[str, Column] | None = None,
    least_ahead: dict[str, Column] | None = None,
    inclusive: bool = True,
    descending: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Adds running sums and maxima of the key's rows up to (``inclusive``) or before each row in order, and
    the least value of the rows from it on (``least_ahead``). Sums without rows are 0, the others null."""
    sums, maxima, least_ahead = sums or {}, maxima or {}, least_ahead or {}
    ahead = [F.col(c).desc() if descending else F.col(c).asc() for c in order]
    back = [F.col(c).asc() if descending else F.col(c).desc() for c in order]
    values = {**sums, **maxima, **least_ahead}
    dealt = df.withColumns({f"_v_{n}": c for n, c in values.items()})
    dealt = ranged(dealt, [*[F.col(k) for k in keys], *ahead], parts)

    part = [*keys, PART]
    upto = 0 if inclusive else -1
    before = _over(part, *ahead).rowsBetween(Window.unboundedPreceding, upto)
    # Running over the reversed order keeps the look ahead linear.
    after = _over(part, *back).rowsBetween(Window.unboundedPreceding, upto)
    own = {f"_i_{n}": F.sum(f"_v_{n}").over(before) for n in sums}
    own |= {f"_i_{n}": F.max(f"_v_{n}").over(before) for n in maxima}
    own |= {f"_i_{n}": F.min(f"_v_{n}").over(after) for n in least_ahead}

    whole = dealt.groupBy(*part).agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in sums],
        *[F.max(f"_v_{n}").alias(f"_t_{n}") for n in maxima],
        *[F.min(f"_v_{n}").alias(f"_t_{n}") for n in least_ahead],
    )
    earlier = _over(keys, F.col(PART)).rowsBetween(Window.unboundedPreceding, -1)
    later = _over(keys, F.col(PART).desc()).rowsBetween(Window.unboundedPreceding, -1)
    cut = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    others = whole.select(
        *part, cut.alias("_cut"),
        *[F.sum(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in sums],
        *[F.max(f"_t_{n}").over(earlier).alias(f"_o_{n}") for n in maxima],
        *[F.min(f"_t_{n}").over(later).alias(f"_o_{n}") for n in least_ahead],
    ).where("_cut > 1").drop("_cut")
    zero = F.lit(0)
    out = {n: F.coalesce(f"_o_{n}", zero) + F.coalesce(f"_i_{n}", zero) for n in sums}
    out |= {n: F.greatest(f"_o_{n}", f"_i_{n}") for n in maxima}
    out |= {n: F.least(f"_o_{n}", f"_i_{n}") for n in least_ahead}
    return dealt.withColumns(own).join(F.broadcast(others), part, "left").select(
        *[dealt[c] for c in df.columns if c not in out], *[c.alias(n) for n, c in out.items()]
    )


def prefix_sums(
    df: DataFrame, keys: list[str], at: str, tie: str, values: dict[str, Column], parts: int | None = None
) -> DataFrame:
    """Adds, per value, its sum over the rows of the key strictly before the row (0 if none)."""
    names = list(values)
    rows = df.withColumn(SLICE, tie_slice(tie)).withColumns({f"_v_{n}": values[n] for n in names})
    cell_key = [*keys, at, SLICE]
    cells = rows.groupBy(*cell_key).agg(*[F.sum(f"_v_{n}").alias(f"_c_{n}") for n in names])
    cells = running(
        cells, keys, [at, SLICE], {f"_pc_{n}": F.col(f"_c_{n}") for n in names}, inclusive=False, parts=parts
    ).select(*cell_key, *[f"_pc_{n}" for n in names])
    in_cell = (
        Window.partitionBy(*cell_key).orderBy(tie).rowsBetween(Window.unboundedPreceding, -1)
    )
    for n in names:
        rows = rows.withColumn(f"_r_{n}", F.coalesce(F.sum(f"_v_{n}").over(in_cell), F.lit(0)))
    joined = rows.join(cells, cell_key)
    return joined.select(
        *df.columns, *[(F.col(f"_pc_{n}") + F.col(f"_r_{n}")).alias(n) for n in names]
    )


def rolling_counts(
    df: DataFrame,
    keys: list[str],
    at: str,
    tie: str,
    widths: dict[str, int],
    include_left: bool = False,
    parts: int | None = None,
) -> DataFrame:
    """Adds, per width, how many rows of the key up to and including this one lie in (t-w, t].

    With ``include_left`` the window is [t-w, t]. Rows are counted one after another, so a row
    does not see later rows of its own instant. Each cell arrives at its instant and leaves the
    window one width later; the count is the running balance of arrivals and departures, which is
    linear in the rows whatever the width holds.
    """
    spans = {n: w + (1 if include_left else 0) for n, w in widths.items()}
    names = list(spans)
    rows = df.withColumn(SLICE, tie_slice(tie))
    cell_key = [*keys, at, SLICE]
    cells = rows.groupBy(*cell_key).agg(F.count(F.lit(1)).alias("_n"))

    def move(pos: Column, kind: int, sign: int, only: str | None = None):
        deltas = [(F.col("_n") * F.lit(sign if only in (None, n) else 0)).alias(f"d_{n}") for n in names]
        return F.struct(pos.alias("pos"), F.lit(kind).alias("kind"), *deltas)

    # At one instant departures come before arrivals.
    moves = [move(F.col(at), 2, 1), *[move(F.col(at) + F.lit(spans[n]), 1, -1, n) for n in names]]
    events = cells.withColumn("_m", F.explode(F.array(*moves))).select(*cell_key, "_n", "_m.*")
    balance = running(
        events, keys, ["pos", "kind", at, SLICE], {f"_s_{n}": F.col(f"d_{n}") for n in names}, parts=parts
    )
    before = balance.where("kind = 2").select(
        *cell_key, *[(F.col(f"_s_{n}") - F.col("_n")).alias(f"_s_{n}") for n in names]
    )
    place = F.row_number().over(Window.partitionBy(*cell_key).orderBy(tie))
    joined = rows.withColumn("_place", place).join(before, cell_key)
    return joined.select(
        *df.columns, *[(F.col(f"_s_{n}") + F.col("_place")).alias(n) for n in names]
    )


def rolling_max_level(
    df: DataFrame, key: str, at: str, level: str, top: int, width: int, name: str, parts: int | None = None
) -> DataFrame:
    """Adds the largest ``level`` (0..top) of the key in (t-w, t], rows of the same instant included.

    Per instant only the largest level is kept. The rolling maximum is the greatest level whose
    latest instant is still inside the window, so one running pass suffices. ``df`` is stored first: it is
    read twice, and what leads up to it is computed once. A large table is worked on in slices of keys.
    """
    folder = fresh_folder(df.sparkSession, "levels")
    df = store(df, folder)
    slices = sliced(df, key)
    if len(slices) == 1:
        return _max_level(df, key, at, level, top, width, name, parts)
    whole = settle_parts(
        df.sparkSession, [partial(_max_level, some, key, at, level, top, width, name, parts) for some in slices], "levels"
    )
    discard(df.sparkSession, folder)
    return whole


def _max_level(
    df: DataFrame, key: str, at: str, level: str, top: int, width: int, name: str, parts: int | None
) -> DataFrame:
    instants = df.where(F.col(at).isNotNull() & F.col(key).isNotNull()).groupBy(key, at).agg(F.max(level).alias("_lvl"))
    latest = {f"_at_{k}": F.when(F.col("_lvl") >= k, F.col(at)) for k in range(1, top + 1)}
    found = running(instants, [key], [at], maxima=latest, parts=parts)
    largest = F.lit(0)
    for k in range(1, top + 1):
        largest = F.when(F.col(f"_at_{k}") > F.col(at) - F.lit(width), F.lit(k)).otherwise(largest)
    return df.join(found.select(key, at, largest.alias(name)), [key, at], "left")


def cumulative_by_value(
    counts: DataFrame,
    value: str,
    sums: list[str],
    groups: list[str] | None = None,
    descending: bool = True,
    following: list[str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Running totals ``cum_*`` of ``sums`` in value order, for a table with one row per value.

    ``following`` adds ``next_*``: the column of the next value (null for the last one).
    """
    following, groups = following or [], groups or []
    # The row after a row is the first one in the reversed order: values are distinct.
    nearer = F.negative(value) if descending else F.col(value)
    cum = running(
        counts, groups, [value], {f"cum_{s}": F.col(s) for s in sums}, descending=descending, parts=parts
    )
    if not following:
        return cum
    ahead = running(
        counts.select(*groups, value, *following), groups, [value],
        least_ahead={"_next": F.struct(nearer.alias("v"), *following)}, inclusive=False,
        descending=descending, parts=parts,
    ).select(*groups, value, *[F.col(f"_next.{c}").alias(f"next_{c}") for c in following])
    return cum.join(ahead, [*groups, value])


#: Precision of the quantile sketch (the rank of what it returns is off by one part in so many), and the number of
#: values between two bounds that are taken as they are.
SKETCH_PARTS, FEW_VALUES = 1000, 50_000


def order_statistics(
    values: DataFrame, ranks: dict[str, set[int]], counts: dict[str, int], parts: int = SKETCH_PARTS, few: int = FEW_VALUES
) -> dict[tuple[str, int], float]:
    """The value of each rank (from 0) of each column, exactly.

    A mergeable sketch gives two values close to each wanted rank; counting what lies below, on and between them tells
    whether one of them is the answer, and otherwise which open interval holds it. That interval is looked at again
    until few values are left. Each round is two aggregates of bounded size.
    """
    found: dict[tuple[str, int], float] = {}
    # Open interval that holds the rank, values before it, values in it.
    open_ = {(c, r): (None, None, 0, counts[c]) for c, wanted in ranks.items() for r in wanted}

    def inside(c: str, low: float | None, high: float | None) -> Column:
        held = F.col(c).isNotNull()
        held = held if low is None else held & (F.col(c) > low)
        return held if high is None else held & (F.col(c) < high)

    while wide := [k for k, (_, _, _, n) in open_.items() if n > few]:
        sketches = []
        for i, (c, r) in enumerate(wide):
            low, high, before, n = open_[c, r]
            place, margin = (r - before) / max(n - 1, 1), 2.0 / parts
            shares = F.expr(f"array({max(0.0, place - margin):.12f}D, {min(1.0, place + margin):.12f}D)")
            sketches.append(F.percentile_approx(F.when(inside(c, low, high), F.col(c)), shares, parts).alias(f"s{i}"))
        bounds = values.agg(*sketches).first()
        sums = []
        for i, (c, r) in enumerate(wide):
            low, high, _, _ = open_[c, r]
            a, b = bounds[f"s{i}"]
            for name, part in (
                ("lt", inside(c, low, a)), ("on", F.col(c) == a), ("mid", inside(c, a, b)), ("top", F.col(c) == b)
            ):
                sums.append(F.count_if(part).alias(f"{name}{i}"))
        seen = values.agg(*sums).first()
        for i, (c, r) in enumerate(wide):
            low, high, before, n = open_.pop((c, r))
            a, b = bounds[f"s{i}"]
            below, on = seen[f"lt{i}"], seen[f"on{i}"]
            mid, top = (seen[f"mid{i}"], seen[f"top{i}"]) if a < b else (0, 0)
            at = r - before - below
            if at < 0:
                open_[c, r] = (low, a, before, below)
            elif at < on:
                found[c, r] = a
            elif at < on + mid:
                open_[c, r] = (a, b, before + below + on, mid)
            elif at < on + mid + top:
                found[c, r] = b
            else:
                upto = below + on + mid + top
                open_[c, r] = (b, high, before + upto, n - upto)
    if open_:
        lists = values.agg(*[
            F.sort_array(F.collect_list(F.when(inside(c, low, high), F.col(c)))).alias(f"l{i}")
            for i, ((c, _), (low, high, _, _)) in enumerate(open_.items())
        ])
        row = lists.select(*[
            F.get(f"l{i}", F.lit(r - before)).alias(f"v{i}") for i, ((_, r), (_, _, before, _)) in enumerate(open_.items())
        ]).first()
        found.update({k: row[f"v{i}"] for i, k in enumerate(open_)})
    return found


def exact_quantiles(df: DataFrame, columns: list[str], *qs: float) -> DataFrame:
    """(column, q, quantile): exact quantiles with linear interpolation between order statistics.

    No value is exchanged by itself and nothing is sorted as a whole. Nulls and NaN take no part; a column without
    values has no row. ``df`` is read two times or more, by its size: pass a stored table.
    """
    names = {f"c{i}": c for i, c in enumerate(columns)}
    values = df.select(*[
        F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double")).alias(n) for n, c in names.items()
    ])
    counts = values.agg(*[F.count(n).alias(n) for n in names]).first().asDict()
    places = {(n, q): q * (counts[n] - 1) for n in names for q in qs if counts[n]}
    ranks: dict[str, set[int]] = {}
    for (n, _), place in places.items():
        ranks.setdefault(n, set()).update((floor(place), ceil(place)))
    found = order_statistics(values, ranks, counts)
    rows = []
    for (n, q), place in places.items():
        low, high = found[n, floor(place)], found[n, ceil(place)]
        rows.append((names[n], float(q), low + (high - low) * (place - floor(place))))
    return df.sparkSession.createDataFrame(rows, "column string, q double, quantile double")
