"""Percentiles of groups of any size.

The built-in exact percentile keeps every distinct value of a group in one task,
which fails once a provider, a model or the whole table is a group. The exact form
here reads its rows once, into a table of counts per (group, value), and narrows down each
wanted rank over that table, never holding a group:

1. Count per (group, coarse bin). Coarse bins are about 1.1 % wide at any size of the
   values, so a group has some hundreds of them. A running sum over the bins tells which
   bins hold the wanted ranks.
2. Within those bins only, do the same with fine bins, 4,096 to a coarse one.
3. Keep only the values of the fine bins found and walk their running sum.

All steps read the exchange that the counting left. Sums and counts wanted beside the
percentiles ride along from the first step. Several groupings of the same rows, as in
GROUPING SETS, are made from the counts of their finest keys, not from the rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The fine bin of a value: a whole number that never falls as the value rises, by the
# logarithm of its size, 2^18 bins to each doubling; -1076 lies below that of any double
# but 0. Null and not-a-number have bins of their own. 4,096 neighbours make a coarse bin.
FINE_BIN = """case when _v is null then -4611686018427387904 when isnan(_v) then 4611686018427387904
    when _v = 0 then 0L
    else cast(sign(_v) * floor((least(log2(abs(_v)), 1025D) + 1076) * 262144) as bigint) end"""
COARSE_BIN = f"shiftright({FINE_BIN}, 12)"
# Whether a run of _c values, with _before values below it, holds a rank.
HOLDS = "(_before <= {rank} and {rank} < _before + _c)"
RUNNING = "rows between unbounded preceding and current row"


def exact_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    sums: dict[str, Column] | None = None,
    sets: Sequence[Sequence[str]] | None = None,
) -> DataFrame:
    """Per group: linearly interpolated percentiles of `value`, and sums.

    `probs` names the percentiles. `sums` names aggregates that may be added up over
    parts of a group (a count or a sum). Null values are left out of the ranks, not of
    the sums. Without keys the answer has one row, also for no input.

    `sets` names several groupings by some of the keys each. The answer then holds the
    groups of all of them, with the grouping's number as `set` and null for other keys.
    """
    keys, sums = list(keys), sums or {}
    base = [f"_k{i}" for i in range(len(keys))]
    carried = [f"_s{i}" for i in range(len(sums))]
    # Counts are asked for three times. A common table that is not deterministic is planned
    # once, and the condition, which always holds, makes it so.
    counts = (
        df.where(F.spark_partition_id() >= 0)
        .select("*", *[F.col(k).alias(g) for g, k in zip(base, keys)], F.col(value).cast("double").alias("_v"))
        .groupBy(*base, "_v")
        .agg(F.count("_v").alias("_c"), *[c.alias(s) for s, c in zip(carried, sums.values())])
    )
    group = base if sets is None else ["_set", *base]

    def grouped(rows: str, columns: str) -> str:
        """`rows` under the keys of each grouping."""
        if sets is None:
            return f"(select {', '.join([*base, columns])} from {rows})"
        masked = [
            f"if(_set in ({', '.join([str(n) for n, s in enumerate(sets) if k in s] or ['-1'])}), {g}, null) as {g}"
            for g, k in zip(base, keys)
        ]
        numbers = ", ".join(map(str, range(len(sets))))
        return f"(select {', '.join(['_set', *masked, columns])} from {rows} lateral view explode(array({numbers})) _sets as _set)"

    def listed(*columns: str) -> str:
        return ", ".join(columns)

    ranks = {name: f"({p!r}D * (_total - 1))" for name, p in probs.items()}
    ends = [f"{end}({rank})" for rank in ranks.values() for end in ("floor", "ceil")]
    wanted = " or ".join(["_total = 0", *[HOLDS.format(rank=r) for r in ends]])
    facts = ["_before", "_total", *carried]
    sum_each = [f"sum({s}) as {s}" for s in carried]
    by = f"partition by {listed(*group) or '1'}"
    by_group = f"group by {listed(*group)}" if group else ""

    def within(bins: str, bin_column: str, part: str) -> str:
        """The parts of the wanted bins, counted, with _before brought up to each."""
        same = " and ".join(f"r.{c} <=> b.{c}" for c in [*group, bin_column])
        columns = f"_v, _c, {COARSE_BIN} as _coarse, {FINE_BIN} as _fine"
        own = [f"r.{c}" for c in [*group, bin_column, part]]
        over = f"partition by {listed(*group, bin_column)} order by {part} {RUNNING}"
        return f"""select {listed(*group, part, "_c", "_total", *carried)}, _before + sum(_c) over ({over}) - _c as _before
            from (select {listed(*own, *facts)}, sum(r._c) as _c from {grouped("counts", columns)} r join {bins} b on {same}
                group by {listed(*own, *facts)})"""

    bins = "select * from few"
    if sets is not None:
        bins = f"""select {listed(*group, "_coarse", "sum(_c) as _c", *sum_each)}
            from {grouped("few", listed("_coarse", "_c", *carried))} group by {listed(*group, "_coarse")}"""
    at = [f"max(case when {HOLDS.format(rank=r)} then _v end) as _e{i}" for i, r in enumerate(ends)]
    found = counts.sparkSession.sql(
        f"""with counts as (select /*+ repartition({listed(*base, "_v")}) */ * from {{counts}}),
        few as (select {listed(*base, f"{COARSE_BIN} as _coarse", "sum(_c) as _c", *sum_each)} from counts
            group by {listed(*base, f"{COARSE_BIN}")}),
        bins as ({bins}),
        placed as (select {listed(*group, "_coarse", "_c")}, sum(_c) over ({by} order by _coarse {RUNNING}) - _c as _before,
            {listed(f"sum(_c) over ({by}) as _total", *[f"sum({s}) over ({by}) as {s}" for s in carried])} from bins),
        coarse as (select {listed(*group, "_coarse", *facts)} from placed where {wanted}),
        finer as ({within("coarse", "_coarse", "_fine")}),
        fine as (select {listed(*group, "_fine", *facts)} from finer where {wanted}),
        last as ({within("fine", "_fine", "_v")})
        select {listed(*group, *[f"max({c}) as {c}" for c in ["_total", *carried]], *at)} from last {by_group}""",
        counts=counts,
    )
    between = [
        f"if(_e{2 * i} = _e{2 * i + 1}, _e{2 * i}, _e{2 * i} + (_e{2 * i + 1} - _e{2 * i}) * ({r} - floor({r}))) as `{name}`"
        for i, (name, r) in enumerate(ranks.items())
    ]
    return found.selectExpr(
        *(["_set as `set`"] if sets is not None else []),
        *[f"{g} as `{k}`" for g, k in zip(base, keys)],
        *[f"{s} as `{name}`" for s, name in zip(carried, sums)],
        *between,
    )


def in_sets(df: DataFrame, keys: Sequence[str], sets: Sequence[Sequence[str]] | None) -> tuple[DataFrame, list[str]]:
    """Each row once per grouping, and the columns to group by."""
    if sets is None:
        return df, list(keys)
    rows = df.withColumn("set", F.explode(F.array(*[F.lit(n) for n in range(len(sets))])))
    masked = {k: F.when(F.col("set").isin([n for n, s in enumerate(sets) if k in s]), F.col(k)) for k in keys}
    return rows.withColumns(masked), ["set", *keys]


def approximate_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    sums: dict[str, Column] | None = None,
    sets: Sequence[Sequence[str]] | None = None,
    accuracy: int = 10000,
) -> DataFrame:
    """The same answer in one pass with summaries of fixed size: each percentile is a
    value that occurs, its rank off by at most 1/accuracy of the group."""
    df, keys = in_sets(df, keys, sets)
    points = F.percentile_approx(value, list(probs.values()), accuracy).alias("_p")
    return _named(df.groupBy(*keys).agg(points, *_sums(sums)), keys, probs, sums)


def sketch_percentiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    probs: dict[str, float],
    sums: dict[str, Column] | None = None,
    sets: Sequence[Sequence[str]] | None = None,
    k: int = 4000,
) -> DataFrame:
    """The same answer from KLL sketches. `plans.rollups` stores and merges them."""
    df, keys = in_sets(df, keys, sets)
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(k))
    points = F.when(F.count(value) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(list(probs.values()))))
    return _named(df.groupBy(*keys).agg(points.alias("_p"), *_sums(sums)), keys, probs, sums)


def _sums(sums: dict[str, Column] | None) -> list[Column]:
    return [c.alias(name) for name, c in (sums or {}).items()]


def _named(df: DataFrame, keys: Sequence[str], probs: dict[str, float], sums: dict[str, Column] | None) -> DataFrame:
    return df.select(
        *keys, *(sums or {}), *[F.col("_p")[i].cast("double").alias(name) for i, name in enumerate(probs)]
    )


MODES = {"exact": exact_percentiles, "approx": approximate_percentiles, "sketch": sketch_percentiles}


def percentiles(mode: str = "exact"):
    """The percentile form for a mode."""
    if mode not in MODES:
        raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
    return MODES[mode]
