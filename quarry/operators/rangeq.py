"""Range queries over metric series (TS10-15).

Events are binned at the scrape interval first (map-side partial counts),
then range windows run over *bins* of one series: a 5-minute range at a
10-second step is a 30-bin `rangeBetween` frame, instead of copying each
event into 30 sliding windows.  Rates over bins take the increase inside the
range / range seconds; `rate_extrapolated` evaluates samples of a counter as
the dashboards do, and `instant_grid` reads gauges with a staleness limit.

A series is cut into chunks of `CHUNK_BINS` bins, and a chunk also gets the
last bins of the chunk before, as far as the range reaches back.  A window
then holds one chunk of one series: tasks stay small however long the history
of a busy series is.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.joins import null_safe_join
from quarry.operators.series import DEFAULT_BUCKETS, bin_end, bin_index, binned, le_label


#: A day of 10-second bins.
CHUNK_BINS = 8640
CHUNK, CARRIED = "_chunk", "_carried"


def _chunked(bins: DataFrame, reach: int, chunk_bins: int) -> DataFrame:
    """Rows by bin with their chunk; the last `reach` bins of a chunk come
    again, marked as carried, in the next one."""
    size = max(chunk_bins, reach + 1)
    own = F.floor(F.col("bin") / size).cast("long")
    near_end = F.col("bin") - own * size >= size - reach
    copies = F.array_compact(F.array(
        F.struct(own.alias("c"), F.lit(False).alias("again")),
        F.when(near_end, F.struct((own + 1).alias("c"), F.lit(True).alias("again")))))
    return bins.select("*", F.explode(copies).alias("_at")).select(
        *bins.columns, F.col("_at.c").alias(CHUNK), F.col("_at.again").alias(CARRIED))


def _over_range(bins: DataFrame, labels: Sequence[str], n: int, sums: dict[str, str],
                chunk_bins: int | None = None) -> DataFrame:
    """Adds each of `sums` (new name -> column): the sum over the n bins that
    end at the row's bin."""
    chunked = _chunked(bins, n - 1, chunk_bins or CHUNK_BINS)
    w = Window.partitionBy(*labels, CHUNK).orderBy("bin").rangeBetween(-(n - 1), 0)
    return chunked.withColumns({k: F.sum(v).over(w) for k, v in sums.items()}).where(
        ~F.col(CARRIED)).drop(CHUNK, CARRIED)


def rate_events(events: DataFrame, labels: Sequence[str], range_s: int = 300,
                step_s: int = 10, chunk_bins: int | None = None) -> DataFrame:
    """TS10 (event form): per series and per bin that saw events,
    events in (t - range, t] / range."""
    b = _over_range(binned(events, labels, step_s), labels, range_s // step_s,
                    {"_inc": "inc"}, chunk_bins)
    return b.select(*labels, "bin", bin_end("bin", step_s).alias("step_ts"),
                    (F.col("_inc") / F.lit(float(range_s))).alias("rate"))


def counter_deltas(samples: DataFrame, labels: Sequence[str], value: str = "value",
                   order: str = "bin", chunk_bins: int | None = None) -> DataFrame:
    """Increase between consecutive samples of a cumulative counter; a drop
    means the counter reset, so the increase is the new value itself.

    The sample before the first one of a chunk is the last one of the latest
    chunk before: one row a chunk and series is enough to find it."""
    marks = {k: f"_k{i}" for i, k in enumerate(labels)}
    chunk = F.floor(F.col(order) / (chunk_bins or CHUNK_BINS)).cast("long")
    parts = samples.withColumn(CHUNK, chunk)
    lasts = parts.groupBy(*labels, CHUNK).agg(F.max_by(value, order).alias("_last"))
    before = lasts.withColumn("_before", F.lag("_last").over(
        Window.partitionBy(*labels).orderBy(CHUNK))).select(
        *[F.col(k).alias(m) for k, m in marks.items()], F.col(CHUNK).alias("_c"), "_before")
    same = F.col(CHUNK) == F.col("_c")
    for k, m in marks.items():
        same &= F.col(k).eqNullSafe(F.col(m))
    w = Window.partitionBy(*labels, CHUNK).orderBy(order)
    samples = parts.join(before, same, "left").withColumn(
        "_prev", F.coalesce(F.lag(value).over(w), F.when(
            F.row_number().over(w) == 1, F.col("_before")))).drop(
        CHUNK, "_c", "_before", *marks.values())
    prev = F.col("_prev")
    delta = F.when(prev.isNull(), F.lit(0.0)) \
        .when(F.col(value) < prev, F.col(value).cast("double")) \
        .otherwise((F.col(value) - prev).cast("double"))
    return samples.withColumn("delta", delta).drop("_prev")


def rate_samples(samples: DataFrame, labels: Sequence[str], value: str = "value",
                 range_s: int = 300, step_s: int = 10,
                 chunk_bins: int | None = None) -> DataFrame:
    """TS10 (sample form): reset-aware rate from sampled counter values."""
    d = _over_range(counter_deltas(samples, labels, value, chunk_bins=chunk_bins), labels,
                    range_s // step_s, {"_inc": "delta"}, chunk_bins)
    return d.select(*labels, "bin", value, (F.col("_inc") / F.lit(float(range_s))).alias("rate"))


def success_ratio(events: DataFrame, labels: Sequence[str], status: str = "status",
                  ok_value: str = "success", range_s: int = 300, step_s: int = 10,
                  chunk_bins: int | None = None) -> DataFrame:
    """TS11: rate(success) / rate(all statuses) per series and bin; the
    denominator sums over every status of the series."""
    b = events.groupBy(*labels, bin_index("ts", step_s).alias("bin")).agg(
        F.count_if(F.col(status) == ok_value).alias("ok"), F.count(F.lit(1)).alias("all"))
    b = _over_range(b, labels, range_s // step_s, {"_ok": "ok", "_all": "all"}, chunk_bins)
    return b.select(*labels, "bin", bin_end("bin", step_s).alias("step_ts"),
                    F.try_divide(F.col("_ok").cast("double"),
                                 F.col("_all").cast("double")).alias("ratio"))


def bucket_rate(events: DataFrame, labels: Sequence[str], value: str,
                buckets: Sequence[float] = DEFAULT_BUCKETS, range_s: int = 300,
                step_s: int = 10, chunk_bins: int | None = None) -> DataFrame:
    """TS13: per (labels, bin) the windowed rate of every cumulative bucket,
    in wide form (one `b{i}` column per bound plus `b_inf`)."""
    v = F.col(value)
    b = events.groupBy(*labels, bin_index("ts", step_s).alias("bin")).agg(
        *[F.count_if(v <= F.lit(float(x))).alias(f"b{i}") for i, x in enumerate(buckets)],
        F.count(v).alias("b_inf"))
    cols = [f"b{i}" for i in range(len(buckets))] + ["b_inf"]
    b = _over_range(b, labels, range_s // step_s, {f"_{c}": c for c in cols}, chunk_bins)
    return b.select(*labels, "bin", bin_end("bin", step_s).alias("step_ts"),
                    *[(F.col(f"_{c}") / F.lit(float(range_s))).alias(c) for c in cols])


def bucket_rate_long(wide: DataFrame, labels: Sequence[str],
                     buckets: Sequence[float] = DEFAULT_BUCKETS) -> DataFrame:
    pairs = [F.struct(F.lit(le_label(x)).alias("le"), F.col(f"b{i}").alias("rate"))
             for i, x in enumerate(buckets)]
    pairs.append(F.struct(F.lit("+Inf").alias("le"), F.col("b_inf").alias("rate")))
    return wide.select(*labels, "bin", "step_ts", F.explode(F.array(*pairs)).alias("p")) \
        .select(*labels, "bin", "step_ts", "p.le", "p.rate")


def histogram_quantile(wide: DataFrame, labels: Sequence[str], q: float | Sequence[float],
                       buckets: Sequence[float] = DEFAULT_BUCKETS,
                       names: Sequence[str] | None = None,
                       keep: Sequence[str] = ("bin", "step_ts")) -> DataFrame:
    """TS12: quantile(s) from cumulative bucket rates (wide form of
    `bucket_rate`): rank = q * total; first bucket reaching the rank; linear
    interpolation inside it (lower bound 0 for the first bucket); a rank in
    the +Inf bucket returns the highest finite bound; no data -> NULL.
    Several quantiles are computed in the same projection."""
    qs = [q] if isinstance(q, (int, float)) else list(q)
    names = list(names) if names is not None else (["quantile"] if len(qs) == 1 else
                                                     [f"q{x}" for x in qs])
    bounds = [float(x) for x in buckets]
    arr = F.array(*[F.struct(F.lit(x).alias("le"), F.col(f"b{i}").cast("double").alias("c"))
                    for i, x in enumerate(bounds)],
                  F.struct(F.lit(float("inf")).alias("le"), F.col("b_inf").cast("double").alias("c")))
    total = F.col("b_inf").cast("double")
    # staged columns: each intermediate is computed once per row (a nested
    # expression would repeat the array search for every reference)
    out = wide.withColumn("_arr", arr)
    for i, qv in enumerate(qs):
        rank = F.lit(float(qv)) * total
        out = out.withColumn(f"_idx{i}", F.array_position(
            F.transform(F.col("_arr"), lambda e: e["c"] >= rank), True))  # 1-based
        out = out.withColumn(f"_hit{i}", F.element_at(F.col("_arr"), F.col(f"_idx{i}").cast("int")))
        out = out.withColumn(f"_prev{i}", F.when(F.col(f"_idx{i}") > 1, F.element_at(
            F.col("_arr"), (F.col(f"_idx{i}") - 1).cast("int"))))
    vals = []
    for i, qv in enumerate(qs):
        rank = F.lit(float(qv)) * total
        hit, prev, idx = F.col(f"_hit{i}"), F.col(f"_prev{i}"), F.col(f"_idx{i}")
        lower = F.coalesce(prev["le"], F.lit(0.0))
        prev_c = F.coalesce(prev["c"], F.lit(0.0))
        interp = lower + (hit["le"] - lower) * F.try_divide(rank - prev_c, hit["c"] - prev_c)
        vals.append((F.when(total.isNull() | (total <= 0), F.lit(None).cast("double"))
                     .when(idx == F.lit(len(bounds) + 1), F.lit(bounds[-1]))
                     .otherwise(F.coalesce(interp, hit["le"]))).alias(names[i]))
    return out.select(*labels, *keep, *vals)


def range_grid(events: DataFrame, labels: Sequence[str], as_of, lookback_s: int = 3600,
               step_s: int = 10, range_s: int = 300, chunk_bins: int | None = None) -> DataFrame:
    """TS15: dense evaluation grid: every step in (as_of - lookback, as_of]
    for every series seen in that span, with the event rate over the range
    ending at the step (0 where nothing happened).  The span is a predicate
    on `ts` itself, so it reaches the scan."""
    start_bin = bin_index(as_of - F.make_interval(secs=F.lit(float(lookback_s))), step_s)
    end_bin = bin_index(as_of, step_s)
    n = range_s // step_s
    # series active inside the lookback (or the range before its first step)
    since = as_of - F.make_interval(secs=F.lit(float(lookback_s + range_s + step_s)))
    recent = events.where((F.col("ts") > since) & (bin_index("ts", step_s) > start_bin - n))
    b = binned(recent, labels, step_s)
    series = b.select(*labels).distinct()
    grid = series.select(*labels, F.explode(F.sequence(start_bin - n + 1, end_bin)).alias("bin"))
    dense = null_safe_join(grid, b, [*labels, "bin"], "left").fillna(0, subset=["inc"])
    rated = _over_range(dense, labels, n, {"_inc": "inc"}, chunk_bins).select(
        *labels, "bin", (F.col("_inc") / F.lit(float(range_s))).alias("rate"))
    return rated.where(F.col("bin") > start_bin).select(
        *labels, "bin", bin_end("bin", step_s).alias("step_ts"), "rate")


# --- evaluation grid over samples ---------------------------------------------------

def step_index(ts: Column | str, step_s: int) -> Column:
    """The first evaluation step (a multiple of `step_s` seconds) at or after
    the time: the steps whose range (t - n steps, t] holds it follow it."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.ceil(F.unix_micros(ts) / F.lit(step_s * 1_000_000)).cast("long")


def _grid(bins: DataFrame, labels: Sequence[str], first: Column, last: Column) -> DataFrame:
    """`bins` (labels, bin, ...) on every step from `first` to `last` of every
    series that it holds."""
    series = bins.select(*labels).distinct()
    steps = series.select(*labels, F.explode(F.sequence(first, last)).alias("bin"))
    return null_safe_join(steps, bins, [*labels, "bin"], "left")


def _windowed(dense: DataFrame, labels: Sequence[str], n: int, aggs: dict[str, Column],
              chunk_bins: int | None) -> DataFrame:
    """`_over_range` with any window aggregates."""
    w = Window.partitionBy(*labels, CHUNK).orderBy("bin").rangeBetween(-(n - 1), 0)
    return _chunked(dense, n - 1, chunk_bins or CHUNK_BINS).withColumns(
        {k: a.over(w) for k, a in aggs.items()}).where(~F.col(CARRIED)).drop(CHUNK, CARRIED)


def _span(as_of, lookback_s: int, range_s: int, step_s: int) -> tuple[Column, Column, Column]:
    """(start of the samples that matter, first step, last step) of the steps
    in (as_of - lookback, as_of]."""
    end = F.floor(F.unix_micros(as_of) / F.lit(step_s * 1_000_000)).cast("long")
    start = F.floor(F.unix_micros(as_of) / F.lit(step_s * 1_000_000) - lookback_s / step_s).cast("long") + 1
    since = as_of - F.make_interval(secs=F.lit(float(lookback_s + range_s + step_s)))
    return since, start, end


def _step_ts(step_s: int) -> Column:
    return F.timestamp_micros(F.col("bin") * F.lit(step_s * 1_000_000)).cast("timestamp_ntz")


def instant_grid(samples: DataFrame, labels: Sequence[str], value: str, as_of,
                 lookback_s: int = 3600, step_s: int = 10, stale_s: int = 300,
                 tiebreak: str | None = None, chunk_bins: int | None = None) -> DataFrame:
    """TS14 on the TS15 grid: at every step t in (as_of - lookback, as_of] the
    last sample of each series in (t - stale, t]; a series that has none there
    is absent.  The span is a predicate on `ts`, so it reaches the scan; a step
    of a series holds one sample, and a window one chunk of one series."""
    since, start, end = _span(as_of, lookback_s, stale_s, step_s)
    n = stale_s // step_s
    order = F.struct("ts", tiebreak) if tiebreak else F.struct("ts")
    recent = samples.where((F.col("ts") > since) & (F.col("ts") <= as_of))
    bins = recent.withColumn("bin", step_index("ts", step_s)).groupBy(*labels, "bin").agg(
        F.max_by(F.struct(F.col("ts").alias("ts"), F.col(value).alias("v")), order).alias("_s"))
    dense = _grid(bins, labels, start - n + 1, end)
    seen = _windowed(dense, labels, n, {"_last": F.last("_s", ignorenulls=True)}, chunk_bins)
    return seen.where(F.col("_last").isNotNull() & (F.col("bin") >= start)).select(
        *labels, "bin", _step_ts(step_s).alias("step_ts"), F.col("_last.v").alias(value),
        F.col("_last.ts").alias("sample_ts"))


def rate_extrapolated(samples: DataFrame, labels: Sequence[str], as_of, value: str = "value",
                      lookback_s: int = 3600, range_s: int = 300, step_s: int = 10,
                      chunk_bins: int | None = None) -> DataFrame:
    """TS10 / TS11 / TS13 as the dashboards evaluate them, from samples of a
    cumulative counter (labels, ts, value; one a series and time): at every
    step t in (as_of - lookback, as_of] the increase over the samples in
    (t - range, t], resets counted from zero, carried on to both ends of the
    range, per second.  Towards an end that is 1.1 mean sample distances away
    or more it is carried on half a distance, and towards the start never
    beyond the point where the counter would be zero.  Fewer than two samples
    give no row.

    Steps hold partial sums (first and last sample, count, increase), so a
    range is a window over steps, and a window holds one chunk of a series."""
    since, start, end = _span(as_of, lookback_s, range_s, step_s)
    n = range_s // step_s
    recent = samples.where((F.col("ts") > since) & (F.col("ts") <= as_of)).select(
        *labels, F.unix_micros("ts").alias("us"), F.col(value).cast("double").alias("v"))
    deltas = counter_deltas(recent, labels, "v", "us",
                            (chunk_bins or CHUNK_BINS) * step_s * 1_000_000)
    size = F.lit(step_s * 1_000_000)
    bins = deltas.groupBy(*labels, F.ceil(F.col("us") / size).cast("long").alias("bin")).agg(
        F.min(F.struct("us", "v", "delta")).alias("_a"), F.max("us").alias("_b"),
        F.count("*").alias("_m"), F.sum("delta").alias("_d"))
    seen = _windowed(_grid(bins, labels, start - n + 1, end), labels, n, {
        "_first": F.min("_a"), "_last": F.max("_b"), "_n": F.sum("_m"), "_inc": F.sum("_d")},
        chunk_bins)
    seen = seen.where((F.col("_n") >= 2) & (F.col("bin") >= start))
    sec = F.lit(1e6)
    sampled = (F.col("_last") - F.col("_first.us")) / sec
    to_start = (F.col("_first.us") - (F.col("bin") - n) * size) / sec
    to_end = (F.col("bin") * size - F.col("_last")) / sec
    mean = sampled / (F.col("_n") - 1)
    rise = F.col("_inc") - F.col("_first.delta")
    at = seen.withColumns({"_sampled": sampled, "_rise": rise}).withColumns({
        "_to_start": F.when(to_start >= 1.1 * mean, mean / 2).otherwise(to_start),
        "_to_end": F.when(to_end >= 1.1 * mean, mean / 2).otherwise(to_end),
        "_to_zero": F.when((F.col("_rise") > 0) & (F.col("_first.v") >= 0),
                           F.col("_sampled") * F.col("_first.v") / F.col("_rise"))})
    # least() leaves a NULL out
    whole = F.col("_sampled") + F.least("_to_start", "_to_zero") + F.col("_to_end")
    return at.select(*labels, "bin", _step_ts(step_s).alias("step_ts"),
                     (F.col("_rise") * whole / F.col("_sampled") / F.lit(float(range_s))).alias("rate"))
