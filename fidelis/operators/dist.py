"""Distribution comparison.

KS plan (exact, scale-safe): both sides are counted per ``(feature, value)``, first in every task by
sorting the columns of ``COUNT_ROWS`` rows at a time (a value that holds a third of all rows becomes ONE entry), then
in ranges of (feature, value) that spread every feature over many tasks; a range returns where its cumulated shares differ
most either way, the totals of earlier ranges make these counts global, and ``D = max |F_r - F_c|``.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fidelis import config
from fidelis.functions.columns import clean, ks_p_value, quality_band
from fidelis.operators.frames import attach, bucketed_running, long_form, packed, quantile_columns, unpacked

TEST_COLUMNS = ["test_name", "feature", "passed", "statistic", "threshold", "p_value"]


def _sides_long(real: DataFrame, candidate: DataFrame, features: list[str]) -> DataFrame:
    a = long_form(real, features).withColumn("_side", F.lit(0))
    b = long_form(candidate, features).withColumn("_side", F.lit(1))
    return a.unionByName(b)


#: Rows whose values a task sorts and counts together.
COUNT_ROWS = 1 << 17


#: Values of a feature that a range should hold, and sampled rows a range for where the ranges end.
RANGE_ROWS = 1 << 18
SAMPLED = 256


def value_counts(real: DataFrame, candidate: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value, na, nb): how often each side holds each value; null and NaN are no values."""
    totals = _totals(real, candidate, features)

    def added(t: pa.Table) -> pa.Table:
        value, a, b = _merged(t)
        return pa.table([pa.array([t.column("feature")[0].as_py()] * len(value), pa.string()), pa.array(value), pa.array(a), pa.array(b)], names=["feature", "value", "na", "nb"])

    dealt = _dealt([real, candidate], features, _range_ends(real, candidate, features, totals))
    return dealt.groupBy("feature", "range").applyInArrow(added, "feature string, value double, na bigint, nb bigint")


def _totals(real: DataFrame, candidate: DataFrame, features: list[str]) -> dict[str, tuple[int, int]]:
    """How many values each side has of each feature."""
    one = [df.agg(F.lit(k).alias("_side"), *[F.count(clean(F.col(f"`{f}`").cast("double"))).alias(f"_{i}") for i, f in enumerate(features)]) for k, df in enumerate((real, candidate))]
    a, b = sorted(one[0].unionByName(one[1]).collect(), key=lambda r: r["_side"])  # a row a side
    return {f: (a[f"_{i}"], b[f"_{i}"]) for i, f in enumerate(features)}


def _range_ends(real: DataFrame, candidate: DataFrame, features: list[str], totals: dict[str, tuple[int, int]]) -> list[np.ndarray]:
    return _ends_of([real, candidate], features, max((a + b for a, b in totals.values()), default=0))


def _ends_of(sides: list[DataFrame], features: list[str], most: int) -> list[np.ndarray]:
    """Per feature (of ``most`` values) the values where its ranges end, from a sample: they only say how even the ranges are."""
    ranges = -(-most // RANGE_ROWS)
    if ranges < 2:
        return [np.zeros(0) for _ in features]
    share = min(1.0, SAMPLED * ranges / most)
    cols = [clean(F.col(f"`{f}`").cast("double")).alias(f"_{i}") for i, f in enumerate(features)]
    row = _sampled(sides, cols, share).agg(*[F.percentile_approx(f"_{i}", [k / ranges for k in range(1, ranges)]).alias(f"_{i}") for i in range(len(features))]).first()  # ranges - 1 numbers a feature
    return [np.unique(np.array(q if q else [], np.float64) + 0.0) for q in row]


def _sampled(sides: list[DataFrame], cols: list[Column], share: float) -> DataFrame:
    """About ``share`` of the rows; as a filter, which goes below the projections that make the columns, so only these rows are computed."""
    parts = [df.where(F.rand(k) < share).select(*cols) for k, df in enumerate(sides, 1)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _dealt(sides: list[DataFrame], features: list[str], ends: list[np.ndarray], only: list[list[int]] | None = None) -> DataFrame:
    """(feature, range, side, held, times): a task sorts and counts the columns of ``COUNT_ROWS`` rows at a time and cuts
    the counts where the ranges end, one packed row each; the rows of one side, feature and range hold ascending values.
    With ``only`` each feature's values of these ranges."""
    def counted(side: int):
        def flush(held: list[np.ndarray]):
            for i, f in enumerate(features if held else ()):
                x = np.concatenate([m[:, i] for m in held])
                x = x[~np.isnan(x)] + 0.0  # no negative zero
                if only is not None:
                    x = x[_within(x, ends[i], only[i])]
                x = np.sort(x)
                first = np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)
                value, n = x[first], np.diff(np.r_[first, len(x)]).astype(np.int32)
                bounds = np.r_[0, np.searchsorted(value, ends[i], side="right"), len(value)]
                full = np.flatnonzero(np.diff(bounds))
                at = np.r_[bounds[full], len(value)].astype(np.int32)
                packed = [pa.Array.from_buffers(pa.binary(), len(full), [None, pa.py_buffer(at * np.int32(v.itemsize)), pa.py_buffer(v)]) for v in (value, n)]
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(full), pa.string()), pa.array(full.astype(np.int32)), pa.array(np.full(len(full), side, np.int32)), *packed],
                                                 names=["feature", "range", "side", "held", "times"])

        def batches(it):
            held: list[np.ndarray] = []
            for b in it:
                held.append(unpacked(b.column(0), len(features)))
                if sum(map(len, held)) >= COUNT_ROWS:
                    yield from flush(held)
                    held = []
            yield from flush(held)
        return batches

    parts = [df.select(packed([F.col(f"`{f}`").cast("double") for f in features]).alias("_values"))
             .mapInArrow(counted(k), "feature string, range int, side int, held binary, times binary") for k, df in enumerate(sides)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _within(x: np.ndarray, ends: np.ndarray, ranges: list[int]) -> np.ndarray:
    """Which values lie in one of the ranges (each holds its end)."""
    out = np.zeros(len(x), bool)
    for r in ranges:
        out |= (x > ends[r - 1] if r else True) & (x <= ends[r] if r < len(ends) else True)
    return out


def _merged(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ascending values of a range, and how often each side holds them."""
    held = [np.frombuffer(x) for x in t.column("held").to_pylist()]
    times = np.concatenate([np.frombuffer(x, np.int32) for x in t.column("times").to_pylist()]).astype(np.int64)
    side = np.repeat(t.column("side").to_numpy(), [len(x) for x in held])
    value = np.concatenate(held)
    order = np.argsort(value, kind="stable")  # merges ascending runs
    value, times, side = value[order], times[order], side[order]
    first = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
    return value[first], np.add.reduceat(times * (side == 0), first), np.add.reduceat(times * (side == 1), first)


def column_quantiles(df: DataFrame, features: list[str], probs: dict[str, float]) -> DataFrame:
    """(feature, one column per prob): exact linear-interpolation quantiles as of ``frames.exact_quantiles``, features without values left out.

    A first pass counts the values of every range of a feature; then only the ranges that hold an asked rank
    are sorted and shuffled.  The driver sees a count a feature and range, and two values a quantile."""
    ends = _ends_of([df], features, df.count())

    def counted(it):
        n = [np.zeros(len(e) + 1, np.int64) for e in ends]
        for b in it:
            m = unpacked(b.column(0), len(features))
            for i, e in enumerate(ends):
                x = m[:, i]
                n[i] += np.bincount(np.searchsorted(e, x[~np.isnan(x)] + 0.0), minlength=len(e) + 1)
        for i, k in enumerate(n):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(k), i, np.int32)), pa.array(np.arange(len(k), dtype=np.int32)), pa.array(k)], names=["feature", "range", "n"])

    wide = df.select(packed([F.col(f"`{f}`").cast("double") for f in features]).alias("_values"))
    sizes = [np.zeros(len(e) + 1, np.int64) for e in ends]
    for r in wide.mapInArrow(counted, "feature int, range int, n bigint").groupBy("feature", "range").agg(F.sum("n").alias("n")).collect():  # a row a feature and range
        sizes[r["feature"]][r["range"]] = r["n"]
    asked: dict[tuple[str, int], list[tuple[int, int]]] = {}  # (rank, rank within the range), from 0
    for f, size in zip(features, sizes):
        upto = np.cumsum(size)
        for p in probs.values() if upto[-1] else ():
            h = (int(upto[-1]) - 1) * float(p)
            for rank in {math.floor(h), math.ceil(h)}:
                at = int(np.searchsorted(upto, rank, side="right"))
                asked.setdefault((f, at), []).append((rank, rank - int(upto[at] - size[at])))

    def picked(t: pa.Table) -> pa.Table:
        f = t.column("feature")[0].as_py()
        value, n, _ = _merged(t)
        ranks = asked[f, t.column("range")[0].as_py()]
        found = value[np.searchsorted(np.cumsum(n), [local for _, local in ranks], side="right")]
        return pa.table([pa.array([f] * len(ranks), pa.string()), pa.array([rank for rank, _ in ranks], pa.int64()), pa.array(found)], names=["feature", "rank", "value"])

    dealt = _dealt([df], features, ends, [[r for g, r in asked if g == f] for f in features])
    held = {(r["feature"], r["rank"]): r["value"] for r in dealt.groupBy("feature", "range").applyInArrow(picked, "feature string, rank bigint, value double").collect()}  # two rows a quantile
    rows = []
    for f, size in zip(features, sizes):
        if size.sum():
            places = [(int(size.sum()) - 1) * float(p) for p in probs.values()]
            lows, highs = ([held[f, to(h)] for h in places] for to in (math.floor, math.ceil))
            rows.append((f, *[lo + (h - math.floor(h)) * (hi - lo) for h, lo, hi in zip(places, lows, highs)]))
    return df.sparkSession.createDataFrame(rows, "feature string, " + ", ".join(f"`{c}` double" for c in probs))


def ks_statistics(real: DataFrame, candidate: DataFrame, features: list[str]) -> DataFrame:
    """(feature, statistic, n_a, n_b, gap) as of ``_ks_of_counts``, without a row a value.

    The totals of a feature are counted first; then a range needs no others to know where, within itself, the difference of the
    two cumulated shares is greatest and least, whatever went before it.  It returns the counts up to those two places
    and its own, and the counts of earlier ranges (few rows a feature) make them global."""
    totals = _totals(real, candidate, features)

    def extremes(t: pa.Table) -> pa.Table:
        feature = t.column("feature")[0].as_py()
        _, a, b = _merged(t)
        a, b = np.cumsum(a), np.cumsum(b)
        n_a, n_b = totals[feature]
        apart = a / max(n_a, 1) - b / max(n_b, 1)
        hi, lo = int(apart.argmax()), int(apart.argmin())
        return pa.table([pa.array([feature], pa.string()), t.column("range").slice(0, 1).combine_chunks(),
                         *[pa.array([int(x)], pa.int64()) for x in (a[-1], b[-1], a[hi], b[hi], a[lo], b[lo])]], names=["feature", "range", "na", "nb", "hi_a", "hi_b", "lo_a", "lo_b"])

    dealt = _dealt([real, candidate], features, _range_ends(real, candidate, features, totals))
    ranges = dealt.groupBy("feature", "range").applyInArrow(extremes, "feature string, range int, na bigint, nb bigint, hi_a bigint, hi_b bigint, lo_a bigint, lo_b bigint")
    whole = Window.partitionBy("feature")  # over the ranges of a feature, not its values
    before = whole.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranges.select("*", F.sum("na").over(whole).alias("n_a"), F.sum("nb").over(whole).alias("n_b"),
                           *[F.coalesce(F.sum(f"n{c}").over(before), F.lit(0)).alias(f"off_{c}") for c in "ab"])
    places = F.array(*[F.struct(*[(F.col(f"{x}_{c}") + F.col(f"off_{c}")).alias(f"cum_n{c}") for c in "ab"]) for x in ("hi", "lo")])
    run = ranges.select("feature", "n_a", "n_b", F.explode(places).alias("at"))
    return _ks_of_running(run.select("feature", "n_a", "n_b", "at.*"))


#: Sides of up to so many rows get the exact p-value.
EXACT_ROWS = 10_000


def _ks_core(u: DataFrame) -> DataFrame:
    """``u``: (feature, value, _side in {0,1}) -> (feature, statistic, n_a, n_b, gap), see ``_ks_of_counts``."""
    return _ks_of_counts(u.groupBy("feature", "value").agg(F.count_if(F.col("_side") == 0).alias("na"),
                                                           F.count_if(F.col("_side") == 1).alias("nb")))


def _ks_of_counts(counts: DataFrame) -> DataFrame:
    """``counts``: (feature, value, na, nb) -> (feature, statistic, n_a, n_b, gap); ``gap`` is
    the statistic times n_a n_b, a whole number, where both sides are small (else null)."""
    run = bucketed_running(counts, ["feature"], "value", ["na", "nb"], totals=True)
    return _ks_of_running(run.withColumnRenamed("total_na", "n_a").withColumnRenamed("total_nb", "n_b"))


def _ks_of_running(j: DataFrame) -> DataFrame:
    # an empty side has no distribution: the statistic is NULL, not an ANSI division error
    d = F.abs(F.try_divide(F.col("cum_na"), F.col("n_a")) - F.try_divide(F.col("cum_nb"), F.col("n_b")))
    small = (F.greatest("n_a", "n_b") <= EXACT_ROWS) & (F.least("n_a", "n_b") > 0)
    gap = F.max(F.when(small, F.abs(F.col("cum_na") * F.col("n_b") - F.col("cum_nb") * F.col("n_a"))))
    return j.groupBy("feature", "n_a", "n_b").agg(F.max(d).alias("statistic"), gap.alias("gap"))


def exact_ks_tail(n: int, m: int, gap: int) -> float:
    """The chance that two samples of one continuous distribution, ``n`` and ``m`` rows, differ by
    ``gap / (n m)`` or more: the share of lattice paths from (0, 0) to (n, m) that reach |i m - j n| >= gap.

    A path through (i, j) came from (i - 1, j) with chance i / (i + j), so the share that has
    touched the border so far follows from the two points before it.  Diagonals i + j = s are
    vectors; shares of touched paths are added up, so small tails keep their digits.
    """
    return float(exact_ks_tails(np.array([n]), np.array([m]), np.array([gap]))[0])


#: Points of a diagonal that are walked together.
WALK = 1 << 16


def exact_ks_tails(n: np.ndarray, m: np.ndarray, gap: np.ndarray) -> np.ndarray:
    """``exact_ks_tail`` of many tests: their diagonals are rows of one matrix, of each only the band |i m - j n| < gap
    (beyond it every path has touched)."""
    out = np.ones(len(n))
    width = np.minimum(n, 2 * (gap // (n + m)) + 2) + 3
    order = np.lexsort((width, n + m))[::-1]
    order = order[gap[order] > 0]
    lo = 0
    while lo < len(order):
        hi = lo + 1
        while hi < len(order) and (hi + 1 - lo) * int(width[order[lo: hi + 1]].max()) <= WALK and 2 * (n + m)[order[hi]] > (n + m)[order[lo]]:
            hi += 1
        at = order[lo: hi]
        out[at] = _walk(n[at].astype(np.int64)[:, None], m[at].astype(np.int64)[:, None], gap[at].astype(np.int64)[:, None], int(width[at].max()))
        lo = hi
    return out


def _walk(n: np.ndarray, m: np.ndarray, gap: np.ndarray, width: int) -> np.ndarray:
    """Tests (rows, the longest walk first) walk their diagonals at once; place 0 of a row stands for i = ``base``."""
    steps = (n + m)[:, 0]
    out = np.ones(len(n))
    offset = np.arange(width)
    base = np.zeros((len(n), 1), np.int64)
    touched = np.zeros((len(n), width + 2))
    touched[:, 1:-1] = np.abs(offset * (m + n)) >= gap  # the diagonal 0 has the point i = 0 alone
    live = len(n)
    for s in range(1, int(steps.max()) + 1):
        # |i m - (s - i) n| < gap: i starts above (s n - gap) / (n + m)
        start = np.maximum((s * n[:live] - gap[:live]) // (n[:live] + m[:live]), np.maximum(0, s - m[:live]))
        move = start - base[:live]  # 0 or 1 (more only where a side ends)
        i = start + offset
        before = np.take_along_axis(touched[:live], np.minimum(offset + move, width + 1), 1)  # i - 1 on the diagonal before
        same = np.take_along_axis(touched[:live], np.minimum(offset + move + 1, width + 1), 1)
        share = (i * before + (s - i) * same) / s
        share[(np.abs(i * m[:live] - (s - i) * n[:live]) >= gap[:live]) | (i > np.minimum(s, n[:live]))] = 1.0  # the border, and no points
        touched[:live, 1:-1] = share
        touched[:live, 0] = 1.0  # below the band
        touched[:live, -1] = 1.0
        base[:live] = start
        done = np.flatnonzero(steps[:live] == s)
        if len(done):
            place = n[done, 0] - base[done, 0]
            out[done] = np.where(place < width, share[done, np.minimum(place, width - 1)], 1.0)
            live = int(done[0])
    return np.minimum(out, 1.0)


def with_p_value(ks: DataFrame) -> DataFrame:
    """``ks`` (one row a test) with ``p_value``: exact for small sides, the Kolmogorov series beyond.

    The tests are small rows with much work each (n m steps at most), so they are dealt to
    ``spark.sql.shuffle.partitions`` tasks whatever their bytes; a task counts the paths of its own tests together."""
    parts = int(ks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    series = ks.withColumn("p_value", ks_p_value("statistic", "n_a", "n_b")).repartition(parts, "feature")

    def batches(it):
        for b in it:
            small = np.flatnonzero(b.column("gap").is_valid().to_numpy(zero_copy_only=False))
            p = b.column("p_value").to_pylist()
            for at, x in zip(small.tolist(), exact_ks_tails(*(b.column(c).take(pa.array(small)).to_numpy() for c in ("n_a", "n_b", "gap"))).tolist()):
                p[at] = x
            yield b.set_column(b.schema.get_field_index("p_value"), "p_value", pa.array(p, pa.float64()))

    return series.mapInArrow(batches, series.schema)


def ks_two_sample(real: DataFrame, candidate: DataFrame, features: list[str],
                  threshold: float = config.KS_THRESHOLD, details: bool = True) -> DataFrame:
    """T1 + T2 + T3: per feature KS statistic, passed iff ``statistic < threshold``,
    p-value (exact for sides of up to ``EXACT_ROWS`` rows), and (``details``) mean / std (n-1) of both sides."""
    ks = with_p_value(ks_statistics(real, candidate, features))
    out = ks.select("feature", F.col("statistic"), (F.col("statistic") < F.lit(threshold)).alias("passed"),
                    F.lit(float(threshold)).alias("threshold"), "p_value",
                    F.col("n_a").alias("n_real"), F.col("n_b").alias("n_candidate"))
    if details:
        sides = attach(real.agg(*moment_aggs(features, "r_")), candidate.agg(*moment_aggs(features, "c_")))  # one row
        mom = sides.select(F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f"r_m{i}").alias("real_mean"), F.col(f"c_m{i}").alias("candidate_mean"),
                                                        F.col(f"r_s{i}").alias("real_std"), F.col(f"c_s{i}").alias("candidate_std")) for i, f in enumerate(features)])).alias("m")).select("m.*")
        out = out.join(mom, "feature", "left")
    return out


def ks_by_group(real: DataFrame, candidate: DataFrame, group: str, feature: str, threshold: float = config.KS_THRESHOLD) -> DataFrame:
    """T1 + T2 of one feature within every value of ``group`` that both sides have: (group, n_real,
    n_candidate, statistic, passed, p_value)."""
    sides = [df.select(F.col(f"`{group}`").alias("feature"), clean(F.col(f"`{feature}`").cast("double")).alias("value"), F.lit(k).alias("_side")) for k, df in enumerate((real, candidate))]
    u = sides[0].unionByName(sides[1]).where(F.col("value").isNotNull() & F.col("feature").isNotNull())
    ks = with_p_value(_ks_core(u).where(F.col("statistic").isNotNull()))
    return ks.select(F.col("feature").alias(group), F.col("n_a").alias("n_real"), F.col("n_b").alias("n_candidate"), "statistic", (F.col("statistic") < threshold).alias("passed"), "p_value")


def ks_by_class(df: DataFrame, label: str, features: list[str], notable: float = 0.3, k: int | None = 10) -> DataFrame:
    """T4: KS of positives vs negatives per feature; ``notable`` if statistic > 0.3,
    ``***`` if p < 0.001; ranked by statistic (top ``k``)."""
    ks = with_p_value(ks_statistics(*(df.where(F.col(f"`{label}`") == side) for side in (1, 0)), features))
    p = F.col("p_value")
    out = ks.select("feature", "statistic", "p_value", (F.col("statistic") > notable).alias("notable"),
                    F.when(p < 0.001, F.lit("***")).when(p < 0.01, F.lit("**")).when(p < 0.05, F.lit("*"))
                    .otherwise(F.lit("")).alias("significance"))
    w = Window.partitionBy(F.lit(0)).orderBy(F.desc("statistic"), "feature")  # one row per feature
    out = out.withColumn("rank", F.row_number().over(w).cast("long"))
    return out.where(F.col("rank") <= k) if k else out


def js_distance(real: DataFrame, candidate: DataFrame, features: list[str], bins: int = config.JS_BINS,
                threshold: float = config.JS_THRESHOLD, eps: float = 1e-10) -> DataFrame:
    """T5: sqrt of the Jensen-Shannon divergence (natural log) of the two histograms over
    ``bins`` equal bins of the REAL range; candidate values outside it are dropped."""
    u = _sides_long(real, candidate, features)
    rng = u.where(F.col("_side") == 0).groupBy("feature").agg(F.min("value").alias("lo0"), F.max("value").alias("hi0"))
    rng = rng.select("feature",
                     F.when(F.col("hi0") > F.col("lo0"), F.col("lo0")).otherwise(F.col("lo0") - 0.5).alias("lo"),
                     F.when(F.col("hi0") > F.col("lo0"), F.col("hi0")).otherwise(F.col("hi0") + 0.5).alias("hi"))
    rng = rng.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    t = u.join(F.broadcast(rng), "feature").where((F.col("value") >= F.col("lo")) & (F.col("value") <= F.col("hi")))
    b = F.least(F.floor((F.col("value") - F.col("lo")) / F.col("w")).cast("int"), F.lit(bins - 1))
    counts = t.groupBy("feature", b.alias("bin")).agg(F.count_if(F.col("_side") == 0).alias("ca"),
                                                      F.count_if(F.col("_side") == 1).alias("cb"))
    grid = rng.select("feature", "w", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    g = grid.join(counts, ["feature", "bin"], "left").fillna(0, ["ca", "cb"])
    wf = Window.partitionBy("feature")  # bins per feature: bounded by ``bins``
    da = F.coalesce(F.try_divide(F.col("ca"), F.sum("ca").over(wf) * F.col("w")), F.lit(0.0)) + eps
    db = F.coalesce(F.try_divide(F.col("cb"), F.sum("cb").over(wf) * F.col("w")), F.lit(0.0)) + eps
    g = g.select("feature", "bin", da.alias("da"), db.alias("db"))
    g = g.select("feature", (F.col("da") / F.sum("da").over(wf)).alias("p"), (F.col("db") / F.sum("db").over(wf)).alias("q"))
    m = (F.col("p") + F.col("q")) / 2
    kl = F.col("p") * F.log(F.col("p") / m) + F.col("q") * F.log(F.col("q") / m)
    js = g.groupBy("feature").agg(F.sqrt(F.greatest(F.sum(kl) / 2, F.lit(0.0))).alias("statistic"))
    return js.select(F.lit("JS_divergence").alias("test_name"), "feature", (F.col("statistic") < threshold).alias("passed"),
                     "statistic", F.lit(float(threshold)).alias("threshold"), F.lit(None).cast("double").alias("p_value"))


def moment_aggs(features: list[str], tag: str) -> list:
    """``{tag}m{i}`` mean and ``{tag}s{i}`` std (n-1) per feature, to share a scan."""
    cols = [clean(F.col(f"`{f}`").cast("double")) for f in features]
    return [F.avg(c).alias(f"{tag}m{i}") for i, c in enumerate(cols)] + \
           [F.stddev_samp(c).alias(f"{tag}s{i}") for i, c in enumerate(cols)]


def moment_tests_from_wide(both: DataFrame, features: list[str], threshold: float = config.MOMENT_THRESHOLD,
                           real_tag: str = "r_", cand_tag: str = "c_") -> DataFrame:
    entries = []
    for i, f in enumerate(features):
        rm, cm = F.col(f"{real_tag}m{i}"), F.col(f"{cand_tag}m{i}")
        rs, cs = F.col(f"{real_tag}s{i}"), F.col(f"{cand_tag}s{i}")
        entries.append(F.struct(F.lit("mean_comparison").alias("test_name"), F.lit(f).alias("feature"),
                                (F.abs(rm - cm) / (F.abs(rm) + F.lit(1e-10))).alias("statistic")))
        entries.append(F.struct(F.lit("std_comparison").alias("test_name"), F.lit(f).alias("feature"),
                                (F.abs(rs - cs) / (rs + F.lit(1e-10))).alias("statistic")))
    out = both.select(F.explode(F.array(*entries)).alias("t")).select("t.*")
    return out.select("test_name", "feature", F.coalesce(F.col("statistic") < threshold, F.lit(False)).alias("passed"),
                      "statistic", F.lit(float(threshold)).alias("threshold"), F.lit(None).cast("double").alias("p_value"))


def moment_comparison(real: DataFrame, candidate: DataFrame, features: list[str],
                      threshold: float = config.MOMENT_THRESHOLD) -> DataFrame:
    """T6 + T7: relative mean difference |dm| / (|m_real| + 1e-10) and relative std difference
    |ds| / (s_real + 1e-10) (std with n-1), passed iff strictly below ``threshold``.
    One aggregate per side, one row each."""
    both = attach(real.agg(*moment_aggs(features, "r_")), candidate.agg(*moment_aggs(features, "c_")))
    return moment_tests_from_wide(both, features, threshold)


def ks_tests(ks: DataFrame) -> DataFrame:
    """KS output in the common ``test_results`` shape."""
    return ks.select(F.lit("KS_test").alias("test_name"), "feature", "passed", "statistic", "threshold", "p_value")


def with_band(ks: DataFrame, stat: str = "statistic", bands=None) -> DataFrame:
    """Q1: Excellent / Good / Fair / Poor by the first upper bound the KS statistic is below."""
    return ks.withColumn("band", quality_band(stat, bands))


def band_counts(ks: DataFrame, stat: str = "statistic", target_pct: float = 95.0) -> DataFrame:
    """M5: number and share of features per band plus best / worst / median KS and whether the
    share of KS < 0.05 reaches ``target_pct``; computed over the per-feature KS table."""
    b = with_band(ks, stat)
    agg = b.agg(
        F.count(F.lit(1)).alias("n_features"),
        *[F.count_if(F.col("band") == name).alias(f"n_{name.lower()}") for _, name in config.KS_BANDS],
        F.count_if(F.col("band") == "Poor").alias("n_poor"),
        F.min(stat).alias("best_ks"), F.max(stat).alias("worst_ks"), F.median(stat).alias("median_ks"))
    pct = F.col("n_excellent") * 100.0 / F.col("n_features")
    return agg.select("*", pct.alias("pct_excellent"), (pct >= target_pct).alias("target_met"))


def ks_extremes(ks: DataFrame, k: int = 5, stat: str = "statistic") -> DataFrame:
    """K2: the ``k`` smallest (best) and ``k`` largest (worst) KS statistics."""
    w_best = Window.partitionBy(F.lit(0)).orderBy(F.asc(stat), "feature")   # per-feature table
    w_worst = Window.partitionBy(F.lit(0)).orderBy(F.desc(stat), "feature")
    r = ks.select("feature", stat, F.row_number().over(w_best).cast("long").alias("_b"), F.row_number().over(w_worst).cast("long").alias("_w"))
    best = r.where(F.col("_b") <= k).select(F.lit("best").alias("kind"), F.col("_b").alias("rank"), "feature", stat)
    worst = r.where(F.col("_w") <= k).select(F.lit("worst").alias("kind"), F.col("_w").alias("rank"), "feature", stat)
    return best.unionByName(worst)


def ks_sorted(ks: DataFrame, descending: bool = False, places: int = 4, stat: str = "statistic") -> DataFrame:
    """K3: KS details ordered by the statistic, rounded."""
    order = F.desc(stat) if descending else F.asc(stat)
    return ks.select("feature", F.round(F.col(stat), places).alias(stat), "passed").orderBy(order, "feature")


def failed_tests(tests: DataFrame) -> DataFrame:
    """K4: the tests that did not pass, worst first."""
    return tests.where(~F.col("passed")).orderBy(F.desc("statistic"), "test_name", "feature")


def feature_comparison(real: DataFrame, candidate: DataFrame, features: list[str], exact: bool = True) -> DataFrame:
    """Q2: per feature the describe numbers of both sides, % differences of mean / std /
    median, and the KS statistic with its band."""
    u = _sides_long(real, candidate, features)
    side = F.when(F.col("_side") == 0, F.lit("real")).otherwise(F.lit("candidate"))
    u = u.withColumn("side", side)
    mom = u.groupBy("feature", "side").agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
                                           F.min("value").alias("min"), F.max("value").alias("max"))
    qs = quantile_columns(u, ["feature", "side"], "value", {"q25": 0.25, "median": 0.5, "q75": 0.75}, exact=exact)
    d = mom.join(qs, ["feature", "side"])
    metrics = ["mean", "std", "min", "q25", "median", "q75", "max"]
    wide = d.groupBy("feature").agg(
        *[F.max(F.when(F.col("side") == "real", F.col(m))).alias(f"real_{m}") for m in metrics],
        *[F.max(F.when(F.col("side") == "candidate", F.col(m))).alias(f"candidate_{m}") for m in metrics])
    for m in ("mean", "std", "median"):
        wide = wide.withColumn(f"{m}_diff_pct", F.abs(F.col(f"candidate_{m}") - F.col(f"real_{m}"))
                               / (F.abs(F.col(f"real_{m}")) + F.lit(1e-10)) * 100)
    ks = _ks_core(u.select("feature", "value", "_side")).select("feature", F.col("statistic").alias("ks"))
    return wide.join(ks, "feature").withColumn("band", quality_band("ks"))
