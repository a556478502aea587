"""Evaluation of probabilities: reliability, scores, calibration, profiles over thresholds.

All operators take rows (probability, 0/1 label) of any number; what is ordered over all rows is
ordered within probability buckets whose sums are added up, never in one task.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.functions.math import clamp, logit, wilson


def _bins(df: DataFrame, count: int) -> DataFrame:
    return df.sparkSession.range(count).select(F.col("id").cast("int").alias("bin"))


def bin_by_edges(p: Column, count: int = 10) -> Column:
    """Bin i holds i/count <= p < (i+1)/count, compared as doubles; the last holds 1 too."""
    out = F.lit(count - 1)
    for i in range(count - 2, -1, -1):
        out = F.when(p < F.lit((i + 1) / count), i).otherwise(out)
    return out.cast("int")


def bin_by_floor(p: Column, count: int = 10) -> Column:
    """floor(p * count), at most count - 1; may differ from ``bin_by_edges`` where p * count rounds."""
    return F.least(F.lit(count - 1), F.floor(p * count)).cast("int")


def reliability(df: DataFrame, p: str, label: str, bins: Column, count: int = 10, extra: dict[str, Column] | None = None) -> DataFrame:
    """bin, n, mean_probability, observed_rate and the aggregates of ``extra``; empty bins stay, with nulls."""
    more = extra or {}
    found = df.groupBy(bins.alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_probability"), F.avg(F.col(label).cast("double")).alias("observed_rate"), *[c.alias(k) for k, c in more.items()])
    return _bins(df, count).join(F.broadcast(found), "bin", "left").select("bin", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "mean_probability", "observed_rate", *more)


def scores(df: DataFrame, p: str, label: str, baseline: str, empty_recall: float | None = None, hit: str | None = None) -> DataFrame:
    """One row: n, events, brier, baseline_brier, brier_skill, log_loss, ece (10 bins) and, with ``hit``, recall.

    ``empty_recall`` is the recall without events: null as issued, 0 in walk-forward.
    """
    y = F.col(label).cast("double")
    q = clamp(F.col(p), 1e-12, 1 - 1e-12)
    part = df.groupBy(bin_by_edges(F.col(p)).alias("bin")).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(y).alias("events"),
        F.sum(F.col(p)).alias("sp"),
        F.sum(F.pow(F.col(p) - y, F.lit(2.0))).alias("se"),
        F.sum(F.pow(F.col(baseline) - y, F.lit(2.0))).alias("be"),
        F.sum(-(y * F.log(q) + (1 - y) * F.log(1 - q))).alias("ll"),
        (F.sum(F.when((y == 1) & F.col(hit), 1.0).otherwise(0.0)) if hit else F.lit(None).cast("double")).alias("hits"),
    )
    total = part.agg(F.sum("n").alias("n"), F.sum("events").cast("long").alias("events"), F.sum("se").alias("se"), F.sum("be").alias("be"), F.sum("ll").alias("ll"), F.sum(F.abs(F.col("sp") - F.col("events"))).alias("gap"), F.sum("hits").alias("hits"))
    recall = F.when(F.col("events") > 0, F.col("hits") / F.col("events")).otherwise(F.lit(empty_recall).cast("double"))
    out = total.select("n", "events", (F.col("se") / F.col("n")).alias("brier"), (F.col("be") / F.col("n")).alias("baseline_brier"), F.when(F.col("be") > 0, 1 - F.col("se") / F.col("be")).alias("brier_skill"), (F.col("ll") / F.col("n")).alias("log_loss"), (F.col("gap") / F.col("n")).alias("ece"), recall.alias("recall"))
    return out if hit else out.drop("recall")


def sample_gate(metrics: DataFrame, windows: int = 1008, events: int = 20) -> DataFrame:
    return metrics.withColumn("sample_sufficient", (F.col("n") >= windows) & (F.col("events") >= events))


#: Rows that a window ranks together, about, as far as the buckets go.
RANKED_TOGETHER = 100_000


def _edges(column: str, count: int) -> Column:
    return F.array_sort(F.array_distinct(F.percentile_approx(F.col(column).cast("double"), F.array(*[F.lit((i + 1) / count) for i in range(count - 1)]), 10 * count)))


def _edges_up_to(value: Column, edges: Sequence[float], with_equal: bool) -> Column:
    """How many of the ascending edges lie below the value (or at it): a binary search as nested conditions."""

    def go(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        passed = value >= edges[mid] if with_equal else value > edges[mid]
        return F.when(passed, go(mid + 1, hi)).otherwise(go(lo, mid))

    return go(0, len(edges))


def ranked(df: DataFrame, p: str, tie: str, sums: dict[str, Column], buckets: int = 128) -> DataFrame:
    """``df`` with rank (1 for the highest p; ties by ``tie``) and running totals of ``sums`` in that order.

    Rows are dealt by approximate quantiles of p (``buckets`` numbers that go to the driver),
    however p is distributed.  A value at a quantile is a bucket of its own and is dealt once more
    by quantiles of ``tie``, so that a value that most rows have is spread too.  Sums of the
    buckets (as many as the parameter allows) are added up.
    """
    found = df.agg(_edges(p, buckets).alias("p"), _edges(tie, buckets).alias("t"), F.count(F.lit(1)).alias("n")).first()
    if found["n"] <= RANKED_TOGETHER:  # one bucket
        whole = Window.orderBy(F.col(p).desc(), F.col(tie))
        return df.withColumns({"rank": F.row_number().over(whole).cast("long")} | {k: F.sum(c).over(whole.rowsBetween(Window.unboundedPreceding, 0)) for k, c in sums.items()})
    every = max(1, buckets // max(16, found["n"] // RANKED_TOGETHER))  # few rows need few buckets
    own_edges, tie_edges = list(found["p"] or [])[::every], list(found["t"] or [])[::every]
    value = F.col(p).cast("double")
    exact = value.isin(*own_edges) if own_edges else F.lit(False)
    placed = df.withColumn("__bucket", exact.cast("int") - 2 * _edges_up_to(value, own_edges, True))
    placed = placed.withColumn("__sub", F.when(exact, _edges_up_to(F.col(tie).cast("double"), tie_edges, False)).otherwise(0))
    totals = placed.groupBy("__bucket", "__sub").agg(F.count(F.lit(1)).alias("__n"), *[F.sum(c).alias(f"__{k}") for k, c in sums.items()])
    before = Window.orderBy("__bucket", "__sub").rowsBetween(Window.unboundedPreceding, -1)
    names = ["n", *sums]
    first = totals.select("__bucket", "__sub", *[F.coalesce(F.sum(f"__{k}").over(before), F.lit(0)).alias(f"__{k}") for k in names])
    own = Window.partitionBy("__bucket", "__sub").orderBy(F.col(p).desc(), F.col(tie))
    running = own.rowsBetween(Window.unboundedPreceding, 0)
    joined = placed.join(F.broadcast(first), ["__bucket", "__sub"])  # a row a bucket
    values = {"rank": F.col("__n") + F.row_number().over(own)} | {k: F.col(f"__{k}") + F.sum(c).over(running) for k, c in sums.items()}
    return joined.withColumns(values).drop("__bucket", "__sub", *[f"__{k}" for k in names])


def average_precision(df: DataFrame, p: str, label: str, tie: str) -> DataFrame:
    """One row: positives and average_precision (null without positives); ties keep the order of ``tie``."""
    rows = ranked(df, p, tie, {"found": F.col(label).cast("long")})
    hit = F.when(F.col(label) == 1, F.col("found") / F.col("rank"))
    return rows.agg(F.sum(F.col(label).cast("long")).alias("positives"), F.avg(hit).alias("average_precision"))


def platt_fit(df: DataFrame, p: str, label: str, iterations: int = 30, ridge: float = 1e-6) -> tuple[float | None, float | None]:
    """Intercept and slope of the logistic recalibration of logit(p), by Newton steps of one aggregation each.

    A step that would lower the likelihood is halved.  Both are kept between -30 and 30, and null
    where only one label occurs.
    """
    rows = df.select(logit(F.col(p)).alias("x"), F.col(label).cast("double").alias("y"))

    def sums(a: float, b: float) -> tuple:
        z = clamp(F.lit(a) + F.lit(b) * F.col("x"), -30, 30)
        q = 1 / (1 + F.exp(-z))
        r, w, x = F.col("y") - q, q * (1 - q), F.col("x")
        value = F.sum(F.when(F.col("y") == 1, F.log(q)).otherwise(F.log1p(-q)))
        return rows.agg(value, F.sum(r), F.sum(r * x), F.sum(w), F.sum(w * x), F.sum(w * x * x), F.sum("y"), F.count("y")).first()

    a, b = 0.0, 1.0
    now = sums(a, b)
    if not now[6] or now[6] == now[7]:
        return None, None
    for _ in range(iterations):
        value, g0, g1, h00, h01, h11 = now[:6]
        h00, h11 = h00 + ridge, h11 + ridge
        det = h00 * h11 - h01 * h01
        if abs(det) < 1e-12:
            break
        da, db = (g0 * h11 - g1 * h01) / det, (g1 * h00 - g0 * h01) / det
        for _ in range(40):
            new_a, new_b = min(30.0, max(-30.0, a + da)), min(30.0, max(-30.0, b + db))
            now = sums(new_a, new_b)
            if now[0] >= value - 1e-12 * abs(value):
                break
            da, db = da / 2, db / 2
        a, b = new_a, new_b
        if max(abs(da), abs(db)) < 1e-8:
            break
    return a, b


def alerts_by_month(df: DataFrame, time: str, p: str, label: str, threshold: float) -> DataFrame:
    wrong = F.count_if((F.col(p) >= threshold) & (F.col(label) == 0))
    return df.groupBy(F.date_format(time, "yyyy-MM").alias("month")).agg(wrong.alias("false_alerts"))


def wilson_rates(df: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("hits"))
    low, high = wilson(F.col("hits"), F.col("n"))
    return counts.select(*keys, "n", "hits", low.alias("low"), high.alias("high"))


def histogram(df: DataFrame, p: str, label: str, count: int = 20) -> DataFrame:
    """bin, n, events, density and event_rate (null in empty bins, which stay)."""
    found = df.groupBy(bin_by_floor(F.col(p), count).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("events"))
    total = found.agg(F.sum("n").alias("total"))
    joined = _bins(df, count).join(F.broadcast(found), "bin", "left").crossJoin(F.broadcast(total))  # a single row
    n = F.coalesce("n", F.lit(0)).cast("long")
    return joined.select("bin", n.alias("n"), F.coalesce("events", F.lit(0)).cast("long").alias("events"), (n / F.col("total") * count).alias("density"), F.when(n > 0, F.col("events") / n).alias("event_rate"))


def distribution_summary(df: DataFrame, p: str, points: int = 5) -> DataFrame:
    """n, mean, deviation (population), minimum, maximum, the mean's four-sigma span on the 1 % grid and its upper threshold."""
    eps = 1e-10
    s = df.agg(F.count(p).alias("n"), F.avg(p).alias("mean"), F.stddev_pop(p).alias("deviation"), F.min(p).alias("minimum"), F.max(p).alias("maximum"))
    low = F.greatest(F.lit(0), F.floor((F.col("mean") - 4 * F.col("deviation")) * 100 + eps))
    high = F.least(F.lit(100), F.ceil((F.col("mean") + 4 * F.col("deviation")) * 100 - eps))
    short = F.greatest(F.lit(0), points - (high - low))
    low2 = F.greatest(F.lit(0), low - F.floor(short / 2))
    high2 = F.least(F.lit(100), F.greatest(high, low2 + points))
    threshold = F.least(F.lit(100), F.ceil((F.col("mean") + 2 * F.col("deviation")) * 100 - eps))
    return s.select("n", "mean", "deviation", "minimum", "maximum", low2.cast("int").alias("low_percent"), high2.cast("int").alias("high_percent"), threshold.cast("int").alias("threshold_percent"))


def order_statistics(df: DataFrame, column: str, ranks: Sequence[int] | Callable[[int], Sequence[int]], bins: int = 4096, few: int = 10_000) -> list[float]:
    """The values of given ranks (from 0), exactly, by nested histograms; ``ranks`` may be a function of the number of values.

    Each step counts, in one job, the bins of all ranges that hold a rank (at most ``bins`` rows a
    range come to the driver) and goes on in the bins that do, until ``few`` values at most are
    left in each.  The last job counts the distinct values of what is left.
    """
    values = df.select(F.col(column).cast("double").alias("v")).filter("v is not null")
    span = values.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.count("v").alias("n")).first()
    wanted = sorted(set(ranks(span["n"]) if callable(ranks) else ranks))
    open_ = [(span["lo"], span["hi"], span["n"], 0, wanted)] if wanted else []  # range, its values, how many are below it, ranks
    closed: list[tuple] = []

    def inside(ranges: Sequence[tuple]) -> Column:
        place = F.lit(None).cast("int")
        for k, r in enumerate(ranges):
            place = F.when(F.col("v").between(r[0], r[1]), k).otherwise(place)
        return place

    while True:
        closed += [r for r in open_ if r[2] <= few or r[0] == r[1]]
        open_ = [r for r in open_ if r[2] > few and r[0] < r[1]]
        if not open_:
            break
        number = F.lit(0)
        for k, (lo, hi, *_) in enumerate(open_):
            number = F.when(F.col("__k") == k, F.least(F.lit(bins - 1), F.floor((F.col("v") - lo) / (hi - lo) * bins))).otherwise(number)
        rows = values.withColumn("__k", inside(open_)).filter("__k is not null").withColumn("b", number)
        found = sorted(tuple(r) for r in rows.groupBy("__k", "b").agg(F.count("v"), F.min("v"), F.max("v")).collect())
        finer: list[tuple] = []
        for k, (lo, hi, _, below, own) in enumerate(open_):
            for _, _, n, low, high in (r for r in found if r[0] == k):
                mine = [x for x in own if below <= x < below + n]
                if mine:  # a range that doubles can't divide has few distinct values left
                    (closed if (low, high) == (lo, hi) else finer).append((low, high, n, below, mine))
                below += n
        open_ = finer
    out: dict[int, float] = {}
    if closed:
        rows = values.withColumn("__k", inside(closed)).filter("__k is not null")
        found = sorted(tuple(r) for r in rows.groupBy("__k", "v").agg(F.count("v")).collect())
        for k, (_, _, _, below, own) in enumerate(closed):
            for _, v, n in (r for r in found if r[0] == k):
                out.update((x, v) for x in own if below <= x < below + n)
                below += n
    return [out[x] for x in (ranks(span["n"]) if callable(ranks) else ranks)]


def quantiles(df: DataFrame, column: str, shares: Sequence[float]) -> list[float | None]:
    """Linearly interpolated quantiles (type 7); null without values."""
    places: list[float] = []

    def ranks(n: int) -> list[int]:
        places[:] = [share * (n - 1) for share in shares] if n else []
        return [r for at in places for r in (math.floor(at), math.ceil(at))]

    found = order_statistics(df, column, ranks)
    if not found:
        return [None] * len(shares)
    pairs = zip(found[::2], found[1::2], places, strict=True)
    return [a + (b - a) * (at - math.floor(at)) for a, b, at in pairs]


def bandwidth(df: DataFrame, p: str) -> DataFrame:
    """Silverman's rule on exact linear quantiles, kept between 0.01 and 0.15."""
    low, high = (F.lit(q).cast("double") for q in quantiles(df, p, (0.25, 0.75)))
    s = df.agg(F.count(p).alias("n"), F.stddev_pop(p).alias("deviation"))
    spread = (high - low) / 1.34
    narrow = F.when(spread > 0, F.least(F.col("deviation"), spread)).otherwise(F.col("deviation"))
    return s.select("n", low.alias("q25"), high.alias("q75"), clamp(0.9 * narrow * F.pow(F.col("n").cast("double"), F.lit(-0.2)), 0.01, 0.15).alias("bandwidth"))


def density(df: DataFrame, p: str, grid: int = 100, fine: int = 10_000) -> DataFrame:
    """x and density of a Gaussian kernel estimate reflected at 0 and 1, on grid + 1 points.

    Rows within 1 / ``fine`` of each other count together, at their mean, so that at most
    ``fine`` + 1 rows meet the points of the grid.
    """
    h = bandwidth(df, p).select("n", "bandwidth")
    counts = df.groupBy(F.floor(F.col(p) * fine + 1e-9).alias("__bin")).agg(F.avg(p).alias("p"), F.count(F.lit(1)).alias("k")).crossJoin(F.broadcast(h))  # a single row
    points = counts.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid))))
    x = F.col("i") / F.lit(float(grid))

    def kernel(at: Column) -> Column:
        return F.exp(-0.5 * F.pow((x - at) / F.col("bandwidth"), F.lit(2.0)))

    value = F.col("k") * (kernel(F.col("p")) + kernel(-F.col("p")) + kernel(2 - F.col("p"))) / (F.col("n") * F.col("bandwidth") * F.lit(math.sqrt(2 * math.pi)))
    return points.groupBy("i").agg(F.sum(value).alias("density")).select("i", (F.col("i") / F.lit(float(grid))).alias("x"), "density")


def threshold_sweep(df: DataFrame, p: str, label: str, event: str | None = None, steps: int = 100) -> DataFrame:
    """threshold_percent, alerts, hits and precision (p strictly above), and the distinct events hit.

    Each row counts once, at the highest threshold that it passes; totals run downwards.
    """
    edge = F.ceil(F.col(p) * steps - 1e-12) - 1  # the highest k with k / steps < p
    own = df.groupBy(edge.cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("y"))
    grid = df.sparkSession.range(steps + 1).select(F.col("id").cast("int").alias("k"))
    down = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)  # steps + 1 rows
    table = grid.join(F.broadcast(own), "k", "left")
    if event:
        best = df.filter(F.col(event).isNotNull()).groupBy(event).agg(F.max(edge.cast("int")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("e"))
        table = table.join(F.broadcast(best), "k", "left")
    out = table.select(F.col("k").alias("threshold_percent"), F.coalesce(F.sum("n").over(down), F.lit(0)).alias("alerts"), F.coalesce(F.sum("y").over(down), F.lit(0)).alias("hits"), *([F.coalesce(F.sum("e").over(down), F.lit(0)).alias("events_hit")] if event else []))
    return out.withColumn("precision", F.when(F.col("alerts") > 0, F.col("hits") / F.col("alerts")))


def compact_points(curve: DataFrame, least: int = 20) -> DataFrame:
    """Confidence only where enough alerts stand behind it."""
    low, high = wilson(F.col("hits"), F.col("alerts"))
    enough = F.col("alerts") >= least
    return curve.select("threshold_percent", "alerts", F.when(enough, F.col("precision")).alias("precision"), F.when(enough, low).alias("low"), F.when(enough, high).alias("high"))


def weighted_correlation(df: DataFrame, x: str, y: str, weight: str, eps: float = 1e-12) -> DataFrame:
    """One row: correlation (null where a variance is about zero)."""
    w, a, b = F.col(weight).cast("double"), F.col(x).cast("double"), F.col(y).cast("double")
    m = df.agg((F.sum(w * a) / F.sum(w)).alias("ma"), (F.sum(w * b) / F.sum(w)).alias("mb"))
    s = df.crossJoin(F.broadcast(m)).agg(F.sum(w * (a - F.col("ma")) * (b - F.col("mb"))).alias("ab"), F.sum(w * F.pow(a - F.col("ma"), F.lit(2.0))).alias("aa"), F.sum(w * F.pow(b - F.col("mb"), F.lit(2.0))).alias("bb"))  # means are a single row
    return s.select(F.when((F.col("aa") > eps) & (F.col("bb") > eps), F.col("ab") / F.sqrt(F.col("aa") * F.col("bb"))).alias("correlation"))


def standardisation(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """feature, mean and scale (population deviation; 1 where it is under 1e-8)."""
    row = df.agg(*[F.avg(c).alias(f"m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"s_{c}") for c in columns])
    parts = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(f"m_{c}").alias("mean"), F.when(F.col(f"s_{c}") < 1e-8, 1.0).otherwise(F.col(f"s_{c}")).alias("scale")) for c in columns])
    return row.select(F.inline(parts))
