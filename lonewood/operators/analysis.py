"""Score analysis: rankings, histograms, densities, run-to-run comparison metrics.

Everything is a DataFrame aggregate or join.  Where an exact global rank of every row
is needed (rank order of another run, position of new points among training scores)
the two-pass range-partitioned index of ``ordering`` is used; exact quantiles use
distributed bucket refinement -- never a window without PARTITION BY, never a
collect of the scores.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import ship_package
from .ordering import global_row_index, running_counts  # noqa: F401


# ------------------------------------------------------------------ O2 / O3 / P5
def top_anomalies(scores: DataFrame, k: int = 10, score_col: str = "score", id_col: str = "id") -> DataFrame:
    """O2: the k highest scores (ties by id) -- TakeOrderedAndProject, per-partition top-k."""
    return scores.orderBy(F.col(score_col).desc(), F.col(id_col).asc()).limit(k)


def bottom_normals(scores: DataFrame, k: int = 10, score_col: str = "score", id_col: str = "id") -> DataFrame:
    """O3: the k lowest scores (most normal points)."""
    return scores.orderBy(F.col(score_col).asc(), F.col(id_col).asc()).limit(k)


def label_layers(scores: DataFrame, k: int = 10, score_col: str = "score", id_col: str = "id") -> DataFrame:
    """P5: layer = 'top' for the k most anomalous, 'bottom' for the k most normal, else
    'other'; bottom wins ties.  The two k-th (score, id) pairs are the limits every row is
    compared with: no join, and any k.

    ``scores`` is read three times (top-k, bottom-k, the labels): pass a materialised table
    (written or checkpointed), not a scoring pipeline."""
    s, i = F.col(score_col), F.col(id_col)
    top = top_anomalies(scores, k, score_col, id_col).agg(F.min(F.struct(s.alias("s"), (-i).alias("i"))).alias("x")).first()["x"]
    low = bottom_normals(scores, k, score_col, id_col).agg(F.max(F.struct(s.alias("s"), i.alias("i"))).alias("x")).first()["x"]
    layer = F.lit("other")
    if top is not None:
        is_top = (s > F.lit(top["s"])) | ((s == F.lit(top["s"])) & (i <= F.lit(-top["i"])))
        is_low = (s < F.lit(low["s"])) | ((s == F.lit(low["s"])) & (i <= F.lit(low["i"])))
        layer = F.when(is_low, "bottom").when(is_top, "top").otherwise("other")
    return scores.withColumn("layer", layer)


# ------------------------------------------------------------------ R5 / R7 / R8
def per_tree_scores(paths: DataFrame, c_psi: float) -> DataFrame:
    """``paths`` (one row per point and tree) with that tree's score 2^(-h / c)."""
    return paths.withColumn("score", F.pow(F.lit(2.0), -F.col("path_length") / F.lit(c_psi)))


def product_scores(paths: DataFrame, n_trees: int, c_psi: float) -> DataFrame:
    """(id, score), the product over trees of 2^(-h / n_trees / c), combined map-side."""
    f = F.pow(F.lit(2.0), -F.col("path_length") / F.lit(float(n_trees)) / F.lit(c_psi))
    return paths.groupBy("id").agg(F.product(f).alias("score"))


def mean_path_scores(paths: DataFrame, c_psi: float) -> DataFrame:
    """(id, path_mean, score) from the mean path length over trees."""
    agg = paths.groupBy("id").agg(F.avg("path_length").alias("path_mean"))
    return agg.withColumn("score", F.pow(F.lit(2.0), -F.col("path_mean") / F.lit(c_psi)))


# ------------------------------------------------------------------ A4
def mean_var_pop(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """A4: mean and population variance (numpy's default ddof=0)."""
    g = df.groupBy(*(by or []))
    return g.agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.var_pop(value).alias("var_pop"))


# ------------------------------------------------------------------ A6
def hist_fixed(scores: DataFrame, col: str = "score", bins: int = 19, lo: float = 0.0, hi: float = 1.0,
               by: list[str] | None = None) -> DataFrame:
    """``bins`` equal bins on [lo, hi] (last bin closed), density-normalised; empty
    bins are present with density 0.

    ``by`` histograms each group separately (e.g. ``by=["id"]`` on per-tree scores gives
    every point's distribution of tree scores): one aggregate keyed by (group, bin), the
    per-group totals from a second aggregate, each group's empty bins from a sequence.
    Without ``by`` the data is read once: the per-bin counts (at most ``bins`` rows) are
    collected and completed with the empty bins."""
    spark = scores.sparkSession
    width = (hi - lo) / bins
    s = F.col(col)
    inr = scores.where((s >= F.lit(lo)) & (s <= F.lit(hi)))
    b = F.least(F.floor((s - F.lit(lo)) / F.lit(hi - lo) * F.lit(float(bins))), F.lit(bins - 1)).cast("int")
    keys = list(by or [])
    counts = inr.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("count"))
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    edges = [(F.lit(lo) + F.col("bin") * F.lit(width)).alias("edge_lo"),
             (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("edge_hi")]
    if not keys:
        # one pass over the data: the per-bin counts (at most `bins` rows) are the result
        got = {int(r["bin"]): int(r["count"]) for r in counts.collect()}
        total = sum(got.values())
        rows = [(b, got.get(b, 0)) for b in range(bins)]
        res = spark.createDataFrame(rows, "bin int, count bigint")
        dens = F.col("count") / F.lit(float(total) * width) if total > 0 else F.lit(0.0)
        return res.select("bin", *edges, "count", dens.alias("density"))
    totals = counts.groupBy(*keys).agg(F.sum("count").alias("_total"))
    # each group's own bins 0..bins-1 (the histogram rows themselves), then its counts
    grid = totals.withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = grid.join(counts, keys + ["bin"], "left")
    return out.select(*keys, "bin", *edges, cnt.alias("count"),
                      (cnt / (F.col("_total") * F.lit(width))).alias("density"))


# ------------------------------------------------------------------ exact quantiles
def _between(lo, hi, n: int) -> list:
    """About ``n`` ordered values from ``lo`` to ``hi``, both included."""
    if isinstance(lo, int):
        return sorted({lo + (hi - lo) * j // n for j in range(n + 1)})
    return sorted({min(hi, max(lo, lo * (1 - j / n) + hi * (j / n))) for j in range(n + 1)} | {lo, hi})


def order_statistics(df: DataFrame, col: str, ranks, buckets: int = 4096) -> list:
    """Exact values at 0-based ``ranks`` of a numeric column (NULLs and NaNs ignored), in the
    order of ``ranks``: a list, or a function from the number of values to one.

    Distributed selection: one aggregate counts the values between given limits, and keeps
    the least and the greatest of each interval; the intervals that hold a wanted rank are
    cut again, all of them in the same next aggregate.  About ``buckets`` rows a level go to
    the driver, never values of the column; nothing is sorted or written.  Every interval
    is cut at its own least and greatest value, so each level makes progress."""
    spark = df.sparkSession
    ship_package(spark)
    whole = isinstance(df.schema[col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType))
    vals = df.select(F.col(col).cast("bigint" if whole else "double").alias("v")).where(F.col("v").isNotNull())
    if not whole:
        vals = vals.where(~F.isnan("v"))
    st = vals.agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).first()
    n = int(st["n"])
    ranks = list(ranks(n) if callable(ranks) else ranks)
    if any(r < 0 or r >= n for r in ranks):
        raise ValueError(f"ranks must lie in [0, {n})")
    found: dict[int, object] = {}
    todo = {(st["lo"], st["hi"], 0): sorted(set(ranks))} if ranks else {}  # (least, greatest, rank of the least)
    while todo:
        for (lo, hi, _), wanted in list(todo.items()):
            if lo == hi:
                found.update(dict.fromkeys(wanted, lo))
        todo = {k: w for k, w in todo.items() if k[0] != k[1]}
        if not todo:
            break
        each = max(2, buckets // len(todo))
        edges = np.unique(np.concatenate([np.array(_between(lo, hi, each), np.int64 if whole else np.float64) for lo, hi, _ in todo]))
        limits = spark.sparkContext.broadcast(edges)

        @F.arrow_udf("int")
        def interval(v: pa.Array) -> pa.Array:
            return pa.array((np.searchsorted(limits.value, v.to_numpy(zero_copy_only=False), "right") - 1).astype(np.int32))

        cells = sorted(vals.groupBy(interval("v").alias("b")).agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi")).collect(),
                       key=lambda r: r["b"])
        below, spans = 0, []
        for r in cells:
            spans.append((below, r["lo"], r["hi"]))
            below += r["n"]
        starts = np.array([s[0] for s in spans])
        left, todo = [r for w in todo.values() for r in w], {}
        for rank in left:
            first, lo, hi = spans[int(np.searchsorted(starts, rank, "right")) - 1]
            todo.setdefault((lo, hi, first), []).append(rank)
    return [found[r] for r in ranks]


def exact_quantiles(df: DataFrame, col: str, qs: list[float], buckets: int = 4096) -> list[float]:
    """Linear-interpolation quantiles (type 7, as numpy / quantile_cont), exact."""
    vals = df.select(F.col(col).cast("double").alias("_v"))
    size = []

    def ranks(n: int) -> list[int]:
        size.append(n)
        return [r for q in qs for r in (math.floor((n - 1) * q), math.ceil((n - 1) * q))] if n else []

    got = order_statistics(vals, "_v", ranks, buckets)
    if not size[0]:
        return [float("nan")] * len(qs)
    return [a + ((size[0] - 1) * q - math.floor((size[0] - 1) * q)) * (b - a) for q, a, b in zip(qs, got[::2], got[1::2])]


def sketch_quantiles(df: DataFrame, col: str, qs: list[float], error: float = 1e-4) -> list[float]:
    """Quantiles by Spark's mergeable sketch, in one aggregate of the JVM: for each q a value of
    the column whose rank differs from q n by at most ``error`` n."""
    got = df.agg(_sketched(F.col(col), qs, error).alias("v")).first()["v"]
    return [float("nan")] * len(qs) if got is None else got


def _sketched(col: Column, qs: list[float], error: float) -> Column:
    return F.percentile_approx(col.cast("double"), qs, round(1 / error))


# ------------------------------------------------------------------ A7
def fd_bins(n: int, q25: float, q75: float, lo: float, hi: float, max_bins: int | None = 50) -> int:
    """Freedman-Diaconis bin count: ceil(range / (2 IQR n^(-1/3))), clamped to [1, max_bins]
    (None: no limit).  Without an interquartile range the rule gives no width: ``max_bins``,
    or 50."""
    rng = hi - lo
    if rng <= 0:
        return 1
    width = 2.0 * (q75 - q25) / (n ** (1.0 / 3.0))
    if width <= 0:
        return max_bins or 50
    bins = max(1, math.ceil(rng / width))
    return bins if max_bins is None else min(max_bins, bins)


def hist_fd(scores: DataFrame, col: str = "score", max_bins: int | None = 50, error: float | None = None) -> DataFrame:
    """Adaptive-width density histogram (Freedman-Diaconis).  Quartiles are exact, or with
    ``error`` those of ``sketch_quantiles``, from the pass that counts the scores."""
    spark = scores.sparkSession
    sketch = [] if error is None else [_sketched(F.col(col), [0.25, 0.75], error).alias("quartiles")]
    st = scores.agg(F.count(col).alias("n"), F.min(col).alias("lo"), F.max(col).alias("hi"), *sketch).first()
    n, lo, hi = int(st["n"]), st["lo"], st["hi"]
    if n == 0:
        return spark.createDataFrame([], "bin bigint, edge_lo double, edge_hi double, count bigint, density double")
    q25, q75 = st["quartiles"] if sketch else exact_quantiles(scores, col, [0.25, 0.75])
    nb = fd_bins(n, q25, q75, lo, hi, max_bins)
    rng = hi - lo
    width = rng / nb if rng > 0 else 1.0
    s = F.col(col)
    b = F.least(F.floor((s - F.lit(lo)) / F.lit(rng if rng > 0 else 1.0) * F.lit(float(nb))), F.lit(nb - 1)).cast("bigint")
    counts = scores.where(s.isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("count"))
    all_bins = spark.range(nb).select(F.col("id").alias("bin"))
    cnt = F.coalesce(F.col("count"), F.lit(0)).cast("bigint")
    return all_bins.join(counts, "bin", "left").select(
        "bin",
        (F.lit(lo) + F.col("bin") * F.lit(width)).alias("edge_lo"),
        (F.lit(lo) + (F.col("bin") + 1) * F.lit(width)).alias("edge_hi"),
        cnt.alias("count"),
        (cnt / F.lit(n * width)).alias("density"),
    )


# ------------------------------------------------------------------ A8
def kde(scores: DataFrame, col: str = "score", grid: int = 100, cut: float = 3.0) -> DataFrame:
    """Gaussian kernel density on a ``grid``-point mesh over [min - cut h, max + cut h],
    Scott bandwidth h = stddev_samp * n^(-1/5).

    Exact over every score: each partition adds its points' kernels into a ``grid``-long
    partial vector (numpy, Arrow batches); partials are summed by grid index.  Shuffle
    = grid rows per partition, whatever the data size.
    """
    spark = scores.sparkSession
    ship_package(spark)
    st = scores.agg(F.count(col).alias("n"), F.stddev_samp(col).alias("sd"), F.min(col).alias("lo"),
                    F.max(col).alias("hi")).first()
    n = int(st["n"])
    if n < 2 or not st["sd"]:
        return spark.createDataFrame([], "grid_index int, x double, density double")
    h = float(st["sd"]) * n ** (-1.0 / 5.0)
    g0, g1 = float(st["lo"]) - cut * h, float(st["hi"]) + cut * h
    xs = [g0 + i * (g1 - g0) / (grid - 1) for i in range(grid)]
    xs_arr = np.array(xs)
    schema = T.StructType([T.StructField("grid_index", T.IntegerType()), T.StructField("ksum", T.DoubleType())])
    arrow_schema = pa.schema([("grid_index", pa.int32()), ("ksum", pa.float64())])

    def partial(batches):
        acc = np.zeros(grid)
        for b in batches:
            v = b.column(0).to_numpy(zero_copy_only=False).astype(np.float64)
            v = v[~np.isnan(v)]
            for i in range(0, v.shape[0], 20000):
                z = (xs_arr[None, :] - v[i:i + 20000, None]) / h
                acc += np.exp(-0.5 * z * z).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(grid, dtype=np.int32)), pa.array(acc)],
                                         schema=arrow_schema)

    parts = scores.select(F.col(col).cast("double")).where(F.col(col).isNotNull()).mapInArrow(partial, schema)
    sums = parts.groupBy("grid_index").agg(F.sum("ksum").alias("ksum"))
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))
    xcol = F.lit(g0) + F.col("grid_index") * F.lit((g1 - g0) / (grid - 1))
    return sums.select("grid_index", xcol.alias("x"), (F.col("ksum") * F.lit(norm)).alias("density"))


def kde_binned(scores: DataFrame, col: str = "score", grid: int = 100, cut: float = 3.0, cells: int = 2048) -> DataFrame:
    """A8, binned: ``kde`` of the scores dealt linearly to ``cells`` points.

    Each score gives its two neighbours among the points their shares, one aggregate sums them
    map-side, and the kernels of at most ``cells`` points are added up on the grid.  Neither
    Python nor more than cells x grid terms, whatever the data size.  A term is off by at most
    (step / h)^2 / 8 of a kernel's height: with 2048 points and the usual spread under 1e-4."""
    spark = scores.sparkSession
    s = F.col(col).cast("double")
    known = scores.select(s.alias("s")).where("s IS NOT NULL AND NOT isnan(s)")
    st = known.agg(F.count("*").alias("n"), F.stddev_samp("s").alias("sd"), F.min("s").alias("lo"), F.max("s").alias("hi")).first()
    n = int(st["n"])
    if n < 2 or not st["sd"]:
        return spark.createDataFrame([], "grid_index int, x double, density double")
    h = float(st["sd"]) * n ** (-1.0 / 5.0)
    lo, hi = float(st["lo"]), float(st["hi"])
    step = (hi - lo) / (cells - 1)
    g0, g1 = lo - cut * h, hi + cut * h
    at = (F.col("s") - F.lit(lo)) / F.lit(step)
    cell = F.least(F.floor(at), F.lit(cells - 2))
    sums = known.select(cell.alias("cell"), (at - cell).alias("up")).groupBy("cell").agg(F.sum("up").alias("up"), F.count("*").alias("n"))
    # a cell's scores weigh on its own point and on the next one
    points = sums.select(F.explode(F.array(F.struct(F.col("cell").alias("cell"), (F.col("n") - F.col("up")).alias("w")),
                                           F.struct((F.col("cell") + 1).alias("cell"), F.col("up").alias("w")))).alias("p")).select("p.*")
    points = points.groupBy("cell").agg(F.sum("w").alias("w"))
    x = F.lit(g0) + F.col("grid_index") * F.lit((g1 - g0) / (grid - 1))
    z = (x - (F.lit(lo) + F.col("cell") * F.lit(step))) / F.lit(h)
    terms = points.select("cell", "w", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))).alias("grid_index"))
    ksum = terms.groupBy("grid_index").agg(F.sum(F.col("w") * F.exp(F.lit(-0.5) * z * z)).alias("ksum"))
    return ksum.select("grid_index", x.alias("x"), (F.col("ksum") * F.lit(1.0 / (n * h * math.sqrt(2.0 * math.pi)))).alias("density"))


# ------------------------------------------------------------------ A9 / A10 / A11 / J3
def align_runs(bench: DataFrame, run: DataFrame, id_col: str = "id", col: str = "score") -> DataFrame:
    """Two score runs side by side by id (equi-join; both sides hash-partitioned on id)."""
    b = bench.select(F.col(id_col).alias("id"), F.col(col).alias("benchmark"))
    r = run.select(F.col(id_col).alias("id"), F.col(col).alias("run"))
    return b.join(r, "id")


def score_runs(df: DataFrame, runs: dict, id_col: str, round_to: int | None = None) -> DataFrame:
    """J3 without a join: every run scores the same scan in turn (chained row-local
    passes), giving (id, <run name> ...) side by side -- no shuffle at any size.

    ``runs`` maps a name to ``(model, combine)``."""
    cur = df
    for name, (model, combine) in runs.items():
        cur = model.score(cur, combine=combine, id_col=id_col, prefix=f"_{name}_")
    cols = []
    for name in runs:
        c = F.col(f"_{name}_score")
        cols.append((F.round(c, round_to) if round_to is not None else c).alias(name))
    return cur.select(F.col(id_col).cast("bigint").alias("id"), *cols)


def series_total(a: DataFrame, b: DataFrame, key: str, col: str) -> DataFrame:
    """A5: element-wise total of two series by ``key`` (equi-join)."""
    x, y = a.select(key, F.col(col).alias("_a")), b.select(key, F.col(col).alias("_b"))
    return x.join(y, key).select(key, (F.col("_a") + F.col("_b")).alias(col))


def rel_diff(aligned: DataFrame) -> DataFrame:
    """Per point (100 (run - bench) / bench)^2 and its root."""
    pct = F.lit(100.0) * (F.col("run") - F.col("benchmark")) / F.col("benchmark")
    return aligned.withColumn("rel_diff_sq", pct * pct).withColumn("abs_pct_diff", F.abs(pct))


def e_metric(aligned: DataFrame) -> DataFrame:
    """A10: E = 100 / N * sqrt(sum(((s - b) / b)^2)) -- N outside the root, as published."""
    r = (F.col("run") - F.col("benchmark")) / F.col("benchmark")
    return aligned.agg(F.count("*").alias("n"),
                       (F.lit(100.0) * F.sqrt(F.sum(r * r)) / F.count("*")).alias("e_metric"))


def max_abs_pct_diff(diff_tables: dict[str, DataFrame]) -> DataFrame:
    """sqrt(max over all series of rel_diff_sq), plus the per-series maxima."""
    parts = [d.select(F.lit(name).alias("series"), "rel_diff_sq") for name, d in diff_tables.items()]
    u = parts[0]
    for p in parts[1:]:
        u = u.unionByName(p)
    per = u.groupBy("series").agg(F.sqrt(F.max("rel_diff_sq")).alias("max_abs_pct_diff"))
    overall = per.agg(F.max("max_abs_pct_diff").alias("max_abs_pct_diff")).select(F.lit("*").alias("series"), "max_abs_pct_diff")
    return per.unionByName(overall)


# ------------------------------------------------------------------ O4
def by_benchmark_rank(aligned: DataFrame) -> DataFrame:
    """Order one run by another's scores: rank of each point by its benchmark score."""
    return global_row_index(aligned, [F.col("benchmark"), F.col("id")], index_col="rank")


# ------------------------------------------------------------------ A12
def score_position(train: DataFrame, new: DataFrame, col: str = "score", id_col: str = "id",
                   bins: int = 19) -> DataFrame:
    """For each new point: how many / what fraction of training scores are <= its
    score, and its bin in the fixed histogram.  One global range sort of train U new
    (training rows first on ties) with running counts; no pairs, no broadcast of data."""
    # training rows carry their own id as tiebreak: a hot training score must not become
    # one range partition
    t = train.select(F.col(col).cast("double").alias("_s"), F.lit(1).alias("is_train"),
                     F.lit(0).alias("is_new"), F.col(id_col).cast("bigint").alias("_nid"))
    q = new.select(F.col(col).cast("double").alias("_s"), F.lit(0).alias("is_train"),
                   F.lit(1).alias("is_new"), F.col(id_col).cast("bigint").alias("_nid"))
    u = t.unionByName(q)
    n_train = train.count()
    rc = running_counts(u, [F.col("_s"), F.col("is_new"), F.col("_nid")], ["is_train"], index_col="_gi")
    out = rc.where(F.col("is_new") == 1).select(
        F.col("_nid").alias(id_col), F.col("_s").alias(col),
        F.col("cum_is_train").alias("n_train_le"),
        (F.col("cum_is_train") / F.lit(float(max(n_train, 1)))).alias("frac_train_le"),
        F.least(F.floor(F.col("_s") * F.lit(float(bins))), F.lit(bins - 1)).cast("int").alias("bin"),
    )
    return out
