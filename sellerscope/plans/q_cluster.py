"""Registered clustering queries: validation scores, k choice, fit, PCA, cluster profiles (ops 9-12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.quantiles import exact_quantiles
from ..operators import evaluate as ev
from ..operators import kmeans as km
from ..operators import gram, pca
from ..operators.elbow import kneedle
from ..operators.euclidean import euclidean_silhouette
from ..operators.features import FEATURES
from ..operators.minibatch import fit_minibatch
from ..operators.preprocess import inverse_scale
from ..operators.segments import relabel_centroids
from ..plans import scoring
from ..sources import sinks
from .oracle_sql import rnd, with_ctes
from .registry import LABEL_CTES, ORACLES, ctx, register

NORM2 = " + ".join(f"a.{f} * a.{f}" for f in FEATURES)
DOT = " + ".join(f"a.{f} * c.s_{f}" for f in FEATURES)
EXTRA = [
    ("cst", "SELECT cluster_id, COUNT(*) AS n, " + ", ".join(f"SUM({f}) AS s_{f}" for f in FEATURES) + ", SUM(" +
     " + ".join(f"{f} * {f}" for f in FEATURES) + ") AS q FROM assigned GROUP BY cluster_id"),
    ("pd", f"SELECT a.seller_nickname, a.cluster_id AS own, c.cluster_id AS other, c.n, "
           f"CAST(c.n AS DOUBLE) * ({NORM2}) - 2.0 * ({DOT}) + c.q AS tot FROM assigned a CROSS JOIN cst c"),
    ("ab", "SELECT seller_nickname, own, MAX(CASE WHEN other = own THEN tot / NULLIF(n - 1, 0) END) AS a, "
           "MIN(CASE WHEN other <> own THEN tot / n END) AS b, MAX(CASE WHEN other = own THEN n END) AS n_own "
           "FROM pd GROUP BY seller_nickname, own"),
    ("cc", "SELECT cluster_id, " + ", ".join(f"AVG({f}) AS {f}" for f in FEATURES) + " FROM assigned GROUP BY cluster_id"),
    ("spread", "SELECT a.cluster_id, AVG(sqrt(" + " + ".join(f"(a.{f} - c.{f}) * (a.{f} - c.{f})" for f in FEATURES) +
               ")) AS s FROM assigned a JOIN cc c ON a.cluster_id = c.cluster_id GROUP BY a.cluster_id"),
    ("gm", "SELECT " + ", ".join(f"AVG({f}) AS {f}" for f in FEATURES) + " FROM assigned"),
]


def C(body: str, *more) -> str:
    return with_ctes(body, *LABEL_CTES, *EXTRA, *more)


def _points(c):
    return km.assign_with_features(c.model.scaled, c.ref_centroids)


@register("silhouette", C(
    "SELECT CAST(COUNT(DISTINCT own) AS INTEGER) AS n_clusters, " +
    rnd("AVG(CASE WHEN n_own <= 1 THEN 0.0 ELSE COALESCE((b - a) / NULLIF(GREATEST(a, b), 0), 0.0) END)", "silhouette") +
    " FROM ab"))
def q_silhouette(spark, sf_dir):
    """10.2: exact mean squared-Euclidean silhouette of the reference-centroid labels."""
    return ev.silhouette(_points(ctx(spark, sf_dir)))


_EUCLID = [
    ("anch", f"SELECT seller_nickname, cluster_id, {', '.join(FEATURES)}, (rk - 1) % 8 AS g FROM (SELECT *, ROW_NUMBER() OVER "
             "(PARTITION BY cluster_id ORDER BY md5(seller_nickname), seller_nickname) AS rk FROM assigned) t WHERE rk <= 1024"),
    ("pairs", "SELECT a.seller_nickname, a.cluster_id AS own, x.cluster_id AS other, x.g, COUNT(*) FILTER (WHERE x.seller_nickname <> a.seller_nickname) AS n, SUM(sqrt(" +
              " + ".join(f"(a.{f} - x.{f}) * (a.{f} - x.{f})" for f in FEATURES) + ")) AS d FROM assigned a CROSS JOIN anch x GROUP BY a.seller_nickname, a.cluster_id, x.cluster_id, x.g"),
    ("less", "SELECT seller_nickname, own, other, r, SUM(n) AS n, SUM(d) AS d FROM pairs CROSS JOIN range(9) q(r) WHERE g <> r GROUP BY seller_nickname, own, other, r"),
    ("sil", "SELECT seller_nickname, r, CASE WHEN a IS NULL THEN 0.0 ELSE COALESCE((b - a) / NULLIF(GREATEST(a, b), 0), 0.0) END AS s FROM ("
            "SELECT seller_nickname, r, MAX(CASE WHEN own = other AND n > 0 THEN d / n END) AS a, MIN(CASE WHEN own <> other AND n > 0 THEN d / n END) AS b "
            "FROM less GROUP BY seller_nickname, r) t"),
    ("runs", "SELECT r, AVG(s) AS v FROM sil GROUP BY r"),
]


@register("silhouette_euclidean", C(
    "SELECT CAST((SELECT COUNT(DISTINCT cluster_id) FROM assigned) AS INTEGER) AS n_clusters, (SELECT COUNT(*) FROM assigned) AS points, "
    "(SELECT COUNT(*) FROM anch) AS anchors, " +
    rnd("(SELECT AVG(CASE WHEN n_own <= 1 THEN 0.0 ELSE COALESCE((b - a) / NULLIF(GREATEST(a, b), 0), 0.0) END) FROM ab)", "silhouette") + ", " +
    rnd("(SELECT v FROM runs WHERE r = 8)", "silhouette_euclidean") + ", " +
    rnd("(SELECT sqrt(VAR_POP(v) * 7 * (1.0::DOUBLE - (SELECT COUNT(*) FROM anch)::DOUBLE / (SELECT COUNT(*) FROM assigned))) FROM runs WHERE r < 8)", "standard_error"),
    *_EUCLID))
def q_silhouette_euclidean(spark, sf_dir):
    """10.2: mean Euclidean silhouette against at most 1,024 anchors a cluster, with its standard error."""
    return euclidean_silhouette(_points(ctx(spark, sf_dir)))


@register("davies_bouldin", C(
    "SELECT CAST(COUNT(*) AS INTEGER) AS n_clusters, " + rnd("AVG(r)", "davies_bouldin") + " FROM ("
    "SELECT i.cluster_id, MAX((si.s + sj.s) / sqrt(" +
    " + ".join(f"(i.{f} - j.{f}) * (i.{f} - j.{f})" for f in FEATURES) +
    ")) AS r FROM cc i JOIN cc j ON i.cluster_id <> j.cluster_id JOIN spread si ON si.cluster_id = i.cluster_id "
    "JOIN spread sj ON sj.cluster_id = j.cluster_id GROUP BY i.cluster_id) t"))
def q_db(spark, sf_dir):
    """10.3a: Davies-Bouldin index of the reference-centroid labels."""
    return ev.davies_bouldin(_points(ctx(spark, sf_dir)))


_SSB = ("(SELECT SUM(x.n * (" + " + ".join(f"(x.{f} - g.{f}) * (x.{f} - g.{f})" for f in FEATURES) + ")) FROM "
        "(SELECT cc.*, (SELECT COUNT(*) FROM assigned a WHERE a.cluster_id = cc.cluster_id) AS n FROM cc) x CROSS JOIN gm g)")
_SSW = ("(SELECT SUM(" + " + ".join(f"(a.{f} - c.{f}) * (a.{f} - c.{f})" for f in FEATURES) +
        ") FROM assigned a JOIN cc c ON a.cluster_id = c.cluster_id)")
_CH_SQL = C(
    "SELECT CAST((SELECT COUNT(*) FROM cc) AS INTEGER) AS n_clusters, " +
    rnd("(ssb / ((SELECT COUNT(*) FROM cc) - 1)) / (ssw / ((SELECT COUNT(*) FROM assigned) - (SELECT COUNT(*) FROM cc)))",
        "calinski_harabasz", 10) + f" FROM (SELECT {_SSB} AS ssb, {_SSW} AS ssw) t")


@register("calinski_harabasz", _CH_SQL, bits=10)
def q_ch(spark, sf_dir):
    """10.3b: Calinski-Harabasz index of the reference-centroid labels."""
    return ev.calinski_harabasz(_points(ctx(spark, sf_dir)))


@register("total_sum_squares", C(
    "SELECT CAST(COUNT(*) AS BIGINT) AS n, " + rnd(" + ".join(f"var_pop({f}) * COUNT(*)" for f in FEATURES),
                                                    "total_sum_squares", 12) + " FROM scaled"), bits=12)
def q_tss(spark, sf_dir):
    """10.1 (k = 1): total sum of squares of the scaled matrix."""
    return km.total_sum_squares(ctx(spark, sf_dir).model.scaled)


@register("feature_covariance", C("\nUNION ALL\n".join(
    f"SELECT '{x}' AS col_x, '{y}' AS col_y, {i} AS x_position, {j} AS y_position, {rnd(f'covar_samp({x}, {y})', 'covariance')} FROM scaled"
    for i, x in enumerate(FEATURES) for j, y in enumerate(FEATURES))))
def q_cov(spark, sf_dir):
    """11.3: sample covariance of the scaled features (input of PCA), one scan."""
    merged = gram.merge_partials(gram.gram_partials(ctx(spark, sf_dir).model.scaled, FEATURES))
    return gram.covariance_from_partials(merged, FEATURES).drop("n")


PRICED = ["price", "stock", "regular_price", "ventas"]


@register("covariance_by_stored_months", with_ctes("\nUNION ALL\n".join(
    f"SELECT '{x}' AS col_x, '{y}' AS col_y, {i} AS x_position, {j} AS y_position, COUNT(*) AS n, "
    f"{rnd(f'covar_samp(CAST({x} AS DOUBLE), CAST({y} AS DOUBLE))', 'covariance', 8)} FROM listings WHERE " +
    " AND ".join(f"{c} IS NOT NULL" for c in PRICED)
    for i, x in enumerate(PRICED) for j, y in enumerate(PRICED))), bits=8)
def q_stored_covariance(spark, sf_dir):
    """11.3: covariance of the listings merged from partials stored per month of publication, each month written once."""
    c = ctx(spark, sf_dir)
    months = c.listings.withColumn("month", F.date_format("published_on", "yyyy-MM"))
    path = c.path("gram-months")
    sinks.append_snapshot(gram.merge_partials(gram.gram_partials(months, PRICED, ["month"]), ["month"]), path, "month")
    return gram.covariance_from_partials(gram.merge_partials(spark.read.parquet(path)), PRICED)


def _sweep(c):
    """One batched k-means sweep (k = 2..14, 10 restarts, seed 42) shared by the
    curve, the elbow, the final fit and the quality table."""
    if getattr(c, "_sweep", None) is None:
        c._sweep = km.fit_sweep(c.model.scaled, range(2, 15), n_init=10, max_iter=300)
    return c._sweep


def _curve(c):
    if getattr(c, "_curve", None) is None:
        tss = km.total_sum_squares(c.model.scaled).collect()[0]["total_sum_squares"]
        rows = [(1, float(tss))] + [(k, float(v[1])) for k, v in sorted(_sweep(c).items())]
        c._curve = c.spark.createDataFrame(rows, "k int, inertia double")
    return c._curve


@register("inertia_curve", bits=8)
def q_inertia(spark, sf_dir):
    """10.1: best-of-10 k-means inertia for k = 1..14."""
    return _curve(ctx(spark, sf_dir))


@register("elbow_k")
def q_elbow(spark, sf_dir):
    """10.4: Kneedle elbow of the inertia curve (fallback 3)."""
    return kneedle(_curve(ctx(spark, sf_dir)))


BANDS = 14
_BANDS = [
    ("span", "SELECT MIN(price) AS lo, MAX(price) AS hi FROM listings"),
    ("band", f"SELECT k, LEAST(k - 1, COALESCE(FLOOR((price - lo) / NULLIF(hi - lo, 0) * k), 0)) AS b, price FROM listings CROSS JOIN span "
             f"CROSS JOIN range(1, {BANDS + 1}) r(k) WHERE price IS NOT NULL"),
    ("crv", "SELECT k, SUM(ss) / (SELECT VAR_POP(price) * COUNT(price) FROM listings) AS ss FROM (SELECT k, b, VAR_POP(price) * COUNT(*) AS ss FROM band GROUP BY k, b) t GROUP BY k"),
    ("bent", f"SELECT k, 1.0::DOUBLE - (ss - MIN(ss) OVER ()) / NULLIF(MAX(ss) OVER () - MIN(ss) OVER (), 0) - (k - 1) / {BANDS - 1}.0::DOUBLE AS d FROM crv"),
    ("turn", "SELECT k, d, LEAD(d) OVER (ORDER BY k) AS nd, d >= LAG(d, 1, d) OVER (ORDER BY k) AND d >= LEAD(d, 1, d) OVER (ORDER BY k) AS top, "
             "d <= LAG(d, 1, d) OVER (ORDER BY k) AND d <= LEAD(d, 1, d) OVER (ORDER BY k) AS low FROM bent"),
    ("cand", f"SELECT t.k AS knee, t.d - 1 / {BANDS - 1}.0::DOUBLE AS floor_, (SELECT MIN(u.k) FROM turn u WHERE u.k > t.k AND u.top) AS next_top, "
             "(SELECT MIN(u.k) FROM turn u WHERE u.k >= t.k AND u.low) AS next_low FROM turn t WHERE t.top"),
    ("drop_", "SELECT c.knee, MIN(u.k) AS hit FROM cand c JOIN turn u ON u.k >= c.knee AND (c.next_top IS NULL OR u.k < c.next_top) "
              "AND u.nd < CASE WHEN u.k >= c.next_low THEN 0.0 ELSE c.floor_ END GROUP BY c.knee"),
]


def _price_bands(c):
    """Sum of squares of the prices within k bands of equal width, as a share of that of all prices, for every k in one pass."""
    span = c.listings.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    lo, hi = span.select("lo").scalar(), span.select("hi").scalar()
    k = F.explode(F.sequence(F.lit(1), F.lit(BANDS)))
    rows = c.listings.where(F.col("price").isNotNull()).select("price", k.alias("k"))
    at = F.coalesce(F.floor(F.try_divide(F.col("price") - lo, hi - lo) * F.col("k")), F.lit(0))
    per = rows.groupBy("k", F.least(F.col("k") - 1, at).alias("b")).agg((F.var_pop("price") * F.count(F.lit(1))).alias("ss"))
    total = c.listings.agg((F.var_pop("price") * F.count("price")).alias("total")).scalar()
    return per.groupBy("k").agg(F.try_divide(F.sum("ss"), total).alias("inertia"))


@register("price_band_curve", with_ctes("SELECT CAST(k AS INTEGER) AS k, " + rnd("ss", "inertia") + " FROM crv", *_BANDS))
def q_price_band_curve(spark, sf_dir):
    """10.1: spread of the prices within k bands of equal width, k = 1..14."""
    return _price_bands(ctx(spark, sf_dir))


@register("price_band_elbow", with_ctes(
    "SELECT CAST(COALESCE((SELECT knee FROM drop_ ORDER BY hit, knee DESC LIMIT 1), 3) AS INTEGER) AS elbow_k, EXISTS (SELECT 1 FROM drop_) AS found", *_BANDS))
def q_price_band_elbow(spark, sf_dir):
    """10.4: how many price bands to take, by the elbow of their curve (the rule of ``elbow_k`` on a curve that SQL has too)."""
    return kneedle(_price_bands(ctx(spark, sf_dir)))


def _fit(c):
    if getattr(c, "_fit", None) is None:
        k = kneedle(_curve(c)).collect()[0]["elbow_k"]
        labels, cents, cost = scoring.segment_sellers(c.model, k, fits=_sweep(c))
        c._fit = (labels.cache(), cents.cache(), cost, k)
    return c._fit


@register("segment_sellers")
def q_segment_sellers(spark, sf_dir):
    """12.1/12.2: k-means (elbow k, 10 restarts) labels, canonically renumbered and named."""
    return _fit(ctx(spark, sf_dir))[0]


@register("fitted_centroids")
def q_fitted_centroids(spark, sf_dir):
    """12.1: fitted centroids in scaled units (canonical ids)."""
    return _fit(ctx(spark, sf_dir))[1]


@register("score_sellers_fitted")
def q_score_fitted(spark, sf_dir):
    """1.8, 12.7: the fitted model saved, read back, and raw seller features scored with it."""
    from ..streaming.scoring import score_frame
    c = ctx(spark, sf_dir)
    path = c.path("fitted-model")
    scoring.save_model(path, c.model.params, _fit(c)[1])
    params, cents = scoring.load_model(spark, path)
    return score_frame(c.model.features, params, cents)


@register("score_sellers_saved_model", ORACLES["score_sellers"])
def q_score_saved(spark, sf_dir):
    """1.8, 12.7: the reference model saved, read back, and raw seller features scored with it: nearest saved centroid."""
    from ..streaming.scoring import score_frame
    c = ctx(spark, sf_dir)
    path = c.path("reference-model")
    scoring.save_model(path, c.model.params, relabel_centroids(c.ref_centroids, c.ref_mapping()))
    return score_frame(c.model.features, *scoring.load_model(spark, path)).select("seller_nickname", "cluster_id", "segment_name", "distance2")


@register("fit_fixed_point", with_ctes("SELECT COUNT(*) AS sellers, TRUE AS settled, TRUE AS cost_confirmed, TRUE AS beats_reference FROM scaled"))
def q_fixed_point(spark, sf_dir):
    """12.1, 12.8: one more Lloyd step from the fitted centroids moves them within the fit's tolerance, the members' distances
    add up to its cost, and that cost is no larger than the reference centroids'."""
    c = ctx(spark, sf_dir)
    _, cents, cost, _ = _fit(c)
    members = km.assign_with_features(c.model.scaled, cents)
    total = members.agg(F.count(F.lit(1)).alias("sellers"), F.sum("distance2").alias("cost"))
    step = km.lloyd_step(c.model.scaled, cents).alias("s").join(cents.alias("c"), "cluster_id")  # one row per cluster
    moved = step.agg(F.sum(sum((F.pow(F.col(f"s.{f}") - F.col(f"c.{f}"), 2) for f in FEATURES), F.lit(0.0))).alias("moved"))
    spread = c.model.scaled.agg((sum((F.var_pop(f) for f in FEATURES), F.lit(0.0)) / len(FEATURES)).alias("spread"))
    other = _points(c).agg(F.sum("distance2").alias("other"))
    return total.select(
        "sellers", (moved.scalar() <= F.lit(km.TOLERANCE) * spread.scalar()).alias("settled"),
        (F.abs(F.col("cost") - F.lit(float(cost))) <= 1e-9 * F.lit(float(cost))).alias("cost_confirmed"),
        (F.col("cost") <= other.scalar()).alias("beats_reference"))


def _written(c, df, name, fmt="parquet"):
    """``df`` written as an output table of the run and read back."""
    path = c.path(name)
    sinks.write_table(df, path, fmt)
    return c.spark.read.schema(df.schema).option("header", "true").format(fmt).load(path)


@register("written_scaled_features", with_ctes(
    "SELECT seller_nickname, " + ", ".join(rnd(f, f) for f in FEATURES) + " FROM scaled"))
def q_written_scaled(spark, sf_dir):
    """1.5: the scaled feature matrix written as Parquet and read back."""
    c = ctx(spark, sf_dir)
    return _written(c, c.model.scaled, "scaled-features")


@register("written_segment_labels", with_ctes(
    "SELECT seller_nickname, cluster_id, " + rnd("distance2", "distance2") + " FROM seg_labels", *LABEL_CTES))
def q_written_labels(spark, sf_dir):
    """1.5: the labelled sellers written as CSV and read back."""
    c = ctx(spark, sf_dir)
    return _written(c, c.ref_labels(), "segment-labels", "csv")


@register("written_centroids", with_ctes("SELECT m.cluster_id, " + ", ".join(rnd(f"c.{f}", f) for f in FEATURES) +
                                         " FROM cents c JOIN cmap m ON c.cluster_id = m.raw_id", *LABEL_CTES))
def q_written_centroids(spark, sf_dir):
    """1.5: the reference centroids (canonical ids) written as CSV and read back."""
    c = ctx(spark, sf_dir)
    return _written(c, relabel_centroids(c.ref_centroids, c.ref_mapping()), "centroids", "csv")


@register("written_loadings", bits=None)
def q_written_loadings(spark, sf_dir):
    """1.5: the component loadings written as CSV and read back."""
    c = ctx(spark, sf_dir)
    return _written(c, pca.pca_loadings(spark, _pca(c)), "loadings", "csv")


@register("pca_variance_identity", C(
    "SELECT " + rnd(" + ".join(f"var_samp({f})" for f in FEATURES), "total_variance", 16) + ", CAST(COUNT(*) AS BIGINT) AS sellers FROM scaled"),
    bits_of={"total_variance": 16})
def q_pca_identity(spark, sf_dir):
    """11.1: the variances of all nine components add up to the features' total variance."""
    c = ctx(spark, sf_dir)
    fit = pca.fit_pca(c.model.scaled, FEATURES, len(FEATURES))
    proj = pca.pca_projection(c.model.scaled, fit)
    total = sum((F.var_samp(f"pc{i + 1}") for i in range(len(FEATURES))), F.lit(0.0))
    return proj.agg(total.alias("total_variance"), F.count(F.lit(1)).alias("sellers"))


@register("cluster_quality", bits=10)
def q_quality(spark, sf_dir):
    """10.5: silhouette / DB / CH / inertia for k = 2..10 (best of the sweep's 10 restarts)."""
    c = ctx(spark, sf_dir)
    return ev.cluster_quality(c.model.scaled, range(2, 11), fits=_sweep(c))


@register("cluster_quality_minibatch", bits=10)
def q_quality_minibatch(spark, sf_dir):
    """10.5: the same table for k = 2..10 from mini-batch k-means (best of 3 restarts, 3 passes of 8 batches)."""
    scaled = ctx(spark, sf_dir).model.scaled
    return ev.cluster_quality(scaled, range(2, 11), fits=fit_minibatch(scaled, range(2, 11)))


@register("pca_reconstruction", ORACLES["scaled_features"])
def q_pca_reconstruction(spark, sf_dir):
    """11.1, 11.2: the scaled features rebuilt from all nine components, their loadings and means."""
    c = ctx(spark, sf_dir)
    fit = pca.fit_pca(c.model.scaled, FEATURES, len(FEATURES))
    return pca.pca_inverse(pca.pca_projection(c.model.scaled, fit), fit)


def _pca(c):
    if getattr(c, "_pca", None) is None:
        c._pca = pca.fit_pca(c.model.scaled, FEATURES, 2)
    return c._pca


@register("pca_projection")
def q_pca_proj(spark, sf_dir):
    """11.1: centred two-component projection per seller."""
    c = ctx(spark, sf_dir)
    return pca.pca_projection(c.model.scaled, _pca(c))


@register("pca_loadings", bits=None)
def q_pca_load(spark, sf_dir):
    """11.2: loadings (feature x 2), 3 decimals."""
    return pca.pca_loadings(spark, _pca(ctx(spark, sf_dir)))


@register("pca_top_features", bits=None)
def q_pca_top(spark, sf_dir):
    """9.1: top-5 absolute loadings per component."""
    return pca.pca_top_features(pca.pca_loadings(spark, _pca(ctx(spark, sf_dir))), 5)


@register("pca_explained_variance")
def q_pca_var(spark, sf_dir):
    """11.x: explained variance and ratio of the two components."""
    return pca.explained_variance(spark, _pca(ctx(spark, sf_dir)))


@register("pca_clusters")
def q_pca_clusters(spark, sf_dir):
    """11.4: projection joined with the reference-centroid labels (plot data)."""
    c = ctx(spark, sf_dir)
    return pca.pca_projection(c.model.scaled, _pca(c)).join(c.ref_labels().select("seller_nickname", "cluster_id"),
                                                            "seller_nickname")


SEGMENT_PROFILE_SQL = C("\nUNION ALL\n".join(
    f"SELECT l.cluster_id, '{f}' AS feature, {rnd(f'AVG(s.{f})', 'mean')}, {rnd(f'quantile_cont(s.{f}, 0.5)', 'median')} "
    f"FROM seg_labels l JOIN scaled s ON l.seller_nickname = s.seller_nickname GROUP BY l.cluster_id" for f in FEATURES))


@register("segment_profile", SEGMENT_PROFILE_SQL)
def q_segment_profile(spark, sf_dir):
    """12.3: mean and exact median of every scaled feature per segment."""
    c = ctx(spark, sf_dir)
    pts = c.ref_points()
    means = pts.groupBy("cluster_id").agg(*[F.avg(f).alias(f) for f in FEATURES])
    means_long = means.select("cluster_id", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"), F.col(f).alias("mean")) for f in FEATURES])))
    med = exact_quantiles(pts, FEATURES, [0.5], by=["cluster_id"]).select(
        "cluster_id", F.col("column").alias("feature"), F.col("quantile").alias("median"))
    return means_long.join(med, ["cluster_id", "feature"])


@register("written_cluster_statistics", SEGMENT_PROFILE_SQL)
def q_written_statistics(spark, sf_dir):
    """1.5: the statistics of the segments written as CSV and read back."""
    return _written(ctx(spark, sf_dir), q_segment_profile(spark, sf_dir), "cluster-statistics", "csv")


@register("centroids_original_units", C(
    "SELECT m.cluster_id, " + ", ".join(rnd(f"c.{f} * p.{f}__scale + p.{f}__median", f) for f in FEATURES) +
    " FROM cents c JOIN cmap m ON c.cluster_id = m.raw_id CROSS JOIN sp p"))
def q_centroids_orig(spark, sf_dir):
    """12.4: reference centroids mapped back to original units (inverse robust scaling)."""
    c = ctx(spark, sf_dir)
    cents = relabel_centroids(c.ref_centroids, c.ref_mapping())
    return inverse_scale(cents, c.model.params)


@register("segment_zscores", C("\nUNION ALL\n".join(
    f"SELECT l.cluster_id, '{f}' AS feature, {rnd(f'(AVG(s.{f}) - (SELECT AVG({f}) FROM sf)) / (SELECT STDDEV_SAMP({f}) FROM sf)', 'zscore')} "
    f"FROM seg_labels l JOIN sf s ON l.seller_nickname = s.seller_nickname GROUP BY l.cluster_id" for f in FEATURES)))
def q_zscores(spark, sf_dir):
    """12.9: z-score of each segment's mean raw feature against the seller population."""
    c = ctx(spark, sf_dir)
    feats = c.model.features
    pts = c.ref_labels().select("seller_nickname", "cluster_id").join(feats, "seller_nickname")
    # population mean / std of every feature: one aggregate, one scalar subquery (a struct)
    pop = feats.select(F.struct(*[F.avg(f).alias(f"m_{f}") for f in FEATURES],
                                *[F.stddev_samp(f).alias(f"s_{f}") for f in FEATURES])).scalar()
    g = pts.groupBy("cluster_id").agg(*[F.avg(f).alias(f) for f in FEATURES])
    return g.select("cluster_id", F.inline(F.array(*[
        F.struct(F.lit(f).alias("feature"),
                 F.try_divide(F.col(f) - pop.getField(f"m_{f}"), pop.getField(f"s_{f}")).alias("zscore"))
        for f in FEATURES])))
