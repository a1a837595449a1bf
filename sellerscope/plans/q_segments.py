"""Registered segment-use queries: playbook, GMV, payload, prompts, season, alerts, migration (ops 12.9-13.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import kmeans as km
from ..operators import segments as sg
from ..operators.features import FEATURES, seller_features
from ..operators.preprocess import robust_scale
from ..operators.segments import relabel
from ..sources import sinks
from .oracle_sql import REP_CASE, rnd, snap, with_ctes
from .registry import LABEL_CTES, SEGNAME_SQL, ctx, register

AS_OF = "2024-08-01"
S = "seller_nickname"


def _case(mapping: dict, col: str = "cluster_id", default: str = "NULL") -> str:
    return f"CASE {col} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in mapping.items()) + f" ELSE {default} END"


def _calendar_values() -> str:
    import datetime as dt
    rows = []
    for name, sm, sd, em, ed, prio in sg.DEFAULT_CALENDAR:
        d, end = dt.date(2000, sm, sd), dt.date(2000, em, ed)
        while d <= end:
            rows.append(f"({d.month * 100 + d.day}, '{name}', {prio})")
            d += dt.timedelta(days=1)
    return "SELECT * FROM (VALUES " + ", ".join(rows) + ") AS t(month_day, campaign, priority)"


EXTRA = [
    ("sgmv", f"SELECT {S}, SUM(gmv) AS gmv, AVG(CAST(COALESCE({REP_CASE}, 0) AS DOUBLE)) AS rep_score "
             f"FROM listings WHERE {S} IS NOT NULL GROUP BY {S}"),
    ("payload", f"""SELECT DATE '{AS_OF}' AS fecha_actual, m.{S}, {SEGNAME_SQL.replace('cluster_id', 'l.cluster_id')} AS cluster_name,
  m.publicaciones, m.categorias_distintas, m.stock_promedio, m.precio_medio_cop, m.descuento_pct, m.rep_score,
  CAST(NULL AS DOUBLE) AS tasa_cancelacion
FROM (SELECT {S}, CAST(COUNT(*) AS BIGINT) AS publicaciones, CAST(COUNT(DISTINCT category_id) AS BIGINT) AS categorias_distintas,
        ROUND({snap("AVG(stock)")}, 1) AS stock_promedio, CAST(ROUND({snap("AVG(price)")}, 0) AS BIGINT) AS precio_medio_cop,
        AVG(discount_pct) AS descuento_pct, ROUND({snap("AVG(rep_score)")}, 1) AS rep_score
      FROM lf WHERE {S} IS NOT NULL GROUP BY {S}) m JOIN seg_labels l ON m.{S} = l.{S}"""),
    ("cal", _calendar_values()),
    ("season", "SELECT date, COALESCE(campaign, 'Ninguna campaña') AS season FROM ("
               "SELECT d.date, c.campaign, ROW_NUMBER() OVER (PARTITION BY d.date ORDER BY c.priority NULLS LAST, c.campaign) AS rn "
               "FROM (SELECT DISTINCT snapshot_on AS date FROM listings WHERE snapshot_on IS NOT NULL) d "
               "LEFT JOIN cal c ON month(d.date) * 100 + day(d.date) = c.month_day) t WHERE rn = 1"),
]


def G(body: str, *more) -> str:
    return with_ctes(body, *LABEL_CTES, *EXTRA, *more)


def _labels(c):
    return c.ref_labels()


@register("segment_playbook", G(
    f"SELECT cluster_id, {SEGNAME_SQL} AS segment_name, {_case({i: a for i, (a, _) in sg.DEFAULT_PLAYBOOK.items()})} AS action, "
    f"{_case({i: k for i, (_, k) in sg.DEFAULT_PLAYBOOK.items()})} AS kpi, CAST(COUNT(*) AS BIGINT) AS sellers FROM seg_labels GROUP BY cluster_id"))
def q_playbook(spark, sf_dir):
    """13.4: sellers per segment with its action and KPI."""
    return sg.segment_playbook(_labels(ctx(spark, sf_dir)))


@register("segment_gmv_share", G(
    f"SELECT l.cluster_id, {SEGNAME_SQL.replace('cluster_id', 'l.cluster_id')} AS segment_name, "
    + rnd("SUM(g.gmv)", "gmv", 8) + ", " + rnd("SUM(g.gmv) / (SELECT SUM(gmv) FROM sgmv)", "gmv_share") +
    f" FROM seg_labels l JOIN sgmv g ON l.{S} = g.{S} GROUP BY l.cluster_id"), bits_of={"gmv": 8})
def q_gmv_share(spark, sf_dir):
    """12.10: share of GMV per segment."""
    c = ctx(spark, sf_dir)
    seller = sg.seller_gmv(c.listings)
    total = seller.select(F.sum("gmv")).scalar()
    j = _labels(c).join(seller, S)
    return j.groupBy("cluster_id").agg(F.sum("gmv").alias("gmv")).select(
        "cluster_id", sg.segment_name("cluster_id").alias("segment_name"), "gmv",
        F.try_divide(F.col("gmv"), total).alias("gmv_share"))


@register("strategy_payload", G(
    f"SELECT CAST(fecha_actual AS VARCHAR) AS fecha_actual, {S}, cluster_name, publicaciones, categorias_distintas, "
    "stock_promedio, precio_medio_cop, " + rnd("descuento_pct", "descuento_pct") + ", rep_score, tasa_cancelacion FROM payload"),
    keep=("stock_promedio", "rep_score"))
def q_payload(spark, sf_dir):
    """13.1: per-seller prompt inputs (segment name + metrics)."""
    c = ctx(spark, sf_dir)
    return sg.strategy_payload(c.listings, _labels(c), as_of=AS_OF)


_PROMPT = ("concat('seller profile on ', CAST(p.fecha_actual AS VARCHAR), ', campaign: ', COALESCE(s.season, 'Ninguna campaña'), "
           "chr(10) || 'group = ', p.cluster_name, chr(10) || 'listings = ', CAST(p.publicaciones AS VARCHAR), "
           "chr(10) || 'categories = ', CAST(p.categorias_distintas AS VARCHAR), "
           "chr(10) || 'units in stock, mean = ', COALESCE(printf('%.1f', p.stock_promedio), 'n/d'), "
           "chr(10) || 'price, mean = ', COALESCE(format('{:,}', p.precio_medio_cop), 'n/d'), "
           "chr(10) || 'discount, mean = ', COALESCE(printf('%d%%', CAST(ROUND(" + snap("p.descuento_pct") + " * 100, 0) AS BIGINT)), 'n/d'), "
           "chr(10) || 'reputation (0 to 5) = ', COALESCE(printf('%.1f', p.rep_score), 'n/d'), "
           "chr(10) || 'cancelled = ', COALESCE(printf('%.1f%%', ROUND(" + snap("p.tasa_cancelacion") + " * 100, 1)), 'n/d'), "
           "chr(10) || 'Name the next step for this seller and the figure that would show it worked.')")


@register("strategy_prompts", G(
    f"SELECT p.{S}, p.cluster_name, {_PROMPT} AS prompt FROM payload p LEFT JOIN ("
    "SELECT month_day, campaign AS season FROM (SELECT month_day, campaign, ROW_NUMBER() OVER (PARTITION BY month_day "
    "ORDER BY priority, campaign) AS rn FROM cal) c WHERE rn = 1) s "
    "ON month(p.fecha_actual) * 100 + day(p.fecha_actual) = s.month_day"))
def q_prompts(spark, sf_dir):
    """13.2: rendered strategy prompt per seller, with the season of the as-of date."""
    c = ctx(spark, sf_dir)
    payload = sg.strategy_payload(c.listings, _labels(c), as_of=AS_OF)
    return sg.strategy_prompts(payload.withColumn("season", F.lit(sg.season_of(AS_OF))), season_col="season")


@register("season_context", G("SELECT CAST(date AS VARCHAR) AS date, season FROM season"))
def q_season(spark, sf_dir):
    """13.3: campaign context of every snapshot date (range join as month-day equi-join)."""
    return sg.season_context(ctx(spark, sf_dir).listings, "snapshot_on")


@register("promotion_alerts", G(
    f"SELECT g.{S}, " + rnd("g.gmv", "gmv", 8) + ", " + rnd("g.rep_score", "rep_score") +
    f", 'candidate' AS alert FROM sgmv g JOIN seg_labels l ON g.{S} = l.{S} "
    "WHERE l.cluster_id = 2 AND g.gmv > 50000 AND g.rep_score >= 4"), bits_of={"gmv": 8})
def q_promotion(spark, sf_dir):
    """13.5: growing sellers with GMV > 50,000 and reputation >= 4."""
    c = ctx(spark, sf_dir)
    return sg.promotion_alerts(sg.seller_gmv(c.listings), _labels(c))


@register("churn_alerts", G(
    f"SELECT {S}, CAST(snapshot_on AS VARCHAR) AS snapshot_on, " + rnd("prev_rep", "prev_rep") + ", " + rnd("rep", "rep") +
    ", 'churn_risk' AS alert FROM ("
    f"SELECT {S}, snapshot_on, rep, LAG(rep) OVER (PARTITION BY {S} ORDER BY snapshot_on) AS prev_rep FROM ("
    f"SELECT x.{S}, x.snapshot_on, AVG(x.snapshot_rep) AS rep FROM listings x "
    f"WHERE x.{S} IN (SELECT {S} FROM seg_labels WHERE cluster_id = 1) GROUP BY x.{S}, x.snapshot_on) d) t "
    "WHERE rep < prev_rep"))
def q_churn(spark, sf_dir):
    """13.6: power sellers whose reputation falls between consecutive snapshots."""
    c = ctx(spark, sf_dir)
    return sg.churn_alerts(c.listings, _labels(c))


@register("segment_gmv_growth", G(
    "SELECT cluster_id, month, " + rnd("gmv", "gmv", 8) + ", " + rnd("prev_gmv", "prev_gmv", 8) + ", " +
    rnd("(gmv - prev_gmv) / NULLIF(prev_gmv, 0)", "growth") + " FROM ("
    "SELECT cluster_id, month, gmv, LAG(gmv) OVER (PARTITION BY cluster_id ORDER BY month) AS prev_gmv FROM ("
    f"SELECT l.cluster_id, strftime(x.snapshot_on, '%Y-%m') AS month, SUM(x.gmv) AS gmv FROM listings x "
    f"JOIN seg_labels l ON x.{S} = l.{S} GROUP BY l.cluster_id, strftime(x.snapshot_on, '%Y-%m')) m) t"), bits_of={"gmv": 8, "prev_gmv": 8})
def q_gmv_growth(spark, sf_dir):
    """13.8: month-over-month GMV per segment."""
    c = ctx(spark, sf_dir)
    return sg.segment_gmv_growth(c.listings, _labels(c))


# --- label snapshots per year -> migration --------------------------------------

_SF_Y = ("SELECT seller_nickname, CAST(year(snapshot_on) AS INTEGER) AS period, "
         "CAST(COUNT(DISTINCT category_id) AS DOUBLE) AS categorias_distintas, AVG(ln(1 + price)) AS log_price_avg, "
         "AVG(ln(1 + CAST(stock AS DOUBLE))) AS log_stock_avg, CAST(COUNT(*) AS DOUBLE) AS num_publicaciones, "
         "AVG(discount_pct) AS porc_descuento, AVG(CAST(is_refurbished AS DOUBLE)) AS proporcion_refurb, "
         "AVG(CASE WHEN condition = 'used' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS proporcion_usados, "
         "AVG(rep_score) AS rep_score, AVG(title_len) AS titulo_length_avg "
         "FROM lf WHERE seller_nickname IS NOT NULL GROUP BY seller_nickname, year(snapshot_on)")
_SC_Y = ("SELECT seller_nickname, period, " + ", ".join(
    f"(COALESCE({f}, {f}__median) - {f}__median) / {f}__scale AS {f}" for f in FEATURES) + " FROM sf_y CROSS JOIN sp")
_D = lambda i: " + ".join(f"(s.{f} - c{i}.{f}) * (s.{f} - c{i}.{f})" for f in FEATURES)
_AS_Y = ("SELECT seller_nickname, period, CASE WHEN d0 <= least(d0, d1, d2) THEN 0 WHEN d1 <= least(d0, d1, d2) THEN 1 "
         "ELSE 2 END AS raw_id FROM (SELECT s.seller_nickname, s.period, " +
         ", ".join(f"{_D(i)} AS d{i}" for i in range(3)) + " FROM sc_y s " +
         " ".join(f"CROSS JOIN (SELECT * FROM cents WHERE cluster_id = {i}) c{i}" for i in range(3)) + ") t")
_LAB_Y = "SELECT a.seller_nickname, a.period, m.cluster_id FROM as_y a JOIN cmap m ON a.raw_id = m.raw_id"
YEARLY = [("sf_y", _SF_Y), ("sc_y", _SC_Y), ("as_y", _AS_Y), ("lab_y", _LAB_Y)]


def period_labels(c, period):
    """Label snapshots: sellers re-scored on each period's listings with the global model."""
    feats = seller_features(c.listings.withColumn("period", period), by=["period"])
    scaled = robust_scale(feats, c.model.params, key=[S, "period"])
    raw = km.assign_with_features(scaled, c.ref_centroids).select(S, "period", "cluster_id")
    return relabel(raw, c.ref_mapping())


def yearly_labels(c):
    return period_labels(c, F.year("snapshot_on"))


@register("segment_migration", G(
    "SELECT a.period AS from_period, b.period AS to_period, a.cluster_id AS from_cluster, b.cluster_id AS to_cluster, "
    "CAST(COUNT(*) AS BIGINT) AS sellers FROM lab_y a JOIN lab_y b ON a.seller_nickname = b.seller_nickname "
    "AND b.period = a.period + 1 GROUP BY a.period, b.period, a.cluster_id, b.cluster_id", *YEARLY))
def q_migration(spark, sf_dir):
    """13.8: sellers moving between segments from one yearly snapshot to the next."""
    return sg.segment_migration(yearly_labels(ctx(spark, sf_dir)))


@register("label_history", G("SELECT seller_nickname, cluster_id, CAST(period AS VARCHAR) || '-12-31' AS label_date FROM lab_y", *YEARLY))
def q_label_history(spark, sf_dir):
    """13.7: label snapshots added to a history table, one partition per label date; writing a date again replaces it."""
    c = ctx(spark, sf_dir)
    path = c.path("label_history")
    labels = yearly_labels(c).withColumn("label_date", F.concat(F.col("period").cast("string"), F.lit("-12-31"))).drop("period")
    sinks.append_snapshot(labels, path, "label_date")
    return spark.read.parquet(path).select("seller_nickname", "cluster_id", F.col("label_date").cast("string").alias("label_date"))


_Q = "CAST(year(snapshot_on) * 4 + quarter(snapshot_on) - 1 AS INTEGER)"
QUARTERLY = [("sf_y", _SF_Y.replace("CAST(year(snapshot_on) AS INTEGER)", _Q).replace("GROUP BY seller_nickname, year(snapshot_on)", f"GROUP BY seller_nickname, {_Q}")), *YEARLY[1:]]


@register("segment_upgrades", G(
    "SELECT a.period AS from_period, a.cluster_id AS from_cluster, CAST(COUNT(*) AS BIGINT) AS sellers, "
    "CAST(COUNT(*) FILTER (WHERE b.cluster_id = 1) AS BIGINT) AS upgraded, " +
    rnd("CAST(COUNT(*) FILTER (WHERE b.cluster_id = 1) AS DOUBLE) / COUNT(*)", "upgrade_share") +
    " FROM lab_y a LEFT JOIN lab_y b ON a.seller_nickname = b.seller_nickname AND b.period = a.period + 1 "
    "WHERE a.cluster_id <> 1 GROUP BY a.period, a.cluster_id", *QUARTERLY))
def q_upgrades(spark, sf_dir):
    """13.8: per quarter (year * 4 + quarter - 1), the share of each segment's sellers that are power sellers a quarter later."""
    quarter = F.year("snapshot_on") * 4 + F.quarter("snapshot_on") - 1
    return sg.segment_upgrades(period_labels(ctx(spark, sf_dir), quarter))


# --- label validity, as-of churn, funnel, dated campaigns ----------------------

_HIST = "SELECT seller_nickname, cluster_id, make_date(CAST(period AS BIGINT), 12, 31) AS label_date FROM lab_y"
_SPANS = ("SELECT seller_nickname, cluster_id, valid_from, lead(valid_from) OVER (PARTITION BY seller_nickname ORDER BY valid_from) AS valid_to FROM ("
          "SELECT seller_nickname, cluster_id, label_date AS valid_from, lag(cluster_id) OVER (PARTITION BY seller_nickname ORDER BY label_date) AS was FROM hist) c "
          "WHERE was IS DISTINCT FROM cluster_id")
HISTORY = [*YEARLY, ("hist", _HIST), ("spans", _SPANS)]


def _history(c):
    return yearly_labels(c).select(S, "cluster_id", F.make_date("period", F.lit(12), F.lit(31)).alias("label_date"))


@register("label_intervals", G(
    f"SELECT s.{S}, s.cluster_id, CAST(valid_from AS VARCHAR) AS valid_from, CAST(valid_to AS VARCHAR) AS valid_to, "
    f"CAST(COUNT(*) AS BIGINT) AS snapshots FROM spans s JOIN hist h ON h.{S} = s.{S} AND h.label_date >= s.valid_from "
    f"AND (s.valid_to IS NULL OR h.label_date < s.valid_to) GROUP BY s.{S}, s.cluster_id, valid_from, valid_to", *HISTORY))
def q_label_intervals(spark, sf_dir):
    """13.7: the label history as validity intervals, one row per change of a seller's segment."""
    return sg.label_intervals(_history(ctx(spark, sf_dir)))


@register("churn_alerts_as_of", G(
    f"SELECT f.{S}, CAST(f.snapshot_on AS VARCHAR) AS snapshot_on, " + rnd("f.prev_rep", "prev_rep") + ", " + rnd("f.rep", "rep") +
    f", 'churn_risk' AS alert FROM (SELECT *, lag(rep) OVER (PARTITION BY {S} ORDER BY snapshot_on) AS prev_rep FROM ("
    f"SELECT {S}, snapshot_on, AVG(snapshot_rep) AS rep FROM listings WHERE {S} IS NOT NULL GROUP BY {S}, snapshot_on) d) f "
    f"ASOF JOIN spans s ON f.{S} = s.{S} AND f.snapshot_on >= s.valid_from WHERE f.rep < f.prev_rep AND s.cluster_id = 1", *HISTORY))
def q_churn_as_of(spark, sf_dir):
    """13.6: reputation falls of sellers that were power sellers on that day, by an as-of join with the label intervals."""
    c = ctx(spark, sf_dir)
    return sg.churn_alerts_as_of(c.listings, sg.label_intervals(_history(c)))


FUNNEL = (0, 2, 1)  # occasional, growing, power


@register("migration_funnel", G(
    "SELECT t.step, t.cluster_id, CAST(COUNT(r.m) FILTER (WHERE r.m >= t.step) AS BIGINT) AS sellers, " +
    rnd("CAST(COUNT(r.m) FILTER (WHERE r.m >= t.step) AS DOUBLE) / NULLIF(COUNT(r.m) FILTER (WHERE r.m >= t.step - 1), 0)", "share") +
    " FROM (VALUES " + ", ".join(f"({i}, {c})" for i, c in enumerate(FUNNEL, 1)) + ") t(step, cluster_id) CROSS JOIN ("
    "WITH RECURSIVE chg AS (SELECT seller_nickname, cluster_id, row_number() OVER (PARTITION BY seller_nickname ORDER BY period) AS i FROM ("
    "SELECT *, lag(cluster_id) OVER (PARTITION BY seller_nickname ORDER BY period) AS was FROM lab_y) x WHERE was IS DISTINCT FROM cluster_id), "
    "walk AS (SELECT seller_nickname, i, 1 AS k FROM chg WHERE cluster_id = " + str(FUNNEL[0]) + " UNION ALL SELECT c.seller_nickname, c.i, w.k + 1 "
    "FROM walk w JOIN chg c ON c.seller_nickname = w.seller_nickname AND c.i = w.i + 1 AND c.cluster_id = "
    "CASE w.k " + " ".join(f"WHEN {k} THEN {c}" for k, c in enumerate(FUNNEL[1:], 1)) + " END) "
    "SELECT s.seller_nickname, COALESCE(MAX(w.k), 0) AS m FROM (SELECT DISTINCT seller_nickname FROM lab_y) s LEFT JOIN walk w "
    "ON w.seller_nickname = s.seller_nickname GROUP BY s.seller_nickname) r GROUP BY t.step, t.cluster_id", *YEARLY))
def q_funnel(spark, sf_dir):
    """13.8: strict funnel occasional, growing, power over the sellers' yearly segments."""
    return sg.migration_funnel(yearly_labels(ctx(spark, sf_dir)), FUNNEL)


_YEARS = range(1992, 1999)
_DATED = [*sg.DEFAULT_CALENDAR, ("Vacaciones fin de año", 12, 27, 1, 10, 3)]


def _dated_values() -> str:
    rows = ", ".join(f"('{n}', DATE '{y}-{sm:02}-{sd:02}', DATE '{y + ((em, ed) < (sm, sd))}-{em:02}-{ed:02}', {p})"
                     for y in _YEARS for n, sm, sd, em, ed, p in _DATED)
    return f"SELECT * FROM (VALUES {rows}) AS t(campaign, start_on, end_on, priority)"


@register("season_by_interval", G(
    "SELECT CAST(date AS VARCHAR) AS date, COALESCE(campaign, 'Ninguna campaña') AS season FROM ("
    "SELECT d.date, c.campaign, ROW_NUMBER() OVER (PARTITION BY d.date ORDER BY c.priority NULLS LAST, c.campaign) AS rn "
    "FROM (SELECT DISTINCT snapshot_on AS date FROM listings WHERE snapshot_on IS NOT NULL) d "
    "LEFT JOIN dated c ON d.date BETWEEN c.start_on AND c.end_on) t WHERE rn = 1", ("dated", _dated_values())))
def q_season_by_interval(spark, sf_dir):
    """13.3: campaign of each listing date from dated campaigns, with one over the turn of the year."""
    return sg.season_by_interval(ctx(spark, sf_dir).listings, "snapshot_on", sg.dated_calendar(spark, _YEARS, _DATED))
