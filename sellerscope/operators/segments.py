"""Segment naming, playbook, payload/prompt text, season context and alerts.

Segment names, actions and KPIs form one small dimension (5 rows, fixed);
they are applied as literal map lookups, not joins.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expressions import REPUTATION_SCORES, discount_pct, lookup, snap

# Cluster id -> segment name used by the scoring command, and the
# name for ids outside the table.
SEGMENT_NAMES = {
    0: "Sellers Ocasionales",
    1: "Power Sellers",
    2: "Sellers en Crecimiento",
    3: "Cazadores de Oferta",
    4: "Liquidadores / Outlet",
}
UNKNOWN_SEGMENT = "Desconocido"

# Playbook: cluster id -> (action code, KPI code).  The texts belong to the caller; the default has neutral codes.
DEFAULT_PLAYBOOK = {i: (f"A{i}", f"K{i}") for i in SEGMENT_NAMES}

NO_CAMPAIGN = "Ninguna campaña"

# The campaign labels.  Dates and priorities are defaults of ours, a parameter of every function:
# (campaign, start month, start day, end month, end day, priority); an end before its start lies in the next year.
DEFAULT_CALENDAR = [
    ("Cyberlunes", 11, 24, 11, 26, 1),
    ("Black Sale", 11, 20, 11, 30, 2),
    ("Hot Sale", 5, 13, 5, 19, 2),
    ("Día del Padre/Madre", 5, 1, 5, 12, 3),
    ("Día del Padre/Madre", 6, 10, 6, 20, 3),
    ("Fin de año / Navidad", 12, 1, 12, 31, 4),
    ("Vacaciones mitad de año", 6, 15, 7, 15, 5),
    ("Temporada baja", 1, 15, 3, 15, 9),
    ("Temporada baja", 8, 1, 9, 30, 9),
]


def segment_name(cluster_id="cluster_id"):
    return lookup(cluster_id, SEGMENT_NAMES, default=UNKNOWN_SEGMENT, value_type="string")


def name_segments(labels: DataFrame, cluster_id="cluster_id") -> DataFrame:
    return labels.withColumn("segment_name", segment_name(cluster_id))


def segment_playbook(labels: DataFrame, playbook: dict = DEFAULT_PLAYBOOK, cluster_id="cluster_id") -> DataFrame:
    """Sellers per segment with the segment's action and KPI from the caller's ``playbook`` (NULL for ids outside it)."""
    return (labels.groupBy(cluster_id).agg(F.count(F.lit(1)).alias("sellers"))
                  .select(F.col(cluster_id).alias("cluster_id"), segment_name(cluster_id).alias("segment_name"),
                          lookup(cluster_id, {i: a for i, (a, _) in playbook.items()}, value_type="string").alias("action"),
                          lookup(cluster_id, {i: k for i, (_, k) in playbook.items()}, value_type="string").alias("kpi"), "sellers"))


def canonical_ids(labels: DataFrame, scaled: DataFrame, key="seller_nickname", cluster_id="cluster_id",
                  size_feature="num_publicaciones") -> dict[int, int]:
    """Map raw k-means ids to canonical ids by a declared size score.

    Clusters are ranked by the mean (scaled) ``size_feature`` of their members,
    ties by member count then raw id: the largest becomes 1 (power), the
    smallest 0 (occasional), the rest 2, 3, ... in descending order.  Only k
    rows reach the driver.
    """
    # labels that already carry the feature (assignment output) need no join
    pts = labels if size_feature in labels.columns else labels.join(scaled.select(key, size_feature), key)
    stats = (pts.groupBy(cluster_id)
                   .agg(F.avg(size_feature).alias("score"), F.count(F.lit(1)).alias("n"))
                   .collect())
    order = sorted(stats, key=lambda r: (-(r["score"] if r["score"] is not None else float("-inf")), -r["n"], r[cluster_id]))
    k = len(order)
    mapping = {}
    for rank, r in enumerate(order):
        if rank == 0:
            mapping[r[cluster_id]] = 1 if k > 1 else 0
        elif rank == k - 1:
            mapping[r[cluster_id]] = 0
        else:
            mapping[r[cluster_id]] = rank + 1
    return mapping


def relabel(labels: DataFrame, mapping: dict[int, int], cluster_id="cluster_id") -> DataFrame:
    return labels.withColumn(cluster_id, lookup(cluster_id, mapping, value_type="int"))


def relabel_centroids(centroids: DataFrame, mapping: dict[int, int], cluster_id="cluster_id") -> DataFrame:
    return centroids.withColumn(cluster_id, lookup(cluster_id, mapping, value_type="int"))


# ---- payload and prompt ------------------------------------------------------

def strategy_payload(listings: DataFrame, labels: DataFrame, *, as_of: str, key="seller_nickname",
                     cancellation: str | None = None) -> DataFrame:
    """Per-seller prompt inputs: counts and means from the listings plus the segment name."""
    lf = listings.where(F.col(key).isNotNull())
    disc = discount_pct("price", "regular_price")
    m = lf.groupBy(key).agg(
        F.count(F.lit(1)).alias("publicaciones"),
        F.count_distinct("category_id").alias("categorias_distintas"),
        F.round(snap(F.avg("stock")), 1).alias("stock_promedio"),
        F.round(snap(F.avg("price")), 0).cast("bigint").alias("precio_medio_cop"),
        F.avg(disc).alias("descuento_pct"),
        F.round(snap(F.avg(lookup("seller_reputation", REPUTATION_SCORES, default=0.0))), 1).alias("rep_score"),
        (F.avg(cancellation) if cancellation else F.lit(None).cast("double")).alias("tasa_cancelacion"))
    return (m.join(labels.select(key, "cluster_id"), key)
             .select(F.lit(as_of).cast("date").alias("fecha_actual"), key,
                     segment_name("cluster_id").alias("cluster_name"), "publicaciones", "categorias_distintas",
                     "stock_promedio", "precio_medio_cop", "descuento_pct", "rep_score", "tasa_cancelacion"))


def strategy_prompts(payload: DataFrame, season_col: str | None = None, key="seller_nickname") -> DataFrame:
    """Render the per-seller strategy prompt text (the text is the output; no model call)."""
    season = F.col(season_col) if season_col else F.lit(NO_CAMPAIGN)
    def fmt(pattern, c, value):
        # format_string renders a NULL argument as text ("null"), so NULL is handled first
        return F.when(F.col(c).isNull(), F.lit("n/d")).otherwise(F.format_string(pattern, value))

    price = fmt("%,d", "precio_medio_cop", F.col("precio_medio_cop"))
    # averages of decimal data often sit exactly on a .5 display boundary; snapping
    # to a binary grid first makes the displayed rounding deterministic
    disc = fmt("%d%%", "descuento_pct", F.round(snap(F.col("descuento_pct")) * 100, 0).cast("bigint"))
    canc = fmt("%.1f%%", "tasa_cancelacion", F.round(snap(F.col("tasa_cancelacion")) * 100, 1))
    stock = fmt("%.1f", "stock_promedio", F.col("stock_promedio"))
    rep = fmt("%.1f", "rep_score", F.col("rep_score"))
    text = F.concat(
        F.lit("seller profile on "), F.col("fecha_actual").cast("string"), F.lit(", campaign: "), season,
        F.lit("\ngroup = "), F.col("cluster_name"),
        F.lit("\nlistings = "), F.col("publicaciones").cast("string"),
        F.lit("\ncategories = "), F.col("categorias_distintas").cast("string"),
        F.lit("\nunits in stock, mean = "), stock,
        F.lit("\nprice, mean = "), price,
        F.lit("\ndiscount, mean = "), disc,
        F.lit("\nreputation (0 to 5) = "), rep,
        F.lit("\ncancelled = "), canc,
        F.lit("\nName the next step for this seller and the figure that would show it worked."))
    return payload.select(key, F.col("cluster_name"), text.alias("prompt"))


# ---- season context ----------------------------------------------------------

def calendar_days(spark, calendar=DEFAULT_CALENDAR) -> DataFrame:
    """Expand a yearly calendar into (month_day, campaign, priority) rows: at most
    366 rows per campaign entry, a size bound fixed by the calendar."""
    rows = []
    base = 2000  # leap year: covers Feb 29
    for name, sm, sd, em, ed, prio in calendar:
        d = _dt.date(base, sm, sd)
        end = _dt.date(base + ((em, ed) < (sm, sd)), em, ed)
        while d <= end:
            rows.append((d.month * 100 + d.day, name, prio))
            d += _dt.timedelta(days=1)
    return spark.createDataFrame(rows, "month_day int, campaign string, priority int")


def season_context(dates: DataFrame, date_col: str, calendar=DEFAULT_CALENDAR) -> DataFrame:
    """Campaign for each distinct date: the calendar range containing it with the
    lowest priority number (then name), else ``NO_CAMPAIGN``.

    The range join ``date BETWEEN start AND end`` is rewritten as an equi-join
    on month-day against the expanded calendar (bounded size, broadcast), so
    no nested-loop join is planned.
    """
    days = F.broadcast(calendar_days(dates.sparkSession, calendar))
    d = dates.select(F.col(date_col).alias("date")).where(F.col("date").isNotNull()).distinct()
    d = d.withColumn("month_day", F.month("date") * 100 + F.dayofmonth("date"))
    j = d.join(days, "month_day", "left")
    best = (j.groupBy("date")
              .agg(F.min_by(F.col("campaign"), F.struct(F.coalesce("priority", F.lit(1 << 30)), F.col("campaign"))).alias("campaign")))
    return best.select("date", F.coalesce("campaign", F.lit(NO_CAMPAIGN)).alias("season"))


def season_of(date: str, calendar=DEFAULT_CALENDAR) -> str:
    """The campaign of one known date (a literal: no job is needed for it); same choice as ``season_context``."""
    d = _dt.date.fromisoformat(date)
    day = d.month * 100 + d.day
    fits = []
    for name, sm, sd, em, ed, prio in calendar:
        start, end = sm * 100 + sd, em * 100 + ed
        if (start <= day <= end) if start <= end else (day >= start or day <= end):
            fits.append((prio, name))
    return min(fits)[1] if fits else NO_CAMPAIGN


def dated_calendar(spark, years, calendar=DEFAULT_CALENDAR) -> DataFrame:
    """The yearly calendar as dated campaigns (campaign, start_on, end_on, priority), one per entry and year in ``years``."""
    rows = [(name, _dt.date(y, sm, sd), _dt.date(y + ((em, ed) < (sm, sd)), em, ed), prio)
            for y in years for name, sm, sd, em, ed, prio in calendar]
    return spark.createDataFrame(rows, "campaign string, start_on date, end_on date, priority int")


def season_by_interval(dates: DataFrame, date_col: str, intervals: DataFrame, bucket_days: int = 32) -> DataFrame:
    """Campaign of each distinct date from dated ``intervals`` (campaign, start_on, end_on, priority): of those that hold
    it the least priority number, then name; else ``NO_CAMPAIGN``.

    An interval join without a nested loop: days are numbered and cut into buckets, an interval is sent to each bucket
    that it touches, and both meet on the bucket before the exact comparison.  Intervals with a NULL or with an end
    before the start hold no date.
    """
    bucket = lambda c: F.floor(F.unix_date(c) / F.lit(bucket_days))
    spans = (intervals.where(F.col("end_on") >= F.col("start_on"))
             .select("campaign", "start_on", "end_on", "priority", F.explode(F.sequence(bucket("start_on"), bucket("end_on"))).alias("bucket")))
    d = dates.select(F.col(date_col).alias("date")).where(F.col("date").isNotNull()).distinct()
    met = d.withColumn("bucket", bucket("date")).join(spans, "bucket").where(F.col("date").between(F.col("start_on"), F.col("end_on")))
    best = met.groupBy("date").agg(F.min(F.struct("priority", "campaign")).alias("c"))
    return d.join(best, "date", "left").select("date", F.coalesce("c.campaign", F.lit(NO_CAMPAIGN)).alias("season"))


# ---- alerts and history ------------------------------------------------------

def promotion_alerts(seller_stats: DataFrame, labels: DataFrame, key="seller_nickname",
                     growing_id: int = 2, min_gmv: float = 50_000.0, min_rep: float = 4.0) -> DataFrame:
    """Growing sellers with GMV above ``min_gmv`` and reputation score >= ``min_rep``."""
    j = seller_stats.join(labels.where(F.col("cluster_id") == growing_id).select(key), key)
    return (j.where((F.col("gmv") > min_gmv) & (F.col("rep_score") >= min_rep))
             .select(key, "gmv", "rep_score", F.lit("candidate").alias("alert")))


def churn_alerts(listings: DataFrame, labels: DataFrame, key="seller_nickname", power_id: int = 1,
                 snapshot="snapshot_on", rep="snapshot_rep") -> DataFrame:
    """Power sellers whose reputation falls between consecutive snapshots.

    Listings are first reduced to one row per (seller, snapshot) (partial
    aggregation): the join with the labels and the per-seller window only see
    one row per snapshot date of a seller, not its listings.
    """
    daily = (listings.where(F.col(key).isNotNull())
                     .groupBy(key, snapshot).agg(F.avg(rep).alias("rep"))
                     .join(labels.where(F.col("cluster_id") == power_id).select(key), key, "left_semi"))
    w = Window.partitionBy(key).orderBy(snapshot)
    return (daily.withColumn("prev_rep", F.lag("rep").over(w))
                 .where(F.col("rep") < F.col("prev_rep"))
                 .select(key, F.col(snapshot).alias("snapshot_on"), "prev_rep", "rep",
                         F.lit("churn_risk").alias("alert")))


def seller_gmv(listings: DataFrame, key="seller_nickname", gmv="gmv") -> DataFrame:
    """``(seller, gmv, rep_score)``: GMV sum and mean reputation score per seller."""
    return (listings.where(F.col(key).isNotNull())
                    .groupBy(key)
                    .agg(F.sum(gmv).alias("gmv"),
                         F.avg(lookup("seller_reputation", REPUTATION_SCORES, default=0.0)).alias("rep_score")))


def segment_gmv_growth(listings: DataFrame, labels: DataFrame, key="seller_nickname", gmv="gmv",
                       date="snapshot_on") -> DataFrame:
    """Monthly GMV per segment and its change against the previous month.

    Listings are summed to (seller, month) before they meet the labels, and the
    per-segment window runs over (segment, month) rows."""
    seller = (listings.groupBy(key, F.date_format(date, "yyyy-MM").alias("month")).agg(F.sum(gmv).alias("gmv")))
    monthly = seller.join(labels.select(key, "cluster_id"), key).groupBy("cluster_id", "month").agg(F.sum("gmv").alias("gmv"))
    w = Window.partitionBy("cluster_id").orderBy("month")
    return (monthly.withColumn("prev_gmv", F.lag("gmv").over(w))
                   .withColumn("growth", F.try_divide(F.col("gmv") - F.col("prev_gmv"), F.col("prev_gmv"))))


def segment_migration(snapshots: DataFrame, key="seller_nickname", period="period") -> DataFrame:
    """Sellers moving from segment a in period p to segment b in period p + 1.

    An equi-join of the snapshot table with itself on (seller, period + 1):
    each seller row meets at most one partner row."""
    a = snapshots.select(F.col(key), F.col(period).alias("from_period"), F.col("cluster_id").alias("from_cluster"))
    b = snapshots.select(F.col(key), (F.col(period) - 1).alias("from_period"), F.col(period).alias("to_period"),
                         F.col("cluster_id").alias("to_cluster"))
    return (a.join(b, [key, "from_period"])
             .groupBy("from_period", "to_period", "from_cluster", "to_cluster")
             .agg(F.count(F.lit(1)).alias("sellers")))


def segment_upgrades(snapshots: DataFrame, key="seller_nickname", period="period", power_id: int = 1) -> DataFrame:
    """Per period and segment other than power: its sellers, and how many are power sellers one period later.

    Sellers without a label in the next period count as not moved up."""
    a = snapshots.where(F.col("cluster_id") != power_id).select(F.col(key), F.col(period).alias("from_period"), F.col("cluster_id").alias("from_cluster"))
    b = snapshots.where(F.col("cluster_id") == power_id).select(F.col(key), (F.col(period) - 1).alias("from_period"), F.lit(1).alias("up"))
    g = a.join(b, [key, "from_period"], "left").groupBy("from_period", "from_cluster").agg(
        F.count(F.lit(1)).alias("sellers"), F.count("up").alias("upgraded"))
    return g.withColumn("upgrade_share", F.try_divide(F.col("upgraded").cast("double"), F.col("sellers")))


def label_intervals(history: DataFrame, key="seller_nickname", date="label_date") -> DataFrame:
    """Label snapshots as validity intervals: (seller, cluster_id, valid_from, valid_to, snapshots).

    Only changes of a seller's label are kept, with the date of the first snapshot of each run of equal labels;
    ``valid_to`` is the date of the next change (exclusive), NULL for the current label.  One window over a seller's
    snapshots (few rows each), one shuffle.
    """
    w = Window.partitionBy(key).orderBy(date)
    runs = (history.withColumn("_was", F.lag("cluster_id").over(w)).withColumn("_first", F.row_number().over(w) == 1)
            .withColumn("_new", F.col("_first") | ~F.col("cluster_id").eqNullSafe(F.col("_was")))
            .withColumn("_run", F.sum(F.col("_new").cast("int")).over(w)))
    spans = runs.groupBy(key, "_run").agg(F.first("cluster_id").alias("cluster_id"), F.min(date).alias("valid_from"), F.count(F.lit(1)).alias("snapshots"))
    return spans.select(key, "cluster_id", "valid_from", F.lead("valid_from").over(Window.partitionBy(key).orderBy("valid_from")).alias("valid_to"), "snapshots")


def as_of_labels(events: DataFrame, history: DataFrame, key="seller_nickname", date="snapshot_on", since="valid_from",
                 label="cluster_id") -> DataFrame:
    """``events`` with the label that its seller had on the event's date (the last one whose ``since`` is not later; NULL
    before the first): an as-of join.

    Events and label changes go into one list per seller and time, changes first, and the last change is filled
    forward: a union and one window, never a comparison of every event with every change.
    """
    cols = events.columns
    left = events.select(F.col(key).alias("_k"), F.col(date).alias("_t"), F.lit(1).alias("_event"), F.lit(None).cast(history.schema[label].dataType).alias("_label"),
                         F.lit(False).alias("_change"), F.struct(*cols).alias("_row"))
    right = history.select(F.col(key).alias("_k"), F.col(since).alias("_t"), F.lit(0).alias("_event"), F.col(label).alias("_label"),
                           F.lit(True).alias("_change"), F.lit(None).cast(left.schema["_row"].dataType).alias("_row"))
    w = Window.partitionBy("_k").orderBy("_t", "_event").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # a struct, so that a change to a NULL label is a change too
    last = F.last(F.when(F.col("_change"), F.struct(F.col("_label").alias("v"))), ignorenulls=True).over(w)
    return left.unionByName(right).withColumn("_last", last).where("_event = 1").select("_row.*", F.col("_last.v").alias(label))


def churn_alerts_as_of(listings: DataFrame, intervals: DataFrame, key="seller_nickname", power_id: int = 1,
                       snapshot="snapshot_on", rep="snapshot_rep") -> DataFrame:
    """Reputation falls between consecutive snapshots of sellers that were power sellers on the day of the fall: the label
    is the one valid then, not today's.  Listings are reduced to (seller, snapshot) rows before they meet the labels."""
    daily = listings.where(F.col(key).isNotNull()).groupBy(key, snapshot).agg(F.avg(rep).alias("rep"))
    falls = (daily.withColumn("prev_rep", F.lag("rep").over(Window.partitionBy(key).orderBy(snapshot)))
             .where(F.col("rep") < F.col("prev_rep")).select(key, F.col(snapshot).alias("snapshot_on"), "prev_rep", "rep"))
    then = as_of_labels(falls, intervals, key=key, date="snapshot_on")
    return then.where(F.col("cluster_id") == power_id).select(key, "snapshot_on", "prev_rep", "rep", F.lit("churn_risk").alias("alert"))


def migration_funnel(snapshots: DataFrame, steps, key="seller_nickname", period="period") -> DataFrame:
    """Strict multi-step funnel over the sellers' paths of segments: (step, cluster_id, sellers, share).

    ``steps`` is a list of cluster ids.  A seller's path is its labels by period, with repeats taken together; it has
    reached step i if the labels of steps 1..i occur in its path one right after the other.  ``share`` is that of the
    sellers of the step before (of step 1: of all sellers).  A path has one entry per change of a seller, so the
    collected list is bounded by the periods; the count of steps is a higher-order function over it.
    """
    path = snapshots.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(F.col(period).alias("p"), F.col("cluster_id").alias("c")))).alias("_all"))
    labels = F.transform("_all", lambda x: x["c"])
    path = path.select(F.filter(F.transform(labels, lambda x, i: F.when((i == 0) | ~x.eqNullSafe(F.try_element_at(labels, i)), x)),
                                lambda x: x.isNotNull()).alias("path"))
    wanted = [int(s) for s in steps]
    # the longest prefix of the steps that starts at any place of the path
    fits = lambda i: sum((F.when(_prefix(i, wanted[:n]), 1).otherwise(0) for n in range(1, len(wanted) + 1)), F.lit(0))
    places = F.when(F.size("path") > 0, F.sequence(F.lit(1), F.size("path"))).otherwise(F.array().cast("array<int>"))
    reached = F.coalesce(F.array_max(F.transform(places, fits)), F.lit(0))
    counts = path.select(reached.alias("reached")).agg(F.count(F.lit(1)).alias("all"), *[F.count_if(F.col("reached") >= n).alias(f"n{n}") for n in range(1, len(wanted) + 1)])
    rows = [F.struct(F.lit(n).alias("step"), F.lit(c).alias("cluster_id"), F.col(f"n{n}").alias("sellers"),
                     F.try_divide(F.col(f"n{n}").cast("double"), F.col("all") if n == 1 else F.col(f"n{n - 1}")).alias("share"))
            for n, c in enumerate(wanted, 1)]
    return counts.select(F.inline(F.array(*rows)))


def _prefix(place, labels):
    """Whether the path has ``labels`` one after the other from ``place`` (1-based) on."""
    out = F.lit(True)
    for k, c in enumerate(labels):
        out = out & F.coalesce(F.try_element_at(F.col("path"), place + k) == c, F.lit(False))
    return out
