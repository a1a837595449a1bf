"""Seller features of a stream of listings.

State is kept per (seller, category, period of the event time): counts and sums that
add up to the nine features.  A listing that is sent again within the watermark is
dropped by its id; a period's state goes once the watermark has passed it.  Each
micro-batch commits the changed state rows under its batch id, in a folder that a
repeated batch overwrites, so replays leave no trace; of a state row the version of
the highest batch counts.  ``read_features`` adds the rows up to the table that the
batch job ``seller_features`` gives; ``compact`` folds committed batches into one
table, so that reading does not grow with the number of batches.

A listing's id is kept as 128 bits of hashes.  ``state_session`` gives a session whose
streams keep their state in RocksDB, in bounded memory outside the heap, so that
state of tens of millions of rows is no burden on the executors' heap.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expressions import indicator
from ..operators.features import FEATURES, listing_features
from ..session import own_session

#: feature -> the value whose mean it is; the two counts come from the rows themselves
MEANS = {
    "log_price_avg": lambda: F.log1p(F.col("price").cast("double")),
    "log_stock_avg": lambda: F.log1p(F.col("stock").cast("double")),
    "porc_descuento": lambda: F.col("discount_pct"),
    "proporcion_refurb": lambda: F.col("is_refurbished").cast("double"),
    "proporcion_usados": lambda: indicator(F.col("condition") == "used"),
    "rep_score": lambda: F.col("rep_score"),
    "titulo_length_avg": lambda: F.col("title_len"),
}
STATE = ["seller_nickname", "category_id", "period"]


def feature_state(listings: DataFrame, event_time: str = "snapshot_on", delay: str = "30 days", period: str = "365 days",
                  listing_id=("url",)) -> DataFrame:
    """The state rows of a (streaming or static) table of listings: n, and per mean its sum and count of values.

    Listings later than ``delay`` behind the newest are left out (the progress reports them as rows dropped by the
    watermark), as are those without a seller or an event time; rows equal in ``listing_id`` (columns) within it count once."""
    lf = listing_features(listings).where(F.col("seller_nickname").isNotNull() & F.col(event_time).isNotNull())
    lf = lf.withColumn("_at", F.col(event_time).cast("timestamp")).withWatermark("_at", delay)
    if listings.isStreaming:  # two hashes of the id and of what is NULL in it: a small key for the state
        whole = [x for c in listing_id for x in (F.col(c), F.col(c).isNull())]
        once = lf.withColumns({f"_id{i}": F.xxhash64(F.lit(i), *whole) for i in range(2)}).dropDuplicatesWithinWatermark(["_id0", "_id1"])
    else:
        once = lf.dropDuplicates(list(listing_id))
    sums = [x for name, value in MEANS.items() for x in (F.sum(value()).alias(f"s_{name}"), F.count(value()).alias(f"n_{name}"))]
    return (once.groupBy(F.window("_at", period).alias("period"), "seller_nickname", "category_id")
            .agg(F.count(F.lit(1)).alias("n"), *sums).withColumn("period", F.col("period.start")))


#: State in RocksDB, whose memory is bounded for all stores of an executor together; a batch writes its changes only.  Of the
#: state's versions those that a restart can need are kept, not those of 100 batches.
STATE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
    "spark.sql.streaming.stateStore.rocksdb.trackTotalNumberOfRows": "false",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    "spark.sql.streaming.stateStore.compression.codec": "zstd",
    "spark.sql.streaming.minBatchesToRetain": "2",
}


def state_session(spark: SparkSession) -> SparkSession:
    """Another session of the application with the caller's settings and ``STATE_CONF``; the caller's stays as it is."""
    return own_session(spark, STATE_CONF)


def commit_batch(state: DataFrame, batch_id: int, path: str) -> None:
    """Write a batch's changed state rows as ``batch=<id>``: running the same batch again replaces them."""
    state.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={int(batch_id)}")


def drop_shuffles(batch: DataFrame) -> None:
    """Remove the shuffle files of a batch that is committed: nothing reads them again, but they would stay until the
    driver happens to collect its garbage, those of many batches at once."""
    cleaner = batch.sparkSession.sparkContext._jsc.sc().cleaner()
    if cleaner.isEmpty():
        return
    todo, seen = [batch._jdf.queryExecution().toRdd()], set()
    while todo:
        rdd = todo.pop()
        if rdd.id() in seen:
            continue
        seen.add(rdd.id())
        deps = rdd.dependencies()
        for dep in (deps.apply(i) for i in range(deps.size())):
            if dep.getClass().getName() == "org.apache.spark.ShuffleDependency":
                cleaner.get().doCleanupShuffle(dep.shuffleId(), False)
            todo.append(dep.rdd())


def start_feature_stream(stream: DataFrame, path: str, checkpoint: str, *, available_now: bool = False, **kw):
    """Start the stream; ``path`` and ``checkpoint`` are in a file system that all executors share."""
    state = feature_state(stream, **kw)

    def commit(df, i):
        commit_batch(df, i, path)
        drop_shuffles(df)
    w = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(commit)
    return (w.trigger(availableNow=True) if available_now else w.trigger(processingTime="30 seconds")).start()


def drop_checkpoint(spark: SparkSession, checkpoint: str) -> None:
    """Remove the checkpoint of a stream that will not be started again: its state is as large as what it has committed."""
    p = spark._jvm.org.apache.hadoop.fs.Path(checkpoint)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _schema(spark: SparkSession) -> str:
    sums = ", ".join(f"s_{m} double, n_{m} long" for m in MEANS)
    return f"period timestamp, seller_nickname string, category_id string, n long, {sums}"


def _versions(spark: SparkSession, path: str):
    """(rows of the last compacted table or None, rows of the batches after it or None, its number or None)."""
    path = path.rstrip("/")
    base = later = upto = None
    if _exists(spark, path):
        later = spark.read.schema(_schema(spark) + ", batch long").parquet(path)
    if _exists(spark, f"{path}-compacted"):
        base = spark.read.schema(_schema(spark) + ", batch long, upto long").parquet(f"{path}-compacted")
        upto = base.agg(F.max("upto")).first()[0]
        base = None if upto is None else base.where(F.col("upto") == upto).drop("upto")
        if upto is not None and later is not None:
            later = later.where(F.col("batch") > upto)
            later = None if later.isEmpty() else later
    return base, later, upto


def _newest(base: DataFrame | None, later: DataFrame | None) -> DataFrame:
    """One row per state row; a compacted table without later batches is that already."""
    if later is None:
        return base
    rows = later if base is None else base.unionByName(later)
    values = [c for c in rows.columns if c not in (*STATE, "batch")]
    return rows.groupBy(*STATE).agg(F.max_by(F.struct("batch", *values), "batch").alias("v")).select(*STATE, "v.*")


def latest_state(spark: SparkSession, path: str) -> DataFrame:
    """The newest version of each state row: of the last compacted table and of the batches after it."""
    base, later, _ = _versions(spark, path)
    if base is None and later is None:
        return spark.createDataFrame([], _schema(spark))
    return _newest(base, later)


def compact(spark: SparkSession, path: str) -> int | None:
    """Fold all committed batches into a compacted table named by the last of them; returns its number.

    Readers take the highest complete table, so a compaction that fails half-way changes nothing."""
    base, later, upto = _versions(spark, path)
    if later is None:
        return upto
    last = later.agg(F.max("batch")).first()[0]  # the last batch's rows are the newest of theirs
    if last is not None:
        _newest(base, later).write.mode("overwrite").parquet(f"{path.rstrip('/')}-compacted/upto={last}")
    return last


def read_features(spark: SparkSession, path: str) -> DataFrame:
    """The nine features per seller from the committed state: the rows that ``seller_features`` gives for the same listings.

    Rows are summed to (seller, category) first, so that a category counts once however many periods it is met in."""
    state = latest_state(spark, path)
    sums = [f"{k}_{m}" for m in MEANS for k in "sn"]
    per = state.groupBy("seller_nickname", "category_id").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in sums])
    mean = {m: F.try_divide(F.sum(f"s_{m}"), F.sum(f"n_{m}")) for m in MEANS}
    mean["categorias_distintas"] = F.count("category_id").cast("double")  # a NULL category is none
    mean["num_publicaciones"] = F.sum("n").cast("double")
    return per.groupBy("seller_nickname").agg(*[mean[f].alias(f) for f in FEATURES])
