"""Mixing sources to target weights by systematic sampling (native: DataFrame functions only).

Sources share the corpus by weight up to a ceiling of copies; each document's expected copies are its source's
target over its source's size; a document is emitted once for each integer that the running sum of expected
copies, shifted by one random offset per source, crosses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, size_of, written

WEIGHTS = (5, 2, 1)
MAX_COPIES = 3
SEED = "mix-1"


def offset_of(source: str, seed: str = SEED):
    """A number in [0, 1) that depends on the seed and the source alone (52 bits of an MD5)."""
    key = F.concat(F.lit(seed), F.when(F.col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), F.col(source))))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 13), 16, 10).cast("long").cast("double") / F.lit(float(2 ** 52))


def source_targets(sizes: DataFrame, source: str = "source", weights=WEIGHTS, ceiling: int = MAX_COPIES) -> DataFrame:
    """One row per source: source, source_size, weight, target.

    ``weights`` go round over the sources in code point order, null last.  Each source gets its weight's share of
    all sizes, at most ``ceiling`` times its size; what is cut off is shared again among the others until none is
    above.  The loop keeps two sums on the driver and ends after at most one pass per source.
    """
    per = sizes.groupBy(source).agg(F.sum("size").alias("source_size"))
    per = ranked(per, [], [F.col(source).asc_nulls_last()], "_at")
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("_at") - 1) % len(weights) + 1).cast("int"))
    per = written(per.select(source, "source_size", w.alias("weight")), "sources")
    cap = F.col("source_size") * F.lit(float(ceiling))
    total = per.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:
        over = cap < F.lit(level) * F.col("weight")
        full, n, free = per.agg(F.sum(F.when(over, cap).otherwise(0.0)), F.sum(over.cast("long")),
                                F.sum(F.when(over, 0.0).otherwise(F.col("weight")))).first()
        if n in (capped, None) or not free:
            break
        capped, level = n, (total - full) / free
    return per.withColumn("target", F.when(cap < F.lit(level) * F.col("weight"), cap).otherwise(F.lit(level) * F.col("weight")))


def mix_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source",
               weights=WEIGHTS, ceiling: int = MAX_COPIES, seed: str = SEED) -> DataFrame:
    """One row per row of ``docs``: doc_id, source, size, source_size, target, copies, taken.

    Rows are ordered by (size, doc_id) in their source, so neighbours have like sizes and the words taken stay
    within about the longest document of the target.  Null source: a source of its own, last.  Null or empty
    text: size 0.  Null ids sort last; repeated rows are separate rows.  Empty table: no rows.  Other columns
    are not read.
    """
    sizes = written(docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), size_of(text).alias("size")), "sizes")
    targets = source_targets(sizes, "source", weights, ceiling).withColumnRenamed("source", "_source")
    rank = ranked(sizes, ["source"], [F.col("size"), F.col("doc_id").asc_nulls_last()])
    # one row per source: Spark broadcasts it below the session's size limit and joins by sort, splitting skew, above
    j = rank.join(targets, F.col("source").eqNullSafe(F.col("_source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    upto = lambda i: F.floor(rate * i + F.col("_u"))
    j = j.withColumn("_u", offset_of("source", seed))
    copies = (upto(F.col("rank")) - upto(F.col("rank") - 1)).cast("long")
    return j.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", **kw) -> DataFrame:
    """The mixed rows: each row of ``docs`` as often as the mix takes it, columns unchanged.

    Rows of one id share their copies: an id that stands k times and is taken c times in all has its rows
    emitted by position, so repeated rows stay separate rows.
    """
    counts = mix_counts(docs, doc_id=doc_id, **kw)
    per = written(counts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_rows"), F.sum("copies").alias("_copies")), "copies")
    whole = docs.select(F.struct("*").alias("_row"))  # so that no column of the table can clash with those of the join
    # both sides grow with the corpus: joined by merge at any size, never by broadcast
    j = whole.join(per.withColumnRenamed("doc_id", "_id").hint("merge"), F.col(f"_row.{doc_id}").eqNullSafe(F.col("_id")))
    plain = j.filter(F.col("_rows") == 1).select("_row", "_copies")
    repeats = j.filter(F.col("_rows") > 1)
    if not repeats.isEmpty():
        again = ranked(repeats, ["_id"], [F.xxhash64(F.col(f"_row.{kw.get('text', 'text')}"))], "_k")
        upto = lambda k: F.floor(F.col("_copies") * k / F.col("_rows"))
        plain = plain.unionByName(again.select("_row", (upto(F.col("_k")) - upto(F.col("_k") - 1)).alias("_copies")))
    out = plain.filter(F.col("_copies") > 0)
    return out.select("_row", F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int"))).alias("_c")).select("_row.*")


#: The same in SQL: sizes, water level from the sorted ceilings, ranks and crossings.
ORACLE = r"""
WITH sized AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
wt AS (SELECT source, source_size, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS DOUBLE) AS weight FROM per),
line AS (SELECT *, row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS k FROM wt),
cut AS (SELECT *, coalesce(sum(source_size * 3.0::DOUBLE) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS full_,
  sum(weight) OVER (ORDER BY k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free, sum(source_size) OVER () AS total FROM line),
level AS (SELECT arg_min((CAST(total AS DOUBLE) - full_) / free, k) AS lv FROM cut WHERE source_size * 3.0::DOUBLE >= (CAST(total AS DOUBLE) - full_) / free * weight),
tgt AS (SELECT source, source_size, CASE WHEN source_size * 3.0::DOUBLE < lv * weight THEN source_size * 3.0::DOUBLE ELSE lv * weight END AS target,
  CAST(CAST('0x' || substr(md5('mix-1' || CASE WHEN source IS NULL THEN '0' ELSE '1' || source END), 1, 13) AS BIGINT) AS DOUBLE) / 4503599627370496.0::DOUBLE AS u FROM wt, level),
r AS (SELECT s.doc_id, s.source, s.size, row_number() OVER (PARTITION BY s.source ORDER BY s.size, s.doc_id NULLS LAST) AS rk FROM sized s)
SELECT r.doc_id, r.size, t.source_size, t.target,
  CAST((floor(CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END * rk + u)
      - floor(CASE WHEN t.source_size > 0 THEN t.target / CAST(t.source_size AS DOUBLE) ELSE 0 END * (rk - 1) + u)) AS BIGINT) * r.size AS taken
FROM r JOIN tgt t ON r.source IS NOT DISTINCT FROM t.source
"""
