"""Source divergence audit: how far each source's use of words lies from its language and from the other sources.

Strings are materialised late.  Tasks count the terms of their documents and write the counts with the term; what is
shuffled are 64-bit digests of the terms.  Text is read again only for digests of kept terms: their least and greatest
string show whether two terms share a digest, and such digests are split by a number of each string.  Text is joined
back only to the terms that are returned.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, lookup, pieces, ship, written

ship(__name__)

MIN_DOCS = 10
RANKS = 10
#: P is 1 + floor(SCALE * (count + SMOOTH) / (N + SMOOTH * V)).
SCALE, SMOOTH = 1_000_000_000, 2
#: Bits of a term's digest (a test takes few, so that terms share them).
DIGEST_BITS = 64
#: Terms of all groups that a task holds before it writes their counts, and bytes of a text cut into terms at a time.
HELD, STEP = 400_000, 1 << 20
#: Rows of a table of groups or of digests up to which it is broadcast.
SMALL = 1 << 20

_LOW = bytes.maketrans(UPPER.encode(), LOWER.encode())
#: Fixed value: the term rule [^\x00-\x40\x5B-\x60\x7B-\x7F]+ on UTF-8 bytes (every byte of another sign is 0x80 or more).
_TERM = re.compile(rb"[A-Za-z\x80-\xff]+")
_BREAK = re.compile(rb"[^A-Za-z\x80-\xff]")
_TERM_KEY = ["lang", "digest", "twin"]


def term_lists(text: bytes):
    """The lower-cased terms of a text, in lists of about STEP bytes."""
    lo = 0
    while lo < len(text):
        gap = _BREAK.search(text, lo + STEP) if lo + STEP < len(text) else None
        hi = gap.start() if gap else len(text)
        yield _TERM.findall(text[lo:hi].translate(_LOW))
        lo = hi


def small(df: DataFrame) -> DataFrame:
    """A written table, marked for broadcast where it has SMALL rows at most; else Spark joins it by its own size rules."""
    return F.broadcast(df) if df.limit(SMALL + 1).count() <= SMALL else df


def task_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), df (documents), digest: partial counts of the tasks, written once."""
    def run(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa
        n, df = defaultdict(Counter), defaultdict(Counter)

        def batch():
            keys = [(g, t, c) for g, terms in n.items() for t, c in terms.items()]
            out = [pa.array([g[0] for g, _, _ in keys], pa.string()), pa.array([g[1] for g, _, _ in keys], pa.string()),
                   pa.array([t for _, t, _ in keys], pa.binary()).cast(pa.string()), pa.array([c for _, _, c in keys], pa.int64()),
                   pa.array([df[g][t] for g, t, _ in keys], pa.int64())]
            n.clear()
            df.clear()
            return pa.RecordBatch.from_arrays(out, ["lang", "source", "term", "n", "df"])
        for b in batches:
            for part in pieces([b], 2):
                for lang, source, text in zip(*[part.column(c).to_pylist() for c in range(3)]):
                    met, g = set(), (lang, source)
                    for terms in term_lists(text):
                        n[g].update(terms)
                        met.update(terms)
                    df[g].update(met)
                if sum(map(len, n.values())) > HELD:
                    yield batch()
        yield batch()
    rows = docs.select("lang", "source", F.col("text").cast("binary").alias("text"))
    return written(rows.mapInArrow(run, "lang string, source string, term string, n long, df long"), "terms")


def counted(docs: DataFrame, min_docs: int = MIN_DOCS, bits: int = DIGEST_BITS):
    """(kept: lang, digest, twin, n; counts: lang, source, digest, twin, n of kept terms; names: digest, twin, term).

    ``twin`` is 0, or among terms of one digest the term's number.
    """
    digest = F.xxhash64("term") if bits == 64 else F.xxhash64("term").bitwiseAND(F.lit((1 << bits) - 1))
    terms = task_counts(docs).withColumn("digest", digest)
    plain = written(terms.groupBy("lang", "source", "digest").agg(F.sum("n").alias("n"), F.sum("df").alias("df")), "counts")
    often = plain.groupBy("lang", "digest").agg(F.sum("df").alias("df"), F.sum("n").alias("n")).filter(F.col("df") >= min_docs)
    often = written(often.select("lang", "digest", "n"), "often")  # a superset of the kept terms where a digest is shared
    wanted = small(written(often.select("digest").distinct(), "wanted"))
    read = terms.select("digest", "term", "n").join(wanted, "digest", "left_semi")
    # counted by hash before the least and greatest strings, which Spark finds by sorting (a mere distinct would be optimised away)
    read = read.groupBy("digest", "term").agg(F.sum("n").alias("n"))
    names = written(read.groupBy("digest").agg(F.min("term").alias("term"), F.max("term").alias("_last"), F.sum("n").alias("n")), "names").drop("n")
    shared = names.filter("term != _last").select("digest")
    names = names.filter("term = _last").select("digest", F.lit(0).alias("twin"), "term")
    if shared.isEmpty():
        kept = often.withColumn("twin", F.lit(0))
    else:
        again = written(terms.join(small(shared), "digest", "left_semi"), "shared")
        number = F.row_number().over(Window.partitionBy("digest").orderBy("term"))  # distinct terms of one digest
        twins = written(again.select("digest", "term").distinct().withColumn("twin", number), "twins")
        again = again.join(twins, ["digest", "term"]).groupBy("lang", "source", "digest", "twin").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
        plain = plain.join(small(shared), "digest", "left_anti").withColumn("twin", F.lit(0))
        plain = written(plain.unionByName(again), "split")
        kept = plain.groupBy(*_TERM_KEY).agg(F.sum("df").alias("df"), F.sum("n").alias("n")).filter(F.col("df") >= min_docs).drop("df")
        kept = written(kept, "kept")
        names = names.unionByName(twins.select("digest", "twin", "term"))
    if "twin" not in plain.columns:
        plain = plain.withColumn("twin", F.lit(0))
    counts = plain.select("lang", "source", "digest", "twin", "n").join(kept.select(*_TERM_KEY), _TERM_KEY, "left_semi")
    return kept, written(counts, "kept-counts"), names


def share(count, total, terms):
    """p of a count, exact: 1 + floor(SCALE * (count + SMOOTH) / (total + SMOOTH * terms)); null where no term is kept."""
    wide = "decimal(20,0)"
    return F.expr(f"1 + (cast({count} + {SMOOTH} as {wide}) * cast({SCALE} as decimal(10,0))) div cast({total} + {SMOOTH} * {terms} as {wide})")


def gap(p: str, q: str):
    """f = floor((p - q)^2 / (p + q)): squares of numbers up to 10^9 + 1 fit in 64 bits."""
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div ({p} + {q})")


def source_divergence(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS,
                      ranks: int = RANKS, bits: int = DIGEST_BITS) -> DataFrame:
    """lang, source, part, item, value, rank: for each group its distance to each other source of its language (``pair``)
    and the terms that it uses more than its language, the first ``ranks`` (``term``).

    Null text, lang and source are ''.  Empty text, or one without a term: the group occurs all the same, its p are those
    of counts 0.  A language without a kept term: pairs of value 0.  Very long texts are counted whole, in steps.  Ties
    are ranked by item.  Repeated rows count as rows.  Empty table: no rows.  Other columns are not read.
    """
    docs = docs.select(*[F.coalesce(F.col(c), F.lit("")).alias(a) for c, a in ((lang, "lang"), (source, "source"), (text, "text"))])
    kept, counts, names = counted(docs, min_docs, bits)
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("terms"), F.sum("n").alias("lang_total"))
    met = docs.select("lang", "source").distinct()
    held = counts.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("own"))
    groups = (met.join(held, ["lang", "source"], "left").join(langs, "lang", "left")
              .select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("total", "own", "terms", "lang_total")]))
    groups = groups.withColumn("p0", F.when(F.col("terms") > 0, share("0", "total", "terms")))
    groups = written(groups, "groups")
    # p of each term that a group holds: the rows of large groups meet them without a shuffle
    use = counts.withColumn("id", F.struct("lang", "source")).withColumnRenamed("n", "count")
    per = groups.select(F.struct("lang", "source").alias("id"), F.col("own").alias("n"), "total", "terms", "p0")
    use = lookup(use, per, "id").withColumn("p", share("count", "total", "terms"))
    use = written(use.select("lang", "source", "digest", "twin", "count", "p", "p0"), "shares")

    # pairs.  Of all kept terms, those of neither group give gap(p0, q0), of one only gap(p, q0); so one sum over each
    # group's own counts, and one over terms that both hold, which corrects what the other sums said of them.
    a, b = ([F.col(c).alias(f"{s}_{c}") if c not in _TERM_KEY else F.col(c) for c in (*_TERM_KEY, "source", "p", "p0")] for s in "ab")
    both = use.select(*a).join(use.select(*b), _TERM_KEY).filter("a_source < b_source")
    both = both.groupBy("lang", "a_source", "b_source").agg(F.sum(gap("a_p", "b_p") - gap("a_p", "b_p0") - gap("a_p0", "b_p") + gap("a_p0", "b_p0")).alias("both"))
    level = use.groupBy("lang", "source", "p").agg(F.count(F.lit(1)).alias("c"))  # few: a group's different counts
    others = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("q0"), F.col("own").alias("item_own"))
    one = (level.join(others, "lang").filter(F.col("source") != F.col("item")).groupBy("lang", "source", "item").agg(F.sum(F.col("c") * gap("p", "q0")).alias("one")))
    one = written(one, "one-sided")
    pairs = groups.select("lang", "source", "p0", "own", "terms").join(others, "lang").filter(F.col("source") != F.col("item"))
    pairs = pairs.join(one, ["lang", "source", "item"], "left")
    pairs = pairs.join(one.select("lang", F.col("item").alias("source"), F.col("source").alias("item"), F.col("one").alias("other")), ["lang", "source", "item"], "left")
    pairs = pairs.join(both.select("lang", F.col("a_source").alias("_a"), F.col("b_source").alias("_b"), "both").withColumnRenamed("lang", "_lang"),
                       (F.col("lang") == F.col("_lang")) & (F.least("source", "item") == F.col("_a")) & (F.greatest("source", "item") == F.col("_b")), "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    value = F.when(F.col("terms") > 0, zero("both") + zero("one") + zero("other") + (F.col("terms") - F.col("own") - F.col("item_own")) * gap("p0", "q0")).otherwise(F.lit(0))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    pairs = (pairs.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))
             .withColumn("rank", F.row_number().over(order)))

    # terms: ranked by value on digests; text is joined to those that can be among the first, ties of the last included
    whole = kept.join(small(written(langs, "langs")), "lang").select(*_TERM_KEY, share("n", "lang_total", "terms").alias("q"))
    over = use.join(whole, _TERM_KEY).filter("p > q").select(*_TERM_KEY, "source", gap("p", "q").alias("value"))
    upper = over.withColumn("_at", F.rank().over(Window.partitionBy("lang", "source").orderBy(F.col("value").desc()))).filter(F.col("_at") <= ranks)
    said = upper.drop("_at").join(names, ["digest", "twin"]).select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value")
    said = said.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks)
    return pairs.unionByName(said)


#: The same in SQL, all terms of all groups written out.
ORACLE = rf"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS MATERIALIZED (SELECT k, lang, source, unnest(w) AS term FROM d),
kept AS MATERIALIZED (SELECT lang, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2 HAVING count(DISTINCT k) >= {MIN_DOCS}),
v AS (SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY 1),
c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t GROUP BY 1, 2, 3),
g AS (SELECT DISTINCT lang, source FROM d),
full_ AS MATERIALIZED (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, kept.n AS all_n FROM g JOIN kept ON kept.lang = g.lang
  LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
total AS (SELECT lang, source, sum(n)::HUGEINT AS n FROM full_ GROUP BY 1, 2),
p AS MATERIALIZED (SELECT f.lang, f.source, f.term, f.n, 1 + {SCALE}::HUGEINT * (f.n + {SMOOTH}) // (total.n + {SMOOTH} * v.v) AS p,
    1 + {SCALE}::HUGEINT * (f.all_n + {SMOOTH}) // (v.total + {SMOOTH} * v.v) AS q
  FROM full_ f JOIN total ON total.lang = f.lang AND total.source = f.source JOIN v ON v.lang = f.lang),
gaps AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
pair AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(gaps.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN gaps ON gaps.lang = a.lang AND gaps.source = a.source AND gaps.item = b.source),
said AS (SELECT lang, source, 'term' AS part, term AS item, ((p - q) * (p - q) // (p + q))::BIGINT AS value FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (SELECT * FROM pair UNION ALL SELECT * FROM said))
SELECT lang, source, part, item, value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= {RANKS}
"""
