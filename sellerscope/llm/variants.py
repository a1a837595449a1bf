"""Spelling variants by asymmetric q-chunks.

Words at one edit: the shorter (of equal lengths the smaller) contributes two disjoint chunks, its halves; the other
contributes positional grams.  One edit lies in one half, so the other half is a gram of the other word, shifted by the
difference of the lengths, one at most.  Of all grams only those at a place where such a chunk can lie are made: two for
each of the two lengths a partner may have.  Chunk and gram are joined on (length, half, string), and what meets is
verified by edit distance.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, pieces, ship, written

ship(__name__)

#: Fixed values of the word rule; only A-Z are lower-cased.
LETTERS = "A-Za-zÀ-ÿ"
DIVISOR = 31
LEAST_LENGTH = 7
LEAST_COUNT = 2
#: A word's near word is its form if it is met so many times as often.
TIMES = 10
#: Words of one chunk that a task joins at a time; a chunk of more is dealt out.
SPLIT = 2000
#: Words that a task holds before it writes their counts, and characters of a text that are searched at a time.
HELD, STEP = 400_000, 1 << 20

_RUN = re.compile(f"[{LETTERS}]{{{LEAST_LENGTH},}}")
_BREAK = re.compile(f"[^{LETTERS}]")
_LOW = str.maketrans(UPPER, LOWER)


def runs(text: str):
    """The lower-cased runs of LEAST_LENGTH letters and more, in lists; shorter ones can't give a word."""
    lo = 0
    while lo < len(text):
        gap = _BREAK.search(text, lo + STEP) if lo + STEP < len(text) else None
        hi = gap.start() if gap else len(text)
        yield _RUN.findall(text[lo:hi].translate(_LOW))
        lo = hi


def word_counts(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """word, n of all documents; partial counts per task, so a frequent word brings a row per task."""
    def run(batches):
        from collections import Counter
        from zlib import crc32

        import pyarrow as pa
        n = Counter()

        def batch():
            out = pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.int64())], ["word", "n"])
            n.clear()
            return out
        for b in batches:
            for part in pieces([b], 1):
                for key, value in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    start = crc32(f"{key}:".encode())
                    for found in runs(value or ""):
                        words = Counter(found)
                        for w in [w for w in words if crc32(w.encode(), start) % DIVISOR == 0]:
                            at = crc32(w.encode(), start) % len(w)
                            times, left = words.pop(w), w[:at] + w[at + 1:]
                            if len(left) >= LEAST_LENGTH:
                                n[left] += times
                        n.update(words)
                if len(n) > HELD:
                    yield batch()
        yield batch()
    rows = docs.select(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(word: str = "word"):
    """64 bits, one for each remainder of the code points that the word holds: one edit changes two of them at most."""
    bits = F.transform(F.split(F.col(word), ""), lambda c: F.call_function("shiftleft", F.lit(1).cast("long"), F.ascii(c) % 64))
    return F.coalesce(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)), F.lit(0))


def sides(words: DataFrame):
    """(chunks, grams): length of the chunked word, half, string, and the word itself with its count and letters."""
    size = F.length("word")
    half = lambda n: F.floor(n / F.lit(2)).cast("int")
    entry = lambda n, h, start, length: F.struct(n.alias("length"), F.lit(h).alias("half"), F.substring(F.col("word"), start, length).alias("key"))
    chunks = F.array(entry(size, 0, F.lit(1), half(size)), entry(size, 1, half(size) + 1, size - half(size)))
    grams = []
    for shorter in (0, 1):  # partners as long as the word, and one shorter: their second half lies that much later here
        n = size - shorter
        grams += [entry(n, 0, F.lit(1), half(n)), entry(n, 1, half(n) + 1 + shorter, n - half(n))]
    out = []
    for side in (chunks, F.array(*grams)):
        out.append(words.select("word", "n", "letters", F.explode(side).alias("_e")).select(F.col("_e.length").alias("length"), F.col("_e.half").alias("half"), F.col("_e.key").alias("key"), "word", "n", "letters"))
    return out


def near_words(words: DataFrame) -> DataFrame:
    """a, b, a_n, b_n: every unordered pair of words (word, n) at exactly one edit, once.

    A chunk of more than SPLIT words is dealt out by hash, its grams are sent to each part.
    """
    on = ["length", "half", "key"]
    chunks, grams = sides(words.withColumn("letters", letters()))
    large = chunks.groupBy(*on).agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") > SPLIT)
    large = written(large.select(*on, F.ceil(F.col("k") / SPLIT).cast("int").alias("parts")), "large")
    parts = F.coalesce(F.col("parts"), F.lit(1))
    chunks = chunks.join(large, on, "left").select(*on, F.pmod(F.xxhash64("word"), parts).cast("int").alias("part"), F.col("word").alias("a"), F.col("n").alias("a_n"), F.col("letters").alias("a_letters"))
    grams = grams.join(large, on, "left").select(*on, F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("word").alias("b"), F.col("n").alias("b_n"), F.col("letters").alias("b_letters"))
    met = chunks.join(grams, [*on, "part"])
    met = met.filter(F.bit_count(F.col("a_letters").bitwiseXOR(F.col("b_letters"))) <= 2)  # before the costly distance: necessary for one edit
    met = met.filter((F.length("b") > F.col("length")) | (F.col("a") < F.col("b")))
    # a pair that shares both halves has met at the first one
    first = F.substring(F.col("a"), F.lit(1), F.floor(F.col("length") / 2).cast("int")) == F.substring(F.col("b"), F.lit(1), F.floor(F.col("length") / 2).cast("int"))
    met = met.filter((F.col("half") == 0) | ~first)
    return met.filter(F.levenshtein("a", "b", 1) == 1).select("a", "b", "a_n", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """word, root for the rows (word, form) of ``forms``: the end of the chain of forms, in rounds that double its steps."""
    root = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = root.select(F.col("word").alias("_w"), F.col("root").alias("_next"))
        more = root.join(step, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved"))
        more = written(more, "roots")
        root = more.drop("_moved")
        if more.filter("_moved").isEmpty():
            return root


def spelling_variants(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", times: int = TIMES) -> DataFrame:
    """word, form, root, n, n_near, form_n: one row per word of the texts.

    Null, empty or letterless text: no words.  A null id counts as an empty one where letters are deleted by hash.  Very
    long texts are read in steps that end between runs.  Ties of n: the smallest near word in code-point order.  Repeated
    rows count again.  Empty table: no rows.  Other columns are not read.
    """
    words = written(word_counts(docs, doc_id, text).filter(F.col("n") >= LEAST_COUNT), "words")
    near = written(near_words(words), "near")
    both = near.select(F.col("a").alias("word"), F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("w")).alias("f")).unionByName(
        near.select(F.col("b").alias("word"), F.struct((-F.col("a_n")).alias("n"), F.col("a").alias("w")).alias("f")))
    per = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min("f").alias("f"))
    often = -F.col("f.n") >= times * F.col("n")
    out = words.join(per, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"),
                                                 F.when(often, F.col("f.w")).alias("form"), F.when(often, -F.col("f.n")).alias("form_n"))
    out = written(out, "forms")
    ends = roots(out.filter(F.col("form").isNotNull()))
    return out.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


#: The same in SQL: crc32 by its table, near words by deleting one letter from each word.
ORACLE = rf"""
WITH RECURSIVE step AS (SELECT i, 0 AS k, i::BIGINT AS c FROM range(256) r(i) UNION ALL
  SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM step WHERE k < 8),
tab AS (SELECT list(c ORDER BY i) AS t FROM step WHERE k = 8),
found AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id, unnest(regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
long_ AS (SELECT id, run, count(*) AS times FROM found WHERE length(run) >= {LEAST_LENGTH} GROUP BY 1, 2),
bytes AS (SELECT id, run, times, flatten(list_transform(string_split(id || ':' || run, ''), lambda x:
    CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [(192 + (unicode(x) >> 6))::BIGINT, (128 + (unicode(x) & 63))::BIGINT] END)) AS b FROM long_),
hashed AS (SELECT id, run, times, xor(list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, x: xor(c >> 8, t[1 + (xor(c, x) & 255)])), 4294967295) AS h FROM bytes, tab),
cut AS (SELECT CASE WHEN h % {DIVISOR} = 0 THEN substr(run, 1, (h % length(run))::BIGINT) || substr(run, (h % length(run))::BIGINT + 2) ELSE run END AS word, times FROM hashed),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n FROM cut WHERE length(word) >= {LEAST_LENGTH} GROUP BY 1 HAVING sum(times) >= {LEAST_COUNT}),
less AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS MATERIALIZED (SELECT DISTINCT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM less a JOIN words b ON a.rest = b.word
  UNION SELECT DISTINCT a.word, b.word, b.n FROM words a JOIN less b ON b.rest = a.word),
best AS (SELECT a, count(*) AS n_near, first(b ORDER BY n DESC, encode(b)) AS form, max(n) AS form_n FROM near GROUP BY a),
forms AS MATERIALIZED (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= {TIMES} * w.n THEN form END AS form, CASE WHEN form_n >= {TIMES} * w.n THEN form_n END AS form_n
  FROM words w LEFT JOIN best ON best.a = w.word),
chain AS (SELECT word, word AS root, 0 AS k FROM forms UNION ALL SELECT chain.word, forms.form, k + 1 FROM chain JOIN forms ON forms.word = chain.root WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n FROM forms JOIN (SELECT word, arg_max(root, k) AS root FROM chain GROUP BY word) r ON r.word = forms.word
"""
