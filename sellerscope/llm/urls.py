"""URL filter (native: DataFrame functions and Spark's own ML stages on the JVM).

A short list of host-and-path rules decides first; what no rule fits goes to a logistic regression on hashed
character n-grams of host and path, trained from a small labelled URL table.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
GRAMS = (3, 4)
BUCKETS = 1 << 14
THRESHOLD = 0.5

#: The small labelled URL table that the query trains from: 1 is to be blocked.  The words are the usual names of the kinds of site that
#: public block lists divide into (gambling, adult, drugs, loans, adverts, malware, piracy), against everyday subjects of all kinds;
#: none is taken from a corpus.  Both labels share tails, prefixes, domains and paths, so that only the words tell them apart.
_BLOCK_WORDS = ("casino", "poker", "betting", "slots", "jackpot", "roulette", "lottery", "blackjack", "bingo", "wager",
                "porn", "xxx", "adult", "escort", "webcam", "nude", "erotic", "hookup",
                "pills", "viagra", "cialis", "steroids", "pharmacy", "weightloss", "loans", "payday", "forex", "creditfix",
                "spam", "adserver", "tracker", "clicks", "popup", "malware", "phishing", "ransom", "warez", "torrent", "keygen", "cracked")
_PLAIN_WORDS = ("garden", "library", "weather", "school", "recipes", "history", "museum", "travel", "science", "news",
                "physics", "chemistry", "biology", "geography", "language", "dictionary", "poetry", "novels", "theatre", "cinema",
                "music", "orchestra", "painting", "photography", "architecture", "engineering", "software", "hardware", "database", "network",
                "hospital", "medicine", "nursing", "family", "children", "kitchen", "bakery", "coffee", "vegetables", "farming",
                "forest", "mountain", "river", "ocean", "island", "animals", "birds", "horses", "football", "tennis",
                "cycling", "swimming", "railway", "airport", "traffic", "council", "government", "parliament", "justice", "economy",
                "industry", "insurance", "furniture", "clothing", "knitting", "woodwork", "astronomy", "climate", "energy", "transport")
_TAILS = ("", "online", "site", "hub", "info", "place", "today", "world")
_PREFIXES = ("", "www.", "m.", "blog.")
_PATHS = ("/en/12", "/de/310/", "/fr/7.html", "/es/4501")


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): a table of some hundred rows made of the word lists above; a parameter of the operator."""
    rows = []
    for label, words in ((1, _BLOCK_WORDS), (0, _PLAIN_WORDS)):
        for i, w in enumerate(words):
            for j, t in enumerate(_TAILS):
                name = w if not t else (f"{w}-{t}", f"{t}-{w}", f"{w}{t}")[(i + j) % 3]
                tld = ("com", "net", "org")[(i + j) % 3]
                rows.append((f"http://{_PREFIXES[(i + j) % 4]}{name}.example.{tld}{_PATHS[(i // 4 + j) % 4]}", float(label)))
    return spark.createDataFrame(rows, "url string, label double")


def host_and_path(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty where the url is null or has no '://'."""
    u = F.col(url)
    at = F.locate("://", u)
    rest = F.when(at > 0, F.substring(u, at + 3, F.length(u))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return (df.withColumn("host", F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER))
            .withColumn("path", F.coalesce(path, F.lit(""))))


def grams(host: str = "host", path: str = "path", sizes=GRAMS):
    """Character n-grams of '^host$' and of '/path' with its digits made one sign; a host gram never equals a path gram."""
    def pieces(mark, text, n):
        cut = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text) - (n - 1))),
                          lambda i: F.concat(F.lit(mark), F.substring(text, i, F.lit(n))))
        return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))

    def of(mark, c):
        return [pieces(mark, F.concat(F.lit("^"), c, F.lit("$")), n) for n in sizes]
    return F.concat(*of("h", F.col(host)), *of("p", F.regexp_replace(F.col(path), "[0-9]+", "0")))


def fit_urls(labelled: DataFrame, buckets: int = BUCKETS):
    """(hashing stage, logistic regression model) from a small (url, label) table; rows with a null label or url are left out."""
    tf = HashingTF(inputCol="_grams", outputCol="_features", numFeatures=buckets, binary=True)
    rows = host_and_path(labelled.filter(F.col("label").isNotNull() & F.col("url").isNotNull())).withColumn("_grams", grams())
    lr = LogisticRegression(featuresCol="_features", labelCol="label", probabilityCol="_prob", rawPredictionCol="_raw",
                            predictionCol="_predicted", regParam=0.003, elasticNetParam=0.0, maxIter=60, standardization=False, threshold=THRESHOLD)
    return tf, lr.fit(tf.transform(rows.coalesce(1)))


def rule_of(rules=RULES, host: str = "host", path: str = "path"):
    """The longest rule that fits as struct(verdict, rule), or null. Equal lengths: the first listed."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(reversed(rules), key=lambda r: len(r[1])):
        name, slash, rest = rule.partition("/")
        fits = (F.col(host) == name) | F.endswith(F.col(host), F.lit("." + name))
        fits = fits & F.startswith(F.col(path), F.lit(slash + rest))
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def filter_urls(pages: DataFrame, labelled: DataFrame, page_id: str = "page_id", url: str = "url", rules=RULES) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict, block_probability.

    Map-only after the fit: no row is shuffled.  Null or malformed url: empty host and path, judged by the model.
    Ids may be null or repeat; other columns are not read.  Empty table: no rows.
    """
    tf, model = fit_urls(labelled)
    parts = host_and_path(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")))
    scored = model.transform(tf.transform(parts.withColumn("_grams", grams())))
    from pyspark.ml.functions import vector_to_array  # a JVM function
    out = scored.withColumn("_rule", rule_of(rules)).withColumn("block_probability", F.get(vector_to_array("_prob"), F.lit(1)))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"),
                      F.coalesce(F.col("_rule.verdict"), F.when(F.col("_predicted") == 1.0, "block").otherwise("allow")).alias("verdict"),
                      "block_probability")
