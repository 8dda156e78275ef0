"""URL filter: longest matching rule, else logistic regression on hashed character n-grams of host and path.

Only DataFrame functions and the DataFrame-based logistic regression. The model is fitted on a small labelled
URL table and its weights, one per hash bucket, are part of the scoring expression.
"""

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: (verdict, host, path), fixed values of the filter.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: Names of the labelled URL table: hosts of junk sites and of ordinary ones.
JUNK = ("cheap-pills", "spam-farm", "casino-bonus", "free-viagra", "hot-dates", "replica-watches", "quick-loans", "crack-keygen", "win-prizes", "adult-cams")
PLAIN = ("library", "weather", "history", "gardening", "university", "museum", "travelnotes", "chess", "cooking", "astronomy",
         "theater", "railways", "mathematics", "wetlands", "orchestra", "northern", "anthology", "stationery", "harbour", "linen")
PREFIXES, DOMAINS, PATHS = ("", "www.", "blog.", "m."), ("example.com", "example.org"), ("/en/12", "/es/450", "/de/77/", "/fr/301.html")
SIZES = (3, 4)
BUCKETS = 4096
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty where there is no `://` or no url."""
    url = F.coalesce(url, F.lit(""))
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring({0}, locate('://', {0}) + 3)".format("`url`"))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _rule(host: Column, path: Column) -> tuple[Column, Column]:
    """The longest rule that fits, as text, and its verdict; null where none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, domain, start in sorted(RULES, key=lambda r: len(r[1] + r[2])):
        fits = ((host == domain) | host.endswith("." + domain)) & path.startswith(start)
        name, verdict = F.when(fits, domain + start).otherwise(name), F.when(fits, kind).otherwise(verdict)
    return name, verdict


def grams(host: Column, path: Column) -> Column:
    """Hash buckets of the character n-grams of host and path, each between marks of its begin and end."""
    def buckets(text: Column, n: int) -> Column:
        places = F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1)))
        return F.transform(places, lambda i: F.pmod(F.xxhash64(F.substring(text, i, F.lit(n))), F.lit(BUCKETS)).cast("int"))

    texts = F.concat(F.lit("^"), host, F.lit("$")), F.concat(F.lit("/"), path, F.lit("$"))
    return F.concat(*[buckets(text, n) for text in texts for n in SIZES])


def labelled_urls(spark: SparkSession) -> DataFrame:
    """(url, label): the small table that the model is fitted on by default; label 1 is junk."""
    rows = []
    for label, names in ((1, JUNK), (0, PLAIN)):
        for k, name in enumerate(names):
            for j, domain in enumerate(DOMAINS):
                rows.append((f"http://{PREFIXES[(k + j) % 4]}{name}.{domain}{PATHS[(2 * k + j) % 4]}", label))
    return spark.createDataFrame(rows, "url string, label int")


def fit(labelled: DataFrame) -> tuple[list[float], float]:
    """Weights of the hash buckets and the intercept. The table must be small: it is read in one partition."""
    host, path = host_and_path(F.col("url"))
    rows = labelled.select("label", host.alias("host"), path.alias("path")).withColumn("grams", grams(F.col("host"), F.col("path")))
    dense = F.transform(F.sequence(F.lit(0), F.lit(BUCKETS - 1)), lambda b: F.array_contains(F.col("grams"), b.cast("int")).cast("double"))
    model = LogisticRegression(regParam=0.01, maxIter=60, standardization=False).fit(
        rows.select(F.col("label").cast("double").alias("label"), array_to_vector(dense).alias("features")).coalesce(1))
    return [float(w) for w in model.coefficients.toArray()], float(model.intercept)


def judged(pages: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """(page_id, host, path, rule, verdict, junk) for each page; `junk` is the model's probability.

    A null url, and one without `://`, has empty host and path, which no rule fits; the model judges it.
    """
    weights, bias = fit(labelled_urls(pages.sparkSession) if labelled is None else labelled)
    table = F.array(*[F.lit(w) for w in weights])
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    parts = rows.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = _rule(F.col("host"), F.col("path"))
    total = F.aggregate(F.array_distinct(grams(F.col("host"), F.col("path"))), F.lit(bias), lambda s, g: s + F.get(table, g))
    junk = F.lit(1.0) / (F.lit(1.0) + F.exp(-total))
    return parts.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), junk.alias("junk")).withColumn(
        "verdict", F.coalesce("verdict", F.when(F.col("junk") >= 0.5, "block").otherwise("allow")))
