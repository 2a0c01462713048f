"""URL rules, and gradient-boosted trees on lexical features where no rule fits.

Trained on at most ``SAMPLE`` labelled URLs (lowest hashes), a URL's label being
the verdict of the rule that fits it. Everything is scored in the JVM.

A null URL or one without ``://`` has an empty host and path and is judged by
the trees as an empty string. Without labelled URLs of both kinds the trees
allow all. Repeated rows each give their row.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eqpanel.llm.common import table

#: Bound of the labelled URLs the trees and the suffix statistics are made from.
SAMPLE = 5000
#: Host, path, verdict.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]
FEATURES = ["length", "depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "n_labels", "host_length", "suffix_rate"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def parsed(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule and the rule's verdict."""
    url = F.coalesce("url", F.lit(""))
    parts = r"://([^/?#]*)([^?#]*)"
    out = pages.select("page_id", url.alias("url"), F.translate(F.regexp_extract(url, parts, 1), UPPER, LOWER).alias("host"), F.regexp_extract(url, parts, 2).alias("path"))
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for host, path, said in sorted(RULES, key=lambda r: len(r[0] + r[1])):
        fits = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)
        rule, verdict = F.when(fits, host + path).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return out.withColumns({"rule": rule, "said": verdict})


def _entropy(s: Column) -> Column:
    n = F.greatest(F.length(s), F.lit(1))
    share = lambda ch: F.length(s) - F.length(F.replace(s, ch, F.lit("")))
    return F.aggregate(F.filter(F.array_distinct(F.split(s, "")), lambda ch: ch != ""), F.lit(0.0), lambda acc, ch: acc - share(ch) / n * F.log2(share(ch) / n))


def lexical(rows: DataFrame, suffix_rates: dict[str, float]) -> DataFrame:
    url, host = F.col("url"), F.col("host")
    many = lambda s, kept: F.length(F.regexp_replace(s, f"[^{kept}]", "")).cast("double")
    suffix = F.element_at(F.split(host, r"\."), -1)
    rate = F.lit(0.5)
    for name, value in sorted(suffix_rates.items()):
        rate = F.when(suffix == name, value).otherwise(rate)
    return rows.withColumns({
        "length": F.length(url).cast("double"), "depth": many(F.col("path"), "/"), "digit_ratio": many(url, "0-9") / F.greatest(F.length(url), F.lit(1)),
        "entropy": _entropy(url), "n_params": many(url, "=&"), "n_hyphens": many(host, "-"), "n_labels": many(host, "."), "host_length": F.length(host).cast("double"), "suffix_rate": rate,
    })


def judge(pages: DataFrame) -> DataFrame:
    rows = parsed(pages)
    labelled = rows.filter("said is not null").select("url", "host", "path", (F.col("said") == "block").cast("double").alias("label"))
    picked = labelled.orderBy(F.xxhash64("url"), "url", "host").limit(SAMPLE).toPandas()
    if picked["label"].nunique() < 2:
        method = rows.withColumn("prediction", F.lit(0.0))
    else:
        by = picked.groupby(picked["host"].str.rsplit(".", n=1).str[-1])["label"].agg(["sum", "count"]).nlargest(100, "count")
        rates = {k: float((s + 1) / (n + 2)) for k, (s, n) in by.iterrows()}
        train = lexical(rows.sparkSession.createDataFrame(picked).coalesce(1), rates)
        trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=15, maxDepth=4, seed=7, checkpointInterval=-1)
        model = Pipeline(stages=[VectorAssembler(inputCols=FEATURES, outputCol="features"), trees]).fit(train)
        method = model.transform(lexical(rows, rates))
    said = F.coalesce("said", F.when(F.col("prediction") > 0, "block").otherwise("allow"))
    return method.select("page_id", "host", "path", "rule", said.alias("verdict"))


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"))
