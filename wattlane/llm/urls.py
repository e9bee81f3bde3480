"""URL filters: list rules, and gradient-boosted trees on lexical features.

Rules of a list decide the URLs that they fit; the others are judged by boosted trees that
are trained on labelled URLs, here those that a rule decides. Features are the URL's
length, path depth, digit share, character entropy, parameter and label counts, and
statistics of its host's suffix over all labelled URLs. The trees are fitted on a bounded
sample (``SAMPLE_ROWS``); suffix statistics cover all rows.

Null URLs and URLs without ``://`` have an empty host and path and fit no rule. Without
labels of both kinds, URLs that no rule fits are allowed. Repeated rows get equal results.
"""
from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import text as T
from .tables import cut_lineage, small_enough

#: The list's rules, host and path together.
RULES = [
    ("allow", "org/"),
    ("block", "example.org/es/"),
    ("block", "example.org/en/1"),
    ("allow", "com/fr/"),
    ("block", "com/de/"),
]
#: Most labelled URLs that the trees are fitted on; suffixes up to this number are broadcast.
SAMPLE_ROWS, BROADCAST_SUFFIXES = 20_000, 100_000
FEATURES = ["length", "depth", "digits", "entropy", "parameters", "host_labels", "longest_label", "suffix_rate", "suffix_count"]


def parts(pages: DataFrame) -> DataFrame:
    """The rows with host and path of column ``url``."""
    url = F.col("url")
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url))).otherwise("")
    return pages.withColumn("host", T.lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1))).withColumn(
        "path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_for(rules: list[tuple[str, str]]) -> Column:
    """(verdict, rule) of the longest rule that fits host and path, else null."""
    out = None
    for verdict, rule in sorted(rules, key=lambda r: -len(r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.startswith("path", F.lit(f"/{path}"))
        found = F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))
        out = F.when(fits, found) if out is None else out.when(fits, found)
    return out


def lexical(rows: DataFrame) -> DataFrame:
    """The rows with the features of the URL alone, and its suffix."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    chars = F.array_remove(F.split(url, ""), "")
    counts = T.let(chars, lambda c: F.transform(F.array_distinct(c), lambda x: F.length(url) - F.length(F.replace(url, x, F.lit("")))))
    entropy = F.aggregate(counts, F.lit(0.0), lambda s, k: s - (k / n) * F.log2(k / n))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return rows.withColumns({
        "length": F.length(url).cast("double"),
        "depth": (F.length("path") - F.length(F.replace("path", F.lit("/"), F.lit("")))).cast("double"),
        "digits": (F.length(url) - F.length(F.translate(url, "0123456789", ""))) / n,
        "entropy": entropy,
        "parameters": F.when(query == "", 0.0).otherwise(F.size(F.split(query, "&")).cast("double")),
        "host_labels": F.size(labels).cast("double"),
        "longest_label": F.array_max(F.transform(labels, lambda x: F.length(x))).cast("double"),
        "suffix": F.element_at(labels, -1),
    })


def with_suffix_statistics(rows: DataFrame) -> DataFrame:
    """Adds how often the suffix is labelled and, shrunk to the mean, how often allowed."""
    stats = cut_lineage(rows.where(F.col("label").isNotNull()).groupBy("suffix").agg(
        F.sum("label").alias("good"), F.count("*").alias("all")))
    total = stats.agg(F.sum("good"), F.sum("all")).first()
    mean = total[0] / total[1] if total[1] else 0.5
    table = stats.select(F.col("suffix").alias("_s"), ((F.col("good") + 20 * mean) / (F.col("all") + 20)).alias("suffix_rate"),
                         F.log1p(F.col("all").cast("double")).alias("suffix_count"))
    table = F.broadcast(table) if small_enough(table, BROADCAST_SUFFIXES) else table
    return rows.join(table, F.col("suffix") == F.col("_s"), "left").drop("_s").fillna(
        {"suffix_rate": mean, "suffix_count": 0.0})


def judge(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score) of every row."""
    split = parts(pages.select("page_id", "url")).withColumn("found", rule_for(rules))
    labelled = split.select("*", F.when(F.col("found").isNotNull(), F.when(F.col("found.verdict") == "allow", 1.0).otherwise(0.0)).alias("label"))
    rows = cut_lineage(with_suffix_statistics(lexical(labelled)).select(
        "page_id", "url", "host", "path", "found", "label", *FEATURES))
    kinds = {r["label"]: r["count"] for r in rows.where(F.col("label").isNotNull()).groupBy("label").count().collect()}
    if len(kinds) < 2:
        scored = rows.withColumn("score", F.lit(1.0))
    else:
        share = min(1.0, SAMPLE_ROWS / sum(kinds.values()))
        assembler = VectorAssembler(inputCols=FEATURES, outputCol="features")
        sample = rows.where(F.col("label").isNotNull() & (
            F.pmod(F.xxhash64("url", "page_id"), F.lit(1_000_000)) < int(share * 1_000_000)))
        if sample.select("label").distinct().count() < 2:
            sample = rows.where(F.col("label").isNotNull())
        model = GBTClassifier(featuresCol="features", labelCol="label", maxIter=8, maxDepth=3, seed=7, checkpointInterval=-1).fit(
            assembler.transform(sample))
        judged = model.transform(assembler.transform(rows))
        scored = judged.withColumn("score", F.get(vector_to_array("probability"), 1))
    return scored.select("page_id", "host", "path", F.col("found.rule").alias("rule"), F.coalesce(
        "found.verdict", F.when(F.col("score") >= 0.5, "allow").otherwise("block")).alias("verdict"), "score")
