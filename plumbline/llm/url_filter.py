"""URL verdicts: host and path rules, and boosted trees on lexical features for the rest.

Native DataFrame operations and Spark ML only.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.session import materialize

#: (rule, verdict); a rule is a host, then the path prefix from its first slash on.
RULES = (("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow"))
#: Labelled URLs that the trees are fitted on at most, and their shape.
SAMPLE, TREES, DEPTH = 20_000, 20, 4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEXICAL = ("length", "host_length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "has_fragment", "is_secure")
FEATURES = (*LEXICAL, "suffix_rate", "domain_rate", "section_rate")


def parts(url: str = "url") -> tuple[Column, Column]:
    """Host and path: empty for a null url or one without ``://``."""
    text = F.coalesce(F.col(url), F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def rule_for(host: Column, path: Column, rules: tuple = RULES) -> tuple[Column, Column]:
    """The longest rule that fits, and its verdict; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """What the spelling of a URL says, as doubles."""
    text = F.coalesce(url, F.lit(""))
    n = F.length(text)
    count = lambda s, c: (F.length(s) - F.length(F.replace(s, F.lit(c), F.lit("")))).cast("double")
    digits = n - F.length(F.translate(text, "0123456789", ""))
    share = lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n
    letters = F.array_distinct(F.split(text, ""))
    bits = F.aggregate(letters, F.lit(0.0), lambda s, c: F.when(c == "", s).otherwise(s - share(c) * F.log2(share(c))))
    return {
        "length": n.cast("double"),
        "host_length": F.length(host).cast("double"),
        "depth": count(path, "/"),
        "digit_ratio": F.when(n > 0, digits / n).otherwise(0.0),
        "entropy": F.when(n > 0, bits).otherwise(0.0),
        "parameters": count(text, "="),
        "labels": count(host, "."),
        "hyphens": count(text, "-"),
        "has_fragment": F.contains(text, F.lit("#")).cast("double"),
        "is_secure": text.startswith("https:").cast("double"),
    }


def featured(pages: DataFrame, url: str = "url", rules: tuple = RULES) -> DataFrame:
    """The rows with host, path, rule, ruled (the rule's verdict) and their lexical features."""
    host, path = parts(url)
    rows = pages.withColumn("host", host).withColumn("path", path)
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    rows = rows.withColumn("rule", rule).withColumn("ruled", verdict)
    rows = rows.withColumns(lexical(F.col(url), F.col("host"), F.col("path")))
    return rows.withColumns(
        {
            "suffix": F.substring_index("host", ".", -1),
            "domain": F.substring_index("host", ".", -2),
            "section": F.split_part("path", F.lit("/"), F.lit(2)),
        }
    )


@dataclass(frozen=True)
class UrlFilter:
    """The trees (None: too few labels to fit any), rates of blocked URLs by key, and the overall rate."""

    model: GBTClassificationModel | None
    rates: dict[str, DataFrame]
    rate: float

    def with_rates(self, rows: DataFrame) -> DataFrame:
        for key, table in self.rates.items():
            rows = rows.join(table, key, "left").fillna({f"{key}_rate": self.rate})
        return rows

    def judge(self, rows: DataFrame) -> DataFrame:
        """``rows`` (of ``featured``) with ``risk``, the model's probability of blocking."""
        if self.model is None:
            return rows.withColumn("risk", F.lit(self.rate))
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(self.with_rates(rows))
        return self.model.transform(rows).withColumn("risk", vector_to_array("probability")[1])


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH) -> UrlFilter:
    """Trees from rows of ``featured`` whose ``ruled`` is set.

    The rates cover all labelled rows; the trees see the ``sample`` rows of least
    hash.  Each rate is smoothed by ten rows of the overall rate.
    """
    labelled = labelled.where("ruled is not null").withColumn("blocked", (F.col("ruled") == "block").cast("double"))
    n, blocked = labelled.agg(F.count("*"), F.sum("blocked")).first()
    rate = (blocked or 0.0) / n if n else 0.0
    if not n or blocked in (0.0, float(n)):
        return UrlFilter(None, {}, rate)
    rates = {}
    for key in ("suffix", "domain", "section"):
        smooth = (F.sum("blocked") + 10 * rate) / (F.count("*") + 10)
        rates[key] = materialize(labelled.groupBy(key).agg(smooth.alias(f"{key}_rate")), f"{key}_rates")
    untrained = UrlFilter(None, rates, rate)
    rows = labelled.orderBy(F.xxhash64("host", "path"), "host", "path").limit(sample)
    rows = untrained.with_rates(rows).select(*FEATURES, "blocked")
    rows = materialize(VectorAssembler(inputCols=list(FEATURES), outputCol="vector").transform(rows).select("vector", "blocked"), "urls")
    fit = GBTClassifier(featuresCol="vector", labelCol="blocked", maxIter=trees, maxDepth=depth, seed=7, cacheNodeIds=True)
    return UrlFilter(fit.fit(rows), rates, rate)


def judge_pages(pages: DataFrame, page_id: str = "page_id", url: str = "url", rules: tuple = RULES) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, risk.

    URLs that a rule fits are the labels; the trees learn their spelling and
    judge the others, which are blocked from a risk of one half on.  A null url
    or one without ``://`` has an empty host and path and is judged by its
    spelling.  Repeated rows are judged alike, each once; with labels of one kind
    or none the risk is the share of blocked labels; an empty table gives an
    empty result.  Other columns are not read.
    """
    rows = featured(pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url")), "url", rules)
    judged = train(rows).judge(rows)
    by_model = F.when(F.col("risk") >= 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select("page_id", "host", "path", "rule", F.coalesce("ruled", by_model).alias("verdict"), "risk")
