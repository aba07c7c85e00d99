"""URL filter: rules first, then gradient-boosted trees on lexical features, learnt from the labelled URLs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quietlog.llm.store import written

RULES = (("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"))
FEATURES = ("url_len", "host_len", "path_len", "depth", "digit_ratio", "entropy", "params", "query_len", "has_fragment", "labels_in_host", "hyphens", "secure", "suffix_rate", "suffix_log_rows", "domain_rate", "domain_log_rows")
FOLDS = 5
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SYMBOLS = LOWER + "0123456789./-_?=&#:%"


def host_of(url: Column) -> Column:
    """After the first '://' up to '/', '?', '#' or the end, A-Z lower-cased; empty for null or without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(quietlog_url, instr(quietlog_url, '://') + 3)")).otherwise("")
    return F.translate(F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^([^/?#]*)", 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    """After the host up to '?', '#' or the end; empty for null or without '://'."""
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(quietlog_url, instr(quietlog_url, '://') + 3)")).otherwise("")
    return F.regexp_extract(F.coalesce(rest, F.lit("")), r"(?s)^[^/?#]*([^?#]*)", 1)


def fitting(rules: Sequence[tuple[str, str]], host: str = "host", path: str = "path") -> Column:
    """The longest rule that fits, as struct(rule, verdict), or null. A rule fits its host and all subdomains
    where the path starts with the rule's; of two rules of one length the first in the list wins."""
    found = F.lit(None).cast("struct<rule:string,verdict:string>")
    for rule, verdict in reversed(sorted(rules, key=lambda r: -len(r[0]))):
        h, slash, p = rule.partition("/")
        fits = ((F.col(host) == h) | F.endswith(F.col(host), F.lit("." + h))) & F.startswith(F.col(path), F.lit(slash + p))
        found = F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(found)
    return found


def count_of(column: Column, piece: str) -> Column:
    return F.length(column) - F.length(F.replace(column, F.lit(piece), F.lit("")))


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need nothing but the URL; expects quietlog_url, host and path."""
    url = F.translate(F.coalesce("quietlog_url", F.lit("")), UPPER, LOWER)
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    parts = [count_of(url, c) / n for c in SYMBOLS]
    other = F.greatest(F.lit(0.0), 1.0 - sum(parts[1:], parts[0]))
    entropy = sum((F.when(p > 1e-9, -p * F.log2(p)).otherwise(0.0) for p in [*parts, other]), F.lit(0.0))
    return df.withColumns({
        "url_len": F.length(url).cast("double"), "host_len": F.length("host").cast("double"), "path_len": F.length("path").cast("double"),
        "depth": count_of(F.col("path"), "/").cast("double"), "digit_ratio": F.length(F.regexp_replace(url, "[^0-9]", "")) / n, "entropy": entropy,
        "params": F.when(F.length(query) > 0, count_of(query, "&") + 1).otherwise(0).cast("double"), "query_len": F.length(query).cast("double"),
        "has_fragment": F.when(F.instr(url, "#") > 0, 1.0).otherwise(0.0), "labels_in_host": (count_of(F.col("host"), ".") + 1).cast("double"),
        "hyphens": count_of(url, "-").cast("double"), "secure": F.when(F.startswith(url, F.lit("https:")), 1.0).otherwise(0.0),
        "suffix": F.substring_index("host", ".", -1), "domain": F.substring_index("host", ".", -2),
    })


OWN = "quietlog_own"
RESULT = ("quietlog_url", "host", "path", "rule", "verdict", "score")


def with_rates(df: DataFrame, by: str, share: float) -> DataFrame:
    """df with <by>_rate and <by>_log_rows: the share of blocked ones among the labelled URLs with the same value of by, shrunk towards the overall share, and how many there are.

    A labelled URL's rate comes from the other folds alone, so that it does not hold the URL's own label. At most FOLDS sums per value are kept; they are joined, not broadcast by force."""
    sums = df.where(F.col("label").isNotNull()).groupBy(by, "fold").agg(F.sum("label").alias("s"), F.count(F.lit(1)).alias("n"))
    known = sums.groupBy(by).agg(F.sum("s").alias("all_s"), F.sum("n").alias("all_n"), F.map_from_entries(F.collect_list(F.struct("fold", F.struct("s", "n")))).alias("of_fold"))
    df = df.join(known, by, "left")
    own = F.when(F.col("label").isNotNull(), F.try_element_at("of_fold", F.col("fold")))
    n = F.coalesce(F.col("all_n"), F.lit(0)) - F.coalesce(own["n"], F.lit(0))
    s = F.coalesce(F.col("all_s"), F.lit(0.0)) - F.coalesce(own["s"], F.lit(0.0))
    return df.withColumns({f"{by}_rate": (s + 5 * share) / (n + 5), f"{by}_log_rows": F.log1p(n.cast("double"))}).drop("all_s", "all_n", "of_fold")


def judge(pages: DataFrame, rules: Sequence[tuple[str, str]] = RULES, max_train_rows: int = 200_000, trees: int = 20, depth: int = 4, seed: int = 7, url: str = "url") -> DataFrame:
    """Every row of pages, its columns but url, with quietlog_url, host, path, rule, verdict and score (the trees' chance that the URL is to be blocked).

    Labelled URLs are those that a rule fits. The trees learn from all of them, or, beyond max_train_rows, from a
    part of about that many chosen by a hash of the URL; the suffix statistics come from all labelled URLs, each one's own fold left out. The shares of a suffix are
    shrunk towards the overall share, so an unseen suffix gets that. A null URL, or one without '://', has
    an empty host and path, no rule, and is judged by the trees like any other. With no labelled URL, or none of
    one of the two kinds, the score is the share of blocked ones among the labelled (0 without any).
    Repeated rows stay, with equal verdicts; nulls in other columns stay; no rows in, no rows out. A column of the caller's named as one of ours (quietlog_url, host, path, rule, verdict, score) is
    replaced, whatever else it has keeps its name and value. Features are written once to the shared folder; training and scoring read them."""
    keep = [c for c in pages.columns if c.lower() not in RESULT and c != url]
    carried = F.struct(*(F.col(f"`{c}`") for c in keep)) if keep else F.struct(F.lit(0).alias("none"))
    df = pages.select(carried.alias(OWN), F.col(f"`{url}`").cast("string").alias("quietlog_url"))
    df = df.withColumn("host", host_of(F.col("quietlog_url"))).withColumn("path", path_of(F.col("quietlog_url")))
    df = lexical(df.withColumn("fits", fitting(rules))).withColumn("fold", F.pmod(F.xxhash64("quietlog_url", F.lit(3)), F.lit(FOLDS)).cast("int"))
    df = written(df.withColumn("label", F.when(F.col("fits.verdict") == "block", 1.0).when(F.col("fits").isNotNull(), 0.0)), "url-features")
    n, blocked = df.agg(F.count("label"), F.sum("label")).first()
    share = (blocked or 0.0) / n if n else 0.0
    if 0 < share < 1:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        df = with_rates(with_rates(df, "suffix", share), "domain", share)
        learn = df.where(F.col("label").isNotNull()).where(F.pmod(F.xxhash64("quietlog_url"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_train_rows / n)))
        learn = written(learn.select("label", *FEATURES), "url-examples")
        model = GBTClassifier(maxIter=trees, maxDepth=depth, stepSize=0.2, seed=seed, maxBins=64).fit(rows.transform(learn))
        df = model.transform(rows.transform(df)).withColumn("score", F.round(vector_to_array("probability")[1], 9))
    else:
        df = df.withColumn("score", F.lit(share))
    verdict = F.coalesce("fits.verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow"))
    return df.select(*(F.col(f"{OWN}.`{c}`").alias(c) for c in keep), "quietlog_url", "host", "path", F.col("fits.rule").alias("rule"), verdict.alias("verdict"), "score")


def op10_url_filter(spark, sf_dir):
    """Every page's URL, judged."""
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict", "score")
