"""URL verdicts: rules first, then gradient-boosted trees on lexical features."""

from __future__ import annotations

from pyspark.ml import PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = ["url_length", "host_length", "depth", "host_depth", "digit_ratio", "entropy", "n_params", "n_hyphens", "suffix_share", "suffix_seen"]
#: Rows on which the trees are fitted at most; a documented bound, chosen by hash.
MAX_TRAIN = 20_000
#: A table of suffix statistics is broadcast up to this many rows, and joined by shuffle beyond.
MAX_BROADCAST_ROWS = 10_000


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path; both empty for a null url and one without ``://``."""
    url = F.coalesce(url, F.lit(""))
    host = F.translate(F.regexp_extract(url, r"(?s)://([^/?#]*)", 1), UPPER, LOWER)
    return host, F.regexp_extract(url, r"(?s)://[^/?#]*([^?#]*)", 1)


def match_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """Rule and verdict of the longest (verdict, ``host/path``) rule that fits; null if none does.

    A rule fits its host and all subdomains where the url's path begins with the
    rule's.  Meant for short lists; they become one expression.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):  # the longest is tested first
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def lexical(df: DataFrame, url: str = "_url") -> DataFrame:
    """Lexical features of a url with its ``host`` and ``path``."""
    text = F.coalesce(F.col(url), F.lit(""))
    length = F.greatest(F.length(text), F.lit(1))
    share = lambda c: (F.length(text) - F.length(F.replace(text, c, F.lit("")))) / length
    letters = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return df.select(
        "*",
        F.length(text).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.size(F.filter(F.split("path", "/"), lambda s: s != "")).cast("double").alias("depth"),
        F.size(F.split("host", r"\.")).cast("double").alias("host_depth"),
        (F.regexp_count(text, F.lit("[0-9]")) / length).cast("double").alias("digit_ratio"),
        F.aggregate(letters, F.lit(0.0), lambda a, c: a - share(c) * F.log2(share(c))).alias("entropy"),
        F.regexp_count(text, F.lit("[?&][^&#]")).cast("double").alias("n_params"),
        F.regexp_count(F.col("host"), F.lit("-")).cast("double").alias("n_hyphens"),
        F.substring_index("host", ".", -1).alias("_suffix"),
    )


def _with_suffixes(df: DataFrame, suffixes: DataFrame, small: bool) -> DataFrame:
    joined = df.join(F.broadcast(suffixes) if small else suffixes, "_suffix", "left")
    return joined.fillna({"suffix_share": 0.5, "suffix_seen": 0.0})


def fit(labelled: DataFrame, max_train: int = MAX_TRAIN) -> tuple[PipelineModel | float, DataFrame | None, bool]:
    """Trees from (``_url``, ``host``, ``path``, ``label`` 0 or 1) rows.

    At most ``max_train`` rows are used for the trees, those with the smallest
    hash; suffix statistics come from all labelled rows.  With labels of one
    kind, or none, the model is that constant (0 without labels).
    """
    rows = lexical(labelled)
    seen = rows.groupBy("_suffix").agg(F.sum("label").alias("_bad"), F.count("*").alias("_n"))
    kinds = seen.agg(F.sum("_bad"), F.sum("_n"), F.count("*")).first()
    if not kinds[1] or kinds[0] in (0, kinds[1]):
        return float(bool(kinds[1]) and kinds[0] == kinds[1]), None, True
    suffixes = seen.select("_suffix", ((F.col("_bad") + 1) / (F.col("_n") + 2)).alias("suffix_share"), F.log1p("_n").alias("suffix_seen"))
    small = kinds[2] <= MAX_BROADCAST_ROWS
    sample = rows.orderBy(F.xxhash64("_url"), "_url").limit(max_train).repartition(4)
    sample = _with_suffixes(sample, suffixes, small)
    assembler = VectorAssembler(inputCols=FEATURES, outputCol="_features", handleInvalid="keep")
    trees = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=8, maxDepth=3, stepSize=0.3, seed=7)
    return PipelineModel([assembler, trees.fit(assembler.transform(sample).select("_features", F.col("label").cast("double")))]), suffixes, small


def score(df: DataFrame, model: tuple, column: str = "block_score") -> DataFrame:
    """Add the probability of block to rows with ``_url``, ``host`` and ``path``."""
    trees, suffixes, small = model
    if suffixes is None:
        return df.withColumn(column, F.lit(float(trees)))
    made = trees.transform(_with_suffixes(lexical(df), suffixes, small))
    return made.select(*df.columns, vector_to_array("probability")[1].alias(column))


def judge(pages: DataFrame, rules: list[tuple[str, str]]) -> DataFrame:
    """page_id, host, path, rule, verdict and block_score of every url.

    Urls that a rule decides are the labelled ones; the trees fitted on them
    judge the others.  Null, empty and repeated urls get a row each; columns
    other than page_id and url are not read.  An empty table gives no rows.
    """
    host, path = split_url(F.col("url"))
    df = pages.select("page_id", F.col("url").alias("_url"), host.alias("host"), path.alias("path"))
    rule, verdict = match_rule(F.col("host"), F.col("path"), rules)
    df = df.select("*", rule.alias("rule"), verdict.alias("_by_rule"))
    labelled = df.where(F.col("_by_rule").isNotNull()).select("_url", "host", "path", (F.col("_by_rule") == "block").cast("int").alias("label"))
    scored = score(df, fit(labelled))
    verdict = F.coalesce("_by_rule", F.when(F.col("block_score") >= 0.5, "block").otherwise("allow"))
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "block_score")
