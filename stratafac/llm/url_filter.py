"""URL filters: longest-rule lists, and boosted trees for all other URLs.

The trees are trained on labelled URLs with lexical features only: lengths,
depth, digit ratio, entropy, parameter counts and statistics of the suffix.
Features are column expressions and the trees are Spark's own
``GBTClassifier``, so training and scoring stay in the JVM.

URLs without a label count as unlabelled, not as allowed: hosts are dealt into
folds, a URL is scored by trees and statistics of the other folds only, and the
score is set against those of held-out labelled URLs (after Elkan and Noto,
Learning classifiers from only positive and unlabeled data, 2008).
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stratafac.llm.tables import written

#: Labelled URLs that the trees are fitted on, at most (a hash sample).
FIT_ROWS = 20_000
#: Suffixes whose statistics are broadcast, the most frequent ones; URLs of all
#: others, each with less than a thousandth of the rows, are joined by shuffle.
SUFFIXES = 1_000
#: Pseudo-labels of the overall block share in a suffix's statistic.
SMOOTHING = 20.0
#: Parts that the hosts are dealt into; each is scored by a model of the others.
FOLDS = 3

FEATURES = (
    "url_length", "host_length", "path_length", "query_length", "depth", "host_labels", "hyphens",
    "digit_ratio", "letter_ratio", "entropy", "n_params", "n_escapes", "has_fragment", "is_https", "suffix_rate", "suffix_count",
)


@dataclass(frozen=True)
class UrlRule:
    """``host`` and all of its subdomains; ``path`` is a prefix of the path."""

    host: str
    path: str
    verdict: str

    @property
    def name(self) -> str:
        return f"{self.host}{self.path}"


def with_parts(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add ``host`` and ``path``.

    Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z
    lower-cased. Path: from there up to ``?``, ``#`` or the end. Both are empty
    for a null URL or one without ``://``.
    """
    url = F.coalesce(F.col(url_col).cast("string"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return df.select("*", F.translate(host, upper, lower).alias("host"), path.alias("path"))


def matched(rules: tuple[UrlRule, ...]) -> tuple[Column, Column]:
    """The longest rule that fits ``host`` and ``path``, and its verdict (else null)."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    # the longest is tested first: build the chain from the shortest
    for r in sorted(rules, key=lambda r: (len(r.name), r.name)):
        fits = ((F.col("host") == r.host) | F.col("host").endswith("." + r.host)) & F.col("path").startswith(r.path)
        name, verdict = F.when(fits, F.lit(r.name)).otherwise(name), F.when(fits, F.lit(r.verdict)).otherwise(verdict)
    return name, verdict


def _count(col: str, characters: str) -> Column:
    return F.length(col) - F.length(F.translate(F.col(col), characters, ""))


def lexical(df: DataFrame, url_col: str = "url") -> DataFrame:
    """Add the lexical features (all but the suffix's statistics) and ``suffix``
    (the host's last label)."""
    digits, letters = "0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    df = df.withColumn("_url", F.coalesce(F.col(url_col).cast("string"), F.lit("")))
    df = df.withColumn("_query", F.regexp_extract("_url", r"\?([^#]*)", 1))
    # entropy from the run lengths of the sorted characters
    df = df.withColumn("_chars", F.sort_array(F.split("_url", "")))
    df = df.withColumn("_ends", F.expr("filter(sequence(0, size(_chars) - 1), i -> i = size(_chars) - 1 or _chars[i] <> _chars[i + 1])"))
    runs = F.expr("transform(_ends, (e, i) -> e - coalesce(get(_ends, i - 1), -1))")
    df = df.withColumn("_runs", runs)
    n = F.greatest(F.length("_url"), F.lit(1))
    df = df.withColumn("_size", F.size("_chars").cast("double"))
    return df.select(
        *[c for c in df.columns if not c.startswith("_")],
        F.length("_url").cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.length("path").cast("double").alias("path_length"),
        F.length("_query").cast("double").alias("query_length"),
        _count("path", "/").cast("double").alias("depth"),
        F.when(F.col("host") == "", 0).otherwise(_count("host", ".") + 1).cast("double").alias("host_labels"),
        _count("host", "-").cast("double").alias("hyphens"),
        (_count("_url", digits) / n).alias("digit_ratio"),
        (_count("_url", letters) / n).alias("letter_ratio"),
        F.expr("aggregate(_runs, 0D, (a, r) -> a - (r / _size) * log2(r / _size))").alias("entropy"),
        F.when(F.col("_query") == "", 0).otherwise(_count("_query", "&") + 1).cast("double").alias("n_params"),
        _count("_url", "%").cast("double").alias("n_escapes"),
        F.col("_url").contains("#").cast("double").alias("has_fragment"),
        F.col("_url").startswith("https://").cast("double").alias("is_https"),
        F.substring_index("host", ".", -1).alias("suffix"),
    )


@dataclass(frozen=True)
class Suffixes:
    """Written statistics of all suffixes."""

    frequent: DataFrame  # at most SUFFIXES rows
    others: DataFrame | None  # None if there are no more


@dataclass(frozen=True)
class UrlModel:
    trees: tuple[GBTClassificationModel | float, ...] | None  # by fold, trained on the other folds; a constant where those have one class
    suffixes: Suffixes | None
    rate: float  # share of blocked URLs among all
    cut: float = 0.5  # the score from which on a URL is blocked

    def with_score(self, df: DataFrame) -> DataFrame:
        """Add ``score``, by the trees that saw no URL of the row's host."""
        rates = _with_statistics(df.withColumn("_fold", _fold()), self.suffixes, self.rate)
        out = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(_of_fold(rates, F.col("_fold")))
        score = F.lit(None).cast("double")
        for k, trees in enumerate(self.trees):
            if isinstance(trees, float):
                mine = F.lit(trees)
            else:
                out, mine = trees.transform(out), vector_to_array(F.col(f"_p{k}"))[1]
            score = F.when(F.col("_fold") == k, mine).otherwise(score)
        return out.select(*df.columns, score.alias("score"))

    def scored(self, df: DataFrame) -> DataFrame:
        """Add ``blocked`` (1.0 or 0.0) to rows with lexical features."""
        if self.trees is None:
            return df.withColumn("blocked", F.lit(float(self.rate >= 0.5)))
        return self.with_score(df).withColumn("blocked", (F.col("score") >= self.cut).cast("double"))


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "host"), F.lit(FOLDS)).cast("int")


def _with_statistics(df: DataFrame, suffixes: Suffixes, rate: float) -> DataFrame:
    """Add ``_rates`` and ``_counts``: the suffix's statistics without each fold."""
    # at most SUFFIXES rows, by construction
    joined = df.join(F.broadcast(suffixes.frequent), "suffix", "left")
    if suffixes.others is not None:
        # frequent suffixes stay where they are, so no key of the shuffle is hot
        rare = joined.where("_rates is null").select(*df.columns).join(suffixes.others, "suffix", "left")
        joined = joined.where("_rates is not null").unionByName(rare)
    none = F.array(*[F.lit(rate)] * FOLDS), F.array(*[F.lit(0.0)] * FOLDS)
    return joined.withColumn("_rates", F.coalesce("_rates", none[0])).withColumn("_counts", F.coalesce("_counts", none[1]))


def _of_fold(df: DataFrame, fold: Column) -> DataFrame:
    return df.withColumn("suffix_rate", F.get("_rates", fold)).withColumn("suffix_count", F.get("_counts", fold))


def _suffix_statistics(rows: DataFrame, rate: float) -> DataFrame:
    """``suffix``, ``n``, and by fold the smoothed block share (``_rates``) and log
    count (``_counts``) of the URLs outside it."""
    totals = rows.groupBy("suffix").agg(
        F.count("*").alias("n"),
        *[F.count_if(F.col("_fold") != k).alias(f"n{k}") for k in range(FOLDS)],
        *[F.coalesce(F.sum(F.when(F.col("_fold") != k, F.col("label"))), F.lit(0.0)).alias(f"b{k}") for k in range(FOLDS)],
    )
    rates = [(F.col(f"b{k}") + F.lit(SMOOTHING * rate)) / (F.col(f"n{k}") + F.lit(SMOOTHING)) for k in range(FOLDS)]
    counts = [F.log1p(f"n{k}") for k in range(FOLDS)]
    return totals.select("suffix", "n", F.array(*rates).alias("_rates"), F.array(*counts).alias("_counts"))


def _suffixes(rows: DataFrame, rate: float, frequent: int) -> Suffixes:
    every = written(_suffix_statistics(rows, rate), "url-suffixes")
    most = written(every.orderBy(F.desc("n"), "suffix").limit(frequent).drop("n"), "url-frequent-suffixes")
    if every.count() <= frequent:
        return Suffixes(most, None)
    return Suffixes(most, written(every.drop("n").join(F.broadcast(most.select("suffix")), "suffix", "left_anti"), "url-other-suffixes"))


def train(labelled: DataFrame, label_col: str = "label", fit_rows: int = FIT_ROWS, rounds: int = 10, depth: int = 4, seed: int = 7) -> UrlModel:
    """Fit the trees on rows with lexical features and a label: 1 (block), 0
    (allow) or null (unlabelled).

    The trees tell blocked URLs from all others; an unlabelled one may be bad
    too, so their score is the chance of being *listed* as bad, and ``_cut``
    sets it against the scores of held-out labelled URLs.

    Suffix statistics cover all rows; the trees see at most ``fit_rows`` of
    them, chosen by a hash of the URL's host and path. Without rows, or with
    one class only, the model is that constant.
    """
    rows = labelled.withColumn("known", F.col(label_col).cast("double")).withColumn("label", F.coalesce("known", F.lit(0.0))).withColumn("_fold", _fold())
    total = rows.agg(F.count("*").alias("n"), F.avg("label").alias("rate")).first()
    rate = float(total["rate"] or 0.0)
    if total["n"] == 0 or rate in (0.0, 1.0):
        return UrlModel(None, None, rate)
    suffixes = _suffixes(rows, rate, SUFFIXES)
    sample = rows.withColumn("_order", F.xxhash64(F.lit(seed), "host", "path", "url_length")).orderBy("_order", "host", "path").limit(fit_rows)
    lexicals = [c for c in FEATURES if not c.startswith("suffix_")]
    sample = written(sample.select("label", "known", "host", "suffix", *lexicals), "url-sample")
    seen = _with_statistics(sample.withColumn("_fold", _fold()), suffixes, rate)
    trees: list[GBTClassificationModel | float] = []
    for k in range(FOLDS):
        others = seen.where(F.col("_fold") != k)
        share = others.agg(F.avg("label")).first()[0]
        if share is None or share in (0.0, 1.0):
            trees.append(rate if share is None else float(share))
            continue
        gbt = GBTClassifier(featuresCol="_features", labelCol="label", maxIter=rounds, maxDepth=depth, seed=seed, stepSize=0.2, cacheNodeIds=False)
        fitted = gbt.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(_of_fold(others, F.lit(k))))
        trees.append(fitted.setProbabilityCol(f"_p{k}").setRawPredictionCol(f"_raw{k}").setPredictionCol(f"_label{k}"))
    model = UrlModel(tuple(trees), suffixes, rate)
    held_out = model.with_score(sample).select("score", "known").collect()  # at most fit_rows
    return replace(model, cut=_cut([(r["score"], r["known"]) for r in held_out]))


def _cut(held_out: list[tuple[float, float | None]]) -> float:
    """The score from which on a URL is blocked, by held-out (score, label) pairs.

    At half the mean score of blocked URLs, the chance of being bad is one half:
    the cut is no lower, and from there on it is the one with the most right
    verdicts on labelled URLs. If blocked URLs score no better than all do, the
    folds say nothing of each other and it is 0.5.
    """
    bad = [score for score, label in held_out if label == 1.0]
    if not bad or sum(bad) / len(bad) <= sum(score for score, _ in held_out) / len(held_out):
        return 0.5
    cut = sum(bad) / len(bad) / 2
    labelled = sorted((score, label) for score, label in held_out if label is not None and score >= cut)
    gain = best = 0  # right verdicts more than at the lowest cut
    for i, (score, label) in enumerate(labelled):
        gain += 1 if label == 0.0 else -1
        if gain > best and (i + 1 == len(labelled) or labelled[i + 1][0] > score):
            best, cut = gain, math.nextafter(score, math.inf)
    return cut


def judge(urls: DataFrame, rules: tuple[UrlRule, ...], model: UrlModel, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``id``, ``host``, ``path``, ``rule`` (the longest fitting rule's name, else
    null) and ``verdict`` (``allow`` or ``block``: the rule's, else the trees').

    Defined cases: null, empty and malformed URLs have an empty host and path,
    fit no rule and are judged by the trees on their (zero) features; repeated
    rows are judged each; an empty table gives an empty result; other columns
    of ``urls`` are ignored.
    """
    parts = lexical(with_parts(urls.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"))))
    name, verdict = matched(rules)
    parts = parts.withColumn("rule", name).withColumn("rule_verdict", verdict)
    scored = model.scored(parts)
    by_trees = F.when(F.col("blocked") == 1.0, F.lit("block")).otherwise(F.lit("allow"))
    return scored.select("id", "host", "path", "rule", F.coalesce("rule_verdict", by_trees).alias("verdict"))


def labelled_by_rules(urls: DataFrame, rules: tuple[UrlRule, ...], url_col: str = "url") -> DataFrame:
    """All URLs with lexical features and ``label``: 1 if a rule blocks them, 0
    if a rule allows them, null if none fits."""
    parts = lexical(with_parts(urls.select(F.col(url_col).cast("string").alias("url"))))
    _, verdict = matched(rules)
    return parts.withColumn("label", F.when(verdict == "block", 1.0).when(verdict == "allow", 0.0))
