"""Quality rules by weak supervision.

Each rule reads a document's features and votes good (1), bad (-1) or abstains
(0); no rule decides alone. Expectation-maximisation over the counts of the
vote patterns of all documents estimates every rule's accuracy (how often it
votes good on good documents and bad on bad ones) and the share of good
documents; a document is kept if its posterior probability of being good
reaches ``threshold``.

Features, votes and pattern counts are DataFrame expressions. Only the counts
of the vote patterns reach the driver: with R rules at most 3^R rows, whatever
the number of documents. The posterior of each pattern goes back as a map
literal of the same bound.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's word and symbol classes.
SPACES = "\\x20\\x09-\\x0D"
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """``good`` and ``bad`` are SQL conditions on the feature columns; where
    both hold, or neither does, the rule abstains."""

    name: str
    good: str
    bad: str


#: Shares are of words (w) or code points in words (c).
RULES = (
    Rule("length", "n_words >= 50", "n_words < 20"),
    Rule("word_size", "word_chars between 3 * n_words and 10 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    Rule("symbols", "50 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    Rule("symbol_words", "50 * n_symbol_words <= n_words", "10 * n_symbol_words > n_words"),
    Rule("letters", "10 * n_letters >= 9 * word_chars", "20 * n_letters < 17 * word_chars"),
    Rule("dup_lines", "n_dup_lines = 0", "10 * n_dup_lines > 3 * n_lines"),
    Rule("repetition", "5 * n_repeat_words <= n_words", "2 * n_repeat_words > n_words"),
    Rule("variety", "5 * n_distinct_words >= n_words", "20 * n_distinct_words < n_words"),
    Rule("line_ends", "2 * n_ended_lines >= n_lines", "20 * n_ended_lines < n_lines and n_lines >= 5"),
)


def features(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """The columns ``keys`` and the features of every row of ``docs``.

    ``n_words``; ``word_chars``: code points in words; ``n_symbols``:
    characters of ``[#*$%&|<>]``; ``n_lines``: lines with a word;
    ``n_dup_lines``: of those, lines equal to an earlier one;
    ``n_ended_lines``: of those, lines that end in a sentence mark;
    ``n_letters``; ``n_symbol_words``: words with such a symbol;
    ``n_distinct_words``; ``n_repeat_words``: words in 3-word windows found
    twice or more in the text, the first included.

    All are long. A null text has no words. Work per document is n log n in
    its words (one sort of the window hashes). Other columns are ignored.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    df = docs.select(*(F.col(k).alias(f"_key_{i}") for i, k in enumerate(keys)), text.alias("_text"))
    bare = F.translate("_text", " \t\n\x0b\x0c\r", "")
    words = F.filter(F.split("_text", f"[{SPACES}]+"), lambda w: w != F.lit(""))
    lines = F.filter(F.split("_text", "\n"), lambda x: x.rlike(f"[^{SPACES}]"))
    df = df.select(
        "*",
        words.alias("_words"),
        lines.alias("_lines"),
        F.length(bare).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        F.length(F.regexp_replace("_text", r"\P{L}+", "")).cast("long").alias("n_letters"),
    )
    # 3-word windows as (hash, place), sorted; the text never leaves its row
    df = df.withColumn(
        "_grams",
        F.expr(
            "case when size(_words) < 3 then cast(array() as array<struct<h: bigint, p: int>>) "
            "else sort_array(transform(sequence(0, size(_words) - 3), i -> named_struct("
            "'h', xxhash64(_words[i], _words[i + 1], _words[i + 2]), 'p', i))) end"
        ),
    )
    df = df.withColumn(
        "_repeated",
        F.expr("sort_array(transform(filter(_grams, (x, i) -> x.h = get(_grams, i - 1).h or x.h = get(_grams, i + 1).h), x -> x.p))"),
    )
    # places covered by [p, p + 3): each start covers up to the next one
    df = df.withColumn(
        "n_repeat_words",
        F.expr("aggregate(transform(_repeated, (p, i) -> least(3, coalesce(get(_repeated, i + 1) - p, 3))), 0L, (a, x) -> a + x)"),
    )
    ended = F.filter("_lines", lambda x: x.rlike(f"[.!?:;。\"'”)][{SPACES}]*$"))
    df = df.select(
        *(F.col(f"_key_{i}").alias(k) for i, k in enumerate(keys)),
        F.size("_words").cast("long").alias("n_words"),
        "word_chars",
        "n_symbols",
        "n_letters",
        F.size(F.filter("_words", lambda w: w.rlike(f"[{SYMBOLS}]"))).cast("long").alias("n_symbol_words"),
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.size(ended).cast("long").alias("n_ended_lines"),
        F.size(F.array_distinct("_words")).cast("long").alias("n_distinct_words"),
        "n_repeat_words",
    )
    return df


def votes(df: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Add ``votes``: one character per rule, ``+`` good, ``-`` bad, ``0`` abstain."""
    marks = [
        F.expr(f"case when ({r.good}) and not ({r.bad}) then '+' when ({r.bad}) and not ({r.good}) then '-' else '0' end")
        for r in rules
    ]
    return df.withColumn("votes", F.concat(*marks))


#: Share of good documents, accuracy on good and on bad ones, to start from.
START = (0.85, 0.95, 0.5)
INFORMED = 1.05


@dataclass(frozen=True)
class LabelModel:
    prior: float  # share of good documents
    right_good: tuple[float, ...]  # per rule: votes good, given a good document and a vote
    right_bad: tuple[float, ...]  # per rule: votes bad, given a bad document and a vote

    def posterior(self, pattern: str) -> float:
        good, bad = math.log(self.prior), math.log(1 - self.prior)
        for v, g, b in zip(pattern, self.right_good, self.right_bad):
            if v == "+":
                good, bad = good + math.log(g), bad + math.log(1 - b)
            elif v == "-":
                good, bad = good + math.log(1 - g), bad + math.log(b)
        return 1 / (1 + math.exp(min(700.0, bad - good)))


def fit(patterns: dict[str, int], n_rules: int, rounds: int = 100, strength: float = 20.0) -> LabelModel:
    """Expectation-maximisation over pattern counts.

    A bad document need not fail every rule, so the two accuracies of a rule
    are estimated apart. They start at ``START``; ``strength`` pseudo-votes of
    that accuracy keep a rule that hardly votes near it. Rules stay better
    than chance (the accuracies sum to ``INFORMED`` at least) and good
    documents pass a rule more often than not, so the two classes can't swap.
    Without documents the start is returned.
    """
    prior, start_good, start_bad = START
    model = LabelModel(prior, (start_good,) * n_rules, (start_bad,) * n_rules)
    total = sum(patterns.values())
    for _ in range(rounds if total else 0):
        post = {p: model.posterior(p) for p in sorted(patterns)}
        prior = sum(post[p] * n for p, n in sorted(patterns.items())) / total

        def accuracy(mark: str, good: bool, j: int, start: float) -> float:
            hit = all_votes = 0.0
            for p, n in sorted(patterns.items()):
                if p[j] != "0":
                    w = n * (post[p] if good else 1 - post[p])
                    all_votes += w
                    hit += w * (p[j] == mark)
            return (hit + strength * start) / (all_votes + strength)

        right_good = [min(0.99, max(0.6, accuracy("+", True, j, start_good))) for j in range(n_rules)]
        right_bad = [min(0.99, max(INFORMED - right_good[j], accuracy("-", False, j, start_bad))) for j in range(n_rules)]
        model = LabelModel(min(0.99, max(0.01, prior)), tuple(right_good), tuple(right_bad))
    return model


def judged(voted: DataFrame, model: LabelModel, patterns: list[str], threshold: float) -> DataFrame:
    """Add ``p_good`` (posterior) and ``good`` (``p_good`` >= ``threshold``)."""
    table = [F.lit(x) for p in patterns for x in (p, model.posterior(p))]
    p_good: Column = F.element_at(F.create_map(*table), F.col("votes")) if table else F.lit(model.prior)
    return voted.withColumn("p_good", p_good).withColumn("good", F.col("p_good") >= F.lit(threshold))


def weakly_supervised(featured: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Vote, fit and judge the rows of ``featured`` (see ``features``).

    ``featured`` is read twice (pattern counts, then verdicts): pass a written
    table. Adds ``votes``, ``p_good`` and ``good``.

    Defined cases: null features make a rule abstain; ties at the threshold
    are good; an empty table gives an empty result.
    """
    voted = votes(featured, rules)
    counts = {r["votes"]: r["n"] for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect()}
    model = fit(counts, len(rules))
    return judged(voted, model, sorted(counts), threshold)
