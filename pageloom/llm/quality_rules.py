"""Quality rules as weak supervision, in DataFrame functions only.

Each rule looks at a figure of the text and votes good, votes bad or abstains.
Expectation-maximisation over all documents estimates how often each rule's
votes are right, without any label, and the posterior
probability of quality replaces the filter by which all rules must pass.
Documents meet the iterations only as counts of equal vote patterns, of
which there are at most 3^rules.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pageloom.llm.common import SPACE, words_of
from pageloom.session import staged

WINDOW = 8


@dataclass(frozen=True)
class Rule:
    """Bad when ``figure`` is at least ``bad``, good when it is at most ``good`` (None: such a rule only finds fault), else no vote."""

    name: str
    figure: str
    good: float | None
    bad: float


#: Figures are shares of the words, or of their characters.
RULES = (
    Rule("unplain_words", "1 - (n_plain - n_stutters) / n_words", 0.15, 0.4),  # a word said twice running is not plain either
    Rule("symbols", "n_symbols / n_words", None, 0.1),
    Rule("shouting", "n_upper / word_chars", None, 0.3),
    Rule("exclaiming", "n_exclaims / n_words", None, 0.1),
    Rule("repeated_windows", "n_repeat_words / n_words", None, 0.3),
    Rule("stuttering", "n_stutters / n_words", None, 0.2),
    Rule("long_words", "word_chars / n_words", None, 12.0),
)


def _repeat_words(hashes: Column, n: Column) -> Column:
    """Words inside windows of 8 that stand in the text twice or more."""
    windows = F.transform(F.sequence(F.lit(1), n - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(hashes, i, WINDOW)))
    return F.when(n >= WINDOW, windows)


def _ordered(windows: Column) -> Column:
    """The windows as (hash, place), equal ones side by side."""
    return F.array_sort(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))


def _hit() -> Column:
    """The places of windows with an equal neighbour in ``_ordered``, in order."""
    at = lambda k: F.get(F.col("_ordered"), k)
    last = F.size("_ordered")
    twin = lambda k: ((k > 0) & (at(k - 1)["h"] == at(k)["h"])) | ((k < last - 1) & (at(k + 1)["h"] == at(k)["h"]))
    return F.array_sort(F.array_compact(F.transform(F.sequence(F.lit(0), last - 1), lambda k: F.when(twin(k), at(k)["i"]))))


#: A word of letters with their marks, joined by inner apostrophes and hyphens, and a sign behind it.
PLAIN_WORD = r"(?<!\S)\p{L}[\p{L}\p{M}]*+(?:['’‐-]\p{L}[\p{L}\p{M}]*+)*+[.,;:?।؟،]?(?!\S)"


def base_figures(docs: DataFrame) -> DataFrame:
    """(doc_id, text figures) of ``docs(doc_id, text)``; a NULL or empty text has zeros.

    Whole texts, however long. Windows are compared by a 64-bit hash of their words' hashes.
    """
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    stage = docs.select("doc_id", text.alias("_text"), words_of(F.col("text")).alias("_words"), lines.alias("_lines"))
    stage = stage.select(
        "doc_id",
        F.size("_words").alias("_n"),
        F.length(F.regexp_replace("_text", SPACE, "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.regexp_count("_text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
        F.regexp_count("_text", F.lit(r"!")).cast("long").alias("n_exclaims"),
        F.regexp_count("_text", F.lit(PLAIN_WORD)).cast("long").alias("n_plain"),
        F.regexp_count("_text", F.lit(r"(?<!\S)(\S++)(?=\s++\1(?!\S))")).cast("long").alias("n_stutters"),
        F.transform("_words", lambda w: F.xxhash64(w)).alias("_hashes"),
    )
    kept = [c for c in stage.columns if c != "_hashes"]
    stage = stage.select(*kept, _repeat_words(F.col("_hashes"), F.size("_hashes")).alias("_windows"))
    # Most texts repeat no window; only the others are looked at closely.
    twice = F.size(F.array_distinct("_windows")) < F.size("_windows")
    stage = stage.select(*kept, F.when(twice, F.col("_windows")).alias("_windows"))
    stage = stage.select(*kept, F.when(F.col("_windows").isNotNull(), _ordered(F.col("_windows"))).alias("_ordered"))
    stage = stage.select(*kept, F.when(F.col("_ordered").isNotNull(), _hit()).alias("_hit"))
    covered = F.aggregate(
        F.sequence(F.lit(1), F.size("_hit")),
        F.lit(0),
        lambda total, k: total + F.least(F.lit(WINDOW), F.coalesce(F.get(F.col("_hit"), k) - F.get(F.col("_hit"), k - 1), F.lit(WINDOW))),
    )
    figures = [c for c in kept if c not in ("doc_id", "_n")]
    return stage.select("doc_id", F.col("_n").cast("long").alias("n_words"), *figures, F.when(F.col("_hit").isNotNull() & (F.size("_hit") > 0), covered).otherwise(0).cast("long").alias("n_repeat_words"))


def votes(figures: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``figures`` with a column ``v_<rule>`` for each rule: 1 good, -1 bad, 0 no vote. Texts without words get no votes."""

    def vote(rule: Rule) -> Column:
        figure = F.expr(f"({rule.figure})")
        fault = F.when(F.col("n_words") == 0, 0).when(figure >= rule.bad, -1)
        return (fault if rule.good is None else fault.when(figure <= rule.good, 1)).otherwise(0).cast("tinyint")

    return figures.withColumns({f"v_{r.name}": vote(r) for r in rules})


@dataclass(frozen=True)
class VoteModel:
    """Share of good documents, and per rule the probability that a vote it gives is right."""

    prior: float
    accuracy: tuple[float, ...]
    rules: tuple[Rule, ...] = RULES

    def posterior(self) -> Column:
        """The probability that a row with the columns ``v_<rule>`` is good; an abstention is no evidence."""
        odds = F.lit(math.log(self.prior / (1 - self.prior)))
        for rule, right in zip(self.rules, self.accuracy):
            odds = odds + F.col(f"v_{rule.name}") * math.log(right / (1 - right))
        return 1 / (1 + F.exp(-odds))


def fit_votes(voted: DataFrame, rules: tuple[Rule, ...] = RULES, iterations: int = 60, tolerance: float = 1e-6, prior: float = 0.8, right: float = 0.9, smooth: float = 1.0) -> VoteModel:
    """Estimate a ``VoteModel`` by expectation-maximisation over all rows of ``voted``.

    Starts from votes that are right with probability ``right``, which fixes the side that is called good; accuracies stay within
    (0.5, 1), so the sides cannot change places. ``smooth`` votes of the starting accuracy are added to each rule. Without rows, or where no rule
    votes, the start is returned almost unchanged. Each iteration is one small aggregation over the vote patterns, whose sums (two per rule) come to the driver.
    """
    names = [f"v_{r.name}" for r in rules]
    patterns = staged(voted.groupBy(*names).agg(F.count(F.lit(1)).cast("double").alias("rows")).coalesce(1), "vote-patterns")
    model = VoteModel(prior, (right,) * len(rules), rules)
    for _ in range(iterations):
        sums = [F.sum(F.col("rows") * F.col("p")), F.sum("rows")]
        for v in map(F.col, names):
            hit = F.when(v == 1, F.col("p")).when(v == -1, 1 - F.col("p"))
            sums += [F.sum(F.col("rows") * hit), F.sum(F.when(v != 0, F.col("rows")))]
        got = [x or 0.0 for x in patterns.withColumn("p", model.posterior()).agg(*sums).first()]
        inside = lambda x, low: min(1 - 1e-6, max(low, x))
        after = VoteModel(
            inside((got[0] + smooth * prior) / (got[1] + smooth), 1e-6),
            tuple(inside((got[k] + smooth * right) / (got[k + 1] + smooth), 0.5 + 1e-6) for k in range(2, len(got), 2)),
            rules,
        )
        moved = max(abs(a - b) for a, b in zip((model.prior, *model.accuracy), (after.prior, *after.accuracy)))
        model = after
        if moved < tolerance:
            break
    return model


def quality_by_votes(docs: DataFrame, rules: tuple[Rule, ...] = RULES, threshold: float = 0.5) -> DataFrame:
    """Figures, votes, ``base_failed``, ``posterior`` and ``kept`` for each row of ``docs(doc_id, text)``.

    ``base_failed``: fewer than 20 words, or over 30 % of them in repeated windows. ``kept``: not failed, and the posterior
    is at least ``threshold``. NULL, empty and blank texts have no words and fail. Every row has one row in the result, repeated
    ids too; a NULL id stays NULL; other columns are ignored. An empty table gives an empty result.
    """
    voted = staged(votes(base_figures(docs), rules), "votes")
    model = fit_votes(voted, rules)
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return voted.withColumns({"base_failed": failed, "posterior": model.posterior()}).withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
