"""Quality rules with weak supervision, in DataFrame functions only.

Each rule looks at one measure of a text and votes good (1), bad (-1) or
abstains (0).  A generative model - the share of good texts and, for each rule,
how it votes on good and on bad ones - is estimated by expectation-maximisation
from the votes alone.  The posterior probability of good, not a conjunction of
all rules, decides.

Expectation-maximisation only needs the number of texts with each pattern of
votes.  There are at most 3 to the power of the number of rules of them, at any
corpus size; that table is what reaches the driver.

Null texts count as empty: no words, all measures 0, base_failed.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tables import WORD
from ..session import cut_lineage

WINDOW = 5
_SPACE = r"[\x20\x09-\x0D]+"
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame) -> DataFrame:
    """doc_id and the base measures of each whole text, in one pass without a shuffle.

    Windows are compared by a 64-bit hash of their words.  Texts in which no
    window comes twice, nearly all, are done with a distinct count; only the others
    have their windows sorted.
    """
    text = F.coalesce("text", F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    words = docs.select("doc_id", text.alias("text")).select(
        "doc_id",
        F.array_remove(F.split("text", _SPACE), "").alias("words"),
        F.regexp_count("text", F.lit("[#*$%&|<>]")).cast("long").alias("n_symbols"),
        with_word.alias("lines"),
    )
    starts = F.when(F.size("words") >= WINDOW, F.sequence(F.lit(0), F.size("words") - WINDOW)).otherwise(F.array().cast("array<int>"))
    # The word array is named once per window word: xxhash64 takes them in order.
    window = F.transform(starts, lambda i: F.xxhash64(*(F.get("words", i + k) for k in range(WINDOW))))
    counted = words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        "n_symbols",
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        window.alias("windows"),
    )
    placed = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    sorted_when_needed = counted.withColumn(
        "placed", F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed)
    ).drop("windows")
    again = F.transform(
        F.filter(
            F.transform(
                "placed",
                lambda x, j: F.struct(
                    x["i"].alias("i"),
                    (
                        F.coalesce(F.get("placed", j - 1)["h"] == x["h"], F.lit(False))
                        | F.coalesce(F.get("placed", j + 1)["h"] == x["h"], F.lit(False))
                    ).alias("twice"),
                ),
            ),
            lambda x: x["twice"],
        ),
        lambda x: x["i"],
    )
    positions = sorted_when_needed.withColumn("at", F.when(F.col("placed").isNotNull(), F.sort_array(again))).drop("placed")
    # A window adds the words that the next repeated window does not begin before.
    gaps = F.transform("at", lambda p, j: F.least(F.coalesce(F.get("at", j + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda total, gap: total + gap)
    return positions.select("doc_id", *MEASURES[:4], F.coalesce(covered, F.lit(0).cast("long")).alias("n_repeat_words"))


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _vote(good: Column, bad: Column) -> Column:
    return F.when(F.coalesce(bad, F.lit(False)), -1).when(F.coalesce(good, F.lit(False)), 1).otherwise(0)


def rules() -> dict[str, Column]:
    """The votes; a rule abstains between its two limits."""
    words = F.col("n_words")
    mean = F.col("word_chars") / F.greatest(words, F.lit(1))
    repeated = F.col("n_repeat_words")
    return {
        "enough_words": _vote(words >= 50, words < 5),
        "word_length": _vote((mean >= 3) & (mean <= 8), (mean < 2) | (mean > 15)),
        "few_symbols": _vote(50 * F.col("n_symbols") <= words, 5 * F.col("n_symbols") > words),
        # Repeated lines repeat windows too, so both make one rule: rules should fail independently.
        "little_repetition": _vote(
            (20 * repeated <= words) & (F.col("n_dup_lines") == 0), (5 * repeated > words) | (F.col("n_dup_lines") >= 4)
        ),
    }


@dataclass
class Accuracies:
    """Share of good texts and, for each rule, the chances of -1, 0 and 1 on bad and on good texts."""

    good: float
    votes: dict[str, dict[int, tuple[float, float]]]


#: What is believed of a rule before any vote is seen: chances of -1, 0 and 1 on bad and on good texts.
#: A bad text breaks few rules, but a good one hardly ever breaks any.
PRIOR = {-1: (0.3, 0.004), 0: (0.1, 0.1), 1: (0.6, 0.896)}
PRIOR_GOOD = 0.85


def estimate(
    counts: list[tuple[tuple[int, ...], int]], names: list[str], trust: float = 1.0, rounds: int = 200
) -> Accuracies:
    """Expectation-maximisation over vote patterns.

    The prior weighs ``trust`` times as much as the votes, at any corpus size.  It
    keeps "bad" the class of texts that break some rule: rules about different
    faults rarely fail together, and without it the class would be those texts that
    break the two most alike rules.  Without rows the prior stands.
    """
    model = Accuracies(PRIOR_GOOD, {name: dict(PRIOR) for name in names})
    total = sum(n for _, n in counts)
    before = trust * total
    share = (1 - PRIOR_GOOD, PRIOR_GOOD)
    for _ in range(rounds if total else 0):
        good = before * PRIOR_GOOD
        tally = {name: {v: [before * share[k] * x[k] for k in (0, 1)] for v, x in PRIOR.items()} for name in names}
        for pattern, n in counts:
            p = posterior(model, dict(zip(names, pattern, strict=True)))
            good += n * p
            for name, vote in zip(names, pattern, strict=True):
                tally[name][vote][0] += n * (1 - p)
                tally[name][vote][1] += n * p
        new = Accuracies(good / (total + before), {})
        for name in names:
            sums = [sum(x[k] for x in tally[name].values()) for k in (0, 1)]
            new.votes[name] = {v: (x[0] / sums[0], x[1] / sums[1]) for v, x in tally[name].items()}
        moved = abs(new.good - model.good)
        model = new
        if moved < 1e-9:
            break
    return model


def posterior(model: Accuracies, votes: dict[str, int]) -> float:
    odds = math.log(model.good / (1 - model.good))
    for name, vote in votes.items():
        bad, good = model.votes[name][vote]
        odds += math.log(good / bad)
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def posterior_column(model: Accuracies, votes: dict[str, Column]) -> Column:
    """The posterior as a column expression over the votes."""
    odds = F.lit(math.log(model.good / (1 - model.good)))
    for name, vote in votes.items():
        weight = {v: math.log(good / bad) for v, (bad, good) in model.votes[name].items()}
        odds = odds + F.when(vote == 1, weight[1]).when(vote == -1, weight[-1]).otherwise(weight[0])
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """Per row of ``docs``: doc_id, the measures, base_failed, quality (posterior) and kept.

    The narrow measures are written once, so the texts are read once.
    """
    measures = cut_lineage(measured(docs))
    votes = rules()
    names = list(votes)
    counts = measures.select(*(v.alias(n) for n, v in votes.items())).groupBy(names).count().collect()
    model = estimate([(tuple(r[n] for n in names), r["count"]) for r in sorted(counts)], names)
    return (
        measures.withColumn("base_failed", base_failed())
        .withColumn("quality", posterior_column(model, votes))
        .withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= least))
    )
