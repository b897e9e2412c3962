"""Quality by weak supervision: rules vote or abstain, EM weighs the rules.

Every rule looks at one count or share of a text and votes keep (1), reject (-1) or
abstains (0). How often each rule gives each vote on good and on bad texts is not
known; expectation-maximisation estimates it, and the share of good texts, from
how the rules agree over the whole corpus. A text's posterior probability of being
good decides.

Bad texts are of several kinds (all symbols, all capitals, the same line again and
again), and within a kind the rules are independent; one class for all of them
would be taken by the kind on which two rules agree. So there is a kind for each
rule that rejects anything, however many texts it rejects: one family of junk may
be most of a corpus. Only :func:`estimate` on rules that nobody vouches for does not
believe those that reject more than ``MOST_BAD`` of the texts on their own, as a rule
that votes at random cannot be told from junk by counts.

All work on texts is DataFrame functions. The rules' votes are counted by pattern,
of which there are at most ``3 ** rules`` whatever the size of the corpus; the
iterations run over those counts.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Collection

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from demandloom.llm.common import BLANKS, durable

WINDOW = 8
ROUNDS = 50
MOST_BAD = 0.3
_LEAST = 0.001
FEATURES = (
    "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_marks", "n_digits",
)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _repeated_words(words: Column, window: int) -> Column:
    """Words inside windows of ``window`` words that stand twice or more in ``words``."""

    def covered(places: Column) -> Column:
        # a window adds what the next one does not cover
        steps = F.transform(
            places, lambda at, i: F.coalesce(F.least(F.lit(window), F.get(places, i + 1) - at), F.lit(window))
        )
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    def twins(ordered: Column) -> Column:
        same = F.filter(
            F.transform(
                ordered,
                lambda x, i: F.when(
                    (F.get(ordered, i - 1)["hash"] == x["hash"]) | (F.get(ordered, i + 1)["hash"] == x["hash"]), x["at"]
                ),
            ),
            lambda at: at.isNotNull(),
        )
        return bound(F.sort_array(same), covered)

    def counted(hashes: Column) -> Column:
        pairs = F.transform(hashes, lambda x, i: F.struct(x.alias("hash"), i.alias("at")))
        repeats = F.size(F.array_distinct(hashes)) < F.size(hashes)
        return F.when(repeats, bound(F.sort_array(pairs), twins)).otherwise(F.lit(0).cast("long"))

    starts = F.sequence(F.lit(0), F.size(words) - window)
    hashes = F.transform(starts, lambda at: F.xxhash64(*(F.get(words, at + i) for i in range(window))))
    return F.when(F.size(words) > window, bound(hashes, counted)).otherwise(F.lit(0).cast("long"))


def text_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id`` and the counts of ``FEATURES`` for every row; a null text counts as empty.

    Windows are compared by the 64-bit hashes of their words within one text.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    words = F.filter(F.split(text, BLANKS), lambda word: word != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    by_word = bound(
        words,
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
            _repeated_words(w, window).alias("n_repeat_words"),
        ),
    )
    by_line = bound(
        lines,
        lambda own: F.struct(
            F.size(own).cast("long").alias("n_lines"),
            (F.size(own) - F.size(F.array_distinct(own))).cast("long").alias("n_dup_lines"),
        ),
    )
    counts = docs.select(
        F.col(id_col).alias("doc_id"),
        by_word.alias("w"),
        by_line.alias("l"),
        F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_upper"),
        F.regexp_count(text, F.lit("[!?]")).cast("long").alias("n_marks"),
        F.regexp_count(text, F.lit("[0-9]")).cast("long").alias("n_digits"),
    )
    return counts.select("doc_id", "w.*", "l.*", "n_symbols", "n_upper", "n_marks", "n_digits").select("doc_id", *FEATURES)


def _share(part: str, whole: str) -> Column:
    return F.col(part) / F.greatest(F.col(whole), F.lit(1))


def _vote(value: Column, keep: Column, reject: Column) -> Column:
    return F.when(value.isNull(), 0).when(reject, -1).when(keep, 1).otherwise(0)


def _rule(value: Column, keep_to: float, reject_from: float) -> Column:
    return _vote(value, value <= keep_to, value > reject_from)


def rules() -> dict[str, Column]:
    """The votes, by name, over the columns of :func:`text_counts`."""
    words, length = F.col("n_words"), _share("word_chars", "n_words")
    return {
        "length": _vote(words, words.between(50, 100_000), words < 20),
        "word_length": _vote(length, length.between(3, 9), (length < 2) | (length > 14)),
        "symbols": _rule(_share("n_symbols", "n_words"), 0.02, 0.2),
        "repeated_lines": _rule(_share("n_dup_lines", "n_lines"), 0.05, 0.3),
        "repeated_words": _rule(_share("n_repeat_words", "n_words"), 0.05, 0.3),
        "capitals": _rule(_share("n_upper", "word_chars"), 0.15, 0.5),
        "marks": _rule(_share("n_marks", "n_words"), 0.1, 0.5),
        "digits": _rule(_share("n_digits", "word_chars"), 0.1, 0.4),
    }


class Model:
    """Log shares of the classes, good first, and ``weight[class][rule][vote]``, log probabilities of votes.

    An abstention says nothing about the class.
    """

    def __init__(self, names: list[str], share: list[float], weight: list[list[dict[int, float]]]):
        self.names, self.share, self.weight = names, share, weight

    def scores(self, votes: tuple[int, ...]) -> list[float]:
        return [s + sum(own[v] for own, v in zip(rules, votes)) for s, rules in zip(self.share, self.weight)]

    def good(self, votes: tuple[int, ...]) -> float:
        return _shares(self.scores(votes))[0]

    def posterior(self) -> Column:
        """The probability of being good, over vote columns of ``names``."""

        def score(share: float, rules: list[dict[int, float]]) -> Column:
            total = F.lit(share)
            for name, own in zip(self.names, rules):
                total = total + F.element_at(F.create_map(*(F.lit(x) for pair in sorted(own.items()) for x in pair)), F.col(name))
            return total

        good, *bad = (score(share, rules) for share, rules in zip(self.share, self.weight))
        odds = F.lit(1.0)
        for own in bad:
            odds = odds + F.exp(F.least(own - good, F.lit(700.0)))
        return 1 / odds


def _shares(scores: list[float]) -> list[float]:
    top = max(scores)
    parts = [math.exp(s - top) for s in scores]
    return [p / sum(parts) for p in parts]


def estimate(
    names: list[str], patterns: dict[tuple[int, ...], int], rounds: int = ROUNDS, believed: Collection[str] = ()
) -> Model:
    """EM over counted vote patterns. It starts from good texts as those that no rule rejects, and a
    bad kind for what each rule rejects. Without texts, a text is as likely good as bad.

    Rules in ``believed`` have a kind at every share of texts, the others up to ``MOST_BAD``.
    """
    total = sum(patterns.values())
    rejected = [sum(n for p, n in patterns.items() if p[j] < 0) for j in range(len(names))]
    kinds = [j for j, n in enumerate(rejected) if n and (names[j] in believed or n <= MOST_BAD * total)]
    belief = {}
    for p in patterns:
        own = [0.5 if p[j] < 0 else 0.001 for j in kinds]
        belief[p] = _shares([math.log(x) for x in [0.9 if max(own, default=0) < 0.1 else 0.05, *own]])
    model = Model(names, [math.log(0.5)] * 2, [[dict.fromkeys((-1, 0, 1), 0.0) for _ in names]] * 2)
    for _ in range(rounds if patterns else 0):
        sizes = [sum(n * belief[p][k] for p, n in patterns.items()) for k in range(len(kinds) + 1)]
        weight = []
        for k in range(len(sizes)):
            rules = []
            for j in range(len(names)):
                keep, reject = (
                    sum(n * belief[p][k] for p, n in patterns.items() if p[j] == vote) + _LEAST for vote in (1, -1)
                )
                rules.append({-1: math.log(reject / (keep + reject)), 0: 0.0, 1: math.log(keep / (keep + reject))})
            weight.append(rules)
        model = Model(names, [math.log((size + _LEAST) / (total + len(sizes) * _LEAST)) for size in sizes], weight)
        belief = {p: _shares(model.scores(p)) for p in patterns}
    return model


def with_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = ROUNDS) -> DataFrame:
    """Counts, votes (``vote_<rule>``) and ``posterior`` of every row of ``docs``, by ``doc_id``.

    Null and empty texts have counts of 0 and are judged like any other. Null ids and
    repeated rows stay, an empty table gives an empty table, and further columns are not read.
    """
    votes = {f"vote_{name}": vote.cast("int") for name, vote in rules().items()}
    counts = durable(text_counts(docs, id_col, text_col)).withColumns(votes)
    names = list(votes)
    patterns = counts.groupBy(*names).agg(F.count("*").alias("n")).collect()  # at most 3 ** len(names) rows
    model = estimate(names, {tuple(row[name] for name in names): row["n"] for row in patterns}, rounds, believed=names)
    return counts.withColumn("posterior", model.posterior())
