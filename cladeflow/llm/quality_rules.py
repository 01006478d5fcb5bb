"""Quality rules by weak supervision: rules vote or abstain, expectation-maximisation weighs them.

Native: DataFrame functions only. The driver sees counts of vote patterns, 3 ** 9 at most.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle, words

WINDOW = 5
KEEP_FROM = 0.5


def measures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Counts over every whole text: id, n_words, word_chars, n_symbols, n_lines (with a word),
    n_dup_lines, n_repeat_words, n_capitals, n_shouts (exclamation marks), n_letters, n_plain (words
    that begin with a letter and have none of the symbols).

    Windows are compared by a 64-bit hash of their words' hashes. A window's hash gives way, in
    its low bits, to its place, so that one sort of plain longs brings equal windows together;
    neighbours are then compared by their full hashes.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    step = docs.select(F.col(id_col).alias("id"), text.alias("text"), words(text).alias("w"))
    step = step.select(
        "id", F.size("w").alias("n"),
        F.char_length(F.array_join("w", "")).alias("word_chars"),
        F.length(F.regexp_replace("text", "[^#*$%&|<>]+", "")).alias("n_symbols"),
        F.length(F.regexp_replace("text", "[^\\p{Lu}]+", "")).alias("n_capitals"),
        F.length(F.regexp_replace("text", "[^!]+", "")).alias("n_shouts"),
        F.char_length(F.regexp_replace("text", r"[^\p{L}\p{M}]+", "")).alias("n_letters"),
        F.size(F.filter("w", lambda x: x.rlike(r"^\p{L}[^#*$%&|<>]*$"))).alias("n_plain"),
        F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.transform("w", lambda x: F.xxhash64(x)).alias("h"),
    )
    step = step.select(
        "id", "n", "word_chars", "n_symbols", "n_capitals", "n_shouts", "n_letters", "n_plain",
        F.size("lines").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).alias("n_dup_lines"),
        F.expr(f"if(n < {WINDOW}, cast(array() as array<bigint>), transform(sequence(0, n - {WINDOW}), i -> xxhash64({', '.join(f'h[i + {k}]' for k in range(WINDOW))})))").alias("win"),
        F.expr("cast(ceil(log2(n + 1)) as int)").alias("b"),
    )
    step = step.withColumn("key", F.expr("sort_array(transform(win, (x, i) -> shiftleft(shiftright(x, b), b) | i))"))
    step = step.withColumn("place", F.expr("shiftleft(1L, b) - 1"))
    step = step.withColumn("twice", F.expr("""
        sort_array(transform(filter(key, (k, i) ->
            (i > 0 and shiftright(k, b) = shiftright(key[i - 1], b) and win[int(k & place)] = win[int(key[i - 1] & place)])
            or (i + 1 < size(key) and shiftright(k, b) = shiftright(key[i + 1], b) and win[int(k & place)] = win[int(key[i + 1] & place)])),
          k -> k & place))"""))
    covered = F.expr(f"""
        aggregate(twice, named_struct('n', 0L, 'end', 0L),
          (acc, p) -> named_struct('n', acc.n + p + {WINDOW} - greatest(p, acc.end), 'end', p + {WINDOW})).n""")
    return step.select(
        "id", *[F.col(c).cast("long").alias(a) for c, a in (
            ("n", "n_words"), ("word_chars", "word_chars"), ("n_symbols", "n_symbols"), ("n_lines", "n_lines"),
            ("n_dup_lines", "n_dup_lines"), ("n_capitals", "n_capitals"), ("n_shouts", "n_shouts"),
            ("n_letters", "n_letters"), ("n_plain", "n_plain"))],
        covered.alias("n_repeat_words"),
    )


def rules() -> dict[str, Column]:
    """Votes over the measures: 1 good, -1 bad, 0 abstains."""
    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0)

    c, n = F.col, F.col("n_words")
    return {
        "length": vote(n >= 30, n < 10),
        "word_length": vote((c("word_chars") >= 3 * n) & (c("word_chars") <= 12 * n), (c("word_chars") < 2 * n) | (c("word_chars") > 20 * n)),
        "symbols": vote(c("n_symbols") * 50 <= n, c("n_symbols") * 10 >= n),
        "repeats": vote(c("n_repeat_words") * 20 <= n, c("n_repeat_words") * 5 > n),
        "same_lines": vote((c("n_dup_lines") == 0) & (c("n_lines") >= 3), (c("n_dup_lines") * 2 > c("n_lines")) & (c("n_lines") >= 4)),
        "capitals": vote(c("n_capitals") * 6 <= c("word_chars"), c("n_capitals") * 2 >= c("word_chars")),
        "shouts": vote(c("n_shouts") * 50 <= n, c("n_shouts") * 10 >= n),
        "letters": vote(c("n_letters") * 50 >= c("word_chars") * 47, c("n_letters") * 10 < c("word_chars") * 9),
        "plain_words": vote(c("n_plain") * 20 >= n * 19, c("n_plain") * 4 < n * 3),
    }


def estimate(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 100) -> tuple[float, list[dict[int, float]]]:
    """Class balance, and each rule's log-odds of good for each of its votes.

    Expectation-maximisation for two classes and independent rules, each with its own
    probabilities of voting good, bad or not at all in either class. It starts from: bad, the
    surer the more rules say so, from two on. Pseudo-counts, a hundredth of the rows and at least one, say that votes lean
    to the class they name, which also holds the classes in place. Nothing else bounds what a vote weighs.
    """
    n_rules = len(patterns[0][0]) if patterns else 0
    total = sum(n for _, n in patterns)
    extra = max(1.0, total / 100)
    lean = {True: {1: 0.6, 0: 0.37, -1: 0.03}, False: {1: 0.3, 0: 0.4, -1: 0.3}}
    good = [1 / (1 + math.exp(3 * (2 * votes.count(-1) - 3))) for votes, _ in patterns]
    odds: list[dict[int, float]] = [dict.fromkeys((1, 0, -1), 0.0)] * n_rules
    base = 0.0
    for _ in range(rounds):
        mass = {True: sum(g * n for g, (_, n) in zip(good, patterns, strict=True)), False: sum((1 - g) * n for g, (_, n) in zip(good, patterns, strict=True))}
        base = math.log((mass[True] + extra) / (mass[False] + extra))
        odds = []
        for j in range(n_rules):
            seen = {True: dict.fromkeys((1, 0, -1), 0.0), False: dict.fromkeys((1, 0, -1), 0.0)}
            for g, (votes, n) in zip(good, patterns, strict=True):
                seen[True][votes[j]] += g * n
                seen[False][votes[j]] += (1 - g) * n
            chance = {k: {v: (seen[k][v] + extra * lean[k][v]) / (mass[k] + extra) for v in (1, 0, -1)} for k in (True, False)}
            odds.append({v: math.log(chance[True][v] / chance[False][v]) for v in (1, 0, -1)})
        new = [1 / (1 + math.exp(-max(-700, min(700, base + sum(odds[j][v] for j, v in enumerate(votes)))))) for votes, _ in patterns]
        change = max((abs(a - b) for a, b in zip(new, good, strict=True)), default=0)
        good = new
        if change < 1e-9:
            break
    return base, odds


def judge_quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measures of every text, base_failed, posterior (of good quality) and kept.

    Rules vote good, bad or abstain; their class-conditional accuracies are estimated without
    labels over all rows, and the posterior replaces the demand that all rules pass.
    base_failed: under 10 words, or over a fifth of the words in repeated windows; such texts are
    never kept, others are if the posterior is at least KEEP_FROM.

    Null texts count as empty: all measures 0, base_failed. Null and repeated ids are kept as
    rows; no rows give no rows; other columns are ignored.
    """
    votes = rules()
    table = settle(measures(docs, id_col, text_col))
    cast = table.select("*", *[v.alias(f"v_{k}") for k, v in votes.items()])
    names = [f"v_{k}" for k in votes]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counted = cast.groupBy(*names).count().collect()
    patterns = sorted((tuple(r[k] for k in names), r["count"]) for r in counted)
    base, odds = estimate(patterns)
    log_odds = F.lit(base)
    for k, o in zip(names, odds or [{1: 0.0, 0: 0.0, -1: 0.0}] * len(names), strict=True):
        log_odds = log_odds + F.when(F.col(k) == 1, o[1]).when(F.col(k) == -1, o[-1]).otherwise(o[0])
    judged = cast.withColumn("posterior", 1 / (1 + F.exp(-log_odds))).withColumn("base_failed", failed)
    return judged.select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & (F.col("posterior") >= KEEP_FROM)).alias("kept"), "posterior",
    )
