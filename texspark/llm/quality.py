"""Quality by weak supervision, with column expressions only.

Rules look at a document's statistics and vote for or against it, or abstain.
Expectation-maximisation over the counts of vote patterns estimates how often each
rule is right, and a document is kept if its posterior probability of being good is at
least one half. Only the pattern counts (3 to the power of the rules, at most) reach the
driver.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from texspark.llm.common import saved, table

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
BLANKS = r"[\x20\x09-\x0D]+"

#: name: (against, in favour) as conditions on the statistics; neither means abstaining.
#: A rule that looks for one fault never votes in favour: bad documents of other kinds
#: lack that fault too.
RULES = {
    "length": ("n_words < 30", "n_words >= 50"),
    "word_length": ("word_chars < 2.5 * n_words or word_chars > 12 * n_words", "word_chars between 3 * n_words and 9 * n_words"),
    "lines": ("n_dup_lines >= 3 and n_dup_lines > 0.30 * n_lines", "n_dup_lines = 0"),
    "symbols": ("n_symbols > 0.10 * n_words", None),
    "repetition": ("n_repeat_words > 0.30 * n_words", None),
    "capitals": ("n_capitals > 0.30 * word_chars", None),
    "exclamation": ("n_marks > 0.15 * n_words", None),
}
#: How often a rule that votes is right about good and about bad documents: at first, at
#: least and at most; and the votes that the first guess counts as. A rule looks for one
#: fault, so it misses most bad documents, but seldom blames good ones.
START, LEAST, MOST, WEIGHT = (0.99, 0.3), (0.97, 0.1), 0.999, 10.0


def removed(text: Column, characters: str) -> Column:
    """How many of these characters the text has."""
    return (F.length(text) - F.length(F.translate(text, characters, ""))).cast("long")


def statistics(docs: DataFrame) -> DataFrame:
    """Counts of each whole text; each step is a projection, so long arrays are made once."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select(
        "doc_id", F.filter(F.split("text", BLANKS), lambda w: w != "").alias("words"), F.filter(F.split("text", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]")).alias("lines"),
        F.length(F.translate("text", " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"), removed(F.col("text"), "#*$%&|<>").alias("n_symbols"), removed(F.col("text"), UPPER).alias("n_capitals"), removed(F.col("text"), "!").alias("n_marks"),
    )
    counts = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_capitals", "n_marks"]
    rows = rows.select("*", F.size("words").cast("long").alias("n_words"), F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"))
    window = F.transform("words", lambda w, i: F.xxhash64(w, F.get("words", i + 1), F.get("words", i + 2)))
    rows = rows.select(*counts, F.when(F.col("n_words") >= 3, F.slice(window, 1, F.col("n_words").cast("int") - 2)).alias("windows"))
    placed = F.sort_array(F.transform("windows", lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
    rows = rows.select(*counts, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), placed).alias("placed"))
    again = F.filter("placed", lambda p, i: F.get("placed", i - 1).getField("x").eqNullSafe(p.x) | F.get("placed", i + 1).getField("x").eqNullSafe(p.x))
    covered = F.flatten(F.transform(again, lambda p: F.array(p.i, p.i + 1, p.i + 2)))
    return rows.select(*counts, F.coalesce(F.size(F.array_distinct(covered)).cast("long"), F.lit(0)).alias("n_repeat_words"))


def estimated(patterns: list[tuple[tuple[int, ...], int]], rounds: int = 50) -> tuple[float, list[tuple[float, float]]]:
    """The share of good documents, and how often each rule that votes is right about good and about bad ones."""
    share, accuracy = 0.8, [START] * len(RULES)
    one_sided = [favour is None for _, favour in RULES.values()]  # all documents count for these, not only those voted on
    for _ in range(rounds):
        good_sum, total = 0.0, 0
        sums = [[WEIGHT * START[0], WEIGHT, WEIGHT * START[1], WEIGHT] for _ in RULES]  # right and all votes about good ones, then bad ones
        for pattern, n in patterns:
            p = posterior(pattern, share, accuracy)
            good_sum, total = good_sum + n * p, total + n
            for k, v in enumerate(pattern):
                if v or one_sided[k]:
                    sums[k][0] += n * p * (v >= 0)
                    sums[k][1] += n * p
                    sums[k][2] += n * (1 - p) * (v < 0)
                    sums[k][3] += n * (1 - p)
        share = min(0.95, max(0.05, good_sum / total)) if total else share
        accuracy = [(min(MOST, max(LEAST[0], g / gn)), min(MOST, max(LEAST[1], b / bn))) for g, gn, b, bn in sums]
    return share, accuracy


def weights(share: float, accuracy: list[tuple[float, float]]) -> tuple[float, list[tuple[float, float]]]:
    """Log odds of being good before any vote, and what a vote in favour and one against add to them."""
    return math.log(share / (1 - share)), [(math.log(g / (1 - b)), math.log((1 - g) / b)) for g, b in accuracy]


def posterior(pattern: tuple[int, ...], share: float, accuracy: list[tuple[float, float]]) -> float:
    odds, by_rule = weights(share, accuracy)
    odds += sum(w[0] if v > 0 else w[1] for v, w in zip(pattern, by_rule, strict=True) if v)
    return 1 / (1 + math.exp(-odds))


def judge(docs: DataFrame) -> DataFrame:
    """Quality of documents (doc_id, text).

    Returns a row for each row of docs: doc_id, the statistics, a vote (1, 0, -1) of each
    rule and posterior, the probability that the document is good. A null text is one
    without words. Repeated rows are judged once each; an empty table gives no rows;
    other columns are ignored.
    """
    vote = lambda against, favour: F.when(F.expr(against), -1).when(F.expr(favour or "false"), 1).otherwise(0)
    judged = saved(statistics(docs).select("*", *(vote(*rule).alias(f"vote_{name}") for name, rule in RULES.items())), "votes")
    columns = [f"vote_{name}" for name in RULES]
    patterns = [(tuple(r[c] for c in columns), r.n) for r in judged.groupBy(*columns).agg(F.count("*").alias("n")).collect()]
    share, accuracy = estimated(sorted(patterns))
    first, by_rule = weights(share, accuracy)
    odds = F.lit(first)
    for c, (favour, against) in zip(columns, by_rule, strict=True):
        odds = odds + F.when(F.col(c) > 0, favour).when(F.col(c) < 0, against).otherwise(0.0)
    return judged.withColumn("posterior", 1 / (1 + F.exp(-odds)))


def op7_quality(spark, sf_dir: str) -> DataFrame:
    """Every document's statistics, the base rules' verdict and the posterior's."""
    judged = judge(table(spark, sf_dir, "documents"))
    failed = F.expr("n_words < 50 or 100 * n_repeat_words > 50 * n_words")
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & (F.col("posterior") >= 0.5)).alias("kept"), F.round("posterior", 6).alias("posterior"))


def oracle() -> str:
    """The columns and rows of op7_quality in DuckDB."""
    rules = list(enumerate(RULES.values(), 1))
    votes = ", ".join(f"CASE WHEN {against} THEN -1 WHEN {favour or 'false'} THEN 1 ELSE 0 END" for _, (against, favour) in rules)
    p = "1 / (1 + exp(-(ln(share / (1 - share))" + "".join(f" + CASE votes[{k}] WHEN 1 THEN ln(good[{k}] / (1 - bad[{k}])) WHEN -1 THEN ln((1 - good[{k}]) / bad[{k}]) ELSE 0 END" for k, _ in rules) + ")))"

    def accuracies(kind: int, of: str, right: str) -> str:
        """How often each rule is right about documents that are of the kind with probability `of`."""
        seen = [("true" if favour is None else f"votes[{k}] <> 0") for k, (_, favour) in rules]
        return ", ".join(f"least({MOST}, greatest({LEAST[kind]}, ({WEIGHT * START[kind]} + coalesce(sum(n * {of}) FILTER ({s} AND votes[{k}] {right}), 0)) / ({WEIGHT} + coalesce(sum(n * {of}) FILTER ({s}), 0))))::DOUBLE" for (k, _), s in zip(rules, seen, strict=True))

    return rf"""
WITH RECURSIVE words AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT r, unnest(range(1, len(w) - 1)) AS i, unnest(list_transform(range(1, len(w) - 1), lambda i: array_to_string(w[i : i + 2], ' '))) AS gram FROM words),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, gram) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM again, range(3) three(k) GROUP BY r),
lines AS (SELECT r, count(*) AS n, count(DISTINCT line) AS n_distinct FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM words) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
counts AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, len(regexp_extract_all(t, '[A-Z]'))::BIGINT AS n_capitals,
  len(regexp_extract_all(t, '!'))::BIGINT AS n_marks, coalesce(lines.n, 0)::BIGINT AS n_lines, coalesce(lines.n - lines.n_distinct, 0)::BIGINT AS n_dup_lines, coalesce(covered.n, 0)::BIGINT AS n_repeat_words FROM words LEFT JOIN lines USING (r) LEFT JOIN covered USING (r)),
voted AS (SELECT *, [{votes}] AS votes FROM counts),
patterns AS MATERIALIZED (SELECT votes, count(*) AS n FROM voted GROUP BY votes),
model AS (SELECT 0 AS round, 0.8::DOUBLE AS share, [{", ".join([f"{START[0]}::DOUBLE"] * len(rules))}] AS good, [{", ".join([f"{START[1]}::DOUBLE"] * len(rules))}] AS bad
  UNION ALL SELECT round + 1, least(0.95, greatest(0.05, sum(n * p) / sum(n)))::DOUBLE, [{accuracies(0, "p", ">= 0")}], [{accuracies(1, "(1 - p)", "< 0")}] FROM (SELECT round, votes, n, {p} AS p FROM model, patterns WHERE round < 50) GROUP BY round),
judged AS (SELECT voted.*, {p} AS p, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM voted, model WHERE round = 50)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND p >= 0.5 AS kept, round(p, 6) AS posterior FROM judged"""
