"""Quality rules under weak supervision.

Each rule looks at counts of the whole text and votes good (1), bad (-1) or abstains (0). How far a vote can be
trusted is not set by hand: expectation-maximisation over the vote patterns of all documents estimates, for each
rule, the chance of each vote among good and among bad documents, and the share of good documents. A document's
verdict is its posterior probability of being good; no single rule rejects by itself.

Defined results: a null or empty text has no words, fails the base rules and is not kept; a null id or repeated row
is judged like any other row; an empty table gives an empty table; extra columns pass through.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import barrier, cut, let, words

SYMBOLS = r"[#*$%&|<>]"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_letters", "n_marks"]
MIN_WORDS = 50
EM_ROUNDS = 40


def _repeat_words(w: Column) -> Column:
    """Words that lie in a three-word window found at least twice."""
    n = F.size(w)
    hashes = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), F.greatest(n - 3, F.lit(0))), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))))

    def covered(hs: Column) -> Column:
        ordered = F.sort_array(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        found = let(ordered, lambda s: F.filter(s, lambda x, k: (F.get(s, k - 1)["h"].eqNullSafe(x["h"])) | (F.get(s, k + 1)["h"].eqNullSafe(x["h"]))))
        return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    return let(hashes, lambda hs: F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(covered(hs)))


def with_counts(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds the struct column `counts` (longs named in COUNTS) to every row."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    without = lambda pattern: F.length(F.regexp_replace(text, pattern, ""))
    both = let(words(F.col(text_col)), lambda w: F.struct(F.size(w).alias("n"), _repeat_words(w).alias("r")))
    uniq = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    df = barrier(docs, _w=both, _l=uniq, _size=F.length(text), _solid=without(r"[\x20\x09-\x0D]+"), _sym=F.regexp_count(text, F.lit(SYMBOLS)), _up=F.regexp_count(text, F.lit(r"\p{Lu}")), _let=F.regexp_count(text, F.lit(r"\p{L}")), _mark=F.regexp_count(text, F.lit(r"[!?]")))
    values = {"n_words": F.col("_w.n"), "word_chars": F.col("_solid"), "n_symbols": F.col("_sym"), "n_dup_lines": F.col("_l.d"), "n_repeat_words": F.col("_w.r"), "n_lines": F.col("_l.n"), "n_upper": F.col("_up"), "n_letters": F.col("_let"), "n_marks": F.col("_mark")}
    return df.withColumn("counts", F.struct(*[values[k].cast("long").alias(k) for k in COUNTS])).drop("_w", "_l", "_size", "_solid", "_sym", "_up", "_let", "_mark")


def base_failed(c: Column) -> Column:
    return (c["n_words"] < MIN_WORDS) | (100 * c["n_repeat_words"] > 50 * c["n_words"])


def votes(c: Column) -> list[Column]:
    """One column in (-1, 0, 1) for each rule: good below the first bound, bad above the second, else no vote."""

    def share(part: Column, whole: Column, good: float, bad: float) -> Column:
        return F.when(part > bad * whole, F.lit(-1)).when(part <= good * whole, F.lit(1)).otherwise(F.lit(0))

    n, chars = c["n_words"], c["word_chars"]
    return [
        F.when((chars > 16 * n) | (chars < 2 * n), F.lit(-1)).when((chars >= 3 * n) & (chars <= 11 * n), F.lit(1)).otherwise(F.lit(0)),
        share(c["n_symbols"], n, 0.02, 0.1),
        share(c["n_dup_lines"], c["n_lines"], 0.15, 0.4),
        share(c["n_repeat_words"], n, 0.2, 0.4),
        share(c["n_upper"], c["n_letters"], 0.15, 0.4),
        share(c["n_marks"], n, 0.05, 0.25),
        share(chars - c["n_letters"], chars, 0.2, 0.45),
        F.when(n >= 2 * MIN_WORDS, F.lit(1)).otherwise(F.lit(0)),
    ]


def pattern(c: Column) -> Column:
    """The votes as one number, three values a rule: at most 3**8 patterns exist."""
    total = F.lit(0)
    for v in votes(c):
        total = total * 3 + (v + 1)
    return total.cast("int")


def estimate(counted: list[tuple[int, int]], rules: int, rounds: int = EM_ROUNDS) -> dict:
    """EM over (pattern, documents) pairs. Returns {"prior": log odds of good, "weights": rule -> [log ratio of each vote]}.

    Chances are those of a vote given that the rule votes: abstaining is no evidence and has the weight 0.
    Starts from "bad if any rule says so"; each chance is smoothed by one imagined document, so no weight is infinite.
    """
    rows = []
    for code, n in sorted(counted):
        v = []
        for _ in range(rules):
            code, x = divmod(code, 3)
            v.append(x)
        rows.append((v[::-1], n))
    good = [0.05 if 0 in v else 0.95 for v, _ in rows]
    prior, weights = 0.0, [[0.0] * 3 for _ in range(rules)]
    for _ in range(rounds):
        mass = [1.0 + sum(n * (1 - g) for (_, n), g in zip(rows, good)), 1.0 + sum(n * g for (_, n), g in zip(rows, good))]
        prior = math.log(mass[1] / mass[0])
        for j in range(rules):
            seen = [[0.5, 0.0, 0.5], [0.5, 0.0, 0.5]]
            for (v, n), g in zip(rows, good):
                seen[0][v[j]] += n * (1 - g)
                seen[1][v[j]] += n * g
            voted = [bad_or_good[0] + bad_or_good[2] for bad_or_good in seen]
            weights[j] = [0.0 if x == 1 else math.log(seen[1][x] / voted[1]) - math.log(seen[0][x] / voted[0]) for x in range(3)]
        good = [1 / (1 + math.exp(-max(-50.0, min(50.0, prior + sum(weights[j][x] for j, x in enumerate(v)))))) for v, _ in rows]
    return {"prior": prior, "weights": weights}


def fit(counts: DataFrame) -> dict:
    """The model from the vote patterns of all documents that pass the base rules; only pattern totals reach the driver."""
    c = F.col("counts")
    found = counts.where(~base_failed(c)).groupBy(pattern(c).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    return estimate([(r["p"], r["n"]) for r in found], len(votes(c)))


def posterior(c: Column, model: dict) -> Column:
    odds = F.lit(float(model["prior"]))
    for v, w in zip(votes(c), model["weights"]):
        odds = odds + F.element_at(F.array(*[F.lit(float(x)) for x in w]), v + 2)
    return 1 / (1 + F.exp(-odds))


def judge(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with counts, base_failed, p_good and kept. Two passes over the text, no shuffle of it."""
    counted = with_counts(docs, text_col)
    model = fit(with_counts(docs.select(text_col), text_col))
    return _judged(counted, model)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs` that are kept, with all their columns, whatever they are called."""
    judged = judge(docs.select(F.col(text_col).alias("text"), F.struct("*").alias("_doc")))
    return judged.where("kept").select("_doc.*")


def _judged(counted: DataFrame, model: dict) -> DataFrame:
    c = F.col("counts")
    return counted.withColumn("base_failed", base_failed(c)).withColumn("p_good", posterior(c, model)).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= 0.5))


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document without its text: the counts are computed once and kept in the shared folder."""
    counted = cut(with_counts(docs.select(id_col, text_col), text_col).select(id_col, "counts"))
    return _judged(counted, fit(counted)).select(id_col, "counts.*", "base_failed", "p_good", "kept")
