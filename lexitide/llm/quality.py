"""Document quality by weak supervision: rules vote or abstain, and a latent-class model weighs their votes.

Each rule looks at one property of a text and votes to keep (1), to reject (-1) or abstains (0). Expectation-maximisation
estimates, without labels, how often good and bad documents get each vote of each rule and how common good documents
are; the posterior probability of being good replaces the demand that every rule pass. All properties are column
expressions within the document's row; the model sees only the table of distinct vote patterns, at most three to the
power of the number of rules, so its fit is the same work for any corpus.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexitide.llm.common import WORD, let, stored

# (rule, measure, reject when, keep when); the measures are columns of `measured`.
RULES: list[tuple[str, str, str]] = [
    ("length", "n_words < 20", "n_words >= 40"),
    ("symbols", "n_symbols > 0.10 * n_words", "n_symbols <= 0.02 * n_words"),
    ("duplicate_lines", "n_dup_lines > 0.30 * n_lines", "n_dup_lines <= 0.10 * n_lines"),
    ("repetition", "n_repeat_words > 0.30 * n_words", "n_repeat_words <= 0.10 * n_words"),
    ("word_length", "word_chars < 2.5 * n_words OR word_chars > 12 * n_words", "word_chars >= 3 * n_words AND word_chars <= 10 * n_words"),
    ("upper_case", "n_upper > 0.5 * n_letters", "n_upper <= 0.2 * n_letters"),
    ("letters", "n_letters < 0.7 * word_chars", "n_letters >= 0.9 * word_chars"),
    ("bare_words", "n_bare_words > 0.20 * n_words", "n_bare_words <= 0.05 * n_words"),
]
MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "n_letters", "n_upper", "n_bare_words"]
ROUNDS = 200


def _repeated_words(words: Column, width: int = 8) -> Column:
    """Words inside windows of `width` words that occur at least twice in the array."""
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(F.sequence(F.lit(1), F.size(h) - width + 1), lambda i: F.xxhash64(F.slice(h, i, width))))

    def covered(found: Column) -> Column:
        ordered = F.sort_array(F.transform(found, lambda x, i: F.struct(x.alias("x"), i.alias("i"))))
        twice = let(
            ordered,
            lambda s: F.transform(s, lambda e, k: F.when((F.get(s, k - 1)["x"] == e["x"]) | (F.get(s, k + 1)["x"] == e["x"]), e["i"])),
        )
        starts = F.sort_array(F.array_compact(twice))
        # each window adds the words that the one before it doesn't cover
        zero = F.struct(F.lit(0).alias("n"), F.lit(-width).alias("last"))
        total = F.aggregate(starts, zero, lambda a, i: F.struct((a["n"] + F.least(F.lit(width), i - a["last"])).alias("n"), i.alias("last")))
        return total["n"]

    several = let(windows, lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), 0).otherwise(covered(w)))
    return F.when(F.size(words) > width, several).otherwise(0)


def measure(docs: DataFrame) -> DataFrame:
    """`docs` with the columns of `MEASURES`; a null text has no words."""
    docs = docs.drop(*MEASURES, "measures")
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    of_words = let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), lambda w: F.struct(F.size(w).alias("n"), _repeated_words(w).alias("r")))
    of_lines = let(lines, lambda x: F.struct(F.size(x).alias("n"), (F.size(x) - F.size(F.array_distinct(x))).alias("d")))
    with_arrays = docs.withColumn("measures", F.struct(of_words.alias("w"), of_lines.alias("l")))
    values = {
        "n_words": F.col("measures.w.n"),
        "word_chars": F.length(text) - F.regexp_count(text, F.lit(r"[\x20\x09-\x0D]")),
        "n_symbols": F.regexp_count(text, F.lit(r"[#*$%&|<>]")),
        "n_lines": F.col("measures.l.n"),
        "n_dup_lines": F.col("measures.l.d"),
        "n_repeat_words": F.col("measures.w.r"),
        "n_letters": F.regexp_count(text, F.lit(r"\p{L}")),
        "n_bare_words": F.regexp_count(text, F.lit(r"(?<![^\x20\x09-\x0D])[^\p{L}\x20\x09-\x0D]++(?![^\x20\x09-\x0D])")),
        "n_upper": F.regexp_count(text, F.lit(r"\p{Lu}")),
    }
    return with_arrays.withColumns({k: v.cast("long") for k, v in values.items()}).drop("measures")


def votes() -> Column:
    """All rules' votes as one array of -1, 0 and 1."""
    return F.array(*[F.when(F.expr(reject), -1).when(F.expr(keep), 1).otherwise(0) for _, reject, keep in RULES])


def fit(patterns: list[tuple[tuple[int, ...], int]], rounds: int = ROUNDS) -> tuple[float, list[dict[int, tuple[float, float]]]]:
    """Prior of good, and per rule the probability of each vote among good and bad documents, from counted patterns.

    Starts from "bad if any rule rejects". A rejection never becomes a sign of quality: its share among good documents is
    held at or below that among bad ones. One pseudo-document per vote keeps unseen votes possible.
    """
    patterns = sorted(patterns)
    total = sum(n for _, n in patterns)
    good = [0.05 if -1 in p else 0.95 for p, _ in patterns]
    prior, rates = 0.5, []
    for _ in range(rounds):
        weight = sum(n * g for (_, n), g in zip(patterns, good, strict=True))
        prior = (weight + 1) / (total + 2)
        rates = []
        for r in range(len(RULES)):
            table = {}
            for v in (-1, 0, 1):
                a = sum(n * g for (p, n), g in zip(patterns, good, strict=True) if p[r] == v)
                b = sum(n * (1 - g) for (p, n), g in zip(patterns, good, strict=True) if p[r] == v)
                table[v] = ((a + 1) / (weight + 3), (b + 1) / (total - weight + 3))
            if table[-1][0] > table[-1][1]:
                same = (table[-1][0] + table[-1][1]) / 2
                table[-1] = (same, same)
            rates.append(table)
        new = [posterior(p, prior, rates) for p, _ in patterns]
        moved = max((abs(x - y) for x, y in zip(new, good, strict=True)), default=0.0)
        good = new
        if moved < 1e-9:
            break
    return prior, rates


def posterior(pattern, prior: float, rates: list[dict[int, tuple[float, float]]]) -> float:
    odds = math.log(prior) - math.log1p(-prior) + sum(math.log(t[v][0]) - math.log(t[v][1]) for v, t in zip(pattern, rates, strict=True))
    return 1 / (1 + math.exp(-max(-700.0, min(700.0, odds))))


def judge_measured(measured: DataFrame) -> DataFrame:
    """Measured rows with `base_failed`, `quality` (posterior probability) and `kept`."""
    voted = measured.withColumn("votes", votes())
    counted = [(tuple(r["votes"]), r["count"]) for r in voted.groupBy("votes").count().collect()]  # at most 3 ** len(RULES)
    prior, rates = fit(counted)
    odds = F.lit(math.log(prior) - math.log1p(-prior)) if counted else F.lit(0.0)
    for r, rule in enumerate(rates):
        vote = F.element_at("votes", r + 1)
        odds = odds + F.when(vote == -1, math.log(rule[-1][0] / rule[-1][1])).when(vote == 0, math.log(rule[0][0] / rule[0][1])).otherwise(math.log(rule[1][0] / rule[1][1]))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    judged = voted.withColumn("base_failed", failed).withColumn("quality", 1 / (1 + F.exp(-odds)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5)).drop("votes")


def judge(docs: DataFrame) -> DataFrame:
    """`docs` with the measures, `base_failed`, `quality` and `kept`.

    A document is kept if the base rules pass (20 words or more; repeated 8-word windows cover at most 30 % of the words)
    and it is more likely good than bad. Null and empty texts have no words and fail. Rows that repeat get the same
    verdict. Columns of `docs` with the added names are replaced; an empty table gives an empty result.
    """
    return judge_measured(stored(measure(docs.drop("base_failed", "quality", "kept", "votes")), "measured"))
