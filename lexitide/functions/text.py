"""Column expressions over token lists and text; all of them run in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: a word is a run of two or more letters, digits or underscores, in any script.
WORD = r"[\p{L}\p{N}_]{2,}"


def words(text: Column) -> Column:
    """Lower-cased words of a text."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def has_words(text: Column) -> Column:
    """True when `words(text)` would not be empty; stops at the first match."""
    return F.lower(text).rlike(WORD)


def folded(text: Column) -> Column:
    """Text without accents on Latin letters."""
    # fixed values: accented letters and their plain forms, position by position
    return F.translate(text, "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")


def unfold(df: DataFrame, *keep: str | Column, tokens: str | Column = "full_text", name: str = "term") -> DataFrame:
    """One row per token beside the kept columns.

    The outer form is used on purpose: for a plain explode Spark adds a filter on the array's size and
    pushes it to the scan, where it would split the text into words a second time.
    """
    return df.select(*keep, F.explode_outer(tokens).alias(name)).where(F.col(name).isNotNull())


def unfold_at(df: DataFrame, *keep: str | Column, tokens: str | Column, names: tuple[str, str]) -> DataFrame:
    """`unfold` with the position of each element."""
    return df.select(*keep, F.posexplode_outer(tokens).alias(*names)).where(F.col(names[0]).isNotNull())


def joined(tokens: Column) -> Column:
    """Tokens joined by one space (F2)."""
    return F.array_join(tokens, " ")


def year_of(raw: Column) -> Column:
    """Integer year of a raw value; anything that is no number becomes null."""
    return F.floor(raw.try_cast("double")).cast("int")


def decade(year: Column) -> Column:
    """1934 -> '1930s'; floors towards minus infinity; null stays null (P5)."""
    return F.concat((F.floor(year / F.lit(10.0)) * 10).cast("int").cast("string"), F.lit("s"))


def windows(tokens: Column, window: int, stride: int) -> Column:
    """Overlapping slices of a token list; the first slice that reaches the end is the last (F1)."""
    if window <= 0:
        raise ValueError("window must be > 0")
    if stride <= 0:
        raise ValueError("stride must be > 0")
    n = F.size(tokens)
    # a start is used if the slice before it did not reach the end
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(stride)),
        lambda s: (s == 0) | (s - stride + window < n),
    )
    slices = F.transform(starts, lambda s: F.slice(tokens, s + 1, F.lit(window)))
    return F.when(n > 0, slices).otherwise(F.array().cast("array<array<string>>"))


def ngrams(tokens: Column, low: int, high: int) -> Column:
    """All n-grams with low <= n <= high, in one array. `tokens` must be a stored column, not an expression."""
    n_tokens = F.size(tokens)
    parts = []
    for n in range(low, high + 1):
        grams = tokens
        for shift in range(1, n):
            # each pass appends the token `shift` places to the right
            width = F.greatest(n_tokens - shift, F.lit(0))
            grams = F.zip_with(
                F.slice(grams, F.lit(1), width),
                F.slice(tokens, F.lit(shift + 1), width),
                lambda left, right: F.concat_ws(" ", left, right),
            )
        parts.append(grams)
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def representation_words(rep: Column, top_n: int) -> Column:
    """Words of an imported representation string: split at commas, else at blanks.

    Brackets and quotes of a stringified list are removed first.
    """
    clean = F.regexp_replace(F.coalesce(rep, F.lit("")), r"""[\[\]'"]""", "")
    trimmed = F.transform(F.split(clean, ","), lambda x: F.regexp_replace(x, r"^\s+|\s+$", ""))
    by_comma = F.filter(trimmed, lambda x: x != "")
    by_blank = F.filter(F.split(clean, r"\s+"), lambda x: x != "")
    return F.slice(F.when(F.size(by_comma) >= 2, by_comma).otherwise(by_blank), 1, top_n)


def file_index(name: Column) -> Column:
    """All digits of a batch file name as one number, -1 without digits."""
    digits = F.regexp_replace(F.regexp_replace(name, r"\.gz$", ""), "[^0-9]", "")
    return F.coalesce(digits.try_cast("bigint"), F.lit(-1).cast("bigint"))


def no_nan(x: Column) -> Column:
    """NaN as null (F8)."""
    return F.when(~F.isnan(x), x)
