"""Text and scalar functions X1-X13 as Spark column expressions.

Rules that also feed the DuckDB oracle are written once as SQL expression
text with a ``dialect`` switch, and used in Spark through ``F.expr``.
Unicode: Java regex classes are ASCII unless ``(?U)`` is set, so every
pattern that mirrors Python's ``\\w``/``\\s`` carries it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lookup import let, look_up_all, word_table
from .stopwords import english, section_stop_words

# Fixed patterns (Python-compatible word and token classes).
WORD_RUN = r"(?U)\S+"                 # X1: whitespace-separated pieces
TOKEN_RUN = r"(?U)[\w&&[^\d]]+"       # X5: word characters without digits
NON_WORD = r"(?U)\W"                  # X7: anything but a word character
LETTER_OR_NOT = r"(\p{L}+|\P{L}+)"    # X4: runs of letters / non-letters
MIN_TOKEN, MAX_TOKEN = 2, 15          # X5: kept token lengths


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def word_count(col: str | Column) -> Column:
    """Number of whitespace-separated pieces; null stays null."""
    return F.regexp_count(_c(col), F.lit(WORD_RUN)).cast("bigint")


def char_count(col: str | Column) -> Column:
    """Number of characters (code points)."""
    return F.char_length(_c(col)).cast("bigint")


def title_case(col: str | Column) -> Column:
    """Python ``str.title``: capital after any non-letter, rest lower."""
    runs = F.regexp_extract_all(_c(col), F.lit(LETTER_OR_NOT), 1)
    return F.when(_c(col).isNotNull(), F.array_join(F.transform(runs, lambda r: F.initcap(r)), ""))


def simple_tokens(col: str | Column) -> Column:
    """Lower-case runs of word characters without digits, 2-15 long,
    not starting with an underscore."""
    toks = F.regexp_extract_all(F.lower(_c(col)), F.lit(TOKEN_RUN), 0)
    return F.filter(
        toks,
        lambda t: (F.char_length(t) >= MIN_TOKEN) & (F.char_length(t) <= MAX_TOKEN) & ~t.startswith("_"),
    )


def remove_words(tokens: str | Column, words: Iterable[str]) -> Column:
    """Drop tokens found in a (bounded) word list. ``isin`` over a long
    literal list becomes a hash-set lookup (InSet), not a linear scan."""
    ws = list(dict.fromkeys(words))
    return F.filter(_c(tokens), lambda t: ~t.isin(*ws))


def remove_stop_words(tokens: str | Column, extra: Iterable[str] = ()) -> Column:
    return remove_words(tokens, list(english()) + list(extra))


def section_clean(col: str | Column) -> Column:
    """D1 step 1: lower, tokenise, drop stop words and "news", join; empty -> null."""
    joined = F.array_join(remove_words(simple_tokens(_c(col)), section_stop_words()), " ")
    return F.when(joined != "", joined)


def singular_sql(t: str, dialect: str = "spark") -> str:
    """Suffix rules for English plurals as SQL text over token ``t``.

    ies -> y (after a consonant); sses/xes/zes/ches/shes -> drop "es";
    a final s -> dropped unless the word ends in ss, us or is.
    Only words longer than three characters are touched.
    """
    ew = "endswith" if dialect == "spark" else "ends_with"

    def e(s):
        return f"{ew}({t}, '{s}')"
    n = f"length({t})"
    return (
        f"CASE WHEN {n} > 4 AND {e('ies')} AND substr({t}, {n} - 3, 1) NOT IN ('a','e','i','o','u') "
        f"THEN concat(substr({t}, 1, {n} - 3), 'y') "
        f"WHEN {n} > 4 AND ({e('sses')} OR {e('xes')} OR {e('zes')} OR {e('ches')} OR {e('shes')}) "
        f"THEN substr({t}, 1, {n} - 2) "
        f"WHEN {n} > 3 AND {e('s')} AND NOT ({e('ss')} OR {e('us')} OR {e('is')}) "
        f"THEN substr({t}, 1, {n} - 1) "
        f"ELSE {t} END"
    )


def singularize(col: str | Column) -> Column:
    """X8 on one word (column of strings)."""
    return _singular_col(_c(col))


def _singular_col(c: Column) -> Column:
    n = F.char_length(c)
    return (
        F.when((n > 4) & c.endswith("ies") & ~F.substring(c, -4, 1).isin("a", "e", "i", "o", "u"),
               F.concat(c.substr(F.lit(1), n - 3), F.lit("y")))
        .when((n > 4) & (c.endswith("sses") | c.endswith("xes") | c.endswith("zes")
                         | c.endswith("ches") | c.endswith("shes")), c.substr(F.lit(1), n - 2))
        .when((n > 3) & c.endswith("s") & ~F.substring(c, -2, 2).isin("ss", "us", "is"),
              c.substr(F.lit(1), n - 1))
        .otherwise(c)
    )


def singularize_tokens(tokens: str | Column) -> Column:
    return F.transform(_c(tokens), _singular_col)


def lemmatize(df: DataFrame, tokens: Column, lemmas: DataFrame, out: str) -> DataFrame:
    """X8 by a ``(form, lemma)`` table: ``df`` with the tokens' lemmas as the
    array ``out``; a token without a lemma stays. Looked up inside the row."""
    found = let(tokens, lambda ts: F.transform(
        F.arrays_zip(ts.alias("t"), look_up_all(F.col("_lemmas"), ts).alias("l")), lambda x: F.coalesce(x["l"], x["t"])))
    return df.withColumn("_lemmas", word_table(lemmas, "form", "lemma")).withColumn(out, found).drop("_lemmas")


def split_pieces(col: str | Column) -> Column:
    """Split on whitespace and hyphens, empty pieces dropped."""
    return F.filter(F.split(_c(col), r"(?U)[\s-]+"), lambda p: p != "")


def clean_text(col: str | Column, stop_words: Iterable[str] | None = None) -> Column:
    """Lower -> non-word to space -> split on spaces -> stop words out ->
    singularise -> join with single spaces."""
    sw = list(stop_words) if stop_words is not None else list(section_stop_words())
    spaced = F.regexp_replace(F.lower(_c(col)), NON_WORD, " ")
    toks = F.filter(F.split(F.trim(spaced), r"\s+"), lambda t: t != "")
    return F.array_join(singularize_tokens(remove_words(toks, sw)), " ")


def round_half_even(col: str | Column, digits: int) -> Column:
    """Numpy-style rounding (half to even)."""
    return F.bround(_c(col), digits)


def non_empty(col: str | Column) -> Column:
    """True when a list cell has at least one element (null -> False)."""
    return F.size(F.coalesce(_c(col), F.array())) > 0


def date_parts(col: str | Column = "date") -> list[Column]:
    """X11: year, month, day as bigint."""
    c = _c(col)
    return [F.year(c).cast("bigint").alias("year"), F.month(c).cast("bigint").alias("month"),
            F.dayofmonth(c).cast("bigint").alias("day")]
