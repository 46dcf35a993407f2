"""DuckDB SQL snippets mirroring the Spark expressions, for oracle text."""

from __future__ import annotations

from ..functions.stopwords import english, section_stop_words
from ..functions.text import singular_sql
from ..operators.clean import GENERIC_SECTIONS


def lit_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def title_case(e: str) -> str:
    return (f"CASE WHEN {e} IS NOT NULL THEN array_to_string(list_transform("
            f"regexp_extract_all({e}, '(\\p{{L}}+|\\P{{L}}+)'), lambda x: upper(x[1]) || lower(x[2:])), '') END")


def tokens(e: str) -> str:
    return (f"list_filter(regexp_extract_all(lower({e}), '[\\p{{L}}\\p{{M}}_]+'), "
            f"lambda t: length(t) BETWEEN 2 AND 15 AND NOT starts_with(t, '_'))")


def drop_words(list_expr: str, words) -> str:
    return f"list_filter({list_expr}, lambda t: NOT list_contains({lit_list(words)}, t))"


def section_clean(e: str) -> str:
    return f"nullif(array_to_string({drop_words(tokens(e), section_stop_words())}, ' '), '')"


def singular_list(list_expr: str) -> str:
    return f"list_transform({list_expr}, lambda w: {singular_sql('w', 'duckdb')})"


def word_count(e: str) -> str:
    return f"CAST(len(regexp_extract_all({e}, '[^\\s\\p{{Z}}]+')) AS BIGINT)"


def stop_words_english() -> str:
    return lit_list(english())


def clean_sections_cte(src: str = "articles", name: str = "cleaned", case_first: bool = True,
                       generic: bool = True) -> str:
    """N12 as CTEs over ``src``; defines ``{name}`` with the same columns."""
    s1 = f"{name}_a"
    tc = title_case("section") if case_first else "section"
    step1 = (f"{s1} AS (SELECT * REPLACE (CASE WHEN lower({tc}) LIKE 'opinion%' THEN 'Opinion' ELSE {tc} END "
             f"AS section) FROM {src} WHERE section IS NOT NULL)")
    s2 = f"{name}_b"
    step2 = (f"{s2} AS (SELECT *, count(*) OVER (PARTITION BY year, section) AS _n_by, "
             f"count(*) OVER (PARTITION BY section) AS _n_all FROM {s1})")
    fin = title_case("section") if not case_first else "section"
    gen = f" AND section NOT IN ({', '.join(repr(g) for g in GENERIC_SECTIONS)})" if generic else ""
    step3 = (f"{name} AS (SELECT * EXCLUDE (_n_by, _n_all) REPLACE ({fin} AS section) FROM {s2} "
             f"WHERE NOT (_n_all = 1 OR (year IS NOT NULL AND _n_by = 1)){gen})")
    return ",\n".join([step1, step2, step3])


def text_null_fix(cols) -> str:
    return ", ".join(f"CASE WHEN lower({c}) IN ('nan', 'none') THEN NULL ELSE {c} END AS {c}" for c in cols)


ARTICLE_STRING_COLS = ("author", "title", "article", "url", "section", "publication", "simple_topic")


def normalised_articles_cte(name: str = "narticles", src: str = "articles") -> str:
    """N1 + N2 over the string columns of the articles view."""
    cols = ", ".join(
        f"nullif(CASE WHEN lower({c}) IN ('nan', 'none') THEN NULL ELSE {c} END, '') AS {c}"
        for c in ARTICLE_STRING_COLS)
    return f"{name} AS (SELECT * REPLACE ({cols}) FROM {src})"
