"""Text functions, Column to Column unless a model or Unicode table is needed."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"

# The letters and clusters that may be prefixed to a Hebrew word, the words that are not
# split, the final letters with their plain forms, and the range of vowel and cantillation marks.
PREFIX_LETTERS = "ובלכמשה"
PREFIX_CLUSTERS = ("כשה", "ובה", "כש", "שב", "שה", "וה", "וב", "ול", "וכ", "ומ")
NOT_PREFIXED = (
    "של", "שם", "שנה", "שלום", "מה", "מי", "מים", "לא", "כל", "כי", "בן", "בת",
    "היה", "הוא", "היא", "הם", "הן", "ולא", "בית", "משה", "שלו", "שלה", "מעל",
    "בכל", "לכל", "מכל", "ועד", "מול", "לפי", "כמו", "בין", "ליד", "מאז", "שוב",
)
FINAL_LETTERS, PLAIN_LETTERS = "ךםןףץ", "כמנפצ"
MARKS = "[֑-ׇ]"
HEBREW = "^[א-ת]+$"


def tokenize(text: Column) -> Column:
    """Lower-cased runs of letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def decompose(text: Column) -> Column:
    """NFKD, which Spark has no function for."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t))

    return run(text)


def normalize(text: Column) -> Column:
    """NFKD without vowel and cantillation marks."""
    return F.regexp_replace(decompose(text), MARKS, "")


def fold_finals(word: Column) -> Column:
    return F.translate(word, FINAL_LETTERS, PLAIN_LETTERS)


def strip_prefixes(word: Column, min_stem: int = 3) -> Column:
    """array(prefix, stem), array(word) or, for the empty word, array(). Strips at most once."""
    alone = F.array(word)
    cut = lambda n: F.array(F.substring(word, 1, n), F.substring(word, n + 1, 1 << 30))
    out = F.when(word == "", F.array().cast("array<string>")).when(~word.rlike(HEBREW) | word.isin(*NOT_PREFIXED), alone)
    for cluster in PREFIX_CLUSTERS:
        out = out.when(word.startswith(cluster) & (F.length(word) >= len(cluster) + min_stem), cut(len(cluster)))
    single = F.substring(word, 1, 1).isin(*PREFIX_LETTERS) & (F.length(word) >= 1 + min_stem)
    return out.when(single, cut(1)).otherwise(alone)


def hebrew_tokens(normalized: Column, split: bool = True) -> Column:
    """Tokens of a normalised text; with split, a word that has a prefix is followed by its stem."""
    words = tokenize(normalized)
    if not split:
        return words

    def both(w: Column) -> Column:
        pieces = strip_prefixes(w)
        return F.when(F.size(pieces) > 1, F.array(w, F.element_at(pieces, -1))).otherwise(F.array(w))

    return F.flatten(F.transform(words, both))


def squeezed(text: Column) -> Column:
    """Trimmed, lower-cased, runs of white space as one space."""
    space = r"[\s\x1c-\x1f\x85\p{Z}]+"
    return F.regexp_replace(F.regexp_replace(F.lower(text), f"^{space}|{space}$", ""), space, " ")


def contains_fact(answer: Column, fact: Column) -> Column:
    return F.contains(squeezed(answer), squeezed(fact))


def fact_value(fact: Column) -> Column:
    return F.lower(F.regexp_extract(fact, r"is ([A-Za-z0-9#\-]+(?: [A-Za-z]+)?)\.", 1))


def token_cost(texts: DataFrame, text_col: str, tokens: Column, by: list[str] | None = None) -> DataFrame:
    """Characters, words, tokens and their ratios; `tokens` counts a text's tokens."""
    words = F.size(F.regexp_extract_all(F.col(text_col), F.lit(WORD), F.lit(0)))
    sums = texts.groupBy(*(by or [])).agg(F.sum(F.length(text_col)).alias("characters"), F.sum(words).alias("words"), F.sum(tokens).alias("tokens"))
    ratio = lambda a, b: F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))
    return sums.withColumns({"tokens_per_word": ratio("tokens", "words"), "characters_per_token": ratio("characters", "tokens")})


def segmentation_agreement(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Counts and disagreements between the prefix rule and recorded pieces (word, pieces)."""
    compared = pairs.withColumn("rule", strip_prefixes(F.col("word")))
    agree = F.col("rule").eqNullSafe(F.col("pieces"))
    counts = compared.agg(F.count("*").alias("total"), F.coalesce(F.sum(agree.cast("long")), F.lit(0)).alias("agree"))
    return counts.withColumn("rate", F.coalesce(F.try_divide("agree", "total"), F.lit(0.0))), compared.filter(~agree)


#: An error type with its colon, at the start of a word.
ERROR_NAME = r"\b([A-Z][A-Za-z]*(?:Error|Exception)):"


def html_errors(html: Column) -> Column:
    """Distinct sorted error names that a page shows."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(html, F.lit(ERROR_NAME), F.lit(1))))


def rtl_lines(pages: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Lines of right-to-left blocks with two flags: a left-to-right start, and a bare figure."""
    from pyspark.sql import Window

    lines = pages.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("line", "text"))
    mark = F.when(F.col("text").contains('dir="rtl"'), True).when(F.col("text").contains("</div>"), False)
    inside = F.coalesce(F.last(mark, ignorenulls=True).over(Window.partitionBy(id_col).orderBy("line")), F.lit(False))
    body = lines.withColumn("inside", inside).filter(F.col("inside") & ~F.col("text").contains("<div"))
    return body.select(id_col, "line", "text", F.col("text").rlike(r"^\s*[A-Za-z]").alias("starts_latin"), F.col("text").rlike(r"^\s*[\d.,%]+\s*$").alias("bare_figure"))


def undefined_terms(text: DataFrame, id_col: str, text_col: str, glossary: DataFrame) -> DataFrame:
    """Back-ticked terms of a text whose words, plural s dropped, aren't all in glossary(term)."""
    spans = text.select(id_col, F.explode(F.regexp_extract_all(text_col, F.lit("`([^`]+)`"), F.lit(1))).alias("term")).distinct()
    parts = spans.select(id_col, "term", F.explode(tokenize(F.col("term"))).alias("part")).withColumn("part", F.regexp_replace("part", "s$", ""))
    known = glossary.select(F.regexp_replace(F.lower("term"), "s$", "").alias("part")).distinct()
    return parts.join(known, "part", "left_anti").select(id_col, "term").distinct()
