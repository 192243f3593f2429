"""Quality classifier: histogram gradient-boosted trees over statistics of the whole text.

Labels come from rows outside the held-out fold; lang, source and doc_id are never inputs.
Defined results: a null text is empty, an empty text has all statistics 0 and gets that leaf's score; a
null doc_id is kept null, every other id to the last digit; equal texts get equal scores; texts of any
length are read whole; repeated rows are scored each; of several labels of one doc_id the largest counts;
without labels every score is 0.5; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from .boosting import train
from .common import table
from .scoring import gathered, remainder, scored, teaching_rows

FOLDS, HELD_OUT = 5, 0
NAMES = ["log_chars", "log_words", "word_length", "upper", "digit", "symbol", "punct", "bang", "stop", "comma", "distinct_words", "top_word", "repeated_next", "symbol_words", "line_words", "distinct_lines", "caps_words", "packed", "alone_bar", "longest_word"]
_UPPER, _SYMBOLS = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[#$%&*@^~<>{}\[\]\\|/=+_]")


def statistics(text: str | None) -> list[float]:
    """NAMES of a whole text, all independent of its language's words."""
    text = text or ""
    words = text.split()
    n, w = max(len(text), 1), max(len(words), 1)
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    lines = [x for x in text.split("\n") if x]
    raw = text.encode("utf-8", "surrogatepass")
    symbols = len(_SYMBOLS.findall(text))
    bang, stop = text.count("!") + text.count("?"), text.count(".")
    comma = text.count(",") + text.count(";") + text.count(":")
    return [
        np.log1p(len(text)), np.log1p(len(words)), sum(map(len, words)) / w, len(_UPPER.findall(text)) / n,
        sum(map(text.count, "0123456789")) / n, symbols / n, (symbols + bang + stop + comma) / n, bang / w, stop / w, comma / w,
        len(counts) / w, max(counts.values(), default=0) / w, sum(map(str.__eq__, words, words[1:])) / w, sum(c for x, c in counts.items() if not x[-1].isalnum()) / w,
        np.log1p(w / max(len(lines), 1)), len(set(lines)) / max(len(lines), 1), sum(c for x, c in counts.items() if len(x) > 1 and x.isupper()) / w,
        len(zlib.compress(raw, 1)) / max(len(raw), 1), counts.get("|", 0) / w, np.log1p(max(map(len, words), default=0)),
    ]


def features(texts: pd.Series) -> np.ndarray:
    return np.array([statistics(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality"):
    """The forest learned from the rows outside the held-out fold."""
    _, x, y = gathered(teaching_rows(docs, labels, label, remainder("doc_id", FOLDS) != HELD_OUT), features)
    return train(x, y)


def op2_quality(spark, sf_dir) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    forest = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, features, forest.probability, remainder("doc_id", FOLDS) == HELD_OUT)
