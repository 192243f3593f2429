"""Toxicity: gradient-boosted trees over dense features, calibrated by isotonic regression.

Features of the whole text: densities of a lexicon, nearness of its entries to a second person,
capitals, punctuation and obfuscation (characters standing in for letters). The lexicon joins a
general list of insults with what the teaching rows show: words, and word beginnings of 4 to 6 letters
(insults are inflected), that are frequent in toxic and rare in clean rows. The trees see each half of
the teaching rows under a lexicon learned from the other half, and the calibration uses rows that the
trees don't, so that none flatters the next; scoring uses the lexicon of both halves.

Labels come from rows outside the held-out fold; lang, source and doc_id are never inputs.
Defined results: a null text is empty, an empty text has all features 0; a null doc_id is scored like any
other and kept null, every other id is kept to the last digit; equal texts get equal scores; texts of any
length are read whole; repeated rows are scored each; of several labels of one doc_id the largest counts;
without labels every score is the same; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .boosting import Forest, isotonic, train
from .common import durable, table
from .scoring import PREDICTED_FROM, gathered, remainder, scored, teaching_rows

FOLDS, HELD_OUT = 4, 2
#: Of the learned lexicon, by strength; it bounds what is broadcast. The test tables yield 58 to some hundred terms, so nothing is cut there.
LEXICON_MOST = 1000
LEAST_ODDS, SHARE = 2.5, 0.01
NEAR = 5
INSULTS = frozenset("idiot moron stupid dumb loser pathetic worthless trash scum garbage disgusting clown fool imbecile cretin jerk bastard filthy vermin idiota imbécil estúpido basura asqueroso idiote stupide imbécile ordure crétin dumm dummkopf trottel abschaum arschloch widerlich".split())
SECOND_PERSON = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr euch tú ti usted ustedes vosotros tuyo".split())
_WORDS = re.compile(r"[^\W\d_]+")
_STANDINS = frozenset("013457@$!*")
_PLAIN = str.maketrans("013457@$!*", "oieastasi ")
TOKENS_KEPT = 300_000
NAMES = ["insults", "log_insults", "learned", "log_learned", "learned_kinds", "any_share", "masked", "masked_hits", "near_person", "person", "caps", "caps_hits", "bang", "punct", "symbols", "log_words"]


def _beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in (4, 5, 6) if len(word) > k]


def terms(text: str | None) -> set[str]:
    """What of a text may enter the lexicon: its words and word beginnings, lower-cased."""
    words = set(_WORDS.findall((text or "").lower()))
    found = set(words)
    for k in (4, 5, 6):
        found.update([w[:k] + "*" for w in words if len(w) > k])
    return found


def learned_lexicons(sample: DataFrame) -> list[dict[str, float]]:
    """Terms that tell toxic rows from clean ones, with their log odds: from the rows of part 0, of part 1 and of both.

    A term is in at least SHARE of the toxic rows (and 3 of them), so the copies of one text don't make one.
    """

    def run(batches):
        for pdf in batches:
            tally: dict[str, list[int]] = {}
            for text, y, part in zip(pdf["text"], pdf["y"], pdf["part"]):
                for term in terms(text):
                    tally.setdefault(term, [0, 0, 0, 0])[2 * part + y] += 1
            yield pd.DataFrame([[t, *v] for t, v in tally.items()], columns=["term", "c0", "t0", "c1", "t1"])

    n = {(r["part"], r["y"]): r["count"] for r in sample.groupBy("part", "y").count().collect()}
    sums = sample.select("text", "y", "part").mapInPandas(run, "term string, c0 long, t0 long, c1 long, t1 long").groupBy("term").agg(*[F.sum(c).alias(c) for c in ("c0", "t0", "c1", "t1")])
    sums = durable(sums.filter("t0 + t1 >= 3"))
    found = []
    for parts in ((0,), (1,), (0, 1)):
        clean, toxic = (sum((F.col(f"{c}{p}") for p in parts), F.lit(0)) for c in "ct")
        n_clean, n_toxic = (sum(n.get((p, y), 0) for p in parts) for y in (0, 1))
        odds = F.log((toxic + 0.5) / (n_toxic + 1.0)) - F.log((clean + 0.5) / (n_clean + 1.0))
        rows = sums.withColumns({"odds": odds, "toxic": toxic}).filter((F.col("odds") > LEAST_ODDS) & (F.col("toxic") >= max(3, SHARE * n_toxic)))
        best = rows.orderBy(F.desc(F.col("odds") * F.sqrt("toxic")), "term").limit(LEXICON_MOST)
        found.append({r.term: float(r.odds) for r in best.select("term", "odds").collect()})
    return found


class Features:
    """NAMES of a whole text under a lexicon. What a token contributes is worked out once and remembered."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon = lexicon
        self._clear()

    def _clear(self):
        self.number: dict[str, int] = {}
        self.facts = np.zeros((1 << 12, 7))  # words, weight, insult, second person, masked, masked hit, shouted

    def weight(self, word: str) -> float:
        return max([self.lexicon.get(word, 0.0), *(self.lexicon.get(b, 0.0) for b in _beginnings(word))])

    def _learn(self, token: str):
        lower = token.lower()
        words = _WORDS.findall(lower)
        core = lower.strip(".,;:!?\"'()")
        masked = len(core) > 2 and any(map(str.isalpha, core)) and not _STANDINS.isdisjoint(core)
        plain = core.translate(_PLAIN).strip() if masked else ""
        shouted = len(core) > 2 and token.isupper()
        k = len(self.number)
        if k == len(self.facts):
            self.facts = np.concatenate([self.facts, np.zeros_like(self.facts)])
        self.facts[k] = len(words), max(map(self.weight, words), default=0.0), any(w in INSULTS for w in words), any(w in SECOND_PERSON for w in words), masked, masked and (plain in INSULTS or self.weight(plain) > 0), shouted
        self.number[token] = k

    def of(self, text: str | None) -> list[float]:
        text = text or ""
        tokens = text.split()
        fresh = set(tokens).difference(self.number)
        if len(self.number) + len(fresh) > TOKENS_KEPT:
            self._clear()
            fresh = set(tokens)
        for token in fresh:
            self._learn(token)
        ids = np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))
        facts = self.facts[ids]
        words, weights, insults, persons, masked, masked_hits, shouted = facts.T
        n, w = max(len(text), 1), max(words.sum(), 1.0)
        hit = (weights > 0) | (insults > 0)
        hits, person = np.flatnonzero(hit), np.flatnonzero(persons)
        near = (np.searchsorted(person, hits - NEAR) < np.searchsorted(person, hits + NEAR + 1)).sum() if len(hits) and len(person) else 0
        bang = text.count("!") + text.count("?")
        punct = bang + text.count(".") + text.count(",")
        symbols = sum(map(text.count, "#$%&*@"))
        return [
            insults.sum() / w, np.log1p(insults.sum()), weights.sum() / w, np.log1p((weights > 0).sum()), np.log1p(len(np.unique(ids[hits]))), len(hits) / w, masked.sum() / w, masked_hits.sum(),
            near / w, len(person) / w, shouted.sum() / w, (shouted * hit).sum(), bang / w, punct / n, symbols / n, np.log1p(words.sum()),
        ]

    def __call__(self, texts: pd.Series) -> np.ndarray:
        return np.array([self.of(t) for t in texts], dtype=float).reshape(len(texts), len(NAMES))

    def __getstate__(self):
        return {"lexicon": self.lexicon}

    def __setstate__(self, state):
        self.__init__(state["lexicon"])


@dataclass
class Model:
    features: Features
    forest: Forest
    knots: tuple[np.ndarray, np.ndarray]

    def probability(self, x: np.ndarray) -> np.ndarray:
        """The calibrated value; the trees' own where too few rows are left to calibrate on."""
        margin = self.forest.margin(x)
        if not len(self.knots[0]):
            return 1.0 / (1.0 + np.exp(-np.clip(margin, -30, 30)))
        return np.clip(np.interp(margin, *self.knots), 0.0, 1.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> Model:
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(2)).cast("int")
    sample = durable(teaching_rows(docs, labels, label, remainder("doc_id", FOLDS) != HELD_OUT).withColumn("part", part))
    first, second, both = map(Features, learned_lexicons(sample))
    pieces = [gathered(sample.filter(f"part = {k}"), features) for k, features in ((0, second), (1, first))]
    ids, x, y = (np.concatenate(p) for p in zip(*pieces))
    third = np.array([zlib.crc32(f"calibrate{i}".encode()) % 3 == 0 for i in ids], bool)
    forest = train(x[~third], y[~third]) if len(x) else train(x, y)
    calibrated = isotonic(forest.margin(x[third]), y[third]) if third.sum() >= 50 and 0 < y[third].sum() < third.sum() else (np.zeros(0), np.zeros(0))
    return Model(both, forest, calibrated)


def scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    model = fit(docs, labels)
    return scored(docs, model.features, model.probability, remainder("doc_id", FOLDS) == HELD_OUT)


def clean(docs: DataFrame, labels: DataFrame, text_col: str = "text") -> DataFrame:
    """The documents that are not rejected, with all their columns, in one narrow pass."""
    model = fit(docs, labels)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.probability(model.features(texts)))

    return docs.filter(score(F.col(text_col)) < PREDICTED_FROM)


def op4_toxicity(spark, sf_dir) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
