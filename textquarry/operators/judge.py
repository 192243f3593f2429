"""Judge replies: prompts, parsing, agreement. An unclear reply is null: left out and counted."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import contains_fact
from . import replay

# The prompts, byte for byte, since recorded replies are found by their hash.
BINARY_PROMPT = """You are checking one specific fact. Answer with a single word, yes or no.

Question asked: {question}
Answer given: {answer}

Does the answer state that {criterion}? Answer yes or no."""
HOLISTIC_PROMPT = """Rate this reply from 1 to 5, where 5 is an excellent, helpful reply.

Question asked: {question}
Reply: {answer}

Answer with the number only."""

_EDGE = r"[^\p{L}\p{N}_]"


def filled(prompt: str, **columns: Column) -> Column:
    """A prompt with its {names} replaced by columns, as one concat."""
    parts: list[Column] = []
    rest = prompt
    while rest:
        text, brace, after = rest.partition("{")
        if text:
            parts.append(F.lit(text))
        if not brace:
            break
        name, _, rest = after.partition("}")
        parts.append(columns[name])
    return F.concat(*parts)


def _first(text: Column, words: str) -> Column:
    """Where the first of the words begins, or null."""
    before = F.regexp_extract(F.lower(text), rf"(?s)^(.*?)(?:(?<={_EDGE})|^)(?:{words})(?={_EDGE}|$)", 1)
    return F.when(F.lower(text).rlike(rf"(^|{_EDGE})({words})({_EDGE}|$)"), F.length(before))


def read_yes_no(text: Column) -> Column:
    """True or false by whichever of yes/true/כן and no/false/לא comes first; null if neither."""
    yes, no = _first(text, "yes|true|כן"), _first(text, "no|false|לא")
    return F.when(yes.isNotNull() & no.isNotNull(), yes < no).when(yes.isNotNull(), True).when(no.isNotNull(), False)


def read_score(text: Column) -> Column:
    """The first 1 to 5 that stands alone; null if none does."""
    digit = F.regexp_extract(text, rf"(?:^|{_EDGE})([1-5])(?={_EDGE}|$)", 1)
    return F.when(digit != "", digit).cast("int")


def build_cases(raw: DataFrame) -> DataFrame:
    """(question, fact, criterion, kept, lost) to a row per variant with its answer and whether it holds the fact."""
    variants = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(v).alias("answer")) for v in ("kept", "lost")]))
    rows = raw.select("question", "fact", "criterion", variants.alias("v")).select("question", "fact", "criterion", "v.variant", "v.answer")
    return rows.withColumn("truth", contains_fact(F.col("answer"), F.col("fact")))


def prompts(cases: DataFrame) -> DataFrame:
    c = {n: F.col(n) for n in ("question", "answer", "criterion")}
    return cases.withColumns({"holistic_prompt": filled(HOLISTIC_PROMPT, **c), "binary_prompt": filled(BINARY_PROMPT, **c)})


def asked(cases: DataFrame, prompt: str, model: Column, max_tokens: Column, seed: Column, temperature: Column) -> DataFrame:
    """Cases with the request's key, under which a reply is recorded."""
    return cases.withColumn("key", replay.key_of(replay.canonical_request(model, F.col(prompt), max_tokens, seed, temperature)))


def judged_by(cases: DataFrame, store: DataFrame, read) -> DataFrame:
    """Cases (key, ...) with the recorded reply `raw` and what `read` makes of it as `verdict`; a request that was never recorded is an error."""
    return replay.replay(cases, store).withColumn("verdict", read(F.col("raw")))


def paired(judgements: DataFrame, truth: DataFrame, on: str) -> DataFrame:
    """Each judgement with its truth; one without the other, or a second one of the same id, is an error."""
    once = lambda df, name: df.withColumn(name, F.lit(1))
    both = once(judgements, "_j").join(once(truth, "_t"), on, "full")
    alone = F.concat(F.lit("judgements and truth differ at "), F.col(on).cast("string"))
    sizes = both.groupBy(on).agg(F.count("*").alias("_n"), F.count("_j").alias("_js"), F.count("_t").alias("_ts"))
    wrong = sizes.filter("_n <> 1 OR _js <> 1 OR _ts <> 1").select(F.col(on), F.lit(True).alias("_wrong"))
    checked = both.join(wrong, on, "left")
    return checked.filter(F.when(F.col("_wrong"), F.raise_error(alone).cast("boolean")).otherwise(True)).drop("_j", "_t", "_wrong")


def agreement(judged: DataFrame, verdict: str = "verdict", truth: str = "truth") -> DataFrame:
    """One row: decided and undecided, accuracy, share of yes, false-positive and false-negative rates."""
    v, t = F.col(verdict), F.col(truth)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    decided, share = v.isNotNull(), lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    return judged.agg(
        n(decided).alias("n"), n(~decided).alias("undecided"), share(n(decided & (v == t)), n(decided)).alias("accuracy"), share(n(v), n(decided)).alias("said_yes"),
        share(n(v & ~t), n(decided & ~t)).alias("false_positive"), share(n(decided & ~v & t), n(decided & t)).alias("false_negative"),
    )


def holistic_summary(judged: DataFrame, score: str = "score", truth: str = "truth", good_from: int = 4) -> DataFrame:
    s, lost = F.col(score), ~F.col(truth)
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    share = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    return judged.filter(s.isNotNull()).agg(F.count("*").alias("n"), share(n(s >= good_from), F.count("*")).alias("called_good"), share(n(lost & (s >= good_from)), n(lost)).alias("called_good_when_fact_lost"), F.coalesce(F.round(F.avg(s), 6), F.lit(0.0)).alias("mean"))


def pair_separation(judged: DataFrame, by: str = "question") -> DataFrame:
    """Pairs that each judge tells apart: the kept answer scores above the lost one; kept is yes and lost isn't."""
    pick = lambda c, v: F.max(F.when(F.col("variant") == v, F.col(c)))
    pairs = judged.groupBy(by).agg(pick("score", "kept").alias("ks"), pick("score", "lost").alias("ls"), pick("verdict", "kept").alias("kv"), pick("verdict", "lost").alias("lv"))
    n = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    return pairs.agg(F.count("*").alias("pairs"), n(F.col("ks") > F.col("ls")).alias("holistic"), n(F.col("kv") & ~F.coalesce("lv", F.lit(False))).alias("binary"))


def mean_by_truth(judged: DataFrame, score: str = "score", truth: str = "truth") -> DataFrame:
    mean = lambda c: F.round(F.avg(F.when(c, F.col(score))), 6)
    return judged.agg(mean(F.col(truth)).alias("kept"), mean(~F.col(truth)).alias("lost")).withColumn("gap", F.round(F.col("kept") - F.col("lost"), 6))
