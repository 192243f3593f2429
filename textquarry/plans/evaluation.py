"""Queries on judging, contexts, replay, tool calls and Hebrew text."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from ..functions import text as txt
from ..operators import context, judge, replay, tools
from .retrieval import _SQUEEZE, read

WORD = r"[\p{L}\p{N}_]+"


def _values(spark, rows: str, names: str):
    return spark.sql(f"SELECT * FROM VALUES {rows} AS v({names})")


# Replies with their place, as rows of VALUES that both engines read.
REPLIES = "(1, 'Yes.'), (2, 'no'), (3, 'It is true that it holds, no doubt'), (4, 'False, although yes is tempting'), (5, 'it depends'), (6, 'כן, בהחלט'), (7, 'לא'), (8, 'yesterday was nothing special'), (9, 'I rate it 4 of 5'), (10, '10 or 45'), (11, 'Score: 5'), (12, '3/5'), (13, ''), (14, 'YES and NO'), (15, 'a2b 1')"
WORDS = "('ובמסמכים'), ('השרתים'), ('מידע'), ('שולחן'), ('שלום'), ('של'), ('להצפנה'), ('כשהגיע'), ('בית'), ('abc'), (''), ('ארץ'), ('והמפתח'), ('מכתב')"
SEGMENTS = "('ובמסמכים', 'וב', 'מסמכים'), ('השרתים', 'ה', 'שרתים'), ('מידע', NULL, 'מידע'), ('שולחן', NULL, 'שולחן'), ('שלום', NULL, 'שלום'), ('בשרת', 'ב', 'שרת'), ('לקוחות', NULL, 'לקוחות')"
PROBE = "(1, 'The deploy key is blue-7.', 'What is the deploy key?', 'first log', 'second log'), (2, 'The region is north.', 'Which region?', 'alpha', 'beta')"
CASES = "('q1', 'sixty minutes', 'it lasts sixty minutes', 'It lasts Sixty  minutes.', 'It is short lived.', 5, 4, true, false), ('q2', 'three tries', 'three tries are allowed', 'You have three tries.', 'Tries are limited.', 4, 4, true, true), ('q3', 'port 8080', 'the port is 8080', 'Use port 8080 here.', 'Use the usual port.', 3, NULL, true, NULL)"
CASE_NAMES = "question, fact, criterion, kept, lost, kept_score, lost_score, kept_yes, lost_yes"


def _replies(spark, sf_dir):
    """The inline replies and every turn and benchmark passage, read as a reply."""
    inline = _values(spark, REPLIES, "id, text").select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("id"), "text")
    turns = _turns(spark, sf_dir).select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    passages = read(spark, sf_dir, "benchmark").select(F.concat(F.lit("b"), F.col("item_id").cast("string")).alias("id"), "text")
    return inline.unionByName(turns).unionByName(passages)


def yes_no_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("id", judge.read_yes_no(F.col("text")).alias("verdict"))


def score_parse(spark, sf_dir):
    return _replies(spark, sf_dir).select("id", judge.read_score(F.col("text")).alias("score"))


def _judged(spark, sf_dir):
    """Documents with quality as the verdict and clean as the truth; unlabelled ones are undecided."""
    labels = read(spark, sf_dir, "labels")
    return read(spark, sf_dir, "documents").join(labels, "doc_id", "left").select("doc_id", (F.col("quality") == 1).alias("verdict"), (F.coalesce("toxic", F.lit(0)) == 0).alias("truth"), F.when(F.col("quality").isNotNull(), F.col("doc_id") % 5 + 1).alias("score"))


def judge_agreement(spark, sf_dir):
    return judge.agreement(_judged(spark, sf_dir))


def holistic_summary(spark, sf_dir):
    return judge.holistic_summary(_judged(spark, sf_dir))


def mean_score_by_truth(spark, sf_dir):
    return judge.mean_by_truth(_judged(spark, sf_dir))


def _cases(spark):
    raw = _values(spark, CASES, CASE_NAMES)
    built = judge.build_cases(raw)
    kept = F.col("variant") == "kept"
    return built.join(raw.select("question", "kept_score", "lost_score", "kept_yes", "lost_yes"), "question").select("question", "variant", "truth", "answer", "criterion", "fact", F.when(kept, F.col("kept_score")).otherwise(F.col("lost_score")).alias("score"), F.when(kept, F.col("kept_yes")).otherwise(F.col("lost_yes")).alias("verdict"))


def build_cases(spark, sf_dir):
    made = judge.prompts(_cases(spark))
    digest = lambda c: F.sha2(F.col(c).cast("binary"), 256).alias(c)
    return made.select("question", "variant", "truth", digest("holistic_prompt"), digest("binary_prompt"))


def judge_replay(spark, sf_dir):
    """Prompt, key, recorded reply and verdict of both judges; the store's keys are made from the same prompts by hand."""
    made, out = judge.prompts(_cases(spark)), []
    kept = F.col("variant") == "kept"
    said = {"binary": (F.when(kept, "Yes.").otherwise("Hard to say."), judge.read_yes_no), "holistic": (F.when(kept, "I rate it 5").otherwise("2 of 5"), judge.read_score)}
    for name, (reply, reader) in said.items():
        asked = judge.asked(made, f"{name}_prompt", F.lit("demo-model"), F.lit(64), F.lit(7), F.lit(0.0))
        store = asked.select("key", reply.alias("text"))
        judged = judge.judged_by(asked.select("question", "variant", "key"), store, reader)
        out.append(judged.select("question", "variant", F.lit(name).alias("judge"), "key", F.col("verdict").cast("string").alias("verdict")))
    return out[0].unionByName(out[1])


def paired_agreement(spark, sf_dir):
    """Judgements and truth from two tables that must hold the same ids."""
    labels = read(spark, sf_dir, "labels")
    judged = labels.select("doc_id", (F.col("quality") == 1).alias("verdict"))
    return judge.agreement(judge.paired(judged, labels.select("doc_id", (F.col("toxic") == 0).alias("truth")), "doc_id"))


def pair_separation(spark, sf_dir):
    return judge.pair_separation(_cases(spark))


def _turns(spark, sf_dir):
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def conversation_render(spark, sf_dir):
    return context.render(_turns(spark, sf_dir), ["conv_id"])


SUMMARY = "Earlier turns were summarised."


def _rendered(spark, sf_dir):
    """Per conversation and strategy: the context before the last turn under keep_all and under the strategy, and after it."""
    turns = _turns(spark, sf_dir)
    last = turns.groupBy("conv_id").agg(F.max("turn").alias("last"))
    before = turns.join(last, "conv_id").filter("turn < last").drop("last")
    made = lambda t: context.strategies(t, 120, 2, SUMMARY, "assistant")
    after = context.render(made(turns), ["conv_id", "strategy"], name="after")
    same = context.render(made(before), ["conv_id", "strategy"], name="before_same")
    plain = context.render(before, ["conv_id"], name="before_plain")
    joined = after.join(same, ["conv_id", "strategy"], "left").join(plain, "conv_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.lit("")) for c in ("before_same", "before_plain")})


def prefix_cache(spark, sf_dir):
    r = _rendered(spark, sf_dir)
    out = [context.common_prefix_length(F.col("before_same"), F.col("after")).alias("prefix"), context.prefix_is_stable(F.col("before_same"), F.col("after")).alias("stable")]
    out += [F.round(context.cache_hit_ratio(F.col(c), F.col("after")), 6).alias(n) for c, n in (("before_same", "ratio_same"), ("before_plain", "ratio_plain"))]
    return r.select("conv_id", "strategy", *out)


def context_strategies(spark, sf_dir):
    r = context.render(context.strategies(_turns(spark, sf_dir), 120, 4, SUMMARY, "assistant"), ["conv_id", "strategy"])
    return context.saved(r.groupBy("strategy").agg(F.sum(F.length("rendered")).alias("chars")))


def context_cost(spark, sf_dir):
    cost = context.estimate_cost(F.col("after"), F.col("before_same"))
    return _rendered(spark, sf_dir).select("conv_id", "strategy", F.round(cost, 9).alias("cost"))


def facts_recalled(spark, sf_dir):
    """The first word of each conversation as its fact: in how many contexts each strategy keeps it."""
    turns = _turns(spark, sf_dir)
    rendered = context.render(context.strategies(turns, 120, 2, SUMMARY, "assistant"), ["conv_id", "strategy"])
    facts = turns.filter("turn = 0").select("conv_id", F.element_at(F.split("text", " "), 1).alias("value"))
    return context.recalled(rendered, facts)


def planted_probe(spark, sf_dir):
    """The inline probes, and a probe about every benchmark passage."""
    inline = _values(spark, PROBE, "id, fact, question, a, b").select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("id"), "fact", "question", F.array("a", "b").alias("filler"))
    passages = read(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("fact"), F.lit("Which passage?").alias("question"), F.array(F.col("text")).alias("filler"))
    probes = inline.unionByName(passages)
    return context.planted_probe(probes).select("conv_id", "turn", "role", "text")


def fact_values(spark, sf_dir):
    return _values(spark, PROBE, "id, fact, question, a, b").select("id", txt.fact_value(F.col("fact")).alias("value"))


def token_cost(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    tokens = F.size(F.regexp_extract_all("text", F.lit(r"[^\s]{1,4}"), F.lit(0)))
    made = txt.token_cost(docs, "text", tokens, ["lang"])
    return made.withColumns({c: F.round(c, 6) for c in ("tokens_per_word", "characters_per_token")})


def language_token_ratio(spark, sf_dir):
    docs = read(spark, sf_dir, "documents").withColumn("n", F.size(F.regexp_extract_all("text", F.lit(r"[^\s]{1,4}"), F.lit(0))))
    part = lambda lang: F.sum(F.when(F.col("lang") == lang, F.col("n")).otherwise(0))
    return docs.agg(F.round(part("de") / F.greatest(part("en"), F.lit(1)), 6).alias("ratio"))


def _requests(spark, sf_dir):
    turns = _turns(spark, sf_dir).filter("role = 'user'")
    canonical = replay.canonical_request(F.lit("demo-model"), F.col("text"), F.lit(64), F.lit(7), F.lit(0.0))
    return turns.select("conv_id", "turn", replay.key_of(canonical).alias("key"))


def replay_keys(spark, sf_dir):
    return _requests(spark, sf_dir)


def replay_join_miss(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    return replay.misses(requests, requests.filter(F.col("conv_id") % 2 == 0)).select("conv_id", "turn", "key")


def replay_recorded(spark, sf_dir):
    requests = _requests(spark, sf_dir)
    return replay.recorded(requests, requests.filter(F.col("conv_id") % 2 == 0)).select("conv_id", "turn", "key")


def replay_answers(spark, sf_dir):
    """Requests that were recorded, answered from the store under the replay backend."""
    requests = _requests(spark, sf_dir)
    store = requests.filter(F.col("conv_id") % 2 == 0).select("key", F.concat(F.lit("reply to "), F.col("key")).alias("text"))
    return replay.dispatch(replay.recorded(requests, store), store, backend="replay").select("conv_id", "turn", "raw")


def json_salvage(spark, sf_dir):
    """By event: a flat object, a nested one with a brace and quotes in a string, one inside a broken outer one, a truncated one, none."""
    props, kind = F.col("props"), F.col("event_id") % 5
    nested = F.concat(F.lit('{"a": {"b": "} \\" {"}, "in": '), props, F.lit("}"))
    body = F.when(kind == 0, props).when(kind == 1, nested).when(kind == 2, F.concat(F.lit("{bad: "), props, F.lit("}"))).when(kind == 3, F.concat(F.lit('{"a": ['), props)).otherwise("[1, 2]")
    wrapped = F.concat(F.lit("Sure, here it is: "), body, F.lit(" - done."))
    return read(spark, sf_dir, "events").select("event_id", tools.salvage(wrapped).alias("found"))


TOOL = tools.Tool("set_k", "Set k.", (tools.Parameter("k", "integer"), tools.Parameter("note", "string", required=False), tools.Parameter("mode", "string", required=False, enum=("a", "b"))))


def _reply(attempt):
    """Synthetic replies by event: some are right at once, some after a retry, some never."""
    m, props = F.col("event_id") % 10, F.col("props")
    never = F.when(m == 0, F.lit("no idea"))
    late = never.when((m == 1) & (attempt < 2), F.regexp_replace(props, r"(\d+)", '"$1"')).when((m == 2) & (attempt < 3), F.regexp_replace(props, "\\}$", ', "x": 1}'))
    return late.when(m == 3, F.regexp_replace(props, "\\}$", ', "note": null}')).when((m == 4) & (attempt < 2), F.regexp_replace(props, "\\}$", ', "mode": "c"}')).otherwise(props)


def tool_validate(spark, sf_dir):
    for_strict = lambda null_is_absent: tools.checked(TOOL, _reply(F.lit(1)), null_is_absent)
    rows = read(spark, sf_dir, "events").withColumns({"lenient": for_strict(True), "strict": for_strict(False)})
    return rows.select("event_id", F.col("lenient.ok").alias("ok"), tools.feedback(F.col("lenient.errors")).alias("feedback"), F.col("strict.ok").alias("strict_ok"))


def repair_summary(spark, sf_dir):
    tasks = read(spark, sf_dir, "events").select(F.col("event_id").alias("task_id"), F.col("props").alias("task"))
    answer = lambda asked: asked.withColumns({"event_id": F.col("task_id"), "props": F.col("task")}).withColumn("raw", _reply(F.col("attempt")))
    return tools.repair_summary(tools.run_tasks(TOOL, tasks, answer))


def hebrew_prefix(spark, sf_dir):
    words = _values(spark, WORDS, "word")
    return words.select("word", F.array_join(txt.strip_prefixes(F.col("word")), "+").alias("pieces"))


def fold_finals(spark, sf_dir):
    return _values(spark, WORDS, "word").select("word", txt.fold_finals(F.col("word")).alias("folded"))


def hebrew_tokens(spark, sf_dir):
    """Documents' words are not Hebrew, so this also shows that none of them is split."""
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text")
    words = _values(spark, WORDS, "word").select(F.col("word").alias("id"), F.concat(F.lit("שָׁלוֹם "), F.col("word")).alias("text"))
    tokens = txt.hebrew_tokens(txt.normalize(F.col("text")))
    return rows.unionByName(words).select("id", F.size(tokens).alias("tokens"), F.array_join(tokens, " ").alias("all"))


def segmentation_agreement(spark, sf_dir):
    pairs = _values(spark, SEGMENTS, "word, prefix, stem").select("word", F.filter(F.array("prefix", "stem"), lambda x: x.isNotNull()).alias("pieces"))
    return txt.segmentation_agreement(pairs)[0].withColumn("rate", F.round("rate", 6))


def html_error_scan(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    return pages.select("page_id", F.array_join(txt.html_errors(F.col("html")), ",").alias("errors"), F.regexp_count("html", F.lit("<li>")).alias("items"), F.regexp_count("html", F.lit("<script")).alias("scripts"))


def html_rtl_lines(spark, sf_dir):
    """Pages' visible lines read as one right-to-left block."""
    pages = read(spark, sf_dir, "pages").withColumn("html", F.concat(F.lit('<div dir="rtl">\n'), F.regexp_replace("html", "<[^>]*>", "\n"), F.lit("\n</div>")))
    return txt.rtl_lines(pages, "page_id", "html").groupBy("page_id").agg(F.count("*").alias("lines"), F.sum(F.col("starts_latin").cast("long")).alias("latin"), F.sum(F.col("bare_figure").cast("long")).alias("figures"))


def undefined_terms(spark, sf_dir):
    """Words of all turns but the first, put into back ticks, that no first turn has."""
    turns = _turns(spark, sf_dir)
    ticked = turns.filter("turn > 0").select("conv_id", F.regexp_replace("text", r"([^ \n`]+)", "`$1`").alias("text"))
    glossary = turns.filter("turn = 0").select(F.explode(txt.tokenize(F.col("text"))).alias("term"))
    return txt.undefined_terms(ticked, "conv_id", "text", glossary)


QUERIES = {f.__name__: f for f in (yes_no_parse, score_parse, judge_agreement, holistic_summary, mean_score_by_truth, build_cases, judge_replay, paired_agreement, pair_separation, conversation_render, prefix_cache, context_strategies, context_cost, facts_recalled, planted_probe, fact_values, token_cost, language_token_ratio, replay_keys, replay_join_miss, replay_recorded, replay_answers, json_salvage, tool_validate, repair_summary, hebrew_prefix, fold_finals, hebrew_tokens, segmentation_agreement, html_error_scan, html_rtl_lines, undefined_terms)}

_E = r"[^\p{L}\p{N}_]"
_R = f"(SELECT 'r' || id AS id, text FROM (VALUES {REPLIES}) v(id, text) UNION ALL SELECT conv_id || ':' || turn, text FROM conversations UNION ALL SELECT 'b' || item_id, text FROM benchmark)"


def _at(words: str) -> str:
    hit = f"regexp_extract(lower(text), '(?s)^(.*?{_E}|)(?:{words})(?:{_E}|$)', 1)"
    return f"CASE WHEN regexp_matches(lower(text), '(^|{_E})({words})({_E}|$)') THEN length({hit}) END"


_YES = f"SELECT id, {_at('yes|true|כן')} AS y, {_at('no|false|לא')} AS n FROM {_R}"
_JUDGED = "j AS (SELECT d.doc_id, l.quality = 1 AS verdict, coalesce(l.toxic, 0) = 0 AS truth, CASE WHEN l.quality IS NOT NULL THEN d.doc_id % 5 + 1 END AS score FROM documents d LEFT JOIN labels l USING (doc_id))"
_CASE = f"c AS (SELECT * FROM (VALUES {CASES}) v({CASE_NAMES})), v AS (SELECT question, fact, criterion, 'kept' AS variant, kept AS answer, kept_score AS score, kept_yes AS verdict FROM c UNION ALL SELECT question, fact, criterion, 'lost', lost, lost_score, lost_yes FROM c)"
_LINES = "string_agg(role || ': ' || text || chr(10), '' ORDER BY turn)"


def _strategy_ctes(turns: str, keep: int, p: str) -> str:
    return f"""
{p}n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS back FROM {turns}),
{p}s AS (SELECT 'keep_all' AS strategy, conv_id, turn, role, text FROM {turns}
  UNION ALL SELECT 'cap', conv_id, turn, role, CASE WHEN role = 'assistant' AND length(text) > 120 THEN substr(text, 1, 120) || ' ...[truncated]' ELSE text END FROM {turns}
  UNION ALL SELECT 'summarise', conv_id, turn, role, text FROM {p}n WHERE back <= {keep}
  UNION ALL SELECT 'summarise', conv_id, -1, 'system', '{SUMMARY}' FROM {p}n WHERE back = {keep} + 1),
{p}r AS (SELECT conv_id, strategy, {_LINES} AS rendered FROM {p}s GROUP BY conv_id, strategy)"""


_BEFORE = "t AS (SELECT conv_id, turn, role, text FROM conversations), b AS (SELECT conv_id, turn, role, text FROM (SELECT *, max(turn) OVER (PARTITION BY conv_id) AS last FROM t) WHERE turn < last), pl AS (SELECT conv_id, " + _LINES + " AS rendered FROM b GROUP BY conv_id)"
_RENDERED = f"{_BEFORE}, {_strategy_ctes('t', 2, 'k')}, {_strategy_ctes('b', 2, 'e')}, x AS (SELECT kr.conv_id, kr.strategy, kr.rendered AS after, coalesce(er.rendered, '') AS bs, coalesce(pl.rendered, '') AS bp FROM kr LEFT JOIN er USING (conv_id, strategy) LEFT JOIN pl USING (conv_id))"


def _prefix(a: str, b: str) -> str:
    """The common prefix's length by positions: before the first that differs."""
    return f"coalesce(list_position(list_transform(range(1, least(length({a}), length({b})) + 1), lambda i: substr({a}, i, 1) <> substr({b}, i, 1)), true) - 1, least(length({a}), length({b})))"


def _key(text: str) -> str:
    return f"""substr(sha256('{{"messages":[{{"content":' || CAST(to_json({text}) AS VARCHAR) || ',"role":"user"}}],"model":"demo-model","params":{{"max_tokens":64,"seed":7,"temperature":0.0}},"tools":null}}'), 1, 16)"""


def _prompt(prompt: str) -> str:
    """A prompt with its {names} as columns, in SQL."""
    parts = re.split(r"\{(\w+)\}", prompt)
    return " || ".join(p if i % 2 else "'" + p.replace("'", "''") + "'" for i, p in enumerate(parts) if p)


_REQ = f"r AS (SELECT conv_id, turn, {_key('text')} AS key FROM conversations WHERE role = 'user')"


def _strip_sql(w: str) -> str:
    stop = ", ".join(f"'{x}'" for x in txt.NOT_PREFIXED)
    cases = [f"WHEN {w} = '' THEN ''", f"WHEN NOT regexp_full_match({w}, '[א-ת]+') OR {w} IN ({stop}) THEN {w}"]
    cases += [f"WHEN starts_with({w}, '{c}') AND length({w}) >= {len(c) + 3} THEN '{c}+' || substr({w}, {len(c) + 1})" for c in txt.PREFIX_CLUSTERS]
    cases.append(f"WHEN contains('{txt.PREFIX_LETTERS}', substr({w}, 1, 1)) AND length({w}) >= 4 THEN substr({w}, 1, 1) || '+' || substr({w}, 2)")
    return f"CASE {' '.join(cases)} ELSE {w} END"


_TASK = "e AS (SELECT event_id, event_id % 10 AS m FROM events)"
_FEEDBACK = "CASE m WHEN 0 THEN 'no JSON object found in the reply' WHEN 1 THEN '`k` must be a integer, got str (\"' || regexp_extract(props, '\\d+') || '\")' WHEN 2 THEN 'unknown key `x`' WHEN 4 THEN '`mode` must be one of [''a'', ''b''], got ''c''' ELSE '' END"

SQL = {
    "yes_no_parse": f"SELECT id, CASE WHEN y IS NOT NULL AND n IS NOT NULL THEN y < n WHEN y IS NOT NULL THEN true WHEN n IS NOT NULL THEN false END AS verdict FROM ({_YES})",
    "score_parse": f"SELECT id, CAST(nullif(regexp_extract(text, '(?:^|{_E})([1-5])(?:{_E}|$)', 1), '') AS INTEGER) AS score FROM {_R}",
    "judge_agreement": f"WITH {_JUDGED} SELECT count(verdict) AS n, count(*) - count(verdict) AS undecided, round(count(*) FILTER (verdict = truth) / greatest(count(verdict), 1)::DOUBLE, 6) AS accuracy, round(count(*) FILTER (verdict) / greatest(count(verdict), 1)::DOUBLE, 6) AS said_yes, round(count(*) FILTER (verdict AND NOT truth) / greatest(count(*) FILTER (verdict IS NOT NULL AND NOT truth), 1)::DOUBLE, 6) AS false_positive, round(count(*) FILTER (NOT verdict AND truth) / greatest(count(*) FILTER (verdict IS NOT NULL AND truth), 1)::DOUBLE, 6) AS false_negative FROM j",
    "holistic_summary": f"WITH {_JUDGED} SELECT count(*) AS n, round(count(*) FILTER (score >= 4) / greatest(count(*), 1)::DOUBLE, 6) AS called_good, round(count(*) FILTER (score >= 4 AND NOT truth) / greatest(count(*) FILTER (NOT truth), 1)::DOUBLE, 6) AS called_good_when_fact_lost, coalesce(round(avg(score), 6), 0) AS mean FROM j WHERE score IS NOT NULL",
    "mean_score_by_truth": f"WITH {_JUDGED}, a AS (SELECT round(avg(score) FILTER (truth), 6) AS kept, round(avg(score) FILTER (NOT truth), 6) AS lost FROM j) SELECT kept, lost, round(kept - lost, 6) AS gap FROM a",
    "build_cases": f"WITH {_CASE} SELECT question, variant, contains({_SQUEEZE.format(t='answer')}, {_SQUEEZE.format(t='fact')}) AS truth, sha256({_prompt(judge.HOLISTIC_PROMPT)}) AS holistic_prompt, sha256({_prompt(judge.BINARY_PROMPT)}) AS binary_prompt FROM v",
    "judge_replay": f"WITH {_CASE} SELECT question, variant, 'binary' AS judge, {_key(_prompt(judge.BINARY_PROMPT))} AS key, CASE variant WHEN 'kept' THEN 'true' END AS verdict FROM v UNION ALL SELECT question, variant, 'holistic', {_key(_prompt(judge.HOLISTIC_PROMPT))}, CASE variant WHEN 'kept' THEN '5' ELSE '2' END FROM v",
    "paired_agreement": "SELECT count(*) AS n, 0 AS undecided, round(avg(CASE WHEN (quality = 1) = (toxic = 0) THEN 1 ELSE 0 END), 6) AS accuracy, round(avg(quality), 6) AS said_yes, round(count(*) FILTER (quality = 1 AND toxic = 1) / greatest(count(*) FILTER (toxic = 1), 1)::DOUBLE, 6) AS false_positive, round(count(*) FILTER (quality = 0 AND toxic = 0) / greatest(count(*) FILTER (toxic = 0), 1)::DOUBLE, 6) AS false_negative FROM labels",
    "pair_separation": f"WITH {_CASE} SELECT count(*) AS pairs, count(*) FILTER (kept_score > lost_score) AS holistic, count(*) FILTER (kept_yes AND NOT coalesce(lost_yes, false)) AS binary FROM c",
    "conversation_render": f"SELECT conv_id, {_LINES} AS rendered FROM conversations GROUP BY conv_id",
    "prefix_cache": f"WITH {_RENDERED} SELECT conv_id, strategy, CAST({_prefix('bs', 'after')} AS INTEGER) AS prefix, starts_with(after, bs) AS stable, round(CASE WHEN bs = '' THEN 1.0::DOUBLE ELSE {_prefix('bs', 'after')} / length(bs)::DOUBLE END, 6) AS ratio_same, round(CASE WHEN bp = '' THEN 1.0::DOUBLE ELSE {_prefix('bp', 'after')} / length(bp)::DOUBLE END, 6) AS ratio_plain FROM x",
    "context_strategies": f"WITH t AS (SELECT conv_id, turn, role, text FROM conversations), {_strategy_ctes('t', 4, 'k')}, c AS (SELECT strategy, CAST(sum(length(rendered)) AS BIGINT) AS chars FROM kr GROUP BY strategy) SELECT strategy, chars, round(1 - chars / (SELECT chars FROM c WHERE strategy = 'keep_all')::DOUBLE, 6) AS saved FROM c",
    "context_cost": f"WITH {_RENDERED} SELECT conv_id, strategy, round((length(after) - {_prefix('bs', 'after')}) * (0.003::DOUBLE / 1000 / 4) + {_prefix('bs', 'after')} * (0.003::DOUBLE / 1000 / 4) * 0.1::DOUBLE, 9) AS cost FROM x",
    "facts_recalled": f"WITH t AS (SELECT conv_id, turn, role, text FROM conversations), {_strategy_ctes('t', 2, 'k')}, w AS (SELECT conv_id, lower(string_split(text, ' ')[1]) AS value FROM t WHERE turn = 0) SELECT strategy, count(*) AS probes, count(*) FILTER (contains(lower(rendered), value) AND value <> '') AS recalled FROM kr JOIN w USING (conv_id) GROUP BY strategy",
    "planted_probe": f"WITH p AS (SELECT 'p' || id AS id, fact, question, [a, b] AS filler FROM (VALUES {PROBE}) v(id, fact, question, a, b) UNION ALL SELECT CAST(item_id AS VARCHAR), text, 'Which passage?', [text] FROM benchmark), s AS (SELECT id AS conv_id, unnest(list_concat([['user', fact], ['assistant', 'הבנתי.']], flatten(list_transform(filler, lambda f: [['tool', f], ['assistant', 'בסדר.']])), [['user', question]])) AS x, generate_subscripts(list_concat([['user', fact], ['assistant', 'הבנתי.']], flatten(list_transform(filler, lambda f: [['tool', f], ['assistant', 'בסדר.']])), [['user', question]]), 1) AS k FROM p) SELECT conv_id, CAST(k - 1 AS BIGINT) AS turn, x[1] AS role, x[2] AS text FROM s",
    "fact_values": f"SELECT id, lower(regexp_extract(fact, 'is ([A-Za-z0-9#\\-]+(?: [A-Za-z]+)?)\\.', 1)) AS value FROM (VALUES {PROBE}) v(id, fact, question, a, b)",
    "token_cost": f"WITH s AS (SELECT lang, CAST(sum(length(text)) AS BIGINT) AS characters, CAST(sum(len(regexp_extract_all(text, '{WORD}'))) AS BIGINT) AS words, CAST(sum(len(regexp_extract_all(text, '[^\\s]{{1,4}}'))) AS BIGINT) AS tokens FROM documents GROUP BY lang) SELECT *, round(coalesce(tokens / nullif(words, 0)::DOUBLE, 0), 6) AS tokens_per_word, round(coalesce(characters / nullif(tokens, 0)::DOUBLE, 0), 6) AS characters_per_token FROM s",
    "language_token_ratio": "WITH n AS (SELECT lang, len(regexp_extract_all(text, '[^\\s]{1,4}')) AS n FROM documents) SELECT round(sum(CASE WHEN lang = 'de' THEN n ELSE 0 END) / greatest(sum(CASE WHEN lang = 'en' THEN n ELSE 0 END), 1)::DOUBLE, 6) AS ratio FROM n",
    "replay_keys": f"WITH {_REQ} SELECT * FROM r",
    "replay_join_miss": f"WITH {_REQ} SELECT * FROM r WHERE key NOT IN (SELECT key FROM r WHERE conv_id % 2 = 0)",
    "replay_recorded": f"WITH {_REQ} SELECT * FROM r WHERE key IN (SELECT key FROM r WHERE conv_id % 2 = 0)",
    "replay_answers": f"WITH {_REQ} SELECT conv_id, turn, 'reply to ' || key AS raw FROM r WHERE key IN (SELECT key FROM r WHERE conv_id % 2 = 0)",
    "json_salvage": """SELECT event_id, CASE event_id % 5 WHEN 1 THEN '{"a": {"b": "} \\" {"}, "in": ' || props || '}' WHEN 4 THEN NULL ELSE props END AS found FROM events""",
    "tool_validate": f"SELECT event_id, {_FEEDBACK} = '' AS ok, {_FEEDBACK} AS feedback, {_FEEDBACK} = '' AND m <> 3 AS strict_ok FROM (SELECT *, event_id % 10 AS m FROM events)",
    "repair_summary": f"WITH {_TASK}, t AS (SELECT m <> 0 AS ok, CASE m WHEN 0 THEN 3 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 4 THEN 2 ELSE 1 END AS tries FROM e) SELECT count(*) AS n, round(avg(CASE WHEN ok AND tries = 1 THEN 1 ELSE 0 END), 6) AS first_try, round(avg(CASE WHEN ok THEN 1 ELSE 0 END), 6) AS eventually, round(avg(CASE WHEN ok THEN 0 ELSE 1 END), 6) AS never, round(avg(tries), 6) AS mean_tries FROM t",
    "hebrew_prefix": f"SELECT word, {_strip_sql('word')} AS pieces FROM (VALUES {WORDS}) v(word)",
    "fold_finals": f"SELECT word, translate(word, '{txt.FINAL_LETTERS}', '{txt.PLAIN_LETTERS}') AS folded FROM (VALUES {WORDS}) v(word)",
    "segmentation_agreement": f"WITH s AS (SELECT {_strip_sql('word')} = coalesce(prefix || '+', '') || stem AS same FROM (VALUES {SEGMENTS}) v(word, prefix, stem)) SELECT count(*) AS total, count(*) FILTER (same) AS agree, round(count(*) FILTER (same) / count(*)::DOUBLE, 6) AS rate FROM s",
    "html_error_scan": "SELECT page_id, array_to_string(list_sort(list_distinct(regexp_extract_all(html, '\\b([A-Z][A-Za-z]*(?:Error|Exception)):', 1))), ',') AS errors, CAST(len(regexp_extract_all(html, '<li>')) AS INTEGER) AS items, CAST(len(regexp_extract_all(html, '<script')) AS INTEGER) AS scripts FROM pages",
    "html_rtl_lines": "WITH l AS (SELECT page_id, unnest(string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10))) AS line FROM pages) SELECT page_id, count(*) AS lines, count(*) FILTER (regexp_matches(line, '^\\s*[A-Za-z]')) AS latin, count(*) FILTER (regexp_matches(line, '^\\s*[\\d.,%]+\\s*$')) AS figures FROM l GROUP BY page_id",
    "undefined_terms": f"WITH g AS (SELECT DISTINCT regexp_replace(unnest(regexp_extract_all(lower(text), '{WORD}')), 's$', '') AS part FROM conversations WHERE turn = 0), t AS (SELECT DISTINCT conv_id, unnest(regexp_extract_all(text, '[^ \n`]+')) AS term FROM conversations WHERE turn > 0), p AS (SELECT conv_id, term, regexp_replace(unnest(regexp_extract_all(lower(term), '{WORD}')), 's$', '') AS part FROM t) SELECT DISTINCT conv_id, term FROM p WHERE part NOT IN (SELECT part FROM g)",
}
