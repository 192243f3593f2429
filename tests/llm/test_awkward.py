"""Repeated rows, null and extreme ids, clashing columns and empty tables, against plain versions."""

import collections
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from textquarry.llm import ann, boosting, chat, common, exact_dedup, licenses, mixing, packing, quality, scoring, sharding, simhash, toxicity

IDS = [2**60 + 1, 2**60, None, 2**63 - 1, -(2**63), 2**60 + 1, None]
TEXTS = ["one two three four", "one two three four", "a b c d e", None, "", "five six seven eight nine", "A B C d e"]


@pytest.fixture(scope="module")
def odd(spark):
    """Every awkward id in one batch, with columns that the operators use as names of their own."""
    rows = [(i, t, "en", "s", 1, 2, 3, "k") for i, t in zip(IDS, TEXTS)]
    names = "doc_id long, text string, lang string, source string, size long, h long, n long, digest string"
    return common.durable(spark.createDataFrame(rows, names).coalesce(1))


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(2**60, 1, 0), (2**60 + 1, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")


def ids(rows):
    return sorted(r.doc_id if r.doc_id is not None else 0.5 for r in rows)


WANT = sorted(i if i is not None else 0.5 for i in IDS)


def test_every_query_keeps_every_id(spark, odd, labels):
    assert ids(simhash.classes(odd).collect()) == WANT
    assert ids(sharding.shards_of(odd, 3).collect()) == WANT
    assert ids(mixing.mixed(odd).collect()) == WANT
    assert ids(exact_dedup.classes(odd).collect()) == WANT
    assert ids(r for r in packing.pack(odd, packing.tokenizer_path()).collect()) == WANT
    assert ids(toxicity.scores(odd, labels).collect()) == WANT
    forest = quality.fit(odd, labels)
    assert ids(scoring.scored(odd, quality.features, forest.probability, scoring.remainder("doc_id", 5) == 0).collect()) == WANT


def test_stages_keep_the_columns(spark, odd, labels):
    for made in (toxicity.clean(odd, labels), exact_dedup.deduplicated(odd), simhash.deduplicated(odd), mixing.mix(odd)):
        assert made.columns == odd.columns and made.count() > 0


def test_components_of_awkward_ids(odd):
    got = {(r.doc_id, r.component_id) for r in simhash.classes(odd).collect()}
    assert {(2**60 + 1, 2**60), (2**60, 2**60), (None, None), (2**63 - 1, -(2**63)), (-(2**63), -(2**63)), (2**60 + 1, 2**60 + 1)} == got


def test_exact_dedup_of_awkward_ids(odd):
    got = sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.classes(odd).collect()), key=str)
    want = [(2**60 + 1, 2**60, 2, False), (2**60, 2**60, 2, True), (None, None, 1, True), (2**63 - 1, -(2**63), 2, False), (-(2**63), -(2**63), 2, True), (2**60 + 1, 2**60 + 1, 1, True), (None, None, 1, True)]
    assert got == sorted(want, key=str)


def test_exact_dedup_of_many_equal_rows(spark):
    rows = [(None, "x y", k % 3) for k in range(300)] + [(4, "xy", 9), (5, "z", 1), (5, "z", 2), (5, " z", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, extra int").repartition(3)
    kept = exact_dedup.deduplicated(df).collect()
    assert len(kept) == 2 and sum(r.kept for r in exact_dedup.classes(df).collect()) == 2
    assert sorted((r.text, r.doc_id) for r in kept) == [(" z", 5), ("x y", None)]  # the most code points, whatever the id
    again = exact_dedup.deduplicated(df.repartition(5, "extra")).collect()
    assert sorted(map(str, kept)) == sorted(map(str, again))


def _bytes(text):
    return len((text or "").encode()) + 1


@pytest.mark.parametrize("hot", [(7, "the same text " * 12), (None, "no id"), (None, None)])
def test_shards_are_even_when_half_of_the_rows_are_equal(spark, hot):
    rng = random.Random(1)
    rows = [(i, "x" * rng.randint(1, 200)) for i in range(1000)] + [hot] * 1000
    got = sharding.shards_of(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect()
    want = collections.Counter((i if i is not None else -1, _bytes(t), zlib.crc32((t or "").encode())) for i, t in rows)
    assert collections.Counter((r.doc_id if r.doc_id is not None else -1, r["size"], r.text_crc32) for r in got) == want
    sizes, mean = collections.Counter(), sum(_bytes(t) for _, t in rows) / 8
    for r in got:
        sizes[r.shard] += r["size"]
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * mean + 2 * 201
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))


def test_overfull_ranges_are_subdivided(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SAMPLE_PER_RANGE", 1)  # a poor sample leaves overfull ranges
    rows = common.durable(sharding.keyed(spark.createDataFrame([(i, "y" * 50) for i in range(4000)], "doc_id long, text string")))
    total = 4000 * 51
    monkeypatch.setattr(sharding, "ROUNDS", 0)
    once = sharding.ranges_of(rows, total, 64)[1]
    monkeypatch.setattr(sharding, "ROUNDS", 3)
    more = sharding.ranges_of(rows, total, 64)[1]
    assert sum(once.values()) == sum(more.values()) == total
    assert max(more.values()) < max(once.values()) and max(more.values()) <= 2 * total / 64


def test_mixing_with_null_ids_and_equal_rows(spark):
    rng = random.Random(2)
    rows = [(None if i % 2 else i, "w " * rng.randint(1, 40), f"s{i % 3}") for i in range(900)] + [(None, "same words here", "s0")] * 600 + [(1, None, None), (2, "", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    got = mixing.mixed(df).collect()
    assert len(got) == len(rows) and all(0 <= r.copies <= 3 for r in got)
    taken, target, sizes = collections.Counter(), {}, collections.Counter()
    for r in got:
        taken[r.source] += r["size"] * r.copies
        sizes[r.source] += r["size"]
        target[r.source] = r.target
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(2, 0.002 * t), (s, taken[s], t)
    assert sum(target.values()) == pytest.approx(sum(sizes.values()))
    again = mixing.mixed(df.repartition(7))
    shown = lambda rows: collections.Counter((r.doc_id, r.digest, r.copies) for r in rows)
    assert shown(got) == shown(again.collect())
    mixed = mixing.mix(df).collect()
    assert len(mixed) == sum(r.copies for r in got)
    assert collections.Counter((r.doc_id, r.text) for r in mixed) == +_copies(got, rows)


def _copies(got, rows):
    import hashlib

    by = {(i, s, hashlib.md5(t.encode()).hexdigest() if t is not None else None): t for i, t, s in rows}
    out = collections.Counter()
    for r in got:
        out[r.doc_id, by[r.doc_id, r.source, r.digest]] += r.copies
    return out


def test_mixing_passes_a_document_that_does_not_fit(spark):
    rows = [(i, "w " * 10, "a") for i in range(300)] + [(1000, "w " * 2500, "a")] + [(2000 + i, "w " * 9, "b") for i in range(600)] + [(5000, "w", "b")]
    got = mixing.mixed(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        mine = [r for r in got if r.source == source]
        assert abs(sum(r["size"] * r.copies for r in mine) - mine[0].target) <= 10


def test_chances_give_the_expected_words(spark):
    rng = random.Random(3)
    rows = [(f"s{s}", c, rng.randint(0, 5000), float(rest)) for s, rest in enumerate((10, 3000, 20000)) for c in range(1, 12)]
    got = mixing.chances(spark.createDataFrame(rows, "source string, class int, words long, rest double")).collect()
    words = {(s, c): w for s, c, w, _ in rows}
    for s, rest in (("s0", 10), ("s1", 3000), ("s2", 20000)):
        mine = sorted((r for r in got if r.source == s), key=lambda r: r["class"])
        expected = sum(r.chance * words[s, r["class"]] for r in mine)
        assert expected == pytest.approx(min(rest, sum(w for (x, _), w in words.items() if x == s)), rel=1e-6)
        assert all(a.chance <= b.chance for a, b in zip(mine, mine[1:])) and mine[0].chance < mine[-1].chance or mine[0].chance > 0.999


def test_chat_gives_one_row_for_each(spark):
    calls = spark.createDataFrame([("a", 1, "reply", '{"question": "x", "turn": 1}', None)] * 3 + [(None, 2, "reply", "{}", None)] * 2, "call_id string, turn long, tool string, arguments string, needs string")
    results = spark.createDataFrame([("a", 2, "r")] * 2 + [(None, 3, "s")], "call_id string, turn long, text string")
    made, answers = chat.linked(calls, results)
    got = made.collect()
    assert len(got) == 5 and answers.count() == 3
    assert sorted((r.call_id or "", "repeated identifier" in r.errors, r.answered) for r in got) == [("", False, False)] * 2 + [("a", False, True)] + [("a", True, False)] * 2
    assert [r.place for r in answers.filter("call_id = 'a'").collect()] == [1, 1]


def _chat(spark, tmp_path, rows, more=""):
    path = tmp_path / "sf"
    schema = "conv_id long, turn long, role string, text string" + more
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(str(path / "conversations.parquet"))
    return chat.op8_chat(spark, str(path)).collect()


def test_chat_query_on_awkward_rows(spark, tmp_path):
    long = "w " * 30_000
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, "user", long), (1, 2, "user", long), (1, 3, "assistant", "a"), (1, 4, "user", None), (None, 0, "user", "x"), (None, 1, "assistant", "y"), (2, 1, "assistant", "alone"), (2, 0, "system", "s"), (2, 5, None, "")]
    got = _chat(spark, tmp_path, [(*r, "k", 1) for r in rows], ", call_id string, place long")
    assert len(got) == len(rows)
    by = collections.Counter((r.conv_id, r.turn, r.role, r.link, r.depth, r.errors) for r in got)
    assert by[1, 0, "user", "linked", 0, ""] == by[1, 1, "assistant", "linked", 0, ""] == by[1, 2, "user", "linked", 1, ""] == 1
    assert by[1, 2, "user", "open", 0, "repeated identifier"] == 1 and by[1, 4, "user", "open", 2, "missing `question`"] == 1
    assert by[None, 0, "user", "open", 0, ""] == by[None, 1, "assistant", "orphan", 0, ""] == by[2, 1, "assistant", "orphan", 0, ""] == 1
    assert by[2, 0, "system", "none", 0, ""] == by[2, 5, None, "none", 0, ""] == 1
    assert _chat(spark, tmp_path, []) == []


def test_licenses_judge_each_row_by_itself(spark):
    mit = next(t for n, t in licenses.TEMPLATES if n == "MIT" and len(t) > 900)
    words = mit.split()
    half = len(words) // 2
    cut = lambda share: " ".join(words[: int(len(words) * share)])
    rows = [(None, " ".join(words[:half])), (None, " ".join(words[half:])), (3, " ".join(words[:half])), (3, " ".join(words[half:])), (5, mit), (5, mit), (6, "intro\n" + cut(0.85)), (7, cut(0.7)), (8, "Released under the MIT License.\n" * 3), (9, None), (10, "")]
    got = licenses.scan(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, template int")).collect()
    whole = [i for i, (n, t) in enumerate(licenses.TEMPLATES) if t == mit][0]
    assert sorted(r.doc_id for r in got if r.template == whole) == [5, 6]
    assert [(r.matched, r.places) for r in got if r.doc_id == 8] == [(1, 3)]
    assert {r.license for r in got if r.doc_id == 5} >= {"MIT"} and sum(r.doc_id == 5 and r.template == whole for r in got) == 1


def _holds(text, templates=licenses.TEMPLATES):
    """Plain containment: (template, matched, first word, places)."""
    cut = lambda t: [" ".join(w[i : i + 5]) for w in [re.findall(r"[^\W_]+", (t or "").lower())] for i in range(len(w) - 4)]
    held, out = cut(text), []
    for k, (_, t) in enumerate(templates):
        own = set(cut(t))
        reach = -(-5 * len(own) // 4)
        good = [(len(own & set(held[p : p + reach])), p) for p, s in enumerate(held) if s in own]
        good = [(n, p) for n, p in good if n >= 0.8 * len(own)]
        if good:
            out.append((k, max(n for n, _ in good), min(p for _, p in good), len(good)))
    return out


def test_licenses_against_plain_containment(spark):
    rng = random.Random(5)
    filler = ["alpha", "beta", "gamma", "software", "the", "license", "under", "copy"]
    rows = []
    for i in range(120):
        _, t = rng.choice(licenses.TEMPLATES)
        words = t.split()
        for _ in range(rng.randint(0, max(1, len(words) // 12))):  # some words are changed
            words[rng.randrange(len(words))] = rng.choice(filler)
        rows.append((i, " ".join([*rng.choices(filler, k=rng.randint(0, 60)), *words, *rng.choices(filler, k=rng.randint(0, 60))])))
    got = collections.defaultdict(list)
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got[r.doc_id].append((r.template, r.matched, r.first_word, r.places))
    assert sum(map(len, got.values())) > 60  # so the comparison is not about nothing
    for i, t in rows:
        assert sorted(got[i]) == sorted(_holds(t)), i


def test_tokens_equal_the_tokenizers_on_short_random_texts():
    whole, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokenizer(packing.tokenizer_path())
    letters = list("abTESIiİışŞÀéßΣσςΑǅﬁ漢字한שקָ،क़½²ªÅ") + list(" \n\t.,!?'’—…”-_#01") + ["́", "̇", "​", " ", "　", "😀"]
    rng = random.Random(9)
    for _ in range(200):
        some = ["".join(rng.choices(letters, k=rng.randint(1, 14))) for _ in range(200)]
        for t, (got, _), want in zip(some, words.encode_all(some), whole.encode_batch(some, add_special_tokens=False)):
            assert got.tolist() == want.ids, t


def test_special_tokens_are_those_in_lower_case():
    whole, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokenizer(packing.tokenizer_path())
    for t in ["<|ENDOFTEXT|> X", "A <|EndOfText|>.", "é<|ENDOFTEXT|>", "<|STARTOFTEXT|>", "<|endoftext|> X", "a<|startoftext|>B. C"]:
        assert words.encode(t)[0].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_coding_looks_up_each_word_once_however_often_it_stands(monkeypatch):
    words = packing.WordTokenizer(packing.tokenizer_path())
    looked_up, numbered = [], words._numbered
    monkeypatch.setattr(words, "_numbered", lambda some: (looked_up.extend(some), numbered(some))[1])
    rng = random.Random(3)
    some = [" ".join(rng.choices(["one", "Two.", "three,", "çà", "a1", "(b)"], k=200)) for _ in range(100)]
    got = words.encode_all(["", *some, "", "new words!"])
    assert len(looked_up) < 100  # of 20,000
    whole = Tokenizer.from_file(packing.tokenizer_path())
    assert [ids.tolist() for ids, _ in got] == [whole.encode(t, add_special_tokens=False).ids for t in ["", *some, "", "new words!"]]
    for t, (ids, ends) in zip(some, got[1:]):
        parts = t.split("Two.")
        want = [len(whole.encode("Two.".join(parts[:i]) + "Two.", add_special_tokens=False).ids) for i in range(1, len(parts))]
        assert ends.tolist() == want


def test_a_full_memory_forgets_the_rare_words_only():
    words = packing.WordTokenizer(packing.tokenizer_path(), kept=30)
    learned, learn = [], words._learn
    words._learn = lambda fresh: (learned.extend(fresh), learn(fresh))[1]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    often = [f"{w}{m}" for w in ("one", "çà", "a1", "Σας") for m in ("", ".", "!?")]
    for k in range(40):
        some = [" ".join(often), f"rare{chr(97 + k % 26)}{k}x. one. x{'y' * k}", "one."]
        got = words.encode_all(some)
        for t, (ids, ends) in zip(some, got):
            want = [whole.encode(w, add_special_tokens=False).ids for w in t.split(" ")]
            assert ids.tolist() == sum(want, [])
            assert ends.tolist() == [sum(map(len, want[: i + 1])) for i, w in enumerate(t.split(" ")) if w[-1] in ".!?"]
        assert len(words.number) < 50
    assert learned.count("one.") == 1 and len(learned) > 80


def _plain_cost(places, penalties, window):
    best = [0.0]
    for j in range(1, len(places)):
        best.append(penalties[j] + min(best[i] + window - places[j] + places[i] for i in range(j) if places[j] - places[i] <= window))
    return best[-1]


def test_cuts_cost_no_more_than_a_plain_search_finds():
    rng = random.Random(5)
    by_runs = []
    for n, step, window, most in [(2000, 30, 4096, 48), (2000, 96, 4096, 48), (300, 90, 100, 48), (300, 9, 12, 5), (300, 9, 12, 40), (300, 5, 5, 3), (1, 1, 9, 0)]:
        places = [0]
        while len(places) < n:
            places.append(places[-1] + rng.randint(1, step))
        penalties = [0, *rng.choices([0, most // 12, most], k=n - 1)]
        by_runs.append(packing._cuts_by_runs(np.array(places), np.array(penalties), window) is not None)
        cuts = packing.best_cuts(places, penalties, window)
        ends = [0, *[places[c] for c in cuts]]
        assert ends[-1] == places[-1] and all(0 < b - a <= window for a, b in zip(ends, ends[1:]))
        assert sum(window - b + a for a, b in zip(ends, ends[1:])) + sum(penalties[c] for c in cuts) == _plain_cost(places, penalties, window)
        back = packing._queued_cuts(places, penalties, window)
        want, j = [], n - 1
        while j:
            want, j = [j, *want], back[j]
        assert cuts == want
    assert by_runs[0] and not all(by_runs)


def test_places_of_cuts_equal_a_plain_walk():
    rng = random.Random(6)
    for _ in range(200):
        docs = []
        for k in range(rng.randint(1, 6)):
            n = rng.choice([1, 2, 50, 96, 97, 400])
            first = rng.randrange(n) if k == 0 else 0
            docs.append((k, np.zeros(n, np.uint32), first, np.array(sorted(rng.sample(range(n + 1), rng.randint(0, min(n, 5)))), np.int64)))
        places, penalties, base = [0], [0], 0
        for _, ids, first, ends in docs:
            for p in [*(e for e in ends.tolist() if first < e < len(ids)), len(ids)]:
                while base + p - first - places[-1] > packing.HARD_STEP:
                    places.append(places[-1] + packing.HARD_STEP)
                    penalties.append(packing.HARD_PENALTY)
                places.append(base + p - first)
                penalties.append(packing.SENTENCE_PENALTY if p < len(ids) else 0)
            base += len(ids) - first
        got = packing._places(docs)
        assert (got[0].tolist(), got[1].tolist()) == (places, penalties)


def _plain_probability(forest, row):
    """One row walked down one tree after the other."""
    margin = forest.base
    for f, t, left, v in zip(forest.feature, forest.threshold, forest.left, forest.value):
        node = 0
        while f[node] >= 0 and left[node] != node:
            node = left[node] + (row[f[node]] > t[node])
        margin += v[node]
    return 1 / (1 + np.exp(-margin))


def test_flattened_trees_equal_a_plain_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(400, 6)).round(1)  # ties
    y = ((x[:, 0] + x[:, 1] * x[:, 2] > 0.3) ^ (rng.random(400) < 0.1)).astype(float)
    forest = boosting.train(x, y, trees=20)
    assert np.allclose(forest.probability(x), [_plain_probability(forest, r) for r in x])


def test_a_tree_takes_the_best_split():
    """One tree of depth 1 against every split of every feature."""
    rng = np.random.default_rng(6)
    x = rng.integers(0, 12, size=(200, 3)).astype(float)
    y = ((x[:, 1] > 6) ^ (rng.random(200) < 0.2)).astype(float)
    forest = boosting.train(x, y, trees=1, depth=1)
    p = (y.sum() + 0.5) / 201
    grad, hess = y - p, np.full(200, p * (1 - p))
    best = max(((grad[m].sum() ** 2 / (hess[m].sum() + 1) + grad[~m].sum() ** 2 / (hess[~m].sum() + 1)), f, e) for f in range(3) for e in np.arange(0.5, 11) for m in [x[:, f] <= e] if 5 <= m.sum() <= 195)
    assert (forest.feature[0, 0], forest.threshold[0, 0]) == (best[1], best[2])


def test_isotonic_is_the_least_squares_ascent():
    rng = np.random.default_rng(8)
    score = rng.normal(size=60).round(1)
    y = (rng.random(60) < 1 / (1 + np.exp(-2 * score))).astype(float)
    xs, ys = boosting.isotonic(score, y)
    values = np.unique(score)
    mean, weight = np.array([y[score == v].mean() for v in values]), np.array([(score == v).sum() for v in values])
    force = [max(min((mean[a : b + 1] * weight[a : b + 1]).sum() / weight[a : b + 1].sum() for b in range(i, len(values))) for a in range(i + 1)) for i in range(len(values))]
    assert np.allclose(np.interp(values, xs, ys), force)


def test_nearest_probes_a_part_of_the_lists(spark, monkeypatch):
    monkeypatch.setattr(ann, "ROWS_PER_LIST", 40)
    rng = np.random.default_rng(11)
    centers = rng.normal(size=(25, 24)) * 4
    x = np.concatenate([centers[rng.integers(0, 25, 1500)] + rng.normal(size=(1500, 24)), np.exp(rng.normal(size=(500, 1))) * rng.normal(size=(500, 24))])
    sample = ann.Index(x, float((x**2).sum(axis=1).max()), len(x))
    assert sample.probes < len(sample.centers)
    got = collections.defaultdict(set)
    for r in ann.search(spark.createDataFrame([(i, [float(v) for v in r], 1) for i, r in enumerate(x)], "vec_id long, embedding array<double>, list int")).collect():
        got[r.query_id].add(r.vec_id)
    hits = 0
    for q in range(0, 2000, 20):
        s = x @ x[q]
        hits += len(got[q] & set([i for i in np.argsort(-s, kind="stable") if i != q][:20]))
    assert hits >= 0.9 * 20 * 100


def test_of_equal_vectors_enough_are_kept():
    rng = np.random.default_rng(12)
    x = rng.integers(0, 2, size=(400, 2)).astype(float)
    ids = rng.integers(0, 12, size=400)
    order = np.argsort(ids, kind="stable")
    x, ids = x[order], ids[order]
    kept = ann._needed(ids, x, 5)
    for own in range(12):
        for v in np.unique(x, axis=0):
            of = lambda rows: [i for i in rows if ids[i] != own and (x[i] == v).all()]  # noqa: E731, B023
            assert [ids[i] for i in of(range(400))][:5] == [ids[i] for i in of(kept)][:5]


TABLES = "documents labels embeddings conversations".split()


@pytest.fixture(scope="module")
def empty_tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("empty")
    for t in TABLES:
        spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet").limit(0).write.parquet(f"{at}/{t}.parquet")
    return str(at)


def test_all_queries_on_empty_tables(spark, empty_tables):
    from textquarry.llm import queries

    for name, query in {**queries.QUERIES, "pipeline": corpus_pipeline.run}.items():
        assert query(spark, empty_tables).count() == 0, name


def test_pipeline_stages_against_plain_versions(spark, tmp_path):
    """Each stage on its own input, awkward rows among it."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    more = docs.filter("doc_id < 6").withColumn("doc_id", F.lit(None).cast("long")).unionByName(docs.filter("doc_id BETWEEN 10 AND 14"))
    more = more.unionByName(docs.filter("doc_id = 20").withColumn("text", F.lit(None).cast("string"))).unionByName(docs.filter("doc_id = 21").withColumn("text", F.lit("")))
    sf = str(tmp_path / "sf")
    docs.unionByName(more).coalesce(2).write.parquet(f"{sf}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.001/labels.parquet").write.parquet(f"{sf}/labels.parquet")
    now, seen = spark.read.parquet(f"{sf}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before = now.collect()
        now = common.durable(stage(spark, now, sf))
        seen[name] = (before, now.collect())
        if name != "packing":
            assert now.columns == docs.columns
    shown = lambda rows: collections.Counter((r.doc_id, r.text) for r in rows)

    before, after = seen["toxicity"]
    df = spark.read.parquet(f"{sf}/documents.parquet")
    model = toxicity.fit(df, spark.read.parquet(f"{sf}/labels.parquet"))
    rejected = [float(model.probability(model.features(pd.Series([r.text], dtype=object)))[0]) >= 0.3 for r in before]
    assert shown(after) == shown(r for r, gone in zip(before, rejected) if not gone)

    before, after = seen["exact_dedup"]
    best = {}
    for r in before:
        key = re.sub(r"[\x20\x09-\x0D]", "", r.text or "")
        rank = (-len(r.text or ""), r.doc_id is None, r.doc_id or 0)
        best[key] = min(best.get(key, (rank,)), (rank,))
    assert collections.Counter(re.sub(r"[\x20\x09-\x0D]", "", r.text or "") for r in after) == collections.Counter(list(best))
    assert all(best[re.sub(r"[\x20\x09-\x0D]", "", r.text or "")][0] == (-len(r.text or ""), r.doc_id is None, r.doc_id or 0) for r in after)

    before, after = seen["simhash_near_dedup"]
    fps = [simhash.fingerprint(r.text) for r in before]
    root = {f: f for f in fps}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for a in root:
        for b in root:
            if a < b and (a ^ b).bit_count() <= 3:
                root[max(find(a), find(b))] = min(find(a), find(b))
    groups = collections.defaultdict(list)
    for r, f in zip(before, fps):
        groups[find(f)].append(r)
    least = {f: min(rows, key=lambda r: (r.doc_id is None, r.doc_id or 0)).doc_id for f, rows in groups.items()}
    assert collections.Counter(find(simhash.fingerprint(r.text)) for r in after) == collections.Counter(list(groups))
    assert all(least[find(simhash.fingerprint(r.text))] == r.doc_id for r in after)

    before, after = seen["mixing"]
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = collections.Counter()
    for r in before:
        sizes[r.source] += words(r.text)
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:  # reshare what the capped ones can't take
        left = sum(sizes.values()) - sum(target.values())
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > 3 * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = 3 * sizes[s]
            open_.discard(s)
    taken = collections.Counter()
    for r in after:
        taken[r.source] += words(r.text)
    for s in order:  # some ten documents a source, of very unequal sizes: where the miss is large, no other one document makes it smaller
        miss, mine = abs(taken[s] - target[s]), [r for r in before if r.source == s]
        copies, whole = shown(after), int(target[s] // sizes[s])
        left = [words(r.text) for r in mine if copies[r.doc_id, r.text] <= whole]
        assert miss <= 0.1 * target[s] or all(abs(taken[s] + w - target[s]) >= miss for w in left), (s, taken[s], target[s])
    assert all(n <= 3 * shown(before)[k] for k, n in shown(after).items())

    before, after = seen["packing"]
    whole = Tokenizer.from_file(packing.tokenizer_path())
    tokens = collections.Counter()
    for r in before:
        tokens[r.doc_id] += len(whole.encode(r.text or "", add_special_tokens=False).ids) + 1
    packed = collections.Counter()
    for r in after:
        packed[r.doc_id] += r.length
    assert packed == tokens
    windows = collections.Counter()
    for r in after:
        windows[r.sequence_id] += r.length
    assert max(windows.values()) <= 4096
