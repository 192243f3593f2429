"""Small fixtures with every awkward case, against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from textquarry.llm import ann, boosting, chat, common, exact_dedup, licenses, mixing, packing, quality, sharding, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, size long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "Gamma", "delta.", "epsilon", "zeta!", "eta", "théta", "iota", "kappa"]
    base = " ".join(rng.choices(words, k=120))
    texts = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(60)]
    texts += [None, "", "  \n\t", base, base, base + " ", base.replace(" ", "\n", 3), base + " iota", "word " * 30000, "Released under the MIT License. " + texts[0]]
    texts += ["copy of a copy"] * 40
    rows = [(i, t, "en", f"s{i % 4}" if i % 9 else None, 0, "x", 1) for i, t in enumerate(texts)]
    rows += [(3, texts[3], "en", "s3", 0, "x", 1), (None, "no id", "en", "s1", 0, None, None), (None, "copy of a copy", None, "s1", None, None, None)]
    return common.durable(spark.createDataFrame(rows, SCHEMA).repartition(3))


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_mph_is_minimal_and_perfect():
    digests = [hashlib.sha256(str(i).encode()).digest() for i in range(3000)]
    sizes, bits, slot = exact_dedup.build_mph(digests)
    assert sorted(slot) == list(range(3000))
    assert (exact_dedup.lookup_mph(sizes, bits, digests) == slot).all()
    assert exact_dedup.build_mph([])[0] == []


def test_exact_dedup(docs, none):
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]", "", r.text or ""), len(r.text or "")) for r in docs.collect()]
    got = exact_dedup.classes(docs).collect()
    assert len(got) == len(rows)
    best, size = {}, {}
    for i, t, n in rows:
        size[t] = size.get(t, 0) + 1
        best[t] = max(best.get(t, (-1, 0, 0)), (n, i is not None, -(i or 0)))
    by = {hashlib.sha256(t.encode()).hexdigest(): t for t in size}
    for r in got:
        t = by[r.text_sha256]
        assert r.group_size == size[t] and r.keep_id == (-best[t][2] if best[t][1] else None)
    assert sum(r.kept for r in got) == len(size)
    kept = exact_dedup.deduplicated(docs)
    assert kept.columns == docs.columns and kept.count() == len(size)
    assert exact_dedup.classes(none).count() == exact_dedup.deduplicated(none).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    k = min(3, len(words))
    h = [xxhash.xxh64_intdigest(" ".join(words[i : i + k]).encode(), 42) for i in range(len(words) - k + 1)] if words else []
    return sum(1 << b for b in range(64) if sum(x >> b & 1 for x in h) * 2 > len(h))


def brute_components(fps):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in fps:
        for b in fps:
            if a < b and (a ^ b).bit_count() <= 3:
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {f: find(f) for f in fps}


def test_simhash(docs, none):
    rows = [(r.doc_id, brute_fingerprint(r.text)) for r in docs.collect()]
    roots = brute_components({f for _, f in rows})
    least = {}
    for i, f in rows:
        if i is not None:
            least[roots[f]] = min(least.get(roots[f], 1 << 60), i)
    got = simhash.classes(docs).collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.fp % (1 << 64), r.component_id) for r in got) == sorted((i if i is not None else -1, f, least.get(roots[f])) for i, f in rows)
    assert simhash.classes(none).count() == simhash.deduplicated(none).count() == 0


def test_simhash_keeps_one_row_of_each_group_with_repeated_and_null_ids(spark):
    one, two, three = ("ab cd ef gh", "red green blue sky", "stone river house walk")
    rows = [(1, one), (2, one.upper()), (2, two), (None, three), (None, three.upper()), (None, two + " "), (7, one), (7, one), (None, None), (None, "")]
    rows += [(9, "a single row twice"), (9, "a single row twice")]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    got = [(r.doc_id, (r.text or "").lower().strip()) for r in kept.collect()]
    want = [(1, one), (2, two), (9, "a single row twice"), (None, three), (None, "")]
    assert kept.columns == ["doc_id", "text"] and sorted(got, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("longest", [4096, 8])
def test_simhash_lists_longer_than_a_task_takes(spark, longest):
    rng = random.Random(5)
    fps = {rng.getrandbits(64) for _ in range(40)}
    for center in list(fps)[:4]:  # dense groups: few bits differ, many lists are shared
        fps |= {center ^ (1 << rng.randrange(24)) ^ (1 << rng.randrange(24)) for _ in range(60)}
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    df = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
    found = {r.node: r.root for r in common.components(common.durable(simhash.links(df, longest))).collect()}
    want = brute_components(fps)
    groups = lambda of: sorted(sorted(signed(f) for f in fps if of(f) == r) for r in {of(f) for f in fps})
    assert groups(lambda f: want[f]) == groups(lambda f: found.get(signed(f), signed(f)))


def test_simhash_joins_never_gather_the_corpus_at_the_driver(spark, monkeypatch):
    plans, write = [], common.durable

    def noted(df):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return write(df)

    for module in (simhash, common):
        monkeypatch.setattr(module, "durable", noted)
    monkeypatch.setattr(common, "BROADCAST_ROWS", 1, raising=False)
    words = [f"w{i}" for i in range(300)]
    texts = [" ".join([*words[:at], "other", *words[at:]]) for at in range(0, 300, 50)] + [" ".join(words[::-1]), "alone", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    made = simhash.classes(docs)
    plans.append(made._jdf.queryExecution().optimizedPlan().toString())
    want = brute_components({brute_fingerprint(t) for t in texts})
    least = {}
    for i, t in enumerate(texts):
        least.setdefault(want[brute_fingerprint(t)], i)
    assert len(least) < len(texts) - 2
    assert {r.doc_id: r.component_id for r in made.collect()} == {i: least[want[brute_fingerprint(t)]] for i, t in enumerate(texts)}
    assert {r.doc_id for r in simhash.deduplicated(docs).collect()} == set(least.values())
    joins = [line for plan in plans for line in plan.split("\n") if re.search(r"\bJoin (Inner|LeftOuter)", line)]
    assert len(joins) >= 8 and all("strategy=merge" in line for line in joins), joins


def test_sharding(docs, none):
    got = sharding.shards_of(docs, 8).collect()
    rows = docs.collect()
    assert len(got) == len(rows) and sum(r.size for r in got) == sum(len((r.text or "").encode()) + 1 for r in rows)
    for s in range(8):
        slots = sorted(r.slot for r in got if r.shard == s)
        assert slots == list(range(len(slots)))
    crc = {r.doc_id: zlib.crc32((r.text or "").encode()) for r in rows if r.doc_id is not None}
    assert all(r.text_crc32 == crc[r.doc_id] for r in got if r.doc_id is not None)
    assert sharding.shards_of(none, 8).count() == 0


def test_shards_are_even(spark):
    rng = random.Random(1)
    df = spark.createDataFrame([(i, "x" * rng.randint(1, 400)) for i in range(4000)] + [(i, "hot") for i in range(4000, 6000)], "doc_id long, text string")
    sizes = {}
    for r in sharding.shards_of(df, 8).collect():
        sizes[r.shard] = sizes.get(r.shard, 0) + r.size
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 8 + 800


def test_mixing(docs, none):
    got = mixing.mixed(docs).collect()
    assert len(got) == docs.count() and all(0 <= r.copies <= 3 for r in got)
    taken, target = {}, {}
    for r in got:
        taken[r.source] = taken.get(r.source, 0) + r.size * r.copies
        target[r.source] = r.target
        assert r.target <= 3 * r.source_size + 1e-9
    assert abs(sum(target.values()) - sum(r.size for r in got)) < 1e-6
    assert mixing.mixed(docs).exceptAll(mixing.mixed(docs)).count() == 0
    assert mixing.mix(docs).columns == docs.columns and mixing.mix(docs).count() == sum(r.copies for r in got)
    assert mixing.mixed(none).count() == mixing.mix(none).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(packing.tokenizer_path())
    got = packing.pack(docs.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), packing.tokenizer_path(), window=256, block=2000).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 256
    texts = {r.doc_id: r.text for r in docs.collect()}
    for i in {r.doc_id for r in got}:
        ids = np.array([*(whole.encode(texts[i] or "", add_special_tokens=False).ids), 2], "<u4")
        at = 0
        for r in sorted((r for r in got if r.doc_id == i), key=lambda r: r.start):
            assert r.start == at and r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    assert packing.pack(none, packing.tokenizer_path()).count() == 0
    assert packing.pack(docs, packing.tokenizer_path()).agg(F.sum("length")).first()[0] > 0


def test_tokens_equal_the_tokenizers():
    from tokenizers import Tokenizer

    whole, words = Tokenizer.from_file(packing.tokenizer_path()), packing.WordTokenizer(packing.tokenizer_path(), kept=20)
    for t in ["a", "don't I'll we've abc's' x''s", "J̌ Á ΑΣ Σ. İstanbul ﬁ", "a　b c\x1cd\te\r\nf", "<|endoftext|> x", "12a3.4 a1.", "שָׁלוֹם, עולם!", "😀!! 漢字。", "ABC.DEF. abc...!!! ***", "क़ ª²½.", "  "]:
        assert words.encode(t)[0].tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_best_cuts_are_optimal():
    rng = random.Random(2)
    for _ in range(30):
        places = [0]
        while len(places) < 11:
            places.append(places[-1] + rng.randint(1, 9))
        penalties = [rng.choice([0, 2, 5]) for _ in places]
        cost = lambda cuts: sum(12 - (b - a) for a, b in zip([0, *[places[c] for c in cuts]], [places[c] for c in cuts])) + sum(penalties[c] for c in cuts)
        ok = lambda cuts: all(b - a <= 12 for a, b in zip([0, *[places[c] for c in cuts]], [places[c] for c in cuts]))
        every = [[i for i in range(1, 10) if m >> i & 1] + [10] for m in range(0, 1 << 10, 2)]
        assert cost(packing.best_cuts(places, penalties, 12)) == min(cost(c) for c in every if ok(c))


def test_forest_learns_and_isotonic_ascends():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    forest = boosting.train(x[:1500], y[:1500])
    assert ((forest.probability(x[1500:]) > 0.5) == y[1500:]).mean() > 0.95
    xs, ys = boosting.isotonic(forest.margin(x), y)
    assert (np.diff(ys) >= 0).all() and (np.diff(xs) >= 0).all()
    assert np.allclose(boosting.train(x[:3], np.ones(3)).probability(x[:3]), 0.875)


def test_classifiers(spark, docs, none):
    rng = random.Random(4)
    plain = ["the", "house", "river", "stone", "walks", "slowly"]
    rows, labels = [], []
    for i in range(600):
        words = rng.choices(plain, k=60)
        bad = i % 6 == 0
        if bad:
            words[5], words[30] = "idiot", "you"
        junk = i % 5 == 0
        text = " ".join(words) + "."
        rows.append((i, text.upper().replace(" ", "!! ") if junk else text))
        labels.append((i, int(not junk), int(bad)))
    df, lab = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    truth = {i: (q, t) for i, q, t in labels}
    scores = toxicity.scores(df, lab).collect()
    held = [r for r in scores if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in scores) and all(r.predicted == truth[r.doc_id][1] for r in held)
    from textquarry.llm.scoring import remainder, scored

    forest = quality.fit(df, lab)
    made = scored(df, quality.features, forest.probability, remainder("doc_id", 5) == 0).collect()
    assert all(r.predicted == truth[r.doc_id][0] for r in made)
    assert all(0 <= r.score <= 1 for r in scored(docs, quality.features, forest.probability, remainder("doc_id", 5) == 0).collect())
    assert toxicity.scores(docs, lab.limit(0)).count() == docs.count() and toxicity.clean(none, lab).count() == 0


def test_nearest(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(400, 8))
    x[100:220] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(900, None), (920, [0.0] * 8), (940, [float("nan")] * 8), (960, [None] * 8), (980, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(df).collect()
    hits = 0
    for q in range(0, 400, 20):
        s = (x * x[q]).sum(axis=1)
        order = [i for i in np.lexsort((np.arange(400), -s)) if i != q][:20]
        mine = sorted((r for r in got if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in mine] == list(range(1, 21)) and all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in mine)
        hits += len({r.vec_id for r in mine} & set(order))
    assert hits >= 0.9 * 400 and {r.query_id for r in got} == set(range(0, 400, 20))
    assert ann.search(df.limit(0)).count() == 0


def _nearest_by_force(ids, x, q):
    s = (x * x[q]).sum(axis=1)
    return [(int(ids[i]), s[i]) for i in np.lexsort((ids, -s)) if ids[i] != ids[q]][:20]


def test_nearest_in_many_tiles_and_query_groups(spark, monkeypatch):
    """One vector fills a third of the table and one id repeats; tiles and groups are far smaller than usual."""
    monkeypatch.setattr(ann, "TILE", 40)
    monkeypatch.setattr(ann, "QUERIES", 7)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(600, 12))
    x[::3] = x[0]
    ids = np.arange(600)
    ids[1:5] = 1
    df = spark.createDataFrame([(int(i), [float(v) for v in r]) for i, r in zip(ids, x)], "vec_id long, embedding array<double>")
    got = ann.search(df).collect()
    hits, queries = 0, [i for i in range(600) if ids[i] % 20 == 0]
    for q in queries:
        mine = [(r.vec_id, r.score) for r in sorted((r for r in got if r.query_id == ids[q]), key=lambda r: r.rank)]
        want = _nearest_by_force(ids, x, q)
        assert len(mine) == 20 and mine == sorted(mine, key=lambda r: (-r[1], r[0]))
        if q % 3 == 0 and want[0][1] == want[-1][1]:  # all ties: the smallest ids
            assert [r[0] for r in mine] == [r[0] for r in want]
        hits += len({r[0] for r in mine} & {r[0] for r in want})
    assert hits >= 0.9 * 20 * len(queries) and len(got) == 20 * len(queries)


def test_tiles_hold_small_lists_and_split_large_ones(monkeypatch):
    monkeypatch.setattr(ann, "TILES_LEAST", 4)
    first, blocks = ann.tiles(np.array([5, 0, 10, 100, 20, 25]))
    assert first.tolist() == [0, 0, 0, 1, 4, 5] and blocks.tolist() == [1, 1, 1, 3, 1, 1]


@pytest.mark.parametrize("chunk", [7, 512])
def test_scan_without_abandoning_is_exact(monkeypatch, chunk):
    monkeypatch.setattr(ann, "EPSILON", 1e9)
    monkeypatch.setattr(ann, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(300, 40))
    x[50:150] = x[50]
    ids = rng.permutation(300)
    index = ann.Index(x, float((x**2).sum(axis=1).max()), len(x))
    lists = index.distances(index.rotated(x)).argmin(axis=1)
    at = np.arange(0, 300, 10)
    got = ann.scan(index, ids, x, lists, ids[at], x[at], np.ones((len(at), len(index.centers)), bool))
    for q in at:
        mine = got[got.query_id == ids[q]]
        assert mine.vec_id.tolist() == [i for i, _ in _nearest_by_force(ids, x, q)]


def test_licenses(docs, none):
    rows = licenses.scan(docs).collect()
    assert [(r.license, r.matched, r.first_word) for r in rows] == [("MIT", 1, 0)]
    assert licenses.scan(none).count() == 0


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_every_license_line_of_the_tables_has_a_template(spark, sf):
    docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet")
    lines = docs.select(F.explode(F.split("text", "\n")).alias("text"))
    found = lines.filter(F.lower("text").rlike(r"\blicen[cs]ed?\b")).distinct().collect()
    lines = spark.createDataFrame([(i, r.text) for i, r in enumerate(found)], "doc_id long, text string")
    matched = {r.doc_id for r in licenses.scan(lines).collect()}
    assert found and [r.text for i, r in enumerate(found) if i not in matched] == []


def test_short_creative_commons_lines_are_told_apart(spark):
    kinds = ["BY", "BY-SA", "BY-ND", "BY-NC", "BY-NC-SA", "BY-NC-ND"]
    lines = spark.createDataFrame([(i, f"words before\nLicensed under CC {k} 4.0.\nwords after") for i, k in enumerate(kinds)], "doc_id long, text string")
    assert sorted((r.doc_id, r.license) for r in licenses.scan(lines).collect()) == [(i, f"CC-{k}-4.0") for i, k in enumerate(kinds)]


def test_chat(spark):
    calls = spark.createDataFrame(
        [("a", 1, "reply", '{"turn": 1, "question": "x"}', None), ("b", 2, "reply", '{"question": 3, "turn": 1, "zz": 0}', "a"), ("c", 3, "other", "{}", "c"), ("a", 9, "reply", "[1]", None), (None, 4, "reply", None, None), ("d", 5, "reply", '{"turn": 1}', "b")],
        "call_id string, turn long, tool string, arguments string, needs string",
    )
    results = spark.createDataFrame([("a", 0, "r"), ("zz", 3, "s"), (None, 4, "t")], "call_id string, turn long, text string")
    made, answers = chat.linked(calls, results)
    by = {(r.call_id, r.turn): r for r in made.collect()}
    assert by["a", 1].errors == [] and by["a", 1].answered and by["a", 1].depth == 0
    assert by["b", 2].errors == ["`question` must be string", "unknown `zz`"] and by["b", 2].depth == 1 and by["d", 5].depth == 2
    assert by["c", 3].errors == ["unknown tool"] and by["c", 3].depth is None  # it needs itself
    assert by["a", 9].errors == ["arguments are no JSON object", "repeated identifier"]
    assert by[None, 4].errors == ["arguments are no JSON object"]
    assert {r.call_id: r.place for r in answers.collect()} == {"a": 1, "zz": None, None: None}
    one = spark.range(1).select(F.lit('{"b": 1, "a": {"z": null, "c": [1, 2]}}').alias("j"))
    assert one.select(chat.canonical("j")).first()[0] == '{"a":{"c":[1,2],"z":null},"b":1}'


def test_chat_follows_long_chains_and_proves_circles(spark):
    pairs = [(f"c{i}", f"c{i - 1}" if i else None) for i in range(40)] + [("x", "y"), ("y", "z"), ("z", "x"), ("w", "x"), ("v", "gone")]
    calls = spark.createDataFrame([(c, i, "reply", "{}", n) for i, (c, n) in enumerate(pairs)], "call_id string, turn long, tool string, arguments string, needs string")
    made, _ = chat.linked(calls, spark.createDataFrame([], "call_id string, turn long, text string"))
    want = {f"c{i}": i for i in range(40)} | {"x": None, "y": None, "z": None, "w": None, "v": 0}
    assert {r.call_id: r.depth for r in made.collect()} == want


def test_chat_places_a_call_after_a_later_result_that_it_needs(spark):
    calls = spark.createDataFrame([("a", 2, "reply", "{}", "b"), ("b", 5, "reply", "{}", None), ("c", 3, "reply", "{}", "a"), ("d", 9, "reply", "{}", "c"), ("e", 4, "reply", "{}", "e")], "call_id string, turn long, tool string, arguments string, needs string")
    results = spark.createDataFrame([(c, t) for c, t in (("a", 3), ("b", 6), ("c", 4), ("d", 10), ("e", 5))], "call_id string, turn long")
    made, answers = chat.linked(calls, results)
    rows = [(r.place, r.depth, 0, r.turn, r.call_id) for r in made.collect()] + [(r.place, r.depth, 1, r.turn, r.call_id) for r in answers.collect()]
    assert [(r[4], r[2]) for r in sorted(r for r in rows if r[0] is not None)] == [(c, k) for c in "bacd" for k in (0, 1)]
    assert {r[4] for r in rows if r[0] is None} == {"e"}  # it needs itself


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    pieces = corpus_pipeline.run(spark, sf)
    assert 3 < len(corpus_pipeline.STAGES) < 6 and pieces.count() > 0
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, sf).columns == docs.columns
