"""Operators 2, 3, 6, 8 and 9 and the pipeline against brute force."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from conftest import SMALL
from pyspark.sql import functions as F
from test_text_operators import LONG, ODD, docs

import corpus_pipeline
from ledgerlens.llm import ann, mixing, pitman_yor, quality, simhash_dedup, token_store
from ledgerlens.llm.common import checkpoint_dealt, drop_unused, sample_hash, table
from ledgerlens.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path

# ---------------------------------------------------------------- 2


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit("x")).withColumn("v", F.lit(1))


def brute(rows, queries, top):
    v = {i: np.array(x, np.float32).astype(float) for i, x in rows}
    return {q: sorted(((-float(np.sum(v[q] * x)), i) for i, x in v.items() if i != q))[:top] for q in queries}


def test_neighbours_of_clustered_vectors(spark):
    rnd = np.random.default_rng(3)
    centres = rnd.normal(size=(12, 16)) * 2
    x = centres[rnd.integers(0, 12, 3000)] + rnd.normal(size=(3000, 16)) * rnd.uniform(0.3, 1.5, (3000, 1))
    rows = [(i, [float(a) for a in v]) for i, v in enumerate(x)]
    df = vectors(spark, rows)
    got = ann.nearest(df, df.where("vec_id % 20 = 0"), list_rows=32).collect()
    want = brute(rows, range(0, 3000, 20), 20)
    by = {}
    for r in got:
        by.setdefault(r.query_id, []).append(r)
    assert set(by) == set(want)
    recall = np.mean([len({i for _, i in want[q]} & {r.vec_id for r in rs}) / 20 for q, rs in by.items()])
    assert recall >= 0.9
    for q, rs in by.items():
        rs.sort(key=lambda r: r["rank"])
        assert [r["rank"] for r in rs] == list(range(1, 21)) and q not in {r.vec_id for r in rs}
        assert all(a.score > b.score or a.score == b.score and a.vec_id < b.vec_id for a, b in zip(rs, rs[1:], strict=False))


def test_copies_ties_and_unusable_vectors(spark):
    rows = [(i, [1.0, 0.5]) for i in range(100)] + [(100 + i, [float(i), 1.0]) for i in range(10)]
    bad = [(500, None), (501, [0.0, 0.0]), (502, [1.0, None]), (503, [1.0, math.nan]), (504, [math.inf, 1.0]), (505, [1.0]), (506, []), (None, [1.0, 1.0])]
    df = vectors(spark, rows + bad + rows[:3])
    got = ann.nearest(df, df.where("vec_id % 20 = 0 or vec_id is null or vec_id > 500"))
    want = {q: [i for _, i in r] for q, r in brute(rows, [0, 20, 40, 60, 80, 100], 20).items()}
    found = {}
    for r in got.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.vec_id)
    assert found == want
    assert ann.nearest(vectors(spark, []), vectors(spark, [])).count() == 0
    alone = vectors(spark, [(20, [1.0, 2.0])])
    assert ann.nearest(alone, alone).count() == 0


def test_ties_of_different_vectors_go_to_the_smaller_id(spark):
    # Half of 4,096 sign vectors tie, far more than any group's share of an answer.
    ids = random.Random(4).sample(range(1, 9000), 4096)
    rows = [(0, [1.0] + [0.0] * 11)] + [(ids[i], [1.0 if i >> b & 1 else -1.0 for b in range(12)]) for i in range(4096)]
    df = vectors(spark, rows)
    got = ann.nearest(df, df.where("vec_id = 0"), list_rows=5000).orderBy("rank").collect()
    assert [r.vec_id for r in got] == [i for _, i in brute(rows, [0], 20)[0]]


# ---------------------------------------------------------------- 3


def corpus(n=400, seed=6):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    out = []
    for i in range(n):
        at = rnd.randrange(300)
        words = [vocab[at]]
        for _ in range(rnd.randint(3, 60)):  # the next word mostly follows from the last
            at = (at * 7 + 3) % 300 if rnd.random() < 0.7 else rnd.randrange(300)
            words.append(vocab[at] if rnd.random() < 0.97 else f"new{rnd.randrange(10**6)}")
        out.append((i, " ".join(words).title(), "en", "s"))
    return out


def test_scores_base_and_held_out_perplexity(spark):
    rows = corpus() + [(1000, None, None, None), (1001, "", "en", "s"), (None, "W1 w2", "en", "s"), (5, corpus()[5][1], "en", "s")]
    got = pitman_yor.score_documents(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    learned = [r for r in rows if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2]
    c = Counter(w for r in learned for w in (r[1] or "").lower().split()) + Counter({"</s>": len(learned)})
    n, v = sum(c.values()), len(c)
    texts = {r[0]: (r[1] or "").lower().split() + ["</s>"] for r in rows}
    for r in got:
        t = texts[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(t), sum(c[w] > 0 for w in t), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t), rel=1e-9)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) * 0.8  # much better than the base
    again = {(r.doc_id, r.score) for r in pitman_yor.score_documents(docs(spark, rows)).collect()}
    assert again == {(r.doc_id, r.score) for r in got}


def test_words_seen_a_few_times_are_contexts(spark):
    # 20,000 words seen four times in 160,000 tokens, each before the same word.
    rnd = random.Random(8)
    pairs = [f"a{i} b{i}" for i in range(20_000)] * 4
    rnd.shuffle(pairs)
    rows = [(i, " ".join(pairs[i * 400:(i + 1) * 400]), "en", "s") for i in range(200)]
    held = [r for r in pitman_yor.score_documents(docs(spark, rows)).collect() if r.held_out]
    # Without contexts every word takes 4.6 or more.
    assert sum(r.score for r in held) / sum(r.n_tokens for r in held) > -3.2


def test_model_probabilities_sum_to_one():
    # The formulas of scoring on a small seating, over all words and one unknown.
    rng = np.random.default_rng(2)
    n_ctx, types = 4, 6
    count = rng.integers(0, 6, (types, n_ctx))
    word, ctx = np.nonzero(count)
    part = pitman_yor.Part(np.zeros(types, np.int32), word, ctx, count[word, ctx])
    sizes = np.array([count[:, c].sum() if c else 0 for c in range(n_ctx)])
    setting = pitman_yor.Setting(types, sizes, (0.4, 0.6))
    state = pitman_yor.State(np.array([0, *(count[:, 1:] > 0).sum(axis=0)]), int((count[:, 0] + (count[:, 1:] > 0).sum(axis=1)).sum()), types, np.empty(0))
    *_, (tables, customers, root_tables) = part.sweeps(3, setting, [state] * 5)
    now = pitman_yor.State(np.bincount(ctx, weights=tables, minlength=n_ctx), int(customers.sum()), int(root_tables.sum()), np.empty(0))
    p = setting.root_p(np.append(customers, 0), np.append(root_tables, 0), now)
    assert p.sum() == pytest.approx(1)
    for c in range(1, n_ctx):
        t = np.zeros(types + 1)
        t[word[ctx == c]] = tables[ctx == c]
        inner = (np.append(count[:, c], 0) - 0.6 * t + (pitman_yor.STRENGTH + 0.6 * now.context_tables[c]) * p) / (pitman_yor.STRENGTH + sizes[c])
        assert inner.sum() == pytest.approx(1) and (inner > 0).all()


def test_tables_keep_all_customers():
    rng = np.random.default_rng(0)
    c, a = np.array([0, 1, 2, 50, 1000]), np.full(5, 0.3)
    t = pitman_yor.Tables(c, a, c + 60, rng)

    def check(want):
        assert [t.sizes[x:x + n].sum() for x, n in zip(t.start, t.t, strict=True)] == want == t.c.tolist()
        assert all((t.sizes[x:x + n] > 0).all() for x, n in zip(t.start, t.t, strict=True)) and t.sizes.sum() == sum(want)

    for _ in range(20):
        t.sweep(a, 0.6, rng)
        check([0, 1, 2, 50, 1000])
    t.resize(np.array([3, 1, 0, 60, 990]), a, 0.6, rng)
    check([3, 1, 0, 60, 990])


def test_seating_matches_the_restaurant_rule():
    # Two customers, new-table weight a, discount d: they share a table with
    # probability (1 - d) / (1 - d + a).
    rng = np.random.default_rng(1)
    n, a, d = 4000, 0.7, 0.4
    t = pitman_yor.Tables(np.full(n, 2), np.full(n, a), np.full(n, 2), rng)
    together = []
    for s in range(40):
        t.sweep(np.full(n, a), d, rng)
        if s >= 10:
            together.append((t.t == 1).mean())
    assert np.mean(together) == pytest.approx((1 - d) / (1 - d + a), abs=0.01)


@pytest.mark.parametrize(("c", "a", "d"), [(300, 5.0, 0.6), (3000, 0.7, 0.6), (3000, 200.0, 0.5)])
def test_sweeps_reseat_dishes_of_many_customers(c, a, d):
    # P(t tables) ~ a^t S(c, t), from the recurrence of the Stirling numbers.
    row = np.zeros(c + 1)
    row[1], t = 1.0, np.arange(c + 1)
    for n in range(1, c):  # row t carries a^t
        row = np.append(0, row[:-1]) * a + np.maximum(n - d * t, 0) * row
        row /= row.max()
    p = row / row.sum()
    mean = (p * t).sum()
    sd = math.sqrt((p * (t - mean) ** 2).sum())
    rng = np.random.default_rng(3)
    n = 40
    dishes = pitman_yor.Tables(np.full(n, c), np.full(n, a), np.full(n, 1), rng)  # all at one table
    for _ in range(8):
        dishes.sweep(np.full(n, a), d, rng)
    got = []
    for _ in range(12):
        dishes.sweep(np.full(n, a), d, rng)
        got.append(dishes.t.copy())
    assert np.mean(got) == pytest.approx(mean, abs=0.35 * sd)
    assert np.std(got) == pytest.approx(sd, rel=0.25)


def test_scoring_odd_and_empty_tables(spark):
    got = pitman_yor.score_documents(docs(spark, ODD)).collect()
    assert len(got) == len(ODD) and all(math.isfinite(r.score) and math.isfinite(r.base_score) for r in got)
    assert pitman_yor.score_documents(docs(spark, [])).count() == 0
    none = pitman_yor.score_documents(docs(spark, [(None, "a b", "en", "s")])).collect()
    assert none[0].train_tokens == 0 and none[0].n_known == 0


# ---------------------------------------------------------------- 6


def test_features_without_values_count_once():
    rnd = np.random.default_rng(5)
    rows = [np.unique(rnd.integers(0, 500, 40)).astype(np.int32) for _ in range(300)]
    target = np.array([float((r < 50).any()) for r in rows])
    got = quality.train_linear([(r, None) for r in rows], target)
    want = quality.train_linear([(r.astype(np.int64), np.ones(len(r))) for r in rows], target)
    assert (got[0] == want[0]).all() and got[1] == want[1] and got[0].any()


def test_dealt_checkpoints_are_not_dealt_again(spark):
    left = checkpoint_dealt(spark.range(500).select((F.col("id") % 16).alias("part"), "id"), 16, "part")
    both = left.groupBy("part").cogroup(left.sparkSession.range(16).select(F.col("id").alias("part")).groupBy("part")) \
        .applyInArrow(lambda a, b: a.select(["id"]), "id long")
    text = both._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange") == 1  # of the other side alone
    assert both.count() == 500 and spark.conf.get("spark.sql.adaptive.enabled") == "true"


def test_unused_frames_are_let_go_at_once(spark):
    weak = spark.sparkContext._jvm.java.lang.ref.WeakReference(spark.range(3)._jdf)
    drop_unused(spark)
    assert weak.get() is None


def slow_simhash(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i:i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(prints, bits=3):
    keys = sorted(set(prints))
    root = {k: k for k in keys}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for i, a in enumerate(keys):
        for b in keys[i + 1:]:
            if (a ^ b).bit_count() <= bits:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {k: find(k) for k in keys}


def test_fingerprints_and_components_equal_brute_force(spark):
    rnd = random.Random(8)
    rows = []
    for i in range(120):
        words = [f"t{rnd.randrange(50)}" for _ in range(rnd.randint(0, 80))]
        rows.append((i, " ".join(words), "en", "s"))
        if i % 3 == 0 and len(words) > 30:
            rows += [(1000 + 10 * i + k, " ".join(words[:-1] + [f"x{k}"]), "en", "s") for k in range(4)]
    rows += [(5000, None, "en", "s"), (5001, "A b", "en", "s"), (5002, "a  B", "en", "s"), (5002, "a  B", "en", "s"), (None, "a b", "en", "s"), (5003, LONG, "en", "s")]
    got = simhash_dedup.dedup_components(docs(spark, rows)).collect()
    prints = {(r[0], r[1]): slow_simhash(r[1] or "") for r in rows}
    assert Counter((r.doc_id, r.fp % 2**64) for r in got) == Counter((r[0], prints[r[0], r[1]]) for r in rows)
    root = components(prints.values())
    least = {}
    for (d, _), p in prints.items():
        if d is not None:
            least[root[p]] = min(d, least.get(root[p], d))
    assert all(r.component_id == least[root[r.fp % 2**64]] for r in got)
    kept = simhash_dedup.keep_one(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted(least.values())
    assert kept.where("doc_id is null").count() == 1
    assert simhash_dedup.dedup_components(docs(spark, [])).count() == 0 and simhash_dedup.keep_one(docs(spark, [])).count() == 0


@pytest.mark.parametrize("cell_rows", [20_000, 8])
def test_grid_join_loses_no_link(spark, cell_rows):
    # A dense cluster and pairs at every distance; small blocks deal hot cells.
    rnd = random.Random(4)
    prints = set()
    for _ in range(60):
        a = rnd.getrandbits(64)
        prints.add(a)
        for _ in range(4):
            for bit in rnd.sample(range(64), rnd.randint(1, 5)):
                a ^= 1 << bit
            prints.add(a)
    centre = rnd.getrandbits(64)
    prints |= {centre ^ (1 << rnd.randrange(64)) ^ (1 << rnd.randrange(64)) for _ in range(150)}
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    df = spark.createDataFrame([(signed(p),) for p in prints], "fp long")
    links = [(r.a % 2**64, r.b % 2**64) for r in simhash_dedup.fingerprint_links(df, cell_rows=cell_rows).collect()]
    assert all(0 < (a ^ b).bit_count() <= 3 for a, b in links)
    want = components(prints)
    root = {p: p for p in prints}

    def find(a):
        while root[a] != a:
            a = root[a]
        return a

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    assert {p: find(p) for p in prints} == want
    edges = spark.createDataFrame([(signed(a), signed(b)) for a, b in links], "a long, b long")
    found = {r.node % 2**64: r.root % 2**64 for r in simhash_dedup.connected(edges).collect()}
    groups = Counter(frozenset(p for p in prints if want[p] == r) for r in set(want.values()) if sum(want[p] == r for p in prints) > 1)
    by = {}
    for node, r in found.items():
        by.setdefault(r, set()).update({node, r})
    assert Counter(map(frozenset, by.values())) == groups


# ---------------------------------------------------------------- 8


def quality_rows(n=600):
    rnd = random.Random(12)
    vocab = ["".join(rnd.choice("aeioubcdlmnrst") for _ in range(rnd.randint(2, 9))) for _ in range(800)]
    insults = ["grobble", "snarf", "wuzzle"]
    rows, labels = [], []
    for i in range(n):
        words = rnd.choices(vocab, k=rnd.randint(20, 200))
        bad, toxic = i % 6 == 0, i % 7 == 0
        if toxic:
            words[rnd.randrange(len(words))] = rnd.choice(insults) + rnd.choice(["", "s", "ing"])
        if bad:
            words = [(w.upper() + "!!") for w in words] if i % 12 == 0 else [w for w in words[:9] for _ in range(12)]
        rows.append((i, " ".join(words), "en", "s"))
        if i % 2:
            continue
        labels.append((i, 0 if bad else 1, 1 if toxic else 0))
    return rows, labels


def labels_of(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


def test_junk_and_toxic_documents_are_rejected(spark):
    rows, labels = quality_rows()
    got = {r.doc_id: r for r in quality.judged(docs(spark, rows), labels_of(spark, labels + [(None, 1, 1), (3, None, None)])).collect()}
    held = [i for i in range(600) if i % 2]  # without labels
    bad = [i for i in range(600) if i % 6 == 0]
    toxic = [i for i in held if i % 7 == 0]
    clean = [i for i in held if i % 7]
    assert np.mean([got[i].quality < 0.5 for i in bad]) >= 0.95
    assert np.mean([got[i].toxicity > 0.5 for i in toxic]) >= 0.9
    assert np.mean([got[i].keep for i in clean]) >= 0.97
    kept = quality.accepted(docs(spark, rows), labels_of(spark, labels))
    assert kept.columns == docs(spark, rows).columns
    assert {r.doc_id for r in kept.collect()} == {i for i, r in got.items() if r.keep}


def test_vote_rates_and_classes_are_recovered():
    rnd = np.random.default_rng(5)
    truth = rnd.random(20000) < 0.2
    accuracy = np.array([0.9, 0.7, 0.8, 0.95])
    votes = np.stack([np.where(rnd.random(20000) < a, truth, ~truth) for a in accuracy], axis=1).astype(int)
    votes[rnd.random(votes.shape) < 0.3] = quality.ABSTAIN
    patterns, place, counts = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    post, agree = quality.estimate(patterns, counts.astype(float), 0.1, trusted=0.95)
    assert ((post[place.ravel()] > 0.5) == truth).mean() > 0.93
    assert np.abs(agree - accuracy).max() < 0.06


def test_quality_of_odd_rows_and_empty_tables(spark):
    rows, labels = quality_rows(100)
    odd = docs(spark, rows + [(None, "x", None, None), (700, None, "en", "s"), (701, "", "en", "s"), (702, LONG, "en", "s"), (1, rows[1][1], "en", "s")])
    got = quality.judged(odd, labels_of(spark, labels)).collect()
    assert len(got) == 105 and all(0 <= r.quality <= 1 and 0 <= r.toxicity <= 1 for r in got)
    assert quality.judged(odd, labels_of(spark, [])).count() == 105
    assert quality.judged(docs(spark, []), labels_of(spark, labels)).count() == 0


# ---------------------------------------------------------------- 9


def water(sizes, weights=(5, 2, 1), cap=3):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, fixed = sum(sizes.values()), {}
    while True:
        free = [s for s in names if s not in fixed]
        level = (total - sum(fixed.values())) / sum(w[s] for s in free) if free else 0
        over = [s for s in free if level * w[s] > cap * sizes[s]]
        if not over:
            return {s: fixed.get(s, level * w[s]) for s in names}
        fixed |= {s: cap * sizes[s] for s in over}


@pytest.mark.parametrize("sizes", [
    {"a": 100, "b": 100, "c": 100}, {"a": 10, "b": 5000, "c": 1, None: 300}, {"x": 0, "y": 10}, {"one": 7},
    {f"s{i}": (i * 37) % 101 for i in range(40)}])
def test_targets_equal_repeated_resharing(spark, sizes):
    df = spark.createDataFrame([(s, n) for s, n in sizes.items()], "source string, size long")
    got = {r.source: r.target for r in mixing.source_targets(df).collect()}
    assert got == pytest.approx(water(sizes))


def test_mix_meets_targets_in_epochs(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["word"] * rnd.randint(0, 40)), "en", None if i % 9 == 8 else f"s{i % 9 % 4}") for i in range(3000)]
    rows += [(9000, None, None, None), (9001, "", None, "s1"), (None, "a b c", None, "s2"), (9002, "long " * 300, "en", "s3"), (7, rows[7][1], "en", rows[7][3])]
    got = mixing.sampled(docs(spark, rows), intervals=16).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len((r[1] or "").split())
    want = water(dict(sizes))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.times <= 3
        taken[r.source] += r.size * r.times
    for s, t in want.items():
        assert abs(taken[s] - t) <= 300 / 2 if s == "s3" else abs(taken[s] - t) <= 20.5
    for s in sizes:  # whole epochs come first
        times = {r.times for r in got if r.source == s and r.size}
        assert max(times) - min(times) <= 1
    key = lambda rs: Counter((r.doc_id, r.size, r.times) for r in rs)
    assert key(mixing.sampled(docs(spark, rows[::-1]).repartition(7), intervals=16).collect()) == key(got)
    mix = mixing.mixed(docs(spark, rows))
    assert mix.columns == docs(spark, rows).columns
    assert Counter(r.doc_id for r in mix.collect())[9002] in (0, 1, 2, 3)
    assert mixing.sampled(docs(spark, [])).count() == 0 and mixing.mixed(docs(spark, [])).count() == 0


def test_heavier_documents_are_taken_more_often(spark):
    rows = [(i, ("words " if i % 2 else "w ") * 10, "en", "s") for i in range(4000)] + [(10**6 + i, "other " * 40, "en", "t") for i in range(2000)]
    got = mixing.sampled(docs(spark, rows), weights=(1, 9)).where("source = 's'").collect()
    share = lambda odd: np.mean([r.times for r in got if r.doc_id % 2 == odd])
    assert share(1) > 1.2 * share(0) > 0


# ---------------------------------------------------------------- queries and pipeline


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_queries_cover_their_tables(spark, name):
    got = QUERIES[name](spark, SMALL)
    n = got.count()
    n_docs = table(spark, SMALL, "documents").count()
    if name.split("_")[0] in ("op3", "op4", "op5", "op6", "op8", "op9", "op10"):
        assert n == n_docs and got.select("doc_id").distinct().count() == n_docs
    else:
        assert n > 0
    assert set(ORACLE_SQL) <= set(QUERIES)


def test_pipeline_stages_take_effect(spark):
    rows = table(spark, SMALL, "documents")
    before = {r.doc_id: r for r in rows.collect()}
    bench = [" ".join(r.text.lower().split()) for r in table(spark, SMALL, "benchmark").collect()]
    docs_now, n = rows, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs_now, SMALL).cache()
        kept = [r.doc_id for r in out.collect()]
        assert set(kept) <= set(before), name
        n.append(len(kept))
        if name != "token_ids":
            assert out.columns == rows.columns
            assert all(tuple(r) == tuple(before[r.doc_id]) for r in out.collect())
        if name == "near_dedup":
            prints = [slow_simhash(r.text or "") for r in out.collect()]
            assert all(r == p for p, r in components(prints).items()) and len(set(prints)) == len(prints)
        if name == "decontamination":
            assert not [r.doc_id for r in out.collect() if any(b in " ".join((r.text or "").lower().split()) for b in bench)]
        docs_now = out
    assert n[0] > 0.6 * len(before) and n[3] == n[4] > 0
    final = corpus_pipeline.run(spark, SMALL)
    assert final.columns == ["doc_id", "start", "n_tokens", "ids_crc32"] and final.count() == n[4]


def test_one_row_of_each_component_stays(spark):
    a, b = " ".join(f"word{i}" for i in range(80)), " ".join(f"other{i}" for i in range(80))
    rows = [(2, a, "en", "s"), (5, a, "en", "s"), (5, b, "en", "s"), (None, a, "en", "s"), (None, a, "en", "s"), (None, "only here " + b[::-1], "en", "s"),
            (9, None, "en", "s"), (9, "", "en", "s"), (9, "", "en", "s")]
    got = [(r.doc_id, r.text) for r in simhash_dedup.keep_one(docs(spark, rows)).collect()]
    assert Counter(got) - Counter([(9, None), (9, "")]) == Counter([(2, a), (5, b), (None, "only here " + b[::-1])])
    assert len(got) == 4
    assert simhash_dedup.keep_one(docs(spark, [])).count() == 0


def test_samples_hold_their_bound_and_no_id_crowds_others_out(spark):
    hot = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("same text").alias("text"))
    other = spark.range(2_000).select((F.col("id") + 10).alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    rows = hot.unionByName(other)
    h, chosen = sample_hash(rows, 1000, 9, "doc_id", "text")
    picked = rows.where(chosen).withColumn("h", h).dropDuplicates(["h"])
    assert picked.count() == 1000 and picked.select("doc_id").distinct().count() >= 999
    h, chosen = sample_hash(rows, 5000, 9, "doc_id", "text")
    assert rows.where(chosen).withColumn("h", h).dropDuplicates(["h"]).count() == 2001
    assert rows.limit(0).where(sample_hash(rows.limit(0), 10, 1, "doc_id")[1]).count() == 0


def test_shards_of_slices_equal_shards_of_texts(spark):
    rnd = random.Random(12)
    texts = [" ".join(rnd.choice(["word", "Word.", "x,", "12.5", "naïve", "日本", "a" * 40, "<|endoftext|>", "end.."]) + str(rnd.randint(0, 30)) for _ in range(rnd.randint(0, 60))).encode() for _ in range(200)]
    whole = token_store.encode(texts, tokenizer_path())
    encoder = token_store.Encoder(tokenizer_path())
    parts = []
    for a in range(0, 200, 7):
        if a % 3 == 0:
            encoder.n_bytes = token_store.KNOWN_BYTES + 1  # starts anew
        ids, sizes = encoder.encode(texts[a:a + 7])
        parts += [x.astype("<u4").tobytes() for x in np.split(ids, np.cumsum(sizes)[:-1])]
    assert parts == whole == [token_store.encode([t], tokenizer_path())[0] for t in texts]
