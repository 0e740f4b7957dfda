"""Operators 11, 12 and 13 against brute force, SQL and odd tables."""

import hashlib
import itertools
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from conftest import MEDIUM, SMALL
from pyspark.sql import functions as F
from test_text_operators import LONG, ODD, docs

from ledgerlens.llm import hard_negatives, quality_rules, token_alignment
from ledgerlens.llm.common import WORD, table
from ledgerlens.llm.queries import ORACLE_SQL, QUERIES, tokenizer_path
from oracle.compare import compare, duck_connection


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_quality_rules"])
@pytest.mark.parametrize("sf_dir", [SMALL, MEDIUM])
def test_queries_equal_their_sql(spark, name, sf_dir):
    found = compare(QUERIES[name](spark, sf_dir), duck_connection(sf_dir), ORACLE_SQL[name])
    assert found["match"], found


# ---------------------------------------------------------------- 11


def slow_mined(rows, anchors, positives=5, negatives=5, low=80):
    """rows: (vec_id, vector of whole numbers, label), vec_ids distinct."""
    out = []
    for a, v, label in rows:
        if a not in anchors:
            continue
        scored = sorted((-sum(x * y for x, y in zip(v, w, strict=True)), i, l) for i, w, l in rows if i != a and len(w) == len(v))
        for s, p, _ in [x for x in scored if x[2] == label][:positives]:
            fits = [x for x in scored if x[2] != label and low * -s <= 100 * -x[0] <= 100 * -s]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits[:negatives])]
    return sorted(out)


def vectors(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    for c in ("row", "vector", "cell", "is_row", "marks", "rank", "score"):
        df = df.withColumn(c, F.lit("x"))
    return df


def test_negatives_equal_brute_force_over_many_cells(spark):
    rnd = np.random.default_rng(7)
    rows = [(i, rnd.integers(-3, 4, 4).tolist(), int(rnd.integers(0, 3))) for i in range(400)]  # small whole numbers: many ties
    df = vectors(spark, [(i, [x / 256 for x in v], l) for i, v, l in rows])
    got = hard_negatives.mined(df, F.col("vec_id") % 10 == 0, anchor_block=7, row_groups=3)
    assert sorted(map(tuple, got.collect())) == slow_mined(rows, set(range(0, 400, 10)))


def test_a_hot_label_copies_and_unusable_vectors(spark):
    rows = [(i, [2, 1], 1) for i in range(150)] + [(200 + i, [2, i % 3], 2) for i in range(30)] + [(300 + i, [1], i % 2) for i in range(6)] + [(400, [], 1), (401, [], 2)]
    bad = [(500, None, 1), (501, [1.0, None], 1), (502, [math.nan, 1.0], 1), (503, [math.inf, 1.0], 1), (504, [1.0, 1.0], None), (None, [1.0, 1.0], 1)]
    df = vectors(spark, [(i, [x / 256 for x in v], l) for i, v, l in rows] + bad + [(0, [2 / 256, 1 / 256], 1)] * 3)
    got = hard_negatives.mined(df, F.col("vec_id") % 50 == 0)
    assert sorted(map(tuple, got.collect())) == slow_mined(rows, {i for i, _, _ in rows if i % 50 == 0})
    again = hard_negatives.mined(vectors(spark, [(1, [1e30, 1.0], 0), (2, [1e30, 1.0], 0), (3, [1e30, 0.5], 1)]), F.col("vec_id") == 1)
    assert [(r.positive_id, r.negative_id) for r in again.collect()] == [(2, 3)]
    empty = hard_negatives.mined(vectors(spark, []), F.col("vec_id") % 10 == 0)
    assert empty.count() == 0 and empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def test_keys_sort_as_tuples_and_windows_hold_no_rows():
    rnd = random.Random(2)
    rows = [(rnd.randint(-2**40, 2**40), rnd.choice([-2**62, -1, 0, 1, 2**62, rnd.randint(-99, 99)]), rnd.random() < 0.5, rnd.randint(-5, 2**50)) for _ in range(500)]
    keys = [hard_negatives.pack_key(*r) for r in rows]
    assert [hard_negatives.unpack_key(k) for k in keys] == rows
    assert [hard_negatives.unpack_key(k) for k in sorted(keys)] == sorted(rows, key=lambda r: (r[0], -r[1], r[2], r[3]))
    endless = ((hard_negatives.pack_key(1, 100 - k // 1000, k > 0, k), None) for k in itertools.count())
    assert [r[3] for r in itertools.islice(hard_negatives.windows(endless, 1, 5, 80), 5)] == [1, 2, 3, 4, 5]


# ---------------------------------------------------------------- 12


PATHS = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")
TRICKY = ["a  b", " ", "\n", "a\n\nb  c\td  x   y ", "▁a", "<|endoftext|> <s></s> <0x0A>", "日本 語 テ キ 　 ス", "x\ny\nz ", "é à ü  q", "\x00 a", "a'b 's don't  I'll",
          "😀 😀\n😀", " \n a", "​ z", "a \x1c b", "a b   c", "ｶ  x", "\r\n x\r\ny"]


def slow_aligned(rows):
    encoders = token_alignment._encoders(*PATHS)
    a, b, (bytes_a, bytes_b) = encoders.a, encoders.b, encoders.bytes
    held, texts = Counter(), []
    for doc_id, text in rows:
        full = (" " + (text or "")).encode()
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        if not text or b"".join(bytes_a[i] for i in ids_a) != full or b"".join(bytes_b[i] for i in ids_b) != full:
            texts.append((doc_id, 0, 0, 0, Counter(), ""))
            continue
        end_a, end_b = (list(itertools.accumulate(len(by[i]) for i in ids)) for ids, by in ((ids_a, bytes_a), (ids_b, bytes_b)))
        groups, links, i, j = [], Counter(), 0, 0
        for c in sorted(set(end_a) & set(end_b)):
            p, q = end_a.index(c, i) + 1, end_b.index(c, j) + 1
            groups.append(",".join(map(str, ids_a[i:p])) + "|" + ",".join(map(str, ids_b[j:q])))
            for x, y in itertools.product(range(i, p), range(j, q)):
                if max(end_a[x] - len(bytes_a[ids_a[x]]), end_b[y] - len(bytes_b[ids_b[y]])) < min(end_a[x], end_b[y]):
                    links[ids_a[x], ids_b[y]] += 1
            i, j = p, q
        texts.append((doc_id, len(ids_a), len(ids_b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
        held.update(links.keys())
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    return Counter((d, na, nb, ng, sum(ls.values()), sum(n for p, n in ls.items() if held[p] == best[p[0]]), sum(n * held[p] for p, n in ls.items()), s) for d, na, nb, ng, ls, s in texts)


def test_alignment_equals_whole_texts(spark):
    rows = [(r.doc_id, r.text) for r in table(spark, SMALL, "documents").limit(150).collect()] + [(1000 + i, t) for i, t in enumerate(TRICKY)]
    rows += [(r[0], r[1] if r[1] != LONG else LONG[:50_000]) for r in ODD]
    rows.append((2000, "".join(random.Random(1).choice(["w ", "ab", "\n", " é", "x" * 50, "日 "]) for _ in range(20_000))))
    df = docs(spark, [(i, t, "en", "s") for i, t in rows])
    for c in ("place", "value", "block", "pair", "text_id", "parts", "payload"):
        df = df.withColumn(c, F.lit("x"))
    got = token_alignment.aligned(df, *PATHS, part_bytes=700)  # most texts go through the tree
    assert Counter(map(tuple, got.collect())) == slow_aligned(rows)


def test_copies_count_as_documents_each(spark):
    rows = [(1, "same text here")] * 4 + [(2, "same other"), (None, None)]
    got = token_alignment.aligned(docs(spark, [(i, t, None, None) for i, t in rows]), *PATHS)
    assert Counter(map(tuple, got.collect())) == slow_aligned(rows)
    assert token_alignment.aligned(docs(spark, []), *PATHS).count() == 0


def test_fragments_compose_associatively():
    rnd = random.Random(4)
    aligner = token_alignment.Aligner(*PATHS)
    for text in [*TRICKY, "plain words and\nlines of 日本 text　here", "".join(rnd.choice(" \nab é日　") for _ in range(120))]:
        raw = b" " + text.encode()
        whole = token_alignment.fragment(raw, aligner)
        for _ in range(12):
            at = sorted(rnd.randint(0, len(raw)) for _ in range(3))
            x, y, z, w = (token_alignment.fragment(raw[a:b], aligner) for a, b in zip([0, *at], [*at, len(raw)], strict=True))
            join = lambda *f: __import__("functools").reduce(lambda p, q: token_alignment.compose(p, q, aligner), f)
            for one in (join(join(x, y), join(z, w)), join(x, join(y, join(z, w))), join(token_alignment.Fragment(), x, y, z, w)):
                assert (one.prefix, one.suffix, one.body is None) == (whole.prefix, whole.suffix, whole.body is None)
                if one.body:
                    assert b"".join(one.body.groups) == b"".join(whole.body.groups) and one.body.links == whole.body.links


# ---------------------------------------------------------------- 13


def slow_counts(text):
    words = re.findall(WORD, text or "")
    seen = defaultdict(list)
    for i in range(len(words) - 7):
        seen[tuple(words[i:i + 8])].append(i)
    repeated = {p for at in seen.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(WORD, x)]
    return len(words), sum(map(len, words)), sum(map((text or "").count, "#*$%&|<>")), len(lines), len(lines) - len(set(lines)), len(repeated)


def test_counts_equal_brute_force(spark):
    rnd = random.Random(9)
    texts = [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 60))) for _ in range(80)]
    texts += ["a " * 40, "one two three four five six seven eight\n" * 3, "x\n\n \nx\ny z\n" * 5, "#a$ |&<> %*", "é日\x0b\x0cñ", None, "", " \n "]
    got = {r.doc_id: tuple(r)[3:] for r in quality_rules.counted(docs(spark, [(i, t, "en", "s") for i, t in enumerate(texts)])).collect()}
    assert got == {i: slow_counts(t) for i, t in enumerate(texts)}


def test_sketches_merge_and_bound_the_error(spark):
    rnd = random.Random(3)
    values = {s: [int(rnd.expovariate(1 / 300)) for _ in range(400)] for s in ("a", "b")}
    rates = [r.name for r in quality_rules.RATES]
    rows = [("en", s, *[v] * len(rates)) for s, vs in values.items() for v in vs]
    sketch = quality_rules.sketches(spark.createDataFrame(rows, f"lang string, source string, {', '.join(r + ' long' for r in rates)}"))
    assert sketch.where("source = 'a' and rate = 'symbols'").count() < 250
    both = sorted(values["a"] + values["b"])
    for keys, exact in ((("lang",), both), (("lang", "source"), None)):
        for r in quality_rules.quartiles(quality_rules.merged(sketch, *keys), *keys).collect():
            of = exact or sorted(values[r.source])
            for q, x in ((r.q1, of[len(of) // 4 - 1]), (r.q2, of[len(of) // 2 - 1]), (r.q3, of[3 * len(of) // 4 - 1])):
                assert q <= x <= q * (1 + 1 / 32)
            assert r.n == len(of)


def test_small_groups_use_their_language_and_a_hot_source_is_salted(spark):
    rnd = random.Random(6)
    text = lambda k=0: " ".join(["w" * rnd.randint(3, 7) + str(rnd.randint(0, 99)) + ("#" if rnd.random() < k else "") for _ in range(60)])
    rows = [(i, text(), "en", "hot") for i in range(300)] + [(1000 + i, text(0.9), "en", "odd") for i in range(300)]
    rows += [(2000, text(), "en", "small"), (2001, text(0.9), None, None), (2002, text(), None, None), (2003, text(0.9), "en", "hot")]
    got = {r.doc_id: r for r in quality_rules.judged(docs(spark, rows)).collect()}
    assert all(got[i].kept for i in range(300)) and all(got[1000 + i].kept for i in range(300))  # what is usual in a source stays
    assert not got[2003].kept and got[2003].failed == ["symbols"]
    assert got[2000].kept and got[2002].kept


def test_odd_tables(spark):
    got = quality_rules.judged(docs(spark, ODD)).collect()
    assert Counter((r.doc_id, r.n_words) for r in got) == Counter((d, len(re.findall(WORD, t or ""))) for d, t, _, _ in ODD)
    assert all(r.base_failed and not r.kept for r in got if r.n_words < 20)
    assert [r.base_failed for r in got if r.doc_id == 4] == [True]
    assert quality_rules.judged(docs(spark, [])).count() == 0
