"""Operators 1, 4, 5, 7 and 10 against brute force and literal cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ledgerlens.llm import chat_preferences, decontaminate, langid, pii, token_store
from ledgerlens.llm.queries import op4_pii, tokenizer_path

LONG = "lorem ipsum dolor " * 20000
#: Nulls in any column, empty and very long texts, repeated rows.
ODD = [(1, None, "en", "s"), (2, "", None, None), (3, " \t\n", "en", "s"), (4, LONG, "xx", "s"), (5, "same text here", "en", None),
       (5, "same text here", "en", None), (None, "same text here", None, "s"), (7, "é ñ ß 日本", "de", "t")]


def docs(spark, rows, extra=True):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("n_chars", F.length("text"))
    if extra:  # names that operators use inside
        for c in ("start", "part", "rank", "base", "spans", "key", "h", "task", "m", "carried", "times", "size", "fp", "s", "terms"):
            df = df.withColumn(c, F.lit("x"))
    return df


# ---------------------------------------------------------------- 1


def items(spark, rows):
    return spark.createDataFrame(rows, "item_id long, text string")


def test_passages_are_found_and_others_are_not(spark):
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefgh") for _ in range(6))
    bench = [(i, " ".join(word() for _ in range(rnd.randint(15, 50)))) for i in range(30)]
    rows, want = [], set()
    for d in range(200):
        words = [word() for _ in range(rnd.randint(5, 300))]
        if d % 4 == 0:
            i = rnd.randrange(30)
            passage = bench[i][1].split()
            if d % 8 == 0:  # one word of it changed near an end: still similar
                passage[1] = "changed"
            at = rnd.randint(0, len(words))
            words[at:at] = [w.upper() + "," if k == 3 else w for k, w in enumerate(passage)]
            n = len(passage) - 4
            if d % 8 or (n - 2) / (n + 2) > 0.85:
                want.add((d, i))
        elif d % 4 == 1:  # half a passage is not a leak
            words += bench[d % 30][1].split()[:7]
        rows.append((d, " ".join(words), "en", "s"))
    got = decontaminate.contaminated(docs(spark, rows), items(spark, bench)).collect()
    found = {(r.doc_id, r.item_id) for r in got}
    assert want <= found
    assert all(d % 4 == 0 for d, _ in found)
    assert all(r.similarity >= 0.8 and r.bits <= decontaminate.RADIUS for r in got)
    texts = dict((r[0], r[1].split()) for r in rows)
    for r in got:
        window = {tuple(w.strip(",").lower() for w in texts[r.doc_id][i:i + 5]) for i in range(r.start, r.end - 4)}
        item = bench[r.item_id][1].split()
        assert window & {tuple(item[i:i + 5]) for i in range(len(item) - 4)}


def test_blocks_find_all_fingerprints_within_the_radius():
    rnd = random.Random(2)
    index = decontaminate.Index([(i, " ".join(f"w{i}x{j}" for j in range(20)).encode()) for i in range(40)])
    prints = index.fingerprints[20]
    for _ in range(300):
        j = rnd.randrange(40)
        near = int(prints[j])
        for bit in rnd.sample(range(64), decontaminate.RADIUS):
            near ^= 1 << bit
        parts = np.frombuffer(near.to_bytes(8, "little"), np.uint8)
        assert any(index.blocks[20][b][parts[b], j] for b in range(8))


def test_decontamination_of_odd_rows_and_empty_tables(spark):
    bench = items(spark, [(1, "same text here"), (2, None), (None, "lorem"), (3, ""), (1, "same text here"), (4, "lorem ipsum dolor " * 6)])
    got = sorted((r.doc_id or 0, r.item_id) for r in decontaminate.contaminated(docs(spark, ODD), bench).collect())
    assert got == [(0, 1), (4, 4), (5, 1), (5, 1)]
    kept = decontaminate.clean(docs(spark, ODD), bench)
    assert sorted(r.doc_id for r in kept.collect()) == [1, 2, 3, 7] and kept.columns == docs(spark, ODD).columns
    assert decontaminate.contaminated(docs(spark, ODD), items(spark, [])).count() == 0
    assert decontaminate.clean(docs(spark, ODD), items(spark, [])).count() == len(ODD)
    assert decontaminate.contaminated(docs(spark, []), bench).count() == 0


def slow_contaminated(rows, bench):
    """All windows of all items' lengths, one by one, by shingle multisets."""
    found = {}
    for d, text, *_ in rows:
        words = text.lower().split()
        for i, item in bench:
            item = item.lower().split()
            k, span = min(5, len(item)), min(len(item), len(words))
            if span < k:
                continue
            grams = lambda ws: Counter(tuple(ws[a:a + k]) for a in range(len(ws) - k + 1))
            weight = lambda c: sum(n * sum(map(len, g)) for g, n in c.items())
            mine = grams(item)
            best = max(weight(mine & w) / weight(mine | w) for w in (grams(words[a:a + span]) for a in range(len(words) - span + 1)))
            if best >= 0.8:
                found[d, i] = best
    return found


def test_decontamination_equals_brute_force(spark):
    rnd = random.Random(15)
    word = lambda: rnd.choice("abcdef") * rnd.randint(1, 4) + rnd.choice("xyz")
    bench = [(i, " ".join(word() for _ in range(rnd.choice([3, 6, 12, 12, 25, 25, 25])))) for i in range(60)]
    bench += [(100 + i, bench[i][1]) for i in range(5)]  # items of equal text
    rows = []
    for d in range(80):
        words = [word() for _ in range(rnd.randint(0, 120))]
        for _ in range(rnd.randint(0, 3)):  # passages, some with changed, lost or doubled words
            passage = rnd.choice(bench)[1].split()
            for _ in range(rnd.choice([0, 0, 1, 2])):
                at = rnd.randrange(len(passage))
                passage[at:at + 1] = rnd.choice([[word()], [], [passage[at]] * 2])
            at = rnd.randint(0, len(words))
            words[at:at] = passage
        rows.append((d, " ".join(words), "en", "s"))
    got = {(r.doc_id, r.item_id): r.similarity for r in decontaminate.contaminated(docs(spark, rows), items(spark, bench)).collect()}
    want = slow_contaminated(rows, bench)
    assert got.keys() == want.keys() and len(want) > 50
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)
    kept = {r.doc_id for r in decontaminate.clean(docs(spark, rows), items(spark, bench), block_bytes=900).collect()}
    assert kept == {r[0] for r in rows} - {d for d, _ in want}


def test_a_common_shingle_does_not_meet_all_items_of_its_length():
    rnd = random.Random(3)
    index = decontaminate.Index([(i, " ".join(f"w{rnd.randrange(10**6)}" for _ in range(20)).encode()) for i in range(2000)])
    words = [f"v{i}".encode() for i in range(1800)]
    words[900:920] = index_words = " ".join(f"w{i}" for i in range(20)).encode().split()
    assert not len(index.hits(decontaminate.word_hashes(words)))
    some = decontaminate.Index([(7, b" ".join(index_words)), *[(i, f"{i} x ".encode() * 10) for i in range(100, 300)]])
    hits = some.hits(decontaminate.word_hashes(words))
    assert set(hits[:, 2].tolist()) == {0} and len(hits) == 16


def test_benchmark_in_blocks_gives_the_same(spark):
    bench = items(spark, [(i, " ".join(f"a{i}b{j}" for j in range(20))) for i in range(20)])
    rows = [(d, " ".join(f"a{d}b{j}" for j in range(20)), "en", "s") for d in range(40)]
    whole = sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), bench).collect()))
    assert len(whole) == 20
    assert sorted(map(tuple, decontaminate.contaminated(docs(spark, rows), bench, block_bytes=700).collect())) == whole


# ---------------------------------------------------------------- 4


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else (2 * int(c) - 9 if int(c) > 4 else 2 * int(c)) for i, c in enumerate(reversed(digits))) % 10 == 0


def base_spans(text):
    digits = lambda s: re.sub("[^0-9]", "", s)
    rules = (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 13 <= len(digits(s)) <= 19 and luhn(digits(s))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(digits(s)) <= 15))
    return [f"{k}:{m.start()}:{m.end()}" for k, p, ok in rules for m in re.finditer(p, text) if ok(m[0])]


PII_TEXTS = [
    "", None, "write to a.b@c.de, a@b.co%x@y.z or a@b..c é@x.yy", "1.2.3.4 1.2.3.400 01.002.0003.4 1.2.3.4.5.6.7.8 99999999999.1.1.1",
    "card 4111 1111 1111 1111, 4111-1111-1111-1112; 4111111111111111", "+1 (578) 555-6437 4366966299381840 and +49 30 1234567",
    "日本語 x@y.zz 😀 +1 212 555 0100 😀 10.0.0.1", "+" * 50 + "1" * 30, "1" * 30000 + " " + "a" * 30000 + "@" + "b" * 10 + ".c", "." * 20000 + "+1" + "(" * 20000,
    "IBAN DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, DE88 3704 0044 0532 0130 00", "ssn 078-05-1120 or 078-05-1120", "-" * 60 + "078-05-1120",
]


def test_base_spans_equal_brute_force(spark):
    rnd = random.Random(3)
    texts = PII_TEXTS + ["".join(rnd.choice(["1", "25", "0", ".", "-", " ", "+", "(", ")", "@", "a", "b.c", "é", "4111111111111111", "\n"]) for _ in range(40)) for _ in range(400)]
    rows = pii.find_spans(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)])).collect()
    assert len(rows) == len(texts)
    for r in rows:
        got = [f"{s.kind}:{s.start}:{s.end}" for s in r.base]
        assert got == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]
        every = [f"{s.kind}:{s.start}:{s.end}" for s in r.spans]
        assert set(got) <= set(every) and [(s.rank, s.start) for s in r.spans] == sorted((s.rank, s.start) for s in r.spans)


def test_added_spans_checksums_and_context(spark):
    got = {r.doc_id: [(s.kind, (PII_TEXTS[r.doc_id] or "")[s.start:s.end], s.score) for s in r.spans]
           for r in pii.find_spans(docs(spark, [(i, t, None, None) for i, t in enumerate(PII_TEXTS)])).collect()}
    assert ("card", "4366966299381840") in [x[:2] for x in got[5]] and ("phone", "+1 (578) 555-6437") in [x[:2] for x in got[5]]
    assert [x[1] for x in got[10]] == ["DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432"]
    assert all(x[2] > 0.75 for x in got[10])  # 'IBAN' stands near
    assert [x[0] for x in got[11]] == ["ssn", "ssn"] and got[12] == []  # only its context makes an ssn


def test_ibans_end_where_their_country_says(spark):
    ibans = ["ES91 2100 0418 4502 0005 1332", "AT61 1904 3002 3457 3201", "NO93 8601 1117 947", "GB82WEST12345698765432", "MT84MALT011000012345MTLCAST001S"]
    rows = [(i, f"x {iban} {tail}", None, None) for i, (iban, tail) in enumerate((x, t) for x in ibans for t in ("300 EUR", "EUR", "1234", "", "OK 5."))]
    for r in pii.find_spans(docs(spark, rows)).collect():
        iban = ibans[r.doc_id // 5]
        assert [(s.start, s.end) for s in r.spans if s.kind == "iban"] == [(2, 2 + len(iban))], rows[r.doc_id]


def test_pii_query_digests(spark, tmp_path):
    docs(spark, [(i, t, None, None) for i, t in enumerate(PII_TEXTS)]).write.parquet(str(tmp_path / "documents.parquet"))
    for r in op4_pii(spark, str(tmp_path)).collect():
        want = base_spans(PII_TEXTS[r.doc_id] or "")
        assert r.base_sha256 == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(x.startswith(k + ":") for x in want) for k in ("email", "ip", "card", "phone")]
    assert pii.find_spans(docs(spark, [])).count() == 0


# ---------------------------------------------------------------- 5


def test_wavelet_matrix_against_arrays():
    rnd = np.random.default_rng(4)
    for n, high in ((0, 1), (1, 1), (7, 1), (1000, 2), (5000, 300), (3000, 49408)):
        ids = rnd.integers(0, high, n).astype(np.uint32)
        m = token_store.WaveletMatrix.build(ids)
        assert (m.decode() == ids).all()
        for i in range(0, n, max(1, n // 50)):
            assert m.access(i) == ids[i]
        for token in set(ids[:20].tolist()) | {high + 5}:
            at = np.flatnonzero(ids == token)
            a, b = n // 3, n - n // 5
            assert m.count(token) == len(at) and m.count(token, a, b) == ((at >= a) & (at < b)).sum()
            assert [m.locate(token, k) for k in range(0, len(at), max(1, len(at) // 7))] == at[::max(1, len(at) // 7)].tolist()
        with pytest.raises(IndexError):
            m.locate(high + 5, 0)


def test_chunks_encode_like_whole_texts():
    from tokenizers import Tokenizer
    rnd = random.Random(1)
    texts = ["", "It's Bob's, we'll. don't", "<|endoftext|> <|ENDOFTEXT|>", "é ́x word,́ ΣΑΣ. İstanbul ﬁ", "日本語 テスト。", "a\x85b c d,\t.", "x" * 3000]
    texts += ["".join(rnd.choice("aB.,'é ́\n<|>9ßΣ日 \t !") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    whole = Tokenizer.from_file(tokenizer_path())
    got = token_store.encode([t.encode() for t in texts], tokenizer_path())
    for t, g in zip(texts, got, strict=True):
        assert np.frombuffer(g, "<u4").tolist() == whole.encode(t, add_special_tokens=False).ids, t


def test_pieces_of_texts_are_learned_once():
    simple = re.compile("[!-&(-@\\[-~\u00df-\u00f6\u00f8-\u00ff]+")
    cuts = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+|[0-9]|[^a-z0-9\u00df-\u00f6\u00f8-\u00ff]+")
    rnd = random.Random(6)
    texts = ["", " \n", "<|A", "É x", "a÷b ÿ9ß.", "it's a, b."] + ["".join(rnd.choice("aBz.,'é́ \n<|>9ß÷ÿÉ日 \t\x7f") for _ in range(rnd.randint(0, 40))) for _ in range(2000)]
    want = []
    for t in texts:
        chunks = [c.decode() for c in (t if "<|" in t else "".join(c.lower() if c.isascii() else c for c in t)).encode().split()]
        want.append([p.encode() for c in chunks for p in (cuts.findall(c) if simple.fullmatch(c) and "<|" not in c else [c])])
    pieces, counts = token_store.pieces_of([t.encode() for t in texts])
    assert counts.tolist() == [len(w) for w in want]
    assert pieces.to_pylist() == [p for w in want for p in w]
    encoder = token_store.Encoder(tokenizer_path())
    encoder.encode([b"word, word. word! (word) word7 other's"])
    assert set(encoder.known) == {b"word", b",", b".", b"!", b"(", b")", b"7", b"other's"}


def test_tasks_of_a_worker_share_learned_pieces(monkeypatch):
    sent, encode = [], token_store._encode
    monkeypatch.setattr(token_store, "_encode", lambda a, b, c, *new: (sent.extend(x for some in new for x in some), encode(a, b, c, *new))[1])

    def task(texts):
        batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts, "part": pa.array([0] * len(texts), pa.int32())})
        sent.clear()
        return [m for b in token_store._shards(tokenizer_path(), token_store.END_ID, 10**6)(iter([batch])) for m in b.to_pylist()], list(sent)

    first, new = task(["sharedpiece otherpiece, it's", None, "sharedpiece"])
    assert {"sharedpiece", "otherpiece", "it's"} <= set(new)
    again, new = task(["sharedpiece otherpiece, it's", None, "sharedpiece"])
    assert again == first and not new
    assert task(["latepiece otherpiece"])[1] == ["latepiece"]
    monkeypatch.setattr(token_store, "KNOWN_BYTES", 0)  # a worker keeps no more than that after a task
    task(["x"])
    assert not token_store._encoder(tokenizer_path()).known


def test_ids_do_not_depend_on_how_texts_are_cut(monkeypatch):
    rnd = random.Random(3)
    texts = ["", *["".join(rnd.choice("aBz.,'é́ \n<|>9ß÷É日") for _ in range(rnd.randint(0, 40))) for _ in range(300)], "<|endoftext|>A", "x" * 500]
    texts = [t.encode() for t in texts] + [b"\xa9. a", b"a \xc3"]  # halves of a letter
    want = [token_store.encode([t, b"a"], tokenizer_path())[0] for t in texts]
    for cut in (1, 60, 1 << 20):
        monkeypatch.setattr(token_store, "CUT_BYTES", cut)
        assert token_store.encode(texts, tokenizer_path()) == want
        assert token_store.encode(texts[::-1], tokenizer_path()) == want[::-1]


@pytest.mark.parametrize("partitions, shard_tokens", [(1, 10**6), (5, 40)])
def test_documents_read_back_from_shards(spark, tmp_path, partitions, shard_tokens):
    from tokenizers import Tokenizer
    whole = Tokenizer.from_file(tokenizer_path())
    rows = ODD + [(100 + i, f"Text {i}, it's number {i * 7}.", "en", "s") for i in range(60)]
    rows[3] = (4, "lorem ipsum " * 300, "xx", "s")
    path = str(tmp_path / "shards")
    token_store.write_shards(docs(spark, rows), path, tokenizer_path(), shard_tokens=shard_tokens, partitions=partitions)
    got = sorted(map(tuple, token_store.read_documents(spark, path).collect()))
    want, at = [], 0
    for d, text in sorted((r[0], r[1] or "") for r in rows if r[0] is not None):
        ids = np.array([*whole.encode(text, add_special_tokens=False).ids, token_store.END_ID], "<u4")
        want.append((d, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert got == want
    shard = spark.read.parquet(path).orderBy(F.desc("n_tokens")).first()
    m = token_store.matrix(shard.asDict())
    ids = m.decode()
    assert m.access(3) == ids[3] and m.count(int(ids[0])) == (ids == ids[0]).sum()


def test_token_table_of_nothing(spark):
    assert token_store.token_table(docs(spark, []), tokenizer_path()).count() == 0


# ---------------------------------------------------------------- 7


def turns(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, side string, turn long, role string, text string").withColumn("n", F.lit("x")).withColumn("prompt", F.lit(1))


def test_common_prefix_is_rendered_once(spark):
    rows = [(1, s, i, r, t) for s, ts in (
        ("chosen", [("system", "S"), ("user", "q"), ("assistant", "good"), ("user", "thanks"), ("assistant", "né")]),
        ("rejected", [("system", "S"), ("user", "q"), ("assistant", "bad")])) for i, (r, t) in enumerate(ts)]
    r = chat_preferences.preference_pairs(turns(spark, rows + rows)).collect()[0]
    assert (r.status, r.prefix_turns) == ("pair", 2)
    assert r.prompt == "<|system|>\nS<|end|>\n<|user|>\nq<|end|>\n"
    assert r.rejected == "<|assistant|>\nbad<|end|>\n"
    assert [r.chosen[s.start:s.end] for s in r.chosen_mask] == ["good<|end|>", "né<|end|>"]
    assert [r.rejected[s.start:s.end] for s in r.rejected_mask] == ["bad<|end|>"]


def test_odd_pairs(spark):
    rows = [(1, "chosen", 0, "user", "a"), (1, "rejected", 5, "user", "a"), (1, "rejected", 6, "assistant", "b"),  # a prefix of the other
            (2, "chosen", 0, "user", "a"), (2, "rejected", 0, "user", "a"),
            (3, "chosen", 0, None, None), (4, "rejected", None, "user", "z"), (None, "chosen", 0, "user", "a"), (5, "other", 0, "user", "a"),
            (6, "chosen", 0, "user", "b"), (6, "chosen", 0, "user", "a"), (6, "rejected", 0, "user", LONG)]
    got = {r.pair_id: r for r in chat_preferences.preference_pairs(turns(spark, rows)).collect()}
    assert {k: (r.status, r.prefix_turns) for k, r in got.items()} == {
        1: ("pair", 1), 2: ("identical", 1), 3: ("chosen_only", 1), 4: ("rejected_only", 1), 6: ("pair", 0)}
    assert got[1].chosen == "" and got[1].rejected.startswith("<|assistant|>") and got[1].chosen_mask == []
    assert got[3].prompt == "<||>\n<|end|>\n" and got[6].chosen.index("a<") < got[6].chosen.index("b<")
    assert chat_preferences.preference_pairs(turns(spark, [])).count() == 0


# ---------------------------------------------------------------- 10

EN = "the of and to in that it is was for with as his on be at by had not are but from or have an they which one you".split()
FR = "le de un être et à il avoir ne je son que se qui ce dans en du elle au pour pas plus par sur faire avec".split()
RU = "и в не на я быть он с что а по это она этот к но они мы весь который из у то за свой".split()


def lang_rows(n):
    rnd = random.Random(9)
    return [(i, " ".join(rnd.choices(v, k=rnd.randint(5, 60))) + ".", lang, "s") for i in range(n) for lang, v in [(("en", EN), ("fr", FR), ("ru", RU))[i % 3]]]


def test_languages_of_held_out_texts(spark):
    rows = lang_rows(300)
    mixed = (1000, " ".join(EN * 2 + RU * 2), "en", "s")
    got = {r.doc_id: r for r in langid.identify(docs(spark, rows + [mixed, *ODD[:3]]).filter("doc_id > 3 or text is null or trim(text) = '' or doc_id < 4")).collect()}
    held = [r for r in rows if zlib.crc32(str(r[0]).encode()) % 4 == 2 and r[0] > 3]
    assert np.mean([got[r[0]].lang_pred == r[2] for r in held]) >= 0.98 and all(got[r[0]].held_out for r in held)
    spans = got[1000].spans
    assert [s.lang for s in spans] == ["en", "ru"] and abs(spans[0].end - 2 * len(EN)) <= 1
    assert 0.4 < got[1000].score < 0.8


def test_viterbi_equals_brute_force():
    from itertools import product
    rnd = np.random.default_rng(1)
    texts = [rnd.normal(size=(n, 3)) * 3 for n in (0, 1, 5, 6, 2, 6)]
    for scores, got in zip(texts, langid.viterbi(texts, 1.5), strict=True):
        value = lambda p: sum(scores[i, x] for i, x in enumerate(p)) - 1.5 * sum(a != b for a, b in zip(p, p[1:], strict=False))  # noqa: B023, E731
        best = max(product(range(3), repeat=len(scores)), key=value)
        assert value(tuple(got)) == pytest.approx(value(best))


def test_languages_of_odd_rows_and_nothing_learned(spark):
    got = langid.identify(docs(spark, ODD)).collect()
    assert len(got) == len(ODD)
    assert all((r.lang_pred, r.score) == ("und", 0.0) for r in got if r.doc_id in (1, 2, 3))
    none = langid.identify(docs(spark, [(i, "some words", None, "s") for i in range(20)])).collect()
    assert len(none) == 20 and {r.lang_pred for r in none} == {"und"}
    assert langid.identify(docs(spark, [])).count() == 0


def test_many_proposals_in_one_text_cost_in_proportion(spark):
    text = "".join(f"{i % 90 + 10}.{i % 7} x " for i in range(40_000)) + "mail a@b.cd ip 10.0.0.1 card 4111 1111 1111 1111 call +49 30 1234567"
    df = spark.createDataFrame([(1, text), (2, "a@b.cd " * 3000)], "doc_id long, text string")
    begun = time.monotonic()
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert time.monotonic() - begun < 60  # a quadratic walk takes minutes
    assert [text[s.start:s.end] for s in got[1].base] == ["a@b.cd", "10.0.0.1", "4111 1111 1111 1111", "+49 30 1234567"]
    assert [(s.start, s.end) for s in got[2].base] == [(7 * i, 7 * i + 6) for i in range(3000)]


def test_scripts_narrow_long_words_too(spark):
    rnd = random.Random(11)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзийклмнопрстуфхцчшщыэюя"
    rows = [(i, " ".join(word(cyrillic if i % 2 else latin, rnd.randint(3, 9)) for _ in range(40)), "ru" if i % 2 else "en", "s") for i in range(200)]
    model = langid.fit(docs(spark, rows))
    scores = dict(zip(("qxzqxzqxzw" * 4, "щыэщыэщыэъ" * 4), model.word_scores(["qxzqxzqxzw" * 4, "щыэщыэщыэъ" * 4]), strict=True))
    assert [model.langs[int(s.argmax())] for s in scores.values()] == ["en", "ru"]
    mixed = docs(spark, [(1, "qxzqxzqxzw" * 4 + " " + "щыэщыэщыэъ" * 4, None, None)])
    assert [s.lang for s in langid.label_spans(mixed, model).first().spans] == ["en", "ru"]


def test_language_sample_is_not_crowded_out_by_one_document(spark):
    rows = [(7, "dasselbe wort immer wieder", "de", "s")] * 600 + [(100 + i, f"the word number {i} here", "en", "s") for i in range(300)]
    model = langid.fit(docs(spark, rows), train_docs=50)
    assert set(model.langs) <= {"de", "en"} and "en" in model.langs
