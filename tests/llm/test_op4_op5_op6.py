import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from markloom.llm import crf_langid, skipchain_pii, winnow_decontam
from markloom.llm.queries import held_out

from .fixtures import frame, hostile


def words_of(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts, items):
    out = {}
    for d, text in enumerate(texts):
        w, hit, found = words_of(text), set(), set()
        for i, item in items:
            b = words_of(item)
            k = min(13, len(b))
            windows = {tuple(b[j : j + k]) for j in range(len(b) - k + 1)} if k else set()
            for p in range(len(w) - k + 1) if k else ():
                if tuple(w[p : p + k]) in windows:
                    hit.update(range(p, p + k))
                    found.update([str(i)] * (i is not None))
        out[d] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_decontamination_matches_brute_force(spark, most_bytes):
    texts = [*hostile(3), "a " * 90 + "b " * 50, "a " * 9]
    items = [(1, texts[20]), (2, "W1 w2"), (30, "a-b c"), (4, None), (5, ""), (6, " ".join((texts[30] or "x").split()[5:25])), (7, "é é é"), (2, "W1 w2"), (None, texts[25]), (2, texts[35]), (8, "a " * 40), (8, "b " * 40)]
    got = winnow_decontam.decontaminate(frame(spark, texts), spark.createDataFrame(items, "item_id long, text string"), ["doc_id"], most_bytes=most_bytes)
    have = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got.collect()}
    want = brute(texts, items)
    assert have == want
    assert {len((texts[25] or "").split()) > 12, len((texts[35] or "").split()) > 12} == {True}
    assert sum(x[1] > 0 for x in want.values()) > 5


def test_decontamination_of_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    got = winnow_decontam.decontaminate(frame(spark, ["a b"]), none, ["doc_id"]).collect()
    assert [(r.n_words, r.n_hit, r.contaminated) for r in got] == [(2, 0, False)]
    assert winnow_decontam.decontaminate(frame(spark, []), none).count() == 0


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    e, a = rng.normal(size=(5, 3)), rng.normal(size=(3, 3))
    alpha, beta = crf_langid.forward_backward(e, a, np.array([0, 0, 5]))
    p = np.zeros((5, 3))
    for c in np.ndindex(3, 3, 3, 3, 3):
        s = np.exp(a[:, c[0]]).sum() * np.exp(sum(e[i, c[i]] for i in range(5)) + sum(a[c[i], c[i + 1]] for i in range(4)))
        for i in range(5):
            p[i, c[i]] += s
    assert np.allclose(crf_langid.marginals(alpha, beta), p / p.sum(1, keepdims=True))


def test_forward_backward_over_many_blocks():
    rng = np.random.default_rng(2)
    n = [0, 1, 63, 64, 65, 1000]
    first = np.concatenate([[0], np.cumsum(n)])
    e, a = rng.normal(size=(first[-1], 3)), rng.normal(size=(3, 3))
    got = crf_langid.marginals(*crf_langid.forward_backward(e, a, first))
    for s, m in zip(first, n, strict=False):
        f, b = np.full(3, 1 / 3), np.ones(3)
        fs, bs = [], [None] * m
        for t in range(m):
            f = f @ np.exp(a) * np.exp(e[s + t])
            f /= f.sum()
            fs.append(f)
        for t in range(m - 1, -1, -1):
            bs[t] = b
            b = np.exp(a) @ (np.exp(e[s + t]) * b)
            b /= b.sum()
        for t in range(m):
            q = fs[t] * bs[t]
            assert np.allclose(got[s + t], q / q.sum())


def test_language_id_is_accurate_on_held_out_rows_and_defined_on_odd_ones(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("held_out", held_out())
    model = crf_langid.train(docs, ~held_out())
    got = crf_langid.identify(docs, model).where("held_out").toPandas()
    assert (got.lang == got.lang_pred).mean() > 0.97
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) for i in got.doc_id)
    odd = crf_langid.identify(frame(spark, [None, "", "12 34 !", "é", "the of and to", "x" * 200_000]), model, ["doc_id"]).orderBy("doc_id").collect()
    assert [r.lang_pred == "und" for r in odd] == [True, True, True, False, False, False]
    assert all(0 <= r.score <= 1 for r in odd)
    assert crf_langid.train(docs.limit(0), ~held_out()) is None
    assert [r.lang_pred for r in crf_langid.identify(frame(spark, ["the"]), None).collect()] == ["und"]


def test_code_switched_words_are_labelled_in_place(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = crf_langid.train(docs, ~held_out())
    pick = {lang: docs.where(f"lang='{lang}' and n_chars between 900 and 2000").orderBy("doc_id").first().text for lang in ("en", "de")}
    a, b = (" ".join(pick[x].split()[20:60]) for x in ("en", "de"))
    blob = np.frombuffer(f"{a} {b}".encode(), np.uint8)
    p = model.label(crf_langid.Words(blob, np.array([0, len(blob)]), lower=True)).argmax(1)
    want = [model.labels.index("en")] * 40 + [model.labels.index("de")] * 40
    assert (p == np.array(want)).mean() > 0.9


PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def brute_base(text):
    out = []
    for k, p in enumerate(PATTERNS.values()):
        for m in re.finditer(p, text):
            digits = re.sub("[^0-9]", "", m[0])
            total = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits)))
            if k == 0 or (k == 1 and all(int(x) <= 255 for x in m[0].split("."))) or (k == 2 and 12 <= len(digits) <= 19 and total % 10 == 0) or (k == 3 and 9 <= len(digits) <= 15):
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_match_the_patterns():
    rng = random.Random(5)
    parts = ["a.b@c.d", "@", "@c", ".", "1.2.3.4", "255", "256", ".3", "+1 (234) 555-0000", "+", "4444 3333 2222 1111", "4111111111111111", "-", " ", "  ", "é", "x@y..z", "a@b.c@d.e", "(", ")", "0", "٣", "%", "_a", "\n"]
    for _ in range(4000):
        text = "".join(rng.choices(parts, k=rng.randrange(1, 14)))
        assert skipchain_pii.base_spans(text) == brute_base(text), text


def test_linear_time_on_long_runs():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "1 " * 150_000):
        skipchain_pii.base_spans(text)
        skipchain_pii.tokens_of(text)


def test_distant_mentions_take_the_label_and_base_spans_stay(spark):
    train = [f"word call +1 ({i}4) 555-{i}89 now or mail ab{i}cdef{".12" if i % 2 else ""}@mail.example.com from 10.0.{i}.7 card 4111111111111111 end room 12 in 2024" for i in range(10, 60)]
    field = skipchain_pii.fitted(train)
    text = "write to user77abc@mail.example.com today. " + "la " * 50 + "ask user77abc or room 15 in 2023."
    (base, every), (_, clean), (nothing, _) = skipchain_pii.find(field, [text, "room 15 in 2023, room 15", None])
    assert base == brute_base(text) and set(base) < set(every)
    assert [text[a:b] for a, k, b in every if (a, k, b) not in base] == ["user77abc"]
    assert clean == [] and nothing == []
    docs = frame(spark, [text, None, ""])
    out = skipchain_pii.detect(docs, field, ["doc_id"]).orderBy("doc_id").collect()
    assert (out[0].n_email, out[1].spans, out[2].n_phone) == (1, "", 0)
    masked = [r.text for r in skipchain_pii.mask(docs, field).orderBy("doc_id").collect()]
    assert "<EMAIL>" in masked[0] and "example.com" not in masked[0] and masked[1:] == [None, ""]
    assert skipchain_pii.train(docs.limit(0)).unary.sum() == 0


def test_every_later_mention_hears_the_base_span():
    field = skipchain_pii.Field()
    field.unary[:, 0] = 0.25  # ten features: 2.5 against every label
    field.pair[skipchain_pii.SKIP] = 6.9 * np.eye(5)
    for n in (1, 2, 5, 30):
        for place in (0, n // 2, n):
            words = ["ask user77abc again"] * n
            text = ". ".join([*words[:place], "write to user77abc@mail.example.com", *words[place:]])
            (base, every), = skipchain_pii.find(field, [text])
            assert len(base) == 1 and len(every) == 1 + n, (n, place)


def test_beliefs_match_enumeration_on_trees():
    rng = np.random.default_rng(3)
    for trial in range(20):
        field = skipchain_pii.Field()
        field.unary[:] = rng.normal(size=field.unary.shape)
        field.pair[:] = rng.normal(size=field.pair.shape)
        graph, n = skipchain_pii.Graph(), 5
        graph.spans = [(0, 0, 1)] * n
        graph.feats = [rng.integers(0, skipchain_pii.FEATURES, 4).tolist() for _ in range(n)]
        graph.gold = [0] * n
        graph.gold[0] = 2 if trial % 2 else 0
        graph.edges = [(int(rng.integers(0, i)), i, int(rng.integers(0, 2))) for i in range(1, n)]
        ids, owner, gold, edges = graph.arrays()
        unary = field.scores(ids, owner, n)
        p = np.zeros((n, 5))
        for labels in np.ndindex(*[5] * n):
            if gold[0] and labels[0] != gold[0]:
                continue
            w = np.exp(sum(unary[i, y] for i, y in enumerate(labels)) + sum(field.pair[k, labels[a], labels[b]] for a, b, k in edges))
            for i, y in enumerate(labels):
                p[i, y] += w
        assert np.allclose(field.beliefs(graph, settled=1e-9), p / p.sum(axis=1, keepdims=True), atol=1e-4)


def test_learned_links_find_planted_repeats_and_no_decoys():
    import duckdb

    rows = duckdb.connect().execute("SELECT text FROM '/root/testdata/sf0.01/documents.parquet' WHERE text IS NOT NULL ORDER BY doc_id").fetchall()
    texts = [t for (t,) in rows]
    field = skipchain_pii.fitted([t for t in texts if re.search("[0-9@]", t)][:400])
    assert all(field.pair[skipchain_pii.SKIP, k, k] > field.pair[skipchain_pii.SKIP, k, j] + 1 for k in range(5) for j in range(5) if j != k)
    rng, hit, wrong = random.Random(8), 0, 0
    plain = [t for t in texts if 300 < len(t) < 2000][:200]
    for t in plain:
        digits = "".join(str(rng.randrange(10)) for _ in range(8))
        base, again = rng.choice([(f"+1 (2{digits[:2]}) 555-{digits[2:6]}", f"12{digits[:2]}555{digits[2:6]}"), (f"1{digits[:2]}.1{digits[2:4]}.1{digits[4:6]}.1{digits[6:]}", f"1{digits[:2]}-1{digits[2:4]}-1{digits[4:6]}-1{digits[6:]}")])
        decoy = re.sub("[0-9]", lambda _: rng.choice("0123456789"), again)
        words = t.split(" ")
        for x in (base, again, decoy, decoy):
            words.insert(rng.randrange(len(words)), x)
        text = " ".join(words)
        ((found, every),) = skipchain_pii.find(field, [text])
        more = {text[a:b] for a, k, b in set(every) - set(found)}
        hit += again in more
        wrong += len(more - {again})
    assert hit >= 0.9 * len(plain) and wrong <= 0.02 * len(plain)


def test_repeated_rows_nulls_and_long_texts(spark):
    field = skipchain_pii.fitted(["mail ab1cdef.12@mail.example.com"])
    long = "la " * 60_000 + "x@y.org " + "77 " * 2000
    docs = frame(spark, [None, "a x@y.org", "a x@y.org", long, ""]).withColumn("spans", F.lit("own"))
    out = skipchain_pii.detect(docs, field).orderBy("doc_id").collect()
    assert [r.n_email for r in out] == [0, 1, 1, 1, 0] and out[1].spans == out[2].spans == "email:2:9"
    assert skipchain_pii.mask(docs, field).orderBy("doc_id").collect()[2].spans == "own"
