import random
import re
import zlib
from collections import Counter, defaultdict
from math import floor, log

import numpy as np
import pytest
import sentencepiece

from markloom.llm import piece_encoding, queries, ranked_search, spelling_variants

from .fixtures import DOC_SCHEMA, frame, hostile


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def brute_words(texts):
    found = Counter()
    for doc_id, text in texts:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                found[run] += 1
    return {w: n for w, n in found.items() if n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_variants(texts):
    n = brute_words(texts)
    near = defaultdict(list)
    for a in n:
        for b in n:
            if a < b and abs(len(a) - len(b)) <= 1 and one_edit(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= 10 * n[w]:
            form[w] = best
    out = {}
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out[w] = (n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root)
    return out


def made_words(seed, n=120):
    """Texts of words with bigrams that repeat, accents, and variants of very different frequency."""
    rng = random.Random(seed)
    base = ["anananana", "bananananas", "ééééééé", "aaaaaaaa", "Zusammenß", "thethethe", "abcdefgh", "straßenþ"]
    base += ["".join(rng.choices("abén", k=rng.randrange(7, 12))) for _ in range(30)]

    def changed(w):
        i = rng.randrange(len(w) + 1)
        return rng.choice([w[:i] + rng.choice("abzé") + w[i:], w[:i] + w[i + 1 :], w[:i] + "n" + w[i + 1 :]])

    texts = []
    for i in range(n):
        words = [w for k, w in enumerate(base) for _ in range(rng.randrange(0, 1 + 12 // (1 + k % 5)))]
        words += [changed(rng.choice(base)) for _ in range(20)]
        words += [changed(changed(base[0]))] * 2
        texts.append((i, ", ".join(words)))
    return [*texts, (None, texts[0][1]), (None, texts[0][1]), (3, texts[3][1]), (500, None), (501, ""), (502, "x9y " * 9)]


@pytest.mark.parametrize("seed", [1, 2])
def test_variants_match_brute_force(spark, seed):
    texts = made_words(seed)
    rows = [(i, t, "en", "s", 1, 5, 0.5) for i, t in texts]
    got = {r.word: tuple(r)[1:] for r in spelling_variants.variants(spark.createDataFrame(rows, DOC_SCHEMA)).select("word", "n", "n_near", "form", "form_n", "root").collect()}
    expected = brute_variants(texts)
    assert got == expected
    assert any(f for _, _, f, _, _ in expected.values())


def test_forms_are_followed_to_the_end(spark):
    text = "xxxxxxxx " * 3000 + "xxxxxxxxy " * 200 + "xxxxxxxxyy " * 15 + "xxxxxxxxyyy "
    docs = spark.createDataFrame([(i, text) for i in range(2)], "doc_id long, text string")
    got = {r.word: r.root for r in spelling_variants.variants(docs, every=1 << 40).collect()}
    assert got == dict.fromkeys(("xxxxxxxx", "xxxxxxxxy", "xxxxxxxxyy", "xxxxxxxxyyy"), "xxxxxxxx")


def test_variants_of_nothing(spark):
    assert spelling_variants.variants(spark.createDataFrame([], DOC_SCHEMA)).count() == 0


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=piece_encoding.model_path())


def strange(seed, n):
    rng = random.Random(seed)
    letters = "abcdefghij  tion éèßñ12.,-\n\t😀①▁의中\x00<>s/"
    return ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(n)]


def test_encoding_and_decoding_equal_the_library(spark, library):
    texts = [*hostile(3, 30), *strange(1, 400), "  a b ", " " * 50, "<s> </s> <unk> <0x0A>", "ab" * 9000, " " * 9999 + "x", "t" * 5000]
    coded = piece_encoding.encode(frame(spark, texts), ["doc_id", "score"])
    got = {r.doc_id: (r.ids, r.decoded) for r in piece_encoding.decode(coded.withColumnRenamed("score", "decoded_score"), ["doc_id", "decoded_score"]).join(coded.select("doc_id", "ids"), "doc_id").collect()}
    assert got == {i: ((ids := library.encode(t or "")), library.decode(ids)) for i, t in enumerate(texts)}


def test_any_ids_decode_like_the_library(library):
    model, rng = piece_encoding.Model(piece_encoding.model_path()), random.Random(5)
    for _ in range(3000):
        ids = [rng.choice([rng.randrange(32000), rng.randrange(260), rng.choice([259, 264, 28705, 0, 1, 2])]) for _ in range(rng.randrange(0, 8))]
        assert model.decode(ids) == library.decode(ids), ids


def test_backtracking_equals_merging(library):
    model = piece_encoding.Model(piece_encoding.model_path())
    for text in strange(2, 300):
        escaped = text.replace(" ", piece_encoding.SPACE)
        assert model.pieces(escaped) == model.merged(escaped)


def test_other_models_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(piece_encoding.model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "m").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError):
        piece_encoding.Model(str(tmp_path / "m"))


def test_digests_of_the_query(spark, library):
    import hashlib

    sf = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in queries.op12_piece_encoding(spark, sf).collect():
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lowered(text))


def brute_search(docs, items, k):
    counts = [Counter(terms(t)) for _, t in docs]
    n, total = sum(1 for c in counts if c), sum(c.total() for c in counts)
    df = Counter(t for c in counts for t in c)
    out = Counter()
    for item_id, text in items:
        scored = []
        for (doc_id, _), c in zip(docs, counts, strict=True):
            m = 100 - 50 + 50 * c.total() * n // total if total else 0
            s = sum(floor(1000 * log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in set(terms(text)) if t in c)
            if s:
                scored.append((-s, doc_id is None, doc_id or 0, doc_id))
        out.update((item_id, r, d, -s) for r, (s, _, _, d) in enumerate(sorted(scored)[:k], 1))
    return out


@pytest.fixture()
def small_segments(monkeypatch):
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", 16)
    monkeypatch.setattr(ranked_search, "BLOCK_TERMS", 40)


@pytest.mark.parametrize(("k", "most_terms"), [(1, 1 << 20), (5, 1 << 20), (50, 0), (500, 1 << 20)])
def test_search_matches_brute_force(spark, monkeypatch, small_segments, k, most_terms):
    monkeypatch.setattr(ranked_search, "MOST_TERMS", most_terms)
    texts = [*enumerate(hostile(9, 120)), (None, "w1 w2 w3 w3"), (None, "w1 w2 w3 w3"), (4, "w1 w2"), (4, "w1 w2"), (900, "W7 " * 300)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, 5, 0.5) for i, t in texts], DOC_SCHEMA).repartition(3)
    items = [(1, "w1 w2 W3 zz"), (2, " ".join(t for t in texts[20][1].split())), (3, None), (4, ""), (5, "nowhere"), (6, "w5"), (6, "w5"), (None, "É é w9"), (7, "w1 " * 50 + texts[70][1])]
    asked = spark.createDataFrame([(i, t, 1.5) for i, t in items], "item_id long, text string, score double")
    got = Counter(tuple(r) for r in ranked_search.search(docs, asked, k).select("item_id", "rank", "doc_id", "score").collect())
    assert got == brute_search(texts, items, k)


def test_search_prunes_and_keeps_ties(spark, monkeypatch):
    """One rare term decides, a frequent one is below the threshold in most lists; hundreds of documents tie at the last place."""
    monkeypatch.setattr(ranked_search, "SEGMENT_DOCS", 64)
    rng = random.Random(4)
    texts = [(i, " ".join(["the"] * rng.randrange(1, 4) + [f"x{rng.randrange(500)}" for _ in range(rng.randrange(5, 90))])) for i in range(700)]
    texts += [(i, "same rare words here") for i in range(999, 700, -1)]
    items = [(1, "the rare x1 x2 x3"), (2, "the x9"), (3, "same words")]
    docs = spark.createDataFrame(texts, "doc_id long, text string").repartition(4)
    got = Counter(tuple(r) for r in ranked_search.search(docs, spark.createDataFrame(items, "item_id long, text string"), 20).collect())
    assert got == brute_search(texts, items, 20)


def test_search_of_nothing(spark):
    none, one = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a")], "item_id long, text string")
    assert ranked_search.search(none, items).count() == 0
    assert ranked_search.search(one, items.where("false")).count() == 0
    assert ranked_search.search(one, spark.createDataFrame([(1, None)], "item_id long, text string")).count() == 0
    assert np.array_equal([r.score > 0 for r in ranked_search.search(one, items).collect()], [True])
