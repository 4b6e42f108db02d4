import random

import corpus_pipeline
from markloom.llm import near_copies

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def groups(texts):
    """Brute force: the component of each text under Jaccard of 0.8 or more."""
    sets, comp = [shingles(t) for t in texts], list(range(len(texts)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                comp[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(len(texts))]


def edited(rng, words, edits):
    out = list(words)
    for i in rng.sample(range(len(out)), edits):
        out[i] = f"z{rng.randrange(10**9)}"
    return " ".join(out)


def planted():
    rng = random.Random(4)
    texts = [None, "", " \n", "one two", "ONE  two", "one two three"]
    passage = [f"p{i}" for i in range(60)]
    for _ in range(25):
        base = [f"v{rng.randrange(5000)}" for _ in range(rng.randrange(20, 300))]
        base = base[:10] + passage * rng.randrange(2) + base[10:]
        texts.append(" ".join(base))
        texts += [edited(rng, base, e) for e in (1, 2, 4, 6, 8) if e < len(base) // 15]
    chain = [f"c{i}" for i in range(400)]
    for _ in range(12):
        chain = edited(rng, chain, 7).split()
        texts.append(" ".join(chain))
    return texts


def test_near_dedup_matches_brute_force(spark):
    texts = planted()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    got = sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect())
    assert got == sorted(set(groups(texts))) and len(got) < len(texts) - 40


def dense_pairs():
    """Texts of one base whose slots hold one of three words: all shingles are in more texts than FEW, and a text is similar to its partner alone."""
    rng = random.Random(9)
    codes = [[rng.randrange(3) for _ in range(12)] for _ in range(150)]
    codes += [[(c + (i in (2, 7))) % 3 for i, c in enumerate(code)] for code in codes]
    return [" ".join(f"s{i}v{c} " + " ".join(f"b{i}w{k}" for k in range(8)) for i, c in enumerate(code)) for code in codes]


def test_large_keys_meet_whole(spark, monkeypatch):
    """Nodes of keys of more than FEW nodes once met their leads only, and some of these pairs stayed apart."""
    texts = dense_pairs()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    want = sorted(set(groups(texts)))
    assert len(want) <= 150
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want
    monkeypatch.setattr(near_copies, "CELL", 4000)  # several cuts of a class
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()) == want


def test_every_similar_pair_shares_a_key():
    import pyarrow as pa

    sets = list(near_copies.shingle_sets(pa.array(planted(), pa.large_string())))
    none = (sets[0][:0], sets[0][:0])
    for i, a in enumerate(sets):
        for b in sets[:i]:
            if len(a) and len(b) and near_copies.similar(a, b):
                assert set(near_copies.prefix(a, *none)) & set(near_copies.prefix(b, *none))


def test_rows_of_null_and_repeated_ids_stay(spark):
    rng = random.Random(6)
    texts = [" ".join(f"q{rng.randrange(10**6)}" for _ in range(30)) for _ in range(12)]
    ids = [None] * 5 + [7] * 5 + [8, 9]
    rows = [(i, t, "en", "s", len(t)) for i, t in zip(ids, texts, strict=True)]
    docs = spark.createDataFrame(rows + [rows[0], rows[6], (3, texts[11], "en", "s", 1), (None, texts[11], "en", "s", 1)], SCHEMA)
    got = [(r.doc_id, r.text) for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    want = [(i, t) for i, t in zip(ids[:11], texts, strict=False)] + [(3, texts[11])]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_members_of_large_keys_are_joined_with_their_fingerprints_once(spark):
    """Cells once joined them four times each, which on a large group of near copies looked like pairs."""
    own = spark.createDataFrame([(k, v, v, 100 + v, v, v) for k in range(2) for v in range(9)], "key long, node long, root long, n long, a long, b long")
    dealt = near_copies.cells(own, near_copies.F.lit(near_copies.CELL // 3))
    met = {}
    for r in dealt.collect():
        met.setdefault((r.key, r["class"], r.i, r.j), set()).add(r.node)
    assert all(any({u, v} <= nodes for (k, *_), nodes in met.items() if k == key) for key in range(2) for u in range(9) for v in range(u))
    assert "[node" not in "".join(line for line in dealt._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line)
