import math
from collections import Counter

import pytest

import corpus_pipeline
from markloom.llm import lm_score, winnow_decontam

from .fixtures import frame, hostile


def brute(texts, quality):
    """Plain counting."""
    docs = [["", *(t or "").lower().split()] for t in texts]

    def model(chosen):
        one, pair, before = Counter(), Counter(), Counter()
        for i in chosen:
            d = docs[i]
            one.update(d[1:])
            pair.update(zip(d, d[1:], strict=False))
            before.update(d[:-1])
        return one, pair, before

    size, out = len({w for d in docs for w in d[1:]}), []
    every, target = range(len(docs)), [i for i in range(len(docs)) if quality.get(i) == 1]
    scale = sum(model(target)[0].values()) / sum(model(every)[0].values())
    for i, d in enumerate(docs):
        losses = []
        for chosen, f in ((target, 1.0), (every, scale)):
            one, pair, before = model([j for j in chosen if j != i])
            mass, total = sum(one.values()) * f, 0.0
            for v, w in zip(d, d[1:], strict=False):
                p1 = (one[w] * f + lm_score.SMOOTH / 8) / (mass + lm_score.SMOOTH / 8 * size)
                total -= math.log((pair[v, w] * f + lm_score.SMOOTH * p1) / (before[v] * f + lm_score.SMOOTH))
            losses.append(total / max(1, len(d) - 1))
        out.append((len(d) - 1, losses[0], losses[1], losses[0] - losses[1]))
    return out


@pytest.mark.parametrize("slot_bytes", [500, 16 << 20])
def test_scores_match_plain_counting(spark, slot_bytes):
    texts = [t and t.replace("É", "é").replace("Ü", "ü") for t in hostile(31, 30)]
    quality = {i: int(i % 3 != 0) for i in range(0, len(texts), 2)}
    labels = spark.createDataFrame([(i, q, 0) for i, q in quality.items()] + [(2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = lm_score.score(frame(spark, texts).repartition(3), labels, slot_bytes).orderBy("doc_id").collect()
    for r, want in zip(got, brute(texts, quality), strict=True):
        assert (r.n_words, r.loss_target, r.loss_background, r.score) == pytest.approx(want), r.doc_id


def test_counts_grow_with_the_corpus_and_copies_score_apart(spark):
    import random

    rng = random.Random(12)
    texts = [" ".join(f"w{rng.randrange(10**6)}" for _ in range(40)) for _ in range(120)]
    texts += texts[:20]
    rows = lm_score.labelled(frame(spark, texts), spark.createDataFrame([(i, 1, 0) for i in range(40, 80)], "doc_id long, quality int, toxic int"))
    sizes = [lm_score.totals_of(rows.where(f"doc_id < {n}"), 1000)[1].selectExpr("sum(words)", "sum(mass)").first() for n in (30, 60, 120, 140)]
    assert [tuple(x) for x in sizes] == [(len({w for t in texts[:n] for w in t.split()}), 40 * n) for n in (30, 60, 120, 140)]
    got = lm_score.score(frame(spark, texts), spark.createDataFrame([(i, 1, 0) for i in range(40, 80)], "doc_id long, quality int, toxic int")).collect()
    twice = [r.score for r in got if r.doc_id < 20 or r.doc_id >= 120]
    assert min(twice) > max(r.score for r in got if 80 <= r.doc_id < 120)


def test_scores_without_target_or_rows(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert {r.score for r in lm_score.score(frame(spark, ["a b", None]), none).collect()} == {0.0}
    assert lm_score.score(frame(spark, []), none).count() == 0


def test_stages_keep_their_contract(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf)
        if name != "packing":
            assert out.columns == docs.columns
        kept[name] = out.cache()
        docs = kept[name]
    n = {name: df.count() for name, df in kept.items()}
    assert 200 >= n["language_id"] >= 190 > n["near_dedup"] * 0 and n["near_dedup"] < n["language_id"]
    assert n["personal_data"] == n["decontamination"] <= n["near_dedup"]
    texts = [r.text for r in kept["near_dedup"].select("text").collect()]
    assert len(texts) == len(set(texts))
    bench = spark.read.parquet(f"{sf}/benchmark.parquet")
    gone = winnow_decontam.decontaminate(kept["near_dedup"], bench, ["doc_id"]).where("contaminated")
    assert n["near_dedup"] - n["decontamination"] == gone.count() > 0
    packed = kept["packing"].toPandas()
    assert set(packed.doc_id) == {r.doc_id for r in kept["personal_data"].select("doc_id").collect()}
    assert packed.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_on_an_empty_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "/root/testdata/sf0.001")
    assert docs.count() == 0


def brute_groups(texts, least=0.8):
    """Root of each text under links of five-word shingle Jaccard."""
    import re

    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if (not a and not b) or (a | b and len(a & b) >= least * len(a | b)):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def hostile_documents(spark, n=24):
    """Documents with null and repeated ids, extra columns and near copies of 0.8 to 0.95."""
    import random

    rng = random.Random(9)
    some = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("length(text) between 200 and 900 and lang is not null").orderBy("doc_id").limit(n).collect()
    rows = []
    for k, r in enumerate(some):
        rows.append((None if k % 5 == 0 else k // 2, r.text, r.lang, r.source, r.n_chars, f"id{k}", 7.5, -7, k))
        words = r.text.split()
        words[rng.randrange(len(words))] = "changed"
        rows.append((100 + k, " ".join(words), r.lang, r.source, r.n_chars, f"near{k}", 7.5, -7, None))
    rows += [(None, None, None, None, None, None, None, None, None), (3, "", "en", "s", 0, "x", 1.0, 1, 1), (4, "the of and to " * 20000, "en", "s", 0, "long", 1.0, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, id string, score double, n_words long, `row` long")


def test_stages_lose_no_rows_and_keep_columns(spark):
    sf = "/root/testdata/sf0.001"
    docs = hostile_documents(spark)
    rows = docs.collect()
    langs = corpus_pipeline.language_id(spark, docs, sf).collect()
    assert {tuple(r) for r in langs} <= {tuple(r) for r in rows} and len(langs) >= len(rows) - 4
    kept = corpus_pipeline.near_dedup(spark, docs, sf).collect()
    root = brute_groups([r.text for r in rows])
    assert len(kept) == len(set(root))
    at = {tuple(r): k for k, r in enumerate(rows)}
    assert {root[at[tuple(r)]] for r in kept} == set(root)
    groups = [[rows[i] for i in range(len(rows)) if root[i] == g] for g in set(root)]
    for own in groups:
        ids = [r.doc_id for r in own if r.doc_id is not None]
        stays = [r.doc_id for r in kept if r in own]
        assert stays == [min(ids) if ids else None]
    clean = corpus_pipeline.decontamination(spark, docs, sf).collect()
    assert {tuple(r) for r in clean} <= {tuple(r) for r in rows} and len(clean) >= len(rows) // 2
    masked = corpus_pipeline.personal_data(spark, docs, sf)
    assert masked.columns == docs.columns and masked.count() == len(rows)
    same = [c for c in docs.columns if c not in ("text", "n_chars")]
    assert sorted(map(repr, masked.select(same).collect())) == sorted(map(repr, docs.select(same).collect()))
    assert corpus_pipeline.packing(spark, docs, sf).where("piece = 0").count() == len(rows)


def test_run_writes_stages_once_and_leaves_other_tables(spark, monkeypatch, tmp_path):
    from markloom.llm import _store

    other = _store.written(spark.range(3), "other")
    calls = []
    stages = [(n, lambda s, d, f, n=n, g=g: calls.append(n) or g(s, d, f)) for n, g in corpus_pipeline.STAGES]
    monkeypatch.setattr(corpus_pipeline, "STAGES", stages)
    before = _store.made(spark)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 100 and calls == [n for n, _ in stages] and other.count() == 3
    assert _store.made(spark) <= before + 8
