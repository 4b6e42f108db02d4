import random

import pytest
from pyspark.sql import functions as F

from markloom.functions import chunks as K
from markloom.operators import cutting as C

from .test_elements import SAMPLES, nested


def prose(rng, n):
    out = []
    for _ in range(n):
        out.append(" ".join(rng.choices(["wort", "b,", "c.", "d!", "é?", "{{t|x y z}}", "[[l]]"], k=rng.randrange(1, 25))))
        out.append(rng.choice(["\n\n", "\n \t\n", "\n", " ", "\n* a b\n* c\n", "\n\n\n\n"]))
    return "".join(out)


def made(seed):
    rng = random.Random(seed)
    return SAMPLES + [nested(rng) for _ in range(15)] + [prose(rng, rng.randrange(1, 30)) for _ in range(25)] + ["x " * 500, "{{big|" + "y " * 300 + "}} tail"]


def frame(spark, samples):
    return spark.createDataFrame(list(enumerate(samples)), "id int, text string")


def test_token_counts(spark):
    samples = made(3)
    got = {r.id: r.n for r in frame(spark, samples).select("id", C.token_count(F.col("text")).alias("n")).collect()}
    assert got == {i: K.token_count(t) for i, t in enumerate(samples)}


def test_free_units(spark):
    samples = [s for s in made(4) if s]
    got = {}
    for r in C.free_units(frame(spark, samples), 8).orderBy("id", "ord").collect():
        got.setdefault(r.id, []).append(r.unit)
    assert got == {i: K.free_units(t, 8) for i, t in enumerate(samples)}


@pytest.mark.parametrize(("least", "most"), [(10, 20), (1, 3), (50, 60)])
def test_pieces_equal_one_pass_over_a_text(spark, least, most):
    samples = made(5)
    got = {}
    for r in C.section_pieces(frame(spark, [*samples, None]), least, most).orderBy("id", "piece").collect():
        got.setdefault(r.id, []).append(r.text)
        assert r.tokens == K.token_count(r.text) or "{{" in r.text or "\n" in r.text
    assert got == {i: K.section_pieces(t, least, most) for i, t in enumerate(samples)}


def brute_pack(sizes, least, most, alone):
    out, piece, size, held = [], 0, 0, 0
    for n in sizes:
        if held and (size >= least or n <= most < size + n or (n > most and (alone or size >= least))):
            piece, size, held = piece + 1, 0, 0
        out.append(piece)
        size, held = size + n, held + 1
        if n > most:
            piece, size, held = piece + 1, 0, 0
    return out


@pytest.mark.parametrize("alone", [False, True])
@pytest.mark.parametrize(("least", "most"), [(5, 9), (1, 1), (30, 31), (7, 100)])
def test_packing_equals_one_pass(spark, alone, least, most):
    rng = random.Random(least)
    sizes = {t: [rng.choice([0, 0, 1, 2, 3, 5, 8, 13, 40]) for _ in range(rng.randrange(1, 120))] for t in range(40)}
    rows = [(t, i, n) for t, own in sizes.items() for i, n in enumerate(own)]
    got = {}
    for r in C.packed(spark.createDataFrame(rows, "id int, i int, n int"), least, most, alone).orderBy("id", "i").collect():
        got.setdefault(r.id, []).append(r.piece)
    assert got == {t: brute_pack(own, least, most, alone) for t, own in sizes.items()}


def test_chunks_of_articles(spark):
    rng = random.Random(9)
    articles = {a: [(f"T{i}", prose(rng, rng.randrange(0, 12))) for i in range(rng.randrange(1, 9))] for a in range(12)}
    rows = [(a, i, t, x) for a, own in articles.items() for i, (t, x) in enumerate(own)]
    got = {}
    for r in C.article_chunks(spark.createDataFrame(rows, "article int, n int, title string, text string"), 15, 40).orderBy("article", "ord").collect():
        got.setdefault(r.article, []).append((r.titles, r.text))
    assert got == {a: K.chunks(own, 15, 40) for a, own in articles.items()}


def test_nothing(spark):
    none = frame(spark, ["x"]).limit(0)
    assert C.section_pieces(none, 5, 9).count() == 0
    assert [tuple(r) for r in C.section_pieces(frame(spark, [""]), 5, 9).collect()] == [(0, 0, "", 0)]
