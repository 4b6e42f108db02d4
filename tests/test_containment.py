import random

import pytest

from markloom.operators import containment, pairing, relational


def pairs(df):
    return sorted((tuple(r) for r in df.select("scope", "name", "part").collect()), key=repr)


def brute(names, texts):
    return sorted({(s, n, p, i) for s, n in names for i, (t, p, x) in enumerate(texts) if n and x is not None and s == t and s is not None and n in x}, key=repr)


def made(seed):
    rng = random.Random(seed)
    letters = "aabbcdeé ñ.-'\"[]|_1𝒳"
    texts = [(rng.randrange(3), i, "".join(rng.choices(letters, k=rng.randrange(0, 60)))) for i in range(60)]
    names = set()
    for s, _, x in texts:
        for _ in range(4):
            a = rng.randrange(len(x) + 1)
            names.add((s if rng.random() < 0.7 else rng.randrange(3), x[a : a + rng.randrange(1, 14)]))
        names.add((s, "".join(rng.choices(letters, k=rng.randrange(1, 5)))))
    extra = [(0, ""), (0, None), (None, "a"), (1, "part of"), (1, "art o"), (1, "—"), (2, "]]"), (2, "."), (1, "a")]
    return [*names, *extra, *extra[3:5]], [*texts, (1, 900, "a part of"), (1, 901, None), (1, 902, ""), (None, 903, "a"), (2, 904, "x — y ]]"), texts[0]]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_held_equals_contains(spark, seed):
    names, texts = made(seed)
    got = pairs(containment.held(spark.createDataFrame(names, "scope long, name string"), spark.createDataFrame(texts, "scope long, part long, text string")))
    assert got == sorted((r[:3] for r in brute(names, texts)), key=repr)


def test_no_pair_without_a_common_token(spark):
    texts = spark.createDataFrame([(1, i, f"word{i} common") for i in range(300)], "scope long, part long, text string").withColumnRenamed("part", "text_id")
    names = spark.createDataFrame([(1, f" word{i} ") for i in range(300)] + [(1, "common")], "scope long, name string")
    found = containment.anchors(names, containment.text_words(texts))
    assert found.where("name <> 'common'").count() == 300  # one rare word each, though none is held
    names = spark.createDataFrame([(1, f"word{i} common") for i in range(300)], "scope long, name string")
    met = containment.anchors(names, containment.text_words(texts)).join(containment.text_words(texts), ["scope", "word"])
    assert met.count() <= 300 * 12  # ends of words: "word1" may end only "word1"


def test_empty_sides(spark):
    names, texts = spark.createDataFrame([(1, "a")], "scope long, name string"), spark.createDataFrame([(1, 1, "a")], "scope long, part long, text string")
    assert containment.held(names.limit(0), texts).count() == 0
    assert containment.held(names, texts.limit(0)).count() == 0
    assert pairs(containment.held(names, texts)) == [(1, "a", 1)]


@pytest.mark.parametrize("seed", [1, 2])
def test_lines_meet_the_first_span_that_holds_them(spark, seed):
    rng = random.Random(seed)
    spans = [(rng.choice([1, 2, None]), i, (a := rng.randrange(-20, 5000)), a + rng.choice([-1, 0, 1, 2, 3, 7, 8, 9, 100, 4000])) for i in range(200)]
    spans += [(1, 300, None, 4), (1, 301, 4, None)]
    findings = [(rng.choice([1, 2, 3, None]), i, rng.choice([None, rng.randrange(-30, 9500)])) for i in range(400)]
    findings += findings[:5]
    got = sorted((tuple(r) for r in relational.locate_findings(spark.createDataFrame(findings, "article long, finding long, line long"), spark.createDataFrame(spans, "article long, ord long, first_line long, last_line long")).collect()), key=repr)
    want = {(a, f, min((o for b, o, x, y in spans if None not in (a, line, x, y) and a == b and x <= line <= y), default=None)) for a, f, line in findings}
    assert got == sorted(want, key=repr)


def test_a_hot_article_is_dealt_over_tasks(spark):
    n = 200_000
    spans = spark.range(n // 10).selectExpr("1L AS article", "id AS ord", "id * 10 AS first_line", "id * 10 + 9 AS last_line")
    findings = spark.range(n).selectExpr("1L AS article", "id AS finding", "id AS line")
    out = relational.locate_findings(findings, spans)
    assert out.where("ord = finding DIV 10").count() == n
    bins = spans.selectExpr("explode(array(first_line DIV 16, last_line DIV 16)) AS bin").groupBy("bin").count().agg({"count": "max"}).first()[0]
    assert bins <= 4


def test_messages_reach_the_first_chunk_with_the_reference(spark):
    chunks = [(1, 0, "x", None), (1, 1, '<ref group=g name="A&amp;b">', "y"), (1, 2, "", "<REF NAME='a&b' />"), (1, 3, None, "<ref name = 'c'>"), (2, 0, "n", "n")]
    findings = [
        (1, 1, "cite_error", None, "Gabim: “A&amp;B” used twice"),
        (1, 2, "cite_error", None, "Gabim: “A&amp;B” used twice"),
        (1, 3, "orphaned_named_ref", None, "‘nowhere’ and 'zz'"),
        (1, 4, "lua_script_error", None, 'in "A&b"'),
        (1, 5, "unexpanded_template", None, "Moduli:X"),
        (1, 6, "cite_error", 4, "“A&b”"),
        (1, 10, "cite_error", None, "Gabim: 'C' used"),
        (2, 7, "lua_script_error", None, "harvc"),
        (2, 8, "harvc_used", 3, "harvc"),
        (None, 9, "cite_error", None, "“A&b”"),
    ]
    got = sorted(tuple(r) for r in pairing.route_messages(spark.createDataFrame(findings, "article long, finding long, kind string, line long, message string"), spark.createDataFrame(chunks, "article long, ord long, text string, made string")).collect())
    assert got == sorted([(1, 1, 1, True), (1, 3, 10, True), *((1, o, f, False) for o in range(4) for f in (3, 4))])


def test_fact_lines(spark):
    mentions = [(1, 0, "link", t) for t in ("a", "b", "c", "d", "e", "unknown")] + [(1, 0, "link", "a"), (1, 1, "template", "Infobox"), (1, 1, "template", "T"), (1, 1, "template", None)]
    facts = [(1, "link", "a", "A"), (1, "link", "b", None), (1, "link", "c", None), (1, "link", "d", None), (1, "link", "e", None), (1, "template", "Infobox", "Stampa:Box"), (1, "template", "T", None)]
    got = {(r.kind, r.title): (r.state, r.value) for r in pairing.fact_lines(
        spark.createDataFrame(mentions, "article long, chunk long, kind string, title string"), spark.createDataFrame(facts, "article long, kind string, title string, target string"),
        spark.createDataFrame([(1, "b", "Bë"), (2, "c", "x")], "article long, title string, rendering string"), spark.createDataFrame([("c", 4), ("d", 0), ("b", 1)], "title string, n long"),
        spark.createDataFrame([("Infobox", ["name", "x"])], "title string, params array<string>")).collect()}
    assert got == {
        ("link", "a"): ("confirmed", "A"), ("link", "b"): ("established", "Bë"), ("link", "c"): ("elsewhere", "4"), ("link", "d"): ("nowhere", "0"), ("link", "e"): ("missing", None),
        ("template", "Infobox"): ("confirmed", "Box: name, x"), ("template", "T"): ("missing", None),
    }
