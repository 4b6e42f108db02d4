import random

import pytest

from markloom.functions import checks, chunks, wiki
from markloom.operators import elements as E

SAMPLES = [
    "", "plain", "{{a|b={{c|d}}|e}} x", "{{a", "b}} {{c}}", "[[x|y]] <ref name=q>{{cite|t=[[z]]}}</ref><ref name=q />",
    "<nowiki>{{x}}</nowiki>{{y<!-- }} -->|z}}", "<math>a_{{b}}</math\n> {{t}}", "{|\n|-\n| a || {{b|c=|}}\n|}\nx {|", "<references>\n<ref>a</ref>\n{{r|k}}\n</references>",
    "* a\n*b\n\n# c\nx\n:d", "{{Infobox  Big\n box | a = 1 | b=2=3 |  | [[c|d=e]] | f = {{g|h=1}} }}", "{{{a|b}}} {{ {{{c}}} | d }}", "<pre>\n[[</pre>]] [[b]]", "é{{ü|ñ=ß}}𝒳{{z}}", "{{#if:x|y}} {{subst:q}} {{ a }}{{a}}",
]


def texts(spark, samples):
    return spark.createDataFrame(list(enumerate(samples)), "id int, text string")


def nested(rng, depth=0):
    """A random text whose marks nest."""
    out = []
    for _ in range(rng.randrange(1, 4)):
        kind = rng.randrange(9 if depth < 4 else 3)
        inner = nested(rng, depth + 1) if kind > 2 else ""
        out.append(["ab c", "é\n", "<!-- {{ -->", f"{{{{t{rng.randrange(5)}|k={inner}|{inner}}}}}", f"[[{inner}]]", f"<ref>{inner}</ref>", f"\n{{|\n{inner}\n|}}\n", f"<nowiki>[[{inner[:5].replace('<', '')}</nowiki>", f"<b>{inner}</b>"][kind])
    return "".join(out)


def spans_of(text):
    m = wiki.Markup(text)
    return sorted((e.kind, e.name, e.start, e.end) for e in m.elements if e.kind != "argument")


@pytest.mark.parametrize("seed", [1, 2])
def test_elements_equal_a_stack(spark, seed):
    rng = random.Random(seed)
    samples = SAMPLES + [nested(rng) for _ in range(80)]
    got = {}
    for r in E.elements(texts(spark, samples)).where("kind <> 'argument'").collect():
        got.setdefault(r.id, []).append((r.kind, r.name, r.s, r.e))
    for i, text in enumerate(samples):
        assert sorted(got.get(i, [])) == spans_of(text), text


def test_parents_and_depths(spark):
    rng = random.Random(7)
    samples = SAMPLES[2:12] + [nested(rng) for _ in range(40)]
    got = {(r.id, r.s, r.e): (r.depth, r.parent and (r.parent.s, r.parent.e)) for r in E.elements(texts(spark, samples)).collect()}
    for i, text in enumerate(samples):
        m = wiki.Markup(text)
        for e in m.elements:
            around, depth = m.elements[e.parent] if e.parent >= 0 else None, 0
            p = e
            while p.parent >= 0:
                p, depth = m.elements[p.parent], depth + 1
            assert got[i, e.start, e.end] == (depth, around and (around.start, around.end)), text


def test_crossing_elements_are_plain_text(spark):
    got = E.elements(texts(spark, ["{{a [[b}} c]] {{d}}", "[[ {{ [[x]] ]] y }}"])).select("id", "kind", "s").collect()
    assert sorted(tuple(r) for r in got) == [(0, "template", 14), (1, "link", 6)]


@pytest.mark.parametrize("name", ["masked", "protected", "names"])
def test_views_equal_the_functions_on_one_text(spark, name):
    rng = random.Random(11)
    samples = SAMPLES + [nested(rng) for _ in range(60)]
    frame = texts(spark, samples)
    if name == "masked":
        got = {r.id: r.t for r in frame.select("id", E.masked(frame["text"]).alias("t")).collect()}
        want = {i: checks.masked(t) for i, t in enumerate(samples)}
    elif name == "protected":
        got = {i: [] for i in range(len(samples))}
        for r in E.protected_spans(frame).orderBy("id", "ord").collect():
            got[r.id].append((r.s, r.e))
        want = {i: chunks.protected_spans(t) for i, t in enumerate(samples)}
    else:
        got = {i: [] for i in range(len(samples))}
        for r in E.template_names(frame).orderBy("id", "ord").collect():
            got[r.id].append(r.name)
        want = {i: wiki.template_names(t) for i, t in enumerate(samples)}
    for i, text in enumerate(samples):
        assert got[i] == want[i], text


def test_params_equal_the_scanner(spark):
    rng = random.Random(5)
    samples = SAMPLES + [nested(rng) for _ in range(40)]
    got = {}
    for r in E.template_params(texts(spark, samples)).orderBy("id", "s", "n").collect():
        got.setdefault((r.id, r.s), []).append((r.name, r.value, r.keyed, r.v, r.b))
    for i, text in enumerate(samples):
        m = wiki.Markup(text)
        for e in m.of("template"):
            assert got.get((i, e.start), []) == [(p.name, p.value, p.keyed, *p.value_span) for p in m.params(e)], text


def test_edits(spark):
    frame = texts(spark, ["0123456789", "abc", None])
    edits = spark.createDataFrame([(0, 2, 4, "X"), (0, 2, 3, "no"), (0, 7, 7, "+"), (0, 9, 10, ""), (1, 0, 3, "")], "id int, s int, e int, new string")
    got = {r.id: (r.text, r.n) for r in E.edited(frame, edits).collect()}
    assert got == {0: ("01X456+78", 3), 1: ("", 1), 2: (None, 0)}
    assert E.elements(frame.where("id = 2")).count() == 0
    assert E.protected_spans(frame.limit(0)).count() == 0
