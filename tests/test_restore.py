"""References of translations set right by their sources, from text to text."""

from markloom.functions import refs
from markloom.operators import restore as V

CASES = [
    (V.renamed_references, 'a<ref name="x1">u http://a.b 12</ref> b<ref name="x1" /> c<ref name="y">no key</ref>', '<ref name="Real">v http://a.b 12</ref>', 'a<ref name="Real">u http://a.b 12</ref> b<ref name="Real" /> c<ref name="y">no key</ref>'),
    (V.renamed_references, 'a<ref name=x>http://a</ref><ref name=x>http://b</ref><ref name=x/>', "<ref name=A>http://a</ref><ref name=B>http://b</ref>", "a<ref name=A>http://a</ref><ref name=B>http://b</ref><ref name=x/>"),
    (V.renamed_references, "a<ref name=x>http://a</ref>", "<ref name=A>http://a</ref><ref name=B>http://a</ref>", "a<ref name=x>http://a</ref>"),
    (V.regrouped_references, '<ref group="shënim" name="q">b</ref><ref group=shënim name=q />', '<ref group="note">a</ref>', '<ref name="q" group="note">b</ref><ref name="q" group="note" />'),
    (V.regrouped_references, '<ref group="a">b</ref>', "{{efn|x}}", '<ref group="lower-alpha">b</ref>'),
    (V.defined_orphans, 'a<ref name="o" /> b<ref name="o" /> <ref name="p"/>', '<ref name="o">body</ref><ref name="o">other</ref>', 'a<ref name="o">body</ref> b<ref name="o" /> <ref name="p"/>'),
    (V.without_unsupported, 'a<ref name="zz" /> b<ref name="p" />c<ref name="d">x</ref><ref name="d" />', "text of p only", 'a b<ref name="p" />c<ref name="d">x</ref><ref name="d" />'),
    (V.collapsed, "<ref name=a>one  two</ref><ref name=a>one two</ref><ref name=a>three</ref>", "<ref name=a>one</ref>", '<ref name=a>one  two</ref><ref name=a>one two</ref><ref name="a" />'),
    (V.without_list_copies, "b<ref name=a>x</ref><references><ref name=a>x</ref></references>", "<ref name=a /><references><ref name=a>x</ref></references>", 'b<ref name="a" /><references><ref name=a>x</ref></references>'),
    (V.without_stray_lists, "t\n{{Reflist}}\nu\n== Shënime ==\n{{notelist}}\n== R ==\n{{reflist}}\n<references group=z />", "{{notelist}} {{reflist}}", "t\nu\n== Shënime ==\n{{notelist}}\n== R ==\n{{reflist}}\n"),
    (V.without_stray_lists, "{{Reflist}}{{notelist|notes=x}}\n<references />", "none", "{{notelist|notes=x}}\n"),
]


def test_texts_are_set_right(spark):
    for fn in dict.fromkeys(c[0] for c in CASES):
        own = [c for c in CASES if c[0] is fn]
        rows = [(i, text, source) for i, (_, text, source, _) in enumerate(own)] + [(90, None, None), (91, "plain", "")]
        got = {r.article: r.text for r in fn(spark.createDataFrame(rows, "article long, text string, source string")).collect()}
        assert got == {i: want for i, (*_, want) in enumerate(own)} | {90: "", 91: "plain"}, fn.__name__


def test_rows_of_references():
    text = "<ref name='a b' group=g>x 1</ref><ref name=c/>"
    rows = refs.references(text)
    assert [(r[2], r[5], r[6], r[9], r[10]) for r in rows] == [("a b", "g", "x 1", False, "#1"), ("c", None, None, False, None)]
    assert [text[r[3] : r[4]] for r in rows] == ["a b", "c"] and refs.references("") == refs.lists("") == []
