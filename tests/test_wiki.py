"""Worked cases of the scanner, checks, cuts and rewrites."""

import random

import pytest

from markloom.functions import checks as C, chunks as K, rewrites as W, wiki as M


def kinds(text):
    return [f[0] for f in C.validated(text)]


def test_elements_nest_and_ignore_unmatched_marks():
    m = M.Markup("{{a|b={{c|d}}|e}} ]] {{x [[L|m]] <ref>q</ref> {{{p|1}}} {{{{z}}}} <!-- {{n}} --> <nowiki>{{v</nowiki>")
    assert [(e.kind, m.source(e)) for e in m.elements if e.kind != "template"] == [("link", "[[L|m]]"), ("tag", "<ref>q</ref>"), ("argument", "{{{p|1}}}"), ("comment", "<!-- {{n}} -->"), ("tag", "<nowiki>{{v</nowiki>")]
    assert [m.source(e) for e in m.of("template")] == ["{{a|b={{c|d}}|e}}", "{{c|d}}", "{{{{z}}}}", "{{z}}"]
    assert [(p.name, p.value, p.keyed) for p in m.params(m.elements[0])] == [("b", "{{c|d}}", True), ("1", "e", False)]
    assert M.Markup("").elements == []


def test_elements_of_random_marks_are_well_nested():
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(["{{", "}}", "[[", "]]", "|", "=", "a ", "\n{|", "\n|}", "<ref>", "</ref>", "{", "}", "<!--", "-->", "<pre>", "</pre>"]) for _ in range(40))
        m = M.Markup(text)
        for i, e in enumerate(m.elements):
            assert e.start < e.end and e.start <= e.inner[0] <= e.inner[1] <= e.end
            for f in m.elements[i + 1 :]:
                assert f.start >= e.end or f.end <= e.end
        assert "".join(K.cut_after(text, [b for _, b in K.protected_spans(text)])) == text
        C.validated(text)


@pytest.mark.parametrize(
    "text, want",
    [
        ("{{convert|ten|km}}\n", [("convert_malformed", "error", 1)]),
        ("A.\n\n{{harvc|last=X}}\n", [("harvc_used", "error", 3)]),
        ("{{sfn|A|1990|text=x}}\n", [("sfn_unsupported_param", "warning", 1)]),
        ("{|\n! Y !! C\n|-\n| 1980 || a\n|-\n| 1990\n|-\n| 2000 || c\n|}\n", [("table_span_mismatch", "warning", 6)]),
        ('{|\n! A !! B !! C\n|-\n| rowspan="2" | x || 1 || 2\n|-\n| Beta\n|-\n| y || 5 || 6\n|}\n', [("table_span_mismatch", "warning", 6)]),
        ('{|\n! A !! B\n|-\n| rowspan=2 | x || 1\n|-\n| 2\n|-\n| y || 3\n|}\n', []),
        ("{|\n! A !! B\n|-\n| 1 || 2\n|-\n| 3 || 4\n|-\n| 5\n|-\n| 6\n|}\n", []),
        ("{|\n| 1 || 2\n|-\n| 3 || 4\n|}\n", []),
        ("'''X''' is {{convert|5|km}}.<ref>{{cite web|url=http://a}}</ref>\n\n== H ==\n* [[L]]\n", []),
        ("a\nb [[x]] ]]", [("link", "error", 2)]),
        ("Clean <ref>citation</ref>\nExtra </ref>", [("reference", "error", 2)]),
        ("<math>\\tfrac{a}{b_{c}}</math> fine", []),
        ("{{val|12.6|u=km/s|}} and\n{|\n| a\n", [("table", "error", None)]),
        ("text == H ==\nmore", [("heading", "error", None)]),
        ("}}{{", []),
        ("", []),
    ],
)
def test_structural_findings(text, want):
    assert [(f[0], f[2], f[3]) for f in C.validated(text)] == want


def test_snippets_and_repetition():
    assert C.validated("a\nb [[x]] ]]")[0][4].startswith("]]")
    assert kinds("One and the same sentence. " * 400) == ["degenerate_repetition"]
    rng = random.Random(2)
    assert kinds("\n".join(f"| {rng.random()} || {rng.random()}" for _ in range(80))) == []
    assert kinds("Sorry, as an AI language model") == ["leaked_commentary"]
    assert C.masked("a<pre>b\nc</pre>d") == "a      \n       d"


def test_cuts_keep_all_text():
    rng = random.Random(3)
    body = lambda n: " ".join(f"w{rng.randrange(99)}" + rng.choice(["", ".", ",", "\n\n"]) for _ in range(n))
    for _ in range(40):
        parts = [(f"S{i}", f"== S{i} ==\n" + body(rng.randrange(1, 300)) + rng.choice(["", "{{t|" + body(40) + "}}", "\n* a\n* b\n", "<ref>" + body(20) + "</ref>"])) for i in range(rng.randrange(1, 6))]
        out = K.chunks(parts, 50, 200)
        assert "".join(t for _, t in out) == "".join(t for _, t in parts)
        assert [t for ts, _ in out for t in ts if True][:1] == ["S0"]
        for a, b in K.protected_spans(parts[0][1]):
            assert any(parts[0][1][a:b] in t for _, t in out)
    small = [(f"S{i}", f"== {i} ==\nshort text here\n") for i in range(10)]
    assert len(K.chunks(small, 50, 200)) < 10


def test_no_near_empty_chunks():
    table = "== T ==\n{|\n" + "".join(f"|-\n| row {i} || value {i}\n" for i in range(300)) + "|}\n"
    assert [K.token_count(t) > 100 for _, t in K.chunks([("T", table)], 100, 300)] == [True]
    assert K.section_pieces("", 10, 20) == [""]
    assert K.free_units("One. Two. Three.\n\nFour.", 3) == ["One. ", "Two. ", "Three.\n\n", "Four."]


def test_protected_spans():
    text = "lead {{a\n\n|b}} x <!-- c\n\nd -->\n* l1\n* l2\nend <references><ref>a. b</ref> {{r|x}} t</references>"
    assert [text[a:b] for a, b in K.protected_spans(text)] == ["{{a\n\n|b}}", "<!-- c\n\nd -->", "* l1\n* l2\n", "<ref>a. b</ref>", "{{r|x}}"]
    saved = "lead\n== A ==\nx\n=== B ===\ny\n" + "z\n\n" * 9000
    assert "".join(t for _, t in K.saved_pieces(saved)) == saved and len(K.saved_pieces(saved)) == 5


def test_names_boxes_and_groups():
    assert M.template_names("{{ A|{{b}}}}{{#if:x}}{{subst:c}}{{A}}") == ["A", "b"]
    assert M.ill_renderings("{{ill|Foo|en|Bar}}{{ill|Foo2|en|Bar}}{{ill|Q|en}}{{ill|Z|de|Y}}") == [("Bar", "Foo"), ("Q", "Q")]
    box = "{{Infobox x|a={{b}}}}"
    assert M.lost_boxes(box + "{{Kuti y}}", "{{Kuti z}} t") == ["{{Kuti y}}"]
    assert M.with_boxes("{{short}}<!-- c -->\ntext", [box]) == "{{short}}<!-- c -->\n" + box + "\ntext"
    assert M.implicit_note_group("{{efn|a}}") and not M.implicit_note_group("{{efn|a|group=x}}")
    assert M.note_counts("{{efn|a}}{{Notelist}}{{Listë shënimesh}}") == {"efn": 1, "listë shënimesh": 2}


def test_reference_blocks():
    assert M.is_reference_only("<ref name=a>x</ref> <!-- c --></references>") and not M.is_reference_only("<ref name=a/>")
    src = "== R ==\n<ref name=a>x</ref>\n"
    assert M.source_reference_block(src, "== T ==\nzz") == "== T ==\n<ref name=a>x</ref>\n"
    assert M.source_reference_block("text\n<ref>a</ref>", "m") == "m"
    assert M.extended_references("<references></references>\n<ref>b</ref> <!-- c -->\n<REF>d</ref> end") == "<references><ref>b</ref> <!-- c -->\n<REF>d</ref>\n</references> end"
    many = "<references></references>" + "\n<ref>b</ref>" * 100_000
    assert M.extended_references(many).endswith("<ref>b</ref>\n</references>") and M.is_reference_only(many)


def test_citation_rewrites():
    assert W.english_params("{{Cite web| titulli =A|redaktori1=B|data=1|date=2}}{{x|titulli=q}}") == ("{{Cite web| title =A|editor1=B|data=1|date=2}}{{x|titulli=q}}", [("titulli", "title"), ("redaktori1", "editor1")])
    assert W.with_languages("{{cite web|title=T|url=u}}{{cite web|lang=en|url=u}}", {"u": "de"}, {"T": "fr"}) == ("{{cite web|title=T|url=u|language=fr}}{{cite web|lang=en|url=u}}", 1)
    assert W.unwrapped_notes("<ref> {{sfn|A|1}} </ref><ref name=x>{{sfn|A|1}}</ref><ref>{{sfn|A|1}} t</ref>")[0] == "{{sfn|A|1}}<ref name=x>{{sfn|A|1}}</ref><ref>{{sfn|A|1}} t</ref>"
    assert W.plain_notes("<ref>{{Sfn |A|1}}, {{sfnp|B}}</ref>{{sfn|C}}") == ("<ref>{{harvnb |A|1}}, {{harvp|B}}</ref>{{sfn|C}}", 2)
    assert W.nested_notes('a<ref group="n" name=b>T | u.<ref>{{cite|x}}</ref></ref> z<ref>q</ref>') == ("a{{refn|group=n|name=b|1=T {{!}} u.<ref>{{cite|x}}</ref>}} z<ref>q</ref>", 1)
    assert W.nested_notes("<ref>a<ref>b<ref>c</ref></ref></ref>")[1] == 0
    assert W.expanded_r("{{r|name=A|ref=text|page=3}} {{r|A}} {{R|n=B|r=t|loc=x}}") == ('<ref name="A">text</ref>{{Rp|3}} {{r|A}} {{R|n=B|r=t|loc=x}}', 1, 1)
    assert W.without_agencies("{{cite news|agency=AP|title=t}}{{cite news|publisher=P |agency=AP}}{{cite news|publisher=The AP|agency=AP}}") == ("{{cite news|publisher=AP|title=t}}{{cite news|publisher=AP; P }}{{cite news|publisher=The AP}}", 3)


def test_layout_rewrites():
    assert W.unnested_ills("[[{{ill|A|en|B}}|lab]] [[{{ill|A|en|B}}]] [[X|{{ill|A|en|B}}]] [[{{ill|A|en}}|A]]") == ("{{ill|A|en|B|lt=lab}} {{ill|A|en|B}} {{ill|A|en|B}} {{ill|A|en}}", 4)
