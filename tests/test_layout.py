import pytest
from pyspark.sql import functions as F

from markloom.operators import layout as L, rewriting as R


def run(spark, fn, samples):
    got = {r.id: (r.text, r.n) for r in fn(spark.createDataFrame(list(enumerate(samples)), "id int, text string")).collect()}
    return [got[i] for i in range(len(samples))]


def test_dates(spark):
    values = ["February 2019", "27 November 2025", "Jan 5, 2020", "Dhjetor 2021", "2008-03", "2008-03-01", "5 Foo 2020", "", "² May 2020", "May 2020 5"]
    want = ["February 2019", "2025-11-27", "2020-01-05", "December 2021", "March 2008", "2008-03-01", "5 Foo 2020", "", "² May 2020", "May 2020 5"]
    got = run(spark, L.right_dates, ["{{cite web|date= " + v + " |x=1 May 2000}}{{y|date=2001-02}}" for v in values])
    assert got == [("{{cite web|date= " + w + " |x=1 May 2000}}{{y|date=2001-02}}", int(v != w)) for v, w in zip(values, want, strict=True)]
    assert run(spark, L.right_dates, ["{{cite web|archive-url=http://web.archive.org/web/20200129133126/x|archive-date=1 May 2000}}", None]) == [("{{cite web|archive-url=http://web.archive.org/web/20200129133126/x|archive-date=2020-01-29}}", 1), (None, 0)]


def test_as_of(spark):
    got = run(spark, L.right_as_of, [
        "Text {{As of|2021|4|lang=sq}}. {{as of|April 5, 2020}} {{As of|2019}}", "x.<ref>a</ref>{{sfn|A|1}} {{As of|2010|May|3|lc=y|df=x}}", "{{As of|2010|²}}", "{{As of|²|4}}", "{{As of|2010|13}}", "{{As of|2010|alt=z|lang=sq}}", "{{As of|{{y}}|2}}", "{{As of|2010|2|alt=z}}"])
    assert got == [
        ("Text {{As of|2021|alt=që nga prilli 2021}}. {{As of|2020|alt=Që nga 5 prilli 2020}} {{As of|2019}}", 2),
        ("x.<ref>a</ref>{{sfn|A|1}} {{As of|2010|alt=që nga 3 maji 2010|df=x}}", 1),
        ("{{As of|2010}}", 1), ("{{As of|²|4}}", 0), ("{{As of|2010}}", 1), ("{{As of|2010|alt=z}}", 1), ("{{As of|{{y}}|2}}", 0), ("{{As of|2010|alt=z}}", 1),
    ]


def test_ages(spark):
    call = "{{{{age in years and days|{}}}}}".format
    cases = {"1946|02|02|1952|11|10": "6 vjet, 282 ditë", "1946|2|2": "", "1896|2|29|1900|3|1": "4 vjet, 1 ditë", "2000|1|1|2000|1|1": "0 ditë", "2000|5|31|2001|5|31": "1 vjet", "2000|12|31|2001|1|1": "1 ditë"}
    kept = ["1946|2|30|1950|1|1", "²|1|1|1950|1|1", "0|1|1|1950|1|1", "a|1|1"]
    assert run(spark, L.age_words, [call(c) for c in cases]) == [(w, 1) for w in cases.values()]
    assert run(spark, L.age_words, [call(c) for c in kept]) == [(call(c), 0) for c in kept]


def test_links_and_notes(spark):
    assert run(spark, L.unnested_ills, ["[[{{ill|A|en|B}}|lab]] [[{{ill|A|en|B}}]] [[X|{{ill|A|en|B}}]] [[{{ill|A|en}}|A]] [[a|b]]"]) == [("{{ill|A|en|B|lt=lab}} {{ill|A|en|B}} {{ill|A|en|B}} {{ill|A|en}} [[a|b]]", 4)]
    assert run(spark, L.nested_notes, ['a<ref group="n" name=b> T | u.<ref>{{cite|x}}</ref> </ref> z<ref>q</ref>', "<ref>a<ref>b<ref>c</ref></ref></ref>", "<ref>a\n<ref>b</ref></ref>"]) == [
        ("a{{refn|group=n|name=b|1=T {{!}} u.<ref>{{cite|x}}</ref>}} z<ref>q</ref>", 1), ("<ref>a<ref>b<ref>c</ref></ref></ref>", 0), ("<ref>a\n<ref>b</ref></ref>", 0)]
    assert run(spark, R.page_params, ["{{sfn|A|1990|f=3}}{{sfn|A|1990|f. 161}}{{harvnb|B|2000|fq. 4-5}}{{sfn|A|f. 2}}"]) == [("{{sfn|A|1990|p=3}}{{sfn|A|1990|p=161}}{{harvnb|B|2000|pp=4-5}}{{sfn|A|f. 2}}", 3)]
    assert run(spark, R.plain_notes, ["<ref>{{Sfn |A|1}}, {{sfnp|B}}</ref>{{sfn|C}}"]) == [("<ref>{{harvnb |A|1}}, {{harvp|B}}</ref>{{sfn|C}}", 2)]
    assert run(spark, R.unwrapped_notes, ["<ref> {{sfn|A|1}} </ref><ref name=x>{{sfn|A|1}}</ref><ref>{{sfn|A|1}} t</ref>"]) == [("{{sfn|A|1}}<ref name=x>{{sfn|A|1}}</ref><ref>{{sfn|A|1}} t</ref>", 1)]
    assert run(spark, R.without_agencies, ["{{cite news|agency=AP|title=t}}{{cite news|publisher=P |agency=AP}}{{cite news|publisher=The AP|agency=AP}}"]) == [("{{cite news|publisher=AP|title=t}}{{cite news|publisher=AP; P }}{{cite news|publisher=The AP}}", 3)]


def test_reference_lists_and_redirects(spark):
    text = "== R ==\n<references>\n<ref>a</ref>\n</references>\n<ref>b</ref>\n</references>\n== S ==\n</references>"
    lone = "x\n</references>\n</references>"
    assert run(spark, L.merged_references, [text, lone, None]) == [("== R ==\n<references>\n<ref>a</ref>\n<ref>b</ref>\n</references>\n== S ==\n</references>", 1), (lone, 0), (None, 0)]
    assert run(spark, L.without_redirect_notes, ["a\n {{Redirect-x|b|{{c}}}} \nd {{redirect|e}}\n{{redirect|f}}"]) == [("a\nd {{redirect|e}}\n", 2)]


def test_hatnotes(spark):
    frame = lambda x: spark.createDataFrame([(1, x)], "id int, text string")
    made, source = "{{Kryesor|Një}}\n{{Kryesor|Dy|Tre}}\n{{Shih|X}}", "{{Main|One}}\n{{Main|Two|Three}}\n{{Further|Y}}"
    missing = spark.createDataFrame([(1, "Dy"), (2, "Një")], "id int, title string")
    got = L.linked_hatnotes(frame(made), frame(source), missing).first()
    assert (got.text, got.n) == ("{{Kryesor|Një}}\n{{Hatnote|Artikulli kryesor: {{ill|Dy|en|Two}} dhe [[Tre]]}}\n{{Shih|X}}", 1)


def test_notes_of_a_block(spark):
    text = "A{{Cref2|a}} B{{cref2|a}} C{{cref2|z}}\n{{Cnote2 Begin|liststyle=lower-alpha}}\n{{Cnote2|a|Note {{sfn|X|1}}<ref>r</ref>}}\n{{Cnote2|b|Un}}\n{{Cnote2 End}}\n\n\nEnd"
    rows = {r.id: (r.text, r.n, r.lost, r.idle) for r in L.expanded_notes(spark.createDataFrame([(1, text), (2, "no notes"), (3, "x{{cref2|a}}"), (4, None)], "id int, text string")).collect()}
    assert rows[1] == ('A<ref name="cnote-a" group="lower-alpha">Note {{harvnb|X|1}}</ref><ref>r</ref> B<ref name="cnote-a" group="lower-alpha" /> C{{cref2|z}}\n{{Reflist|group=lower-alpha}}\n\nEnd', 2, ["z"], ["b"])
    assert rows[2] == ("no notes", 0, [], []) and rows[3] == ("x{{cref2|a}}", 0, [], []) and rows[4][0] is None


def test_ordered_rewrites(spark):
    text = "{{Cite web|titulli=A|data=27 November 2025}}<ref>{{sfn|A|1}}</ref>"
    frame = lambda x: spark.createDataFrame([(1, x)], "id int, text string")
    once = L.ordered(frame(text)).first()
    assert once.text == "{{Cite web|title=A|date=2025-11-27}}{{sfn|A|1}}" and list(once.steps) == ["english_params", "unwrapped_notes", "right_dates"]
    again = L.ordered(frame(once.text)).first()
    assert (again.text, list(again.steps)) == (once.text, [])


@pytest.mark.parametrize("fn", [L.right_dates, L.right_as_of, L.age_words, L.unnested_ills, L.nested_notes, L.merged_references, L.without_redirect_notes])
def test_nothing(spark, fn):
    assert fn(spark.createDataFrame([], "id int, text string")).count() == 0
    assert [tuple(r)[:3] for r in fn(spark.createDataFrame([(1, "plain")], "id int, text string")).withColumn("text", F.col("text")).collect()] == [(1, "plain", 0)]
