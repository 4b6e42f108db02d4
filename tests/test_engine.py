"""The engine surface, its loops, settings and the queue."""

import pytest

from markloom.operators import articles as A, engine as E, relational as R, wikitext as T
from markloom.sources import config as C
from markloom.streaming import queue


class Failing:
    def complete(self, system, user):
        raise RuntimeError("HTTP 402: no credit")


def test_fallback_changes_once_and_only_for_spent_credit():
    e = E.FallbackEngine(Failing(), E.LocalEngine(str.upper))
    assert e.complete("", "a").text == "A" and len(e.engines) == 1

    class Broken:
        def complete(self, system, user):
            raise RuntimeError("timeout")

    with pytest.raises(RuntimeError, match="timeout"):
        E.FallbackEngine(Broken(), E.LocalEngine(str.upper)).complete("", "a")


def test_prompts_hold_their_text():
    assert E.between(E.translation_prompt("en", "sq", "A", "S", "text", "facts")) == "text"
    assert E.between(E.repair_prompt("A", "made", ["e"], "source")) == "made"
    assert E.between(E.review_prompt("A", "s", "m")) == "m"
    assert E.judge_prompt("s", list("abcdef")).count(": ") == 4


def test_guards():
    assert E.guarded("{{efn|a}}", "x") == "{{efn|a}}" and E.guarded("a", "b") == "b" and E.guarded("a", " ") == "a"
    assert not E.usable("{{Infobox a}}t", "t") and E.usable("t", "u") and not E.usable("t", "{{")
    assert E.mended("{{Infobox a}}t", "u") == ("\n{{Infobox a}}u", True)


def test_loops_end_and_keep_what_cannot_be_mended(spark):
    rows = [(1, 0, "s", "a [["), (1, 1, "s", "fine"), (2, 0, "s", None), (3, 0, "s", "b ]]")]
    state = spark.createDataFrame(rows, "article long, ord long, text string, made string")
    same, n = E.repair_rounds(state, "same", lambda: E.LocalEngine(lambda x: x), rounds=2)
    assert n == 2 and sorted((r.article, r.ord, r.made or "") for r in same.collect()) == sorted((a, o, m or "") for a, o, _, m in rows)
    fixed, n = E.repair_rounds(state, "fix", lambda: E.LocalEngine(lambda x: x.replace("[[", "").replace("]]", "")))
    assert n == 1 and {r.made for r in fixed.collect()} == {"a ", "fine", None, "b "}
    bad = lambda: E.LocalEngine(lambda x: '[{"message": "m", "snippet": "fine"}]')
    kept, _ = E.review_rounds(state.where("article = 1 and ord = 1"), ("bad", bad), ("break", lambda: E.LocalEngine(lambda x: "}}")))
    assert [r.made for r in kept.collect()] == ["fine"]
    assert E.repair_rounds(state.limit(0), "same", lambda: E.LocalEngine(str))[1] == 0


def test_equal_requests_are_asked_once(spark, tmp_path):
    log = str(tmp_path / "calls")

    def factory():
        def say(x):
            with open(log, "a") as f:
                f.write("call\n")
            return x

        return E.LocalEngine(say)

    out = E.completed(spark.createDataFrame([("a",)] * 20 + [("b",)], "prompt string"), "once", factory)
    assert len(out.collect()) == 2 and open(log).read().count("call") == 2


def test_null_chunks_and_repeated_cache_rows(spark):
    spans = R.assemble(spark.createDataFrame([(1, 0, "a"), (1, 1, None), (1, 2, "b")], "article long, ord long, text string")).orderBy("ord").collect()
    assert [(r.first_line, r.last_line) for r in spans] == [(1, 1), (1, 0), (2, 2)]
    kv = spark.createDataFrame([("k", "1"), ("k", "2")], "k string, v string")
    assert [tuple(r) for r in R.resolve_cached(kv.select("k"), kv, kv.limit(0)).collect()] == [("k", "2", True)]


def test_settings():
    c = C.config("provider: a\nmodel: m  # note\ncomplex_model: big\n\n", {"MARKLOOM_CONTACT": "x@y"})
    assert (c.provider, c.model, c.complex_model, c.user_agent) == ("a", "m", "big", "markloom (x@y)")
    c = C.config('{"provider": "a", "model": "m", "complex_model": "big", "contact": "z", "chunk_min": "7"}', provider="b")
    assert (c.model, c.complex_provider, c.complex_model, c.chunk_min) == ("echo", "b", None, 7)
    for wrong in ("", "contact: a\nodd: 1"):
        with pytest.raises(ValueError):
            C.config(wrong)


def test_instruction_bundle(spark, tmp_path):
    for folder, name, text in (("a", "1.md", "---\nx: y\n---\none"), ("a", "2.md", "two"), ("b", "r.md", "three")):
        (tmp_path / folder).mkdir(exist_ok=True)
        (tmp_path / folder / name).write_text(text)
    (r,) = C.instruction_bundle(spark, [f"{tmp_path}/a", f"{tmp_path}/b"]).collect()
    assert r.text == f"one\ntwo\n# {tmp_path}/b/r.md\nthree" and len(r.hash) == 16


def test_queue_is_drained_and_failures_are_answered(spark, tmp_path):
    for i, rows in enumerate([[(1,), (1,), (2,)], [(3,)], [(4,)]]):
        spark.createDataFrame(rows, "article long").coalesce(1).write.mode("append").json(f"{tmp_path}/q")
    stream = spark.readStream.schema("article long").option("maxFilesPerTrigger", 1).json(f"{tmp_path}/q")

    def handle(batch):
        if batch.where("article = 3").count():
            raise queue.Unanswered("engine")
        return batch.selectExpr("article", "true AS ok")

    for _ in range(2):  # a second run finds nothing new
        queue.drained(stream, handle, f"{tmp_path}/a", f"{tmp_path}/c")
    got = spark.read.parquet(f"{tmp_path}/a").select("article", "ok").collect()
    assert sorted(tuple(r) for r in got) == [(1, True), (2, True), (3, False), (4, True)]


def test_local_wiki():
    w = A.LocalWiki({"a": "[{{{1|d}}}{{b}}]", "b": "x", "loop": "{{loop}}"})
    assert w.expand("{{A|1}} {{a}} {{c}}") == "[1x] [dx] {{c}}" and w.expand("{{loop}}") == "{{loop}}"
    assert w.render("{{a}} <b>{{c}}") == ("[dx] &lt;b>{{c}}", [("a", True), ("c", False)])


def test_tables_keep_columns_and_nulls(spark):
    df = spark.createDataFrame([(1, None, "own")], "id long, x string, y string")
    assert [tuple(r) for r in T.mapped(df, lambda x: (x + "!",), "y string", "x").collect()] == [(1, None, "!")]
    assert T.mapped(df.limit(0), lambda x: (x,), "y string", "x").count() == 0


def test_review_replies(spark):
    replies = ['x ```json\n[{"message": " m ", "kind": "odd", "severity": "WARNING", "snippet": ""}, {"kind": "grammar"}]\n``` y', 'see [{"message": "a", "kind": "grammar", "snippet": "b"}]', "none", "[broken", None]
    got = [tuple(r) for r in E.review_findings(spark.createDataFrame(list(enumerate(replies)), "article int, reply string")).collect()]
    assert got == [(0, 0, "semantic_fidelity", "m", "warning", None), (1, 0, "grammar", "a", "error", "b")]
