"""Cases of review findings, each of which failed before its change."""

import re

from pyspark.sql import functions as F

from markloom.operators import containment as N, cutting as C, elements as E, layout as L, pairing as P, relational as R, rewriting as W

from .test_cutting import brute_pack


def test_null_borders_come_last(spark):
    """Null borders once stood before the spans beside them, which cut an island in two."""
    spans = spark.createDataFrame([(1, 10, 14), (1, 12, None), (1, 12, 16), (1, 20, None), (1, 20, 22), (1, None, 30), (2, None, None)], "id int, s int, e int")
    assert sorted(map(tuple, R.merge_spans(spans).collect())) == [(1, 10, 16), (1, 20, 30), (2, None, None)]
    gaps = R.complement_spans(spans, spark.createDataFrame([(1, 40), (2, 5)], "id int, n int"))
    assert sorted(map(tuple, gaps.collect())) == [(1, 0, 10), (1, 16, 20), (1, 30, 40), (2, 0, 5)]


def test_equal_spans_make_one_island(spark):
    spans = spark.range(4000).select(F.lit(1).alias("id"), (F.col("id") % 500 * 3).alias("s"), (F.col("id") % 500 * 3 + 2).alias("e"))
    assert sorted(map(tuple, R.merge_spans(spans).collect())) == [(1, 3 * i, 3 * i + 2) for i in range(500)]


def test_an_empty_name_goes_to_the_first_chunk(spark):
    """contains(text, '') is true; an empty name once went to all chunks as a null one does."""
    findings = spark.createDataFrame([(1, 0, ""), (1, 1, None), (1, 2, "b"), (2, 3, "")], "article int, finding int, name string")
    chunks = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, "b"), (2, 0, None), (2, 1, None)], "article int, ord int, text string")
    got = sorted(map(tuple, P.route_findings(findings, chunks).collect()))
    assert got == [(1, 0, 1), (1, 1, 0), (1, 1, 1), (1, 1, 2), (1, 2, 2), (2, 3, 0), (2, 3, 1)]


def test_texts_are_dealt_by_their_number(spark):
    """One task once sorted the marks of a whole table, however many texts it had."""
    texts = spark.range(3 * E.TEXTS).selectExpr("id", "'a {{b|c=[[d]]}}' AS text")
    found = E.elements(texts).select("id", F.spark_partition_id().alias("task")).groupBy("task").agg(F.countDistinct("id").alias("n")).collect()
    assert len(found) >= 3 and max(r.n for r in found) < 1.2 * E.TEXTS


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_boxes_of_two_texts_are_found_in_stages_of_their_own(spark):
    """One task once held the sorts of four searches for boxes, each with a page of its own."""
    source, made = (spark.range(8).selectExpr("id", f"{x} AS text") for x in ("'{{Infobox a|b}}{{Kuti c}}'", "'{{Kuti c}} d'"))
    out = W.with_lost_boxes(source, made)
    assert _plan(out).count("Sort [") <= 30
    assert {tuple(r) for r in out.select("text", "n").collect()} == {("{{Kuti c}}\n{{Kuti c}} d", 1)}


def test_redirect_notes_look_for_bars_once(spark):
    """Without broadcast joins one task once held the sorts of three searches."""
    key = "spark.sql.autoBroadcastJoinThreshold"
    old = spark.conf.get(key)
    spark.conf.set(key, "-1")
    try:
        texts = spark.createDataFrame([(1, "a\n{{redirect|b}}\nc {{redirect|b}}"), (2, "{{redirect}}\n{{redirect|{{y|z}}}}")], "id int, text string")
        out = L.without_redirect_notes(texts)
        assert _plan(out).count("Sort [") <= 45
        assert sorted(map(tuple, out.collect())) == [(1, "a\nc {{redirect|b}}", 1), (2, "{{redirect}}\n", 1)]
    finally:
        spark.conf.set(key, old)


def _dealt_by_number(rewrite, spark, text: str):
    """The result over texts that ask for six tasks; all its exchanges are as wide."""
    out = rewrite(spark.range(5 * E.TEXTS).selectExpr("id", f"{text} AS text"))
    widths = {int(n) for n in re.findall(r"hashpartitioning\(.*?, (\d+)\)", _plan(out))}
    assert widths == {6}, widths
    return out


def test_kept_tables_are_dealt_by_the_number_of_texts(spark, monkeypatch):
    """What was read back from the shared folder was once met by place in as many tasks as its bytes asked for."""
    monkeypatch.setattr(E, "TEXTS", 64)
    out = _dealt_by_number(L.nested_notes, spark, "concat('a<ref>', id, '<ref>b</ref></ref>')")
    assert out.where("text = concat('a{{refn|1=', id, '<ref>b</ref>}}') AND n = 1").count() == 5 * E.TEXTS


def test_pieces_are_followed_from_batch_to_batch(spark):
    """Units are walked in sorted batches, which end anywhere in a text; no rounds are written."""
    key, many = "spark.sql.execution.arrow.maxRecordsPerBatch", {t: [(t * i) % 7 for i in range(1 + 5 * t)] for t in range(12)}
    rows = [(t, i, n) for t, own in many.items() for i, n in enumerate(own)]
    units, old = spark.createDataFrame(rows, "id int, i int, n int"), spark.conf.get(key)
    whole = sorted(map(tuple, C.packed(units, 5, 9).collect()))
    spark.conf.set(key, "3")
    try:
        assert sorted(map(tuple, C.packed(units, 5, 9).collect())) == whole
    finally:
        spark.conf.set(key, old)
    assert {t: [p for x, _, _, p in whole if x == t] for t in many} == {t: brute_pack(own, 5, 9, False) for t, own in many.items()}


def test_many_texts_without_calls_keep_their_tasks(spark, tmp_path):
    """A union in the table of elements once had the partitions of its three parts, where a join above it was planned for those of one: an error."""
    spark.range(9 * E.TEXTS).selectExpr("struct(id, 'a' AS label) AS id", "concat('<ref>', id, '</ref>') AS text").write.parquet(f"{tmp_path}/t")
    rows = W.plain_notes(spark.read.parquet(f"{tmp_path}/t")).groupBy(F.regexp_replace("text", "[0-9]+", "")).agg(F.count("*"), F.sum("n")).collect()
    assert list(map(tuple, rows)) == [("<ref></ref>", 9 * E.TEXTS, 0)]


def test_calls_and_bars_come_from_one_table(spark):
    """Calls were once joined with their bars, and one side, as many rows as the table has calls, was sent through the driver."""
    texts = spark.range(10).selectExpr("id", "'a {{b|c={{d|e}}}} {{f}}' AS text")
    calls = E.template_calls(texts)
    assert _plan(calls).count("Join") == 1
    assert sorted(map(tuple, calls.where("id = 0").select("s", "e", "name", "depth", "bar").collect())) == [(2, 17, "b", 0, 5), (8, 15, "d", 1, 11), (18, 23, "f", 0, None)]


def test_words_send_only_the_keys_their_scope_asks_for(spark):
    """All grams of all words were once sent to be joined, many times the texts themselves."""
    texts = spark.range(400).selectExpr("id AS scope", "0 AS part", "array_join(transform(sequence(1, 100), i -> substr(sha2(concat(id, '.', i), 256), 1, 12)), ' ') AS text")
    names = texts.selectExpr("scope", "substr(text, 10, 7) AS name")
    size = texts.selectExpr("sum(length(text))").first()[0]
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        before = written()
        assert N.held(names, texts).count() == 400
        assert written() - before < 8 * size
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
