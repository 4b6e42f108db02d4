import gzip
import hashlib
import random
import re

import pytest

from markloom.llm import spotsigs, warc_source

from .fixtures import frame, hostile


def page_rows():
    big = "<p>é</p>" * 300
    return [(1, "u", big), (2, "u\r\nX: y", big), (3, None, big), (4, "u", "<p>"), (5, "u", "<p>"), (6, "u", None), (7, "u", "WARC/1.1\r\n\r\n" * 200), (8, "u", ""), (9, "u", "x" * 1000), (10, "u", "x" * 1000), (11, "u", "x" * 999), (12, "u", "x" * 999), (None, "u", big)]


def test_archive_round_trip(spark, tmp_path):
    pages = spark.createDataFrame(page_rows(), "page_id long, url string, html string").repartition(3)
    path = str(tmp_path / "a")
    warc_source.write(pages, path)
    back = {r.page_id: r for r in warc_source.read(spark, path).collect()}
    assert len(back) == len(page_rows())
    first = {}
    for i, _, html in page_rows():
        data = (html or "").encode()
        if i is not None and len(data) >= 1000:
            first[data] = max(first.get(data, i), i)
    for i, _, html in page_rows():
        data, r = (html or "").encode(), back[i]
        to = first.get(data, i)
        assert (r.payload_bytes, r.payload_digest) == (len(data), hashlib.sha1(data).hexdigest())
        assert (r.record_type, r.refers_to) == (("response", None) if to == i else ("revisit", to))
        assert bytes(r.payload) == (data if to == i else b"")
    plain = b"".join(gzip.decompress(f.read_bytes()) for f in (tmp_path / "a").glob("*.warc.gz"))
    assert plain.count(b"WARC/1.1\r\nWARC-Page-ID") == len(page_rows()) - 1


def test_predicates_are_pushed_and_payloads_left_alone(spark, tmp_path):
    rows = [(i, f"u{i}", f"<p>{i}" * 2000) for i in range(20)]
    path = str(tmp_path / "b")
    warc_source.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    found = warc_source.read(spark, path).where("url = 'u7' and record_type in ('response', 'x')")
    assert [(r.page_id, len(r.payload)) for r in found.collect()] == [(7, len(rows[7][2]))]
    reader = warc_source.WarcDataSource({"path": path}).reader(spark.createDataFrame([], warc_source.SCHEMA).schema)
    left = list(reader.pushFilters([warc_source.EqualTo(("url",), "u7"), warc_source.EqualTo(("payload",), b"")]))
    assert len(left) == 1
    stats = {}
    with open(next((tmp_path / "b").glob("*.warc.gz")), "rb") as f:
        import pyarrow as pa

        got = list(warc_source.records(pa.PythonFile(f), lambda x: x["url"] == "u7", True, stats))
    assert stats == {"payloads": 1} and len(got) == 1
    assert warc_source.read(spark, path, payloads=False).columns == [c for c in warc_source.FIELDS if c != "payload"]


def test_empty_archive(spark, tmp_path):
    warc_source.write(spark.createDataFrame([], "page_id long, url string, html string"), str(tmp_path / "c"))
    assert warc_source.read(spark, str(tmp_path / "c")).count() == 0


def foreign(i, body, kind="response"):
    return f"WARC/1.0\r\nwarc-type: {kind}\r\nWARC-Target-URI: http://x/{i}\r\nWARC-Record-ID: <urn:{i}>\r\nContent-Type: application/http; msgtype={kind}\r\nContent-Length: {len(body)}\r\n\r\n".encode() + body + b"\r\n\r\n"


def test_foreign_archives(spark, tmp_path):
    bodies = [b"HTTP/1.1 200 OK\r\n\r\nWARC/1.0\r\n\r\n" + bytes([i]) * (i * 5000) for i in range(6)]
    parts = [foreign("info", b"software: x\r\n", "warcinfo"), *(foreign(i, b) for i, b in enumerate(bodies))]
    (tmp_path / "a.warc").write_bytes(b"".join(parts))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, parts)))
    (tmp_path / "c.warc.gz").write_bytes(gzip.compress(b"".join(parts)))
    rows = warc_source.read(spark, str(tmp_path)).collect()
    assert sorted((r.record_type, r.url, r.page_id) for r in rows) == sorted([("warcinfo", "http://x/info", None), *(("response", f"http://x/{i}", None) for i in range(6))] * 3)
    assert sorted(bytes(r.payload) for r in rows if r.record_type == "response") == sorted(bodies * 3)
    assert all(r.payload_bytes == len(r.payload) and r.record_id.startswith("urn:") for r in rows)
    assert [r.payload_bytes for r in warc_source.read(spark, str(tmp_path), payloads=False).where("url = 'http://x/3'").collect()] == [len(bodies[3])] * 3


def test_cut_archives_raise(tmp_path):
    import pyarrow as pa

    data = foreign(1, b"q" * 100)
    for cut in (40, len(data) - 30):
        with pytest.raises(EOFError):
            list(warc_source.records(pa.BufferReader(data[:cut]), lambda x: True, True))
    with pytest.raises(ValueError):
        list(warc_source.records(pa.BufferReader(b"<html>\n\n"), lambda x: True, True))


def test_failed_jobs_leave_no_files(spark, tmp_path):
    rows = spark.range(40, numPartitions=4).selectExpr("id AS page_id", "'response' AS record_type", "'u' AS url", "'r' AS record_id", "'d' AS payload_digest", "1L AS payload_bytes", "CAST(null AS long) AS refers_to", "CASE WHEN id = 35 THEN CAST(raise_error('no') AS binary) ELSE CAST('x' AS binary) END AS payload")
    with pytest.raises(Exception, match="no"):
        warc_source.registered(spark).createDataFrame(rows.rdd, rows.schema).write.format("warc").option("path", str(tmp_path / "d")).mode("append").save()
    assert list((tmp_path / "d").glob("*")) == [] if (tmp_path / "d").exists() else True


def brute_sets(text):
    w = [x for x in re.sub(r"[\x00-\x20!-/:-@\[-`{-~]+", " ", text.lower()).strip(" ").split(" ") if x]
    stop, out = set(spotsigs.ANCHORS), set()
    for i, x in enumerate(w):
        if x in stop:
            chain, gap = [], 0
            for y in w[i + 1 :]:
                if y in stop:
                    gap += 1
                    if gap > spotsigs.GAP:
                        break
                else:
                    chain.append(y)
                    gap = 0
                    if len(chain) == spotsigs.CHAIN:
                        break
            if chain:
                out.add("".join(chain))
    return out or {"".join(w[i : i + 3]) for i in range(len(w))}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a and b else float(not a and not b)


@pytest.mark.parametrize("step", [1, 700])
def test_edited_likeness_matches_brute_force(spark, step):
    rng = random.Random(4)
    mixed = [t and " ".join(x for w in t.split(" ") for x in (w, rng.choice(["the", "of the", "", "und", "la,"]))) for t in hostile(11, 30)]
    texts = [*mixed, "the " * 3000, "The. the, x", "x the", "😀 the 😀é b", "a\nb\nthe\nc"]
    docs = frame(spark, texts).selectExpr(f"doc_id * {step} as doc_id", "text", "lang as n_chars").repartition(3)
    got = {r.doc_id // step: r for r in spotsigs.edited_likeness(docs).collect()}
    order = sorted(range(len(texts)), reverse=True)
    for k, d in enumerate(order):
        t, nxt = texts[d] or "", texts[order[(k + 1) % len(order)]] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        r = got[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.near_edited == pytest.approx(jaccard(brute_sets(t), brute_sets(edited))), d
        assert r.near_next == pytest.approx(jaccard(brute_sets(t), brute_sets(nxt))), d
        assert (r.fingerprint == r.edited_fingerprint) == (brute_sets(t) == brute_sets(edited))
        sets = [{x[i : i + 8] for i in range(0, len(x), 8)} for x in (r.fingerprint, r.edited_fingerprint)]
        assert r.near_edited == pytest.approx(jaccard(*sets))
    same = {}
    for d, t in enumerate(texts):
        assert same.setdefault(t or "", got[d].fingerprint) == got[d].fingerprint


def test_one_row_nulls_and_nothing(spark):
    assert spotsigs.edited_likeness(frame(spark, [])).count() == 0
    (r,) = spotsigs.edited_likeness(frame(spark, [None])).collect()
    assert (r.n_chars, r.near_edited, r.near_next) == (0, 1.0, 1.0)
    rows = spark.createDataFrame([(None, "the cat"), (5, "the cat"), (5, None)], "doc_id long, text string")
    assert spotsigs.edited_likeness(rows).count() == 3


@pytest.mark.parametrize("ranges", [4, 256])
def test_hot_and_null_ids_follow_the_stated_order(spark, ranges):
    rng = random.Random(7)
    rows = [(rng.choice([None, 7, 7, 7, rng.randrange(10**12)]), " ".join(rng.choices("the of a b c d e".split(), k=rng.randrange(8)))) for _ in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    keyed = docs.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(keyed, key=lambda r: (-(r.doc_id if r.doc_id is not None else -(2**63)), -r.h, r.text))
    want = []
    for k, r in enumerate(order):
        nxt = order[(k + 1) % len(order)].text
        half = len(r.text) // 2
        want.append((r.doc_id, r.text and len(r.text), hashlib.sha256((r.text[: len(r.text) - half] + nxt[:half]).encode()).hexdigest()))
    ordered = spotsigs.in_order(docs, ranges)
    assert ordered.where("guest = 1").count() == ordered.select("bucket").distinct().count() > min(3, ranges)
    got = [(r.doc_id, r.n_chars or "", r.edited_sha256) for r in spotsigs.edited_likeness(docs, ranges).collect()]
    assert sorted(got, key=repr) == sorted(((i, n or "", x) for i, n, x in want), key=repr)


def test_near_pairs_match_brute_force(spark):
    texts = [*hostile(13, 40)]
    texts += [" ".join([*(t or "x").split(" ")[:-1], "new"]) for t in texts[8:40]]
    members, pairs = spotsigs.near_pairs(frame(spark, texts))
    of = {r.doc_id: r["class"] for r in members.collect()}
    sets = {of[i]: brute_sets(t or "") for i, t in enumerate(texts)}
    names = sorted(sets)
    want = {(a, b) for i, a in enumerate(names) for b in names[i + 1 :] if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8}
    assert {(r.a, r.b) for r in pairs.collect()} == want and want
