import hashlib
import random
import re
from collections import Counter

import pytest

from markloom.llm import anchor_dedup, columnwise_suffix

from .fixtures import frame, hostile


def brute_words(texts, ids):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for t in texts]
    least = {}
    for i, w in zip(ids, words, strict=True):
        for p in range(len(w) - 12):
            key = tuple(w[p : p + 13])
            least[key] = min(least.get(key, i), i)
    out = []
    for i, w in zip(ids, words, strict=True):
        gone = {q for p in range(len(w) - 12) if least[tuple(w[p : p + 13])] < i for q in range(p, p + 13)}
        kept = " ".join(x for q, x in enumerate(w) if q not in gone)
        out.append((i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


@pytest.mark.parametrize("slot_bytes", [1000, 1 << 24])
def test_word_dedup_matches_brute_force(spark, slot_bytes):
    texts = hostile(21) + ["x " * 300, "x " * 20, " ".join(f"u{i % 5}" for i in range(100))]
    docs = frame(spark, texts).repartition(5)
    got = anchor_dedup.deduplicate(docs, slot_bytes).collect()
    want = brute_words(texts, range(len(texts)))
    assert sorted((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == want
    assert sum(r[2] > 0 for r in want) > 20
    assert all(hashlib.sha256(r.kept.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_word_dedup_of_nothing_and_null_ids(spark):
    assert anchor_dedup.deduplicate(frame(spark, [])).count() == 0
    w = " ".join(f"a{i}" for i in range(20))
    rows = spark.createDataFrame([(None, w), (4, w), (4, w), (7, w)], "doc_id long, text string")
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_removed) for r in anchor_dedup.deduplicate(rows).collect())
    assert got == [(False, 4, 0), (False, 4, 0), (False, 7, 20), (True, 0, 20)]


def brute_bytes(texts):
    data = [(t or "").encode() for t in texts]
    n = Counter(d[p : p + 200] for d in data for p in range(len(d) - 199))
    out = []
    for i, d in enumerate(data):
        gone = bytearray(len(d))
        for p in range(len(d) - 199):
            if n[d[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        kept = bytes(b for b, g in zip(d, gone, strict=True) if not g)
        spans = len(re.findall(b"\1+", bytes(gone)))
        out.append((i, len(d), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return out


def byte_texts():
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("abcdé 😀", k=n))
    shared = [make(n) for n in (150, 190, 230, 400, 900)]
    texts = [None, "", "a" * 199, "a" * 200, "a" * 201, "b" * 450, "ab" * 300, make(150) * 3, make(250), make(250)]
    for _ in range(70):
        texts.append("".join(rng.choice([make(rng.randrange(1, 300)), *shared, rng.choice(shared)[3:260]]) for _ in range(rng.randrange(1, 5))))
    texts += texts[12:18]
    s = shared[4]
    texts += [s[:i] + "X" + s[i:] for i in (0, 100, 101, 200, 450, 899)]
    return texts


@pytest.mark.parametrize("slot_bytes, hot, block", [(3000, 50_000, 4096), (1 << 24, 50_000, 7), (1 << 24, 3, 4096), (3000, 0, 2)])
def test_byte_dedup_matches_brute_force(spark, slot_bytes, hot, block):
    texts = byte_texts()
    got = columnwise_suffix.deduplicate(frame(spark, texts).repartition(5), slot_bytes, hot, block).collect()
    want = brute_bytes(texts)
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want
    assert sum(0 < r[2] < r[1] for r in want) > 15


def test_byte_dedup_of_nothing(spark):
    assert columnwise_suffix.deduplicate(frame(spark, [])).count() == 0
    rows = spark.createDataFrame([(None, "q" * 100 + "é" * 100), (1, "q" * 100 + "é" * 100)], "doc_id long, text string")
    assert sorted((r.n_bytes, r.n_removed, r.n_spans) for r in columnwise_suffix.deduplicate(rows).collect()) == [(300, 300, 1)] * 2


def test_transform_and_common_prefixes_match_sorting():
    rng = random.Random(3)
    for _ in range(30):
        segments = ["".join(rng.choices("ab", k=rng.randrange(1, 12))).encode() for _ in range(rng.randrange(1, 9))]
        c = columnwise_suffix.Collection(segments)
        suffixes = sorted(((s[i:], k) for k, s in enumerate(segments) for i in range(len(s) + 1)), key=lambda x: x[0])
        got = [(segments[k][len(segments[k]) - n :], int(k)) for k, n in zip(c.segment, c.length, strict=True)]
        assert [x for x, _ in got] == [x for x, _ in suffixes] and sorted(got) == sorted(suffixes)
        before = [segments[k][len(segments[k]) - n - 1] if n < len(segments[k]) else -1 for k, n in zip(c.segment, c.length, strict=True)]
        assert c.transform.tolist() == before
        same = lambda a, b: next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert c.common.tolist() == [0, *(same(a[0], b[0]) for a, b in zip(got, got[1:], strict=False))]


def test_hot_anchors_are_told_from_others():
    from markloom.llm._exchange import message, unbits

    import numpy as np

    values = np.array([3, 9, 12], np.uint64)
    times = lambda *n: np.array(n, "<u4").tobytes()
    out = columnwise_suffix.twice([message(values, 5, times(1, 2, 200)), message(values[2:], 5, times(100))], 250)
    assert unbits(out[0], 6).tolist() == [False, True, True, False, False, True]
    out = columnwise_suffix.twice([message(values[:1], 5, times(30_000))] * 2, 50_000)
    assert unbits(out[0], 2).tolist() == [True, True]


def test_an_anchor_that_repeats_in_one_batch_is_counted_whole():
    import numpy as np
    import pyarrow as pa

    batch = columnwise_suffix.Batch(np.array([1]), pa.array([("ab" * 3000).encode()], pa.large_binary()), 1)
    assert max(int(n.max()) for _, _, n, _, _, _ in batch.anchors()) > 255
