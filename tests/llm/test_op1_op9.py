import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from markloom.llm import graph, residual_packing, simhash_pivot
from markloom.llm._text import blobs

from .fixtures import frame, hostile


def brute_print(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    comp = list(range(len(fps)))

    def root(i):
        while comp[i] != i:
            i = comp[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                a, b = sorted((root(i), root(j)))
                comp[b] = a
    return [root(i) for i in range(len(fps))]


def test_near_duplicates_match_brute_force(spark):
    texts = hostile(7, 40)
    long = texts[-1].split()
    texts += [" ".join([*long[:i], "zz", *long[i + 1 :]]) for i in (5, 900, 4000)]
    texts += ["A  B", "a b", "Z", "z\t", "\x1f", "é" * 3]
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash_pivot.near_duplicates(frame(spark, texts)).collect()}
    fps = [brute_print(t) for t in texts]
    comp = brute_components(fps)
    assert got == {i: (f"{f:016x}", c) for i, (f, c) in enumerate(zip(fps, comp, strict=True))}
    assert max(Counter(comp).values()) >= 3


def test_chains_and_hot_groups_lose_no_link(spark):
    rng = random.Random(3)
    base = rng.getrandbits(64)
    fps = {base}
    for _ in range(300):  # one dense group
        fps.add(base ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(0, 4))))
    x = rng.getrandbits(64)
    for _ in range(40):  # a chain
        x ^= sum(1 << b for b in rng.sample(range(64), 3))
        fps.add(x)
    fps |= {rng.getrandbits(64) for _ in range(400)}
    fps = sorted(fps)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    for chunk in (16, 8192):
        table = spark.createDataFrame([(f,) for f in signed], "fp long").repartition(3)
        found = {r.node: r.root for r in graph.components(simhash_pivot.links(table, chunk)).collect()}
        mine, want = defaultdict(set), defaultdict(set)
        for f, s, c in zip(fps, signed, brute_components(fps), strict=True):
            mine[found.get(s, s)].add(f)
            want[c].add(f)
        assert sorted(map(sorted, mine.values())) == sorted(map(sorted, want.values()))


def test_components_of_odd_graphs(spark):
    edges = [(i, i + 1) for i in range(50)] + [(100, i) for i in range(101, 160)] + [(7, 7), (200, 201), (201, 200), (None, 3)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 51)} | {i: 100 for i in range(101, 160)} | {201: 200}
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_near_duplicates_of_nothing(spark):
    assert simhash_pivot.near_duplicates(frame(spark, [])).count() == 0
    assert [(r.fingerprint, r.component_id) for r in simhash_pivot.near_duplicates(frame(spark, [None, ""])).collect()] == [("0" * 16, 0)] * 2


def test_best_fit_is_tight_and_gapless():
    rng = np.random.default_rng(1)
    for n in (0, 1, 500):
        sizes = rng.integers(1, 100, n)
        b, place, fills = residual_packing.best_fit(sizes, 100)
        assert (fills <= 100).all() and fills.sum() == sizes.sum()
        for k in range(len(fills)):
            own = sorted(zip(place[b == k], sizes[b == k], strict=True))
            assert [p for p, _ in own] == [0, *np.cumsum([s for _, s in own])[:-1]]
        assert not (np.sort(fills)[:2].sum() <= 100 and len(fills) > 1)


@pytest.mark.parametrize("how", [{}, {"node_items": 7, "fan_in": 2, "carry": 3}])
def test_sequences_hold_every_piece_once(spark, how):
    from tokenizers import Tokenizer

    texts = hostile(9, 50) + ["ΑΣ ς ΟΔΟΣ", "İI x é é", "it's I'LL <|endoftext|> a<|startoftext|>b", "x " * 5000, "٣4 ½   a\x1cb"]
    rows = residual_packing.sequences(frame(spark, texts), **how).collect()
    whole = Tokenizer.from_file(residual_packing.tokenizer_path())
    by_seq, seen = defaultdict(list), defaultdict(list)
    for r in rows:
        by_seq[r.sequence_id].append((r.offset, r.length))
        seen[r.doc_id].append((r.piece, r.start, r.length, r.ids_crc32))
    for d, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want = [(k, s, len(ids[s : s + 2048]), zlib.crc32(ids[s : s + 2048].tobytes())) for k, s in enumerate(range(0, len(ids), 2048))]
        assert sorted(seen[d]) == want
    for own in by_seq.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 2048
    last = [r.length for r in rows if r.length < 2048]
    full = sum(r.length == 2048 for r in rows)
    if not how:
        assert len(by_seq) == full + len(residual_packing.best_fit(np.array(last), 2048)[2])
    assert residual_packing.sequences(frame(spark, [])).count() == 0


@pytest.mark.parametrize("marks", [True, False])
def test_ids_of_words_are_those_of_whole_texts(marks):
    rng = random.Random(3)
    parts = ["a", "B", "É", "e", "İ", "ſ", "\u212a", "ß", "Σ", "1", "\u0663", ".", ",", "!", "'s", "'S", "'T.", "'", '"', "—", " ", " ", "\n", "\u00a0", "\u2028", "\0", "\x1c", "😀", "漢", "ﬁ"]
    parts += ["J\u030c", "\u0301", "h\u0331", "I\u0307", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>"] if marks else []
    texts = ["".join(rng.choices(parts, k=rng.randrange(0, 30))) for _ in range(4000)] + [""]
    encoder, got = residual_packing.Encoder(residual_packing.tokenizer_path(), known=50), []
    want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
    for _, _, blob, offsets in blobs(pa.array(texts, pa.large_string()), 1 << 14):
        flat, first = encoder.ids(blob, offsets)
        got += [flat[a:b].tolist() for a, b in zip(first[:-1], first[1:], strict=True)]
    assert got == want


def test_small_batches_only_lowers_the_bound(spark):
    from markloom.llm._store import BATCH_BYTES, MOST, small_batches

    try:
        small_batches(spark)
        assert spark.conf.get(BATCH_BYTES).rstrip("b") == str(MOST)
        spark.conf.set(BATCH_BYTES, "1000")
        small_batches(spark)
        assert spark.conf.get(BATCH_BYTES).rstrip("b") == "1000"
    finally:
        spark.conf.unset(BATCH_BYTES)


def test_equal_rows_are_dealt_over_all_nodes(spark):
    from pyspark.sql import functions as F

    items = spark.range(3000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(100).cast("long").alias("length"))
    out = residual_packing.pack(items, capacity=1000, node_items=200).collect()
    assert len(out) == 3000 and len({(r.sequence_id, r.offset) for r in out}) == 3000
    nodes = Counter(r.sequence_id >> 30 & 0x3FFFFFF for r in out)
    assert len(nodes) > 8 and max(nodes.values()) < 600
    assert len({r.sequence_id for r in out}) <= 320
