"""What a Python worker holds beside its batch is bounded by the slice it works on, as a worker keeps its largest one."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from markloom.llm import crf_langid, near_copies


def most_mb(run):
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def long_texts():
    rng = random.Random(2)
    words = [f"w{i}" for i in range(3000)]
    return pa.array([" ".join(rng.choices(words, k=10_000)) for _ in range(60)], pa.large_string())


def test_language_labels_of_large_batches():
    texts, model = long_texts(), crf_langid.Model(["a", "b", "c", "d"])
    assert most_mb(lambda: crf_langid.predict(model, texts)) < 70


def test_shingles_of_large_batches():
    texts = long_texts()
    assert most_mb(lambda: sum(len(x) for x in near_copies.shingle_sets(texts))) < 25


def test_fingerprints_of_large_cells():
    n = 3000
    column = pa.array(np.random.default_rng(1).integers(-(2**62), 2**62, n))
    zero = pa.array(np.zeros(n, np.int64))
    table = pa.table({"key": zero, "i": zero, "j": zero, "side": zero, "node": column, "root": column, "n": pa.array(np.full(n, 100)), "a": column, "b": column})
    assert most_mb(lambda: near_copies.with_partners(table)) < 10
