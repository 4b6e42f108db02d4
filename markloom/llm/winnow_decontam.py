"""Benchmark decontamination by winnowing.

The fingerprint of 13 consecutive words is the minimum hash of their nine
5-grams, kept with the place of that 5-gram (the rightmost of equal ones).
Equal 13-word windows have equal fingerprints at equal places, so training and
benchmark fingerprints are joined, every joint 5-gram is extended to the left
and right for as long as the words agree, and a run of 13 words or more is a
hit: each shared span of 13 words is found.  Items of 1 to 12 words are one
window of their own length, whose hash is the fingerprint, found and compared
in the same way.

The fingerprints of a benchmark of at most ``most_bytes`` bytes of text are
broadcast, and one pass over the documents does it all.  A larger benchmark is
joined in shuffles: documents send only fingerprints that a bitmap of fixed
size may hold, pairs of text and item meet their words for extension, and hit
spans are merged in SQL; no task or worker holds the benchmark.

Edge cases: a null or wordless text has no words and no hits; an item without
words never occurs; items are told apart by item_id, so repeated rows of an
item count once; an item of null id marks words but is not counted or listed;
repeated documents are judged each; result names win over columns of the same
name, unless they are not kept; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ._bits import bitmap, picked
from ._store import written
from ._text import ALNUM_SEPARATORS, Words, blobs, mix

WINDOW, GRAM = 13, 5
HITS = "n_words long, n_hit long, n_items long, items_sha256 string, item_ids array<string>, contaminated boolean"
NAMES = tuple(x.split()[0] for x in HITS.split(", "))
MOST_BYTES = 16 << 20


def prints(w: Words, lengths: tuple[int, ...]):
    """(length, fingerprint, word where the fingerprint's gram begins), each once; short lengths only as asked."""
    for k in lengths:
        h, one = w.rolling(k)
        at = np.flatnonzero(one)
        yield k, mix(h[at] + np.uint64(k)), at
    n = len(w.hash)
    if n < WINDOW:
        return
    h, _ = w.rolling(GRAM)
    m = n - WINDOW + 1
    low, where = h[:m].copy(), np.arange(m)
    for j in range(1, WINDOW - GRAM + 1):
        smaller = h[j : j + m] <= low
        low = np.where(smaller, h[j : j + m], low)
        where = np.where(smaller, np.arange(j, j + m), where)
    doc = w.doc()
    at = np.unique(where[doc[:m] == doc[WINDOW - 1 : WINDOW - 1 + m]])
    yield WINDOW, h[at], at


def words_of(texts: list[bytes]) -> Words:
    ends = np.cumsum([0, *map(len, texts)])
    return Words(np.frombuffer(b"".join(texts), np.uint8), ends, ALNUM_SEPARATORS, lower=True)


def extended(w: Words, doc: np.ndarray, p: np.ndarray, v: Words, item: np.ndarray, q: np.ndarray, k: int):
    """(pair, start, end): runs of at least k words of w that agree with v around the grams p and q.

    A window holds its own gram, so eight more words on either side of each gram cover every shared window.
    Each run is then compared byte for byte, once an item.
    """
    a, b = p.copy(), p + (GRAM if k == WINDOW else k)
    for step in (-1, 1) if k == WINDOW else ():
        live = np.arange(len(p))
        for _ in range(WINDOW - GRAM):
            x = a[live] - 1 if step < 0 else b[live]
            y = x - p[live] + q[live]
            ok = (x >= w.first[doc[live]]) & (x < w.first[doc[live] + 1]) & (y >= v.first[item[live]]) & (y < v.first[item[live] + 1])
            live, x, y = live[ok], x[ok], y[ok]
            live = live[w.hash[x] == v.hash[y]]
            if step < 0:
                a[live] -= 1
            else:
                b[live] += 1
    long = np.flatnonzero(b - a >= k)
    _, at = np.unique(np.stack([a[long], b[long], item[long]]), axis=1, return_index=True)
    own = [i for i in long[at].tolist() if same_words(w, int(a[i]), v, int(q[i] - p[i] + a[i]), int(b[i] - a[i]))]
    return np.array(own, np.int64), a, b


def same_words(w: Words, p: int, v: Words, q: int, n: int) -> bool:
    cut = lambda z, i: [z.blob[x:y].tobytes() for x, y in zip(z.start[i : i + n].tolist(), z.end[i : i + n].tolist(), strict=True)]
    return cut(w, p) == cut(v, q)


class Index:
    """The joined side: fingerprints of items with their places."""

    def __init__(self, items: list[tuple[str | None, str | None]]):
        self.ids = [i for i, _ in items]
        self.words = words_of([(t or "").encode() for _, t in items])
        self.lengths = tuple(sorted({n for n in self.words.count.tolist() if 0 < n < WINDOW}))
        doc, self.table = self.words.doc(), {}
        for k, h, at in prints(self.words, self.lengths):
            if k < WINDOW:
                whole = self.words.count[doc[at]] == k
                h, at = h[whole], at[whole]
            order = np.argsort(h, kind="stable")
            self.table[k] = h[order], at[order], doc[at[order]]

    def hits(self, w: Words):
        """(document, item, start word, end word) of shared spans."""
        doc = w.doc()
        for k, h, at in prints(w, self.lengths):
            keys, places, items = self.table.get(k, (np.zeros(0, np.uint64),) * 3)
            low, high = np.searchsorted(keys, h), np.searchsorted(keys, h, side="right")
            n = high - low
            met = np.flatnonzero(n)
            cuts = np.flatnonzero(np.diff(np.cumsum(n[met]) >> 16)) + 1
            for part in np.split(met, cuts) if len(met) else ():
                p = np.repeat(at[part], n[part])
                j = np.repeat(low[part] - np.concatenate([[0], np.cumsum(n[part])[:-1]]), n[part]) + np.arange(n[part].sum())
                own, a, b = extended(w, doc[p], p, self.words, items[j], places[j], k)
                yield doc[p[own]], items[j[own]], a[own], b[own]


def covered(w: Words, spans: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Words of each document inside any span."""
    cover = np.zeros(len(w.start) + 1, np.int64)
    for a, b in spans:
        np.add.at(cover, a, 1)
        np.add.at(cover, b, -1)
    total = np.concatenate([[0], np.cumsum(np.cumsum(cover)[:-1] > 0)])
    return total[w.first[1:]] - total[w.first[:-1]]


def columns_of(words, hit, named: list[list[str]], ratio: int) -> dict:
    return {
        "n_words": pa.array(words),
        "n_hit": pa.array(hit),
        "n_items": pa.array([len(x) for x in named], pa.int64()),
        "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
        "item_ids": pa.array(named, pa.list_(pa.string())),
        "contaminated": pa.array((hit > 0) & (ratio * hit >= words)),
    }


def scan(batches, index: Index, keep: list[str], ratio: int):
    """Adds HITS to the kept columns of Arrow batches."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        n = batch.num_rows
        words, hit = np.zeros(n, np.int64), np.zeros(n, np.int64)
        items: list[set] = [set() for _ in range(n)]
        for i, j, blob, offsets in blobs(texts):
            w = Words(blob, offsets, ALNUM_SEPARATORS, lower=True)
            words[i:j] = w.count
            spans = []
            for doc, item, a, b in index.hits(w):
                spans.append((a, b))
                for d, o in set(zip(doc.tolist(), item.tolist(), strict=True)):
                    items[i + d].add(index.ids[o])
            hit[i:j] = covered(w, spans)
        named = [sorted(x - {None}) for x in items]
        out = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
        yield pa.RecordBatch.from_pydict(out | columns_of(words, hit, named, ratio))


def joined(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(key, n_hit, item_ids) of the texts (key: their SHA-256) that share a span with an item, by shuffles alone."""
    spark = docs.sparkSession

    def item_prints(batches):
        for batch in batches:
            for i, j, blob, offsets in blobs(batch.column(1)):
                w = Words(blob, offsets, ALNUM_SEPARATORS, lower=True)
                doc = w.doc()
                for k, h, at in prints(w, tuple({n for n in w.count.tolist() if 0 < n < WINDOW})):
                    own = np.flatnonzero(w.count[doc[at]] == k) if k < WINDOW else np.arange(len(at))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i).take(pa.array(doc[at[own]])), pa.array(h[own].view(np.int64)), pa.array(np.full(len(own), k, np.int32))], ["b", "fp", "k"])

    texts = items.select("item_id", F.coalesce("text", F.lit("")).alias("words")).withColumn("b", F.sha2("words", 256))
    bodies = written(texts.select("b", "words").dropDuplicates(["b"]), "items")
    known = written(bodies.mapInArrow(item_prints, "b string, fp long, k int").distinct(), "item_prints")
    lengths = tuple(sorted(r.k for r in known.where(F.col("k") < WINDOW).select("k").distinct().collect()))  # 12 at most
    bits = spark.sparkContext.broadcast(bitmap(known.select("fp")))

    def doc_prints(batches):
        for batch in batches:
            for i, j, blob, offsets in blobs(batch.column(0)):
                w = Words(blob, offsets, ALNUM_SEPARATORS, lower=True)
                doc = w.doc()
                own, fps = [], []
                for _, h, at in prints(w, lengths):
                    keep = picked(bits.value, h.view(np.int64))
                    own.append(doc[at[keep]])
                    fps.append(h[keep])
                own, fps = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (own, fps))
                for d in np.unique(own).tolist():
                    data = blob[offsets[d] : offsets[d + 1]].tobytes()
                    yield pa.RecordBatch.from_pydict({"key": [hashlib.sha256(data).hexdigest()], "text": pa.array([data.decode("utf-8", "replace")]), "fps": pa.array([np.unique(fps[own == d]).view(np.int64)], pa.list_(pa.int64()))})

    maybe = written(docs.select("text").mapInArrow(doc_prints, "key string, text string, fps array<long>").dropDuplicates(["key"]), "maybe")
    pairs = maybe.select("key", F.explode("fps").alias("fp")).join(known, "fp").select("key", "b").distinct()

    def grown(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                w, v = (words_of([batch.column(c)[r].as_py().encode()]) for c in (2, 3))
                found = list(Index([(None, batch.column(3)[r].as_py())]).hits(w))
                a, b = (np.concatenate([x[c] for x in found]) if found else np.zeros(0, np.int64) for c in (2, 3))
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(c)[r].as_py()] * len(a), pa.string()) for c in (0, 1)] + [pa.array(a), pa.array(b)], ["key", "b", "s", "e"])

    spans = written(pairs.join(maybe.select("key", "text"), "key").join(bodies, "b").select("key", "b", "text", "words").mapInArrow(grown, "key string, b string, s long, e long"), "spans")
    before = F.max("e").over(Window.partitionBy("key").orderBy("s", "e").rowsBetween(Window.unboundedPreceding, -1))
    n_hit = spans.select("key", "s", "e").distinct().withColumn("seen", F.coalesce(before, F.lit(0))).groupBy("key").agg(F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", "seen"))).alias("n_hit"))
    named = spans.select("key", "b").distinct().join(texts.select("b", "item_id").distinct(), "b").groupBy("key").agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    return written(n_hit.join(named, "key").select("key", "n_hit", "item_ids"), "hits")


def counted(docs: DataFrame, keep: list[str]) -> DataFrame:
    """The kept columns, n_words and the text's key."""
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            n = [Words(blob, offsets, ALNUM_SEPARATORS, hashes=False).count for _, _, blob, offsets in blobs(texts)]
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            key = [hashlib.sha256(t.as_buffer() if t.is_valid else b"").hexdigest() for t in texts]
            yield pa.RecordBatch.from_pydict(out | {"n_words": pa.array(np.concatenate([np.zeros(0, np.int64), *n])), "_key": pa.array(key, pa.string())})

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "n_words long, _key string"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None, ratio: int = 20, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Each document with its hits: the kept columns (all by default), then HITS.

    contaminated: at least one word in ``ratio`` lies in a benchmark window.
    """
    keep = [c for c in (docs.columns if keep is None else keep) if c not in NAMES]
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    size = items.agg(F.coalesce(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + 64), F.lit(0))).first()[0]
    if size <= most_bytes:
        index = docs.sparkSession.sparkContext.broadcast(Index([(r.item_id, r.text) for r in items.collect()]))
        kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
        schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), HITS])
        return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lambda batches: scan(batches, index.value, keep, ratio), schema)
    out = counted(docs, keep).join(joined(docs, items).withColumnRenamed("key", "_key"), "_key", "left")
    ids, hit = F.coalesce("item_ids", F.array().cast("array<string>")), F.coalesce("n_hit", F.lit(0))
    return out.select(*(f"`{c}`" for c in keep), "n_words", hit.cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), ids.alias("item_ids"), ((hit > 0) & (ratio * hit >= F.col("n_words"))).alias("contaminated"))
