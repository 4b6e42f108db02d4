"""Ranked lexical search by three-phase uniform thresholds over term-partitioned postings.

The index holds one list part for each term and segment of documents (about
32 MB of text, a bounded number of documents): places of the documents, how
often they hold the term, and their lengths.  Parts are dealt by term, and the
parts of a frequent term over several partitions, so no task holds a whole list
of unknown length.  A part's scores follow from the term's weight and the
corpus' size, which are known once the index is written.

1. Heads: the ``k`` best documents of each list.  Their sums over the terms of
   an item are lower bounds, and the k-th of them is the item's first bound.
2. Uniform threshold: with the first bound divided by the number of the item's
   terms, every list gives its documents from that score on; a document below
   it in all lists cannot reach the bound.  Each list is read once with the
   least threshold of the items that hold the term, and dealt by segment, where
   sums and, with the threshold for each list that did not name the document,
   upper bounds are taken.  The k-th sum over all segments is the second bound;
   documents whose upper bound reaches it are the candidates.
3. Lookup: the candidates' scores are read from the lists of all the item's
   terms, and the ``k`` best remain, all equal ones until the last order by id.

Items go in blocks of a bounded number of terms, whose tables are small enough
for every task.  Only the terms of items are indexed while they are at most
``MOST_TERMS``; beyond, all terms are, and a join picks the lists.

Terms are told apart by 64-bit hashes.  All arithmetic is of 64-bit integers
but the logarithm in the weight.

Edge cases: null and empty texts have no terms: such documents are never found
and such items give no rows; rows of equal doc_id are documents of their own,
ordered by place if their scores are equal too; null doc_ids come after all
others of the same score; rows of equal or null item_id are items of their own;
fewer than ``k`` documents with a score above 0 are all returned; an empty
table on either side gives no rows; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.window import Window

from ._store import written
from ._text import ALNUM_SEPARATORS, Words, blobs

TOP = 50
SEGMENT_BYTES, SEGMENT_DOCS, MOST_TERMS, BLOCK_TERMS = 32 << 20, 1 << 16, 1 << 20, 1 << 20
PARTS = "seg long, term long, docs binary, tf binary, n binary, df long"


def _held(a: np.ndarray, kind: str) -> bytes:
    return a.astype(kind).tobytes()


def item_terms(items: DataFrame) -> DataFrame:
    """(item, item_id, terms): a number for each row, and the distinct hashes of its terms; rows without are left out."""
    kind = items.schema["item_id"].dataType.simpleString()

    def run(batches):
        first, n = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for i, j, blob, offsets in blobs(batch.column(1)):
                w = Words(blob, offsets, ALNUM_SEPARATORS, lower=True)
                key = np.unique(np.stack([w.doc(), w.hash.view(np.int64)]), axis=1)
                ends = np.searchsorted(key[0], np.arange(j - i + 1))
                terms = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(key[1]))
                yield pa.RecordBatch.from_arrays([pa.array(first + n + np.arange(j - i)), batch.column(0).slice(i, j - i), terms], ["item", "item_id", "terms"])
                n += j - i

    return items.select("item_id", "text").mapInArrow(run, f"item long, item_id {kind}, terms array<long>").where(F.size("terms") > 0)


def index(docs: DataFrame, terms: np.ndarray | None = None) -> DataFrame:
    """List parts (PARTS, ids) of the documents' terms; a row of null term has a segment's doc_ids, its documents with terms (df) and their terms' number (total).

    terms: sorted hashes; others are counted, but have no lists.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(terms) if terms is not None else None

    def wanted(key: np.ndarray, own: np.ndarray, may: np.ndarray) -> np.ndarray:
        at = np.flatnonzero(may[key & 0xFFFFF])
        place = np.minimum(np.searchsorted(own, key[at]), len(own) - 1)
        return at[own[place] == key[at]]

    def run(batches):
        own = shared.value if shared else None
        may = np.zeros(1 << 20, bool)
        if own is not None:
            may[own & 0xFFFFF] = True
        seg = TaskContext.get().partitionId() << 32
        ids, counts, keys, places, size, n = [], [], [], [], 0, 0

        def parts() -> Iterator[pa.RecordBatch]:
            count = np.concatenate(counts)
            term, code = np.unique(np.concatenate(keys), return_inverse=True)
            pair, tf = np.unique(code.astype(np.int64) << 32 | np.concatenate(places), return_counts=True)
            doc, ends = pair & 0xFFFFFFFF, np.searchsorted(pair, np.arange(len(term) + 1) << 32)
            cut = [(int(a), int(b)) for a, b in zip(ends[:-1], ends[1:], strict=True)]
            long = count[doc]
            lists = {
                "term": [None, *term.tolist()],
                "docs": [None, *(_held(doc[a:b], "<u4") for a, b in cut)],
                "tf": [None, *(_held(tf[a:b], "<u4") for a, b in cut)],
                "n": [None, *(_held(long[a:b], "<u4") for a, b in cut)],
                "df": [int((count > 0).sum()), *(b - a for a, b in cut)],
                "total": [int(count.sum()), *(0 for _ in cut)],
            }
            named = pa.concat_arrays(ids)
            lists["ids"] = pa.ListArray.from_arrays(pa.array([0] + [len(named)] * (len(term) + 1), pa.int32()), named)
            yield pa.RecordBatch.from_pydict({"seg": pa.array([seg] * (len(term) + 1), pa.int64()), **lists}, schema=pa.schema([("seg", pa.int64()), ("term", pa.int64()), ("docs", pa.binary()), ("tf", pa.binary()), ("n", pa.binary()), ("df", pa.int64()), ("total", pa.int64()), ("ids", lists["ids"].type)]))

        for batch in batches:
            for i, j, blob, offsets in blobs(batch.column(1)):
                w = Words(blob, offsets, ALNUM_SEPARATORS, lower=True)
                key, doc = w.hash.view(np.int64), w.doc()
                if own is not None:
                    at = wanted(key, own, may) if len(own) else np.zeros(0, np.int64)
                    key, doc = key[at], doc[at]
                ids.append(batch.column(0).slice(i, j - i))
                counts.append(w.count)
                keys.append(key)
                places.append(doc + n)
                size, n = size + len(blob), n + j - i
                if size >= SEGMENT_BYTES or n >= SEGMENT_DOCS:
                    yield from parts()
                    seg += 1
                    ids, counts, keys, places, size, n = [], [], [], [], 0, 0
        if n:
            yield from parts()

    found = docs.select("doc_id", "text").mapInArrow(run, f"{PARTS}, total long, ids array<{kind}>")
    return written(found.withColumn("place", F.coalesce("term", "seg")).hint("rebalance", "place").drop("place"), "postings")


def weights(parts: DataFrame) -> tuple[DataFrame, int, int]:
    """(term, w) of all lists, and the numbers of documents and terms that the scores need."""
    n, total = parts.where("term is null").agg(F.coalesce(F.sum("df"), F.lit(0)), F.coalesce(F.sum("total"), F.lit(0))).first()
    df = parts.where("term is not null").groupBy("term").agg(F.sum("df").alias("df"))
    return df.select("term", F.floor(1000 * F.log(F.lit(float(2 * n + 2)) / (2 * F.col("df") + 1).cast("double"))).alias("w")), n, total


def _scores(w: int, tf: bytes, n: bytes, docs_in_all: int, terms_in_all: int) -> np.ndarray:
    t, size = np.frombuffer(tf, "<u4").astype(np.int64), np.frombuffer(n, "<u4").astype(np.int64)
    m = 50 + 50 * size * docs_in_all // terms_in_all
    return w * (1_000_000_000 * t // (1000 * t + 20 * m))


def _each(batches, docs_in_all: int, terms_in_all: int):
    """(seg, term, places, scores, row's columns from the sixth on) of list parts with their weights."""
    for batch in batches:
        cols = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
        for seg, term, docs, tf, n, w, *more in zip(*cols, strict=True):
            yield seg, term, np.frombuffer(docs, "<u4"), _scores(w, tf, n, docs_in_all, terms_in_all), more


def _sent(rows: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({
        "seg": pa.array([r[0] for r in rows], pa.int64()),
        "term": pa.array([r[1] for r in rows], pa.int64()),
        "docs": pa.array([_held(r[2], "<u4") for r in rows], pa.binary()),
        "scores": pa.array([_held(r[3], "<i8") for r in rows], pa.binary()),
    })


SENT = "seg long, term long, docs binary, scores binary"
FOUND = "item long, seg long, doc long, score long, most long"


class Block:
    """The items of a block with their terms and thresholds, for the tasks."""

    def __init__(self, items: list[tuple[int, list[int], int]]):
        self.items = {i: (np.sort(np.array(t, np.int64)), bound) for i, t, bound in items}
        terms = np.concatenate([t for t, _ in self.items.values()])
        floor = np.concatenate([np.full(len(t), self.threshold(i)) for i, (t, _) in self.items.items()])
        self.terms, at = np.unique(terms, return_inverse=True)
        self.least = np.full(len(self.terms), np.iinfo(np.int64).max)
        np.minimum.at(self.least, at, floor)

    def threshold(self, item: int) -> int:
        terms, bound = self.items[item]
        return bound // len(terms)

    def sums(self, lists: dict[int, tuple[np.ndarray, np.ndarray]], item: int, size: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """Sum of an item's scores from a floor on, and how many lists named the document, by place."""
        total, named = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for term in self.items[item][0].tolist():
            if term in lists:
                docs, scores = lists[term]
                some = scores >= floor
                docs, scores = (docs, scores) if some.all() else (docs[some], scores[some])
                total[docs] += scores
                named[docs] += 1
        return total, named


def _lists(table: pa.Table) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    cols = [table[c].to_pylist() for c in ("term", "docs", "scores")]
    return {t: (np.frombuffer(d, "<u4"), np.frombuffer(s, "<i8")) for t, d, s in zip(*cols, strict=True)}


def _found(rows: list[tuple[np.ndarray, ...]], seg: int) -> pa.Table:
    item, doc, score, most = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (zip(*rows, strict=True) if rows else ((), (), (), ())))
    return pa.table({"item": item, "seg": np.full(len(item), seg), "doc": doc, "score": score, "most": most})


def _kth(values: np.ndarray, k: int) -> int:
    return int(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else 0


def _bound(rows: DataFrame, k: int) -> DataFrame:
    """(item, bound): the k-th largest score of each item; items with fewer do not appear."""
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    return rows.withColumn("r", F.row_number().over(order)).where(F.col("r") == k).select("item", F.col("score").alias("bound"))


def _searched(lists: DataFrame, block: list, n: int, total: int, heads: DataFrame, k: int) -> DataFrame:
    """(item, seg, doc, score) of the k best documents of the block's items, and of all with the score of the last."""
    spark = lists.sparkSession
    own = spark.createDataFrame([(r.item, list(r.terms)) for r in block], "item long, terms array<long>")
    pairs = own.select("item", F.explode("terms").alias("term"))
    lower = heads.join(pairs, "term").groupBy("item", "seg", "doc").agg(F.sum("score").alias("score"))
    bound = {r.item: r.bound for r in _bound(lower, k).collect()}  # one number an item of the block
    held = spark.sparkContext.broadcast(Block([(r.item, r.terms, bound.get(r.item, 0)) for r in block]))

    def fetch(batches):
        b, rows, size = held.value, [], 0
        for seg, term, docs, scores, _ in _each(batches, n, total):
            at = int(np.searchsorted(b.terms, term))
            if at < len(b.terms) and b.terms[at] == term:
                some = scores >= b.least[at]
                rows.append((seg, term, docs[some], scores[some]))
                size += 12 * int(some.sum()) + 16
                if size > 4 << 20:
                    yield _sent(rows)
                    rows, size = [], 0
        yield _sent(rows)

    def bounds(table: pa.Table) -> pa.Table:
        b, lists_, rows = held.value, _lists(table), []
        size = 1 + max((int(d.max()) for d, _ in lists_.values() if len(d)), default=-1)
        for item, (terms, first) in b.items.items():
            floor = b.threshold(item)
            total_, named = b.sums(lists_, item, size, floor)
            at = np.flatnonzero(total_)
            score = total_[at]
            most = score + (len(terms) - named[at]) * max(0, floor - 1)
            some = most >= max(first, _kth(score, k))
            rows.append((np.full(int(some.sum()), item), at[some], score[some], most[some]))
        return _found(rows, table["seg"][0].as_py())

    partial = written(lists.mapInArrow(fetch, SENT).groupBy("seg").applyInArrow(bounds, FOUND), "partial")
    second = _bound(partial, k).withColumnRenamed("bound", "second")
    chosen = written(partial.join(second, "item", "left").where(F.col("most") >= F.coalesce("second", F.lit(0))).select("item", "seg", "doc"), "candidates")

    def ask(table: pa.Table) -> pa.Table:
        b, item, doc, want = held.value, table["item"].to_numpy(), table["doc"].to_numpy(), {}
        for i in np.unique(item).tolist():
            for term in b.items[i][0].tolist():
                want.setdefault(term, []).append(doc[item == i])
        docs = [_held(np.unique(np.concatenate(d)), "<u4") for d in want.values()]
        return pa.table({"seg": pa.array([table["seg"][0].as_py()] * len(want), pa.int64()), "term": pa.array(list(want), pa.int64()), "want": pa.array(docs, pa.binary())})

    def pick(batches):
        rows, size = [], 0
        for seg, term, docs, scores, (want,) in _each(batches, n, total):
            some = np.isin(docs, np.frombuffer(want, "<u4"), assume_unique=True)
            rows.append((seg, term, docs[some], scores[some]))
            size += 12 * int(some.sum()) + 16
            if size > 4 << 20:
                yield _sent(rows)
                rows, size = [], 0
        yield _sent(rows)

    def whole(looked: pa.Table, candidates: pa.Table) -> pa.Table:
        b, lists_, rows = held.value, _lists(looked), []
        item, doc = candidates["item"].to_numpy(), candidates["doc"].to_numpy()
        size = 1 + int(doc.max()) if len(doc) else 0
        for i in np.unique(item).tolist():
            at = doc[item == i]
            score = b.sums(lists_, i, size, 0)[0][at]
            some = score >= _kth(score, k)
            rows.append((np.full(int(some.sum()), i), at[some], score[some], score[some]))
        return _found(rows, candidates["seg"][0].as_py() if len(doc) else 0)

    asked = chosen.groupBy("seg").applyInArrow(ask, "seg long, term long, want binary")
    looked = lists.join(asked, ["seg", "term"]).select("seg", "term", "docs", "tf", "n", "w", "want").mapInArrow(pick, SENT)
    best = looked.groupBy("seg").cogroup(chosen.groupBy("seg")).applyInArrow(whole, FOUND)
    order = Window.partitionBy("item").orderBy(F.desc("score"))
    return best.where("score > 0").withColumn("r", F.rank().over(order)).where(F.col("r") <= k).select("item", "seg", "doc", "score")


def _blocks(items: DataFrame) -> Iterator[list]:
    """Rows of items in blocks of at most BLOCK_TERMS terms, or one item."""
    held, size = [], 0
    for row in items.toLocalIterator():
        if held and size + len(row.terms) > BLOCK_TERMS:
            yield held
            held, size = [], 0
        held.append(row)
        size += len(row.terms)
    if held:
        yield held


def search(docs: DataFrame, items: DataFrame, k: int = TOP) -> DataFrame:
    """(item_id, rank, doc_id, score): the k best documents of every item."""
    spark: SparkSession = docs.sparkSession
    asked = written(item_terms(items), "items")
    wanted = asked.select(F.explode("terms").alias("term")).distinct()
    few = wanted.count() <= MOST_TERMS
    terms = np.sort(np.array([r.term for r in wanted.collect()], np.int64)) if few else None
    parts = index(docs, terms)
    weight, n, total = weights(parts)
    lists = parts.where("term is not null").select("seg", "term", "docs", "tf", "n").join(F.broadcast(weight) if few else weight, "term")  # at most MOST_TERMS rows
    lists = (lists if few else lists.join(wanted, "term", "left_semi")).select("seg", "term", "docs", "tf", "n", "w")

    def head(batches):
        for batch in batches:
            rows = []
            for seg, term, at, scores, _ in _each([batch], n, total):
                best = np.argpartition(-scores, k - 1)[:k] if len(scores) > k else slice(None)
                rows.append((seg, term, at[best], scores[best]))
            size = [len(r[2]) for r in rows]
            seg, term = (np.repeat(np.array([r[c] for r in rows], np.int64), size) for c in (0, 1))
            doc, score = (np.concatenate([np.zeros(0, np.int64), *(r[c].astype(np.int64) for r in rows)]) for c in (2, 3))
            yield pa.RecordBatch.from_pydict({"seg": seg, "term": term, "doc": doc, "score": score})

    order = Window.partitionBy("term").orderBy(F.desc("score"), "seg", "doc")
    heads = lists.mapInArrow(head, "seg long, term long, doc long, score long").withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).drop("r")
    heads = written(heads, "heads")
    best = None
    for block in _blocks(asked.select("item", "terms")):
        one = written(_searched(lists, block, n, total, heads, k), "best")
        best = one if best is None else best.unionByName(one)
    if best is None:
        best = spark.createDataFrame([], "item long, seg long, doc long, score long")
    named = parts.where("term is null").select("seg", F.posexplode("ids").alias("doc", "doc_id"))
    rows = best.join(named, ["seg", "doc"]).join(asked.select("item", "item_id"), "item")
    last = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"), "seg", "doc")
    return rows.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")
