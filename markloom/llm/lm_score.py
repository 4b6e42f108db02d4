"""Cross-entropy difference of documents under matched n-gram models.

Target model: documents labelled of quality 1.  Background model: all
documents.  Both are bigram models over one shared vocabulary, all words of
the corpus, with the same Dirichlet smoothing; the background's counts are
scaled to the target's mass, so that neither model gains from size.  Counts
cover every word of every document.  A document's own counts are taken out of
both models before it is scored, so labelled documents are not scored by a
model that has seen them.

score = loss per token under the target minus loss under the background: low
scores look like the target.

Words, contexts and word pairs are kept apart by 64-bit hashes and grow with
the corpus; nothing is broadcast.  Batches of documents send each slot of
hashes their own counts, every event once a batch, so an event of a third of
all documents costs one entry a batch; slots add them up and answer each batch
with the totals of the events it asked for.

Edge cases: texts without words and tables without a target have score 0;
several labels of a document count as their largest; null doc_ids are never
labelled; repeated rows are counted and scored each, and take out one row's
counts; very long texts are one batch; words are lowered in ASCII; other
columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._exchange import bits, by_slot, message, opened, planes, slots_for, unbits, unplanes, with_answers
from ._store import written
from ._text import Words, blobs, mix

SMOOTH, BATCH = 8.0, 3 << 20
SCORES = "n_words long, loss_target double, loss_background double, score double"
_WORD, _CONTEXT, _PAIR, _START = (np.uint64(x) for x in (1, 2, 3, 0x9E3779B97F4A7C15))
_SHORT, _WIDTH = np.uint64(16), 6


def events(w: Words) -> np.ndarray:
    """Keys of shape (3, words): the word, what stands before it (or the text's start), and both."""
    before = np.empty_like(w.hash)
    before[1:] = w.hash[:-1]
    before[w.first[:-1][w.count > 0]] = _START
    with np.errstate(over="ignore"):
        return np.stack([mix(w.hash ^ mix(_WORD)), mix(before ^ mix(_CONTEXT)), mix(mix(before + _PAIR) + w.hash)])


def labelled(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, text, target): target is 1 for documents of quality 1.

    The labels grow with the documents, so the join is a merge at every size.
    """
    own = labels.where("doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    joined = docs.select("doc_id", "text").join(own.hint("merge"), "doc_id", "left")
    return joined.select("doc_id", "text", F.coalesce(F.col("quality") == 1, F.lit(False)).cast("int").alias("target"))


def packed(rows: DataFrame, limit: int) -> DataFrame:
    """(batch, size, payload): rows of about ``limit`` bytes of text as one compressed Arrow stream."""

    def run(batches):
        n, first = 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, blob, _ in blobs(batch.column(1), limit):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(i, j - i))
                payload = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
                yield pa.RecordBatch.from_pydict({"batch": pa.array([first + n]), "size": pa.array([len(blob)], pa.int64()), "payload": pa.array([payload], pa.binary())})
                n += 1

    return written(rows.mapInArrow(run, "batch long, size long, payload binary"), "batches", "none")


class Batch:
    """Documents of a batch, their words and what they ask."""

    def __init__(self, payload: bytes, slots: int):
        self.rows = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all().combine_chunks()
        self.words = [(i, j, Words(blob, offsets, lower=True)) for i, j, blob, offsets in blobs(self.rows.column(1))]
        self.target = self.rows.column(2).to_numpy() > 0
        self.keys = np.concatenate([events(w) for _, _, w in self.words] or [np.zeros((3, 0), np.uint64)], axis=1)
        self.doc = np.concatenate([i + w.doc() for i, _, w in self.words] or [np.zeros(0, np.int64)])
        self.slots = np.uint64(slots - 1)

    def asked(self):
        """(slot, values, which values are words, counts, target counts, events, value of each)."""
        flat = self.keys.ravel()
        n = self.keys.shape[1]
        hit = np.tile(self.target[self.doc], 3)
        for slot, own in by_slot(flat >> _SHORT, (flat & self.slots).astype(np.int64)):
            values, begin, back, times = np.unique(flat[own] >> _SHORT, return_index=True, return_inverse=True, return_counts=True)
            yield slot, values, own[begin] < n, times, np.bincount(back, hit[own], len(values)).astype(np.int64), own, back


def added(table: pa.Table) -> pa.Table:
    """A slot's totals for each batch that asked; words, mass and target_mass stand in the first row."""
    got = [opened(b.as_py(), _WIDTH) for b in table["body"]]
    values = np.concatenate([v for v, _ in got])
    word = np.concatenate([unbits(m[0], len(v)) for v, m in got])
    _, at, back = np.unique(values, return_index=True, return_inverse=True)
    totals = [np.zeros(len(at), np.int64) for _ in range(2)]
    for side, total in enumerate(totals):
        np.add.at(total, back, np.concatenate([unplanes(m[1 + side], len(v), 4) for v, m in got]).astype(np.int64))
    masks, i = [], 0
    for v, _ in got:
        own = back[i : i + len(v)]
        masks.append(zstandard.ZstdCompressor(level=1).compress(b"".join(planes(total[own], 6) for total in totals)))
        i += len(v)
    rest = [0] * (len(masks) - 1)
    stats = [int(word[at].sum()), *(int(total[word[at]].sum()) for total in totals)]
    return pa.table({"batch": table["batch"], "slot": table["slot"], "mask": pa.array(masks, pa.binary())} | {name: pa.array([x, *rest], pa.int64()) for name, x in zip(("words", "mass", "target_mass"), stats, strict=True)})


def totals_of(rows: DataFrame, slot_bytes: int) -> tuple[DataFrame, DataFrame, int]:
    """(batches, answers, slots) of the whole corpus's counts."""
    batches = packed(rows, BATCH)
    slots = min(1 << 16, slots_for(batches, slot_bytes))

    def send(parts):
        for part in parts:
            for number, payload in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                sent = [(slot, message(values, _WIDTH, bits(word), planes(times, 4), planes(hits, 4))) for slot, values, word, times, hits, _, _ in Batch(payload, slots).asked()]
                yield pa.RecordBatch.from_pydict({"slot": pa.array([s for s, _ in sent], pa.int64()), "batch": pa.array([number] * len(sent), pa.int64()), "body": pa.array([b for _, b in sent], pa.binary())})

    sent = batches.select("batch", "payload").mapInArrow(send, "slot long, batch long, body binary")
    reply = "batch long, slot long, mask binary, words long, mass long, target_mass long"
    return batches, written(sent.groupBy("slot").applyInArrow(added, reply), "totals"), slots


def losses(b: Batch, counts: np.ndarray, totals: tuple[int, int, int]) -> np.ndarray:
    """Mean loss of each document under target and background, its own counts left out; counts: (2, 3, words), background first."""
    words, mass, target_mass = totals
    n = len(b.rows)
    scale = target_mass / max(1, mass)
    own = np.empty_like(b.keys, np.int64)
    for k in range(3):
        order = np.lexsort((b.keys[k], b.doc))
        key, doc = b.keys[k][order], b.doc[order]
        cut = np.flatnonzero(np.concatenate([[True], (np.diff(key) != 0) | (np.diff(doc) != 0)])) if len(key) else np.zeros(0, np.int64)
        times = np.diff(np.append(cut, len(key)))
        own[k, order] = np.repeat(times, times)
    length = np.bincount(b.doc, minlength=n)
    out = []
    for side, factor, share in ((1, 1.0, b.target), (0, scale, np.ones(n, bool))):
        one, before, pair = ((counts[side, k] - own[k] * share[b.doc]) * factor for k in range(3))
        whole = ((target_mass if side else mass) - length * share)[b.doc] * factor
        p1 = (one + SMOOTH / 8) / (whole + SMOOTH / 8 * words)
        p = (pair + SMOOTH * p1) / (before + SMOOTH)
        out.append(np.bincount(b.doc, -np.log(p), minlength=n) / np.maximum(length, 1))
    return np.stack(out)


def score(docs: DataFrame, labels: DataFrame, slot_bytes: int = 16 << 20) -> DataFrame:
    """(doc_id, SCORES) of every document."""
    batches, answers, slots = totals_of(labelled(docs, labels), slot_bytes)
    totals = tuple(x or 0 for x in answers.agg(F.sum("words"), F.sum("mass"), F.sum("target_mass")).first())

    def run(parts):
        for part in parts:
            for payload, masks in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                b = Batch(payload, slots)
                answered = {m["slot"]: m["mask"] for m in masks or ()}
                n = b.keys.shape[1]
                counts = np.zeros((2, 3 * n), np.int64)
                for slot, values, _, _, _, own, back in b.asked():
                    data = zstandard.ZstdDecompressor().decompress(answered[slot])
                    for side in (0, 1):
                        counts[side, own] = unplanes(data[side * 6 * len(values) : (side + 1) * 6 * len(values)], len(values), 6).astype(np.int64)[back]
                t, g = losses(b, counts.reshape(2, 3, n), totals) if totals[2] else np.zeros((2, len(b.rows)))
                length = np.bincount(b.doc, minlength=len(b.rows)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([b.rows.column(0).combine_chunks(), pa.array(length), pa.array(t), pa.array(g), pa.array(t - g)], ["doc_id", "n_words", "loss_target", "loss_background", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return with_answers(batches, [answers]).mapInArrow(run, f"doc_id {kind}, {SCORES}")
