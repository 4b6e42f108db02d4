"""Exact substring dedup over words, with fixed-block anchors.

Every document is cut into non-overlapping reference blocks of seven words; a
window of 13 words holds at least one whole block of its document.  The blocks
are the index, every rolling seven-word window of every document probes it.
A hit is a block that another document holds too; hits are extended to maximal
runs of words in which every seven-word window is shared, and the 13-word
windows of those runs are settled by the smallest doc_id that has them.

A batch of documents asks with each hash once, so passages in a third of all
documents cost one entry per batch.  Blocks only pick candidates; windows are
told apart by two hashes of 64 bits over their words' hashes, so that words of
other texts are not moved.

Edge cases: null text has no words; a null doc_id counts as larger than any,
so such a row never outranks another (2^63-1 is read and given back as null);
doc_ids are whole numbers; rows of equal doc_id do not remove each other's
words; windows are judged on the input; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._exchange import LAST, answered, bits, by_slot, each_batch, message, opened, packed, slots_for, unbits, with_answers
from ._text import Words, blobs

WINDOW, BLOCK = 13, 7
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string"
_SHORT = np.uint64(24)
_OTHER = np.uint64(0xA0761D6478BD642F)


class Batch:
    """Words and windows of one batch of documents."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, slots: int):
        parts = [(i, Words(blob, offsets)) for i, _, blob, offsets in blobs(texts)]
        self.words = parts
        count = np.concatenate([w.count for _, w in parts]) if parts else np.zeros(0, np.int64)
        self.ids, self.count = ids, count
        self.first = np.concatenate([[0], np.cumsum(count)])
        seven = [w.rolling(BLOCK) for _, w in parts]
        n = self.first[-1]
        self.seven, self.one = np.zeros(n, np.uint64), np.zeros(n, bool)
        self.wide, self.other, self.whole = np.zeros(n, np.uint64), np.zeros(n, np.uint64), np.zeros(n, bool)
        at = 0
        for (_, w), (h, ok) in zip(parts, seven, strict=True):
            self.seven[at : at + len(h)], self.one[at : at + len(h)] = h, ok
            h, ok = w.rolling(WINDOW)
            self.wide[at : at + len(h)], self.whole[at : at + len(h)] = h, ok
            self.other[at : at + len(h)] = w.rolling(WINDOW, _OTHER)[0]
            at += len(w.start)
        self.doc = np.repeat(np.arange(len(count)), count)
        self.slots = np.uint64(slots - 1)

    def probes(self):
        """(slot, values, block, several, positions, which) of the rolling windows, each value once per slot."""
        at = np.flatnonzero(self.one & (self.count[self.doc] >= WINDOW))
        h = self.seven[at]
        for slot, part in by_slot(h >> _SHORT, (h & self.slots).astype(np.int64)):
            own = at[part]
            values, begin, which = np.unique(h[part] >> _SHORT, return_index=True, return_inverse=True)
            block = np.logical_or.reduceat((own - self.first[self.doc[own]]) % BLOCK == 0, begin)
            low, high = np.minimum.reduceat(self.doc[own], begin), np.maximum.reduceat(self.doc[own], begin)
            yield slot, values, block, low < high, own, which

    def candidates(self, answers: dict[int, bytes]) -> np.ndarray:
        """Positions of 13-word windows whose seven-word windows are all shared, one of them with a block."""
        shared, hit = np.zeros(len(self.seven), bool), np.zeros(len(self.seven), bool)
        for slot, values, _, _, own, which in self.probes():
            if slot in answers:
                n = len(values)
                mask = unbits(answers[slot], 2 * n)
                shared[own], hit[own] = mask[:n][which], mask[n:][which]
        k = WINDOW - BLOCK + 1
        every, some = np.concatenate([[0], np.cumsum(shared)]), np.concatenate([[0], np.cumsum(hit)])
        at = np.flatnonzero(self.whole)
        return at[(every[at + k] - every[at] == k) & (some[at + k] > some[at])]

    def windows(self, at: np.ndarray):
        """(slot, values, other values, smallest doc_id here, positions, which) of candidate windows."""
        h, other, owner = self.wide[at], self.other[at], self.ids[self.doc[at]]
        for slot, part in by_slot(h, (h & self.slots).astype(np.int64)):
            part = part[np.lexsort((other[part], h[part]))]
            first = np.ones(len(part), bool)
            first[1:] = (np.diff(h[part]) != 0) | (np.diff(other[part]) != 0)
            begin = np.flatnonzero(first)
            yield slot, h[part[begin]], other[part[begin]], np.minimum.reduceat(owner[part], begin), at[part], np.cumsum(first) - 1


def shared_blocks(bodies: list[bytes]) -> list[bytes]:
    """Masks: is the hash in several documents, and is it a reference block of one of them."""
    got = [opened(b, 5) for b in bodies]
    values = np.concatenate([v for v, _ in got])
    block = np.concatenate([unbits(m[0], len(v)) for v, m in got])
    several = np.concatenate([unbits(m[1], len(v)) for v, m in got])
    _, back, n = np.unique(values, return_inverse=True, return_counts=True)
    shared = (n > 1) | (np.bincount(back, several, len(n)) > 0)
    hit = (shared & (np.bincount(back, block, len(n)) > 0))[back]
    shared, out, at = shared[back], [], 0
    for v, _ in got:
        part = slice(at, at + len(v))
        out.append(bits(np.concatenate([shared[part], hit[part]])))
        at += len(v)
    return out


def smaller_elsewhere(bodies: list[bytes]) -> list[bytes]:
    """Masks: has another batch the window in a document of smaller doc_id."""
    got = [opened(b, 8) for b in bodies]
    values = np.concatenate([v for v, _ in got])
    least, other = (np.concatenate([np.frombuffer(m[i], kind) for _, m in got]) for i, kind in ((0, "<i8"), (1, "<u8")))
    order = np.lexsort((other, values))
    first = np.ones(len(order), bool)
    first[1:] = (np.diff(values[order]) != 0) | (np.diff(other[order]) != 0)
    begin = np.flatnonzero(first)
    low = np.minimum.reduceat(least[order], begin)
    of = np.empty(len(values), np.int64)
    of[order] = np.repeat(low, np.diff(np.append(begin, len(values))))
    smaller, out, at = of < least, [], 0
    for v, _ in got:
        out.append(bits(smaller[at : at + len(v)]))
        at += len(v)
    return out


def deduplicate(docs: DataFrame, slot_bytes: int = 16 << 20) -> DataFrame:
    """RESULT and kept (string): the text's words that stay, joined by one space."""
    batches = packed(docs)
    slots = slots_for(batches, slot_bytes)

    def probe(ids, texts, _):
        for slot, values, block, several, _, _ in Batch(ids, texts, slots).probes():
            yield slot, message(values, 5, bits(block), bits(several))

    def settle(ids, texts, masks):
        b = Batch(ids, texts, slots)
        for slot, values, other, least, _, _ in b.windows(b.candidates(masks[0])):
            yield slot, message(values, 8, least.astype("<i8").tobytes(), other.astype("<u8").tobytes())

    def cut(rows):
        for _, ids, texts, (first, second) in each_batch(rows):
            b = Batch(ids, texts, slots)
            cover = np.zeros(len(b.doc) + WINDOW, np.int64)
            for slot, values, _, least, at, which in b.windows(b.candidates(first)):
                gone = unbits(second[slot], len(values))[which] | (least[which] < ids[b.doc[at]])
                np.add.at(cover, at[gone], 1)
                np.add.at(cover, at[gone] + WINDOW, -1)
            removed = np.cumsum(cover)[: len(b.doc)] > 0
            total = np.concatenate([[0], np.cumsum(removed)])
            kept, at = [], 0
            for _, w in b.words:
                data = w.blob.tobytes()
                for a, z in zip(w.first[:-1].tolist(), w.first[1:].tolist(), strict=True):
                    stay = np.flatnonzero(~removed[at + a : at + z]) + a
                    kept.append(b" ".join([data[x:y] for x, y in zip(w.start[stay].tolist(), w.end[stay].tolist(), strict=True)]))
                at += len(w.start)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, mask=ids == LAST),
                    "n_words": pa.array(b.count.astype(np.int64)),
                    "n_removed": pa.array(total[b.first[1:]] - total[b.first[:-1]]),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    "kept": pa.array(kept, pa.binary()).cast(pa.string()),
                }
            )

    first = answered(batches, [], probe, shared_blocks, "blocks")
    second = answered(batches, [first], settle, smaller_elsewhere, "windows")
    return with_answers(batches, [first, second]).mapInArrow(cut, f"{RESULT}, kept string")
