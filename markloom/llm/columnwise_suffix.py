"""Exact byte-substring dedup by column-wise multi-document suffix sorting.

Column-wise construction takes as many rounds as the longest document has
symbols and passes over the whole transform in each, so the documents are
first cut to what can match.  Each window of 200 bytes is named by its anchor,
the smallest-hashed 100-byte gram inside; equal windows have equal anchors at
equal places.  Batches ask which anchors occur twice, and neighbouring windows
of one repeated anchor become a segment of at most 300 bytes, dealt by its
anchor.  In a slot, segments without a window whose hash another one has are
done; the others are the documents of collections of at most BLOCK segments,
whole anchors each.

A collection's Burrows-Wheeler transform and common-prefix array grow by one
symbol per segment each round, from the segments' ends: a sequential pass over
the transform gives each new suffix its rank, and the common prefixes change at
the new suffixes and right behind them only, by the least common prefix since
the last suffix that was extended by the same symbol.  A window is repeated if
its suffix shares 200 symbols with a neighbour.  The arrays of a collection
take the place of the sequential files, as a block fits in memory; between
batches and slots the shuffle's files do.  Symbols are compared, not hashes.

An anchor of more than HOT occurrences, say inside a passage that a third of
all documents hold in different surroundings, would gather its segments in one
slot.  Its windows are dealt by their own 64-bit hashes instead, each once a
batch, and told apart by them.  An anchor of more than BLOCK segments in one
slot has its windows compared directly, place by place.

Edge cases: null text is empty; texts under 200 bytes have no window; equal
rows remove each other's bytes wholly; a null doc_id is a document like any
other, and so is one of 2^63-1, which comes back as null; doc_ids are whole
numbers; windows are judged on the input; other columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._exchange import LAST, answered, bits, by_slot, each_batch, message, opened, packed, slots_for, unbits, with_answers
from ._text import blobs, powers, prefix_hash, span_hash

WINDOW, GRAM = 200, 100
SIDE = WINDOW - GRAM
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
_SHORT = np.uint64(24)
BLOCK, HOT = 4096, 50_000


def sliding(x: np.ndarray, k: int, pick) -> np.ndarray:
    """pick over every k neighbours, by doubling."""
    done = 1
    while done < k:
        step = min(done, k - done)
        x = pick(x[:-step], x[step:])
        done += step
    return x


class Part:
    """Anchors and windows of a slice of documents."""

    def __init__(self, blob: np.ndarray, offsets: np.ndarray):
        self.blob, self.offsets = blob, offsets
        n = len(blob)
        m = max(0, n - WINDOW + 1)
        at = np.arange(n)
        ok = np.zeros(n, bool)
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            ok[a : max(a, b - WINDOW + 1)] = True
        self.whole = ok[:m]
        if not m:
            self.low, self.anchor, self.gram = np.zeros(0, np.uint64), np.zeros(0, bool), np.zeros(0, np.uint64)
            return
        powers(n + 1)
        s = prefix_hash(blob)
        self.gram = span_hash(s, at[: n - GRAM + 1], at[: n - GRAM + 1] + GRAM)
        self.low = sliding(self.gram, SIDE + 1, np.minimum)
        low = np.where(self.whole, self.low, 0)
        wide = np.zeros(m + 2 * SIDE, np.uint64)
        wide[SIDE : SIDE + m] = low
        self.anchor = sliding(wide, SIDE + 1, np.maximum)[: len(self.gram)] == self.gram

    def spots(self, at: np.ndarray) -> np.ndarray:
        """The leftmost anchor of each window: the first gram inside that has the smallest hash."""
        known = np.flatnonzero(self.anchor)
        nth = np.searchsorted(known, at)
        off = np.arange(len(at))
        while len(off := off[self.gram[known[nth[off]]] != self.low[at[off]]]):
            nth[off] += 1
        return known[nth]

    def candidates(self, shared: np.ndarray) -> np.ndarray:
        """Windows whose anchor (mask over grams) is shared; one look for each run of windows of one anchor."""
        at = np.flatnonzero(self.whole)
        if not len(at):
            return at
        run = np.flatnonzero(np.concatenate([[True], (np.diff(self.low[at]) != 0) | (np.diff(at) > 1)]))
        return at[np.repeat(shared[self.spots(at[run])], np.diff(np.append(run, len(at))))]

    def segments(self, at: np.ndarray):
        """(first window, last window, anchor) of runs of candidate windows under one anchor."""
        if not len(at):
            return np.zeros((0, 3), np.int64)
        spot = self.spots(at)
        cut = np.flatnonzero((np.diff(at) > 1) | (np.diff(spot) != 0)) + 1
        begin = np.concatenate([[0], cut])
        return np.stack([at[begin], at[np.concatenate([cut - 1, [len(at) - 1]])], spot[begin]], axis=1)


class Batch:
    def __init__(self, ids: np.ndarray, texts: pa.Array, slots: int):
        self.ids, self.slots = ids, np.uint64(slots - 1)
        self.parts = [Part(blob, offsets) for _, _, blob, offsets in blobs(texts, 2 << 20)]

    def anchors(self):
        """(slot, values, occurrences, which part, gram) of the anchors, each value once per slot."""
        at = [np.flatnonzero(p.anchor) for p in self.parts]
        h = np.concatenate([p.gram[a] for p, a in zip(self.parts, at, strict=True)] or [np.zeros(0, np.uint64)])
        part = np.repeat(np.arange(len(at)), [len(a) for a in at])
        at = np.concatenate(at or [np.zeros(0, np.int64)])
        for slot, own in by_slot(h >> _SHORT, (h & self.slots).astype(np.int64)):
            values, which, n = np.unique(h[own] >> _SHORT, return_inverse=True, return_counts=True)
            yield slot, values, n.astype("<u4"), part[own], at[own], which

    def segments(self, answers: dict[int, bytes]):
        """(part, segments, whether each segment's anchor is hot) after the answers about anchors."""
        shared = [np.zeros(len(p.gram), bool) for p in self.parts]
        hot = [np.zeros(len(p.gram), bool) for p in self.parts]
        for slot, values, _, part, at, which in self.anchors():
            if slot in answers:
                n = len(values)
                mask = unbits(answers[slot], 2 * n)
                for k in np.unique(part).tolist():
                    own = part == k
                    shared[k][at[own]], hot[k][at[own]] = mask[:n][which[own]], mask[n:][which[own]]
        found = [(p, p.segments(p.candidates(s))) for p, s in zip(self.parts, shared, strict=True)]
        return [(p, s, h[s[:, 2]]) for (p, s), h in zip(found, hot, strict=True)]

    def asked(self, answers: dict[int, bytes]):
        """What goes to each slot: (slot, segments and their left lengths, several, [(part, first, last, segment)], windows, several, [(part, window)], which)."""
        found = self.segments(answers)
        rows = [(k, *s) for k, (_, segments, hot) in enumerate(found) for s in segments[~hot].tolist()]
        slot = np.concatenate([(p.gram[s[~hot, 2]] & self.slots).astype(np.int64) for p, s, hot in found] or [np.zeros(0, np.int64)])
        data = [p.blob.tobytes() for p, _, _ in found]
        own_segments: dict[int, list[int]] = {}
        for i, x in enumerate(slot.tolist()):
            own_segments.setdefault(x, []).append(i)
        part, at, h = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for k, (p, segments, hot) in enumerate(found):
            if hot.any():
                n = segments[hot, 1] - segments[hot, 0] + 1
                w = np.repeat(segments[hot, 0] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                part.append(np.full(len(w), k))
                at.append(w)
                h.append(span_hash(prefix_hash(p.blob), w, w + WINDOW))
        part, at, h = (np.concatenate(x) for x in (part, at, h))
        own_windows = dict(by_slot(h, (h & self.slots).astype(np.int64)))
        for x in sorted({*own_segments, *own_windows}):
            known: dict[tuple[bytes, int], int] = {}
            which, n = [], []
            for i in own_segments.get(x, ()):
                k, a, z, spot = rows[i]
                key = (data[k][a : z + WINDOW], spot - a)
                j = known.setdefault(key, len(known))
                if j == len(n):
                    n.append(0)
                n[j] += 1
                which.append((k, a, z, j))
            own = own_windows.get(x, np.zeros(0, np.int64))
            values, back, times = np.unique(h[own], return_inverse=True, return_counts=True)
            yield x, list(known), np.array(n, np.int64) > 1, which, values, times > 1, (part[own], at[own]), back


def twice(bodies: list[bytes], hot: int = HOT) -> list[bytes]:
    """Masks: does the anchor occur twice anywhere, and more than ``hot`` times."""
    got = [opened(b, 5) for b in bodies]
    values = np.concatenate([v for v, _ in got])
    times = np.concatenate([np.frombuffer(m[0], "<u4") for _, m in got])
    _, back = np.unique(values, return_inverse=True)
    n = np.bincount(back, times)[back] if len(back) else times
    out, at = [], 0
    for v, _ in got:
        own = n[at : at + len(v)]
        out.append(bits(np.concatenate([own > 1, own > hot])))
        at += len(v)
    return out


class Collection:
    """The Burrows-Wheeler transform, common prefixes (up to 255) and suffixes of a block of segments, one column a round.

    The transform holds the symbol before each suffix, -1 before a whole segment; while it grows, symbols are numbered
    from 1 in their order, and 0 stands before whole segments.
    """

    def __init__(self, segments: list[bytes]):
        n = len(segments)
        size = np.array([len(x) for x in segments], np.int64)
        raw = np.frombuffer(b"".join(segments), np.uint8)
        used = np.flatnonzero(np.bincount(raw, minlength=256))
        number = np.zeros(256, np.uint8 if len(used) < 255 else np.int16)
        number[used] = np.arange(1, len(used) + 1)
        flat, end = number[raw], np.cumsum(size)
        self._symbols = np.zeros(n, number.dtype)
        self.common = np.zeros(n, np.uint8)
        self._suffix = np.arange(n, dtype=np.int32) << 10  # segment and length
        newest = np.arange(n)  # places of the suffixes inserted last
        for t in range(int(size.max(initial=0)) + 1):
            own = self._suffix[newest] >> 10
            more = size[own] > t
            self._symbols[newest] = np.where(more, flat[np.maximum(end[own] - 1 - t, 0)], 0)
            if more.any():
                newest = self._insert(newest[more], n)
        self.segment, self.length = self._suffix >> 10, self._suffix & 0x3FF
        self.transform = np.concatenate([[-1], used])[self._symbols]

    def _insert(self, before: np.ndarray, n: int) -> np.ndarray:
        """Inserts the suffixes one symbol longer than those at ``before``; their places, in order."""
        symbols, common, suffix = self._symbols, self.common, self._suffix
        order = np.argsort(symbols, kind="stable")
        ended = len(symbols) - int(np.count_nonzero(symbols))
        chosen = np.zeros(len(symbols), bool)
        chosen[before] = True
        rank = np.flatnonzero(chosen[order])
        place = rank - ended + n
        size = len(symbols) + len(place)
        source = np.ones(size, np.int64)
        source[place] = 0
        np.cumsum(source, out=source)
        source -= 1
        source[place] = len(symbols) + np.arange(len(place))
        more = suffix[order[rank]] + 1
        none = np.zeros(len(place), np.uint8)
        self._symbols, self.common, self._suffix = (np.take(np.concatenate([x, y.astype(x.dtype)]), source) for x, y in ((symbols, none), (common, none), (suffix, more)))
        look = np.unique(np.concatenate([place, place + 1]))
        look = look[(look > n) & (look < size)]
        k = look - n + ended
        p, q = order[k], order[k - 1]
        same = symbols[p] == symbols[q]
        self.common[look[~same]] = 0
        p, q, look = p[same], q[same], look[same]
        step = np.cumsum(p - q)
        for part in np.split(np.arange(len(p)), np.flatnonzero(np.diff(step >> 22)) + 1) if len(p) else ():
            m = p[part] - q[part]
            first = np.concatenate([[0], np.cumsum(m)[:-1]])
            span = np.repeat(q[part] + 1 - first, m) + np.arange(m.sum())
            self.common[look[part]] = np.minimum(np.minimum.reduceat(common[span], first), 254) + 1
        return place

    def repeated(self) -> np.ndarray:
        """(segment, suffix length) of suffixes that share WINDOW symbols with a neighbour."""
        near = self.common >= WINDOW
        near[:-1] |= near[1:].copy()
        return np.stack([self.segment[near], self.length[near]], axis=1)


def window_hashes(data: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, piece: int = 1 << 20):
    """(segment, place, hash) of all windows, for anchors at ascending ``first``; the place counts bytes before the anchor."""
    n = left + right - SIDE + 1
    seg = np.repeat(np.arange(len(n)), n)
    x = left[seg] - (np.arange(len(seg)) - np.concatenate([[0], np.cumsum(n)[:-1]])[seg])
    start = first[seg] - x
    out = np.empty(len(seg), np.uint64)
    ends = np.cumsum(n)
    i = 0
    while i < len(n):
        j = max(i + 1, int(np.searchsorted(first, first[i] + piece)))
        own = slice(ends[i] - n[i], ends[j - 1])
        low = int(first[i] - left[i])
        s = prefix_hash(data[low : int((first[i:j] + GRAM + right[i:j]).max())])
        out[own] = span_hash(s, start[own] - low, start[own] - low + WINDOW)
        i = j
    return seg, x, out


def direct(data: np.ndarray, start: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Which windows have an equal one of the same group (place and hash), compared symbol by symbol."""
    order = np.lexsort((start, group))
    hit = np.zeros(len(start), bool)
    near = np.flatnonzero(np.diff(group[order]) == 0)
    for part in np.split(near, range(1 << 14, len(near), 1 << 14)):
        a, b = order[part], order[part + 1]
        at = np.arange(WINDOW)[None, :]
        same = (data[start[a][:, None] + at] == data[start[b][:, None] + at]).all(axis=1)
        hit[a[same]] = hit[b[same]] = True
    return hit


def repeated(bodies: list[bytes], block: int = BLOCK) -> list[bytes]:
    """Masks of SIDE + 1 windows per segment, and of the dealt windows: does the window occur elsewhere, or twice."""
    got = [opened(b, 8) for b in bodies]
    left = np.concatenate([np.frombuffer(m[1], np.uint8) for _, m in got]).astype(np.int64)
    size = np.concatenate([np.frombuffer(m[2], "<i4") for _, m in got]).astype(np.int64)
    several = np.concatenate([unbits(m[3], len(m[2]) // 4) for _, m in got])
    mask = np.zeros((len(size), SIDE + 1), bool)
    if len(size):
        data = np.concatenate([np.frombuffer(m[0], np.uint8) for _, m in got])
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        raw = data.tobytes()
        # equal segments of several batches are one
        known: dict[tuple[bytes, int], int] = {}
        of = np.array([known.setdefault((raw[a : a + n], x), len(known)) for a, n, x in zip(begin.tolist(), size.tolist(), left.tolist(), strict=True)])
        some = np.zeros(len(known), np.int64)
        some[of[::-1]] = np.arange(len(of))[::-1]
        again = (np.bincount(of) > 1) | (np.bincount(of, several) > 0)
        first = begin[some] + left[some]
        seg, x, h = window_hashes(data, first, left[some], size[some] - left[some] - GRAM)
        hit = again[seg]
        _, back, n = np.unique(h, return_inverse=True, return_counts=True)
        # a group of equal hashes in which every window is known to be repeated has nothing to settle
        open_ = np.bincount(back, ~hit, minlength=len(n)) > 0
        maybe = (n[back] > 1) & open_[back]
        lively = np.unique(seg[maybe])
        grams = np.ascontiguousarray(data[first[lively][:, None] + np.arange(GRAM)[None, :]]).view(f"V{GRAM}").ravel()
        _, anchor, times = np.unique(grams, return_inverse=True, return_counts=True)
        large = times[anchor] > block
        code = seg * (SIDE + 1) + x
        small = lively[~large][np.argsort(anchor[~large], kind="stable")]
        ends = np.flatnonzero(np.diff(np.sort(anchor[~large]), append=-1)) + 1  # whole anchors to a block
        at = 0
        while at < len(small):
            to = int(ends[np.searchsorted(ends, at + block, side="right") - 1])
            own = small[at:to]
            at = to
            c = Collection([raw[begin[some[i]] : begin[some[i]] + size[some[i]]] for i in own.tolist()])
            s, length = c.repeated().T
            i = own[s]
            hit |= np.isin(code, i * (SIDE + 1) + left[some[i]] - size[some[i]] + length)
        wide = np.zeros(len(known), bool)
        wide[lively[large]] = True
        ask = np.flatnonzero(maybe & wide[seg])
        if len(ask):
            hit[ask] |= direct(data, first[seg[ask]] - x[ask], back[ask])
        found = np.zeros((len(known), SIDE + 1), bool)
        found[seg, x] = hit
        mask = found[of]
    values = np.concatenate([v for v, _ in got])
    more = np.concatenate([unbits(m[4], len(v)) for v, m in got])
    _, back, n = np.unique(values, return_inverse=True, return_counts=True)
    dealt = ((n > 1) | (np.bincount(back, more, len(n)) > 0))[back]
    out, at, w = [], 0, 0
    for v, m in got:
        k = len(m[2]) // 4
        out.append(np.packbits(mask[at : at + k], axis=1).tobytes() + bits(dealt[w : w + len(v)]))
        at, w = at + k, w + len(v)
    return out


def deduplicate(docs: DataFrame, slot_bytes: int = 16 << 20, hot: int = HOT, block: int = BLOCK) -> DataFrame:
    """RESULT and kept (binary): the text's bytes that stay."""
    batches = packed(docs, 3 << 20)
    slots = slots_for(batches, slot_bytes)

    def anchors(ids, texts, _):
        for slot, values, times, _, _, _ in Batch(ids, texts, slots).anchors():
            yield slot, message(values, 5, times.tobytes())

    def segments(ids, texts, masks):
        for slot, known, several, _, windows, more, _, _ in Batch(ids, texts, slots).asked(masks[0]):
            sizes = np.array([len(b) for b, _ in known], "<i4")
            yield slot, message(windows, 8, b"".join(b for b, _ in known), bytes(x for _, x in known), sizes.tobytes(), bits(several), bits(more))

    def cut(rows):
        for _, ids, texts, (first, second) in each_batch(rows):
            batch = Batch(ids, texts, slots)
            cover = [np.zeros(len(p.blob) + 1, np.int32) for p in batch.parts]
            for slot, known, _, which, windows, _, (part, start), back in batch.asked(first):
                wide = len(known) * ((SIDE + 8) // 8)
                mask = np.unpackbits(np.frombuffer(second[slot][:wide], np.uint8).reshape(len(known), -1) if known else np.zeros((0, 13), np.uint8), axis=1, count=SIDE + 1)
                for k, a, z, j in which:
                    # the window that starts at s takes left - (s - a) bytes before the anchor
                    x = known[j][1] - np.arange(z - a + 1)
                    at = a + np.flatnonzero(mask[j, x])
                    np.add.at(cover[k], at, 1)
                    np.add.at(cover[k], at + WINDOW, -1)
                gone = unbits(second[slot][wide:], len(windows))[back] if len(windows) else np.zeros(0, bool)
                for k in np.unique(part[gone]).tolist():
                    at = start[gone & (part == k)]
                    np.add.at(cover[k], at, 1)
                    np.add.at(cover[k], at + WINDOW, -1)
            n_removed, n_spans, kept = [], [], []
            for p, c in zip(batch.parts, cover, strict=True):
                gone = np.cumsum(c)[:-1] > 0
                for a, z in zip(p.offsets[:-1].tolist(), p.offsets[1:].tolist(), strict=True):
                    own = gone[a:z]
                    n_removed.append(int(own.sum()))
                    n_spans.append(int(own[:1].sum() + (own[1:] & ~own[:-1]).sum()))
                    kept.append(p.blob[a:z][~own].tobytes())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": pa.array(ids, mask=ids == LAST),
                    "n_bytes": pa.array([len(k) + r for k, r in zip(kept, n_removed, strict=True)], pa.int64()),
                    "n_removed": pa.array(n_removed, pa.int64()),
                    "n_spans": pa.array(n_spans, pa.int64()),
                    "kept_sha256": pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()),
                    "kept": pa.array(kept, pa.binary()),
                }
            )

    first = answered(batches, [], anchors, lambda bodies: twice(bodies, hot), "anchors")
    second = answered(batches, [first], segments, lambda bodies: repeated(bodies, block), "segments")
    return with_answers(batches, [first, second]).mapInArrow(cut, f"{RESULT}, kept binary")
