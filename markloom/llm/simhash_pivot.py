"""SimHash near-duplicates through pivot distance tables.

A fingerprint's row of the table holds its Hamming distances to PIVOTS
reference fingerprints, block by block of its 64 bits.  Two fingerprints at
most MAX_BITS apart differ in at most MAX_BITS blocks, so in some pair of the
five blocks they are equal and so are all their distances there: rows meet
under the hash of those distances.  Rows that meet are discarded when a
coordinate of their whole distances differs by more than MAX_BITS (triangle
inequality), and what survives is verified by its Hamming distance.

Equal fingerprints are one row.  Of the links inside a group only a spanning
forest leaves the task, so a group of n gives at most n - 1 rows.  A group of
more than ``chunk`` rows is cut into chunks and the pairs of chunks are dealt
to different tasks.

Edge cases: null or wordless text has fingerprint zero and links like any
other; fewer words than a shingle are one shingle; repeated rows share a
component; rows with a null doc_id never name a component unless all of it is
null; other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._store import written
from ._text import mix
from .graph import components

SHINGLE, MAX_BITS, SEED = 3, 3, 42
WIDTHS = (13, 13, 13, 13, 12)
PIVOTS = np.random.default_rng(64).integers(0, 2**64, 12, dtype=np.uint64)
_EDGES = np.cumsum([0, *WIDTHS])
MASKS = np.array([((1 << int(b)) - (1 << int(a))) & (2**64 - 1) for a, b in zip(_EDGES, _EDGES[1:], strict=False)], dtype=np.uint64)
PAIRS = list(combinations(range(len(WIDTHS)), len(WIDTHS) - MAX_BITS))
_LOWER = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


def fingerprint(text: bytes, shingle: int = SHINGLE, piece: int = 1 << 16) -> int:
    """SimHash over word shingles: a bit is 1 if more than half of the shingle hashes have it."""
    words = text.translate(_LOWER).split()
    if not words:
        return 0
    k, n = min(shingle, len(words)), max(1, len(words) - shingle + 1)
    line = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words]) - 1
    start = np.concatenate([[0], end[:-1] + 1])
    ones = np.zeros(64, np.int64)
    digest = xxhash.xxh64_intdigest
    for i in range(0, n, piece):
        m = min(piece, n - i)
        spans = zip(start[i : i + m].tolist(), end[i + k - 1 : i + k - 1 + m].tolist(), strict=True)
        h = np.fromiter((digest(line[a:b], SEED) for a, b in spans), np.uint64, m)
        ones += np.unpackbits(h.view(np.uint8).reshape(m, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp long): the fingerprint's 64 bits as a signed number."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary())
            got = np.array([fingerprint(t.as_buffer().to_pybytes(), shingle) if t.is_valid else 0 for t in texts], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def pivot_table(fp: np.ndarray) -> np.ndarray:
    """Distances of shape (rows, blocks, pivots)."""
    return np.bitwise_count((fp[:, None] ^ PIVOTS[None, :])[:, None, :] & MASKS[None, :, None])


def meeting_keys(fp: np.ndarray) -> np.ndarray:
    """For each pair of blocks, a hash of the distances there; shape (rows, pairs)."""
    t = pivot_table(fp).astype(np.uint64)
    packed = np.zeros(t.shape[:2], np.uint64)
    for p in range(t.shape[2]):
        packed = packed * np.uint64(31) + t[:, :, p]
        packed = mix(packed) if p % 6 == 5 else packed
    return np.stack([mix(packed[:, list(c)].sum(axis=1, dtype=np.uint64) ^ mix(packed[:, c[0]] + np.uint64(i + 1))) for i, c in enumerate(PAIRS)], axis=1)


def near_pairs(a: np.ndarray, b: np.ndarray, same: bool, rows: int = 512):
    """(i, j) with a[i] and b[j] at most MAX_BITS apart: pivot filter, then Hamming distance."""
    ta, tb = (pivot_table(x).sum(axis=1, dtype=np.int16) for x in (a, b))
    order = np.argsort(tb[:, 0], kind="stable")
    first = tb[order, 0]
    for i in range(0, len(a), rows):
        part = np.arange(i, min(i + rows, len(a)))
        low = np.searchsorted(first, ta[part, 0] - MAX_BITS)
        n = np.searchsorted(first, ta[part, 0] + MAX_BITS, side="right") - low
        x = np.repeat(part, n)
        y = order[np.repeat(low - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
        if same:
            x, y = x[x < y], y[x < y]
        for p in range(1, ta.shape[1]):
            keep = np.abs(ta[x, p] - tb[y, p]) <= MAX_BITS
            x, y = x[keep], y[keep]
        keep = np.bitwise_count(a[x] ^ b[y]) <= MAX_BITS
        yield x[keep], y[keep]


def forest(n: int, pairs) -> np.ndarray:
    """Smallest index of each of n nodes' components, merging arrays of pairs one by one."""
    label = np.arange(n)
    for x, y in pairs:
        while len(x):
            a, b = label[x], label[y]
            apart = a != b
            if not apart.any():
                break
            x, y, a, b = x[apart], y[apart], a[apart], b[apart]
            up = np.arange(n)
            np.minimum.at(up, np.maximum(a, b), np.minimum(a, b))
            while (up != up[up]).any():
                up = up[up]
            label = up[label]
    return label


def _links(fps: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Spanning links of one group, or between two chunks of one."""
    fp = np.concatenate(fps)
    if len(fps) == 1:
        label = forest(len(fp), near_pairs(fp, fp, True))
    else:
        n = len(fps[0])
        label = forest(len(fp), ((x, y + n) for x, y in near_pairs(*fps, False)))
    own = np.flatnonzero(label != np.arange(len(fp)))
    return fp[own].view(np.int64), fp[label[own]].view(np.int64)


def _runs(batches, chunk: int):
    """Groups of equal keys of sorted batches: (key, part number, fingerprints, whether it is the whole group)."""
    key, held, size, part = None, [], 0, 0
    for batch in batches:
        keys, fps = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if keys[a] != key:
                if size > 1 or part:
                    yield key, part, np.concatenate(held), not part
                key, held, size, part = keys[a], [], 0, 0
            while size + b - a > chunk:
                held.append(fps[a : a + chunk - size])
                a += chunk - size
                yield key, part, np.concatenate(held), False
                held, size, part = [], 0, part + 1
            held.append(fps[a:b])
            size += b - a
    if size > 1 or part:
        yield key, part, np.concatenate(held or [np.zeros(0, np.uint64)]), not part


def links(distinct: DataFrame, chunk: int = 8192) -> DataFrame:
    """(u, v) links among distinct fingerprints (column fp) that span their components."""

    def deal(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            keys = meeting_keys(fp.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel().view(np.int64)), pa.array(np.repeat(fp, keys.shape[1]))], ["key", "fp"])

    def meet(batches):
        for key, part, fp, whole in _runs(batches, chunk):
            if whole:
                u, v = _links([fp])
                none = pa.nulls(len(u), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), none, none], ["u", "v", "key", "part"])
            else:
                n = len(fp)
                yield pa.RecordBatch.from_arrays([pa.array(fp.view(np.int64)), pa.nulls(n, pa.int64()), pa.array(np.full(n, key)), pa.array(np.full(n, part, np.int64))], ["u", "v", "key", "part"])

    def chunks(table: pa.Table) -> pa.Table:
        part = table["part"].to_numpy()
        fp = table["u"].to_numpy().view(np.uint64)
        u, v = _links([fp[part == p] for p in np.unique(part)])
        return pa.table({"u": u, "v": v})

    dealt = distinct.select("fp").mapInArrow(deal, "key long, fp long")
    met = written(dealt.repartition(F.col("key")).sortWithinPartitions("key", "fp").mapInArrow(meet, "u long, v long, key long, part long"), "links")
    large = met.where("key is not null")
    parts = large.groupBy("key").agg(F.max("part").alias("last"))
    dealt = large.join(parts, "key").select("key", "part", "u", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("other"))
    dealt = dealt.select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "u")
    return met.where("key is null").select("u", "v").unionByName(dealt.groupBy("key", "i", "j").applyInArrow(chunks, "u long, v long"))


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, chunk: int = 8192) -> DataFrame:
    """(doc_id, fp long, fingerprint, component_id): the smallest doc_id reachable over links."""
    prints = written(fingerprints(docs, shingle), "fingerprints")
    distinct = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    roots = components(links(distinct, chunk))
    named = distinct.join(roots, distinct["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    of = named.join(first, "root").select("fp", "component_id")
    return prints.join(of, "fp").select("doc_id", "fp", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
