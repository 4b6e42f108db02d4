"""Best-fit packing of token pieces into sequences, by hierarchical residuals.

Documents become token ids and an end id 0; longer ones are cut into full
pieces, each a sequence of its own, and a last piece.  Last pieces are dealt to
nodes of about ``node_items``.  A node packs best-fit decreasing and emits its
nearly full bins; its ``carry`` least filled bins travel up as items, ``fan_in``
nodes to one, to be packed best-fit again until one node is left.  Inside a
node no two bins fit together, so what can still be joined higher up are a few
underfull bins of each node, and a bound on ``carry`` costs no document: bins
that stay behind are emitted as they are.

Edge cases: null and empty texts are the end id alone, a piece of length 1;
repeated rows are packed each; an empty table gives no rows; other columns are
not read.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._store import written
from ._text import Words, blobs, hash_spans

CAPACITY, END = 2048, 0
#: Bytes of text encoded at once; a worker keeps the memory of its largest slice.
SLICE = 1 << 19
PIECES = "piece int, start long, length long, ids_crc32 long"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


_encoders: dict[str, Encoder] = {}


#: Marks that end many words; after an ASCII letter or digit each is a token of its own.
_MARK = np.isin(np.arange(256), list(b".,;:!?"))
_ALNUM = np.isin(np.arange(256), list(b"0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"))


class Encoder:
    """Token ids of white-space words, with a bounded memory of the words met first.

    White space separates tokens of this tokenizer and case does not matter to
    it, so a text's ids are those of its words in a row, a last mark apart and
    ASCII letters lowered.  Lowering waits where it could matter: beside
    combining marks, which compose with some small letters only, and beside
    what may be a special token.  New words are encoded many to a string, with
    NUL between them, whose id no word without NUL can have.
    """

    def __init__(self, path: str, known: int = 250_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known, self.seen = known, {}
        (self.between,) = self.tokenizer.encode("\0", add_special_tokens=False).ids

    @staticmethod
    def of(path: str) -> Encoder:
        """The worker's own encoder, kept from task to task."""
        if path not in _encoders:
            _encoders[path] = Encoder(path)
        return _encoders[path]

    def encoded(self, words: list[bytes], together: int = 64) -> list[bytes]:
        """Ids of each word as bytes."""
        out: list[bytes] = [b""] * len(words)
        plain = [i for i, x in enumerate(words) if b"\0" not in x and b"<|" not in x]
        groups = [plain[i : i + together] for i in range(0, len(plain), together)]
        texts = ["".join(words[i].decode("utf-8", "replace") + " \0 " for i in g) for g in groups]
        for g, e in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False), strict=True):
            ids = np.array(e.ids, "<u4")
            ends, data, at = np.flatnonzero(ids == self.between).tolist(), ids.tobytes(), 0
            for i, end in zip(g, ends, strict=True):
                out[i], at = data[4 * at : 4 * end], end + 1
        for i in sorted({*range(len(words))} - {*plain}) if len(plain) < len(words) else ():
            out[i] = np.array(self.tokenizer.encode(words[i].decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4").tobytes()
        return out

    def ids(self, blob: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and where each text's begin."""
        raw = blob.tobytes()
        w = Words(blob, offsets, lower=not (b"\xcc" in raw or b"\xcd" in raw or b"<|" in raw), hashes=False)
        data = w.blob.tobytes()
        cut = (w.end - w.start > 1) & _MARK[w.blob[w.end - 1]] & _ALNUM[w.blob[w.end - 2]]
        start = np.sort(np.concatenate([w.start, w.end[cut] - 1]))
        end = np.sort(np.concatenate([w.end - cut, w.end[cut]]))
        _, at, back = np.unique(hash_spans(w.blob, start, end), return_index=True, return_inverse=True)
        words = [data[a:b] for a, b in zip(start[at].tolist(), end[at].tolist(), strict=True)]
        own = [self.seen.get(x) for x in words]
        new = [i for i, x in enumerate(own) if x is None]
        for i in range(0, len(new), 20_000):
            part = new[i : i + 20_000]
            for j, e in zip(part, self.encoded([words[j] for j in part]), strict=True):
                own[j] = e
        self.seen.update((words[i], own[i]) for i in new[: max(0, self.known - len(self.seen))])
        size = np.array([len(x) for x in own], np.int64) >> 2
        flat = np.frombuffer(b"".join(own), "<u4")
        begin = np.concatenate([[0], np.cumsum(size)])[:-1]
        n = size[back]
        first = np.concatenate([[0], np.cumsum(n)])
        span = np.concatenate([[0], np.cumsum(1 + cut.astype(np.int64))])
        return flat[np.repeat(begin[back] - first[:-1], n) + np.arange(first[-1])], first[span[w.first]]


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, PIECES) of every document."""
    path = path or tokenizer_path()

    def run(batches):
        encoder = Encoder.of(path)
        for batch in batches:
            ids = batch.column(0)
            for i, j, blob, offsets in blobs(batch.column(1), SLICE):
                flat, first = encoder.ids(blob, offsets)
                rows: list[tuple[int, int, int, int, int]] = []
                for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
                    own = np.append(flat[a:b], np.uint32(END)).astype("<u4")
                    for p, s in enumerate(range(0, len(own), capacity)):
                        part = own[s : s + capacity]
                        rows.append((i + d, p, s, len(part), zlib.crc32(part.tobytes())))
                doc, piece, start, length, crc = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, {PIECES}")


def best_fit(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-fit decreasing: each item's bin and place there, and the bins' fills."""
    bin_of, place, fills = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64), []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_ = 0  # bit r: some bin has r left
    for i in np.argsort(-sizes, kind="stable").tolist():
        n = int(sizes[i])
        if above := open_ >> n:
            r = n + (above & -above).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                open_ ^= 1 << r
        else:
            r, b = capacity, len(fills)
            fills.append(0)
        bin_of[i], place[i] = b, fills[b]
        fills[b] += n
        if r > n:
            room[r - n].append(b)
            open_ |= 1 << (r - n)
    return bin_of, place, np.array(fills, np.int64)


def _pack(table: pa.Table, level: int, capacity: int, nearly: int, carry: int, size: str) -> pa.Table:
    """Adds bin, place, fill and up (whether the bin travels on) to a node's items."""
    node = table["node"][0].as_py()
    bin_of, place, fills = best_fit(table[size].to_numpy(), capacity)
    up = np.zeros(len(fills), bool)
    up[np.argsort(fills, kind="stable")[:carry]] = True
    up &= fills < nearly
    ids = (level << 56) + (node << 30) + np.arange(len(fills))
    for name, column in (("bin", ids[bin_of]), ("place", place), ("fill", fills[bin_of]), ("up", up[bin_of])):
        table = table.append_column(name, pa.array(column))
    return table


def pack(items: DataFrame, capacity: int = CAPACITY, node_items: int = 50_000, fan_in: int = 8, carry: int = 1024, nearly: float = 0.99) -> DataFrame:
    """items with a length from 1 to capacity, each with sequence_id and offset; a written table, whose rows are numbered alike in every attempt."""
    full = items.where(F.col("length") >= capacity).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = items.where(F.col("length") < capacity)
    nodes = max(1, -(-rest.count() // node_items))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema.fields)
    extra, few = "node long, bin long, place long, fill long, up boolean", int(capacity * nearly)

    def packer(level: int, size: str):
        return lambda t: _pack(t, level, capacity, few, carry, size)

    key = F.pmod(F.xxhash64(*items.columns, F.monotonically_increasing_id()), F.lit(nodes))  # equal rows are dealt over all nodes
    packed = written(rest.withColumn("node", key).groupBy("node").applyInArrow(packer(1, "length"), f"{kinds}, {extra}"), "packed")
    bins, out, level = packed.where("up and place = 0").select("node", "bin", "fill"), packed.drop("node", "fill", "up"), 1
    while nodes > 1:
        nodes, level = -(-nodes // fan_in), level + 1
        child = bins.select(F.col("bin").alias("child"), F.col("fill").alias("size"), F.floor(F.col("node") / fan_in).cast("long").alias("node"))
        step = written(child.groupBy("node").applyInArrow(packer(level, "size"), f"child long, size long, {extra}"), "packed")
        bins = step.where("up and place = 0").select("node", "bin", "fill")
        move = step.select("child", F.col("bin").alias("to"), F.col("place").alias("at"))
        out = out.join(move, F.col("bin") == F.col("child"), "left").withColumns({"place": F.col("place") + F.coalesce("at", F.lit(0)), "bin": F.coalesce("to", "bin")}).drop("child", "to", "at")
    return full.unionByName(out.withColumnsRenamed({"bin": "sequence_id", "place": "offset"}))


def sequences(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, **how) -> DataFrame:
    """(doc_id, PIECES, sequence_id, offset) of every document."""
    return pack(written(pieces(docs, path, capacity), "pieces"), capacity, **how)
