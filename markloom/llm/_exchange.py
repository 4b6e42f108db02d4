"""Questions from batches of documents to slots of hashes, and the slots' answers.

Documents are packed into compressed batches, written once.  A batch asks each
slot in one message, with every hash at most once, so a hash that a third of
all documents hold costs one entry per batch.  Slots answer each message with
its own mask, and the answers meet their batch again by its number.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ._store import written

LAST = np.iinfo(np.int64).max


def packed(docs: DataFrame, limit: int = 8 << 20) -> DataFrame:
    """(batch, size, payload): about ``limit`` bytes of text a row, written to the shared folder."""

    def run(batches):
        held, size, n = [], 0, 0
        first = TaskContext.get().partitionId() << 32

        def row():
            table = pa.Table.from_batches(held).combine_chunks()
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, table.schema) as w:
                w.write_table(table)
            payload = zstandard.ZstdCompressor(level=3).compress(sink.getvalue().to_pybytes())
            return pa.RecordBatch.from_pydict({"batch": pa.array([first + n]), "size": pa.array([size]), "payload": pa.array([payload], pa.binary())})

        for batch in batches:
            texts = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            own = pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), texts], ["doc_id", "text"])
            ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
            i = 0
            while i < len(ends):
                before = ends[i - 1] if i else 0
                j = max(i + 1, int(np.searchsorted(ends, before + limit - size, side="right")))
                held.append(own.slice(i, j - i))
                size += int(ends[j - 1] - before)
                i = j
                if size >= limit or i < len(ends):
                    yield row()
                    held, size, n = [], 0, n + 1
        if held:
            yield row()

    return written(docs.select("doc_id", "text").mapInArrow(run, "batch long, size long, payload binary"), "batches", "none")


def unpack(payload: bytes) -> tuple[np.ndarray, pa.Array]:
    """doc_ids (null: the largest number) and texts of a batch."""
    table = pa.ipc.open_stream(zstandard.ZstdDecompressor().decompress(payload)).read_all()
    ids, texts = (table.column(i).combine_chunks() for i in (0, 1))
    return ids.fill_null(LAST).to_numpy(zero_copy_only=False), texts


def planes(x: np.ndarray, width: int) -> bytes:
    """Little-endian numbers byte plane by byte plane."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def unplanes(data: bytes, n: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def message(values: np.ndarray, width: int, *more: bytes) -> bytes:
    """Sorted values as compressed differences, and further bytes."""
    parts = [planes(np.diff(values, prepend=np.uint64(0)), width), *more]
    head = np.array([len(values), *map(len, more)], "<u8").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(bytes([len(more)]) + head + b"".join(parts))


def opened(body: bytes, width: int) -> tuple[np.ndarray, list[bytes]]:
    data = zstandard.ZstdDecompressor().decompress(body)
    k = data[0]
    n, *sizes = np.frombuffer(data[1 : 9 + 8 * k], "<u8").astype(int).tolist()
    at = 9 + 8 * k
    with np.errstate(over="ignore"):
        values = np.cumsum(unplanes(data[at : at + n * width], n, width), dtype=np.uint64)
    at += n * width
    more = []
    for size in sizes:
        more.append(data[at : at + size])
        at += size
    return values, more


def bits(x: np.ndarray) -> bytes:
    return np.packbits(x).tobytes()


def unbits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def slots_for(batches: DataFrame, slot_bytes: int) -> int:
    """A power of two, so that a slot stands for about ``slot_bytes`` of text."""
    total = batches.agg(F.sum("size")).first()[0] or 0
    return 1 << max(0, int(total // slot_bytes)).bit_length()


Ask = Callable[[np.ndarray, pa.Array, list[dict[int, bytes]]], Iterator[tuple[int, bytes]]]


def with_answers(batches: DataFrame, answers: list[DataFrame]) -> DataFrame:
    """Batches with one list of (slot, mask) for each round of answers."""
    out = batches.select("batch", "payload")
    for i, a in enumerate(answers):
        own = a.groupBy("batch").agg(F.collect_list(F.struct("slot", "mask")).alias(f"masks{i}"))
        out = out.join(own, "batch", "left")
    return out


def each_batch(batches) -> Iterator[tuple[int, np.ndarray, pa.Array, list[dict[int, bytes]]]]:
    for batch in batches:
        for row in range(batch.num_rows):
            masks = [{m["slot"]: m["mask"] for m in batch.column(c)[row].as_py() or ()} for c in range(2, batch.num_columns)]
            yield batch.column(0)[row].as_py(), *unpack(batch.column(1)[row].as_py()), masks


def answered(batches: DataFrame, answers: list[DataFrame], ask: Ask, answer, name: str) -> DataFrame:
    """(batch, slot, mask): asks from every batch, and lets every slot answer all messages at once.

    answer takes the bodies of one slot and returns as many masks; written.
    """

    def send(rows):
        for number, ids, texts, masks in each_batch(rows):
            slots, bodies = [], []
            for slot, body in ask(ids, texts, masks):
                slots.append(slot)
                bodies.append(body)
            yield pa.RecordBatch.from_pydict({"slot": pa.array(slots, pa.int64()), "batch": pa.array([number] * len(slots), pa.int64()), "body": pa.array(bodies, pa.binary())})

    def reply(table: pa.Table) -> pa.Table:
        return pa.table({"batch": table["batch"], "slot": table["slot"], "mask": pa.array(answer(table["body"].to_pylist()), pa.binary())})

    sent = with_answers(batches, answers).mapInArrow(send, "slot long, batch long, body binary")
    return written(sent.groupBy("slot").applyInArrow(reply, "batch long, slot long, mask binary"), name)


def by_slot(values: np.ndarray, slot: np.ndarray):
    """(slot, positions) of sorted order by slot and value."""
    order = np.lexsort((values, slot))
    cuts = np.flatnonzero(np.diff(slot[order])) + 1
    for part in np.split(order, cuts) if len(order) else ():
        yield int(slot[part[0]]), part
