"""SentencePiece encoding and decoding, exact for merge-type (BPE) models.

The library merges the adjacent pair of highest score, leftmost first, until
none is left.  A row of pieces is what those merges give exactly if every two
neighbours, merged anew on their own, give those two pieces again: a merge
across a border would have happened between these two alone as well.  So a text
is walked from the left: an Aho-Corasick automaton names the pieces that start
at a place, the longest compatible with the piece before is taken, and where
none is, the last piece is taken back and the next shorter one tried.  What was
reached before the place is the only encoding of that prefix, so the place can
never be a border again: one bit marks it as failed.  Each place is tried once
for each piece that starts there, so time is linear in the text.

No merge crosses the border between two characters that stand beside each other
in no piece, such as a letter and a space behind it; the units between such
borders are encoded once and kept in a bounded memory of the worker.  A unit of
any length is walked once.

Nothing is shuffled.  Pieces are told apart as the model's file says; the
model's path is a parameter and is opened in the tasks, so it must exist on
every executor.

Edge cases: null and empty texts have no ids and decode to an empty text; what
no piece covers becomes one id for each of its UTF-8 bytes; ids of bytes that
make no valid text decode to U+FFFD, one for each byte; null ids decode like
none; rows are kept as they are, repeated ones too; an empty table gives none.
Models other than merge-type ones with byte fallback and plain normalisation
raise ValueError.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from itertools import pairwise
from math import inf

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SPACE = "▁"
KNOWN, PAIRS = 1 << 19, 1 << 17


def model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Known(dict):
    """A memory of a function of a string: the last KNOWN entries and what is still used of the KNOWN before; long strings are not kept."""

    def __init__(self, make: Callable[[str], bytes]):
        super().__init__()
        self.make, self.before = make, {}

    def __missing__(self, unit: str) -> bytes:
        out = self.before.get(unit)
        if out is None:
            out = self.make(unit)
        if len(unit) <= 64:
            if len(self) >= KNOWN:
                self.before = dict(self)
                self.clear()
            self[unit] = out
        return out


class Model:
    """Encodes and decodes by one model file."""

    _own: dict[str, Model] = {}

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind, norm, train = pb.ModelProto.SentencePiece, proto.normalizer_spec, proto.trainer_spec
        plain = not norm.precompiled_charsmap and not norm.remove_extra_whitespaces and norm.escape_whitespaces and not train.treat_whitespace_as_suffix
        if train.model_type != pb.TrainerSpec.BPE or not plain or not train.byte_fallback or any(p.type in (kind.USER_DEFINED, kind.UNUSED) for p in proto.pieces):
            raise ValueError(f"{path}: only merge-type models with byte fallback and plain normalisation are encoded")
        self.prefix = SPACE if norm.add_dummy_prefix else ""
        self.ids = {p.piece: i for i, p in enumerate(proto.pieces) if p.type == kind.NORMAL}
        self.order = {p.piece: -p.score for p in proto.pieces if p.type == kind.NORMAL}  # the least is merged first
        byte = {int(p.piece[3:5], 16): i for i, p in enumerate(proto.pieces) if p.type == kind.BYTE}
        self.byte_ids = [byte[b] for b in range(256)]
        self.automaton = ahocorasick.Automaton()
        for piece in self.ids:
            self.automaton.add_word(piece, piece)
        self.automaton.make_automaton()
        prefixes = {p: [p[:i] for i in range(len(p) - 1, 0, -1)] for p in self.ids}
        self.shorter = {p: next((x for x in of if x in self.ids), "") for p, of in prefixes.items()}
        self.packed = {p: i.to_bytes(4, "little") for p, i in self.ids.items()}
        beside = {pair for p in self.ids for pair in pairwise(p)}
        self.index = np.zeros(0x110000, np.int32)  # a number for each character that stands beside another one in a piece
        self.index[[ord(c) for c in sorted({c for pair in beside for c in pair})]] = np.arange(len({c for pair in beside for c in pair})) + 1
        self.beside = np.zeros((self.index.max() + 1,) * 2, bool)
        self.beside[tuple(self.index[[ord(x[i]) for x in beside]] for i in (0, 1))] = True
        surface = {kind.NORMAL: lambda p: p.piece.replace(SPACE, " "), kind.CONTROL: lambda p: "", kind.UNKNOWN: lambda p: train.unk_surface}
        self.raw = [bytes([int(p.piece[3:5], 16)]) if p.type == kind.BYTE else surface[p.type](p).encode() for p in proto.pieces]
        self.is_byte = [p.type == kind.BYTE for p in proto.pieces]
        self.leads = [p.type == kind.NORMAL and p.piece.startswith(SPACE) for p in proto.pieces]
        self.known = _Known(lambda unit: b"".join(map(self._packed, self.pieces(unit))))
        self.together = lru_cache(PAIRS)(self._together)

    @classmethod
    def of(cls, path: str) -> Model:
        """The worker's own model, kept from task to task."""
        if path not in cls._own:
            cls._own[path] = cls(path)
        return cls._own[path]

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text by merging: the pair of highest score first, of equal ones the leftmost."""
        parts, none = list(text), inf
        order = [self.order.get(a + b, none) for a, b in pairwise(parts)]
        while order and (best := min(order)) < none:
            i = order.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del order[i]
            if i:
                order[i - 1] = self.order.get(parts[i - 1] + parts[i], none)
            if i < len(order):
                order[i] = self.order.get(parts[i] + parts[i + 1], none)
        return parts

    def _together(self, left: str, right: str) -> bool:
        """Whether two neighbours stay what they are; with no left one, whether a piece can be reached at all."""
        return self.merged(left + right) == ([left, right] if left else [right])

    def units(self, text: str) -> list[str]:
        """Parts of an escaped text, cut between characters that stand beside each other in no piece."""
        c = self.index[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        cuts = [0, *(np.flatnonzero(~self.beside[c[:-1], c[1:]]) + 1).tolist(), len(text)]
        return [text[a:b] for a, b in pairwise(cuts)]

    def _longest(self, text: str, at: int) -> str:
        """The longest piece that starts at a place; a character of no piece stands for itself."""
        end, piece = next(self.automaton.iter_long(text, at), (at, ""))
        return piece if end - at < len(piece) else text[at]

    def pieces(self, text: str) -> list[str]:
        """The pieces of an escaped text, by backtracking."""
        together, shorter, size = self.together, self.shorter, len(text)
        out, at, last, failed = [], 0, "", None
        piece = self._longest(text, 0) if text else ""
        while piece or at:
            while piece:
                to = at + len(piece)
                if (failed is None or not failed[to >> 3] >> (to & 7) & 1) and together(last, piece):
                    break
                piece = shorter.get(piece)
            if piece:
                out.append(piece)
                if to == size:
                    break
                at, last = to, piece
                piece = self._longest(text, at)
            else:
                failed = failed or bytearray(size // 8 + 1)
                failed[at >> 3] |= 1 << (at & 7)
                taken = out.pop()
                at, last, piece = at - len(taken), out[-1] if out else "", shorter.get(taken)
        return out

    def _packed(self, piece: str) -> bytes:
        own = self.packed.get(piece)
        return own if own is not None else b"".join(self.byte_ids[b].to_bytes(4, "little") for b in piece.encode())

    def encode(self, text: str) -> bytes:
        """Ids as little-endian 32-bit numbers."""
        if not text:
            return b""
        return b"".join(map(self.known.__getitem__, self.units(self.prefix + text.replace(" ", SPACE))))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids of the model."""
        raw = list(map(self.raw.__getitem__, ids))
        parted = b"" in raw  # control ids part bytes
        first = next((i for i, x in enumerate(raw) if x), None)
        if self.prefix and first is not None and self.leads[ids[first]]:  # the prefix goes, if nothing visible stands before it
            raw[first] = raw[first][1:]
        try:
            return self._mended(raw, ids) if parted else b"".join(raw).decode()
        except UnicodeDecodeError:
            return self._mended(raw, ids)

    def _mended(self, raw: list[bytes], ids: list[int]) -> str:
        out, run = [], b""
        for own, part in zip([*ids, None], [*raw, b""], strict=True):
            if own is not None and self.is_byte[own]:
                run += part
                continue
            while run:
                size = next((k for k in range(1, 5) if _valid(run[:k])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[size or 1 :]
            out.append(part.decode())
        return "".join(out)


def _valid(raw: bytes) -> bool:
    try:
        return len(raw.decode()) == 1
    except UnicodeDecodeError:
        return False


def _kinds(df: DataFrame, keep: list[str]) -> str:
    return "".join(f"`{c}` {df.schema[c].dataType.simpleString()}, " for c in keep)


def encode(docs: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns ``keep`` and ids, the ids of text."""
    path = path or model_path()

    def run(batches):
        model = Model.of(path)
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            own = [model.encode(t.as_py().decode("utf-8", "replace")) if t.is_valid else b"" for t in texts]
            ends = np.cumsum([0, *map(len, own)]) >> 2
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(own), "<i4")))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], ids], [*keep, "ids"])

    return docs.select(*(f"`{c}`" for c in keep), "text").mapInArrow(run, f"{_kinds(docs, keep)}ids array<int>")


def decode(coded: DataFrame, keep: list[str], path: str | None = None) -> DataFrame:
    """The columns ``keep`` and decoded, the text of ids."""
    path = path or model_path()

    def run(batches):
        model = Model.of(path)
        for batch in batches:
            texts = [model.decode(x.values.to_pylist()) if x.is_valid else "" for x in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string())], [*keep, "decoded"])

    return coded.select(*(f"`{c}`" for c in keep), "ids").mapInArrow(run, f"{_kinds(coded, keep)}decoded string")
