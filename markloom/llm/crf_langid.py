"""Language identification with a linear-chain conditional random field.

Every word is a node; its features are affixes and character n-grams of 1 to 5
bytes (the word's ends are marked, so affixes are n-grams too) and the word
itself as lexicon entry, hashed into a fixed table of learned weights.  Learned
transitions join neighbouring words, so words of code-switched text are
labelled in context.  Forward-backward gives each word's label probabilities;
a document's language is the label with the largest sum over words that hold a
letter, its score the mean probability of that label, its certainty the mean of
each such word's largest probability, whichever label that is: high also where
every word of a code-switched text is told apart.

Forward-backward is exact at any length: texts are cut into blocks, all blocks'
transfer matrices are multiplied side by side, and block borders are scanned.

Training uses a bounded sample: about ``per_lang`` labelled documents of each
language, ``span_words`` words in spans from the whole of each; a quarter of
the training sequences join spans of different languages.

Edge cases: null text or text without a letter gives `und` and 0; a null lang
is never learned from; with no labelled row everything is `und`; equal sums
fall to the alphabetically first label; repeated rows count each; null doc_ids
are sampled like one document; result names win over columns of the same name,
unless they are not kept; other columns are not read.
"""

from __future__ import annotations

from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ._text import Words, blobs, prefix_hash, span_hash

BITS, GRAMS, BLOCK = 18, (1, 2, 3, 4, 5), 64
UNKNOWN = "und"
#: Bytes of text labelled at once; a worker keeps the memory of its largest slice.
SLICE = 1 << 19


def features_of(words: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Marked words as one byte array with their borders."""
    n = end - start
    first = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.empty(first[-1], np.uint8)
    out[first[:-1]] = 0x3C
    out[first[1:] - 1] = 0x3E
    inside = np.ones(len(out), bool)
    inside[first[:-1]] = inside[first[1:] - 1] = False
    out[inside] = words[np.repeat(start - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())]
    return out, first[:-1], first[1:], first


def feature_ids(words: np.ndarray, start: np.ndarray, end: np.ndarray):
    """Yields (ids, word) of all features, n-gram length by length."""
    marked, a, b, _ = features_of(words, start, end)
    s = prefix_hash(marked)
    owner = np.repeat(np.arange(len(a)), b - a)
    mask = np.uint64((1 << BITS) - 1)
    at = np.arange(len(marked))
    for n in GRAMS:
        ok = at + n <= b[owner]
        p = at[ok]
        yield (span_hash(s, p, p + n) & mask).astype(np.int64), owner[ok]
    yield (span_hash(s, a, b) & mask).astype(np.int64), np.arange(len(a))


def emissions(weights: np.ndarray, words: np.ndarray, start: np.ndarray, end: np.ndarray, piece: int = 50_000) -> np.ndarray:
    """Log-potentials of the words' labels."""
    out = np.zeros((len(start), weights.shape[1]))
    for i in range(0, len(start), piece):
        part = slice(i, i + piece)
        n = len(start[part])
        for ids, owner in feature_ids(words, start[part], end[part]):
            for label in range(weights.shape[1]):
                out[part, label] += np.bincount(owner, weights[ids, label], minlength=n)
    return out


def forward_backward(e: np.ndarray, trans: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scaled alpha and beta of every word; e: log-potentials, first: where each sequence begins, and the end."""
    n, k = e.shape
    e = np.exp(e - e.max(axis=1, keepdims=True)) if n else e
    a = np.exp(trans)
    count = np.diff(first)
    per = -(-count // BLOCK)
    seq = np.repeat(np.arange(len(count)), per)
    begin = np.concatenate([[0], np.cumsum(per)])
    nth = np.arange(begin[-1]) - begin[:-1][seq]
    at = first[:-1][seq] + nth * BLOCK
    size = np.minimum(BLOCK, first[1:][seq] - at)
    order = np.argsort(-size, kind="stable")
    at, size = at[order], size[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    active = [int(np.searchsorted(-size, -t, side="left")) for t in range(BLOCK + 1)]  # blocks of more than t words

    prod = np.tile(np.eye(k), (len(at), 1, 1))
    for t in range(BLOCK):
        if not (m := active[t]):
            break
        x = (prod[:m].reshape(-1, k) @ a).reshape(m, k, k) * e[at[:m] + t][:, None, :]
        prod[:m] = x / x.max(axis=(1, 2), keepdims=True)
    entry, leave = np.full((len(at), k), 1.0 / k), np.ones((len(at), k))
    by_length = np.argsort(-per, kind="stable")
    v, u = np.full((len(count), k), 1.0 / k), np.ones((len(count), k))
    for t in range(int(per.max(initial=0))):
        own = by_length[: int((per > t).sum())]
        b = place[begin[own] + t]
        entry[b] = v[own]
        x = np.einsum("bi,bij->bj", v[own], prod[b])
        v[own] = x / x.sum(axis=1, keepdims=True)
        b = place[begin[own + 1] - 1 - t]
        leave[b] = u[own]
        x = np.einsum("bij,bj->bi", prod[b], u[own])
        u[own] = x / x.sum(axis=1, keepdims=True)
    alpha, beta = np.empty((n, k)), np.empty((n, k))
    x = entry
    for t in range(BLOCK):
        if not (m := active[t]):
            break
        x = (x[:m] @ a) * e[at[:m] + t]
        x /= x.sum(axis=1, keepdims=True)
        alpha[at[:m] + t] = x
    x = leave
    for t in range(BLOCK - 1, -1, -1):
        if not (m := active[t]):
            continue
        beta[at[:m] + t] = x[:m]
        y = (e[at[:m] + t] * x[:m]) @ a.T
        x[:m] = y / y.sum(axis=1, keepdims=True)
    return alpha, beta


def marginals(alpha: np.ndarray, beta: np.ndarray) -> np.ndarray:
    g = alpha * beta
    return g / g.sum(axis=1, keepdims=True)


class Model:
    """Labels, feature weights and transitions; fitted by stochastic gradient on the conditional likelihood."""

    def __init__(self, labels: list[str]):
        self.labels = labels
        self.weights = np.zeros((1 << BITS, len(labels)))
        self.trans = np.zeros((len(labels), len(labels)))

    def fit(self, sequences: list[list[tuple[bytes, int]]], epochs: int = 4, batch: int = 64, rate: float = 0.25, seed: int = 7) -> Model:
        rng, sums, sums_t = np.random.default_rng(seed), np.full_like(self.weights, 1e-2), np.full_like(self.trans, 1e-2)
        for _ in range(epochs):
            order = rng.permutation(len(sequences))
            for i in range(0, len(order), batch):
                chosen = [sequences[j] for j in order[i : i + batch]]
                words = [w for s in chosen for w, _ in s]
                gold = np.array([y for s in chosen for _, y in s])
                first = np.concatenate([[0], np.cumsum([len(s) for s in chosen])])
                end = np.cumsum([len(w) for w in words])
                blob = np.frombuffer(b"".join(words), np.uint8)
                feats = list(feature_ids(blob, end - np.array([len(w) for w in words]), end))
                ids, owner = np.concatenate([f for f, _ in feats]), np.concatenate([o for _, o in feats])
                e = np.stack([np.bincount(owner, self.weights[ids, y], minlength=len(words)) for y in range(len(self.labels))], axis=1)
                alpha, beta = forward_backward(e, self.trans, first)
                diff = -marginals(alpha, beta)
                diff[np.arange(len(gold)), gold] += 1
                used, back = np.unique(ids, return_inverse=True)
                g = np.stack([np.bincount(back, diff[owner, y]) for y in range(len(self.labels))], axis=1)
                sums[used] += g * g
                self.weights[used] += rate * g / np.sqrt(sums[used]) - 1e-4 * self.weights[used]
                inner = np.setdiff1d(np.arange(1, len(words)), first)
                pair = alpha[inner - 1][:, :, None] * np.exp(self.trans)[None] * (np.exp(e - e.max(axis=1, keepdims=True)) * beta)[inner][:, None, :]
                g = -(pair / pair.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
                np.add.at(g, (gold[inner - 1], gold[inner]), 1)
                sums_t += g * g
                self.trans += rate * g / np.sqrt(sums_t)
        self.weights = self.weights.astype(np.float32)
        return self

    def label(self, w: Words) -> np.ndarray:
        """Label probabilities of every word."""
        keys, at, back = np.unique(w.hash, return_index=True, return_inverse=True)
        e = emissions(self.weights, w.blob, w.start[at], w.end[at])
        return marginals(*forward_backward(e[back], self.trans, w.first))


def with_letters(w: Words, blob: np.ndarray) -> np.ndarray:
    """Whether each word holds a letter of any script; words without an ASCII letter are decoded, once each."""
    ascii_letter = np.concatenate([[0], np.cumsum(((blob | 0x20) >= 0x61) & ((blob | 0x20) <= 0x7A))])
    wide = np.concatenate([[0], np.cumsum(blob >= 0x80)])
    out = ascii_letter[w.end] > ascii_letter[w.start]
    ask = np.flatnonzero(~out & (wide[w.end] > wide[w.start]))
    _, at, back = np.unique(w.hash[ask], return_index=True, return_inverse=True)
    found = [any(c.isalpha() for c in blob[w.start[i] : w.end[i]].tobytes().decode("utf-8", "replace")) for i in ask[at].tolist()]
    out[ask] = np.array(found, bool)[back]
    return out


def predict(model: Model | None, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and certainty of each text."""
    langs, scores, certain = [], [np.zeros(0)], [np.zeros(0)]
    for i, j, blob, offsets in blobs(texts, SLICE):
        if model is None:
            langs += [UNKNOWN] * (j - i)
            scores.append(np.zeros(j - i))
            certain.append(np.zeros(j - i))
            continue
        w = Words(blob, offsets, lower=True)
        counted = with_letters(w, blob)
        p = model.label(w) * counted[:, None] if len(w.start) else np.zeros((0, len(model.labels)))
        of = lambda x: (lambda s: s[w.first[1:]] - s[w.first[:-1]])(np.concatenate([np.zeros((1, x.shape[1])), np.cumsum(x, axis=0)]))  # noqa: B023, E731
        total, top, n = of(p), of(p.max(axis=1, keepdims=True))[:, 0], of(counted[:, None])[:, 0]
        has = n > 0
        langs += [model.labels[b] if h else UNKNOWN for b, h in zip(total.argmax(axis=1).tolist(), has.tolist(), strict=True)]
        for out, x in ((scores, total.max(axis=1)), (certain, top)):
            out.append(np.where(has, np.clip(x / np.maximum(n, 1), 0, 1), 0.0))
    return langs, np.concatenate(scores), np.concatenate(certain)


def training_sequences(rows: list[tuple[str, str]], labels: list[str], span_words: int, span: int = 30, seed: int = 11) -> list[list[tuple[bytes, int]]]:
    rng, spans = np.random.default_rng(seed), []
    for text, lang in rows:
        words = text.encode().lower().split()
        y = labels.index(lang)
        for at in np.linspace(0, max(0, len(words) - span), max(1, min(span_words, len(words)) // span)).astype(int):
            if part := words[at : at + span]:
                spans.append([(w, y) for w in part])
    rng.shuffle(spans)
    mixed = len(spans) // 4
    pairs = [a[: rng.integers(3, 28)] + b[: rng.integers(3, 28)] for a, b in pairwise(spans[:mixed])]
    return spans[mixed:] + pairs


def train(docs: DataFrame, usable: Column, per_lang: int = 300, span_words: int = 150) -> Model | None:
    """Fits on a bounded sample of the usable rows with a lang, chosen by a hash of doc_id."""
    known = docs.where(usable & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(per_lang / n))])
    part = F.pmod(F.xxhash64(F.lit("sample"), F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    rows = [(r["text"], r["lang"]) for r in known.where(part < share[F.col("lang")]).select("text", "lang").toLocalIterator()]
    labels = sorted(counts)
    return Model(labels).fit(training_sequences(sorted(rows), labels, span_words))


def identify(docs: DataFrame, model: Model | None, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default), lang_pred string, score double and certainty double."""
    names = ("lang_pred", "score", "certainty")
    keep = [c for c in (docs.columns if keep is None else keep) if c not in names]
    sent = docs.sparkSession.sparkContext.broadcast(model)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for batch in batches:
            langs, scores, certain = predict(sent.value, batch.column(batch.schema.get_field_index("text")))
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(out | dict(zip(names, (pa.array(langs, pa.string()), pa.array(scores), pa.array(certain)), strict=True)))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "lang_pred string, score double, certainty double"])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)
