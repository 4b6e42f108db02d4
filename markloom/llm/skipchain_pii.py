"""Personal data: base patterns and a skip-chain conditional random field.

Base spans come from four patterns, matched in linear time.  The field then
labels tokens: those that hold a digit or an at sign, and name-like words that
equal the marked user part of an address in the same document.  Shape features
give unary potentials, touching tokens share chain potentials, and distant
repeated or similar tokens (equal core, equal digits, equal mail user) share
skip potentials, each token with its latest predecessor of the same key and
with the key's first base span, wherever that stands, so that every mention
hears it directly and links grow with the tokens and not with their pairs.
Base spans are observed; loopy message passing carries their labels to the
other mentions until its messages settle.  A token outside base spans becomes a
span, without the marks around it, when it has a skip link and its belief
reaches ``sure``.  Base spans always stay.

All potentials are learned, by pseudo-likelihood, on a bounded sample of
documents whose base spans serve as labels.  Texts rarely repeat an address in
another form, so held-out mentions are made: each base span of the sample is
mentioned again without what makes its pattern match, linked to it and of its
label, beside a pair of decoys of the same shape and other characters, linked
to each other and of no label.  So shape alone says little, and the links must.

Edge cases: null text is empty; overlapping kinds are all kept; equal starts
are ordered by kind; repeated rows count each; very long texts are read whole
(training reads the first SAMPLE_CHARS characters of a sampled one); a sample
without base spans adds no span; result names win over columns of the same
name, unless they are not kept; other columns are not read.  Offsets are code
points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import random
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ._text import mix

KINDS = ("email", "ip", "card", "phone")
SPANS = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_USER = re.compile(r"[A-Za-z0-9._%+-]*\Z")
_USER_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]++(?:\.[0-9]++)*+")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9@]\S*")
_NONDIGIT = re.compile(r"[^0-9]")
_MARKS = ".,;:!?()[]<>{}\"'"
FEATURES, SAMPLE_CHARS = 1 << 12, 20_000
CHAIN, SKIP = 0, 1


def emails(text: str) -> list[tuple[int, int]]:
    out, done = [], 0
    for m in _AT.finditer(text) if "@" in text else ():
        at = m.start()
        if at < done:
            continue
        start = at
        while start > done and text[start - 1] in _USER_CHARS:
            start -= 1
        if start < at:
            out.append((start, m.end()))
            done = m.end()
    return out


def luhn(digits: str) -> bool:
    odd = [int(c) for c in digits[-1::-2]]
    even = [int(c) * 2 for c in digits[-2::-2]]
    return (sum(odd) + sum(x - 9 if x > 9 else x for x in even)) % 10 == 0


def ips(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DOTTED.finditer(text):
        if m[0].count(".") < 3:
            continue
        parts, at = m[0].split("."), m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= 12:
            digits = _NONDIGIT.sub("", m[0])
            if 12 <= len(digits) <= 19 and luhn(digits):
                out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= len(_NONDIGIT.sub("", m[0])) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end), sorted."""
    return sorted((a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text))


def tokens_of(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """Tokens that hold a digit or at sign, and words that equal the marked user part of a base address."""
    out, done = [], 0
    for m in _TOKEN.finditer(text):
        start = m.start()
        while start > done and not text[start - 1].isspace():
            start -= 1
        out.append((start, m.end()))
        done = m.end()
    users = {text[a:z].split("@")[0] for a, k, z in base if k == 0}
    users = sorted(u for u in users if len(u) >= 6 and re.search(r"[A-Za-z][._-]+[A-Za-z]", u) and not re.search(r"[0-9]", u))
    if users:
        named = re.compile(r"(?i)(?<![\w.%+@-])(?:" + "|".join(map(re.escape, users)) + r")(?![\w%+@-])")
        out = sorted([*out, *(m.span() for m in named.finditer(text))])
    return out


def shape(token: str) -> list[str]:
    digits = len(_NONDIGIT.sub("", token))
    short = re.sub(r"[^\W\d_]+", "a", re.sub(r"[0-9]+", "9", token))[:24]
    return ["bias", f"d{min(digits, 20)}", f"l{min(len(token), 40) // 2}", f".{min(token.count('.'), 5)}", f"-{min(token.count('-'), 4)}", f"@{'@' in token}", f"+{token[0] == '+'}", f"({token[0]}" if not token[0].isalnum() else "w", f"r{digits * 4 // len(token)}", f"s{short}"]


def keys_of(token: str) -> list[str]:
    core = token.strip(".,;:!?()[]<>{}\"'").lower()
    digits = _NONDIGIT.sub("", token)
    user = core.split("@")[0]
    return [f"c{core}"] * (len(core) >= 6) + [f"d{digits}"] * (len(digits) >= 7) + [f"u{user}"] * (len(user) >= 6)


class Graph:
    """Tokens of many documents as nodes, with chain and skip edges."""

    def __init__(self):
        self.spans: list[tuple[int, int, int]] = []  # document, start, end
        self.feats: list[list[int]] = []
        self.gold: list[int] = []
        self.edges: list[tuple[int, int, int]] = []  # from, to, CHAIN or SKIP
        self.hidden: set[int] = set()  # labelled nodes that training must predict

    def add(self, doc: int, text: str, base: list[tuple[int, int, int]]) -> None:
        mentions: dict[str, list[int]] = {}
        before, ended, b = -1, -1, 0
        free = [(x, y, 0) for x, y in tokens_of(text, base)]
        for start, end, label in sorted([*free, *((x, z, k + 1) for x, k, z in base)]):
            while b < len(base) and base[b][2] <= start:
                b += 1
            if not label and any(x < end and z > start for x, _, z in base[max(0, b - 4) : b + 8]):
                continue  # a base span is one node, whatever tokens it covers
            token = text[start:end]
            core = token.strip(_MARKS) if not label else token
            at = start + token.find(core) if core else start
            node = len(self.spans)
            self.spans.append((doc, at, at + len(core or token)))
            self.gold.append(label)
            self.feats.append(feature_ids(tuple(shape(token))))
            if before >= 0 and ended + 1 == start:
                self.edges.append((before, node, CHAIN))
            ended = end
            for key in keys_of(token):
                mentions.setdefault(key, []).append(node)
            before = node
        for own in mentions.values():
            self.edges += [(x, y, SKIP) for x, y in zip(own, own[1:], strict=False)]
            seen = next((x for x in own if self.gold[x]), None)
            if seen is not None:
                self.edges += [(min(seen, x), max(seen, x), SKIP) for x in own if not self.gold[x]]

    def hold_out(self, doc: int, text: str, base: list[tuple[int, int, int]], rng: random.Random) -> None:
        """Mentions of base spans in a form that no pattern matches, and unlabelled pairs of the same shape."""

        def node(token: str, label: int, known: int) -> int:
            self.spans.append((doc, -1, -1))
            self.gold.append(label)
            self.feats.append(feature_ids(tuple(shape(token)[:known])))
            return len(self.spans) - 1

        for start, kind, end in base:
            token = text[start:end]
            groups = re.findall("[0-9]+", token)
            groups = groups if len(groups) > 1 else re.findall("[0-9]{1,4}", token)
            forms = [token.split("@")[0]] if kind == 0 else sorted({x.join(groups) for x in ("", "-", ".")} - {token})
            for said in rng.sample(forms, min(2, len(forms))):
                if not set(keys_of(said)) & set(keys_of(token)):
                    continue
                known = rng.choice((1, 4, 99))  # some shapes are hidden, so that links carry to unknown ones
                seen, again = node(token, kind + 1, 99), node(said, kind + 1, known)
                self.hidden.add(again)
                other = re.sub(r"[0-9]", lambda _: rng.choice("0123456789"), re.sub(r"[A-Za-z]", lambda _: rng.choice("abcdefghijklmnopqrstuvwxyz"), said))
                one, two = node(other, 0, known), node(other, 0, known)
                self.edges += [(seen, again, SKIP), (one, two, SKIP)]

    def arrays(self):
        ids = np.array([f for x in self.feats for f in x], np.int64)
        owner = np.repeat(np.arange(len(self.feats)), [len(x) for x in self.feats])
        edges = np.array(sorted(set(self.edges)), np.int64).reshape(-1, 3)
        return ids, owner, np.array(self.gold, np.int64), edges


@lru_cache(1 << 16)
def feature_ids(shapes: tuple[str, ...]) -> list[int]:
    return [int(h) % FEATURES for h in mix(np.array([hash_of(f) for f in shapes], np.uint64))]


def hash_of(s: str) -> int:
    return int.from_bytes(hashlib.blake2b(s.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class Field:
    """Unary weights and one label-by-label table each for chain and skip edges."""

    def __init__(self):
        n = len(KINDS) + 1
        self.unary = np.zeros((FEATURES, n))
        self.pair = np.zeros((2, n, n))

    def scores(self, ids, owner, n: int) -> np.ndarray:
        return np.stack([np.bincount(owner, self.unary[ids, y], minlength=n) for y in range(self.unary.shape[1])], axis=1)

    def fit(self, graph: Graph, steps: int = 600, rate: float = 2.0) -> Field:
        """Pseudo-likelihood: each node given its neighbours' labels; AdaGrad, whole sample."""
        ids, owner, gold, edges = graph.arrays()
        n, k = len(gold), self.unary.shape[1]
        if not n:
            return self
        a, b, kind = edges.T
        one = np.eye(k)
        free = (gold == 0).astype(float)  # base labels are given, so nothing is learned from predicting them
        free[sorted(graph.hidden)] = 1
        su, sp = np.full_like(self.unary, 1e-2), np.full_like(self.pair, 1e-2)
        for _ in range(steps):
            s = self.scores(ids, owner, n)
            np.add.at(s, b, self.pair[kind, gold[a]])
            np.add.at(s, a, self.pair[kind, :, gold[b]])
            p = np.exp(s - s.max(axis=1, keepdims=True))
            diff = (one[gold] - p / p.sum(axis=1, keepdims=True)) * free[:, None]
            g = np.stack([np.bincount(ids, diff[owner, y], minlength=FEATURES) for y in range(k)], axis=1) / n - 1e-5 * self.unary
            gp = np.zeros_like(self.pair)
            np.add.at(gp, (kind, gold[a]), diff[b])
            np.add.at(gp.transpose(0, 2, 1), (kind, gold[b]), diff[a])
            gp[SKIP] += gp[SKIP].T.copy()  # a link has no direction
            gp = gp / n - 1e-6 * self.pair
            su += g * g
            sp += gp * gp
            self.unary += rate * g / np.sqrt(su)
            self.pair += rate * gp / np.sqrt(sp)
        return self

    def beliefs(self, graph: Graph, rounds: int = 1000, settled: float = 1e-4) -> np.ndarray:
        """Loopy message passing over all documents at once; base labels are observed."""
        ids, owner, gold, edges = graph.arrays()
        n, k = len(gold), self.unary.shape[1]
        s = self.scores(ids, owner, n)
        s[gold > 0] -= 1e9 * (1 - np.eye(k)[gold[gold > 0]])  # no number of mentions outvotes them
        source = np.concatenate([edges[:, 0], edges[:, 1]])
        target = np.concatenate([edges[:, 1], edges[:, 0]])
        tables = np.concatenate([self.pair[edges[:, 2]], self.pair[edges[:, 2]].transpose(0, 2, 1)])
        m = np.zeros((len(source), k))
        half = len(edges)
        for _ in range(rounds if half else 0):
            total = s.copy()
            np.add.at(total, target, m)
            out = total[source] - np.concatenate([m[half:], m[:half]])
            x = out[:, :, None] + tables
            top = x.max(axis=1)
            new = top + np.log(np.exp(x - top[:, None, :]).sum(axis=1))
            step = 0.5 * (new - new.max(axis=1, keepdims=True) - m)
            m += step
            if np.abs(step).max() < settled:
                break
        np.add.at(s, target, m)
        p = np.exp(s - s.max(axis=1, keepdims=True))
        return p / p.sum(axis=1, keepdims=True)


def added_spans(field: Field, graph: Graph, base: dict[int, list[tuple[int, int, int]]], sure: float) -> dict[int, list[tuple[int, int, int]]]:
    """Spans of the field outside base spans, by document."""
    out: dict[int, list[tuple[int, int, int]]] = {}
    if not graph.spans:
        return out
    linked = {x for a, b, kind in graph.edges if kind == SKIP for x in (a, b)}
    p = field.beliefs(graph)
    label = p.argmax(axis=1)
    for x in sorted(linked):
        if graph.gold[x] or not label[x] or p[x, label[x]] < sure:
            continue
        doc, start, end = graph.spans[x]
        if not any(a < end and z > start for a, _, z in base.get(doc, ())):
            out.setdefault(doc, []).append((start, int(label[x]) - 1, end))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in sorted(spans))


def find(field: Field, texts: list[str | None], sure: float = 0.8) -> list[tuple[list, list]]:
    """(base, all) spans of each text."""
    graph, base = Graph(), {}
    for d, text in enumerate(texts):
        if text and _TOKEN.search(text):
            base[d] = base_spans(text)
            graph.add(d, text, base[d])
    more = added_spans(field, graph, base, sure)
    return [(base.get(d, []), sorted(base.get(d, []) + more.get(d, []))) for d in range(len(texts))]


def fitted(texts: list[str]) -> Field:
    """The field of some texts, whose base spans are the labels; without any it labels nothing."""
    graph, rng, found = Graph(), random.Random(5), False
    for d, text in enumerate(sorted(texts)):
        base = base_spans(text)
        graph.add(d, text, base)
        graph.hold_out(d, text, base, rng)
        found = found or bool(base)
    return Field().fit(graph) if found else Field()


def train(docs: DataFrame, sample: int = 400) -> Field:
    """Fits on the documents of the ``sample`` smallest hashes among those with a digit or at sign, no more than SAMPLE_CHARS characters of each.

    Tasks send hashes first, and then the chosen texts only; equal rows are one.
    """
    some = docs.where(F.col("text").rlike("[0-9@]")).select(F.xxhash64(F.lit("pii"), F.col("doc_id"), F.col("text")).alias("key"), F.substring("text", 1, SAMPLE_CHARS).alias("text"))
    chosen = [r.key for r in some.select("key").orderBy("key").limit(sample).collect()]
    texts = {r.key: r.text for r in some.where(F.col("key") <= chosen[-1]).dropDuplicates(["key"]).collect()} if chosen else {}
    return fitted(list(texts.values()))


def _mapped(docs: DataFrame, field: Field, keep: list[str], extra: str, columns) -> DataFrame:
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}

    def run(batches):
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            out = {c: batch.column(batch.schema.get_field_index(c)) for c in keep}
            yield pa.RecordBatch.from_pydict(out | columns(texts, find(sent.value, texts)))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), extra])
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(run, schema)


def detect(docs: DataFrame, field: Field, keep: list[str] | None = None) -> DataFrame:
    """The kept columns (all by default) and SPANS."""
    names = [x.split()[0] for x in SPANS.split(", ")]

    def columns(texts, found):
        out = {f"n_{kind}": pa.array([sum(s[1] == k for s in base) for base, _ in found], pa.int64()) for k, kind in enumerate(KINDS)}
        out["base_sha256"] = pa.array([hashlib.sha256(joined(base).encode()).hexdigest() for base, _ in found], pa.string())
        return out | {"spans": pa.array([joined(every) for _, every in found], pa.string())}

    return _mapped(docs, field, [c for c in (docs.columns if keep is None else keep) if c not in names], SPANS, columns)


def mask(docs: DataFrame, field: Field) -> DataFrame:
    """docs with every span of text replaced by its kind in angle brackets; overlapping spans become one."""

    def masked(text, spans):
        if not spans:
            return text
        out, done = [], 0
        for a, k, b in spans:
            if a >= done:
                out += [text[done:a], f"<{KINDS[k].upper()}>"]
            done = max(done, b)
        return "".join(out) + text[done:]

    def columns(texts, found):
        return {"text": pa.array([masked(t, every) for t, (_, every) in zip(texts, found, strict=True)], pa.string())}

    return _mapped(docs, field, [c for c in docs.columns if c != "text"], "text string", columns).select(*docs.columns)
