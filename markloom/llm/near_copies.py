"""SimHash near-duplicates of five-word shingle sets with a Jaccard similarity of LEAST (0.8) or more.

At 0.8 two SimHash fingerprints differ in 15 of 100 bits, too many for blocks
of equal bits, so rows meet over shared shingles: of n shingles under one
common order the first n - ceil(0.8 n) + 1 are a row's keys, and two sets of
0.8 or more share a key.  Any order is right; shingles that a bounded sample
shows to be frequent come last, so that a passage which many documents hold is
seldom a key.  Pairs that meet are discarded when a coordinate of their pivot
distance tables differs by more than RADIUS of 128 bits, then by their Hamming
distance, and what survives is verified on the whole sets.  RADIUS leaves out
about one in 5,000 pairs of exactly 0.8, and fewer above.

Equal sets are one node.  Each of a key's nodes meets one node of that key, the
lead, chosen by a hash of both: a node of many keys meets as many leads, and no
pairs inside a group are formed.  Links that hold make components.  Keys whose
nodes are then still in different components are looked at again: with up to
FEW nodes all of those pairs meet; in larger keys each node meets LEADS nodes of
many links, which are central among near copies.  Larger keys that even then
hold nodes of different components are met whole: cut into CELL shingles by
class of size and by hash, pairs of cuts dealt to tasks, and what is in one
component by then is skipped.  They meet by fingerprints first, and only nodes
with a partner there meet by their sets.  So all links of nodes that share a key
are found; the last step is quadratic in those nodes of a key that nothing
links, and a task holds two cuts.

A bitmap of row keys picks the rows whose sets
or texts are needed; it may pick more, never fewer, so that texts are not dealt.

Edge cases: words are cut and lowered as for op1; fewer words than SHINGLE are
one shingle; null and wordless texts are one group; shingles are told apart by
64-bit hashes; rows are told apart as rows, so null and repeated ids lose none.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ._bits import bitmap, picked
from ._store import dropped, written
from ._text import Words, blobs, mix
from .graph import components
from .simhash_pivot import pivot_table

SHINGLE = 5
#: The least similarity as a fraction, so that it is compared in whole numbers.
LEAST = (4, 5)
SAMPLE, FREQUENT = 4000, 1 << 17
RADIUS = 34
FEW, LEADS = 64, 3
#: Shingles, or fingerprints of so many words each, in a cut of a large key's class of sizes, on average, and pairs compared at once.
CELL, PRINT, AT_ONCE = 1 << 20, 128, 1 << 17
#: Bytes of text whose words are hashed at once; a worker keeps the memory of its largest slice.
SLICE = 1 << 18
_SECOND = np.uint64(0x5851F42D4C957F2D)


def shingle_sets(texts: pa.Array):
    """The sorted distinct shingle hashes of each text."""
    for i, j, blob, offsets in blobs(texts, SLICE):
        w = Words(blob, offsets, lower=True)
        h, _ = w.rolling(SHINGLE)
        for d in range(j - i):
            a, n = int(w.first[d]), int(w.count[d])
            if n >= SHINGLE:
                yield np.unique(h[a : a + n - SHINGLE + 1])
            else:
                own = w.hash[a : a + n].tobytes()
                yield np.array([xxhash.xxh64_intdigest(own, n)] if n else [], np.uint64)


def node_of(own: np.ndarray) -> int:
    return int(np.array([xxhash.xxh64_intdigest(own.tobytes())], np.uint64).view(np.int64)[0]) if len(own) else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return LEAST[1] * both >= LEAST[0] * (len(a) + len(b) - both)


def wide_print(own: np.ndarray) -> tuple[int, int]:
    """SimHash of a set in 128 bits, as two signed numbers; the empty set has none set."""
    if not len(own):
        return 0, 0
    both = np.stack([own, mix(own ^ _SECOND)], axis=1)
    ones = sum(np.unpackbits(part.view(np.uint8).reshape(len(part), 16), axis=1).sum(axis=0, dtype=np.int64) for part in np.split(both, range(1 << 16, len(both), 1 << 16)))
    return tuple(np.packbits(2 * ones > len(own)).view(np.int64).tolist())


def prefix(own: np.ndarray, known: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """The keys of a set: those of its shingles that come first, frequent ones last."""
    n = len(own)
    if not n:
        return own
    at = np.minimum(np.searchsorted(known, own), len(known) - 1)
    often = np.where(known[at] == own, seen[at], 0) if len(known) else np.zeros(n, np.int64)
    return own[np.argsort(often, kind="stable")[: n + LEAST[0] * -n // LEAST[1] + 1]]


def frequent(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted frequent shingles of a bounded sample and their counts; they only shape the order of keys.

    Counted in the tasks, so that no text goes to the driver.
    """
    share = SAMPLE / max(1, rows.count())
    part = F.pmod(F.xxhash64(F.lit("order"), F.col("row")), F.lit(1 << 30)) / float(1 << 30)

    def run(batches):
        for batch in batches:
            found = np.concatenate([np.zeros(0, np.uint64), *shingle_sets(batch.column(0))])
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64))], ["shingle"])

    some = rows.where(part < share).select(F.substring("text", 1, 10000).alias("text")).limit(2 * SAMPLE)
    seen = some.mapInArrow(run, "shingle long").groupBy("shingle").agg(F.count("*").alias("seen")).where("seen > 1")
    top = seen.orderBy(F.desc("seen"), "shingle").limit(FREQUENT).toArrow()
    known, counts = top["shingle"].to_numpy().view(np.uint64), top["seen"].to_numpy()
    order = np.argsort(known)
    return known[order], counts[order]


def row_key(docs: DataFrame):
    """A hash of the whole row, so that rows of one key are interchangeable."""
    return F.xxhash64(*(x for c in docs.columns for x in (F.col(f"`{c}`"), F.col(f"`{c}`").isNull())))


def met(keys: DataFrame) -> DataFrame:
    """(key, node, lead): each node of a key beside the key's lead."""

    def run(batches):
        last = lead = before = None
        for batch in batches:
            key, node = (batch.column(c).to_numpy() for c in range(2))
            if not len(key):
                continue
            new = np.concatenate([[last is None or key[0] != last], key[1:] != key[:-1]])
            head = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
            first = np.where(head >= 0, node[head], 0 if lead is None else lead)
            again = np.concatenate([[not new[0] and node[0] == before], ~new[1:] & (node[1:] == node[:-1])])
            keep = (node != first) & ~again
            last, lead, before = key[-1], first[-1], node[-1]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (key, node, first)], ["key", "node", "lead"])

    return keys.repartition(F.col("key")).sortWithinPartitions("key", F.xxhash64("key", "node"), "node").mapInArrow(run, "key long, node long, lead long")


def possible(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Those (u, v) whose pivot distances differ by RADIUS at most in each coordinate, and then whose fingerprints do."""

    def run(batches):
        for batch in batches:
            a, b, c, d = (batch.column(i).to_numpy().view(np.uint64) for i in (2, 3, 4, 5))
            tables = [(pivot_table(x).astype(np.int16) + pivot_table(y)).sum(axis=1) for x, y in ((a, b), (c, d))]
            keep = np.flatnonzero((np.abs(tables[0] - tables[1]) <= RADIUS).all(axis=1))
            apart = np.bitwise_count(a[keep] ^ c[keep]).astype(np.int64) + np.bitwise_count(b[keep] ^ d[keep])
            keep = pa.array(keep[apart <= RADIUS])
            yield pa.RecordBatch.from_arrays([batch.column(i).take(keep) for i in (0, 1)], ["u", "v"])

    one = nodes.select(F.col("node").alias("u"), F.col("n"), F.col("fp.*")).toDF("u", "n", "a", "b")
    two = nodes.select(F.col("node").alias("v"), F.col("n"), F.col("fp.*")).toDF("v", "m", "c", "d")
    met_pairs = pairs.join(one, "u").join(two, "v").where(near_size("n", "m"))
    return met_pairs.select("u", "v", "a", "b", "c", "d").mapInArrow(run, "u long, v long")


def near_size(a: str, b: str):
    return (LEAST[0] * F.col(a) <= LEAST[1] * F.col(b)) & (LEAST[0] * F.col(b) <= LEAST[1] * F.col(a))


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those (u, v) whose sets are similar."""

    def run(batches):
        for batch in batches:
            a, b = ([np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(c)] for c in (2, 3))
            keep = pa.array([similar(x, y) for x, y in zip(a, b, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(keep) for c in (0, 1)], ["u", "v"])

    one = sets.select(F.col("node").alias("u"), F.col("own").alias("a"))
    two = sets.select(F.col("node").alias("v"), F.col("own").alias("b"))
    return pairs.join(one, "u").join(two, "v").select("u", "v", "a", "b").mapInArrow(run, "u long, v long")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """roots (node, root) after further links (u, v): components of the components that they join."""
    of = lambda end: roots.select(F.col("node").alias(end), F.col("root").alias(f"root_{end}"))
    ends = links.join(of("u"), "u", "left").join(of("v"), "v", "left").select(F.coalesce("root_u", "u").alias("u"), F.coalesce("root_v", "v").alias("v"))
    up = written(components(ends), "roots")
    higher = up.select(F.col("node").alias("root"), F.col("root").alias("higher"))
    return written(roots.join(higher, "root", "left").select("node", F.coalesce("higher", "root").alias("root")).unionByName(up), "roots")


def mixed_keys(members: DataFrame, roots: DataFrame) -> DataFrame:
    """(key, node, root): the members (key, node) of keys that still hold different components."""
    now = members.join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    mixed = now.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high")
    return now.join(mixed.select("key"), "key", "left_semi")


def cells(own: DataFrame, weight) -> DataFrame:
    """(key, class, i, j, side, node, root, n, a, b): own (key, node, root, n, a, b), a written table of keys' members, dealt so that any two of near sizes meet in a cell.

    Sizes of similar sets are in equal or neighbouring classes.  A class is cut
    by hash into as many cuts as the weights of its nodes ask for; each pair of cuts is a
    cell: i and j of one class, or i below and -1 - j of the class above.
    """
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(LEAST[1] / LEAST[0]))).cast("long")
    own = own.withColumn("class", size)
    cuts = own.groupBy("key", "class").agg(F.ceil(F.sum(weight) / F.lit(CELL)).cast("long").alias("cuts"))
    below = cuts.select("key", (F.col("class") + 1).alias("class"), F.col("cuts").alias("below"))
    above = cuts.select("key", (F.col("class") - 1).alias("class"), F.col("cuts").alias("above"))
    known = cuts.join(below, ["key", "class"], "left").join(above, ["key", "class"], "left")
    cut = F.pmod(F.xxhash64("node", "key"), F.col("cuts"))
    dealt = own.join(known, ["key", "class"]).withColumn("cut", cut)
    place = lambda c, i, j, side: F.struct(c.alias("class"), i.alias("i"), j.alias("j"), side.alias("side"))
    upto = lambda n: F.when(n.isNotNull(), F.sequence(F.lit(0).cast("long"), n - 1)).otherwise(F.array().cast("array<bigint>"))
    here, none = F.col("cut"), F.lit(0)
    same = F.transform(upto(F.col("cuts")), lambda x: place(F.col("class"), F.least(here, x), F.greatest(here, x), F.when(here <= x, 0).otherwise(1)))
    lower = F.transform(upto(F.col("above")), lambda x: place(F.col("class"), here, -1 - x, none))
    upper = F.transform(upto(F.col("below")), lambda x: place(F.col("class") - 1, x, -1 - here, none + 1))
    return dealt.select("key", "node", "root", "n", "a", "b", F.explode(F.concat(same, lower, upper)).alias("x")).select("key", "x.*", "node", "root", "n", "a", "b")


def near_prints(table: pa.Table, label: np.ndarray):
    """(x, y) of a cell's nodes with unequal labels and near sizes and fingerprints, nearest first, by and by."""
    side = table["side"].to_numpy()
    n = table["n"].to_numpy()
    a, b = (table[c].to_numpy().view(np.uint64) for c in ("a", "b"))
    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    same = table["i"][0].as_py() == table["j"][0].as_py()
    two = one if same else two
    step = max(1, AT_ONCE // max(1, len(two)))
    for k in range(0, len(one), step):
        part = one[k : k + step]
        far = np.bitwise_count(a[part, None] ^ a[two]) + np.bitwise_count(b[part, None] ^ b[two])
        keep = (far <= RADIUS) & (label[part, None] != label[two])
        keep &= (LEAST[0] * n[part, None] <= LEAST[1] * n[two]) & (LEAST[0] * n[two] <= LEAST[1] * n[part, None])
        if same:
            keep &= part[:, None] < two
        x, y = np.nonzero(keep)
        order = np.argsort(far[x, y], kind="stable")
        yield part[x[order]], two[y[order]]


def _labels(table: pa.Table) -> np.ndarray:
    return np.unique(table["root"].to_numpy(), return_inverse=True)[1]


def with_partners(table: pa.Table) -> pa.Table:
    """(key, node, root, n, a, b) of a cell's nodes with a possible partner there."""
    some = np.zeros(len(table), bool)
    for x, y in near_prints(table, _labels(table)):
        some[x] = some[y] = True
    return table.select(["key", "node", "root", "n", "a", "b"]).filter(pa.array(some))


def met_whole(table: pa.Table) -> pa.Table:
    """(u, v): verified links between different components in a cell, as many as join them."""
    node, label = table["node"].to_numpy(), _labels(table)
    own = [np.frombuffer(x.as_buffer(), np.uint64) for x in table["own"]]
    found = []
    for x, y in near_prints(table, label):
        for u, v in zip(x.tolist(), y.tolist(), strict=True):
            if label[u] != label[v] and similar(own[u], own[v]):
                label[label == label[v]] = label[u]
                found.append((node[u], node[v]))
    u, v = np.array(found, np.int64).reshape(-1, 2).T
    return pa.table({"u": np.minimum(u, v), "v": np.maximum(u, v)})


def copies(docs: DataFrame) -> DataFrame:
    """(row, kept): row_key of each row that has company, by near or equal texts, and whether it is the one that stays.

    That is the row with the smallest doc_id, null ids last.
    """
    spark = docs.sparkSession
    rows = docs.select(row_key(docs).alias("row"), "doc_id", "text")
    order = spark.sparkContext.broadcast(frequent(rows))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def shingled(batches):
        done = set()
        for batch in batches:
            node, n, fp, keys = [], [], [], []
            for own in shingle_sets(batch.column(2)):
                node.append(node_of(own))
                n.append(len(own))
                fp.append(wide_print(own))
                keys.append(None if node[-1] in done else prefix(own, *order.value).tobytes())
                done.add(node[-1])
            fp = pa.StructArray.from_arrays([pa.array([f[i] for f in fp], pa.int64()) for i in (0, 1)], ["x", "y"])
            more = [pa.array(node, pa.int64()), pa.array(n, pa.int64()), fp, pa.array(keys, pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *more], ["row", "doc_id", "node", "n", "fp", "keys"])

    def dealt(batches):
        for batch in batches:
            keys = [np.frombuffer(k.as_buffer(), np.int64) for k in batch.column(1)]
            node = np.repeat(batch.column(0).to_numpy(), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *keys])), pa.array(node)], ["key", "node"])

    def needed(nodes: DataFrame) -> DataFrame:
        """(node, own) of the nodes."""
        bits = spark.sparkContext.broadcast(bitmap(least.join(nodes, "node", "left_semi").select(F.col("best.row").alias("row"))))

        def whole(batches):
            for batch in batches:
                own = list(shingle_sets(batch.column(1).filter(pa.array(picked(bits.value, batch.column(0).to_numpy())))))
                yield pa.RecordBatch.from_arrays([pa.array([node_of(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["node", "own"])

        return written(rows.select("row", "text").mapInArrow(whole, "node long, own binary").join(nodes, "node", "left_semi").dropDuplicates(["node"]), "sets")

    def links_of(pairs: DataFrame) -> DataFrame:
        some = written(possible(pairs, least.select("node", "n", "fp")), "possible")
        ends = some.select(F.col("u").alias("node")).unionByName(some.select(F.col("v").alias("node"))).distinct()
        return written(verified(some, needed(ends)), "links")

    table = written(rows.mapInArrow(shingled, f"row long, doc_id {kind}, node long, n long, fp struct<x: long, y: long>, keys binary"), "shingled")
    best = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row"))
    least = written(table.groupBy("node").agg(best.alias("best"), F.min("n").alias("n"), F.min("fp").alias("fp")), "nodes")
    of = written(table.select("row", "node"), "rows")
    met_keys = written(met(table.where("keys is not null").select("node", "keys").mapInArrow(dealt, "key long, node long")), "met")
    for path in {p.rsplit("/", 1)[0] for p in table.inputFiles()}:
        dropped(spark, path)

    links = links_of(met_keys.select(F.least("lead", "node").alias("u"), F.greatest("lead", "node").alias("v")).distinct())
    roots = written(components(links), "roots")
    degree = links.select(F.col("u").alias("node")).unionByName(links.select(F.col("v").alias("node"))).groupBy("node").agg(F.count("*").alias("links"))
    every = met_keys.select("key", "node").unionByName(met_keys.select("key", F.col("lead").alias("node")).distinct())
    every = every.join(roots.join(degree, "node"), "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"), F.coalesce("links", F.lit(0)).alias("links"))
    central = F.ceil(F.log2(F.col("links") + 1))
    leads = [F.max(F.struct(central.alias("rank"), F.xxhash64("node", F.lit(i)).alias("hash"), "node", "root")).alias(f"lead{i}") for i in range(LEADS)]
    mixed = every.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size"), *leads).where("low < high")
    members = written(every.join(mixed.select("key", "size", F.array(*(F.struct(f"lead{i}.node", f"lead{i}.root") for i in range(LEADS))).alias("leads")), "key"), "members")
    few = members.where(F.col("size") <= FEW).select("key", "node", "root")
    other = few.select("key", F.col("node").alias("v"), F.col("root").alias("root_v"))
    near = few.join(other, "key").where("root < root_v").select("node", "v")
    many = members.where(F.col("size") > FEW).select("node", "root", F.explode("leads").alias("lead")).where("root <> lead.root").select("node", F.col("lead.node").alias("v"))
    more = links_of(near.unionByName(many).select(F.least("node", "v").alias("u"), F.greatest("node", "v").alias("v")).distinct())
    if not more.isEmpty():
        roots = merged(roots, more)
    prints = least.select("node", "n", F.col("fp.x").alias("a"), F.col("fp.y").alias("b"))
    rest = written(mixed_keys(members.where(F.col("size") > FEW).select("key", "node"), roots).join(prints, "node"), "mixed")
    near = written(cells(rest, F.lit(PRINT)).groupBy("key", "class", "i", "j").applyInArrow(with_partners, "key long, node long, root long, n long, a long, b long").distinct(), "partners")
    if not near.isEmpty():
        met_cells = cells(near, F.col("n")).join(needed(near.select("node").distinct()), "node")
        whole = written(met_cells.groupBy("key", "class", "i", "j").applyInArrow(met_whole, "u long, v long").distinct(), "links")
        if not whole.isEmpty():
            roots = merged(roots, whole)
    named = of.join(roots, "node", "left").select("row", "node", F.coalesce("root", "node").alias("root"))
    first = least.join(roots, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("best").alias("best"))
    size = named.groupBy("root").agg(F.count("*").alias("size")).where("size > 1")
    first = size.join(first, "root").select("root", F.col("best.row").alias("stays"))
    return written(named.join(first, "root").select("row", (F.col("row") == F.col("stays")).alias("kept")).distinct(), "copies")


def deduplicated(docs: DataFrame) -> DataFrame:
    """docs with one row of each group; rows that are equal in all columns are copies."""
    found = copies(docs)
    bits = docs.sparkSession.sparkContext.broadcast(bitmap(found.select("row")))
    keyed = docs.select(F.struct(*(f"`{c}`" for c in docs.columns)).alias("doc"), row_key(docs).alias("row"), F.lit(False).alias("near"))

    def mark(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(picked(bits.value, batch.column(1).to_numpy()))], names=batch.schema.names)

    marked = keyed.mapInArrow(mark, keyed.schema)
    alone = marked.where("not near")
    gone = found.where("not kept").select("row")
    rest = marked.where("near").join(gone, "row", "left_anti").dropDuplicates(["row"])
    return alone.select("doc.*").unionByName(rest.select("doc.*"))
