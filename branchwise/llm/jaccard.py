"""N-gram Jaccard join: a blocked product of the sparse document by n-gram incidence matrix.

Documents link when the Jaccard similarity of their sets of word n-grams is at least ``least`` percent. Equal sets are one
row of the matrix. Columns are ordered by how often they occur over all documents (a counting table of fixed size; ties
and mixed-up counts only change the order), rarest first, and the product runs in two parts:

* Head. A link needs an overlap that follows from the two sizes, so it must begin inside the first few columns of both
  rows. Only those columns are joined. First each column compares its rows with one hub, that with the most neighbours;
  links found there make components. Then columns that hold several components are multiplied in blocks of bounded size,
  and only pairs of different components leave a block. Overlaps of a pair add up over the columns, and a pair goes when
  its overlap so far and all that may follow stay below what its sizes ask for. Parity bitmaps bound the overlap too:
  each bit in which two bitmaps differ is at least one n-gram that only one of them has.
* Tail. What is left is multiplied in full: the exact overlap of the two sets decides.

So a family of near copies costs links to its hub and not all its pairs, and no link between different components is
lost. N-grams are compared by 64-bit hashes of their bytes.

Cases: null text is empty; a text without words has an empty set and links with nothing, its component is its own id; a
text with fewer words than n is one n-gram; rows with one id are documents of their own; a null id takes part but never
names a component that holds an id; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import SubstringHash, slices, two_columns, utf8
from branchwise.llm.graph import components
from branchwise.session import stored

WORDS, LEAST, COUNT_BITS, CHUNK, BLOCK, SALTS, FILTER_BITS = 3, 90, 20, 1 << 14, 256, 8, 23
ROWS = "doc_id long, k1 long, k2 long, n int, bits binary"


def ngrams(data: bytes, hasher: SubstringHash, words: int) -> np.ndarray:
    """Sorted distinct hashes of the word n-grams of a UTF-8 text, A-Z lower-cased."""
    parts = data.lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    raw = np.frombuffer(b" ".join(parts), np.uint8)
    gaps = np.flatnonzero(raw == 32)
    starts, ends = np.concatenate([[0], gaps + 1]), np.append(gaps, len(raw))
    w = min(words, len(parts))
    return np.unique(hasher.hashes(hasher.sums(raw), starts[: len(starts) - w + 1], ends[w - 1 :]))


def set_name(h: np.ndarray) -> tuple[int, int]:
    """128 bits that name a set."""
    with np.errstate(over="ignore"):
        a, b = (h * np.uint64(0x9E3779B97F4A7C15)), ((h ^ (h >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F))
        a, b = a ^ (a >> np.uint64(32)), b ^ (b >> np.uint64(31))
        return int((a * a).sum().view(np.int64)), int((b * b + b).sum().view(np.int64))


def parity(h: np.ndarray) -> bytes:
    """A bitmap in which every n-gram flips one bit, half as many bits as n-grams or a little more."""
    width = max(64, 1 << max(0, (len(h) - 1).bit_length() - 1))
    return np.packbits(np.bincount((h & np.uint64(width - 1)).astype(np.int64), minlength=width).astype(np.uint8) & 1).tobytes()


def need(a: int, b: int, least: int) -> int:
    """The overlap that sets of sizes a and b need."""
    return -(-least * (a + b) // (100 + least))


def may_link(a: bytes, b: bytes, n: int, m: int, least: int) -> bool:
    """Whether bitmaps allow the overlap that sizes n and m need."""
    if len(a) < len(b):
        a, b = b, a
    while len(a) > len(b):
        half = len(a) // 2
        a = (int.from_bytes(a[:half]) ^ int.from_bytes(a[half:])).to_bytes(half)
    apart = (int.from_bytes(a) ^ int.from_bytes(b)).bit_count()
    return (n + m - apart) // 2 >= need(n, m, least)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    return int((b[np.minimum(at, len(b) - 1)] == a).sum())


def _batch(rows: list, schema: str):
    import pyarrow as pa

    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [c.split() for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(zip(*rows), fields)], [name for name, _ in fields])


def _sets(docs: DataFrame, words: int) -> DataFrame:
    """One row per document, and at the end of each task one row (n = -1) with its counts of n-grams by hash bucket."""

    def run(batches):
        hasher, counts = SubstringHash(31), np.zeros(1 << COUNT_BITS, np.int64)
        shift = np.uint64(64 - COUNT_BITS)
        for b in slices(batches):
            out, seen = [], []
            for doc_id, data in zip(b.column(0).to_pylist(), utf8(b.column(1))):
                h = ngrams(data, hasher, words)
                out.append((doc_id, *(set_name(h) if len(h) else (0, 0)), len(h), parity(h) if len(h) else None))
                seen.append(h >> shift)
            yield _batch(out, ROWS)
            counts += np.bincount(np.concatenate(seen).astype(np.int64), minlength=len(counts))
        if counts.any():
            for c in range(0, len(counts), CHUNK):
                yield _batch([(None, c, 0, -1, zlib.compress(counts[c : c + CHUNK].tobytes(), 1))], ROWS)

    return stored(docs.mapInArrow(run, ROWS), "jaccard-rows")


def _counts(rows: DataFrame) -> np.ndarray:
    """The counting table over all documents: each chunk added up by one task, 2**COUNT_BITS numbers at the driver."""

    def run(batches):
        first, total = None, None
        for b in batches:
            for c, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if c != first:
                    if first is not None:
                        yield _batch([(first, total.tobytes())], "chunk long, total binary")
                    first, total = c, np.zeros(CHUNK, np.int64)
                total += np.frombuffer(zlib.decompress(data), np.int64)
        if first is not None:
            yield _batch([(first, total.tobytes())], "chunk long, total binary")

    parts = rows.where("n = -1").select("k1", "bits").repartition("k1").sortWithinPartitions("k1")
    out = np.zeros(1 << COUNT_BITS, np.int64)
    for r in parts.mapInArrow(run, "chunk long, total binary").collect():
        out[r["chunk"] : r["chunk"] + CHUNK] = np.frombuffer(r["total"], np.int64)
    return out


def _head(docs: DataFrame, counts: np.ndarray, words: int, least: int) -> DataFrame:
    """(gram, pos, k1, k2, n): the columns of each row in which a link must begin, rarest first."""
    import pyarrow as pa

    order = counts.astype(np.float32)
    shift = np.uint64(64 - COUNT_BITS)

    def run(batches):
        hasher, met = SubstringHash(31), set()
        for b in slices(batches):
            got = []
            for data in utf8(b.column(0)):
                h = ngrams(data, hasher, words)
                if not len(h):
                    continue
                name = set_name(h)
                if name in met:  # copies of a set within a task come once; the set of names is bounded
                    continue
                if len(met) < 1 << 17:
                    met.add(name)
                size = len(h) - -(-least * len(h) // 100) + 1
                first = h[np.lexsort((h, order[(h >> shift).astype(np.int64)]))[:size]]
                got.append((first.view(np.int64), *name, len(h)))
            if got:
                k = [len(g[0]) for g in got]
                cols = [np.concatenate([g[0] for g in got]), np.concatenate([np.arange(x, dtype=np.int32) for x in k])]
                cols += [np.repeat(np.array([g[i] for g in got], t), k) for i, t in ((1, np.int64), (2, np.int64), (3, np.int32))]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["gram", "pos", "k1", "k2", "n"])

    return stored(docs.select("text").mapInArrow(run, "gram long, pos int, k1 long, k2 long, n int"), "jaccard-head")


def _possible(n, pos, m, pos2, least: int):
    """Whether rows of sizes n and m that meet at these places, and not before, can have the overlap they need."""
    small, large = F.least(n, m), F.greatest(n, m)
    rest = F.least(n - pos, m - pos2)
    return (100 * small >= least * large) & (rest * (100 + least) >= least * (n + m))


def _by_bitmap(pairs: DataFrame, classes: DataFrame, least: int) -> DataFrame:
    """The (a, b) pairs that bitmaps do not rule out."""
    side = lambda x: classes.select(F.col("cid").alias(x), F.col("n").alias(f"n{x}"), F.col("bits").alias(f"bits{x}"))

    def run(batches):
        for b in slices(batches, 4096):
            out = [r[:2] for r in zip(*[c.to_pylist() for c in b.columns]) if may_link(r[4], r[5], r[2], r[3], least)]
            if out:
                yield _batch(out, "a long, b long")

    wide = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "bitsa", "bitsb")
    return stored(wide.mapInArrow(run, "a long, b long"), "jaccard-pairs")


def _fetched(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int) -> DataFrame:
    """(cid, grams): the sets of all classes that occur in pairs, made again from their documents' texts.

    A table of 2**FILTER_BITS bits tells which ids may be asked for, so most texts are passed over; with more ids than
    bits it passes over fewer, and the join decides in any case.
    """
    import pyarrow as pa

    asked = pairs.select(F.col("a").alias("cid")).union(pairs.select("b")).distinct()
    asked = stored(classes.join(asked, "cid").select("cid", "k1", "k2", "first_id"), "jaccard-asked")
    slot = F.pmod(F.xxhash64(F.coalesce("first_id", F.lit(0))), F.lit(1 << FILTER_BITS))
    words64 = asked.select(slot.alias("s")).select(F.shiftright("s", 6).alias("w"), F.expr("shiftleft(1L, int(s % 64))").alias("bit"))
    table = np.zeros(1 << (FILTER_BITS - 6), np.int64)
    for r in words64.groupBy("w").agg(F.bit_or("bit").alias("bits")).collect():
        table[r["w"]] = r["bits"]
    bits = table.view(np.uint64)

    def run(batches):
        hasher = SubstringHash(31)
        for b in slices(batches, 2000):
            s = b.column(0).to_numpy().astype(np.uint64)
            hit = (bits[(s >> np.uint64(6)).astype(np.int64)] >> (s & np.uint64(63))) & np.uint64(1)
            for part in slices([b.filter(pa.array(hit.astype(bool)))], 200):
                out = []
                for data in utf8(part.column(1)):
                    h = ngrams(data, hasher, words)
                    if len(h):
                        out.append((*set_name(h), h.tobytes()))
                if out:
                    yield _batch(out, "k1 long, k2 long, grams binary")

    slot = F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0))), F.lit(1 << FILTER_BITS))
    sets = docs.select(slot.alias("s"), "text").mapInArrow(run, "k1 long, k2 long, grams binary")
    got = sets.join(asked.select("k1", "k2", "cid"), ["k1", "k2"]).select("cid", "grams")
    return stored(got, "jaccard-sets").dropDuplicates(["cid"])


def _links(docs: DataFrame, classes: DataFrame, pairs: DataFrame, words: int, least: int) -> DataFrame:
    """The (a, b) pairs that link: each b's set meets the set of its a. A large a comes in several parts."""
    if pairs.isEmpty():
        return pairs
    sets = stored(_fetched(docs, classes, pairs, words), "jaccard-fetched")
    salted = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    hubs = salted.select("a", "salt").distinct().join(sets, F.col("a") == F.col("cid"))
    members = salted.join(sets, F.col("b") == F.col("cid"))
    both = hubs.select("a", "salt", F.lit(0).alias("part"), F.col("a").alias("b"), "grams").union(
        members.select("a", "salt", F.lit(1).alias("part"), "b", "grams")
    )

    def run(batches):
        hub = None
        for batch in slices(batches, 1000):
            out = []
            for a, _, part, b, grams in zip(*[c.to_pylist() for c in batch.columns]):
                h = np.frombuffer(grams, np.uint64)
                if not part:
                    hub = h
                elif overlap(hub, h) >= need(len(hub), len(h), least):
                    out.append((a, b))
            if out:
                yield _batch(out, "a long, b long")

    placed = both.repartition("a", "salt").sortWithinPartitions("a", "salt", "part")
    return stored(placed.mapInArrow(run, "a long, b long"), "jaccard-links")


def _star(cells: DataFrame, least: int) -> DataFrame:
    """(a, b): hub and row of each column, where sizes and places allow a link. The hub has the most neighbours."""
    columns = cells.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"))
    weight = cells.join(columns, "gram").groupBy("cid").agg(F.sum("rows").alias("weight"))
    weighed = stored(cells.join(weight, "cid"), "jaccard-weighed")
    hub = weighed.groupBy("gram").agg(F.max(F.struct("weight", "cid", "n", "pos")).alias("hub"))
    met = weighed.join(stored(hub, "jaccard-hubs"), "gram").where(F.col("cid") != F.col("hub.cid"))
    fine = _possible(F.col("n"), F.col("pos"), F.col("hub.n"), F.col("hub.pos"), least)
    return met.where(fine).select(F.col("hub.cid").alias("a"), F.col("cid").alias("b")).distinct()


def _product(cells: DataFrame, classes: DataFrame, label: DataFrame, least: int) -> DataFrame:
    """(a, b) of different components that the head of the product leaves."""
    seen = cells.join(label, "cid", "left").withColumn("comp", F.coalesce("component", "cid")).drop("component")
    seen = stored(seen, "jaccard-labelled")
    mixed = seen.groupBy("gram").agg(F.count(F.lit(1)).alias("rows"), F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y")
    wide = seen.join(stored(mixed.select("gram", "rows"), "jaccard-mixed"), "gram").join(classes.select("cid", "bits"), "cid")
    # A column of many rows is cut into parts, and every two parts meet in a block of their own.
    parts = F.ceil(F.col("rows") / BLOCK).cast("int")
    wide = wide.withColumn("mine", F.pmod(F.xxhash64("cid"), parts).cast("int"))
    wide = wide.withColumn("other", F.explode(F.sequence(F.lit(0), parts - 1)))
    block = [F.least("mine", "other").alias("low"), F.greatest("mine", "other").alias("high")]
    wide = wide.select("gram", *block, "mine", "cid", "comp", "n", "pos", "bits")
    schema = "a long, b long, last_a int, last_b int, na int, nb int"

    def pairs(rows):
        """Pairs of a block: sizes first, then places, then bitmaps."""
        rows.sort(key=lambda r: (r[6], r[4]))  # by size
        n = np.array([r[6] for r in rows], np.int64)
        upto = np.searchsorted(n, n * 100 // least, "right")
        cross = rows[0][1] != rows[0][2]
        for i, x in enumerate(rows):
            if x[7] > x[6] - need(x[6], x[6], least):  # the smaller row of a pair must begin here
                continue
            for j in range(i + 1, int(upto[i])):
                y = rows[j]
                if x[5] == y[5] or (cross and x[3] == y[3]):
                    continue
                if min(x[6] - x[7], y[6] - y[7]) < need(x[6], y[6], least) or not may_link(x[8], y[8], x[6], y[6], least):
                    continue
                yield (x[4], y[4], x[7], y[7], x[6], y[6]) if x[4] < y[4] else (y[4], x[4], y[7], x[7], y[6], x[6])

    def run(batches):
        held, out = [], []
        for b in slices(batches, 2000):
            for r in zip(*[c.to_pylist() for c in b.columns]):
                if held and held[0][:3] != r[:3]:
                    out += pairs(held)
                    held = []
                    if len(out) > 20_000:
                        yield _batch(out, schema)
                        out = []
                held.append(r)
        if held:
            out += pairs(held)
        if out:
            yield _batch(out, schema)

    placed = wide.repartition("gram", "low", "high").sortWithinPartitions("gram", "low", "high")
    met = placed.mapInArrow(run, schema).groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("met"), F.max("last_a").alias("pa"), F.max("last_b").alias("pb"))
    after = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb")) - 1
    return stored(met.where((F.col("met") + after) * (100 + least) >= least * (F.col("na") + F.col("nb"))).select("a", "b"), "jaccard-left")


def joined(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, least: int = LEAST) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row; the component is named by its smallest doc_id."""
    docs = two_columns(docs, id_col, text_col)
    rows = _sets(docs, words)
    head = _head(docs, _counts(rows), words, least)
    classes = rows.where("n > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("first_id"), F.first("n").alias("n"), F.first("bits").alias("bits")
    )
    classes = stored(classes.withColumn("cid", F.monotonically_increasing_id()), "jaccard-classes")
    often = head.groupBy("gram").agg(F.count(F.lit(1)).alias("rows")).where("rows > 1").select("gram")
    shared = head.join(stored(often, "jaccard-often"), "gram").join(classes.select("k1", "k2", "cid"), ["k1", "k2"])
    cells = stored(shared.select("gram", "cid", "n", "pos").distinct(), "jaccard-cells")
    first = _links(docs, classes, _by_bitmap(_star(cells, least), classes, least), words, least)
    label = stored(components(first).withColumnRenamed("node", "cid"), "jaccard-first")
    rest = _links(docs, classes, _product(cells, classes, label, least), words, least)
    if not rest.isEmpty():
        label = stored(components(first.union(rest)).withColumnRenamed("node", "cid"), "jaccard-all")
    named = classes.select("k1", "k2", "cid", "first_id").join(label, "cid", "left").withColumn("comp", F.coalesce("component", "cid"))
    named = stored(named.select("k1", "k2", "comp", "first_id"), "jaccard-named")
    least_id = stored(named.groupBy("comp").agg(F.min("first_id").alias("component_id")), "jaccard-least")
    names = stored(named.join(least_id, "comp").select("k1", "k2", "component_id"), "jaccard-names")
    full = rows.where("n > 0").join(names, ["k1", "k2"]).select("doc_id", F.col("n").cast("long").alias("n_shingles"), "component_id")
    empty = rows.where("n = 0").select("doc_id", F.lit(0).cast("long").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return full.unionByName(empty)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS MATERIALIZED (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {WORDS} THEN [array_to_string(w, ' ')]
                     ELSE list_transform(range(1, len(w) - {WORDS - 2}), lambda i: array_to_string(w[i:i + {WORDS - 1}], ' ')) END) AS s FROM w),
e AS MATERIALIZED (SELECT doc_id, len(s) AS n, hash(unnest(s)) AS gram FROM g),
half AS (SELECT a.doc_id AS a, b.doc_id AS b FROM e a JOIN e b ON a.gram = b.gram AND a.doc_id < b.doc_id
           AND 100 * least(a.n, b.n) >= {LEAST} * greatest(a.n, b.n)
         GROUP BY ALL HAVING 100 * count(*) >= {LEAST} * (any_value(a.n) + any_value(b.n) - count(*))),
links AS MATERIALIZED (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reach(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.a, links.b FROM reach JOIN links ON links.a = reach.b)
SELECT g.doc_id, len(g.s)::BIGINT AS n_shingles, r.component_id
FROM g JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) r ON r.a = g.doc_id
"""
