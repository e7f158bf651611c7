"""SimHash near-duplicates by a generalised pigeonhole search.

64-bit fingerprints within ``radius`` bits are linked. The bits are cut into m partitions of correlated bits. If the
thresholds t_i of a query satisfy sum(t_i + 1) = radius + 1, every fingerprint within the radius is within t_i of the
query in some partition i. Each query gets its own thresholds, by dynamic programming over the partitions on estimated
candidate counts plus the probes needed, so a partition in which its value is common can be left out (t_i = -1). A
query probes the exact partition values within t_i of its own; candidates are verified on all 64 bits inside the join.

Rows with the same fingerprint are one node. Before probing, the members of each exact partition value that are within
the radius of its most frequent fingerprint are linked to it, and the probe join then only returns pairs not yet in one
component. A dense family of near copies thus gives as many links as members, not a link for each pair.

Cases: null text is empty; no words give fingerprint zero, linked like any other; rows with a null id get the component
of their fingerprint; repeated rows share a node; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import slices, two_columns, utf8, whole_rows
from branchwise.llm.graph import components
from branchwise.session import stored

BITS, WORDS, SEED, RADIUS = 64, 4, 42, 4
PROBE_COST, CANDIDATE_COST = 1.0, 0.02


def fingerprint(data: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """Bit i is 1 when set in over half the shingles' XXH64 values; ``data`` is UTF-8 text."""
    from xxhash import xxh64_intdigest

    parts = data.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    ends = np.append(np.flatnonzero(np.frombuffer(joined, np.uint8) == 32), len(joined))
    starts = np.concatenate([[0], ends[:-1] + 1])
    w = min(words, len(parts))
    s, e = starts[: len(starts) - w + 1].tolist(), ends[w - 1 :].tolist()
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(s), 8192):
        h = [xxh64_intdigest(joined[x:y], seed) for x, y in zip(s[i : i + 8192], e[i : i + 8192])]
        bits = np.unpackbits(np.array(h, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > len(s)).tolist()))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sha: bool = False) -> DataFrame:
    """(doc_id, fp): fingerprints as signed longs; with ``sha`` also the SHA-256 of the text."""
    import pyarrow as pa

    def run(batches):
        for b in slices(batches):
            fp = np.array([fingerprint(t) for t in utf8(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp), *b.columns[2:]], ["doc_id", "fp", *b.schema.names[2:]])

    rows = two_columns(docs, id_col, text_col)
    if sha:
        return rows.withColumn("sha", F.sha2("text", 256)).mapInArrow(run, "doc_id long, fp long, sha string")
    return rows.mapInArrow(run, "doc_id long, fp long")


def _ball(width: int, t: int) -> list[int]:
    """All masks of at most t of ``width`` bits."""
    return [sum(1 << i for i in c) for d in range(t + 1) for c in itertools.combinations(range(width), d)]


def _ball_size(width: int, t: int) -> int:
    from math import comb

    return sum(comb(width, d) for d in range(t + 1))


def _units(probe: list[list[float]], units: int) -> float:
    """Least total when ``units`` are dealt to partitions; probe[i][u] is what u units cost in partition i."""
    best = [0.0] + [float("inf")] * units
    for row in probe:
        best = [min(best[b - u] + row[u] for u in range(b + 1)) for b in range(units + 1)]
    return best[units]


def partition_count(n: int, radius: int = RADIUS) -> int:
    """How many partitions make probes and candidates cheapest for n fingerprints, were bits independent."""

    def cost(m: int) -> float:
        rows = []
        for i in range(m):
            w = BITS // m + (i < BITS % m)
            rows.append([0.0] + [_ball_size(w, u - 1) * (PROBE_COST + CANDIDATE_COST * n / 2**w) for u in range(1, radius + 2)])
        return m + _units(rows, radius + 1)

    return min(range(2, radius + 2), key=cost)


def bit_groups(together: np.ndarray, n: int, m: int) -> list[list[int]]:
    """Bits in m groups, each grown from its most correlated pair by the bit most correlated with the group."""
    p = np.diag(together) / max(n, 1)
    sd = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs(together / max(n, 1) - np.outer(p, p)) / np.outer(sd, sd)
    np.fill_diagonal(corr, 0)
    left, out = list(range(BITS)), []
    for i in range(m):
        width = BITS // m + (i < BITS % m)
        sub = corr[np.ix_(left, left)]
        a, b = divmod(int(sub.argmax()), len(left))
        group = [left[a]] if a == b else [left[a], left[b]]
        while len(group) < width:
            rest = [x for x in left if x not in group]
            group.append(rest[int(corr[np.ix_(rest, group)].sum(axis=1).argmax())])
        left = [x for x in left if x not in group]
        out.append(sorted(group))
    return out


def _value(fp: np.ndarray, bits: list[int]) -> np.ndarray:
    v = np.zeros(len(fp), np.uint64)
    for i, b in enumerate(bits):
        v |= ((fp >> np.uint64(b)) & np.uint64(1)) << np.uint64(i)
    return v


def _summed(nodes: DataFrame, cells: int, add) -> np.ndarray:
    """Sums of ``cells`` numbers (a fixed few thousand) that ``add(array, fps)`` makes of batches of fingerprints."""
    import pyarrow as pa

    def run(batches):
        total = np.zeros(cells, np.int64)
        for b in slices(batches, 4096):
            add(total, b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["cell", "n"])

    rows = nodes.select("fp").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(cells, np.int64)
    for r in rows:
        out[r["cell"]] = r["n"]
    return out


class Plan:
    """Partitions, and the estimates by which queries choose their thresholds."""

    SUB = 11

    def __init__(self, nodes: DataFrame, n: int, radius: int):
        self.n, self.radius = n, radius

        def pairs(total, fp):
            x = ((fp[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float64)
            total += (x.T @ x).astype(np.int64).ravel()

        self.groups = bit_groups(_summed(nodes, BITS * BITS, pairs).reshape(BITS, BITS), n, partition_count(n, radius))
        # Each partition in pieces of at most SUB bits: exact counts by value and distance, joined as if independent.
        self.pieces = [[g[i : i + self.SUB] for i in range(0, len(g), self.SUB)] for g in self.groups]
        flat = [p for ps in self.pieces for p in ps]
        size = 1 << self.SUB

        def values(total, fp):
            for i, p in enumerate(flat):
                total[i * size : (i + 1) * size] += np.bincount(_value(fp, p).astype(np.int64), minlength=size)

        hist = _summed(nodes, len(flat) * size, values).reshape(len(flat), size)
        dist = np.array([bin(i).count("1") for i in range(size)])
        near, at = [], 0
        xor = np.arange(size)[:, None] ^ np.arange(size)[None, :]
        for ps in self.pieces:
            tables = []
            for p in ps:
                h, w = hist[at][: 1 << len(p)].astype(np.float64), 1 << len(p)
                d = dist[xor[:w, :w]]
                tables.append(np.stack([(h[None, :] * (d == k)).sum(axis=1) for k in range(radius + 1)], axis=1))
                at += 1
            near.append(tables)
        self.near = near

    def estimates(self, fp: np.ndarray) -> list[np.ndarray]:
        """Per partition: (fingerprints, distance 0..radius) expected counts of fingerprints within that distance."""
        out = []
        for ps, tables in zip(self.pieces, self.near):
            total = None
            for p, t in zip(ps, tables):
                own = t[_value(fp, p).astype(np.int64)]
                if total is None:
                    total = own
                else:
                    total = np.stack([sum(total[:, i] * own[:, d - i] for i in range(d + 1)) for d in range(self.radius + 1)], axis=1) / max(self.n, 1)
            out.append(np.cumsum(total, axis=1))
        return out

    def thresholds(self, fp: np.ndarray) -> np.ndarray:
        """(fingerprints, partitions) thresholds, -1 where a partition is left out; t + 1 sums to radius + 1."""
        units, n = self.radius + 1, len(fp)
        best = np.full((n, units + 1), np.inf)
        best[:, 0] = 0
        choice = []
        for g, near in zip(self.groups, self.estimates(fp)):
            cost = np.zeros((n, units + 1))
            for u in range(1, units + 1):
                cost[:, u] = PROBE_COST * _ball_size(len(g), u - 1) + CANDIDATE_COST * near[:, u - 1]
            opts = np.stack([np.stack([best[:, b - u] + cost[:, u] if u <= b else np.full(n, np.inf) for u in range(units + 1)]) for b in range(units + 1)])
            choice.append(opts.argmin(axis=1).T)  # (n, b)
            best = opts.min(axis=1).T
        out = np.zeros((n, len(self.groups)), np.int64)
        left = np.full(n, units)
        for i in range(len(self.groups) - 1, -1, -1):
            u = choice[i][np.arange(n), left]
            out[:, i], left = u - 1, left - u
        return out


def _keys(part: int, value: np.ndarray) -> np.ndarray:
    return (np.uint64(part) << np.uint64(40) | value).view(np.int64)


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of every row; the component is named by its smallest doc_id."""
    rows = stored(fingerprints(docs, id_col, text_col), "simhash-rows")
    return rows.join(stored(_named(rows, radius), "simhash-named"), "fp").select("doc_id", "fp", "component_id")


def _named(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, component, component_id) of every fingerprint; ``component`` is a fingerprint of its own component, so it
    tells components apart that share their smallest doc_id or have none."""
    nodes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("copies")), "simhash-nodes")
    n = nodes.count()
    if not n:
        return nodes.select("fp", F.col("fp").alias("component"), F.col("first_id").alias("component_id"))
    label = _labels(nodes, n, radius)
    joined = nodes.join(label.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    # Written tables on both sides: Spark can then split the rows of a large component over tasks.
    joined = stored(joined.select("fp", "component", "first_id"), "simhash-joined")
    least = stored(joined.groupBy("component").agg(F.min("first_id").alias("component_id")), "simhash-least")
    return joined.join(least, "component").select("fp", "component", "component_id")


def _labels(nodes: DataFrame, n: int, radius: int) -> DataFrame:
    """(node, component) over fingerprints that have a link."""
    import pyarrow as pa

    plan = Plan(nodes, n, radius)
    groups = plan.groups

    def index(batches):
        for b in slices(batches, 8192):
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            key = np.concatenate([_keys(i, _value(fp, g)) for i, g in enumerate(groups)])
            again = [pa.concat_arrays([c] * len(groups)) for c in b.columns]
            yield pa.RecordBatch.from_arrays([pa.array(key), *again], ["key", "fp", "extra"])

    def probes(batches):
        masks: dict = {}
        for b in slices(batches, 4096):
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            comp = b.column(1).to_numpy(zero_copy_only=False)
            t = plan.thresholds(fp)
            for i, g in enumerate(groups):
                value = _value(fp, g)
                for level in np.unique(t[:, i][t[:, i] >= 0]).tolist():
                    m = masks.setdefault((len(g), level), np.array(_ball(len(g), level), np.uint64))
                    rows = np.flatnonzero(t[:, i] == level)
                    step = max(1, 200_000 // len(m))
                    for j in range(0, len(rows), step):
                        r = rows[j : j + step]
                        key = _keys(i, (value[r][:, None] ^ m[None, :]).ravel())
                        cols = [pa.array(key), pa.array(np.repeat(fp[r].view(np.int64), len(m))), pa.array(np.repeat(comp[r], len(m)))]
                        yield pa.RecordBatch.from_arrays(cols, ["key", "fp", "extra"])

    indexed = nodes.select("fp", F.col("copies").alias("extra")).mapInArrow(index, "key long, fp long, extra long")
    centre = indexed.groupBy("key").agg(F.max_by("fp", F.struct("extra", "fp")).alias("centre"))
    close = F.bit_count(F.col("fp").bitwiseXOR(F.col("centre"))) <= radius
    star = indexed.join(centre, "key").where(close & (F.col("fp") != F.col("centre"))).select(F.col("fp").alias("a"), F.col("centre").alias("b"))
    first = components(star)
    known = nodes.join(first.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("component", "fp").alias("extra"))
    known = stored(known, "simhash-known")
    q = known.mapInArrow(probes, "key long, fp long, extra long")
    x = known.mapInArrow(index, "key long, fp long, extra long").select("key", F.col("fp").alias("fp2"), F.col("extra").alias("extra2"))
    # The smaller fingerprint of a pair finds the larger one; pairs in one component already are not returned.
    found = q.join(
        x,
        (q["key"] == x["key"])
        & (F.col("fp") < F.col("fp2"))
        & (F.col("extra") != F.col("extra2"))
        & (F.bit_count(F.col("fp").bitwiseXOR(F.col("fp2"))) <= radius),
    )
    second = components(found.select(F.col("extra").alias("a"), F.col("extra2").alias("b")))
    second = second.select(F.col("node").alias("extra"), F.col("component").alias("last"))
    return known.join(second, "extra", "left").select(F.col("fp").alias("node"), F.coalesce("last", "extra").alias("component"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay: one of each component, that with the smallest id, of equal ids the smallest hash of
    the text. A row whose id is null stays where no row of its component has an id. All columns stay unchanged, whatever
    their names; of rows alike in id and text one stays.

    The rule is the operator's own: components of fingerprints of 4-word shingles at most ``RADIUS`` bits apart."""
    id_, sha = F.col(id_col).cast("long").alias("id"), F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256).alias("sha")
    rows = stored(fingerprints(docs, id_col, text_col, sha=True), "simhash-rows")
    # Equal texts have one fingerprint, so (id, hash of the text) lies in one component and names its row.
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "sha")).alias("f")
    per = rows.groupBy("fp").agg(first).join(stored(_named(rows, RADIUS), "simhash-named"), "fp")
    keep = per.groupBy("component").agg(F.min("f").alias("f")).select(F.col("f.doc_id").alias("id"), F.col("f.sha").alias("sha"))
    mine = rows["doc_id"].eqNullSafe(keep["id"]) & (rows["sha"] == keep["sha"])
    keep = stored(rows.join(keep, mine).groupBy(keep["id"], keep["sha"]).agg(F.count(F.lit(1)).alias("times")), "simhash-kept")
    whole = docs.select(id_, sha, whole_rows(docs))

    def of(part: DataFrame) -> DataFrame:
        return whole.join(part, whole["id"].eqNullSafe(part["id"]) & (whole["sha"] == part["sha"]), "left_semi")

    out = of(keep.where("times = 1")).select("row.*")
    again = keep.where("times > 1")
    return out if again.isEmpty() else out.unionByName(of(again).dropDuplicates(["id", "sha"]).select("row.*"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_groups(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
