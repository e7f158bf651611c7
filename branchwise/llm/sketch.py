"""Bottom-k sketches of word shingles: the k smallest distinct hashes of a text.

Sketches merge by keeping the k smallest of both, so parts of a text or of a corpus can be sketched apart and joined.
Two sketches estimate resemblance, containment and the number of distinct shingles; a sketch of fewer than k hashes
holds them all, and its figures are exact. Shingles are five words of the text lower-cased in A-Z and cut at ASCII
white space, repeats counted once; fewer words make one shingle, none an empty sketch.

Cases: null text is empty; two empty sketches have likeness 1, an empty and another 0; equal texts have equal
sketches; very long texts are hashed whole by one vectorised pass; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import SubstringHash, slices, two_columns

K, WORDS, SEED = 128, 5, 20240501
EMPTY = np.zeros(0, np.uint64)


def shingle_hashes(text: str, hasher: SubstringHash, words: int = WORDS) -> np.ndarray:
    parts = text.encode("utf-8", "replace").lower().split()
    if not parts:
        return EMPTY
    joined = np.frombuffer(b" ".join(parts), np.uint8)
    gap = np.flatnonzero(joined == 32)
    start, end = np.concatenate([[0], gap + 1]), np.append(gap, len(joined))
    w = min(words, len(parts))
    return hasher.hashes(hasher.sums(joined), start[: len(start) - w + 1], end[w - 1 :])


def bottom_k(hashes: np.ndarray, k: int = K) -> np.ndarray:
    """The k smallest distinct hashes, ascending."""
    near = 4 * k
    while len(hashes) > near:
        few = np.unique(np.partition(hashes, near)[:near])
        if len(few) >= k:
            return few[:k]
        near *= 4
    return np.unique(hashes)[:k]


def merge(a: np.ndarray, b: np.ndarray, k: int = K) -> np.ndarray:
    return np.union1d(a, b)[:k]


def resemblance(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A or B|: the share of the union's k smallest hashes that both sketches hold."""
    if not len(a) and not len(b):
        return 1.0
    union = merge(a, b, k)
    both = np.intersect1d(a, b, assume_unique=True)
    return float(np.isin(union, both, assume_unique=True).sum() / len(union))


def distinct_count(a: np.ndarray, k: int = K) -> float:
    """Estimated number of distinct shingles."""
    return float(len(a)) if len(a) < k else (k - 1) / ((float(a[-1]) + 1.0) / 2.0**64)


def containment(a: np.ndarray, b: np.ndarray, k: int = K) -> float:
    """Estimated |A and B| / |A|; 1 for an empty A."""
    n = distinct_count(a, k)
    return 1.0 if not n else min(1.0, resemblance(a, b, k) * distinct_count(merge(a, b, k), k) / n)


def to_text(sketch: np.ndarray) -> str:
    return base64.b64encode(sketch.astype(">u8").tobytes()).decode()


def from_text(text: str) -> np.ndarray:
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """(doc_id, fingerprint, n_shingles) of every text."""
    import pyarrow as pa

    def run(batches):
        hasher = SubstringHash(SEED)
        for b in slices(batches):
            s = [bottom_k(shingle_hashes(t, hasher), k) for t in b.column(1).to_pylist()]
            cols = [b.column(0), pa.array([to_text(x) for x in s], pa.string()), pa.array([distinct_count(x, k) for x in s], pa.float64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "fingerprint", "n_shingles"])

    return two_columns(docs, id_col, text_col).mapInArrow(run, "doc_id long, fingerprint string, n_shingles double")


def beside_next(docs: DataFrame, rows_per_part: int = 1000, most_parts: int = 4096) -> DataFrame:
    """(part, peek, doc_id, text): rows dealt by ranges of doc_id, sorted descending, each range followed by the row
    that comes next after it (``peek``), the last one by the very first. One shuffle of the texts."""
    n, top = docs.agg(F.count(F.lit(1)), F.max("doc_id")).first()
    parts = max(1, min(most_parts, n // rows_per_part))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)], 10 * parts)).first()[0] if parts > 1 else []
    bounds = sorted({*(cuts or []), *([top] if top is not None else [])})
    if bounds:
        edges = F.array(*[F.lit(b).cast("long") for b in bounds])
        part = F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(edges, lambda e: e < F.col("doc_id"))))
        edge = F.coalesce(F.array_position(edges, F.col("doc_id")), F.lit(0)) > 0
    else:
        part, edge = F.lit(0), F.lit(True)
    rows = docs.withColumn("part", part).withColumn("edge", edge)
    after = F.pmod(F.col("part") + 1, F.lit(max(1, len(bounds))))
    own = F.struct(F.col("part").alias("part"), F.lit(False).alias("peek"))
    peek = F.struct(after.alias("part"), F.lit(True).alias("peek"))
    placed = rows.withColumn("at", F.explode(F.when(F.col("edge"), F.array(own, peek)).otherwise(F.array(own))))
    return (
        placed.select("at.part", "at.peek", "doc_id", "text")
        .repartition("part")
        .sortWithinPartitions("part", "peek", F.col("doc_id").desc_nulls_last(), "text")
    )


def edited_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Sketches of each text and of the text whose last half gives way to the start of the next document.

    Next: the following row in descending doc_id (equal ids by text, null ids last); after the last comes the first.
    """
    import pyarrow as pa

    schema = (
        "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
        "near_next double, n_shingles double, edited_in_text double"
    )
    names = [c.split()[0] for c in schema.split(", ")]

    def one(row, nxt, hasher):
        doc_id, text, a = row
        half = len(text) // 2
        edited = text[: len(text) - half] + nxt[1][:half]
        e = bottom_k(shingle_hashes(edited, hasher), k)
        sha = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
        return (doc_id, len(text), sha, to_text(a), to_text(e), resemblance(a, e, k), resemblance(a, nxt[2], k), distinct_count(a, k), containment(e, a, k))

    def run(batches):
        hasher = SubstringHash(SEED)
        before, out = None, []
        types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()] + [pa.float64()] * 4

        def batch():
            cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
            return pa.RecordBatch.from_arrays(cols, names)

        for b in slices(batches):
            for part, peek, doc_id, text in zip(*[c.to_pylist() for c in b.columns]):
                if peek and (before is None or before[0] != part):
                    continue  # a second row with the edge's id
                row = (doc_id, text, bottom_k(shingle_hashes(text, hasher), k))
                if before is not None and before[0] == part:
                    out.append(one(before[1], row, hasher))
                before = None if peek else (part, row)
            if len(out) >= 500:
                yield batch()
                out = []
        if before is not None:
            raise RuntimeError("a range of documents has no next row")
        if out:
            yield batch()

    return beside_next(two_columns(docs, id_col, text_col)).mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_likeness(spark.read.parquet(f"{sf_dir}/documents.parquet"))
