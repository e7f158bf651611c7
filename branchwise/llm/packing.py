"""Lexical retrieval packing: sequences of related documents, chosen by BM25.

Texts become ids once, in a written table. Term statistics (document frequency of every id of the vocabulary, number of
documents, mean length) are counted over all documents. Rows are then dealt in ranges of a lexical signature, and cut
into shards of bounded size; each shard gets an inverted index with the global statistics. Packing walks a shard: a seed
document fills windows of ``WINDOW`` ids; where its end leaves room, the index returns its unused neighbours, best
first, and they fill the window. A neighbour that does not fit whole is cut, and its rest is the next seed. Only a
shard's last sequence can be short, whatever the texts.

Terms are the ids themselves, so statistics are bounded by the vocabulary. Terms in over half of all documents have no
weight (their BM25 idf would be below zero).

Cases: null text is empty and is packed as its end id; equal texts and repeated rows are documents of their own; null
ids are kept; a very long text is its own run of full windows; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import slices
from branchwise.llm.tokens import counted, default_vocabulary, distinct, token_table

WINDOW, SHARD_IDS, SHARD_DOCS, K1, B = 1024, 1 << 19, 2048, 1.2, 0.75


class Index:
    """Inverted index of a shard: postings (document, BM25 weight) by term."""

    def __init__(self, ids: list[np.ndarray], idf: np.ndarray, mean_length: float):
        self.n = len(ids)
        found = [distinct(d) for d in ids]
        sizes = np.array([len(t) for t, _ in found])
        term, tf = np.concatenate([t for t, _ in found]), np.concatenate([c for _, c in found]).astype(np.float64)
        doc = np.repeat(np.arange(self.n), sizes)
        norm = K1 * (1 - B + B * np.array([len(d) for d in ids]) / mean_length)
        weight = idf[term] * tf * (K1 + 1) / (tf + norm[doc])
        keep = weight > 0
        term, doc, weight = term[keep], doc[keep], weight[keep]
        order = np.argsort(term, kind="stable")
        self.doc, self.weight = doc[order], weight[order]
        names, self.first, self.count = np.unique(term[order], return_index=True, return_counts=True)
        place = np.searchsorted(names, term)
        cuts = np.searchsorted(doc, np.arange(self.n + 1))
        self.terms = [place[a:b] for a, b in zip(cuts[:-1], cuts[1:])]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of every document of the shard for the seed's distinct terms."""
        t = self.terms[seed]
        n = self.count[t]
        if not len(n):
            return np.zeros(self.n)
        at = np.arange(n.sum()) + np.repeat(self.first[t] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
        return np.bincount(self.doc[at], self.weight[at], self.n)


def pack(lengths: list[int], neighbours, window: int = WINDOW):
    """Pieces (document, start, length, sequence, offset); ``neighbours(seed, used)`` gives unused documents, best first."""
    n = len(lengths)
    used = np.zeros(n, bool)
    out, seq, room, at = [], 0, window, 0

    def put(doc: int, start: int) -> int:
        nonlocal room
        size = min(room, lengths[doc] - start)
        out.append((doc, start, size, seq, window - room))
        room -= size
        return start + size

    while at < n:
        if used[at]:
            at += 1
            continue
        doc, start = at, 0
        used[doc] = True
        while True:
            start = put(doc, start)
            if room == 0:
                seq, room = seq + 1, window
                if start < lengths[doc]:
                    continue
                break
            cut = False
            for near in neighbours(doc, used):
                used[near] = True
                start = put(near, 0)
                if room == 0:
                    seq, room = seq + 1, window
                    if start < lengths[near]:
                        doc, cut = near, True  # the rest is the next seed
                    break
            if not cut:
                break
    return out


def packed(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    import pyarrow as pa
    from pyspark import TaskContext

    tokens, df = counted(token_table(docs, vocabulary, id_col, text_col, signature=True, counts=True), "pack-ids")
    n, total = tokens.agg(F.count(F.lit(1)), F.sum("n_tokens")).first()
    idf = np.maximum(0.0, np.log((n - df + 0.5) / (df + 0.5)))
    mean = (total or 1) / max(n, 1)
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long"
    names = [c.split()[0] for c in schema.split(", ")]

    def shard(rows, first_sequence):
        ids = [np.frombuffer(r[1], "<u2") for r in rows]
        index = Index(ids, idf, mean)

        def neighbours(seed, used):
            left = np.flatnonzero(~used)
            for k in left[np.argsort(-index.scores(seed)[left], kind="stable")].tolist():
                yield k

        pieces = pack([len(i) for i in ids], neighbours, window)
        fill: dict = {}
        for _, _, size, seq, _ in pieces:
            fill[seq] = fill.get(seq, 0) + size
        out = []
        for d, start, size, seq, offset in pieces:
            crc = zlib.crc32(ids[d][start : start + size].astype("<u4").tobytes())
            padded = fill[seq] if fill[seq] & (fill[seq] - 1) == 0 else window
            out.append((rows[d][0], start, size, crc, len(ids[d]), first_sequence + seq, offset, padded))
        cols = [pa.array(c, pa.int64()) for c in zip(*out)]
        return pa.RecordBatch.from_arrays(cols, names), first_sequence + pieces[-1][3] + 1

    def run(batches):
        nxt = TaskContext.get().partitionId() << 40
        rows, held = [], 0
        for b in slices(batches, 100):
            for doc_id, ids in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if rows and (held + len(ids) // 2 > SHARD_IDS or len(rows) >= SHARD_DOCS):
                    batch, nxt = shard(rows, nxt)
                    yield batch
                    rows, held = [], 0
                rows.append((doc_id, ids))
                held += len(ids) // 2
        if rows:
            yield shard(rows, nxt)[0]

    parts = max(1, -(-(total or 0) // (8 * SHARD_IDS)))
    # The signature may be shared by very many copies; id and a hash of the row cut such a run too.
    tie = F.xxhash64("doc_id", "n_tokens")
    placed = tokens.select("doc_id", "ids", "route", tie.alias("tie")).repartitionByRange(parts, "route", "tie")
    return placed.sortWithinPartitions("route", "tie").select("doc_id", "ids").mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
