"""Secret scan with corpus-wide ownership frequency.

A first pass finds base matches (assignments, access keys, hex runs) and further candidates: long mixed strings that no
base match covers. Values leave that pass only as SHA-256 hashes. Hashes are counted by distinct repositories and
owners: a value with more than ``MOST_OWNERS`` owners or more than ``MOST_REPOS`` repositories is a copied example, any
other looks live. Candidates that look live become spans of kind ``opaque``; base spans always stay, and each finding is
returned with its value's two counts.

Counting goes through distinct (hash, owner, repository) rows that combine before the shuffle, so a value copied into
a third of all documents is one row per repository and task. In ``documents`` the owner is ``source`` and the
repository is ``source`` with ``lang``.

Cases: null text is empty; null owners or repositories count as one owner or repository of their own; repeated rows
are rows of their own and do not raise the distinct counts; very long texts are scanned whole; an empty table gives an
empty result. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import slices
from branchwise.session import stored

# The base patterns and the least lengths that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "opaque")
LEAST_ASSIGN, LEAST_ACCESS = 6, 20

OPAQUE = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
LEAST_BITS = 3.5
MOST_OWNERS, MOST_REPOS = 3, 6


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, secret value), leftmost and non-overlapping within a kind, ordered by start, then kind."""
    out = [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    out += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST_ACCESS]
    out += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(out, key=lambda s: (s[0], KINDS.index(s[2])))


def entropy(value: str) -> float:
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values())


def opaque_spans(text: str, base: list) -> list[tuple[int, int, str, str]]:
    """Long strings of mixed classes and high entropy that overlap no base span."""
    out = []
    starts, ends = [s[0] for s in base], list(accumulate((s[1] for s in base), max))
    for m in OPAQUE.finditer(text):
        v = m[0]
        if not (re.search("[0-9]", v) and re.search("[a-z]", v) and re.search("[A-Z]", v)) or entropy(v) < LEAST_BITS:
            continue
        # Of the base spans that begin before its end, the one that reaches farthest tells.
        before = bisect_left(starts, m.end())
        if not before or ends[before - 1] <= m.start():
            out.append((m.start(), m.end(), "opaque", v))
    return out


def line(spans) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(docs: DataFrame, id_col: str, text_col: str, owner, repo) -> DataFrame:
    """Per row: id, owner, repo, counts, base hash, and all candidates with the hashes of their values."""
    import pyarrow as pa

    found = pa.list_(pa.struct([("at", pa.int64()), ("stop", pa.int64()), ("kind", pa.string()), ("value", pa.string())]))
    schema = (
        "doc_id long, owner string, repo string, n_assign long, n_access long, n_hex long, base_sha256 string, "
        "found array<struct<at: long, stop: long, kind: string, value: string>>"
    )
    names = [c.split()[0] for c in schema.split(", ", 7)]

    def run(batches):
        for b in slices(batches):
            rows, lists = [], []
            for text in b.column(3).to_pylist():
                base = base_spans(text)
                kinds = Counter(s[2] for s in base)
                sha = hashlib.sha256(line([s[:3] for s in base]).encode()).hexdigest()
                rows.append((kinds["assign"], kinds["access"], kinds["hex"], sha))
                every = base + opaque_spans(text, base)
                lists.append([{"at": s, "stop": e, "kind": k, "value": hashlib.sha256(v.encode()).hexdigest()} for s, e, k, v in every])
            cols = [b.column(i) for i in range(3)]
            cols += [pa.array(c, t) for c, t in zip(zip(*rows), [pa.int64()] * 3 + [pa.string()])]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(lists, found)], names)

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), owner.cast("string").alias("owner"), repo.cast("string").alias("repo"),
        F.coalesce(F.col(text_col), F.lit("")).alias("text"),
    )
    return rows.mapInArrow(run, schema)


def ownership(candidates: DataFrame) -> DataFrame:
    """(value, repos, owners): distinct repositories and owners of each hash, from (value, owner, repo) rows."""
    # Null marks become values, so that they count and group like others.
    named = candidates.select("value", *[F.struct(F.col(c).isNull(), F.coalesce(c, F.lit(""))).alias(c) for c in ("owner", "repo")])
    pairs = named.groupBy("value", "owner", "repo").agg(F.lit(1).alias("one"))
    per_owner = pairs.groupBy("value", "owner").agg(F.count(F.lit(1)).alias("repos"))
    return per_owner.groupBy("value").agg(F.sum("repos").alias("repos"), F.count(F.lit(1)).alias("owners"))


def secrets(
    docs: DataFrame, owner, repo, id_col: str = "doc_id", text_col: str = "text", most_owners: int = MOST_OWNERS, most_repos: int = MOST_REPOS
) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live, n_example, and frequencies
    (kind:start:end:repositories:owners of every finding, copied examples included)."""
    rows = stored(scan(docs, id_col, text_col, owner, repo), "secrets")
    cands = rows.where(F.size("found") > 0).select("doc_id", "owner", "repo", "base_sha256", F.explode("found").alias("f"))
    verdict = ownership(cands.select(F.col("f.value").alias("value"), "owner", "repo"))
    verdict = verdict.withColumn("live", (F.col("owners") <= most_owners) & (F.col("repos") <= most_repos))
    # Rows with one id may differ in text: spans are gathered per written row, named by id and its list of candidates.
    own = F.xxhash64(F.to_json("found"))
    flat = rows.where(F.size("found") > 0).select("doc_id", own.alias("mark"), F.explode("found").alias("f")).distinct()
    judged = flat.withColumn("value", F.col("f.value")).join(verdict, "value")
    kept = F.struct("f.at", F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("f.kind")).alias("rank"), "f.stop", "f.kind", "repos", "owners", "live")
    marks = judged.groupBy("doc_id", "mark").agg(
        F.sort_array(F.collect_list(kept)).alias("found"),
        F.count(F.when(F.col("live"), 1)).alias("n_live"),
        F.count(F.when(~F.col("live"), 1)).alias("n_example"),
    )
    line_of = lambda s, *more: F.concat_ws(":", s["kind"], *[s[c].cast("string") for c in ("at", "stop", *more)])
    kept = F.filter("found", lambda s: (s["kind"] != "opaque") | s["live"])
    text = F.concat_ws(",", F.transform(kept, lambda s: line_of(s)))
    counts = F.concat_ws(",", F.transform("found", lambda s: line_of(s, "repos", "owners")))
    base = rows.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", own.alias("mark"))
    same = base["doc_id"].eqNullSafe(marks["doc_id"]) & (base["mark"] == marks["mark"])
    zero = F.lit(0).cast("long")
    return base.join(marks, same, "left").select(
        base["doc_id"], "n_assign", "n_access", "n_hex", "base_sha256", F.coalesce(text, F.lit("")).alias("spans"),
        F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example"), F.coalesce(counts, F.lit("")).alias("frequencies"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return secrets(docs, F.col("source"), F.concat_ws("/", "source", "lang"))
