"""Repeated passages: every byte covered by a string of ``length`` bytes that also starts anywhere else.

A whole suffix array of a large corpus is too much to move, so it is built sparse. Among the ``length - GRAM + 1``
grams of each window of ``length`` bytes, the one with the least hash is the window's anchor. Equal windows have equal
anchors at equal places, so two occurrences of a repeated window meet in the group of their anchor's gram, and an anchor
needs only the bytes that its windows can reach (its context).

* Contexts that occur twice are repeats as a whole; hashes tell them, and each counts once in what follows.
* The other contexts of a gram are sorted by what follows the anchor: a piece of an enhanced suffix array. A stack scan
  of the longest-common-prefix array visits its intervals (the common-prefix tree) from the deepest up. An interval's
  members share ``p`` bytes to the right; those that also share ``l`` bytes to the left, with p + l >= length, form a
  repeat. Left extensions are tested in the order of the members' left contexts: members that extend alike stand
  together, and how far two groups extend alike shows where they meet, so every pair that becomes neighbours when
  intervals join is compared, and no other. Each repeat reaches all its occurrences, not only neighbours in the array.
* A gram with very many different contexts is first cut: its windows are halved, and each half regroups by the longer
  string that all its windows share. Strings found once go; at one window the group is the repeat. So no group above
  ``MOST`` contexts is ever gathered in one task, whatever it holds.

Cases: null text is empty; texts shorter than ``length`` have no repeat; a row repeated with the same id and text
repeats itself; occurrences may overlap, also in one document; an empty table gives an empty result. Bytes are UTF-8.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from branchwise.llm.common import SubstringHash, slices, two_columns, utf8
from branchwise.session import stored

LENGTH, GRAM, MOST = 400, 64, 8192


def _least_of(h: np.ndarray, w: int) -> np.ndarray:
    """Positions of the leftmost least value of every w consecutive values, each position once."""
    n = len(h) - w + 1
    low, size = h, 1
    while 2 * size <= w:
        low = np.minimum(low[:-size], low[size:])
        size *= 2
    least = np.minimum(low[:n], low[w - size : w - size + n]) if size < w else low[:n]
    # A window opens a new anchor where its least value is new or the old one has left; walk those changes only.
    change = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1, [n]])
    out = []
    for a, b in zip(change[:-1].tolist(), change[1:].tolist()):
        value, at = least[a], a
        hits = np.flatnonzero(h[a : b - 1 + w] == value) + a  # all places of the least value in these windows
        # the leftmost hit at or after each window's start
        out.append(hits[np.unique(np.searchsorted(hits, np.arange(at, b)))] if len(hits) > 1 else hits)
    return np.unique(np.concatenate(out))


def anchors(docs: DataFrame, length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """(doc_id, mark, pos, tail, gram, c1, c2): anchors of (doc_id, text) rows with hashes of their gram and context.

    ``mark`` is a short hash of the text, which tells rows with one id apart; ``tail`` is how far the context reaches.
    """
    import pyarrow as pa

    w = length - gram + 1

    def run(batches):
        one, two = SubstringHash(11), SubstringHash(12)
        for b in slices(batches):
            got = []
            for doc_id, mark, data in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), utf8(b.column(2))):
                if len(data) < length:
                    continue
                raw = np.frombuffer(data, np.uint8)
                sums = one.sums(raw)
                at = np.arange(len(raw) - gram + 1)
                h = one.hashes(sums, at, at + gram)
                p = _least_of(h, w)
                lo, hi = np.maximum(p - (w - 1), 0), np.minimum(p + length, len(raw))
                c1 = one.hashes(sums, lo, hi) ^ (p - lo).astype(np.uint64)
                c2 = two.hashes(two.sums(raw), lo, hi)
                got.append((doc_id, mark, p, hi - p, h[p], c1, c2))
            if got:
                n = [len(g[2]) for g in got]
                ids = pa.array([g[0] for g in got], pa.int64()).take(pa.array(np.repeat(np.arange(len(got)), n)))
                cols = [np.concatenate([g[i] for g in got]) for i in range(2, 7)]
                marks = np.repeat(np.array([g[1] for g in got], np.int32), n)
                arrays = [ids, pa.array(marks), pa.array(cols[0].astype(np.int64)), pa.array(cols[1].astype(np.int16))]
                arrays += [pa.array(c.view(np.int64)) for c in cols[2:]]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "mark", "pos", "tail", "gram", "c1", "c2"])

    rows = docs.select("doc_id", F.hash("text").alias("mark"), "text")
    return rows.mapInArrow(run, "doc_id long, mark int, pos long, tail short, gram long, c1 long, c2 long")


def _lcp(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return n - ((int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])).bit_length() + 7) // 8


def interval_repeats(rights: list[bytes], lefts: list[bytes], length: int) -> list[tuple[int, int, int, int]]:
    """Repeats among contexts sorted by ``rights``: (context, bytes to the left, bytes to the right, other context).

    ``lefts`` are the bytes before the anchor in reverse. For each context and each common-prefix interval that holds
    it, the longest left extension shared with another member is among the results, or one that covers it.
    """
    n = len(rights)
    rank_of = [0] * n
    for r, i in enumerate(sorted(range(n), key=lefts.__getitem__)):
        rank_of[i] = r
    at_rank = sorted(range(n), key=rank_of.__getitem__)
    out: list[tuple[int, int, int, int]] = []

    def meet(r: int, s: int, right: int) -> None:
        x, y = at_rank[r], at_rank[s]
        left = _lcp(lefts[x], lefts[y])
        if left + right >= length:
            out.append((x, left, right, y))
            out.append((y, left, right, x))

    def join(a: list[int], b: list[int], right: int) -> list[int]:
        """Members of two intervals by left rank; every pair that becomes neighbours is compared."""
        if len(a) < len(b):
            a, b = b, a
        for r in b:
            k = bisect_left(a, r)
            if k:
                meet(a[k - 1], r, right)
            if k < len(a):
                meet(r, a[k], right)
            a.insert(k, r)
        return a

    stack: list[tuple[int, list[int]]] = []  # (common prefix with the entry below, members)

    def close() -> None:
        depth, top = stack.pop()
        lower, members = stack.pop()
        stack.append((lower, join(members, top, depth)))

    for i in range(n):
        common = _lcp(rights[i - 1], rights[i]) if i else 0
        while len(stack) > 1 and stack[-1][0] >= common:
            close()
        stack.append((common, [rank_of[i]]))
    while len(stack) > 1:
        close()
    return out


def _scan(groups: DataFrame, length: int) -> DataFrame:
    """(c1, c2, before, after): covered bytes around the anchors of each context.

    ``groups``: (grp, c1, c2, left, right, lo, hi). Members of a group share the string from offset hi to lo + length of
    the anchor, which all windows that start in lo..hi have in common; ``left`` and ``right`` are the bytes beside it.
    """
    import pyarrow as pa

    def solve(rows):
        """Each repeat covers its anchor, so all repeats of a context cover one run: the farthest either way."""
        rights, lefts = [r[4] for r in rows], [r[3][::-1] for r in rows]
        lo, hi = rows[0][5], rows[0][6]
        far: dict = {}
        for x, left, right, _ in interval_repeats(rights, lefts, hi - lo):
            a, b = far.get(x, (0, 0))
            far[x] = (max(a, left), max(b, right))
        return [(rows[x][1], rows[x][2], left - hi, lo + length + right) for x, (left, right) in far.items()]

    def batch(out):
        cols = [pa.array(c, t) for c, t in zip(zip(*out), [pa.int64(), pa.int64(), pa.int32(), pa.int32()])]
        return pa.RecordBatch.from_arrays(cols, ["c1", "c2", "before", "after"])

    def run(batches):
        rows, out = [], []
        for b in slices(batches, 1000):
            for row in zip(*[c.to_pylist() for c in b.columns]):
                if rows and rows[0][0] != row[0]:
                    out += solve(rows)
                    rows = []
                rows.append(row)
            if len(out) > 10_000:
                yield batch(out)
                out = []
        if rows:
            out += solve(rows)
        if out:
            yield batch(out)

    placed = groups.select("grp", "c1", "c2", "left", "right", "lo", "hi").repartition("grp").sortWithinPartitions("grp", "right", "left")
    return placed.mapInArrow(run, "c1 long, c2 long, before int, after int")


def _contexts(docs: DataFrame, wanted: DataFrame, length: int, gram: int) -> DataFrame:
    """Bytes around chosen anchors: (gram, c1, c2, left, right) for the (doc_id, mark, pos, gram, c1, c2) asked for."""
    import pyarrow as pa

    asked = wanted.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("pos", "gram", "c1", "c2")).alias("asked"))
    rows = docs.select("doc_id", F.hash("text").alias("mark"), "text")
    same = rows["doc_id"].eqNullSafe(asked["doc_id"]) & (rows["mark"] == asked["mark"])
    joined = rows.join(asked, same).select("text", "asked")

    def run(batches):
        for b in slices(batches, 50):
            out = []
            for data, asked in zip(utf8(b.column(0)), b.column(1).to_pylist()):
                for a in asked:
                    p = a["pos"]
                    out.append((a["gram"], a["c1"], a["c2"], data[max(0, p - length + gram) : p], data[p : p + length]))
            if out:
                types = [pa.int64()] * 3 + [pa.binary()] * 2
                cols = [pa.array(c, t) for c, t in zip(zip(*out), types)]
                yield pa.RecordBatch.from_arrays(cols, ["gram", "c1", "c2", "left", "right"])

    # Rows alike in id and text give their contexts once each; one is enough.
    return joined.mapInArrow(run, "gram long, c1 long, c2 long, left binary, right binary").dropDuplicates(["gram", "c1", "c2"])


def _cut(hot: DataFrame, length: int, most: int) -> tuple[DataFrame | None, list[DataFrame]]:
    """Groups above ``most`` contexts, cut until they are smaller or hold a single window.

    The windows lo..hi of a group are halved. The earlier half has more of the left bytes in common, the later half more
    of the right ones: these go into the group's key, and what is left beside the longer common string is half as
    long. A context whose text ends before the common string is complete has no window in that half.
    Returns the smaller groups (as ``_scan`` takes them) and the coverage of the single windows.
    """
    items, small, covers = stored(hot, "repeat-hot"), None, []
    while not items.isEmpty():
        lo, hi, n_left, n_right = F.col("lo"), F.col("hi"), F.length("left"), F.length("right")
        mid = F.floor((lo + hi) / 2).cast("int")
        earlier = F.struct(
            lo.alias("lo"),
            mid.alias("hi"),
            (n_left >= hi - mid).alias("there"),
            F.expr("right(hex(left), 2 * (hi - floor((lo + hi) / 2)))").alias("more"),
            F.substring("left", F.lit(1), (n_left - (hi - mid)).cast("int")).alias("left"),
            F.substring("right", F.lit(1), mid - lo).alias("right"),
        )
        later = F.struct(
            (mid + 1).alias("lo"),
            hi.alias("hi"),
            ((n_right >= mid + 1 - lo) & (lo < hi)).alias("there"),
            F.hex(F.substring("right", F.lit(1), mid + 1 - lo)).alias("more"),
            F.substring("left", F.greatest(n_left - (hi - mid - 1), F.lit(0)) + 1, n_left).alias("left"),
            F.substring("right", mid + 2 - lo, n_right).alias("right"),
        )
        half = items.select("grp", "c1", "c2", F.explode(F.array(earlier, later)).alias("h")).where("h.there")
        key = F.md5(F.concat_ws(":", "grp", F.col("h.lo").cast("string"), F.col("h.hi").cast("string"), "h.more"))
        child = stored(half.select(key.alias("grp"), "c1", "c2", "h.left", "h.right", "h.lo", "h.hi"), "repeat-cut")
        sizes = stored(child.groupBy("grp").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "repeat-sizes")
        # Written, so that what reads the levels' groups later is plain scans and keeps no level's sizes in memory.
        sized = stored(child.join(sizes, "grp"), "repeat-sized")
        covers.append(sized.where("lo = hi").select("c1", "c2", (-lo).alias("before"), (lo + length).alias("after")))
        few = sized.where(f"lo < hi and n <= {most}").drop("n")
        small = few if small is None else small.unionByName(few)
        items = sized.where(f"lo < hi and n > {most}").drop("n")
    return small, covers


def covered(docs: DataFrame, length: int = LENGTH, gram: int = GRAM, most: int = MOST) -> DataFrame:
    """(doc_id, mark, start, stop): spans of bytes that repeats cover; spans of a row may overlap."""
    rows = stored(anchors(docs, length, gram), "repeat-anchors")
    contexts = rows.groupBy("gram", "c1", "c2").agg(
        F.count(F.lit(1)).alias("n"),
        F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("k"), "doc_id", "mark", "pos", "tail")).alias("at"),
    )
    grams = contexts.groupBy("gram").agg(F.sum("n").alias("rows"), F.count(F.lit(1)).alias("contexts")).where("rows > 1")
    known = stored(contexts.join(grams, "gram"), "repeat-contexts")
    reach = F.least(F.col("at.pos"), F.lit(length - gram)).cast("int")
    covers = known.where("n > 1").select("c1", "c2", reach.alias("before"), F.col("at.tail").cast("int").alias("after"))
    wanted = known.where("contexts > 1").select("gram", "c1", "c2", "at.doc_id", "at.mark", "at.pos", "contexts")
    if not wanted.isEmpty():
        texts = stored(_contexts(docs, wanted, length, gram), "repeat-texts")
        hot = known.where(f"contexts > {most}").select("gram").distinct()
        # What all windows of an anchor have in common is its gram.
        groups = texts.select(
            "gram",
            F.md5(F.substring("right", 1, gram)).alias("grp"),
            "c1",
            "c2",
            "left",
            F.substring("right", gram + 1, length).alias("right"),
            F.lit(gram - length).alias("lo"),
            F.lit(0).alias("hi"),
        )
        if not hot.isEmpty():
            small, more = _cut(groups.join(hot, "gram", "left_semi").drop("gram"), length, most)
            groups = groups.join(hot, "gram", "left_anti").drop("gram")
            groups = groups if small is None else groups.unionByName(small)
            for c in more:
                covers = covers.unionByName(c)
        covers = covers.unionByName(_scan(groups, length))
    # Every cover holds its anchor, so those of one context are one run.
    runs = covers.groupBy("c1", "c2").agg(F.max("before").alias("before"), F.max("after").alias("after"))
    # Written first, so that Spark can split the rows of a context that very many places share.
    runs = stored(runs, "repeat-runs")
    found = rows.select("doc_id", "mark", "pos", "c1", "c2").join(runs, ["c1", "c2"])
    return found.select("doc_id", "mark", (F.col("pos") - F.col("before")).alias("start"), (F.col("pos") + F.col("after")).alias("stop"))


def _union(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs covered by spans."""
    if not len(starts):
        return starts, stops
    order = np.argsort(starts, kind="stable")
    start, far = starts[order], np.maximum.accumulate(stops[order])
    new = np.concatenate([[True], start[1:] > far[:-1]])
    return start[new], far[np.append(np.flatnonzero(new)[1:] - 1, len(far) - 1)]


def removed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, most: int = MOST) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed byte runs)."""
    import pyarrow as pa

    docs = two_columns(docs, id_col, text_col)
    spans = covered(docs, length, min(GRAM, length), most)
    per_doc = spans.groupBy("doc_id", "mark").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    per_doc = stored(per_doc, "repeat-spans")
    rows = docs.select("doc_id", F.hash("text").alias("mark"), "text")
    same = rows["doc_id"].eqNullSafe(per_doc["doc_id"]) & (rows["mark"] == per_doc["mark"])
    joined = rows.join(per_doc, same, "left").select(rows["doc_id"], "text", "spans")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start: long, stop: long>>"

    def run(batches):
        span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
        for b in slices(batches):
            out, lists = [], b.column(2)
            starts, stops = (lists.values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            offsets, there = lists.offsets.to_numpy(), lists.is_valid().to_pylist()
            for k, data in enumerate(utf8(b.column(1))):
                at = slice(offsets[k], offsets[k + 1]) if there[k] else slice(0, 0)
                s, e = (x.tolist() for x in _union(starts[at], stops[at]))
                sha, done = hashlib.sha256(), 0
                for i, j in zip(s, e):
                    sha.update(data[done:i])
                    done = j
                sha.update(data[done:])
                runs = [{"start": i, "stop": j} for i, j in zip(s, e)]
                out.append((len(data), sum(e) - sum(s), len(s), sha.hexdigest(), runs))
            types = [pa.int64()] * 3 + [pa.string(), span]
            cols = [b.column(0)] + [pa.array(c, t) for c, t in zip(zip(*out), types)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return joined.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return removed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
