"""Token-id files in canonical length-limited Huffman code.

Code lengths come from the global counts of all ids (package-merge, at most ``MAX_BITS`` bits); the canonical code
follows from the lengths alone, which each file's header holds. Ids are coded in blocks of ``BLOCK`` with the bit offset
of every block in the footer, so a reader starts at any block, and blocks decode side by side by table lookups. Files
hold the documents in ascending doc_id order, one file per range of ids.

File: magic, block size, number of codes, length of the packed code lengths, packed code lengths | coded bits, in
64-bit big-endian words | doc ids, null marks, token counts, block bit offsets | their counts, total ids, footer
offset, magic. Numbers are little-endian.

Cases: null text is empty and has the end id alone; equal ids are ordered by token count and keep a row each; null ids
come first; very long texts are streamed through in blocks; an empty table writes no file and reads back empty.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from branchwise.llm.common import filesystem, slices
from branchwise.llm.tokens import counted, default_vocabulary, token_table
from branchwise.session import scratch_path, stored

MAGIC, BLOCK, MAX_BITS, TASK_IDS = b"BWHUFF01", 1024, 18, 4 << 20


def code_lengths(counts: np.ndarray, max_bits: int = MAX_BITS) -> np.ndarray:
    """Optimal code lengths of at most ``max_bits`` bits (package-merge); 0 for ids that never occur."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), np.uint8)
    n = len(used)
    if n == 0:
        return out
    if n == 1:
        out[used] = 1
        return out
    if n > 1 << max_bits:
        raise ValueError("more ids than codes")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.float64)
    levels, packages = [], np.zeros(0)
    for _ in range(max_bits):
        both = np.concatenate([leaves, packages])
        at = np.argsort(both, kind="stable")
        levels.append(at < n)
        row = both[at]
        packages = row[0 : len(row) // 2 * 2 : 2] + row[1::2][: len(row) // 2]
    take = 2 * n - 2
    length = np.zeros(n, np.int64)
    for is_leaf in reversed(levels):
        chosen = is_leaf[:take]
        k = int(chosen.sum())
        length[:k] += 1  # the leaves taken at a level are its lightest ones
        take = 2 * (len(chosen) - k)
    out[order] = length
    return out


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes by ascending length, then id."""
    codes = np.zeros(len(lengths), np.uint64)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if not len(order):
        return codes
    ls = lengths[order].astype(np.int64)
    top = int(ls.max())
    # Left-aligned to the longest length, each code starts where the one before it ends.
    width = np.uint64(1) << (top - ls).astype(np.uint64)
    start = np.concatenate([[np.uint64(0)], np.cumsum(width)[:-1].astype(np.uint64)])
    codes[order] = start >> (top - ls).astype(np.uint64)
    return codes


def decode_table(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(id, length) for every prefix of the longest code's bits."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    top = int(lengths.max()) if len(order) else 1
    ids, bits = np.zeros(1 << top, np.uint16), np.ones(1 << top, np.uint8)
    if len(order):
        width = 1 << (top - lengths[order].astype(np.int64))
        n = int(width.sum())
        ids[:n], bits[:n] = np.repeat(order, width), np.repeat(lengths[order], width)
    return ids, bits, top


class BitWriter:
    """Packs codes into big-endian 64-bit words, keeping the unfinished word between calls."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray):
        self.codes, self.lengths = codes, lengths.astype(np.uint64)
        self.open, self.bits, self.total = np.uint64(0), 0, 0

    def add(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Finished words, and the bit offset of each id in the whole stream."""
        size, code = self.lengths[ids].astype(np.int64), self.codes[ids]
        ends = np.cumsum(size) + self.bits
        begins = ends - size
        word, off = begins >> 6, (begins & 63).astype(np.uint64)
        end = off + size.astype(np.uint64)
        over = end > 64
        head = np.where(over, code >> np.where(over, end - np.uint64(64), np.uint64(0)), code << np.where(over, np.uint64(0), np.uint64(64) - end))
        words = np.zeros(int(ends[-1] >> 6) + 2 if len(ids) else 1, np.uint64)
        words[0] = self.open
        if len(ids):
            first = np.concatenate([[0], np.flatnonzero(np.diff(word)) + 1])
            words[word[first]] |= np.bitwise_or.reduceat(head, first)
            words[word[over] + 1] |= code[over] << (np.uint64(128) - end[over])
            full, self.bits = int(ends[-1] >> 6), int(ends[-1] & 63)
        else:
            full = 0
        at = begins + self.total * 64
        self.open = words[full]
        self.total += full
        return words[:full].astype(">u8").tobytes(), at

    def finish(self) -> bytes:
        return np.array([self.open], ">u8").tobytes() + bytes(8)


def write(tokens: DataFrame, lengths: np.ndarray, folder: str, block: int = BLOCK) -> DataFrame:
    """Write (doc_id, n_tokens, ids) rows, sorted within partitions, one file a partition; (path, n_docs, n_ids, first)."""
    import pyarrow as pa

    fs, path = filesystem(folder)
    fs.create_dir(path, recursive=True)
    packed = zlib.compress(lengths.tobytes(), 9)
    codes = canonical(lengths)

    def run(batches):
        fs, path = filesystem(folder)
        name, out, bits = f"ids-{uuid.uuid4().hex}.bwh", None, None
        docs, nulls, counts, marks, held, n_ids = [], [], [], [], [], 0

        def flush(whole: bool):
            nonlocal held, n_ids
            ids = np.concatenate(held) if held else np.zeros(0, np.uint16)
            n = len(ids) if whole else len(ids) // block * block
            if n:
                data, at = bits.add(ids[:n])
                out.write(data)
                marks.append(at[::block])
                n_ids += n
            held = [ids[n:]]

        first, size = None, 0
        for b in slices(batches, 500):
            for doc_id, n, ids in zip(*[c.to_pylist() for c in b.columns]):
                if out is None:
                    out, bits, first = fs.open_output_stream(f"{path}/{name}", compression=None), BitWriter(codes, lengths), doc_id
                    out.write(MAGIC + struct.pack("<III", block, len(lengths), len(packed)) + packed)
                docs.append(doc_id or 0)
                nulls.append(doc_id is None)
                counts.append(n)
                held.append(np.frombuffer(ids, "<u2"))
                size += n
                if size >= 1 << 18:
                    flush(False)
                    size = 0
        if out is None:
            return
        flush(True)
        out.write(bits.finish())
        at = out.tell()
        offsets = np.concatenate(marks) if marks else np.zeros(0, np.int64)
        foot = [np.array(docs, "<i8"), np.array(nulls, "u1"), np.array(counts, "<i8"), offsets.astype("<i8")]
        out.write(b"".join(a.tobytes() for a in foot) + struct.pack("<QQQQ", len(docs), len(offsets), n_ids, at) + MAGIC)
        out.close()
        cols = [pa.array([f"{folder}/{name}"]), pa.array([len(docs)]), pa.array([n_ids]), pa.array([first], pa.int64())]
        yield pa.RecordBatch.from_arrays(cols, ["path", "n_docs", "n_ids", "first"])

    return stored(tokens.select("doc_id", "n_tokens", "ids").mapInArrow(run, "path string, n_docs long, n_ids long, first long"), "id-files")


def decode(buffer: np.ndarray, offsets: np.ndarray, table, block: int) -> np.ndarray:
    """(blocks, block) ids decoded side by side from bit offsets into ``buffer``."""
    ids, bits, top = table
    padded = np.concatenate([buffer, np.zeros(8 + block * 4, np.uint8)])
    window = np.ndarray((len(padded) - 3,), ">u4", padded.data, 0, (1,))
    out, at = np.zeros((block, len(offsets)), np.uint16), offsets.astype(np.int64).copy()
    last = len(window) * 8 - 8
    mask = (1 << top) - 1
    for i in range(block):
        look = (window[at >> 3].astype(np.int64) >> (32 - top - (at & 7))) & mask
        out[i] = ids[look]
        at += bits[look]
        np.minimum(at, last, out=at)  # past the end of the last block
    return out.T


@lru_cache(maxsize=2)
def _shared_table(lengths: bytes):
    """The table of a header's code lengths; files of one run have one code, so a worker makes it once."""
    return decode_table(np.frombuffer(lengths, np.uint8))


class Reader:
    """One file: header and footer, then ids from any block on."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(0)
        head = source.read(len(MAGIC) + 12)
        self.block, n_codes, n_packed = struct.unpack("<III", head[len(MAGIC) :])
        self.lengths = np.frombuffer(zlib.decompress(source.read(n_packed)), np.uint8)
        self.body = len(MAGIC) + 12 + n_packed
        source.seek(size - 32 - len(MAGIC))
        tail = source.read(32 + len(MAGIC))
        if head[: len(MAGIC)] != MAGIC or tail[32:] != MAGIC or len(self.lengths) != n_codes:
            raise ValueError("not an id file")
        n_docs, n_blocks, self.n_ids, self.foot = struct.unpack("<QQQQ", tail[:32])
        source.seek(self.foot)
        raw = source.read(n_docs * 17 + n_blocks * 8)
        self.docs = np.frombuffer(raw, "<i8", n_docs)
        self.nulls = np.frombuffer(raw, "u1", n_docs, n_docs * 8)
        self.counts = np.frombuffer(raw[n_docs * 9 : n_docs * 17], "<i8")
        self.offsets = np.frombuffer(raw[n_docs * 17 :], "<i8")
        self.table = _shared_table(self.lengths.tobytes())

    def ids(self, start: int, stop: int, step: int = 2048):
        """Arrays of the ids start..stop, some blocks at a time."""
        for b in range(start // self.block, -(-stop // self.block), step):
            offs = self.offsets[b : b + step]
            stop_bit = int(self.offsets[b + step]) if b + step < len(self.offsets) else (self.foot - self.body) * 8
            low = int(offs[0]) >> 3
            self.source.seek(self.body + low)
            data = np.frombuffer(self.source.read((stop_bit + 7) // 8 - low + 8), np.uint8)
            got = decode(data, offs - low * 8, self.table, self.block).ravel()
            first = b * self.block
            yield got[max(0, start - first) : max(0, min(stop, self.n_ids) - first)]


def read(files: DataFrame, task_ids: int = TASK_IDS) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the (path, n_ids, base) files; a task reads the
    documents that begin in one range of a file's ids."""
    import pyarrow as pa

    step = F.sequence(F.lit(0).cast("long"), F.col("n_ids") - 1, F.lit(task_ids).cast("long"))
    # One row a file tells how many ranges there are; with that number given, no ranges are merged into one task.
    n = files.where("n_ids > 0").agg(F.sum(F.ceil(F.col("n_ids") / task_ids))).first()[0]
    ranges = files.where("n_ids > 0").select("path", "base", F.explode(step).alias("low")).repartition(int(n or 1))

    def run(batches):
        for b in batches:
            for path, base, low in zip(*[c.to_pylist() for c in b.columns]):
                fs, p = filesystem(path)
                with fs.open_input_file(p) as source:
                    r = Reader(source, fs.get_file_info(p).size)
                    begin = np.concatenate([[0], np.cumsum(r.counts)[:-1]])
                    mine = np.flatnonzero((begin >= low) & (begin < low + task_ids))
                    if not len(mine):
                        continue
                    ends = begin[mine] + r.counts[mine]
                    crcs, k, at, crc = [], 0, int(begin[mine[0]]), 0
                    for part in r.ids(at, int(ends[-1])):
                        i = 0
                        while i < len(part):
                            n = min(len(part) - i, int(ends[k]) - at)
                            crc = zlib.crc32(part[i : i + n].astype("<u4").tobytes(), crc)
                            i, at = i + n, at + n
                            if at == ends[k]:
                                crcs.append(crc)
                                k, crc = k + 1, 0
                    ids = pa.array(r.docs[mine], pa.int64(), mask=r.nulls[mine].astype(bool))
                    cols = [ids, pa.array(begin[mine] + base), pa.array(r.counts[mine]), pa.array(crcs, pa.int64())]
                    yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"])

    return ranges.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode all texts, write the files, and read them back."""
    spark = docs.sparkSession
    tokens, counts = counted(token_table(docs, vocabulary, id_col, text_col, counts=True), "ids")
    lengths = code_lengths(counts)
    placed = tokens.repartitionByRange("doc_id", "n_tokens").sortWithinPartitions("doc_id", "n_tokens", F.crc32("ids"))
    files = write(placed, lengths, scratch_path(spark, "id-files"))
    # One row a file: its place in the order of first ids gives the ids before it.
    upto = Window.orderBy(F.col("first").asc_nulls_first(), "n_ids", "path").rowsBetween(Window.unboundedPreceding, -1)
    return read(files.withColumn("base", F.coalesce(F.sum("n_ids").over(upto), F.lit(0))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_vocabulary())
