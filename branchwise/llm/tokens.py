"""Token ids of whole texts, as little-endian unsigned 16-bit bytes.

The vocabulary is a parameter (a file path every worker can open). The byte-level pattern of such vocabularies always
cuts a text where a space or one line break is followed by something else than white space, and words repeat, so a text
is cut there and the ids of equal parts are looked up. What the table lacks of some texts' parts is found at once and cut
further, at places where the pattern always cuts too, and only words never met before reach the library's merge model,
many in a row, since no id reaches over the space between two words (``Words.apart`` looks for one that would). The
parts' ids joined are exactly the ids of the whole text (``tests/llm`` compares them with direct calls). Both tables
have a fixed capacity.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from itertools import compress, islice

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # one Spark task is one core

#: Unicode white space, as the byte-level pattern's \s has it; ASCII marks; letters of one or two bytes.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
MARKS = r"!-/:-@\[-`{-~"
LETTERS = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u017f"
#: White space but for its last character; letters before a mark or the end; digits likewise; else all to the next space.
PIECES = re.compile(
    f"[{SPACE}]+(?![^{SPACE}])| ?[{LETTERS}]+(?![^{SPACE}{MARKS}])| ?[0-9]+(?![^{SPACE}{MARKS}])"
    rf"| ?[!-&(-/:-@\[-`{{-~]+(?![^{SPACE}{LETTERS}0-9])| ?[^{SPACE}]+|[{SPACE}]"
)
#: Pieces that the pattern leaves whole.
WHOLE = re.compile(rf" ?(?:[{LETTERS}]+|[0-9]+|[!-&(-/:-@\[-`{{-~]+)\Z")
NAMES = re.compile(rf"[{LETTERS} ]*\Z")
#: Each of the parts joined by spaces: perhaps a line break, letters, marks; or else all to the next space.
FORMS = re.compile(rf"(\n?)([{LETTERS}]++)([!-&(-/:-@\[-`{{-~]*+)(?= |\Z)|([^ ]+)")
#: The same white space, character by character.
SPACES = frozenset(c for c in map(chr, range(0x3001)) if re.match(f"[{SPACE}]", c))
END_ID = 0
PARTS, WORDS, LONG, MET = 500_000, 100_000, 64, 1 << 22
ROW, HELD = 100, 1 << 22  # words in a call of the library; bytes of texts cut together


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> list[str]:
    """The character that stands for each byte: itself where it prints, else the next from U+0100 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Table(dict):
    """Look-up table of bounded size: the older half of a full one goes."""

    def __init__(self, entries: int):
        self.entries, self.met = entries, bytearray(MET)

    def keep(self, key: str, ids: bytes) -> bytes:
        """Enter a key when it comes a second time (or one that shares its mark): most words come once."""
        mark = hash(key) & (MET - 1)
        if not self.met[mark]:
            self.met[mark] = 1
        elif len(key) <= LONG:
            if len(self) >= self.entries:
                for old in list(islice(self, self.entries // 2)):
                    del self[old]
                self.met = bytearray(MET)
            self[key] = ids
        return ids


class Words(Table):
    """Piece to ids; asks the library for pieces not met before."""

    def __init__(self, tokenizer, letters: list[str]):
        super().__init__(WORDS)
        self.tokenizer, self.model = tokenizer, tokenizer.model
        # Every byte has an entry: str.translate raises and catches an error for each character that has none.
        self.letters = {i: ord(c) for i, c in enumerate(letters)}
        space, vocabulary = letters[32], tokenizer.get_vocab()
        self.opens = np.zeros(1 << 16, bool)
        self.opens[[i for t, i in vocabulary.items() if t.startswith(space)]] = True
        # The bytes of ``LETTERS``: ASCII letters, and two bytes for the others.
        word = "A-Za-z" + re.escape("".join(letters[0x80:0xC0] + letters[0xC3:0xC6]))
        over = re.compile(f"(?=.*[{word}]{space})[{word}{space}]+", re.DOTALL)
        #: Whether words in a row, each behind a space, have the ids that each has alone.
        plain = not any(getattr(self.model, k, None) for k in ("dropout", "ignore_merges", "continuing_subword_prefix", "end_of_word_suffix"))
        self.apart = plain and space in vocabulary and not any(map(over.fullmatch, vocabulary))

    def shown(self, piece: str) -> str:
        return piece if piece.isascii() and " " not in piece else piece.encode().decode("latin-1").translate(self.letters)

    def merged(self, shown: str) -> bytes:
        """Ids of one piece that the pattern leaves whole, given in the characters that stand for its bytes."""
        return array("H", [t.id for t in self.model.tokenize(shown)]).tobytes()

    def spaced(self, names: list[str]) -> list[bytes]:
        """Ids of words of ``LETTERS``, each with a space before it."""
        if not self.apart:
            return [self.merged(self.shown(" " + name)) for name in names]
        out = []
        for i in range(0, len(names), ROW):
            ids = np.array([t.id for t in self.model.tokenize(self.shown(" " + " ".join(names[i : i + ROW])))], "<u2")
            # Each word's first id is the one that shows its space.
            cuts, data = (np.flatnonzero(self.opens[ids]) * 2).tolist(), ids.tobytes()
            out += [data[a:b] for a, b in zip(cuts, [*cuts[1:], len(data)])]
        return out

    def __missing__(self, piece: str) -> bytes:
        if WHOLE.match(piece):
            ids = self.merged(self.shown(piece))
        else:
            ids = array("H", self.tokenizer.encode(piece, add_special_tokens=False).ids).tobytes()
        return self.keep(piece, ids)


class Parts:
    """What follows a space or stands from a line break on, up to the next of them, to ids (of the space too)."""

    def __init__(self, words: Words):
        self.words, self.known, self.met = words, {}, np.zeros(MET, bool)

    def of(self, parts: list[str]) -> list[bytes | None]:
        """Ids of each of different parts; None for white space that does not begin a word."""
        out = list(map(self.known.get, parts))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        new = [parts[i] for i in gaps]
        found = self.cut(new)
        for i, ids in zip(gaps, map(found.get, new)):
            out[i] = ids
        self.keep(found)
        return out

    def cut(self, new: list[str]) -> dict[str, bytes]:
        """Ids of parts that the table lacks, and of the words in them."""
        known, words = self.known, self.words
        plain = list(filter(str.isalpha, new))
        if not NAMES.match(" ".join(plain)):
            plain = [part for part in plain if NAMES.match(part)]
        rest = list(set(new).difference(plain, [""]))
        forms = FORMS.findall(" ".join(rest))
        names = [*plain, *{name for line, name, _, _ in forms if name and not line}.difference(known, plain)]
        found = dict(zip(names, words.spaced(names), strict=True))
        for part, (line, name, marks, other) in zip(rest, forms, strict=True):
            if line:
                found[part] = words["\n"] + words[name] + (words[marks] if marks else b"")
            elif marks:
                found[part] = (known.get(name) or found[name]) + words[marks]
            elif other[0] not in SPACES:
                found[part] = b"".join(map(words.__getitem__, PIECES.findall(" " + part)))
            elif other[0] == "\n" and other[1:] and other[1] not in SPACES:
                found[part] = b"".join(map(words.__getitem__, PIECES.findall(part)))
        return found

    def keep(self, found: dict[str, bytes]) -> None:
        """Most words come once: a part is entered when it is looked for a second time (or one that shares its mark)."""
        n, known = len(found), self.known
        marks = np.fromiter(map(hash, found), np.int64, n) & (MET - 1)
        stay = self.met[marks] & (np.fromiter(map(len, found), np.int64, n) <= LONG)
        self.met[marks] = True
        known.update(compress(found.items(), stay.tolist()))
        if len(known) > PARTS:
            for old in list(islice(known, len(known) // 2)):
                del known[old]
            self.met[:] = False


class Encoder:
    """Whole texts to ids."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.size = self.tokenizer.get_vocab_size()
        if self.size > 1 << 16:
            raise ValueError("ids do not fit 16 bits")
        with open(path, encoding="utf-8") as f:
            plan = json.load(f)
        cut = plan.get("pre_tokenizer") or {}
        #: Whether the file has the pattern that the cuts above rely on, and nothing that changes texts before it.
        self.splits = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not plan.get("normalizer")
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.tokenizer.model._resize_cache(0)  # the tables below take its place
        self.words = Words(self.tokenizer, byte_letters())
        self.parts = Parts(self.words)

    def direct(self, texts: list[str]) -> list[bytes]:
        got = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [array("H", e.ids).tobytes() for e in got]

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self.words.__getitem__, PIECES.findall(text)))

    def some(self, texts) -> list[bytes]:
        """Ids of an array of texts that are cut and looked up together; each different part is looked up once."""
        import pyarrow as pa
        import pyarrow.compute as pc

        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        parts = cut.flatten().dictionary_encode()
        ids = self.parts.of(parts.dictionary.to_numpy(False).tolist())
        # What stands before the first cut follows no space.
        starts = cut.offsets.to_numpy()
        which, begin = parts.indices.to_numpy().astype(np.int64), starts[:-1]
        which[begin] = len(ids) + np.arange(len(texts))
        ids += map(self.pieces, pc.list_element(cut, 0).to_pylist())
        taken = pa.array(ids, pa.large_binary()).take(pa.array(which))
        ends = np.frombuffer(taken.buffers()[1], np.int64)[starts].tolist()
        data = memoryview(taken.buffers()[2] or b"")
        out = [bytes(data[a:b]) for a, b in zip(ends, ends[1:])]
        if taken.null_count:  # a space or line break that does not begin a word
            for k in set((np.searchsorted(begin, np.flatnonzero(taken.is_null().to_numpy(False)), "right") - 1).tolist()):
                out[k] = self.pieces(texts[k].as_py())
        for special in self.special:
            for k in np.flatnonzero(pc.match_substring(texts, special).to_numpy(False)).tolist():
                out[k] = self.direct([texts[k].as_py()])[0]
        return out

    def encode(self, texts) -> list[bytes]:
        """Ids of each text of a list or array; a null counts as empty. Texts holding a special token's string go whole to the library."""
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = (texts if isinstance(texts, pa.Array) else pa.array(texts, pa.large_string())).cast(pa.large_string()).fill_null("")
        if not self.splits:
            return self.direct(texts.to_pylist())
        size = np.cumsum(pc.binary_length(texts).to_numpy(False)) // HELD
        cuts = [0, *(np.flatnonzero(np.diff(size)) + 1).tolist(), len(texts)]
        return [ids for a, b in zip(cuts, cuts[1:]) if a < b for ids in self.some(texts.slice(a, b - a))]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per worker process and vocabulary."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct 16-bit ids, ascending, and how often each occurs."""
    s = np.sort(ids, kind="stable")  # a radix sort for 16 bits
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]])) if len(s) else np.zeros(0, np.int64)
    return s[first], np.diff(np.append(first, len(s)))


def counts_of(ids: list[np.ndarray]) -> np.ndarray:
    """How often each id occurs in these arrays."""
    return np.bincount(np.concatenate(ids), minlength=1 << 16)


def token_table(docs, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", signature: bool = False, counts: bool = False):
    """(doc_id, n_tokens, ids) of every whole text, the end id appended; null text counts as empty.

    ``signature`` adds ``route``: 32 sign bits of a fixed random projection of the text's distinct ids, so texts with
    similar vocabulary tend to sort near each other. With ``counts``, ids are counted in the same pass (with a signature the
    texts that hold them): a task's sums follow its texts as one more row with n_tokens -1, which ``counted`` takes off.
    """
    import pyarrow as pa
    from pyspark.sql import functions as F

    schema = "doc_id long, n_tokens long, ids binary" + (", route long" if signature else "")
    names = ["doc_id", "n_tokens", "ids", "route"][: 4 if signature else 3]
    end = np.array([END_ID], "<u2").tobytes()

    def run(batches):
        enc, total = encoder(vocabulary), np.zeros(1 << 16, np.int64)
        signs = np.random.default_rng(42).integers(0, 2, (enc.size, 32), np.int8) * 2 - 1 if signature else None
        for batch in batches:
            for i in range(0, batch.num_rows, 800):
                part = batch.slice(i, 800)
                ids = [b + end for b in enc.encode(part.column(1))]
                cols = [part.column(0), pa.array([len(b) // 2 for b in ids], pa.int64()), pa.array(ids, pa.binary())]
                arrays = [np.frombuffer(b, "<u2") for b in ids]
                if signature:
                    arrays = [distinct(x)[0] for x in arrays]
                if counts and arrays:
                    total += counts_of(arrays)
                if signature:
                    marks = [signs[x].sum(axis=0, dtype=np.int32) > 0 for x in arrays]
                    packed = np.packbits(np.array(marks), axis=1).view(">u4").ravel() if marks else np.zeros(0)
                    cols.append(pa.array(packed.astype(np.int64)))
                yield pa.RecordBatch.from_arrays(cols, names)
        if total.any():
            row = [pa.array([None], pa.int64()), pa.array([-1]), pa.array([total.astype("<i8").tobytes()], pa.binary()), pa.array([0])]
            yield pa.RecordBatch.from_arrays(row[: len(names)], names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def counted(table, name: str):
    """The written token table, and its counts over all texts: a number per id of the vocabulary at the driver."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from branchwise.session import stored

    def run(batches):
        total = np.zeros(1 << 16, np.int64)
        for b in batches:
            for data in b.column(0).to_pylist():
                total += np.frombuffer(data, "<i8")
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], ["id", "n"])

    written = stored(table, name)
    out = np.zeros(1 << 16, np.int64)
    sums = written.where("n_tokens = -1").select("ids").mapInArrow(run, "id long, n long")
    for r in sums.groupBy("id").agg(F.sum("n").alias("n")).collect():
        out[r["id"]] = r["n"]
    return written.where("n_tokens >= 0"), out
