"""Token ids in binary files, coded by a static range asymmetric numeral system.

The ids of a corpus are counted once; the counts, scaled to ``2 ** SCALE``, are the one frequency table that all files
share. Documents are range-sorted by id, a file per range; a file is a row of blocks of at most ``BLOCK`` ids, which
are coded apart from each other, so any block can be decoded alone. Within a block ids are dealt in turn to up to
``LANES`` coders whose 32-bit words are interleaved in one stream; numpy steps all lanes at once. Every
``INTERVAL`` steps a checkpoint holds the lanes' states and the place in the stream, so decoding can begin there, too.

Layout, all numbers little-endian. ``table.rans``: ``TABLE``, the table's ids and frequencies (deflated), checksum.
``part-NNNNNN.rans``: ``MAGIC`` and the table's checksum, blocks, then one ``INDEX`` row per block and ``FOOT``. A block:
``HEAD``, the directory of its documents (deflated), per checkpoint its place, the checksum of the ids up to the next one and the states,
the words, checksum of all that. A document may go on over any number of blocks, but not over files.
"""

from __future__ import annotations

import functools
import os
import posixpath
import re
import struct
import uuid
import zlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from tsquorum.llm.common import Cuts, fresh_path, released
from tsquorum.llm.warc import _file

END_ID = 2
#: Bits of the scaled frequencies; a table has at most half as many ids as 2 ** SCALE.
SCALE = 20
BLOCK, LANES, INTERVAL = 1 << 20, 1024, 256
#: Ids of a file, about; there are at least as many files as shuffle partitions.
FILE_IDS = 1 << 26
#: Words whose ids a worker remembers; bounds its memory.
CACHED_WORDS = 800_000

LOW = 1 << 31
MAGIC, TABLE = b"TOKRANS1", "<8sIII"
HEAD, INDEX, FOOT = "<4sIIHHQQIIII", "<QQQQ", "<QQI8s"
CONTINUES, CONTINUED = 1, 2


class TokenFileError(ValueError):
    """A file that doesn't hold what it says."""


# --- the tokenizer -------------------------------------------------------------------------------------------------

_STOPS = re.compile(r" \x01(?<![^\W_] \x01)")
#: A word whose ends are white space by no definition.
_SOLID = re.compile(r"(?s)[!-~\w](.*[!-~\w])?\Z")
#: A word of letters, digits and marks (but apostrophes, which may lead an ending), and its runs of one kind, which are tokens before merging.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ɏ]+\Z")
_RUNS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ɏ]+|[0-9]+|[!-&(-/:-@\[-`{-~]+")


def _byte_letters() -> dict[int, str]:
    """The printable stand-ins of byte-level vocabularies: printable bytes for themselves, the others from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}


class ByteTokenizer:
    """A byte-level tokenizer with a memory of words, for the ids of whole texts.

    Its splitting starts a new token at each blank or line end after other characters, and a line end alone is one token;
    so the stretches between them are encoded one by one. Texts with other white space at their ends, or with the string of
    an added token, are encoded whole, by the tokenizer as it is. So is every text if the tokenizer splits otherwise.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        line = self.plain.encode("\n", add_special_tokens=False).ids
        self.line = line[0] if len(line) == 1 else -1
        probe = "Some plain words, été À Öl.\nAnother's line: 12 of 34, end x9.87###"
        self.known: dict[str, bytes] = {}
        self.splits = "ByteLevel(add_prefix_space=False" in str(self.plain.pre_tokenizer) and self.plain.normalizer is None and self._joined(self._words(probe)) == self._whole(probe)

    def _whole(self, text: str) -> bytes:
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _joined(self, words: list[str]) -> bytes:
        self._learn(words)
        return b"".join(map(self.known.__getitem__, words))

    def _learn(self, words: list[str]) -> None:
        """Ids of words: plain ones follow a blank, ``\\n`` leads those after a line end (with its id), ``\\x01`` those after neither.

        Words that begin or end with what may be white space have none.
        """
        known, letters, tokenize = self.known, self.letters, self.plain.model.tokenize
        blank = letters[32]
        others: dict[str, list[str]] = {" ": [], "": []}
        for w in words:
            lead = w[:1] if w[:1] in ("\n", "\x01") else ""
            if w.isascii() and w.isalpha():
                known[w] = array("I", [t.id for t in tokenize(blank + w)]).tobytes()
            elif _PLAIN.match(w, len(lead)):
                runs = _RUNS.findall(w, len(lead))
                if not lead:
                    runs[0] = " " + runs[0]
                ids = [t.id for run in runs for t in tokenize(run if run.isascii() and run[0] != " " else run.encode().decode("latin-1").translate(letters))]
                known[w] = array("I", [self.line, *ids] if lead == "\n" else ids).tobytes()
            elif _SOLID.match(w, len(lead)):
                others["" if lead else " "].append(w)
            else:
                known[w] = b""
        line = np.uint32(self.line).tobytes()
        for lead, kind in others.items():
            for lo in range(0, len(kind), 500):
                some = kind[lo : lo + 500]
                ids = np.array(self.plain.encode("\n".join([lead + (w if lead else w[1:]) for w in some]), add_special_tokens=False).ids, "<u4")
                ends = np.append(np.flatnonzero(ids == self.line), len(ids)).tolist()
                start = 0
                for w, end in zip(some, ends, strict=True):
                    known[w] = (line if w[0] == "\n" else b"") + ids[start:end].tobytes()
                    start = end + 1

    def _marked(self, text: str) -> str:
        """The text with a blank between any two words, led as ``_learn`` says."""
        lined = text.replace("\n", " \n")
        apart = lined.replace(". ", " \x01. ").replace(", ", " \x01, ")
        return "\x01" + (lined if _STOPS.search(apart) else apart)

    def _words(self, text: str) -> list[str]:
        return self._marked(text).split(" ")

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text. Each different word of all texts is looked up once; the rest is arithmetic on its places."""
        out: list[np.ndarray | None] = [None] * len(texts)
        plain = [k for k, t in enumerate(texts) if self.splits and t and "\x01" not in t and not any(a in t for a in self.added)]
        if plain:
            split = pc.split_pattern(pa.array([self._marked(texts[k]) for k in plain], pa.large_string()), " ")
            coded = split.flatten().dictionary_encode()
            words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
            found = list(map(self.known.get, words))
            new = [k for k, x in enumerate(found) if x is None]
            self._learn([words[k] for k in new])
            full = len(self.known) > CACHED_WORDS
            for k in new:
                found[k] = self.known.pop(words[k]) if full else self.known[words[k]]
            ids = np.frombuffer(b"".join(found), "<u4")
            sizes = np.fromiter(map(len, found), np.int64, len(found)) // 4
            at = coded.indices.to_numpy()
            n = np.take(sizes, at)
            before = np.cumsum(n) - n
            ids = np.take(ids, np.repeat(np.take(np.cumsum(sizes) - sizes, at) - before, n) + np.arange(n.sum()))
            firsts = split.offsets.to_numpy()[:-1]
            odd = np.logical_or.reduceat(n == 0, firsts).tolist()  # texts with a word without ids
            for k, own, whole in zip(plain, np.split(ids, before[firsts[1:]]), odd, strict=True):
                if not whole:
                    out[k] = own
        return [np.frombuffer(self._whole(t), "<u4") if own is None else own for own, t in zip(out, texts, strict=True)]


_tokenizers: dict[str, ByteTokenizer] = {}


def _tokenizer(path: str) -> ByteTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = ByteTokenizer(path)
    return _tokenizers[path]


# --- the coder -----------------------------------------------------------------------------------------------------


@dataclass
class Frequencies:
    """Scaled frequencies of the ids that occur, ascending, and their running sums."""

    ids: np.ndarray
    freq: np.ndarray

    def __post_init__(self) -> None:
        self.cum = np.cumsum(self.freq) - self.freq
        top = int(self.ids[-1]) + 1 if len(self.ids) else 0
        self.place = np.full(top, -1, np.int64)
        self.place[self.ids] = np.arange(len(self.ids))

    @functools.cached_property
    def slots(self) -> np.ndarray:
        """By slot: frequency of its id, its place among that id's slots, and place of the id, in 64 bits."""
        of = np.repeat(np.arange(len(self.ids)), self.freq)
        return (self.freq[of] << 2 * SCALE | np.arange(len(of)) - self.cum[of] << SCALE | of).astype(np.uint64)

    @classmethod
    def of_counts(cls, ids: np.ndarray, counts: np.ndarray) -> Frequencies:
        """Each id seen keeps a frequency of 1 at least; the sum is ``2 ** SCALE``."""
        if len(ids) > 1 << (SCALE - 1):
            raise ValueError(f"{len(ids)} different ids; the table holds {1 << (SCALE - 1)}")
        order = np.argsort(ids)
        ids, counts = np.asarray(ids, np.int64)[order], np.asarray(counts, np.float64)[order]
        freq = np.maximum(1, np.floor(counts / max(1.0, counts.sum()) * (1 << SCALE))).astype(np.int64)
        rest = (1 << SCALE) - int(freq.sum()) if len(ids) else 0
        for k in np.argsort(-freq, kind="stable"):
            if not rest:
                break
            step = max(rest, 1 - int(freq[k]) // 2) if rest < 0 else rest
            freq[k] += step
            rest -= step
        return cls(ids, freq)

    def to_bytes(self) -> bytes:
        body = zlib.compress(self.ids.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes())
        head = struct.pack(TABLE, MAGIC, SCALE, len(self.ids), len(body))
        return head + body + struct.pack("<I", zlib.crc32(head + body))

    @classmethod
    def from_bytes(cls, data: bytes) -> Frequencies:
        if len(data) < struct.calcsize(TABLE) + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
            raise TokenFileError("the table doesn't have its checksum")
        magic, scale, n, size = struct.unpack_from(TABLE, data)
        if magic != MAGIC or scale != SCALE or size != len(data) - struct.calcsize(TABLE) - 4:
            raise TokenFileError("not a table of this format")
        numbers = np.frombuffer(zlib.decompress(data[struct.calcsize(TABLE) : -4]), "<u4").astype(np.int64)
        return cls(numbers[:n], numbers[n:])


def _lanes(n: int) -> int:
    return max(1, min(LANES, n >> 8))


def encode_ids(ids: np.ndarray, table: Frequencies) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray]]]:
    """The words, and per checkpoint (place in the words, checksum of its ids, states of the lanes), for at least one id."""
    at = np.take(table.place, ids)
    freq, cum = np.take(table.freq.astype(np.uint64), at), np.take(table.cum.astype(np.uint64), at)
    lanes = _lanes(len(ids))
    steps = -(-len(ids) // lanes)
    state, out, marks = np.full(lanes, LOW, np.uint64), [], []
    limit, rest, half = freq << np.uint64(63 - SCALE), np.uint64(1 << SCALE) - freq, np.uint64(32)
    for step in range(steps - 1, -1, -1):
        here = slice(step * lanes, (step + 1) * lanes)
        f = freq[here]
        x = state[: len(f)]
        over = x >= limit[here]
        out.append(x[over].astype(np.uint32))  # the low 32 bits
        np.right_shift(x, half, out=x, where=over)
        q = x // f
        q *= rest[here]
        x += q  # the quotient times 2 ** SCALE, and the remainder
        x += cum[here]
        if step % INTERVAL == 0:
            marks.append((step, len(out), state.copy()))
    sizes = np.cumsum([len(w) for w in out])
    words = np.concatenate(out[::-1])
    raw = ids.astype("<u4")
    return words, [(int(sizes[-1] - sizes[n - 1]), zlib.crc32(raw[step * lanes : (step + INTERVAL) * lanes]), x) for step, n, x in reversed(marks)]


def decode_ids(words: np.ndarray, marks: list[tuple[int, int, np.ndarray]], n: int, table: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids from checkpoint ``first`` up to checkpoint ``last`` (default: the end) of a block of ``n``; each part is held against its checksum."""
    lanes = _lanes(n)
    steps = -(-n // lanes)
    last = len(marks) if last is None else last
    parts, mask, scale, half = [], np.uint64((1 << SCALE) - 1), np.uint64(SCALE), np.uint64(32)
    twice, slots, words = np.uint64(2 * SCALE), table.slots, words.astype(np.uint64)
    state, place = marks[first][2].copy(), marks[first][0]
    for k in range(first, last):
        if place != marks[k][0] or not np.array_equal(state, marks[k][2]):
            raise TokenFileError("a checkpoint isn't what decoding comes to")
        found = []
        for step in range(k * INTERVAL, min((k + 1) * INTERVAL, steps)):
            x = state[: min(lanes, n - step * lanes)]
            code = np.take(slots, (x & mask).view(np.int64))
            x = (x >> scale) * (code >> twice) + (code >> scale & mask)
            low = np.flatnonzero(x < LOW)
            if place + len(low) > len(words):
                raise TokenFileError("the words end early")
            x[low] = (x[low] << half) | words[place : place + len(low)]
            place += len(low)
            state[: len(x)] = x
            found.append(code)
        ids = np.take(table.ids.astype("<u4"), (np.concatenate(found) & mask).view(np.int64))
        if zlib.crc32(ids) != marks[k][1]:
            raise TokenFileError("ids don't have their checksum")
        parts.append(ids)
    if last == len(marks) and (place != len(words) or (state != LOW).any()):
        raise TokenFileError("decoding doesn't end where encoding began")
    return np.concatenate(parts) if parts else np.zeros(0, "<u4")


# --- blocks and files ----------------------------------------------------------------------------------------------


@dataclass
class Block:
    """A decoded block: its documents' ids (None: null), their numbers of ids here, and where it lies in the file."""

    doc_ids: list[int | None]
    counts: np.ndarray
    ids: np.ndarray
    first_id: int
    first_doc: int
    continues: bool
    continued: bool


def block_bytes(doc_ids: list[int | None], counts: list[int], ids: np.ndarray, table: Frequencies, first_id: int = 0, first_doc: int = 0, continues: bool = False, continued: bool = False) -> bytes:
    words, marks = encode_ids(ids, table)
    keys = np.array([d or 0 for d in doc_ids], "<i8").tobytes() + np.array([d is None for d in doc_ids], np.uint8).tobytes() + np.array(counts, "<u4").tobytes()
    listed = zlib.compress(keys, 1)
    points = b"".join(struct.pack("<II", place, crc) + x.astype("<u8").tobytes() for place, crc, x in marks)
    head = struct.pack(HEAD, b"BLCK", len(ids), len(doc_ids), len(marks), CONTINUES * continues | CONTINUED * continued, first_id, first_doc, len(listed), len(words), _lanes(len(ids)), INTERVAL)
    body = head + listed + points + words.astype("<u4").tobytes()
    return body + struct.pack("<I", zlib.crc32(body))


def read_block(data: bytes, table: Frequencies) -> Block:
    if len(data) < struct.calcsize(HEAD) + 4 or zlib.crc32(data[:-4]) != struct.unpack("<I", data[-4:])[0]:
        raise TokenFileError("a block doesn't have its checksum")
    magic, n, n_docs, n_marks, flags, first_id, first_doc, listed, n_words, lanes, interval = struct.unpack_from(HEAD, data)
    if magic != b"BLCK" or lanes != _lanes(n) or interval != INTERVAL:
        raise TokenFileError("not a block of this format")
    keys = zlib.decompress(data[struct.calcsize(HEAD) : struct.calcsize(HEAD) + listed])
    ids, nulls, counts = np.frombuffer(keys, "<i8", n_docs), np.frombuffer(keys, np.uint8, n_docs, 8 * n_docs), np.frombuffer(keys, "<u4", n_docs, 9 * n_docs)
    at, marks = struct.calcsize(HEAD) + listed, []
    for _ in range(n_marks):
        place, crc = struct.unpack_from("<II", data, at)
        marks.append((place, crc, np.frombuffer(data, "<u8", lanes, at + 8)))
        at += 8 + 8 * lanes
    words = np.frombuffer(data, "<u4", n_words, at)
    doc_ids = [None if null else d for d, null in zip(ids.tolist(), nulls.tolist(), strict=True)]
    return Block(doc_ids, counts.astype(np.int64), decode_ids(words, marks, n, table), first_id, first_doc, bool(flags & CONTINUES), bool(flags & CONTINUED))


class _Blocks:
    """Gathers documents until a block is full; long documents go on in the next one."""

    def __init__(self, table: Frequencies, size: int) -> None:
        self.table, self.size = table, size
        self.first_id = self.first_doc = self.held = 0
        self.doc_ids, self.parts, self.continues = [], [], False

    def _close(self, continued: bool) -> tuple[bytes, int, int]:
        n = self.held
        data = block_bytes(self.doc_ids, [len(p) for p in self.parts], np.concatenate(self.parts), self.table, self.first_id, self.first_doc, self.continues, continued)
        done = data, self.first_id, n
        self.first_id += n
        self.first_doc += len(self.doc_ids) - continued
        self.doc_ids, self.parts, self.held, self.continues = [], [], 0, continued
        return done

    def add(self, doc_id: int | None, ids: np.ndarray) -> Iterator[tuple[bytes, int, int]]:
        while True:
            part = ids[: self.size - self.held]
            self.doc_ids.append(doc_id)
            self.parts.append(part)
            self.held += len(part)
            ids = ids[len(part) :]
            if self.held == self.size:
                yield self._close(len(ids) > 0)
            if not len(ids):
                return

    def rest(self) -> Iterator[tuple[bytes, int, int]]:
        if self.held:
            yield self._close(False)


_TOKENIZED = "doc_id bigint, row bigint, n bigint, ids binary"


def _tokenized(docs: DataFrame, tokenizer_path: str, id_col: str, text_col: str, end_id: int) -> DataFrame:
    """The rows of ``tokenized``, and per partition one that has in ``counts`` alone how often each id occurs in it: all ids, then all numbers."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} must be an integer")
    names = [c.split()[0] for c in _TOKENIZED.split(", ")] + ["counts"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        total = np.zeros(0, np.int64)
        for whole in batches:
            for lo in range(0, whole.num_rows, 1024):
                batch = whole.slice(lo, 1024)
                rows = [np.append(ids, np.uint32(end_id)) for ids in tokenizer.encode_all([t or "" for t in batch.column(2).to_pylist()])]
                more = np.bincount(np.concatenate(rows), minlength=len(total))
                more[: len(total)] += total
                total = more
                packed = [_packed(ids) for ids in rows]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(ids) for ids in rows], pa.int64()), pa.array(packed, pa.binary()), pa.nulls(len(rows), pa.binary())], names)
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary()), pa.array([np.concatenate([some, total[some]]).astype("<i8").tobytes()], pa.binary())], names)

    slim = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("row"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(released(run), _TOKENIZED + ", counts binary")


def tokenized(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID) -> DataFrame:
    """(doc_id, row, n, ids): each document's ids and ``end_id`` as compressed 32-bit numbers, rows numbered in table order."""
    return _tokenized(docs, tokenizer_path, id_col, text_col, end_id).where("counts IS NULL").drop("counts")


def _packed(ids: np.ndarray) -> bytes:
    """Two bytes an id where that is enough, deflated by the fastest level of zstandard."""
    narrow = ids.max() < 1 << 16
    data = ids.astype("<u2" if narrow else "<u4").tobytes()
    return (b"2" if narrow else b"4") + len(data).to_bytes(8, "little") + pa.compress(data, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    raw = pa.decompress(data[9:], int.from_bytes(data[1:9], "little"), codec="zstd", asbytes=True)
    return np.frombuffer(raw, "<u2" if data[:1] == b"2" else "<u4")


def _counted(ids: DataFrame) -> DataFrame:
    """(id, n): how often each id occurs, from the ``counts`` of ``_tokenized``; summed up by partition before it is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            for data in batch.column(0):
                some, n = np.frombuffer(data.as_py(), "<i8").reshape(2, -1)
                total = np.append(total, np.zeros(max(0, int(some[-1]) + 1 - len(total)), np.int64))
                total[some] += n
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(total[some], pa.int64())], ["id", "n"])

    return ids.where("counts IS NOT NULL").select("counts").mapInArrow(released(run), "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n"))


def write_token_files(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, folder: str | None = None, block: int = BLOCK) -> tuple[str, DataFrame]:
    """Writes the ids of all documents, in ascending order of their ids, and returns (folder, files).

    ``files`` has (part, path, n_docs, n_ids), a row per file; files follow each other by part. Null text is empty and has ``end_id`` alone;
    null ids come first; rows with one id keep the order of the table. Ids must be integers. A text of any length is written whole, over as many blocks as
    it needs. An empty table gives a table of frequencies and no files. Other columns aren't read.

    A task writes under a name of its own and renames it when complete, so a repeated task leaves one file. The ids
    are counted as they are written to the shared folder, once, before they are sorted, and deleted when the files are there.
    """
    spark = docs.sparkSession
    cuts = Cuts(spark)
    folder = folder or fresh_path(spark, "tokens")
    ids = cuts.cut(_tokenized(docs, tokenizer_path, id_col, text_col, end_id), "ids")
    counts = _counted(ids).toArrow()  # a row per id of the vocabulary at most
    table = Frequencies.of_counts(counts.column(0).to_numpy(), counts.column(1).to_numpy())
    data = table.to_bytes()
    store, root = _file(folder)
    store.create_dir(root, recursive=True)
    with store.open_output_stream(posixpath.join(root, "table.rans"), compression=None) as out:
        out.write(data)
    mark = data[-4:]
    shared = spark.sparkContext.broadcast(data)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _file(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}.rans"
        own, final = posixpath.join(root, f".{name}.{uuid.uuid4().hex}"), posixpath.join(root, name)
        index, at, n_docs, out, blocks = [], len(MAGIC) + 4, 0, None, None
        try:
            for batch in batches:
                for doc_id, packed in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    if out is None:
                        out, blocks = store.open_output_stream(own, compression=None), _Blocks(Frequencies.from_bytes(shared.value), block)
                        out.write(MAGIC + mark)
                    n_docs += 1
                    for made, first, n in blocks.add(doc_id, _unpacked(packed.as_py())):
                        out.write(made)
                        index.append((at, len(made), first, n))
                        at += len(made)
            if out is None:
                return
            for made, first, n in blocks.rest():
                out.write(made)
                index.append((at, len(made), first, n))
                at += len(made)
            listed = b"".join(struct.pack(INDEX, *row) for row in index)
            out.write(listed + struct.pack(FOOT, len(index), n_docs, zlib.crc32(listed), MAGIC))
        finally:
            if out is not None:
                out.close()
        store.move(own, final)
        yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([posixpath.join(folder, name)]), pa.array([n_docs], pa.int64()), pa.array([sum(r[3] for r in index)], pa.int64())], ["part", "path", "n_docs", "n_ids"])

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), int(counts.column(1).to_numpy().sum()) // FILE_IDS + 1)
    dealt = ids.where("counts IS NULL").select("doc_id", "row", "ids").repartitionByRange(parts, "doc_id", "row").sortWithinPartitions("doc_id", "row").select("doc_id", "ids")
    files = cuts.cut(dealt.mapInArrow(released(run), "part int, path string, n_docs bigint, n_ids bigint"), "files")
    cuts.drop("ids")
    return folder, files


def blocks_of(files: DataFrame) -> DataFrame:
    """(part, path, offset, size): where the blocks of the files lie, from the files' ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, path in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                store, at = _file(path)
                with store.open_input_file(at) as source:
                    if source.size() < len(MAGIC) + 4 + struct.calcsize(FOOT):
                        raise TokenFileError("the file is too short")
                    source.seek(source.size() - struct.calcsize(FOOT))
                    n, _, crc, magic = struct.unpack(FOOT, source.read(struct.calcsize(FOOT)))
                    if magic != MAGIC or struct.calcsize(FOOT) + n * struct.calcsize(INDEX) > source.size():
                        raise TokenFileError("the file doesn't end as it must")
                    source.seek(source.size() - struct.calcsize(FOOT) - n * struct.calcsize(INDEX))
                    listed = source.read(n * struct.calcsize(INDEX))
                if zlib.crc32(listed) != crc:
                    raise TokenFileError("the index doesn't have its checksum")
                rows = list(struct.iter_unpack(INDEX, listed))
                yield pa.RecordBatch.from_arrays([pa.array([part] * n, pa.int32()), pa.array([path] * n), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], ["part", "path", "offset", "size"])

    named = files.select("part", "path")
    return named.repartition(int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))).mapInArrow(run, "part int, path string, offset bigint, size bigint")


PIECES = "part int, doc bigint, doc_id bigint, at bigint, n bigint, crc bigint, whole boolean"


def read_pieces(spark: SparkSession, folder: str, files: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """A row per document and block: (part, doc: number in the file, doc_id, at: ids before it in the file, n, crc, whole, and ids if asked for).

    Blocks are decoded independently of each other, and checked: framing, table, order of documents, checksums. Damage raises TokenFileError.
    """
    store, root = _file(folder)
    with store.open_input_file(posixpath.join(root, "table.rans")) as source:
        data = source.read()
    Frequencies.from_bytes(data)
    shared = spark.sparkContext.broadcast(data)
    names = [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None
        for batch in batches:
            table = table or Frequencies.from_bytes(shared.value)
            for part, path, offset, size in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                store, at = _file(path)
                with store.open_input_file(at) as source:
                    if source.read(len(MAGIC) + 4) != MAGIC + shared.value[-4:]:
                        raise TokenFileError("not a file of this table")
                    source.seek(offset)
                    block = read_block(source.read(size), table)
                ends = np.cumsum(block.counts)
                starts = ends - block.counts
                parts = [block.ids[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                whole = np.ones(len(parts), bool)
                whole[0] &= not block.continues
                whole[-1] &= not block.continued
                k = len(parts)
                columns = [
                    pa.array([part] * k, pa.int32()), pa.array(block.first_doc + np.arange(k), pa.int64()), pa.array(block.doc_ids, pa.int64()), pa.array(block.first_id + starts, pa.int64()),
                    pa.array(block.counts, pa.int64()), pa.array([zlib.crc32(p) for p in parts], pa.int64()), pa.array(whole),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(block.ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    blocks = blocks_of(files)
    spread = blocks.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path", "offset")
    return spread.mapInArrow(released(run), PIECES + ", ids array<int>" * with_ids)


def crc_joined(first: int, second: int, n: int) -> int:
    """The CRC-32 of two stretches in a row from those of each; the second has ``n`` bytes."""

    def times(a: int, b: int) -> int:
        """Product of two polynomials, bits reversed, modulo that of CRC-32."""
        out = 0
        for k in range(31, -1, -1):
            if b >> k & 1:
                out ^= a
            a = a >> 1 ^ (0xEDB88320 if a & 1 else 0)
        return out

    power, square = 1 << 31, 1 << 23  # x ** 0, x ** 8
    while n:
        if n & 1:
            power = times(square, power)
        square, n = times(square, square), n >> 1
    return times(first, power) ^ second


def documents_of(pieces: DataFrame, files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) per document written: ids before it in all files, ids, and their checksum.

    Documents over several blocks are put together from their pieces' lengths and checksums.
    """
    base = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    before = files.select("part", F.coalesce(F.sum("n_ids").over(base), F.lit(0)).alias("before"))
    slim = pieces.select("part", "doc", "doc_id", "at", "n", "crc", "whole")
    listed = F.array_sort(F.collect_list(F.struct("at", "n", "crc")))  # a piece per 2 ** 20 ids
    cut = slim.where("not whole").groupBy("part", "doc").agg(F.max("doc_id").alias("doc_id"), F.min("at").alias("at"), F.sum("n").alias("n"), listed.alias("pieces"))
    joined = F.udf(_all_joined, "bigint", useArrow=True)
    cut = cut.select("part", "doc_id", "at", "n", joined("pieces").alias("crc"))
    found = slim.where("whole").select("part", "doc_id", "at", "n", "crc").unionByName(cut)
    return found.join(before, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))


def _all_joined(pieces) -> int:
    crc = 0
    for _, n, more in pieces:
        crc = crc_joined(crc, more, 4 * n)
    return crc
