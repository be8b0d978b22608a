"""Best-fit packing of tokenized documents into sequences, bulk-synchronously.

Documents are cut into pieces of at most ``capacity`` tokens. Pieces and gaps of open sequences are sorted by
size. Rounds go from the longest pieces down; a round takes all pieces of one length at once, sweeps the gaps
upwards from that length (the successor is the tightest gap that fits), resolves who gets which gap by rank,
updates the gaps, and sweeps again until the pieces are placed; only what finds no gap opens new sequences.

Pieces of one length, and sequences with one gap, differ only in their rank. So a round needs only the number of
pieces of each length, and its result is a list of runs: pieces of rank a.. of this length go to sequences b..
at one offset. There are at most ``capacity`` lengths, whatever the input, so the runs come from a bounded table;
the ranks and the matching of each piece with its sequence are distributed.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquorum.llm.common import Cuts, chunks_for, ranked, released

CAPACITY = 2048
#: Words whose ids a worker remembers; bounds its memory.
CACHED_WORDS = 500_000

#: A character whose token can come from no other text; words that hold it are encoded one by one.
BORDER = "\x01"

_tokenizers: dict[str, WordTokenizer] = {}


_JOINED = re.compile(r"[.,](?<![^\W_][.,])(?=[ \n]|\Z)")


def _plain(text: str) -> str:
    """A text with the same ids and fewer different words: A-Z lower-cased, single stops and commas set apart.

    The tokenizer composes, then lower-cases, so A-Z may come first where the text is composed either way. A stop
    after a letter or digit and before a blank is a token of its own anyway; texts with longer runs stay as they are.
    """
    lower = text.encode().lower().decode()
    if not text.isascii() and ("\u0130" in text or not (unicodedata.is_normalized("NFC", text) and unicodedata.is_normalized("NFC", lower))):
        return text  # U+0130 alone gets a mark when lower-cased
    if _JOINED.search(lower):
        return lower
    for mark in ".,":
        lower = lower.replace(f"{mark} ", f" {mark} ").replace(f"{mark}\n", f" {mark}\n")
    return lower[:-1] + " " + lower[-1] if lower[-1:] in {".", ","} else lower


class WordTokenizer:
    """A public word-level tokenizer with a bounded memory of words already encoded.

    The tokenizer never joins text across blanks or newlines, so encoding the stretches between them one by one
    gives the ids of the whole text. Texts that hold the string of an added token are encoded whole, by the tokenizer as it is.

    The words of the first texts stay, up to ``CACHED_WORDS``; words learned later last for one call.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_file(path)
        self.added = [t.content for t in self.plain.get_added_tokens_decoder().values()]
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # lower-casing may make such a string, which the plain one would not see
        border = self.tokenizer.encode(BORDER, add_special_tokens=False).ids
        self.border = border[0] if len(border) == 1 else None
        self.place: dict[str, int] = {"": 0}
        self.start, self.length = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
        self.ids, self.used = np.zeros(1 << 18, np.uint32), 0

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in a row, and their number by word."""
        encode = self.tokenizer.encode_batch_fast
        if self.border is None or any(BORDER in w for w in words):
            codes = [c.ids for c in encode(words, add_special_tokens=False)]
            return np.fromiter((i for c in codes for i in c), np.uint32), np.fromiter(map(len, codes), np.int64, len(codes))
        # Long stretches are encoded faster than single words; a token that none of the words has marks their borders.
        stretches = [f" {BORDER} ".join([*words[i : i + 500], ""]) for i in range(0, len(words), 500)]
        ids = np.concatenate([np.array(c.ids, np.uint32) for c in encode(stretches, add_special_tokens=False)])
        borders = np.flatnonzero(ids == self.border)
        return ids[ids != self.border], np.diff(borders, prepend=-1) - 1

    def _learn(self, words: list[str]) -> None:
        flat, lengths = self._encode(words)
        first = len(self.place)
        if first + len(words) > len(self.start):
            more = np.zeros(max(len(self.start), len(words)), np.int64)
            self.start, self.length = np.concatenate([self.start, more]), np.concatenate([self.length, more])
        if self.used + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros(max(len(self.ids), len(flat)), np.uint32)])
        self.length[first : first + len(words)] = lengths
        self.start[first : first + len(words)] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : self.used + len(flat)] = flat
        self.used += len(flat)
        self.place.update(zip(words, range(first, first + len(words)), strict=True))

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        whole = [i for i, text in enumerate(texts) if any(a in text for a in self.added)]
        out = self._encode_ordinary(["" if i in whole else text for i, text in enumerate(texts)] if whole else texts)
        for i in whole:
            out[i] = np.array(self.plain.encode(texts[i], add_special_tokens=False).ids, np.uint32)
        return out

    def _encode_ordinary(self, texts: list[str]) -> list[np.ndarray]:
        rows = [_plain(text).replace("\n", " ").split(" ") for text in texts]
        places = [np.array([*map(self.place.get, words, repeat(-1))], np.int64) for words in rows]
        unknown = [np.flatnonzero(p < 0) for p in places]
        new = list(dict.fromkeys(words[i] for words, at in zip(rows, unknown, strict=True) for i in at.tolist()))
        used, out = self.used, []
        if new:
            self._learn(new)
        for words, p, at in zip(rows, places, unknown, strict=True):
            p[at] = [self.place[words[i]] for i in at.tolist()]
            lengths = self.length[p]
            ends = np.cumsum(lengths)
            out.append(self.ids[np.arange(ends[-1]) + np.repeat(self.start[p] - (ends - lengths), lengths)])
        if len(self.place) > CACHED_WORDS:
            self.used = used
            for w in new:
                del self.place[w]
        return out


def _tokenizer(path: str) -> WordTokenizer:
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = True) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, and ids if asked for): each document's ids and ``end_id``, cut every ``capacity`` ids.

    Null text is empty and gives one piece with ``end_id`` alone; so every row of ``docs`` has a piece.
    """

    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = _tokenizer(tokenizer_path)
        for whole in batches:
            for lo in range(0, whole.num_rows, 512):
                batch = whole.slice(lo, 512)
                rows, pieces, starts, lengths, crcs, parts = [], [], [], [], [], []
                encoded = tokenizer.encode_all([text or "" for text in batch.column(1).to_pylist()])
                for row, ids in enumerate(encoded):
                    ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(ids), capacity)):
                        part = ids[start : start + capacity]
                        rows.append(row), pieces.append(piece), starts.append(start), lengths.append(len(part)), crcs.append(zlib.crc32(part))
                        if with_ids:
                            parts.append(part)
                columns = [batch.column(0).take(pa.array(rows, pa.int64())), *(pa.array(x, pa.int64()) for x in (pieces, starts, lengths, crcs))]
                columns[1] = columns[1].cast(pa.int32())
                if with_ids:
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    flat = np.concatenate(parts).astype(np.int32) if parts else np.zeros(0, np.int32)
                    columns.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)))
                yield pa.RecordBatch.from_arrays(columns, names)

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = slim.schema["doc_id"].dataType.simpleString()
    return slim.mapInArrow(released(run), f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids)


class _Gaps:
    """Open sequences as runs (first sequence, number) by gap."""

    def __init__(self) -> None:
        self.runs: dict[int, list[list[int]]] = {}

    def add(self, gap: int, first: int, n: int) -> None:
        if n > 0:
            self.runs.setdefault(gap, []).append([first, n])

    def successor(self, length: int, capacity: int) -> int | None:
        return next((g for g in range(length, capacity + 1) if self.runs.get(g)), None)


def best_fit_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int]], int]:
    """Runs (length, first rank, first sequence, offset), and the number of sequences.

    ``counts`` has the number of pieces by length, so its size is at most ``capacity``.
    """
    gaps, runs, opened = _Gaps(), [], 0
    for length in sorted(counts, reverse=True):  # rounds
        rank, left = 0, counts[length]
        while left:
            gap = gaps.successor(length, capacity)
            if gap is None:
                fit = capacity // length
                full, rest = divmod(left, fit)  # the last new sequence takes the rest only
                for k in range(fit):  # the k-th pieces of all new sequences
                    if n := full + (k < rest):
                        runs.append((length, rank, opened, k * length))
                        rank += n
                gaps.add(capacity - fit * length, opened, full)
                if rest:
                    gaps.add(capacity - rest * length, opened + full, 1)
                opened += full + (rest > 0)
                left = 0
                continue
            first, n = gaps.runs[gap][0]
            take = min(n, left)
            runs.append((length, rank, first, capacity - gap))
            if take == n:
                gaps.runs[gap].pop(0)
            else:
                gaps.runs[gap][0] = [first + take, n - take]
            gaps.add(gap - length, first, take)
            rank, left = rank + take, left - take
    return runs, opened


def pack(pieces: DataFrame, *, capacity: int = CAPACITY, order: tuple[str, ...] = ("doc_id", "piece", "ids_crc32")) -> DataFrame:
    """``pieces`` with sequence_id and offset.

    ``pieces`` needs ``length`` (1 to ``capacity``) and the ``order`` columns, which settle ranks among pieces
    of equal length; equal rows take their ranks in any order. An empty table gives none.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most ``capacity`` rows
    runs, _ = best_fit_runs(counts, capacity)
    table = np.array(sorted(runs), np.int64).reshape(-1, 4)
    keys = (table[:, 0] << 44) + table[:, 1]
    shared = spark.sparkContext.broadcast((keys, table))
    with_rank = ranked(pieces, ["length"], list(order), "_rank", chunks=chunks_for(sum(counts.values())))
    names = [c for c in with_rank.columns if c != "_rank"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts, found = shared.value
        for batch in batches:
            rank, length = batch.column("_rank").to_numpy(), batch.column("length").to_numpy()
            at = np.searchsorted(starts, (length << 44) + rank, side="right") - 1
            sequence = found[at, 2] + rank - found[at, 1]
            arrays = [batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(sequence), pa.array(found[at, 3])], [*names, "sequence_id", "offset"])

    from pyspark.sql.types import LongType, StructField, StructType

    schema = StructType([*[with_rank.schema[c] for c in names], StructField("sequence_id", LongType()), StructField("offset", LongType())])
    return with_rank.mapInArrow(released(run), schema)


def pack_documents(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Pieces with their place: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and ``ids`` if asked for.

    Every row of ``docs`` is packed, repeated ones too; null and empty texts are the end id alone; texts of any length are
    tokenized whole and cut. Other columns aren't read; an empty table gives no rows. Tokens are made once and written to the shared folder.
    """
    cuts = Cuts(docs.sparkSession)
    made = tokenized_pieces(docs, tokenizer_path, id_col=id_col, text_col=text_col, capacity=capacity, with_ids=with_ids)
    return pack(cuts.cut(made, "pieces"), capacity=capacity)
