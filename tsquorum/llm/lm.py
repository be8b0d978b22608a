"""Masked pseudo-likelihood: how likely each word of a document is, given the words on both sides.

A window network sees ``REACH`` words on either side of a masked one: word embeddings, one matrix per place and a
tanh layer. Its output is the masked word itself, in two levels: a softmax over about ``CLASSES`` classes of words,
then the binary choices down a tree over the words of that class. Every class and every inner node of a tree has
weights of its own on the hidden layer, so all of a word's conditional probability depends on both sides. Words
beyond the vocabulary are one word to the network and are then spelled by letter frequencies. So the probabilities
of all words sum to one; the sum of their logarithms scores the document.

Counts of words come from the whole corpus, and the vocabulary and with it the trees grow with it. Training is
data-parallel: each task starts from the shared weights, takes every ``rounds``-th word of all its documents as
masked examples (the next ones each round, so that all words were masked once in the end), and the tasks' changes
are averaged by their numbers of examples. Each example steps on all choices in its word's tree. Tasks send the rows of
weights that they changed, in 8 bits and a scale by row, which are summed up in slots of ``SLOT_ROWS`` rows, in the
order of the tasks; so a rerun over the same partitions gives the same model.

Examples are taken by falling depth of their words: those with a choice at some level of the trees are then the first
ones, and each level's rows of the hidden layer are a slice of it rather than copies.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsquorum.llm.common import Cuts, released
from tsquorum.llm.neardup import _mixed

#: Words seen as often as this are in the vocabulary.
LEAST = 5
CLASSES, WIDTH, HIDDEN, REACH = 64, 16, 16, 2
ROUNDS, RATE, BATCH = 2, 0.1, 1024
#: Different words whose counts a task holds before it sends them.
HELD_WORDS = 200_000
#: Words whose hashes a task holds before it adds them up and sends them.
HELD_HASHES = 1 << 21
#: Texts that are cut into words at once.
TEXTS = 64
#: Batches whose words are looked up at once, at most 512.
PLANNED = 16
#: Words that are scored at once.
SCORED = 8192
#: Rows of weights whose changes one task sums up.
SLOT_ROWS = 16_384
EDGE, UNKNOWN, FIRST = 0, 1, 2  # ids of the padding, of words beyond the vocabulary, and of the commonest word

_AROUND = np.array([d for d in range(-REACH, REACH + 1) if d])


class Model(NamedTuple):
    keys: np.ndarray  # sorted 64-bit hashes of the vocabulary's words
    ids: np.ndarray  # id of each key
    counts: np.ndarray  # occurrences of each id
    of_class: np.ndarray  # class of each id
    first: np.ndarray  # first id of each class; its words follow by frequency
    sizes: np.ndarray  # number of words of each class
    letters: np.ndarray  # log frequency of each byte, and of a word's end at 256
    weights: list[np.ndarray]  # embeddings, node weights and node biases by id; places, hidden bias, class weights, class biases


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def word_counts(docs: DataFrame, text_col: str) -> DataFrame:
    """(word, n) over all documents; words as in ``_words``, as bytes. Tasks add up their words before they send them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def sent() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts.keys()), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column(0):
                counts.update(_words(text.as_py()))
                if len(counts) > HELD_WORDS:
                    yield sent()
                    counts.clear()
        yield sent()

    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    return texts.mapInArrow(released(run), "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _cut(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts in lower case, begins and lengths of the words that ``_words`` finds, and their number by text."""
    sizes = np.fromiter((len(text or b"") + 1 for text in texts), np.int64, len(texts))
    row = b"\n".join([b"", *(text or b"" for text in texts), b"\n" * (16 - (int(sizes.sum()) + 1) % 8)]).lower()
    letters = np.frombuffer(row, np.uint8)
    space = (letters == 32) | ((letters >= 9) & (letters <= 13))
    edges = np.flatnonzero(space[1:] != space[:-1]) + 1
    begins = edges[::2]
    return letters, begins, edges[1::2] - begins, np.diff(np.searchsorted(begins, np.append(0, np.cumsum(sizes)) + 1))


def _hashes(letters: np.ndarray, begins: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """64-bit hashes of words in ``letters``, a multiple of 8 bytes of which the last 8 are in no word: eight bytes of each at a time, mixed with what came before.

    Different words of one length up to 8 have different hashes.
    """
    eights, found = letters.view("<u8"), lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
    at, begin, left = np.arange(len(begins)), begins, lengths
    while len(at):
        place, over = begin >> 3, ((begin & 7) << 3).astype(np.uint64)
        own = np.take(eights, place) >> over
        own |= (np.take(eights, place + 1) << np.uint64(1)) << (np.uint64(63) - over)
        own &= np.take(masks, np.minimum(left, 8))
        found[at] = _mixed(np.take(found, at) ^ own)
        more = np.flatnonzero(left > 8)
        at, begin, left = np.take(at, more), np.take(begin, more) + 8, np.take(left, more) - 8
    return found


def _hashed(words: list[bytes]) -> np.ndarray:
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    row = b"".join(words)
    return _hashes(np.frombuffer(row + bytes(16 - len(row) % 8), np.uint8), np.cumsum(lengths) - lengths, lengths)


_TALLY = "kind int, key bigint, n bigint"


def _tally(kind: int, key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(key), kind, np.int32)), pa.array(key.view(np.int64)), pa.array(n)], ["kind", "key", "n"])


def _summed(tallies: DataFrame, least: int) -> tuple[np.ndarray, np.ndarray, int, np.ndarray]:
    """Hashes and counts of the words seen ``least`` times, the number of the other words, and of each letter in all words.

    ``tallies`` has hashes with counts (kind 0), and how often each byte and, at 256, a word's end came (kind 1).
    """
    found = tallies.groupBy("kind", "key").agg(F.sum("n").alias("n")).where((F.col("kind") == 1) | (F.col("n") >= least)).toArrow()
    kind, key, n = (found.column(c).to_numpy() for c in ("kind", "key", "n"))
    letters = np.zeros(257, np.int64)
    letters[key[kind == 1]] = n[kind == 1]
    key, n = key[kind == 0].view(np.uint64), n[kind == 0]
    return key, n, int(letters[256] - n.sum()), letters + 1


def _tree_biases(n: np.ndarray) -> np.ndarray:
    """Log odds of going right at each inner node of the tree over words with counts ``n``; place 0 is unused.

    Inner nodes are 1 to len(n) - 1, the words' leaves len(n) and on; the children of i are 2i and 2i + 1.
    """
    mass = np.concatenate([np.zeros(len(n)), n.astype(float)])
    for i in range(len(n) - 1, 0, -1) if len(n) < 64 else ():
        mass[i] = mass[2 * i] + mass[2 * i + 1]
    if len(n) >= 64:
        hi = len(n)
        while hi > 1:  # all nodes whose children are known
            lo = (hi + 1) // 2
            at = np.arange(lo, hi)
            mass[at] = mass[2 * at] + mass[2 * at + 1]
            hi = lo
    inner = np.arange(1, len(n))
    return np.concatenate([[0.0], np.log(mass[2 * inner + 1] / mass[2 * inner])])


def vocabulary(counts: DataFrame, least: int = LEAST) -> Model:
    """The model before training, from (word, n): its probabilities are the words' shares of the corpus, whatever is around.

    All words seen ``least`` times, commonest first (ties by hash); the driver holds a hash and a count of each.
    Words are told apart by 64-bit hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = np.zeros(257, np.int64)
        for batch in batches:
            words, n = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            letters[:256] += np.bincount(np.frombuffer(b"".join(words), np.uint8), np.repeat(n, [len(w) for w in words]), 256).astype(np.int64)
            letters[256] += n.sum()
            yield _tally(0, _hashed(words), n)
        yield _tally(1, np.arange(257), letters)

    return _untrained(*_summed(counts.select("word", "n").mapInArrow(released(run), _TALLY), least))


def corpus_vocabulary(docs: DataFrame, text_col: str, least: int = LEAST) -> Model:
    """``vocabulary`` of the ``word_counts`` of ``docs``. Only hashes leave the tasks, which sort them to add them up."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters, held, n = np.zeros(257, np.int64), [], 0

        def sent() -> pa.RecordBatch:
            keys = np.sort(np.concatenate(held or [np.zeros(0, np.uint64)]))
            begins = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])[: len(keys)])
            held.clear()
            return _tally(0, keys[begins], np.diff(np.append(begins, len(keys))))

        for batch in batches:
            for lo in range(0, batch.num_rows, TEXTS):
                row, begins, lengths, _ = _cut(batch.column(0).slice(lo, TEXTS).to_pylist())
                held.append(_hashes(row, begins, lengths))
                letters[:256] += np.bincount(row, minlength=256)
                letters[256] += len(begins)
                n += len(begins)
                if n > HELD_HASHES:
                    yield sent()
                    n = 0
        letters[[9, 10, 11, 12, 13, 32]] = 0  # between words
        yield sent()
        yield _tally(1, np.arange(257), letters)

    texts = docs.select(F.col(text_col).cast("binary").alias("text"))
    return _untrained(*_summed(texts.mapInArrow(released(run), _TALLY), least))


def _untrained(keys: np.ndarray, n: np.ndarray, rest: int, letters: np.ndarray) -> Model:
    order = np.lexsort([keys, -n])
    keys, n = keys[order], n[order]
    seen = np.concatenate([[0, max(1, rest)], n])
    # Classes of about equal mass, the commonest words first; the unknown word has one of its own.
    mass = np.cumsum(n) - n
    found = np.unique((mass * (CLASSES - 1) // max(1, int(n.sum()))).astype(np.int64), return_inverse=True)[1] + 1
    of_class = np.concatenate([[0, 0], found]).astype(np.int16)
    first = np.concatenate([[UNKNOWN], FIRST + np.flatnonzero(np.diff(found, prepend=0))]).astype(np.int64)
    sizes = np.diff(np.append(first, len(seen)))
    biases = np.zeros(len(seen), np.float32)
    for lo, k in zip(first, sizes, strict=True):
        biases[lo : lo + k] = _tree_biases(seen[lo : lo + k])
    prior = np.log(np.add.reduceat(seen, first) / seen.sum())
    rng = np.random.default_rng(3)
    weights = [
        (rng.standard_normal((len(seen), WIDTH)) * 0.7).astype(np.float32), np.zeros((len(seen), HIDDEN), np.float32), biases,
        (rng.standard_normal((len(_AROUND), WIDTH, HIDDEN)) * 0.25).astype(np.float32), np.zeros(HIDDEN, np.float32),
        np.zeros((HIDDEN, len(first)), np.float32), prior.astype(np.float32),
    ]
    by_key = np.argsort(keys)
    return Model(keys[by_key], (by_key + FIRST).astype(np.int32), seen, of_class, first, sizes, np.log(letters / letters.sum()), weights)


def _known(model: Model, wanted: np.ndarray, starts: tuple[np.uint64, np.ndarray] | None = None) -> np.ndarray:
    """Ids of the words with the hashes ``wanted``."""
    if not len(model.keys):
        return np.full(len(wanted), UNKNOWN, np.int32)
    at = _found(model.keys, _starts(model.keys) if starts is None else starts, wanted)
    return np.where(np.take(model.keys, at) == wanted, np.take(model.ids, at), UNKNOWN).astype(np.int32)


def _ids(model: Model, words: Iterable[bytes], n: int) -> np.ndarray:
    return _known(model, _hashed(list(islice(words, n))))


def _starts(keys: np.ndarray) -> tuple[np.uint64, np.ndarray]:
    """A shift, and the number of sorted ``keys`` below each value of their leading bits, of which there are about as many as keys."""
    bits = max(1, len(keys).bit_length())
    heads = (keys >> np.uint64(64 - bits)).astype(np.int64)
    return np.uint64(64 - bits), np.append(0, np.cumsum(np.bincount(heads, minlength=1 << bits))).astype(np.int32)


def _found(keys: np.ndarray, starts: tuple[np.uint64, np.ndarray], wanted: np.ndarray) -> np.ndarray:
    """Places of ``wanted`` in the sorted ``keys``; of what isn't there, the place of some other key."""
    shift, begins = starts
    head = (wanted >> shift).astype(np.int64)
    at = np.minimum(np.take(begins, head), len(keys) - 1)
    left = np.flatnonzero(np.take(keys, at) < wanted)
    ends = np.take(begins, np.take(head, left) + 1) - 1
    while len(left):  # a bucket has one key on average, so few steps are left
        at[left] += at[left] < ends
        more = (np.take(keys, np.take(at, left)) < np.take(wanted, left)) & (np.take(at, left) < ends)
        left, ends = left[more], ends[more]
    return at


def _encoded(model: Model, texts: list[bytes | None], starts: tuple[np.uint64, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all texts in a row, the number of words by text, and the log probability of spelling its unknown words."""
    row, begins, lengths, n = _cut(texts)
    ids, spelled = _known(model, _hashes(row, begins, lengths), starts), np.zeros(len(texts))
    unknown = np.flatnonzero(ids == UNKNOWN)
    if len(unknown):
        text = np.searchsorted(np.cumsum(n), unknown, side="right")
        begins, lengths = begins[unknown], lengths[unknown]
        first = np.cumsum(lengths) - lengths
        letters = model.letters[row[np.arange(lengths.sum()) + np.repeat(begins - first, lengths)]]
        spelled += np.bincount(text, np.add.reduceat(letters, first) + model.letters[256], len(texts))
    return ids, n, spelled


#: Parts of ids, which are stored apart: each packs better than the ids do, and a row has few values to be copied.
_PARTS = {"low": np.dtype(np.uint8), "middle": np.dtype(np.uint8), "high": np.dtype("<u2")}


def encoded(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, low, middle, high, n, spelled) per row: the ids of the words, their number, and the log probability of spelling the unknown ones.

    Of the ids, ``low`` holds bits 0 to 7 (a byte per word), ``middle`` bits 8 to 15 and ``high`` the rest (two bytes, the lower first).
    """
    shared = docs.sparkSession.sparkContext.broadcast(model._replace(weights=[]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        starts = _starts(shared.value.keys)
        for whole in batches:
            for lo in range(0, whole.num_rows, TEXTS):
                batch = whole.slice(lo, TEXTS)
                ids, n, spelled = _encoded(shared.value, batch.column(1).to_pylist(), starts)
                ends = np.append(0, np.cumsum(n))
                parts = [pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer((ends * kind.itemsize).astype(np.int32)), pa.py_buffer((ids >> shift).astype(kind))]) for shift, kind in zip((0, 8, 16), _PARTS.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0), *parts, pa.array(n), pa.array(spelled)], ["doc_id", *_PARTS, "n", "spelled"])

    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return slim.mapInArrow(released(run), f"doc_id {slim.schema['doc_id'].dataType.simpleString()}, low binary, middle binary, high binary, n bigint, spelled double")


def targets(n: np.ndarray, r: int, rounds: int) -> np.ndarray:
    """Which words of texts with ``n`` words are masked in round ``r``; over all rounds each word once."""
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    return at % rounds == r


def _framed(ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids in a row, with REACH edges around each, and the places of the words."""
    row = np.full(len(ids) + REACH * (len(n) + 1), EDGE, np.int32)
    at = np.arange(len(ids)) + np.repeat(REACH * np.arange(1, len(n) + 1), n)
    row[at] = ids
    return row, at


def _lists(batch: pa.RecordBatch, size: int = 256) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    for lo in range(0, batch.num_rows, size):
        rows = batch.slice(lo, size)
        low, middle, high = (np.frombuffer(b"".join(rows.column(name).to_pylist()), kind).astype(np.int32) for name, kind in _PARTS.items())
        yield lo, low | middle << 8 | high << 16, rows.column("n").to_numpy()


def _leaves(model: Model, goal: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Leaves and depths of the words ``goal`` in their classes' trees."""
    leaf = goal - np.take(model.first, classes) + np.take(model.sizes, classes)
    return leaf, np.frexp(leaf.astype(float))[1] - 1  # exact: leaf < 2 ** 53


def _by_depth(depth: np.ndarray) -> np.ndarray:
    """An order by falling depth, which is at most 62."""
    return np.argsort((-depth).astype(np.int8), kind="stable")


def _paths(leaf: np.ndarray, depth: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, list[tuple[slice, slice]]]]]:
    """The choices down to leaves, in groups of ``size`` leaves in which depths fall: nodes (as rows of the weights), and 1 where it is right.

    ``first`` are the first rows of the leaves' classes. A group's last choices come first. With them, by group, a slice
    of its choices, and its steps as of ``_steps``, counted within the group.
    """
    group, most = np.arange(len(leaf)) // size, int(depth.max(initial=0))
    deep = np.bincount(group * (most + 1) + depth, minlength=(len(leaf) + size - 1) // size * (most + 1)).reshape(-1, most + 1)
    sizes = (deep.sum(axis=1, keepdims=True) - np.cumsum(deep, axis=1))[:, :-1]  # of the steps, by group
    ends, flat = np.cumsum(sizes).reshape(sizes.shape), sizes.ravel()
    before = ends - sizes - size * np.arange(len(sizes))[:, None]
    which = np.arange(flat.sum()) - np.repeat(before.ravel(), flat)
    child = np.take(leaf, which) >> np.repeat(np.tile(np.arange(most), len(sizes)), flat)
    groups, lo = [], 0
    for own in sizes.tolist():
        steps, at = [], 0
        for k in own:
            if k:
                steps.append((slice(at, at + k), slice(0, k)))
                at += k
        groups.append((slice(lo, lo + at), steps))
        lo += at
    return np.take(first, which) + (child >> 1), (child & 1).astype(np.float32), groups


def _path(leaf: np.ndarray, depth: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[tuple[slice, slice]]]:
    """``_paths`` of one group, and its steps."""
    node, right, groups = _paths(leaf, depth, first, max(1, len(leaf)))
    return node, right, groups[0][1] if groups else []


def _choices(model: Model, goal: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The choices down to the words ``goal``: row of ``goal``, node (as a row of the weights), and right or not.

    The last choices of all words come first, then those before them. If depths fall, each step is of the first rows.
    """
    leaf, depth = _leaves(model, goal, classes)
    order = _by_depth(depth)
    node, right, steps = _path(np.take(leaf, order), np.take(depth, order), np.take(np.take(model.first, classes), order))
    return np.concatenate([order[rows] for _, rows in steps] or [order[:0]]), node, right.astype(bool)


def _steps(which: np.ndarray) -> list[tuple[slice, slice]]:
    """By step of choices in which depths fall: its choices, and the rows they are of."""
    begins = np.append(np.flatnonzero(which == 0), len(which)).tolist()
    return [(slice(lo, hi), slice(0, hi - lo)) for lo, hi in itertools.pairwise(begins)]


def _odds(h: np.ndarray, inner: np.ndarray, biases: np.ndarray, steps: list[tuple[slice, slice]], products: np.ndarray | None = None) -> np.ndarray:
    """Log odds of going right at each choice, from the hidden layer and the weights of the choices' nodes; ``products`` is overwritten."""
    products = np.empty(inner.shape, np.result_type(h, inner)) if products is None else products
    for own, rows in steps:
        np.multiply(h[rows], inner[own], out=products[own])
    odds = products @ np.ones(inner.shape[1], products.dtype)  # much faster than a sum by row
    odds += biases
    return odds


def _aligned(w: np.ndarray) -> np.ndarray:
    """A float32 copy whose rows begin at multiples of 64 bytes, if they are as long."""
    room = np.empty(w.size * 4 + 64, np.uint8)
    at = -room.ctypes.data % 64
    out = room[at : at + w.size * 4].view(np.float32).reshape(w.shape)
    out[...] = w
    return out


def _hidden(weights: list[np.ndarray], seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = np.take(weights[0], seen, axis=0).reshape(len(seen), -1)  # much faster than by an index
    return flat, np.tanh(flat @ weights[3].reshape(-1, HIDDEN) + weights[4])


def _scores(weights: list[np.ndarray], hidden: np.ndarray) -> np.ndarray:
    """Scores of all classes by row of the hidden layer, small enough for exp."""
    scores = hidden @ weights[5]
    scores += weights[6]
    if np.abs(weights[5]).sum(axis=0).max() + weights[6].max() > 60:  # hidden values are within 1, so else no score is above
        scores -= scores.max(axis=1, keepdims=True)
    return scores


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    """``x`` in each of ``width`` columns; products with it are much faster than with one column."""
    return np.repeat(x, width).reshape(-1, width)


def _added(rows: np.ndarray, at: np.ndarray, changes: np.ndarray) -> None:
    """Adds ``changes`` to the rows ``at``, as often as they come; by column, two float32 at a time as one complex number."""
    pair = np.complex64 if rows.dtype == np.float32 else np.complex128
    rows, changes = rows.view(pair), changes.view(pair)
    for k in range(rows.shape[1]):
        np.add.at(rows[:, k], at, changes[:, k])


def log_words(model: Model, row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log probability of each word at the places ``at`` of ``row``, given the words around it."""
    goal = np.take(row, at).astype(np.int64)
    classes = np.take(model.of_class, goal).astype(np.int64)
    leaf, depth = _leaves(model, goal, classes)
    order = _by_depth(depth)
    at, classes, leaf, depth = (np.take(x, order) for x in (at, classes, leaf, depth))
    _, h = _hidden(model.weights, np.take(row, at[:, None] + _AROUND))
    scores = _scores(model.weights, h)
    out = scores[np.arange(len(at)), classes].astype(float)
    out -= np.log(np.exp(scores, out=scores) @ np.ones(scores.shape[1], scores.dtype))
    node, right, steps = _path(leaf, depth, np.take(model.first, classes))
    inner = np.take(model.weights[1], node, axis=0)
    against = _odds(h, inner, np.take(model.weights[2], node), steps, inner)
    against *= 1 - 2 * right
    costs = np.maximum(against, 0) + np.log1p(np.exp(-np.abs(against)))
    for own, rows in steps:
        out[rows] -= costs[own]
    logs = np.empty_like(out)
    logs[order] = out
    return logs


def _rates(model: Model, rate: float) -> np.ndarray:
    """Rate of each embedding: one that a batch is likely to meet k times takes steps shorter by the root of 1 + k."""
    return (rate / np.sqrt(1 + len(_AROUND) * BATCH * model.counts / max(1, int(model.counts.sum())))).astype(np.float32)


def _batches(model: Model, row: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[tuple[slice, slice]]]]:
    """By ``BATCH`` of places, by falling depth of their words: classes, ids around, and the choices as ``_paths`` has them.

    None of it depends on the weights, so it is made for some batches at once.
    """
    for lo in range(0, len(at), PLANNED * BATCH):
        here = at[lo : lo + PLANNED * BATCH]
        goal = np.take(row, here).astype(np.int64)
        classes = np.take(model.of_class, goal).astype(np.int64)
        leaf, depth = _leaves(model, goal, classes)
        order = np.argsort((np.arange(len(here)) // BATCH * 64 + 63 - depth).astype(np.int16), kind="stable")
        here, classes, leaf, depth = (np.take(x, order) for x in (here, classes, leaf, depth))
        seen = np.take(row, here[:, None] + _AROUND).astype(np.int64)
        node, right, groups = _paths(leaf, depth, np.take(model.first, classes), BATCH)
        for k, (own, steps) in enumerate(groups):
            mine = slice(k * BATCH, (k + 1) * BATCH)
            yield classes[mine], seen[mine], node[own], right[own], steps


def sgd(model: Model, row: np.ndarray, at: np.ndarray, rate: float, slow: np.ndarray, used: np.ndarray | None = None) -> None:
    """One step per ``BATCH`` of masked places, in place; ``slow`` are the embeddings' rates, ``used`` marks the nodes with steps."""
    embed, nodes, biases, place, bias, out, out_bias = model.weights
    flat_place, ones = place.reshape(-1, HIDDEN), np.ones(len(out_bias), out.dtype)
    for classes, seen, node, right, steps in _batches(model, row, at):
        flat, h = _hidden(model.weights, seen)
        scores = _scores(model.weights, h)
        np.exp(scores, out=scores)
        sums = scores @ ones
        scores[np.arange(len(h)), classes] -= sums
        shares = 1 / sums  # of the classes, with which the errors are multiplied where there are fewer columns
        dh = scores @ out.T
        dh *= _wide(shares, HIDDEN)
        if len(node):
            inner = np.take(nodes, node, axis=0)
            off = _odds(h, inner, np.take(biases, node), steps)
            np.exp(np.negative(off, out=off), out=off)
            off += 1
            np.subtract(np.reciprocal(off, out=off), right, out=off)
            # Nodes near a root are met by a share of its class's words; classes have about equal mass.
            step = np.float32(-rate / (1 + len(h) / max(1, len(model.first))) ** 0.5)
            each_off, moves = _wide(off, HIDDEN), h * step
            inner *= each_off
            for own, rows in steps:
                dh[rows] += inner[own]
                np.multiply(moves[rows], each_off[own], out=inner[own])
            _added(nodes, node, inner)
            np.add.at(biases, node, off * step)
            if used is not None:
                used[node] = True
        dh *= 1 - h * h
        whole = np.float32(rate / len(h) ** 0.5 / 4)
        dx = (dh @ flat_place.T).reshape(-1, WIDTH)
        out -= whole * ((h * _wide(shares, HIDDEN)).T @ scores)
        out_bias -= whole * (shares @ scores)
        place -= whole * (flat.T @ dh).reshape(place.shape)
        bias -= whole * (np.ones(len(h), h.dtype) @ dh)
        seen = seen.ravel()
        dx *= _wide(-np.take(slow, seen), WIDTH)
        _added(embed, seen, dx)


_MESSAGE = "slot int, part int, n bigint, " + ", ".join(f"{name} binary" for name in ("rows", "scales", "changes", "node_rows", "node_scales", "node_changes", "biases", "dense"))


def _message(slot: int, part: int, n: int, *values: np.ndarray) -> pa.RecordBatch:
    names = [field.split(" ")[0] for field in _MESSAGE.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([slot], pa.int32()), pa.array([part], pa.int32()), pa.array([n], pa.int64()), *[pa.array([x.tobytes()], pa.binary()) for x in values]], names)


def _short(changes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A scale by row, and the rows in 8 bits."""
    scales = (np.abs(changes).max(axis=1, initial=0) / 127 + 1e-7).astype(np.float16)
    return scales, np.clip(np.rint(changes / scales[:, None]), -127, 127).astype(np.int8)


def _long(scales: bytes, changes: bytes, width: int) -> np.ndarray:
    return np.frombuffer(changes, np.int8).reshape(-1, width) * np.frombuffer(scales, np.float16)[:, None].astype(float)


def _one_round(ids: DataFrame, model: Model, r: int, rounds: int, rate: float) -> None:
    """A pass over every ``rounds``-th word from the ``r``-th on; changes the model's weights."""
    spark = ids.sparkSession
    total = ids.agg(F.sum(F.ceil((F.col("n") - r) / rounds))).first()[0]
    if not total:
        return
    small = model._replace(keys=model.keys[:0], ids=model.ids[:0], weights=[w.astype(np.float16) for w in model.weights])
    shared = spark.sparkContext.broadcast(small)
    del small
    slots = -(-len(model.counts) // SLOT_ROWS)

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, old = shared.value._replace(weights=[_aligned(w) for w in shared.value.weights]), shared.value.weights
        seen, used, n, part = np.zeros(len(m.counts), bool), np.zeros(len(m.counts), bool), 0, TaskContext.get().partitionId()
        slow = _rates(m, rate)
        for batch in batches:
            for _, values, lengths in _lists(batch):
                row, places = _framed(values, lengths)
                at = places[targets(lengths, r, rounds)]
                batches_here = -(-len(at) // BATCH) or 1
                at = np.concatenate([at[i::batches_here] for i in range(batches_here)])  # a batch's words come from all over the texts
                sgd(m, row, at, rate, slow, used)
                seen[row] = True
                n += len(at)
        if n:
            for slot in range(slots):
                lo, hi = slot * SLOT_ROWS, (slot + 1) * SLOT_ROWS
                own, inner = np.flatnonzero(seen[lo:hi]), np.flatnonzero(used[lo:hi])
                if len(own) or len(inner) or slot == 0:
                    embed, nodes, biases = (w[lo:hi][at] - before[lo:hi][at] for w, before, at in zip(m.weights, old, (own, inner, inner), strict=False))
                    dense = np.concatenate([(w - before).ravel() for w, before in zip(m.weights[3:], old[3:], strict=True)])
                    yield _message(slot, part, n, own.astype(np.uint16), *_short(embed), inner.astype(np.uint16), *_short(nodes), biases.astype(np.float16), dense if slot == 0 else dense[:0])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, sums = None, []

        def done() -> pa.RecordBatch:
            none = np.zeros(0, np.uint16)
            embed, nodes, biases, dense = (s.astype(np.float32) for s in sums)
            return _message(slot, 0, 0, none, none, embed, none, none, nodes, biases, dense)

        for batch in batches:
            for message in batch.to_pylist():
                if message["slot"] != slot:
                    if slot is not None:
                        yield done()
                    slot = message["slot"]
                    sums = [np.zeros((SLOT_ROWS, WIDTH)), np.zeros((SLOT_ROWS, HIDDEN)), np.zeros(SLOT_ROWS), np.zeros(len(message["dense"]) // 4)]
                share = message["n"] / total
                sums[0][np.frombuffer(message["rows"], np.uint16)] += _long(message["scales"], message["changes"], WIDTH) * share
                inner = np.frombuffer(message["node_rows"], np.uint16)
                sums[1][inner] += _long(message["node_scales"], message["node_changes"], HIDDEN) * share
                sums[2][inner] += np.frombuffer(message["biases"], np.float16) * share
                sums[3] += np.frombuffer(message["dense"], np.float32) * share
        if slot is not None:
            yield done()

    made = ids.select(*_PARTS, "n").mapInArrow(released(local), _MESSAGE).repartition("slot").sortWithinPartitions("slot", "part")
    for part in made.mapInArrow(released(added), _MESSAGE).toLocalIterator():  # a row per slot, as many bytes as the weights
        lo = part["slot"] * SLOT_ROWS
        for w, name in zip(model.weights, ("changes", "node_changes", "biases"), strict=False):
            w[lo : lo + SLOT_ROWS] += np.frombuffer(part[name], np.float32).reshape(-1, *w.shape[1:])[: len(w) - lo]
        if part["dense"]:
            rest, at = np.frombuffer(part["dense"], np.float32), 0
            for w in model.weights[3:]:
                w += rest[at : at + w.size].reshape(w.shape)
                at += w.size
    shared.unpersist()


def fit(ids: DataFrame, model: Model, *, rounds: int = ROUNDS, rate: float = RATE) -> Model:
    """The model after ``rounds`` passes over ``ids`` (see ``encoded``), in which every word is masked once."""
    model = model._replace(weights=[w.copy() for w in model.weights])
    for r in range(rounds):
        _one_round(ids, model, r, rounds, rate)
    return model


def train(docs: DataFrame, *, text_col: str = "text", rounds: int = ROUNDS, rate: float = RATE, least: int = LEAST) -> Model:
    """Counts the words of all documents, then trains on all documents.

    Null and empty texts add nothing; repeated rows count as often as they come; words of equal frequency are
    ordered by hash. No words: a model that spells every word.
    """
    cuts = Cuts(docs.sparkSession)
    model = corpus_vocabulary(docs, text_col, least)
    ids = cuts.cut(encoded(docs.withColumn("_none", F.lit(0)), model, id_col="_none", text_col=text_col), "ids", "zstd")
    model = fit(ids, model, rounds=rounds, rate=rate)
    cuts.drop("ids")
    return model


def _log_likelihoods(model: Model, ids: np.ndarray, n: np.ndarray, spelled: np.ndarray) -> np.ndarray:
    row, places = _framed(ids, n)
    logs = np.concatenate([log_words(model, row, places[lo : lo + SCORED]) for lo in range(0, len(places), SCORED)] or [np.zeros(0)])
    return np.bincount(np.repeat(np.arange(len(n)), n), logs, len(n)) + spelled


def log_likelihoods(model: Model, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Number of words and summed conditional log probability of each text."""
    ids, n, spelled = _encoded(model, texts)
    return n, _log_likelihoods(model, ids, n, spelled)


def score_encoded(ids: DataFrame, model: Model) -> DataFrame:
    """As ``score``, of rows that ``encoded`` made with the same vocabulary."""
    small = model._replace(keys=model.keys[:0], ids=model.ids[:0])
    shared = ids.sparkSession.sparkContext.broadcast(small)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, values, n in _lists(batch):
                part = batch.slice(lo, len(n))
                sums = _log_likelihoods(shared.value, values, n, part.column("spelled").to_numpy())
                mean = pa.array(sums / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n.astype(np.int64)), pa.array(sums), mean], ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"])

    return ids.select("doc_id", *_PARTS, "n", "spelled").mapInArrow(released(run), f"doc_id {ids.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, log_likelihood double, mean_log_likelihood double")


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, mean_log_likelihood) per row.

    Texts that are null, empty or without words have n_tokens 0, log_likelihood 0 and a null mean. Whole texts are
    scored, long ones in stretches of words. Null ids and repeated rows are rows like any other; other columns
    aren't read; an empty table gives no rows.
    """
    return score_encoded(encoded(docs, model, id_col=id_col, text_col=text_col), model)


def train_and_score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``score`` of all documents by a model of the same documents, which are cut into words once."""
    cuts = Cuts(docs.sparkSession)
    model = corpus_vocabulary(docs, text_col)
    ids = cuts.cut(encoded(docs, model, id_col=id_col, text_col=text_col), "ids", "zstd")
    return score_encoded(ids, fit(ids, model))
