"""Operator 8: language-model scoring with a probabilistic suffix tree.

Tokens are words (maximal runs without ASCII white space, A-Z lower-cased) and one end after
each text.  The root of the tree is the smoothed unigram distribution
(c + 0.1) / (N + 0.1 * (V + 1)), counted over every token of all training documents.

Tree (contexts of up to ``depth`` words, a parameter; what they hold grows with the corpus):

* A context is a candidate for a symbol if the two were met together at least ``least`` times.
* Divergence test: its next symbols are those whose count differs from what the context
  without its first word expects by more than chance (``z`` deviations).  The context is kept
  if the likelihood gained by giving these symbols their own probability, its count times the
  divergence, exceeds a cost of log(N) for each of them.
* Smoothing: such a symbol gets (c(s, w) + k * P(w | suffix)) / (c(s) + k), all others the
  suffix's probability times the factor that makes the sum 1.
* A token is scored in the state of the longest kept context that ends in front of it.

Contexts grow by one word in front as long as one can be kept, and no longer than ``depth``: each word
more is a round of jobs, and long passages that thousands of near copies share would go on for hundreds.  Where the counts and probabilities
behind ``s`` show that no longer context that ends in ``s`` passes the test (``extendable``), it
isn't extended.  Until a longer context is kept the state stays, so this holds for all lengths
and no context of up to ``depth`` words that would be kept is missed.

The log of a probability over the root's is a sum over the sequences of words that end with the
token or in front of it: each kept context adds its factor, each symbol listed there what it gets
beyond that.  So the tree is one distributed table (sequence, value) and a document's score the
sum over its sequences.  Sequences are named by 64-bit hashes.  Counts, tests and table stay on
the executors; bitmaps of fixed size only spare sequences that can't count, a full one spares none.

Every text is cut and hashed once; a block of texts is kept as its distinct hashes and a code for each word.
Words are counted, contexts named and texts scored from these blocks.  Sequences of two and three words that are all among
the ``HEAD`` most frequent are counted by the ranks of their words, which are short and name their context; all
others by hashes, and the contexts of the frequent ones are named in a second pass.  For scoring, the ``head`` most frequent words and the ``head_values`` most frequent sequences of
the table are broadcast (fixed numbers of them); the rest are looked up by a join, one row for each
document and distinct rare word or sequence, so neither vocabulary nor tree is cut off.

Edge cases: null text is empty and scores its end; unknown words have the root's probability
of a count of 0; without training documents every probability is 1; repeated rows are scored each.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, fold, giving_back, let_go, stored

BITS = 26  # of the largest bitmap
DEPTH = 6
FLUSH = 5_000_000
BLOCK = 500_000  # words that are handled at once
CUT_BYTES = 16 << 20  # of texts that are cut at once, about
RANK_BITS = 20
HEAD = 1 << RANK_BITS  # words with a rank
KEYS_PER_TASK = 1_500_000
SALT = 0x5851F42D4C957F2D  # tells keys of words from those of sequences


@dataclass
class Lookup:
    """Values of 64-bit keys, found by their upper bits."""

    keys: np.ndarray
    values: np.ndarray
    starts: np.ndarray
    bits: int
    most: int

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Lookup:
        order = np.argsort(keys)
        bits = max(1, (2 * len(keys)).bit_length())
        n = np.bincount((keys >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits)
        return cls(keys[order], values[order], np.r_[0, np.cumsum(n)].astype(np.int32), bits, int(n.max()))

    def places(self, keys: np.ndarray) -> np.ndarray:
        """Where each of ``keys`` is, or -1."""
        out = np.full(len(keys), -1, np.int64)
        if not len(self.keys):
            return out
        upper = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.starts[upper], self.starts[upper + 1]
        left = np.flatnonzero(at < end)
        at, end = at[left], end[left]
        for _ in range(self.most):
            ok = self.keys[at] == keys[left]
            out[left[ok]] = at[ok]
            more = ~ok & (at + 1 < end)
            left, at, end = left[more], at[more] + 1, end[more]
            if not len(left):
                break
        return out


def hash_of(word: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")


def hashes_of(words: pa.Array) -> np.ndarray:
    """64-bit hash of each of some distinct words: of eight bytes at a time or, beyond 64 bytes, of the whole word."""
    kind = np.int64 if pa.types.is_large_string(words.type) else np.int32
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, kind)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    if not len(words) or data is None:
        return np.zeros(len(words), np.uint64)
    held = np.r_[np.frombuffer(data, np.uint8)[: at[-1]], np.zeros(8, np.uint8)]
    eights = np.ndarray(len(held) - 7, np.uint64, held, strides=(1,))
    at, left = at[:-1], np.diff(at)
    out = longer(np.full(len(words), SALT, np.uint64), left.astype(np.uint64))
    some = np.flatnonzero((left > 0) & (left <= 64))
    for done in range(0, 64, 8):
        some = some[left[some] > done]
        if not len(some):
            break
        unused = np.maximum(8 - (left[some] - done), 0).astype(np.uint64) * np.uint64(8)
        out[some] = longer(out[some], eights[at[some] + done] << unused)
    for i in np.flatnonzero(left > 64):
        out[i] = hash_of(held[at[i] : at[i] + left[i]].tobytes())
    return out


def longer(before: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hash of sequences and one word behind each."""
    a = before * np.uint64(0x9E3779B97F4A7C15) + word
    a = (a ^ (a >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return a ^ (a >> np.uint64(29))


def bitmap(keys: DataFrame) -> np.ndarray:
    """Bits at the upper bits of the column ``key``: 16 or more for each key, but 2 ** BITS at most."""
    bits = min(BITS, max(10, int(keys.count() * 16).bit_length()))
    at = F.shiftrightunsigned("key", 64 - bits)
    words = keys.groupBy(F.shiftright(at, 6).alias("at")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(key, {64 - bits}) & 63 as int))")).alias("bits"))
    found = words.toArrow()  # at most 2 ** (BITS - 6) rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def marked(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = (keys >> np.uint64(59 - len(bits).bit_length())).astype(np.int64)
    return (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) != 0


def runs(w: np.ndarray, known: np.ndarray, pairs: np.ndarray | None, first: np.ndarray | None = None):
    """(ends, hashes) of the sequences of 1, 2, ... words all of whose words are known and whose pairs are marked.

    ``first`` is true where a text begins, if ``w`` holds several: no sequence crosses such a place."""
    ends = np.flatnonzero(known)
    hashes = w[ends]
    linked = None
    while len(ends):
        yield ends, hashes
        # A sequence that ends one word earlier and may be followed by this one.
        if linked is None:
            at = np.flatnonzero(np.diff(ends) == 1)
            if first is not None:
                at = at[~first[ends[at] + 1]]
            nxt = ends[at] + 1
            both = longer(hashes[at], w[nxt])
            if pairs is not None:
                ok = marked(pairs, both)
                nxt, both = nxt[ok], both[ok]
            linked = np.zeros(len(w) + 1, bool)
            linked[nxt] = True
            ends, hashes = nxt, both
        else:
            go = linked[ends + 1]
            ends, hashes = ends[go] + 1, longer(hashes[go], w[ends[go] + 1])


def blocks_of_words(batches, block: int = BLOCK):
    """(hashes of words, where texts begin) of about ``block`` words from arrays of hashes, or their bytes; a longer text is a block of its own."""
    for batch in batches:
        w, offsets = words_of(batch.column(0))
        starts = offsets[:-1][np.diff(offsets) > 0]
        end, at = int(offsets[-1]), 0
        while at < len(starts):
            after = max(at + 1, int(np.searchsorted(starts, starts[at] + block)))
            a, b = int(starts[at]), int(starts[after]) if after < len(starts) else end
            first = np.zeros(b - a, bool)
            first[starts[at:after] - a] = True
            yield w[a:b], first
            at = after


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a column, and where each row's begin and end."""
    if pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        return column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    kind = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8)[: offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return held[: len(held) // 8 * 8].view(np.uint64), offsets // 8


def packed(w: np.ndarray, first: np.ndarray) -> tuple[int, bytes, bytes, bytes]:
    """Of a block: number of words, lengths of the texts, distinct hashes, sorted, and how often each occurs, codes of the words by their frequency."""
    coded = pa.array(w).dictionary_encode()
    words = coded.dictionary.to_numpy()
    order = np.argsort(words)
    times = np.bincount(coded.indices.to_numpy(), minlength=len(words))[order].astype(np.uint32)
    rank = np.empty(len(words), code_type(len(words)))
    rank[order[by_frequency(times)]] = np.arange(len(words))
    lengths = np.diff(np.r_[np.flatnonzero(first), len(w)]).astype(np.uint32)
    return len(w), planes(lengths), steps(words[order]) + planes(times), planes(rank[coded.indices.to_numpy()])


def by_frequency(times: np.ndarray) -> np.ndarray:
    return np.argsort(-times.astype(np.int64), kind="stable")


def code_type(distinct: int) -> type:
    return np.uint16 if distinct <= 1 << 16 else np.uint32


PACKED = T.StructType([T.StructField("n", T.LongType()), *(T.StructField(c, T.BinaryType()) for c in ("lengths", "words", "codes"))])


def blocks(batches):
    """(distinct words, codes, where texts begin) of packed blocks."""
    for batch in batches:
        for i in range(batch.num_rows):
            lengths, words, codes = (batch.column(k)[i].as_py() for k in (1, 2, 3))
            distinct = len(words) // 12
            words = from_steps(words[: 8 * distinct])[by_frequency(from_planes(words[8 * distinct :], np.uint32))]
            lengths = from_planes(lengths, np.uint32).astype(np.int64)
            codes = from_planes(codes, code_type(distinct))
            first = np.zeros(len(codes), bool)
            first[np.cumsum(lengths) - lengths] = True
            yield words, codes, first


def hashed(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words and the end of each text, and the length of each."""
    found = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    kinds = found.values.dictionary_encode()
    there = pc.binary_length(found.values).to_numpy(zero_copy_only=False) > 0  # white space at an end leaves an empty word
    n = np.diff(np.r_[0, np.cumsum(there)][found.offsets.to_numpy()])
    own = hashes_of(kinds.dictionary)
    out = np.empty(int(n.sum()) + len(n), np.uint64)
    last = np.zeros(len(out), bool)
    last[np.cumsum(n + 1) - 1] = True
    out[last] = hash_of(b"\n")
    out[~last] = own[kinds.indices.to_numpy()[there]]
    return out, n + 1


def hashed_texts(docs: DataFrame) -> DataFrame:
    """Blocks of the texts of ``docs``, apart by ``_train``, with lists of what else their rows hold."""
    keep = [c for c in docs.columns if c not in ("text", "_train")]
    kept = [T.StructField(c, T.ArrayType(docs.schema[c].dataType)) for c in keep]

    def run(batches):
        for batch in batches:
            train = pc.fill_null(batch.column(1), False).to_numpy(zero_copy_only=False)
            for kind in (True, False):
                part = batch.take(pa.array(np.flatnonzero(train == kind)))
                if not part.num_rows:
                    continue
                some = max(1, part.num_rows * CUT_BYTES // max(1, part.column(0).nbytes))
                made = [hashed(part.column(0).slice(at, some)) for at in range(0, part.num_rows, some)]
                w, lengths = (np.concatenate(x) for x in zip(*made))
                made.clear()
                w = pa.LargeListArray.from_arrays(np.r_[0, np.cumsum(lengths)], pa.array(w.view(np.int64)))
                at = 0
                for own, first in blocks_of_words([pa.RecordBatch.from_arrays([w], names=["w"])]):
                    n = int(first.sum())
                    lists = [pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), pa.concat_arrays([c.slice(at, n)])) for c in part.columns[2:]]
                    at += n
                    columns = [pa.array([x], t) for x, t in zip(packed(own, first), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([pa.array([kind]), *columns, *lists], names=["_train", *PACKED.names, *keep])

    return docs.select("text", "_train", *keep).mapInArrow(giving_back(run), T.StructType([T.StructField("_train", T.BooleanType()), *PACKED.fields, *kept]))


def stretches(train: DataFrame, length: int, shared) -> DataFrame:
    """Blocks of the stretches in which contexts of more than ``length`` words can end."""
    def run(batches):
        words, pairs, extended, symbols = shared.value
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def made():
            columns = [pa.array([x], t) for x, t in zip(packed(*map(np.concatenate, zip(*held))), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))]
            return pa.RecordBatch.from_arrays(columns, names=PACKED.names)

        for kinds, codes, begins in blocks(batches):
            w = kinds[codes]
            first, last = np.ones(len(w), bool), np.zeros(len(w), bool)
            for k, (ends, keys) in enumerate(runs(w, marked(words, kinds)[codes], pairs, begins), 1):
                if k == 2:
                    first[ends] = False
                if k == length:
                    last[ends[marked(extended, keys)]] = True
                if k == length + 1:
                    last[ends[marked(symbols, keys)]] = True
                    break
            starts, ends = np.flatnonzero(first), np.flatnonzero(last)
            if len(ends):
                chain = np.searchsorted(starts, ends, "right") - 1
                final = np.r_[chain[1:] != chain[:-1], True]
                step = np.zeros(len(w) + 1, np.int8)
                step[starts[chain[final]]] += 1
                step[ends[final] + 1] -= 1
                inside = np.cumsum(step[:-1], dtype=np.int8) > 0
                held.append((w[inside], first[inside]))
                size += len(held[-1][0])
            if size > BLOCK:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    return train.mapInArrow(giving_back(run), PACKED)


def sequences(kinds: np.ndarray, codes: np.ndarray, first: np.ndarray, length: int, words, pairs, extended, listed):
    """(ends of sequences of ``length`` words and a symbol, the sequences, their contexts, the same without the first word, contexts alone).

    Contexts alone of two words are sequences of one and a symbol, which are counted before.  Beyond one word only symbols that the shorter context lists count, and contexts whose ends are marked in ``extended``."""
    none, nowhere = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    w = kinds[codes]
    levels: list[tuple[np.ndarray, np.ndarray]] = []
    for k, level in enumerate(runs(w, marked(words, kinds)[codes], pairs, first), 1):
        levels = [*levels, level][-3:]
        if k == length + 1:
            break
    else:
        k = len(levels) and k
    if k < length:
        return nowhere, none, none, none, none
    if k == length:
        levels.append((nowhere, none))
    (ends, own), (gram_ends, grams) = levels[-2:]
    at = np.zeros(len(w), np.uint64)
    at[ends] = own
    if length == 1:
        return gram_ends, grams, at[gram_ends - 1], at[gram_ends], none
    last = np.zeros(len(w), np.uint64)
    last[levels[-3][0]] = levels[-3][1]
    short = at[gram_ends]
    ok = marked(listed, short)
    return gram_ends[ok], grams[ok], at[gram_ends[ok] - 1], short[ok], none if length == 2 else own[marked(extended, last[ends])]


@dataclass
class Ranks:
    """Ranks of the most frequent words.  Two or three of them make a number whose upper bits, the range, are even for all words:
    there are the lower bits of the sum of the ranks, and the last rank goes without its lower bits."""

    of_words: Lookup
    words: np.ndarray

    def of(self, words: np.ndarray, codes: np.ndarray, ends: np.ndarray, length: int) -> np.ndarray:
        """Ranks of the words of each sequence, a row for each place in it; -1 for words without."""
        at = self.of_words.places(words)
        rank = np.full(len(words), -1, np.int64)
        rank[at >= 0] = self.of_words.values[at[at >= 0]]
        return np.stack([rank[codes[ends - k]] for k in range(length, -1, -1)])

    @staticmethod
    def number(ranks: np.ndarray, bits: int) -> np.ndarray:
        whole = np.zeros(ranks.shape[1], np.uint64)
        for r in ranks:
            whole = whole << np.uint64(RANK_BITS) | r.astype(np.uint64)
        return ranks.sum(axis=0).astype(np.uint64) << np.uint64(64 - bits) | whole >> np.uint64(bits)

    @staticmethod
    def ranks(numbers: np.ndarray, length: int, bits: int) -> np.ndarray:
        whole = (numbers & np.uint64((1 << (64 - bits)) - 1)) << np.uint64(bits)
        out = np.stack([whole >> np.uint64(RANK_BITS * k) & np.uint64(HEAD - 1) for k in range(length, -1, -1)])
        out[-1] |= (numbers >> np.uint64(64 - bits)) - out.sum(axis=0) & np.uint64((1 << bits) - 1)
        return out.astype(np.int64)

    def hashes(self, numbers: np.ndarray, length: int, bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of the sequences, of their contexts and without the first word."""
        w = self.words[self.ranks(numbers, length, bits)]
        join = lambda part: part[0] if len(part) == 1 else longer(join(part[:-1]), part[-1])
        return join(w), join(w[:-1]), join(w[1:])


def ranks_of(listed: DataFrame, most: int) -> tuple[Ranks, bool]:
    """Ranks of at most ``most`` words, and whether these are all."""
    here, others = most_frequent(listed, most)
    found = here.select("key", "n").toArrow()
    words = found.column("key").to_numpy().view(np.uint64)[np.argsort(-found.column("n").to_numpy(), kind="stable")]
    return Ranks(Lookup.of(words, np.arange(len(words), dtype=np.int32)), words), others.isEmpty()


def planes(x: np.ndarray) -> bytes:
    """The first bytes of all numbers, then the second and so on, which is what compresses."""
    return x.view(np.uint8).reshape(-1, x.itemsize).T.tobytes()


def from_planes(held: bytes, kind: type = np.uint64) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(held, np.uint8).reshape(size, -1).T).view(kind).ravel()


def steps(x: np.ndarray) -> bytes:
    """Sorted numbers by their differences."""
    return planes(np.diff(x, prepend=x.dtype.type(0)))


def from_steps(held: bytes) -> np.ndarray:
    return np.cumsum(from_planes(held), dtype=np.uint64)


def ranges_for(words_there: int) -> int:
    return 1 << min(RANK_BITS, max(3, int(words_there / KEYS_PER_TASK).bit_length()))


def cut(keys: np.ndarray, ranges: int) -> list[tuple[int, slice]]:
    """The ranges that sorted keys fall into, and where."""
    cuts = np.searchsorted(keys >> np.uint64(65 - ranges.bit_length()), np.arange(ranges + 1, dtype=np.uint64))
    return [(i, slice(cuts[i], cuts[i + 1])) for i in range(ranges) if cuts[i] < cuts[i + 1]]


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys)
    keys, n = keys[order], n[order].astype(np.int64)
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return keys[starts], np.add.reduceat(n, starts)


def count_keys(
    frame: DataFrame, keys_of: Callable[..., Iterable[tuple]], least: int, words_there: int,
    named: Callable[[np.ndarray], tuple] | None = None,
) -> DataFrame:
    """(key, n, context, shorter) of the keys of all blocks that occur at least ``least`` times.

    ``keys_of`` gives (whether numbers of ranks, keys, counts or None) of a block; ``named`` makes of numbers of ranks their keys, contexts and
    the keys without the first word, which are null for other keys.
    Keys are counted block by block, and a block's counts go to the reducers as a few sorted arrays, one for each range of
    keys: what is shuffled is less than eight bytes a key, and no row is made of a key that is not frequent."""
    ranges = ranges_for(words_there)
    out = pa.schema([("range", pa.int32()), ("ranked", pa.bool_()), ("keys", pa.binary()), ("counts", pa.binary())])

    def count(batches):
        held: dict[bool, list[tuple]] = {}
        size = 0

        def made():
            for ranked, some in held.items():
                keys, n = zip(*some)
                keys, n = np.unique(np.concatenate(keys), return_counts=True) if n[0] is None else summed(np.concatenate(keys), np.concatenate(n))
                parts, n = cut(keys, ranges), n.astype(np.uint32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i for i, _ in parts], pa.int32()), pa.array([ranked] * len(parts), pa.bool_()), pa.array([steps(keys[x]) for _, x in parts], pa.binary()), pa.array([planes(n[x]) for _, x in parts], pa.binary())],
                    schema=out,
                )

        for block in blocks(batches):
            for ranked, keys, n in keys_of(*block):
                held.setdefault(ranked, []).append((keys, n))
                size += len(keys)
            if size > FLUSH:
                yield from made()
                held.clear()
                size = 0
        if size:
            yield from made()

    def merge(batches):
        held: dict[bool, list[tuple]] = {}
        for batch in batches:
            for ranked, keys, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                held.setdefault(ranked, []).append((from_steps(keys), from_planes(n, np.uint32)))
        for ranked in list(held):
            key, n = summed(*map(np.concatenate, zip(*held.pop(ranked))))
            key, n = key[n >= least], n[n >= least]
            columns = named(key) if ranked else (key, None, None)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(n), pa.int64()) if c is None else pa.array(c.view(np.int64)) for c in (columns[0], n, *columns[1:])], names=["key", "n", "context", "shorter"]
            )

    blobs = frame.select(*PACKED.names).mapInArrow(giving_back(count), "range int, ranked boolean, keys binary, counts binary")
    return blobs.repartition(ranges, "range").mapInArrow(giving_back(merge), "key long, n long, context long, shorter long")


def count_sequences(train: DataFrame, length: int, shared, least: int, words_there: int, shared_ranks) -> DataFrame:
    """(key, n, context, shorter) of the sequences, and of contexts alone, that occur at least ``least`` times in texts or stretches."""
    bits = ranges_for(words_there).bit_length() - 1

    def keys_of(words, codes, first):
        ends, grams, _, _, alone = sequences(words, codes, first, length, *shared.value)
        if length <= 2:
            ranks = shared_ranks.value.of(words, codes, ends, length)
            ok = (ranks >= 0).all(axis=0)
            yield True, Ranks.number(ranks[:, ok], bits), None
            grams = grams[~ok]
        yield False, grams, None
        yield False, alone, None

    return count_keys(train, keys_of, least, words_there, lambda numbers: shared_ranks.value.hashes(numbers, length, bits))


def resolve(train: DataFrame, length: int, shared, shared_frequent, words_there: int, shared_ranks) -> DataFrame:
    """(key, context, shorter) of the sequences counted by hashes and marked in ``frequent``.  As the keys, they go to the reducers in sorted arrays.

    A key isn't sent: it is made of its context and last word, and behind one word that is the shorter sequence."""
    ranges = ranges_for(words_there)
    out = pa.schema([("range", pa.int32()), ("contexts", pa.binary()), ("keys", pa.binary()), ("shorter", pa.binary())])

    def distinct(keys, *more):
        keys, at = np.unique(keys, return_index=True)
        return keys, *(x[at] for x in more)

    def run(batches):
        marks, frequent = shared.value, shared_frequent.value
        held: list[tuple] = []
        size = 0

        def made():
            keys, context, short = distinct(*map(np.concatenate, zip(*held)))
            parts, rows = cut(keys, ranges), []
            for i, x in parts:
                order = np.argsort(context[x])
                rows.append((i, steps(context[x][order]), planes(keys[x][order]) if length > 1 else b"", planes(short[x][order])))
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows), out)], schema=out)

        for words, codes, first in blocks(batches):
            ends, grams, context, short, _ = sequences(words, codes, first, length, *marks)
            ok = marked(frequent, grams)
            if length <= 2:
                ok &= (shared_ranks.value.of(words, codes, ends, length) < 0).any(axis=0)
            if ok.any():
                held.append(distinct(grams[ok], context[ok], short[ok]))
                size += len(held[-1][0])
            if size > FLUSH:
                yield made()
                held, size = [], 0
        if size:
            yield made()

    def merge(batches):
        found = []
        for batch in batches:
            for contexts, keys, short in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                context, short = from_steps(contexts), from_planes(short)
                found.append((from_planes(keys) if length > 1 else longer(context, short), context, short))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in distinct(*map(np.concatenate, zip(*found)))], names=["key", "context", "shorter"])

    blobs = train.select(*PACKED.names).mapInArrow(giving_back(run), "range int, contexts binary, keys binary, shorter binary")
    return blobs.repartition(ranges, "range").mapInArrow(merge, "key long, context long, shorter long")


def kept_contexts(codes, n, size: int, context_counts: np.ndarray, suffix, total: int, z: float, pull: float):
    """Divergence test of ``grow`` on arrays.  ``suffix(place, symbols)``: probabilities behind the context without its first word.

    Returns places of kept contexts, log factors of their other symbols, and listed codes with probabilities."""
    places, rests, listed, probability = [], [], [], []
    starts = np.flatnonzero(np.r_[True, np.diff(codes // size) > 0]) if len(codes) else []
    for a, b in zip(starts, list(starts[1:]) + [len(codes)]):
        place, symbols, c = int(codes[a] // size), codes[a:b] % size, n[a:b]
        whole = context_counts[place]
        q = suffix(place, symbols)
        expected = whole * q
        odd = np.abs(c - expected) > z * np.sqrt(expected + 1)
        if not odd.any():
            continue
        symbols, c, q = symbols[odd], c[odd], q[odd]
        p = (c + pull * q) / (whole + pull)
        left, before = 1 - p.sum(), 1 - q.sum()
        if left <= 0 or before <= 0:
            continue
        divergence = (p * np.log(p / q)).sum() + left * np.log(left / before)
        if whole * divergence < len(symbols) * np.log(max(total, 2)):
            continue
        places.append(place)
        rests.append(np.log10(left / before))
        listed.append((symbols, p))
    return places, rests, listed


def grow(
    train: DataFrame, vocabulary: DataFrame, total: int, distinct: int, least_context: float = 0.0, least_symbol: float = 0.0,
    z: float = 6.0, pull: float = 20.0, least: int = 10, depth: int = DEPTH, head: int = HEAD,
) -> tuple[DataFrame | None, int, np.ndarray | None, np.ndarray | None]:
    """Table (key, value, n) of the tree, most words of a sequence in it, bitmaps of its words and pairs.

    ``train`` has packed blocks, ``vocabulary`` is (key, n)."""
    cost = float(np.log(max(total, 2)))
    few, rare = max(least, least_context * total), max(least, least_symbol * total)
    listed = stored(vocabulary.filter(F.col("n") >= min(few, rare)).withColumn("p", (F.col("n") + 0.1) / F.lit(total + 0.1 * (distinct + 1))))
    words, pairs, extended, symbols = bitmap(listed), None, None, None
    ranks, all_ranked = ranks_of(listed, head)
    broadcast = train.sparkSession.sparkContext.broadcast
    ranks, marks = broadcast(ranks), broadcast((words, pairs, extended, symbols))
    used = [ranks, marks]  # each executor keeps a copy on disk until they are destroyed
    values, spent, before, length, part, there = [], [listed], None, 0, train, total
    while True:
        length += 1
        counted = stored(count_sequences(part, length, marks, least, there, ranks))
        let_go(counted)
        grams, named = counted.filter("context is not null"), None
        if length > 2 or not all_ranked:
            unnamed = counted.filter("context is null").select("key", "n")
            frequent = broadcast(bitmap(unnamed))
            named = stored(resolve(part, length, marks, frequent, there, ranks))
            frequent.destroy()
            grams = grams.unionByName(unnamed.join(named, "key"))
        whole = (listed if length == 1 else before if length == 2 else counted).select("key", "n")
        below = listed.filter(F.col("n") >= rare) if length == 1 else listed
        met = (
            grams.join(below.select(F.col("key").alias("shorter"), F.col("p").alias("q")), "shorter")
            .join(whole.filter(F.col("n") >= few).select(F.col("key").alias("context"), F.col("n").alias("whole")), "context")
        )
        met = met.drop("shorter")
        expected = F.col("whole") * F.col("q")
        met = met.withColumn("odd", F.abs(F.col("n") - expected) > z * F.sqrt(expected + 1))
        met = stored(met.withColumn("own", (F.col("n") + pull * F.col("q")) / (F.col("whole") + pull)))
        discard(*[x for x in (named, before) if x is not None])
        if met.isEmpty():
            discard(counted, met)
            break
        odd = lambda c: F.sum(F.when(F.col("odd"), c).otherwise(0.0))
        tested = met.groupBy("context").agg(
            F.first("whole").alias("all"), (1 - odd(F.col("own"))).alias("left"), (1 - odd(F.col("q"))).alias("before"), odd(F.lit(1.0)).alias("kinds"),
            odd(F.col("own") * F.log(F.col("own") / F.col("q"))).alias("gain"),
        )
        tested = tested.filter("kinds > 0 and left > 0 and before > 0").withColumn("factor", F.col("left") / F.col("before"))
        tested = stored(tested.filter(F.col("all") * (F.col("gain") + F.col("left") * F.log("factor")) >= F.col("kinds") * cost))
        listed = met.join(tested.select("context", "factor"), "context", "left").withColumn("own", F.when(F.col("odd") & F.col("factor").isNotNull(), F.col("own")))
        listed = stored(listed.withColumn("p", F.coalesce("own", F.col("q") * F.coalesce("factor", F.lit(1.0)))).select("key", "context", "n", "whole", "q", "p", "own", "factor"))
        spent += [tested, listed]
        before = counted if length == 1 else None
        discard(met, *([] if length == 1 else [counted]))
        values.append(tested.select(F.col("context").alias("key"), F.log10("factor").alias("value"), F.col("all").alias("n")))
        values.append(listed.filter("own is not null").select("key", (F.log10(F.col("p") / F.col("q")) - F.log10("factor")).alias("value"), "n"))
        if length == 1:
            pairs = bitmap(listed)
        if length >= depth:
            length += 1
            break
        worth = stored(extendable(listed, z, pull, least, cost))
        spent.append(worth)
        extended, symbols = bitmap(worth.select(F.col("context").alias("key"))), bitmap(listed.join(worth, "context", "left_semi"))
        if not symbols.any():
            length += 1
            break
        used.pop().destroy()
        marks = broadcast((words, pairs, extended, symbols))
        used.append(marks)
        if length >= 2:
            whole_part, part = part, stored(stretches(part.select(*PACKED.names), length, marks))
            there = part.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            if whole_part is not train:
                discard(whole_part)
    for x in used:
        x.destroy()
    if part is not train:
        discard(part)
    if before is not None:
        discard(before)
    if not values:
        discard(*spent)
        return None, 0, words, pairs
    table = values[0]
    for more in values[1:]:
        table = table.unionByName(more)
    table = stored(table.groupBy("key").agg(F.sum("value").alias("value"), F.max("n").alias("n")))
    discard(*spent)
    return table, length, words, pairs


def extendable(listed: DataFrame, z: float, pull: float, least: int, cost: float) -> DataFrame:
    """(context) of those with a longer one that may be kept.

    A longer context's gain is convex in its shares, so it is at most the sum over its symbols of what a
    context with that symbol alone gains; each count is at most that of the shorter one.  One symbol at least
    must differ by more than chance: above what is expected or, with others in its place, below."""
    n, whole, q = F.col("n"), F.col("whole"), F.col("p")
    pure = whole / (whole + pull)
    most = lambda q: (pure + (1 - pure) * q) * F.log(pure / q + 1 - pure) + (1 - pure) * (1 - q) * F.log(1 - pure)
    above = whole * (1 - q) > z * F.sqrt(whole * q + 1)
    below = (whole * q - least > z * F.sqrt(whole * q + 1)) & (whole - n > z)
    by = listed.groupBy("context").agg(
        F.sum(n * most(q)).alias("gain"), F.first("whole").alias("whole"), (F.first("whole") - F.sum("n")).alias("others"),
        F.greatest(1 - F.sum("p"), F.lit(1e-12)).alias("p"), F.max(above | below).alias("odd"),
    )
    return by.filter(F.col("odd") & (F.col("gain") + F.col("others") * most(q) >= cost)).select("context")


def most_frequent(table: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The rows with the largest ``n``, at most ``most`` of them, and the others.

    A histogram of the logarithm of the counts (a few hundred rows) gives the least count to take, so
    that no more than the rows taken reach the driver."""
    step = F.floor(F.log2("n") * 16).cast("int")
    sizes = sorted(((r["step"], r["count"]) for r in table.groupBy(step.alias("step")).count().collect()), reverse=True)
    least, taken = None, 0
    for at, n in sizes:
        taken += n
        if taken > most:
            break
        least = at
    if least is None:
        return table.limit(0), table
    return table.filter(step >= least), table.filter(step < least)


def looked_up(table: DataFrame) -> Lookup:
    """``key`` and ``value`` of a table of bounded size."""
    found = table.select("key", "value").toArrow()
    return Lookup.of(found.column("key").to_numpy().view(np.uint64), found.column("value").to_numpy())


@dataclass
class Model:
    """Root logarithms of the most frequent words, the most frequent sequences of the tree and their values; a bitmap of the others."""

    roots: Lookup
    values: Lookup
    others: np.ndarray | None
    length: int
    words: np.ndarray | None
    pairs: np.ndarray | None

    def of(self, words: np.ndarray, codes: np.ndarray, first: np.ndarray, doc: np.ndarray, n: int):
        """For ``n`` texts of a block, ``doc`` telling the text of each word: known words, their logarithms, sums of the values of sequences
        that are here, and (kind, texts, keys) to look up."""
        w, at = words[codes], self.roots.places(words)[codes]
        there = at >= 0
        known, base = np.bincount(doc[there], minlength=n), np.bincount(doc[there], self.roots.values[at[there]], n)
        ratio, asked = np.zeros(n), [(1, doc[~there], w[~there] ^ np.uint64(SALT))]
        first_places = self.values.places(words)
        for k, (ends, keys) in enumerate(runs(w, marked(self.words, words)[codes], self.pairs, first) if self.length else (), 1):
            at = first_places[codes[ends]] if k == 1 else self.values.places(keys)
            there = at >= 0
            ratio += np.bincount(doc[ends[there]], self.values.values[at[there]], n)
            if self.others is not None:
                ends, keys = ends[~there], keys[~there]
                some = marked(self.others, keys)
                asked.append((2, doc[ends[some]], keys[some]))
            if k == self.length:
                break
        return known, base, ratio, asked


def times(doc: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's distinct keys and how often they occur."""
    order = np.lexsort((keys, doc))
    doc, keys = doc[order], keys[order]
    starts = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (keys[1:] != keys[:-1])]) if len(keys) else np.zeros(0, np.int64)
    return doc[starts], keys[starts], np.diff(np.r_[starts, len(keys)])


def score(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    train: Column | None = None,
    held_out: Column | None = None,
    head_words: int = 250_000,
    least_context: float = 0.0,
    least_symbol: float = 0.0,
    head_values: int = 1_000_000,
    depth: int = DEPTH,
    head_ranks: int = HEAD,
) -> DataFrame:
    """n_tokens, n_known, train_tokens, base_score (root only) and score of every row; ``held_out`` defaults
    to the ids whose crc32 modulo 10 is 0, ``train`` to the others.  Contexts and symbols below a share of
    ``least_context`` or ``least_symbol`` are left out; by default none is.  Contexts have at most ``depth`` words.
    The three ``head`` parameters only bound what workers hold."""
    if head_ranks > HEAD:
        raise ValueError(f"at most {HEAD} words have a rank")
    spark = df.sparkSession
    held_out = fold(F.col(id_col), 10) == 0 if held_out is None else held_out
    train = ~held_out if train is None else train
    docs = df.select(F.col(id_col).alias("_id"), F.col(text_col).alias("text"), held_out.alias("held_out"), train.alias("_train"))
    texts = stored(hashed_texts(docs.withColumn("row", F.monotonically_increasing_id())))
    training = texts.filter("_train").select(*PACKED.names)
    there = training.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    vocabulary = stored(count_keys(training, lambda words, codes, _: [(False, words, np.bincount(codes, minlength=len(words)))], 1, there).select("key", "n"))
    let_go(vocabulary)
    total, distinct = vocabulary.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    log = F.log10((F.coalesce("c", F.lit(0)) + 0.1) / F.lit(float(total) + 0.1 * (distinct + 1)))
    roots = looked_up(most_frequent(vocabulary, head_words)[0].select("key", F.col("n").alias("c")).select("key", log.alias("value")))
    tree, length, words, pairs = grow(training, vocabulary, int(total), int(distinct), least_context, least_symbol, depth=depth, head=head_ranks)
    lookup = vocabulary.select(F.col("key").bitwiseXOR(F.lit(SALT)).alias("key"), F.col("n").alias("c"), F.lit(None).cast("double").alias("value"))
    model = Model(roots, Lookup.of(np.zeros(0, np.uint64), np.zeros(0)), None, 0, None, None)
    if tree is not None:
        here, others = most_frequent(tree, head_values)
        model = Model(roots, looked_up(here), None if others.isEmpty() else bitmap(others), length, words, pairs)
        if model.others is not None:
            lookup = lookup.unionByName(others.select("key", F.lit(None).cast("long").alias("c"), "value"))
    shared = spark.sparkContext.broadcast(model)
    names = ["row", "_id", "held_out", "key", "n", "kind", "tokens", "known", "base", "ratio"]
    id_type = docs.schema["_id"].dataType

    def run(batches):
        model = shared.value
        for batch in batches:
            for i, (words, codes, first) in enumerate(blocks([batch])):
                doc, lengths = np.cumsum(first) - 1, np.diff(np.r_[np.flatnonzero(first), len(first)])
                n = len(lengths)
                known, base, ratio, asked = model.of(words, codes, first, doc, n)
                asked = [(kind, *times(doc, keys)) for kind, doc, keys in asked]
                row, ids, held = (batch.column(k)[i].values for k in (4, 5, 6))
                rows = row.to_numpy()
                m = sum(len(x[1]) for x in asked)
                joined = lambda head, rest: np.concatenate([np.asarray(head), *rest])
                behind = lambda head: np.concatenate([head, np.zeros(m, head.dtype)])
                arrays = [
                    pa.array(joined(rows, [rows[x[1]] for x in asked]), pa.int64()), pa.concat_arrays([ids, pa.nulls(m, ids.type)]),
                    pa.concat_arrays([held, pa.nulls(m, pa.bool_())]), pa.array(joined(np.zeros(n, np.int64), [x[2].view(np.int64) for x in asked]), pa.int64()),
                    pa.array(joined(np.zeros(n, np.int64), [x[3] for x in asked]), pa.int64()), pa.array(joined(np.zeros(n, np.int32), [np.full(len(x[1]), x[0], np.int32) for x in asked]), pa.int32()),
                    pa.array(behind(lengths), pa.int64()), pa.array(behind(known), pa.int64()), pa.array(behind(base), pa.float64()), pa.array(behind(ratio), pa.float64()),
                ]
                yield pa.RecordBatch.from_arrays(arrays, names=names)

    ddl = f"row long, _id {id_type.simpleString()}, held_out boolean, key long, n long, kind int, tokens long, known long, base double, ratio double"
    parts = texts.select(*PACKED.names, "row", "_id", "held_out").mapInArrow(giving_back(run), ddl)
    word = F.col("kind") == 1
    sums = parts.join(lookup, "key", "left").groupBy("row").agg(
        F.max("_id").alias("_id"),
        F.max("held_out").alias("held_out"),
        F.sum("tokens").alias("n_tokens"),
        (F.sum("known") + F.sum(F.when(word & F.col("c").isNotNull(), F.col("n")).otherwise(0))).alias("n_known"),
        (F.sum("base") + F.sum(F.when(word, F.col("n") * log).otherwise(0.0))).alias("base_score"),
        (F.sum("ratio") + F.sum(F.when(F.col("kind") == 2, F.col("n") * F.coalesce("value", F.lit(0.0))).otherwise(0.0))).alias("ratio"),
    )
    return sums.select(
        F.col("_id").alias(id_col), "held_out", "n_tokens", "n_known", F.lit(int(total)).cast("long").alias("train_tokens"), "base_score",
        (F.col("base_score") + F.col("ratio")).alias("score"),
    )
