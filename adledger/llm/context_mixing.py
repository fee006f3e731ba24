"""LM scoring by online logistic context mixing.

A text is its tokens (words between ASCII white space, A-Z lower-cased, then one end). It is
coded as a run of bytes, each token followed by a terminator, and each byte as a few binary
decisions, the steps to it in a prefix code of the bytes that follow the byte before in training tokens. For every decision
five predictors look up counts of zeros and ones under hashed contexts of what came before in
the text, across tokens: the last byte, the last two, the last three, the token so far and the
token so far after the previous token.
Their stretched probabilities are combined with weights from a set that a gate chooses, by
how often the two longest contexts were seen; weights are learned online along the texts, by
gradient steps over small batches. A last table, by decision and by mixed probability, adapts
along with them and refines the result. Probabilities of all bytes sum to one by construction,
so the total is a code length, and it depends on the order of the words.

What is gathered: one pass cuts texts into blocks and writes each block's distinct tokens
with their counts, and each row as numbers into them, in order. Counts by token are added up over
the corpus, a hot token having one row per block. Tables, weights and refinement are learned from
all training texts, a decision's own occurrence taken out of the counts it is predicted from.
Blocks get their tokens back with the counts and score their texts in bounded pieces, which start
with the last tokens of the piece before. What is predicted of a byte depends on its token so far
and the token before (its last bytes are theirs), so counting, learning and scoring do each distinct
prefix of a token after another once a piece, by how often it occurs. Tables have a fixed size,
a parameter, so the model can be sent to every task; the vocabulary cannot and never is.
Contexts that share a slot share its counts.

Null and empty texts are one end. A null id is in the training part. Repeated rows are
scored row by row and learned from as often as they occur. Without training rows counts are
empty, and the base of every text is 0.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from adledger.llm.bagminhash import BASE, _powers, mix
from adledger.llm.common import arrow_map, slices, staged

U = np.uint64
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
ORDERS = 3
INPUTS = ORDERS + 2
GATES = 32  # how often the token so far was seen (8 steps) by how often it was after the previous token (4)
STEPS = 33
FINE = 24 * 128 + 1
DEPTH = 20  # steps to a byte at most
WINDOW = 1 << 15  # bytes predicted at once
SHARED = 2 << 20  # bytes whose equal pairs of tokens are predicted once
PART_BYTES = 1 << 19  # bytes of pairs whose equal contexts are predicted once
RUN = 64  # nodes that are learned from together and lie together
PREFIX = 32  # bytes of a token, at most, that are shared with other tokens
BLOCK_BYTES = 24 << 20
PART = 1 << 16


def held_out(id_: Column, folds: int = 7, fold: int = 2) -> Column:
    return F.coalesce(F.crc32(id_.cast("string")) % folds == fold, F.lit(False))


def tokens(text: str | None) -> list[bytes]:
    """The words of a text; the end is not among them."""
    return (text or "").encode().translate(LOWER).split()


# ---- contexts ---------------------------------------------------------------------------

def spelled(words: list[bytes]) -> np.ndarray:
    """The bytes of the words, each with its terminator."""
    return np.frombuffer(b" ".join(words) + b" ", np.uint8) if words else np.zeros(0, np.uint8)


def orders(last: np.ndarray) -> np.ndarray:
    """The hashes of the last byte, the last two and the last three, (ORDERS, bytes); ``last``: 9 bits for each, the latest highest."""
    return np.stack([mix((last >> U(9 * (ORDERS - order))) + U(order) * U(0x1234567890123)) for order in range(1, ORDERS + 1)])


def spans(data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each token up to each of its bytes, and for each whole token; ``starts``: where tokens start."""
    n, at = len(data), np.arange(len(data))
    start = np.repeat(starts, np.diff(starts, append=n))
    power, inverse = _powers(n + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum((data.astype(U) + U(1)) * power[:n])])
    whole = (sums[np.append(starts[1:], n)] - sums[starts]) * inverse[starts] + U(1)
    return (sums[at] - sums[start]) * inverse[start] + (at - start).astype(U), whole


def after(so_far: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The hash of a token so far after the token with the hash ``before``, 0 for none."""
    return mix(so_far + before * U(0x9E3779B97F4A7C15) + U(7))


def contexts(data: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """The hashes of the contexts of each byte, (INPUTS, bytes); ``begins`` are the places where texts start, the first is 0."""
    n, at = len(data), np.arange(len(data))
    ends = np.flatnonzero(data == 32)
    starts = np.concatenate([np.zeros(1, np.int64), ends + 1])[:-1 if len(ends) and ends[-1] == n - 1 else None]
    text = np.repeat(begins, np.diff(begins, append=n))
    value, last = data.astype(U) + U(1), np.zeros(n, U)
    for order in range(1, ORDERS + 1):
        last = last << U(9)
        last[order:] |= np.where(at[order:] - order >= text[order:], value[:-order], U(0))
    so_far, whole = spans(data, starts)
    # a text's first token has none before it
    before = np.concatenate([np.zeros(1, U), mix(whole)[:-1]])
    before[np.isin(starts, begins)] = 0
    return np.concatenate([orders(last), mix(so_far)[None], after(so_far, np.repeat(before, np.diff(starts, append=n)))[None]])


def cuts(starts: np.ndarray, most: int) -> Iterator[tuple[int, int, int]]:
    """(lead, lo, hi) of runs of tokens of about ``most`` bytes, one token at least; ``starts``: of the tokens, and the end of the last.

    The lead from ``lead`` to ``lo``, two tokens, gives the contexts of what follows.
    """
    lo = 0
    while lo < len(starts) - 1:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield max(lo - 2, 0), lo, hi
        lo = hi


def inside(begins: np.ndarray, lead: int, hi: int) -> np.ndarray:
    """Where texts begin in a piece, the lead's first place among them, counted from there."""
    found = begins[np.searchsorted(begins, lead):np.searchsorted(begins, hi)] - lead
    return found if found.size and not found[0] else np.append(0, found)


def windows(data: np.ndarray, begins: np.ndarray, most: int = WINDOW) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(lead, lo, hi, begins) of such runs, in bytes."""
    starts = np.concatenate([np.zeros(1, np.int64), np.flatnonzero(data == 32) + 1])
    for lead, lo, hi in cuts(starts, most):
        lead, lo, hi = (int(starts[i]) for i in (lead, lo, hi))
        yield lead, lo, hi, inside(begins, lead, hi)


@dataclass
class Code:
    """A prefix code of the 256 bytes: the steps to each, and their number; or one code for each byte that may come before."""

    length: np.ndarray  # uint8, 256 or, by the byte before, 65536
    steps: np.ndarray  # int32, the first step is the highest of DEPTH bits

    def symbols(self, before: np.ndarray, data: np.ndarray) -> np.ndarray:
        """Where the steps of bytes are found; ``before``: the bytes before them, 0 where none is."""
        return data if len(self.length) == 256 else before.astype(np.int32) << 8 | data


@dataclass
class Nodes:
    """The distinct predictions in some pairs of tokens.

    All predictors but the last see the last three bytes and the token so far; a distinct one of these with
    the byte that follows is a stem. With the token before, it is a node, which the last predictor sees. A node is
    shared by all pairs of tokens with that token before and that prefix; each pair has a run of nodes of its
    own, and those it borrows from earlier pairs.
    """

    begin: np.ndarray  # the first node of each pair
    borrower: np.ndarray  # pairs ...
    lent: np.ndarray  # ... and nodes that they borrow
    stem: np.ndarray  # of each node
    pair: np.ndarray  # of each node, the first that has it
    before: np.ndarray  # the hash of the token before, by pair
    so_far: np.ndarray  # the number of the token so far, by stem
    stem_last: np.ndarray  # the last three bytes of each stem, 9 bits for each, the latest highest
    stem_byte: np.ndarray

    def stem_hashes(self, some: slice) -> np.ndarray:
        """What the predictors but the last see at these stems, (INPUTS - 1, stems)."""
        return np.concatenate([orders(self.stem_last[some].astype(U)), mix(self.so_far[some])[None]])

    def hashes(self, some) -> np.ndarray:
        """What the last predictor sees at these nodes, (1, nodes)."""
        return after(self.so_far.take(self.stem[some]), self.before.take(self.pair[some]))[None]

    def symbols(self, code: Code) -> np.ndarray:
        """What the code has steps for, by stem."""
        return code.symbols(np.maximum((self.stem_last >> 18) - 1, 0), self.stem_byte)

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of the nodes' values over the second token of each pair."""
        pairs = np.add.reduceat(values, self.begin, dtype=np.float64)
        return pairs + np.bincount(self.borrower, values[self.lent], len(pairs))

    def weights(self, n: np.ndarray) -> np.ndarray:
        """How often each node occurs; ``n``: how often each pair does."""
        return n[self.pair] + np.bincount(self.lent, n[self.borrower], len(self.stem))


def _distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values, and the number of each value's among them."""
    found = pa.array(values).dictionary_encode()
    return found.dictionary.to_numpy(), found.indices.to_numpy()


def _common(spelt: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """How many bytes two different tokens have in common from their starts, PREFIX at most."""
    found, at = np.zeros(len(left), np.int8), np.arange(len(left))
    for p in range(PREFIX):
        at = at[spelt[left[at] + p] == spelt[right[at] + p]]
        found[at] += 1
    return found


def _borrowed(common: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(which, place, node) of what items in order have in common with the items before them."""
    which, place, node = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for p in range(int(common.max(initial=0))):
        more = common > p
        some = np.flatnonzero(more)
        owner = np.maximum.accumulate(np.where(more, 0, np.arange(len(common))))[some]
        which.append(some)
        place.append(np.full(len(some), p))
        node.append(begin[owner] + p - common[owner])
    return np.concatenate(which), np.concatenate(place), np.concatenate(node)


@dataclass
class Words:
    """Distinct tokens with their terminators, in order."""

    spelt: np.ndarray
    offset: np.ndarray
    size: np.ndarray

    def of(self, own: np.ndarray) -> tuple[Words, np.ndarray]:
        """Only those tokens that occur, and their numbers among them."""
        used = np.zeros(len(self.size), bool)
        used[own] = True
        size = self.size[used]
        return Words(self.spelt[np.repeat(used, self.size)], np.cumsum(size) - size, size), (np.cumsum(used) - 1)[own]


def words_of(tokens: pa.Array) -> Words:
    """The tokens must be in order."""
    tokens = pa.concat_arrays([tokens])
    offset = np.frombuffer(tokens.buffers()[1], np.int32)[tokens.offset:tokens.offset + len(tokens) + 1].astype(np.int64)
    spelt = np.frombuffer(tokens.buffers()[2], np.uint8)[offset[0]:offset[-1]]
    return Words(spelt, offset[:-1] - offset[0], np.diff(offset))


def encoded(stops: np.ndarray, data: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct tokens in order, and the number of each token among them; ``stops``: 0 and where tokens end."""
    found = pa.Array.from_buffers(pa.binary(), len(stops) - 1, [None, pa.py_buffer(stops), pa.py_buffer(data)]).dictionary_encode()
    order = pc.array_sort_indices(found.dictionary)
    rank = np.empty(len(order), np.int32)
    rank[order.to_numpy()] = np.arange(len(order), dtype=np.int32)
    return found.dictionary.take(order), rank[found.indices.to_numpy()]


def read(data: np.ndarray, begins: np.ndarray) -> tuple[Words, np.ndarray, np.ndarray]:
    """The tokens of texts: the distinct ones, their numbers in order and the first of each text."""
    stops = np.append(0, np.flatnonzero(data == 32) + 1).astype(np.int32)
    found, own = encoded(stops, data)
    return words_of(found), own, np.searchsorted(stops, begins)


@dataclass
class Pairs:
    """The distinct pairs of a token and the one before it, in order of both."""

    words: Words
    of: np.ndarray  # the pair of each token
    own: np.ndarray
    before: np.ndarray  # 0: none; a token of one byte that starts its text has another number than elsewhere
    hashed: np.ndarray  # the hash of each token that may come before
    tails: np.ndarray  # the last three bytes with it, 9 bits for each, the latest highest

    def parts(self) -> Iterator[tuple[slice, Nodes]]:
        """The nodes of some pairs at a time."""
        for _, lo, hi in cuts(np.append(0, np.cumsum(self.words.size[self.own])), PART_BYTES):
            some = slice(lo, hi)
            yield some, nodes_of(*self.words.of(self.own[some]), self.before[some], self.hashed, self.tails)


def pieces(words: Words, own: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, int, Pairs]]:
    """Runs of tokens, and the pairs of each; ``first``: the first token of each text."""
    for lead, lo, hi in cuts(np.append(0, np.cumsum(words.size[own])), SHARED):
        yield lo, hi, pairs_of(*words.of(own[lead:hi]), inside(first, lead, hi), lo - lead)


def pairs_of(words: Words, own: np.ndarray, first: np.ndarray, skip: int) -> Pairs:
    """The pairs of tokens from ``skip`` on; what is before gives contexts only."""
    size, many = words.size, len(words.size)
    before = np.append(0, own[:-1] + 1)
    before[first] = 0
    second = first[(first + 1 < len(own)) & (size[own[first]] == 2)] + 1
    before[second] += np.where(before[second] > 0, many, 0)
    pairs, of = _distinct(before[skip:] * many + own[skip:])
    order = np.argsort(pairs)
    pairs, rank = pairs[order], np.empty(len(order), np.int32)
    rank[order] = np.arange(len(order), dtype=np.int32)
    before, own = np.divmod(pairs, many)

    whole = mix(spans(words.spelt, words.offset)[1])
    value = words.spelt.astype(np.int64) + 1
    end = words.offset + size - 2  # the last byte before the terminator
    tail = 33 << 18 | value[np.maximum(end, 0)] << 9
    third = np.where(size > 2, value[np.maximum(end - 1, 0)], 33)
    tails = np.concatenate([np.zeros(1, np.int64), tail | third, tail | np.where(size > 2, third, 0)])
    return Pairs(words, rank[of], own, before, np.concatenate([np.zeros(1, U), whole, whole]), tails)


def nodes_of(words: Words, own: np.ndarray, before: np.ndarray, hashed: np.ndarray, tails: np.ndarray) -> Nodes:
    spelt, offset, size = words.spelt, words.offset, words.size
    so_far, value = spans(spelt, offset)[0], spelt.astype(np.int64) + 1

    def runs(common, size, offset):
        """Where the bytes begin that items do not share with the items before, how many they are, and their places in the words."""
        long = size - common
        begin = np.cumsum(long) - long
        return begin, long, np.repeat((offset + common - begin).astype(np.int32), long) + np.arange(long.sum(), dtype=np.int32)

    # stems from the fourth byte of a token on depend on the token only
    common = np.append(np.int8(0), _common(spelt, offset[1:], offset[:-1]))
    begin, long, at = runs(common, size, offset)
    deep = at - np.repeat(offset, long) > 2
    number = np.cumsum(deep, dtype=np.int32) - 1
    stem_of = np.empty(len(spelt), np.int32)  # by place in the words
    stem_of[at] = number
    which, place, node = _borrowed(common, begin)
    stem_of[offset[which] + place] = number[node]
    deep = at[deep]

    common = np.zeros(len(own), np.int8)
    same = np.flatnonzero(before[1:] == before[:-1]) + 1
    common[same] = _common(spelt, offset[own[same]], offset[own[same - 1]])
    begin, long, at = runs(common, size[own], offset[own])
    pair = np.repeat(np.arange(len(own), dtype=np.int32), long)
    few = np.clip(3 - common, 0, long)
    low = np.repeat(begin - np.cumsum(few) + few, few) + np.arange(few.sum())
    spot = at[low]
    start = np.repeat(offset[own], few)
    place = spot - start
    last = np.repeat(tails[before], few)
    for p in (1, 2):
        more = np.flatnonzero(place >= p)
        last[more] = value[start[more] + p - 1] << 18 | last[more] >> 9
    keys, inverse = _distinct((last << 2 | place) << 8 | spelt[spot])
    example = np.empty(len(keys), np.int64)
    example[inverse] = spot
    stem = stem_of[at]
    stem += len(keys)
    stem[low] = inverse
    last = np.concatenate([keys >> 10, value[deep - 1] << 18 | value[deep - 2] << 9 | value[deep - 3]])
    spot = np.concatenate([example, deep])
    borrower, _, lent = _borrowed(common, begin)
    return Nodes(begin, borrower, lent, stem, pair, hashed[before], so_far[spot], last, spelt[spot])


PLAIN = Code(np.full(256, 8, np.uint8), np.arange(256, dtype=np.int32) << (DEPTH - 8))


def short_code(seen: np.ndarray) -> Code:
    """Short codes for frequent bytes: fewer decisions a text. No byte is rarer than 1 in 5,000, which bounds the depth."""
    weight = np.maximum(seen, max(seen.sum(), 1) / 5_000)
    heap = [(w, i, (i,)) for i, w in enumerate(weight.tolist())]
    heapq.heapify(heap)
    length, steps = np.zeros(256, np.uint8), np.zeros(256, np.int64)
    while len(heap) > 1:
        zero, one = heapq.heappop(heap), heapq.heappop(heap)
        for side, (_, _, members) in enumerate((zero, one)):
            m = list(members)
            steps[m] |= side << length[m].astype(np.int64)
            length[m] += 1
        heapq.heappush(heap, (zero[0] + one[0], min(zero[1], one[1]), zero[2] + one[2]))
    assert length.max() <= DEPTH
    return Code(length, (steps << (DEPTH - length.astype(np.int64))).astype(np.int32))


def codes_after(seen: np.ndarray) -> Code:
    """A short code for each byte that may come before, (256, 256) how often bytes followed it: none, at the start of a text, is as a terminator."""
    seen = seen.copy()
    seen[0] += seen[32]
    each = [short_code(s) if s.any() else PLAIN for s in seen]
    return Code(np.concatenate([c.length for c in each]), np.concatenate([c.steps for c in each]))


def decisions(data: np.ndarray, hashes: np.ndarray, bits: int, code: Code, kinds: slice = slice(None)):
    """The places of the bytes, longest codes first, then for each step: its number, the steps taken and the slots of each predictor.

    Steps come for the first places, as many as have so long a code. A quarter of the slots is for
    contexts of bytes, a quarter for tokens, a half for tokens after another. ``kinds``: the predictors whose hashes these are.
    """
    length = code.length[data]
    place = np.argsort(DEPTH - length, kind="stable")
    steps = code.steps[data[place]].astype(np.int64)
    long = np.cumsum(np.bincount(length, minlength=DEPTH + 1)[::-1])[::-1]  # with a length of d at least
    hashes = hashes[:, place]
    width = np.full((INPUTS, 1), bits - 2, U)
    width[-1] = bits - 1
    offset = np.zeros((INPUTS, 1), np.int64)
    offset[-2:, 0] = 1 << (bits - 2), 1 << (bits - 1)
    width, offset = width[kinds], offset[kinds]
    top = (np.int64(1) << width.astype(np.int64)) - 16

    def each():
        for d in range(DEPTH):
            n = int(long[d + 1])
            if not n:
                return
            if d % 4 == 0:  # the slots of four steps lie close together, between those of other contexts
                walked = (steps[:n] >> (DEPTH - d)).astype(U) + (U(d) << U(32))
                group = (((hashes[:, :n] + walked * U(0x2545F4914F6CDD1D)) * U(0xD6E8FEB86659FD93)) >> (U(64) - width)).astype(np.int64)
                group = np.minimum(group, top) + offset
            node = 1 << (d % 4) | (steps[:n] >> (DEPTH - d)) & ((1 << (d % 4)) - 1)
            yield d, steps[:n] >> (DEPTH - 1 - d) & 1, group[:, :n] + node

    return place, each()


# ---- counts in a byte each ----------------------------------------------------------------

EXACT = 64
COUNT = np.concatenate([np.arange(EXACT + 1), EXACT * 1.13 ** np.arange(1, 256 - EXACT)])


def packed(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Both counts of a slot in 16 bits; counts over 64 to the nearest step of 13 %."""
    def code(n):
        steps = np.rint(np.log(np.maximum(n, 1) / EXACT) / np.log(1.13)) + EXACT
        return np.where(n <= EXACT, n, np.clip(steps, EXACT, 255)).astype(np.uint16)

    return code(zeros) << np.uint16(8) | code(ones)


def _tables():
    """Stretched probability and count step by packed counts, and the same with one zero or one one left out."""
    zeros, ones = np.repeat(COUNT, 256), np.tile(COUNT, 256)
    stretch, seen = [], []
    for a, b in ((zeros, ones), (np.maximum(zeros - 1, 0), ones), (zeros, np.maximum(ones - 1, 0))):
        stretch.append(np.log((b + 0.4) / (a + 0.4)).astype(np.float32))
        seen.append(np.searchsorted([0.5, 1.5, 3.5, 11.5, 47.5, 255.5, 2047.5], a + b).astype(np.uint8))
    return (stretch[0], np.concatenate(stretch[1:])), (seen[0], np.concatenate(seen[1:]))


BIAS = np.float32(0.3)
STRETCH, SEEN = _tables()  # [1] is asked at packed counts + 65536 * (bit to leave out)


@dataclass
class Mixer:
    """Counts by slot, the gated weights, the refinement and the code of bytes."""

    bits: int
    counts: np.ndarray  # (2 ** bits) of packed counts
    weights: np.ndarray  # (INPUTS + 1, GATES)
    refined: np.ndarray  # (DEPTH, STEPS) probabilities of a one
    code: Code = field(default_factory=lambda: PLAIN)

    def seen(self, slots: np.ndarray, taken: np.ndarray | None = None):
        """Stretched probabilities and count steps of slots; with `taken`, own occurrences left out."""
        at = self.counts.take(slots).astype(np.int32)
        if taken is not None:
            at += (taken << 16).astype(np.int32)
        own = 0 if taken is None else 1
        return STRETCH[own].take(at), SEEN[own].take(at)

    def inputs(self, slots: np.ndarray, taken: np.ndarray | None = None):
        """Predictions as (INPUTS, n), and the gate of each; with `taken`, own occurrences left out."""
        x, seen = self.seen(slots, taken)
        return x, (np.minimum(seen[ORDERS + 1], 3) + 4 * seen[ORDERS]).astype(np.intp)

    def stems(self, nodes: Nodes, own: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The stems' symbols and first decisions; then by decision the predictions, (INPUTS - 1, decisions), and 4 times the count step of the token."""
        symbols = nodes.symbols(self.code)
        long = self.code.length[symbols].astype(np.int64)
        first = np.cumsum(long) - long
        x, gate = np.empty((INPUTS - 1, int(long.sum())), np.float32), np.empty(int(long.sum()), np.uint8)
        for lo in range(0, len(first), WINDOW):
            some = slice(lo, lo + WINDOW)
            place, each = decisions(symbols[some], nodes.stem_hashes(some), self.bits, self.code, slice(0, INPUTS - 1))
            at = first[some][place]
            for d, taken, slots in each:
                found, seen = self.seen(slots, taken if own else None)
                decision = at[:len(taken)] + d
                for k in range(INPUTS - 1):
                    x[k, decision] = found[k]
                gate[decision] = 4 * seen[ORDERS]
        return symbols, first, x, gate

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        total = self.weights[INPUTS].take(gate) * BIAS
        for k in range(INPUTS):
            total += x[k] * self.weights[k].take(gate)
        return clipped(total)

    def fine(self) -> np.ndarray:
        """The probability of a one after refinement by decision and mixed probability, (DEPTH, FINE)."""
        stretch = np.linspace(-12, 12, FINE)
        return np.array([np.interp(stretch, np.linspace(-12, 12, STEPS), r) + 1 / (1 + np.exp(-stretch)) for r in self.refined]) / 2

    def final(self, d: int, stretch: np.ndarray) -> np.ndarray:
        """The probability of a one after refinement."""
        return self.fine()[d].take(step_of(stretch, FINE))

    def log10(self, words: list[bytes]) -> np.ndarray:
        """log10 of the probability of each word, as a text without an end, (words, 1)."""
        data = spelled(words)
        lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
        return self.texts(data, np.cumsum(lengths) - lengths)[:, None]

    def texts(self, data: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """log10 of the probability of each of the texts that lie one after the other in data."""
        words, own, first = read(data, begins)
        return np.add.reduceat(self.tokens(words, own, first), first)

    def tokens(self, words: Words, own: np.ndarray, first: np.ndarray) -> np.ndarray:
        """log10 of the probability of each token of the texts; ``first``: the first token of each text."""
        out = np.empty(len(own))
        for lo, hi, pairs in pieces(words, own, first):
            out[lo:hi] = np.concatenate([nodes.sums(self.logs(nodes)) for _, nodes in pairs.parts()])[pairs.of]
        return out / np.log(10)

    def logs(self, nodes: Nodes) -> np.ndarray:
        """The logarithm of the probability of each node's byte."""
        symbols, first, x, gates = self.stems(nodes, False)
        # what the stems add, for each count step of the token after another
        mixed = np.empty((len(gates), 4), np.float32)
        for lo in range(0, len(gates), WINDOW):
            some = x[:, lo:lo + WINDOW]
            for step in range(4):
                gate = gates[lo:lo + WINDOW] + step
                mixed[lo:lo + WINDOW, step] = BIAS * self.weights[INPUTS].take(gate) + sum(
                    some[k] * self.weights[k].take(gate) for k in range(INPUTS - 1))
        own, fine = self.weights[INPUTS - 1].copy(), self.fine()
        final = np.log(np.concatenate([1 - fine, fine], axis=1)).astype(np.float32)
        mixed, found = mixed.reshape(-1), np.empty(len(nodes.stem), np.float32)
        for lo in range(0, len(found), WINDOW):
            stem = nodes.stem[lo:lo + WINDOW]
            place, each = decisions(symbols[stem], nodes.hashes(slice(lo, lo + WINDOW)), self.bits, self.code, slice(INPUTS - 1, None))
            at, logs = first[stem[place]], np.zeros(len(stem), np.float32)
            for d, taken, slots in each:
                last, step = self.seen(slots[0])
                step = np.minimum(step, 3)
                decision = at[:len(taken)] + d
                last *= own.take(gates.take(decision) + step)
                decision *= 4
                decision += step
                last += mixed.take(decision)
                logs[:len(taken)] += final[d].take(step_of(clipped(last), FINE) + taken * FINE)
            found[lo + place] = logs
        return found


def step_of(stretch: np.ndarray, steps: int) -> np.ndarray:
    """The nearest of as many steps from -12 to 12."""
    where = stretch * np.float32((steps - 1) / 24)
    where += np.float32((steps - 1) / 2 + 0.5)
    return where.astype(np.intp)


def clipped(total: np.ndarray) -> np.ndarray:
    return np.minimum(np.maximum(total, np.float32(-11), out=total), np.float32(11), out=total)


def fresh_mixer(bits: int, counts: np.ndarray, code: Code = PLAIN) -> Mixer:
    weights = np.full((INPUTS + 1, GATES), 0.3, np.float32)
    weights[INPUTS] = 0
    edges = np.linspace(-12, 12, STEPS)
    return Mixer(bits, counts.reshape(-1), weights, np.tile(1 / (1 + np.exp(-edges)), (DEPTH, 1)), code)


def add_texts(table: np.ndarray, data: np.ndarray, begins: np.ndarray, bits: int, code: Code = PLAIN, n: np.ndarray | None = None) -> None:
    """Adds the decisions of texts to counts, (2 ** bits, 2); ``n``: how often the token of each byte counts."""
    flat = table.reshape(-1)
    words, own, first = read(data, begins)
    often = None if n is None else n[data == 32]
    for lo, hi, pairs in pieces(words, own, first):
        times = np.bincount(pairs.of, None if n is None else often[lo:hi], len(pairs.own))
        for some, nodes in pairs.parts():
            symbols, weight = nodes.symbols(code), nodes.weights(times[some])
            _add(flat, symbols, nodes.stem_hashes, np.bincount(nodes.stem, weight, len(symbols)), bits, code, slice(0, INPUTS - 1))
            _add(flat, symbols[nodes.stem], nodes.hashes, weight, bits, code, slice(INPUTS - 1, None))


def _add(flat: np.ndarray, symbols: np.ndarray, hashes: Callable, times: np.ndarray, bits: int, code: Code, kinds: slice) -> None:
    times = times.astype(flat.dtype)
    for at in range(0, len(times), WINDOW):
        some = slice(at, at + WINDOW)
        place, each = decisions(symbols[some], hashes(some), bits, code, kinds)
        n = times[some][place]
        for _, taken, slots in each:
            for row in slots:
                np.add.at(flat, row * 2 + taken, n[:len(taken)])


def add_counts(table: np.ndarray, words: list[bytes], n: np.ndarray, bits: int, often: int, code: Code = PLAIN) -> None:
    """Adds n occurrences of each word, as a text of its own seen ``often`` times at least, to counts, (2 ** bits, 2)."""
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    add_texts(table, spelled(words), np.cumsum(lengths) - lengths, bits, code, np.repeat(np.where(n >= often, n, 0), lengths))


def learn(mixer: Mixer, data: np.ndarray, begins: np.ndarray, followed: np.ndarray, rate: float = 0.1) -> None:
    """Gradient steps on the weights along these texts.

    Adds to followed (2, DEPTH, STEPS) how often each step of the mixed probability led to 0 and to 1.
    """
    for nodes, n in ((nodes, times[some]) for _, _, pairs in pieces(*read(data, begins))
                     for times in [np.bincount(pairs.of, minlength=len(pairs.own)).astype(np.float32)] for some, nodes in pairs.parts()):
        symbols, first, stretched, gates = mixer.stems(nodes, True)
        weight = nodes.weights(n).astype(np.float32)
        batches = -(-len(weight) // WINDOW)
        for batch in range(batches):  # runs of nodes from all over the piece
            some = (np.arange(batch * RUN, len(weight), batches * RUN)[:, None] + np.arange(RUN)).ravel()
            some = some[:np.searchsorted(some, len(weight))]
            stem = nodes.stem[some]
            place, each = decisions(symbols[stem], nodes.hashes(some), mixer.bits, mixer.code, slice(INPUTS - 1, None))
            at, weights = first[stem[place]], weight[some[place]]
            for d, taken, slots in each:
                last, step = mixer.seen(slots[0], taken)
                decision, times = at[:len(taken)] + d, weights[:len(taken)]
                x = [*(k.take(decision) for k in stretched), last]
                gate = (gates.take(decision) + np.minimum(step, 3)).astype(np.intp)
                z = mixer.mixed(x, gate)
                followed[:, d] += np.bincount(step_of(z, STEPS) + STEPS * taken, times, 2 * STEPS).reshape(2, STEPS)
                error = (taken.astype(np.float32) - 1 / (1 + np.exp(-z))) * times
                scale = rate / np.maximum(np.bincount(gate, times, GATES), 1)
                for k in range(INPUTS):
                    mixer.weights[k] += scale * np.bincount(gate, error * x[k], GATES)
                mixer.weights[INPUTS] += scale * BIAS * np.bincount(gate, error, GATES)


# ---- the corpus ----------------------------------------------------------------------------

def _run(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Texts as they are coded, one after the other, with their ends; where each begins; their sizes in UTF-8."""
    coded, sizes = [], []
    for t in texts:
        raw = (t or "").encode()
        sizes.append(len(raw))
        words = raw.translate(LOWER).split()
        coded.append(b" ".join(words) + b"  " if words else b" ")
    long = np.fromiter(map(len, coded), np.int64, len(coded))
    return np.frombuffer(b"".join(coded), np.uint8), np.cumsum(long) - long, sizes


def _blocks(df: DataFrame) -> DataFrame:
    """df: id, t, held. Rows of kind 0 are a block's tokens with their terminators, of kind 1 its documents."""
    kind = df.schema["id"].dataType.simpleString()
    schema = pa.schema([("kind", pa.int32()), ("block", pa.int64()), ("at", pa.int32()), ("token", pa.binary()), ("n", pa.int64()),
                        ("id", _arrow(kind)), ("held", pa.bool_()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("ats", pa.binary())])

    def block(number, rows):
        data, begins, sizes = np.concatenate(rows["data"]), np.array(rows["begins"]), rows["size"]
        rows["data"].clear()
        stops = np.append(0, np.flatnonzero(data == 32) + 1).astype(np.int32)
        found, at = encoded(stops, data)
        first = np.searchsorted(stops, np.append(begins, len(data)))  # each document's first token
        learned = np.repeat(~np.array(rows["held"], bool), np.diff(first))
        n = len(found)
        total = np.bincount(at[learned], minlength=n)
        nulls = lambda k, t: pa.nulls(k, t)
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, number)), pa.array(np.arange(n, dtype=np.int32)),
             found, pa.array(total.astype(np.int64)),
             *(nulls(n, schema.field(c).type) for c in ("id", "held", "n_bytes", "n_tokens", "ats"))], schema=schema)
        d = len(sizes)
        packs = [pa.compress(at[lo:hi].tobytes(), "zstd", asbytes=True) for lo, hi in zip(first, first[1:])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.ones(d, np.int32)), pa.array(np.full(d, number)), nulls(d, pa.int32()), nulls(d, pa.binary()), nulls(d, pa.int64()),
             pa.array(rows["id"], schema.field("id").type), pa.array(rows["held"]),
             pa.array(sizes, pa.int64()), pa.array(np.diff(first), pa.int64()), pa.array(packs, pa.binary())], schema=schema)

    def run(batches):
        number = TaskContext.get().partitionId() << 32
        rows, size = {"id": [], "held": [], "data": [], "begins": [], "size": []}, 0
        for part in slices(batches, 1, 4 << 20):
            data, begins, sizes = _run(part.column(1).to_pylist())
            for name, more in (("id", part.column(0).to_pylist()), ("held", part.column(2).to_pylist()), ("data", [data]),
                               ("begins", (begins + size).tolist()), ("size", sizes)):
                rows[name] += more
            size += len(data)
            if size >= BLOCK_BYTES or len(rows["id"]) >= 100_000:
                yield from block(number, rows)
                number += 1
                rows, size = {k: [] for k in rows}, 0
        if rows["id"]:
            yield from block(number, rows)

    return arrow_map(df, run, f"kind int, block long, at int, token binary, n long, id {kind}, held boolean, "
                              "n_bytes long, n_tokens long, ats binary")


def _arrow(kind: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[kind]


def _byte_code(vocabulary: DataFrame) -> Code:
    """The codes of bytes by how often training tokens hold them after another."""
    def run(batches):
        seen = np.zeros(1 << 16)
        for batch in batches:
            words = batch.column(0).to_pylist()
            if words:
                data = np.frombuffer(b"".join(words), np.uint8)
                times = np.repeat(batch.column(1).to_numpy(), np.fromiter(map(len, words), np.int64, len(words)))
                seen += np.bincount(np.append(np.uint8(32), data[:-1]).astype(np.int64) << 8 | data, times, 1 << 16)
        used = np.flatnonzero(seen)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(seen[used])], ["pair", "seen"])

    found = arrow_map(vocabulary, run, "pair long, seen double").groupBy("pair").agg(F.sum("seen").alias("seen")).collect()
    seen = np.zeros(1 << 16)
    for r in found:
        seen[r.pair] = r.seen
    return codes_after(seen.reshape(256, 256))


def _counted(texts: DataFrame, bits: int, code: Code) -> np.ndarray:
    """The packed counts of the texts, added up over tasks."""
    def run(batches):
        table = np.zeros((1 << bits, 2), np.uint32)
        for part in slices(batches, 0, SHARED):
            data, begins, _ = _run(part.column(0).to_pylist())
            add_texts(table, data, begins, bits, code)
        parts = table.reshape(-1, PART * 2)
        used = np.flatnonzero(parts.any(axis=1))
        for at in range(0, len(used), 16):
            some = used[at:at + 16]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(
                [pa.compress(parts[i].tobytes(), "zstd", asbytes=True) for i in some], pa.binary())], ["part", "counts"])

    def add(part: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(PART * 2)
        for c in part["counts"]:
            total += np.frombuffer(pa.decompress(c, PART * 8, "zstd", asbytes=True), np.uint32)
        total = total.reshape(-1, 2)
        return pd.DataFrame({"part": part["part"].iloc[:1], "counts": [packed(total[:, 0], total[:, 1]).tobytes()]})

    summed = arrow_map(texts, run, "part long, counts binary").groupBy("part").applyInPandas(add, "part long, counts binary")
    out = np.zeros(1 << bits, np.uint16)
    for row in summed.toLocalIterator():
        out[row.part * PART:(row.part + 1) * PART] = np.frombuffer(row.counts, np.uint16)
    return out


def _trained(texts: DataFrame, bits: int, code: Code) -> Mixer:
    """Counts, then weights and refinement; tasks learn them apart and are averaged by what they saw."""
    mixer = fresh_mixer(bits, _counted(texts, bits, code), code)
    sent = texts.sparkSession.sparkContext.broadcast(mixer.counts)
    weights, refined = mixer.weights, mixer.refined

    def learned(batches):
        own, followed = Mixer(bits, sent.value, weights.copy(), refined, code), np.zeros((2, DEPTH, STEPS))
        for part in slices(batches, 0, SHARED):
            data, begins, _ = _run(part.column(0).to_pylist())
            learn(own, data, begins, followed)
        yield pa.RecordBatch.from_arrays([pa.array([followed.sum()]), pa.array([own.weights.astype(np.float64).ravel().tolist()]),
                                          pa.array([followed.ravel().tolist()])], ["seen", "w", "f"])

    each = staged(arrow_map(texts, learned, "seen double, w array<double>, f array<double>").where("seen > 0"), "weights")
    w = (each.select("seen", F.posexplode("w").alias("k", "x")).groupBy("k")
         .agg((F.sum(F.col("x") * F.col("seen")) / F.sum("seen")).alias("x")).orderBy("k").collect())
    f = each.select(F.posexplode("f").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").collect()
    if w:
        weights = np.array([x.x for x in w], np.float32).reshape(weights.shape)
        zeros, ones = np.array([x.x for x in f]).reshape(2, DEPTH, STEPS)
        refined = (ones + 20 * refined) / (zeros + ones + 20)
    return Mixer(bits, mixer.counts, weights, refined, code)


def score(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 23, folds: int = 7, fold: int = 2) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte per row."""
    held = held_out(F.col(id_col), folds, fold)
    cut = staged(_blocks(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"), held.alias("held"))), "blocks")
    # one shuffle by token gives every block's rows the corpus counts
    same = Window.partitionBy("token")
    owned = (cut.where("kind = 0").withColumn("n", F.sum("n").over(same))
             .withColumn("first", F.row_number().over(same.orderBy("block")) == 1))
    owned = staged(owned.select("token", "block", "at", "first", "n"), "owned")
    vocabulary = owned.where("first AND n > 0").select("token", "n")
    size = vocabulary.agg(F.count("*"), F.sum("n")).first()
    distinct, total = size[0] or 0, size[1] or 0
    under = float(np.log10(total + distinct + 1)) if total else 0.0
    mixer = _trained(df.where(~held).select(F.col(text_col).alias("t")), bits, _byte_code(vocabulary))
    sent = df.sparkSession.sparkContext.broadcast(mixer)

    docs = cut.where("kind = 1").select(F.col("block").alias("own"), "id", "held", "n_bytes", "n_tokens", "ats")
    kind = docs.schema["id"].dataType.simpleString()

    def run(tokens: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
        own, at = sent.value, np.argsort(tokens["at"].to_numpy())
        words = tokens["token"].to_numpy()[at]
        known = np.log10(tokens["n"].to_numpy()[at] + 1.0)
        words = words_of(pa.array(words, pa.binary()))
        counts = docs["n_tokens"].to_numpy()
        out = np.zeros((len(docs), 3))
        some, held = [], 0
        for i, (pack, count) in enumerate(zip(docs["ats"], counts)):
            some.append(np.frombuffer(pa.decompress(pack, int(count) * 4, "zstd", asbytes=True), np.int32))
            held += count
            if held >= SHARED // 6 or i + 1 == len(docs):
                which, starts = np.concatenate(some), np.cumsum([0, *map(len, some)])[:-1]
                rows = slice(i + 1 - len(some), i + 1)
                out[rows, 0] = np.add.reduceat(known[which], starts)
                out[rows, 1] = np.add.reduceat(known[which] > 0, starts, dtype=np.int64)
                out[rows, 2] = np.add.reduceat(own.tokens(words, which, starts), starts)
                some, held = [], 0
        size = docs["n_bytes"].to_numpy()
        return pd.DataFrame({
            "id": docs["id"], "held_out": docs["held"].astype(bool), "n_tokens": counts,
            "n_known": out[:, 1].astype(np.int64), "train_tokens": total,
            "base_score": out[:, 0] - counts * under, "score": out[:, 2], "n_bytes": size,
            "bits_per_byte": -out[:, 2] * np.log2(10) / np.maximum(size, 1)})

    return (owned.select("block", "at", "token", "n").groupBy("block").cogroup(docs.groupBy("own"))
            .applyInPandas(run, f"id {kind}, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double, n_bytes long, bits_per_byte double")
            .withColumnRenamed("id", id_col))
