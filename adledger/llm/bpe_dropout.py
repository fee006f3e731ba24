"""SentencePiece BPE with seeded merge-dropout, and its exact inverse.

A text becomes the model's normal form: a leading mark, each space as the mark U+2581. No
piece of the vocabulary holds a mark after another character, so the units (marks, then
other characters) are merged apart from each other. Within a unit candidate merges wait in
an agenda ordered by score, then position. When one is taken, a keyed hash of (seed,
document, occurrence, span) decides whether it is skipped for good; so every occurrence is
cut for itself, and the same key gives the same segmentation anywhere. What a unit becomes
when a given set of merges is skipped is a state, kept in a bounded cache with the merges that
lead there. An occurrence starts at its unit's state without skips; as long as its hashes skip
merges of the state it is at, it moves to the state that skips those as well. The state it
stays at is its own result, since merges that are never taken may be skipped or not. What a
batch asks for once is merged on its own instead.

Characters without a piece become byte pieces. A mark that stands in the text itself also
becomes byte pieces, which the library would not do, so that decoding is lossless: decode()
of any encoding is the text. Dropout 0 gives the library's segmentation otherwise.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from adledger.llm.bagminhash import mix
from adledger.llm.common import arrow_map, slices

MARK = "▁"
U = np.uint64
GOLDEN = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
UNITS = re.compile(" *[^ ]+| +")


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The stretches of flat that start there, end to end."""
    ends = np.cumsum(size)
    return flat[np.repeat(start - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]


class Rows:
    """Arrays of any length, end to end."""

    def __init__(self, dtype):
        self.flat, self.size, self.start = np.zeros(0, dtype), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, flat: np.ndarray, size: np.ndarray) -> None:
        self.start = np.concatenate([self.start, len(self.flat) + np.cumsum(size) - size])
        self.size = np.concatenate([self.size, size])
        self.flat = np.concatenate([self.flat, flat])

    def take(self, rows: np.ndarray) -> np.ndarray:
        return gather(self.flat, self.start[rows], self.size[rows])


class Coder:
    """Encodes and decodes with one SentencePiece BPE model with byte pieces."""

    def __init__(self, path: str, dropout: float = 0.1, seed: int = 0, cache: int = 400_000):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(self.pieces))
                 if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        if any(MARK in p.lstrip(MARK) for p in self.pieces):
            raise ValueError("a piece holds a space inside; units cannot be merged apart")
        self.ids = {self.pieces[i]: i for i in plain}
        self.score = {self.pieces[i]: -model.get_score(i) for i in plain}
        self.bytes = {int(self.pieces[i][1:-1], 16): i for i in range(len(self.pieces)) if model.is_byte(i)}
        self.byte_of = {i: b for b, i in self.bytes.items()}
        self.spelled = [bytes((self.byte_of[i],)) if i in self.byte_of else p.replace(MARK, " ").encode()
                        for i, p in enumerate(self.pieces)]
        if len(self.bytes) != 256:
            raise ValueError("the model has no byte pieces; it could not give every text back")
        self.threshold = int(dropout * (1 << 32))
        self.seed = seed
        self.spelled_bytes = np.frombuffer(b"".join(self.spelled), np.uint8)
        self.spelled_size = np.fromiter(map(len, self.spelled), np.int64, len(self.spelled))
        self.spelled_start = np.cumsum(self.spelled_size) - self.spelled_size
        self.cache = cache
        self._forget()
        self._table()

    def _forget(self) -> None:
        """No states: of units without skips by unit, of others by the state before and the bits of its path skipped."""
        self.number: dict[str, int] = {}
        self.forks: dict[tuple[int, int], int] = {}
        self.units: list[str] = []
        self.ids_of, self.paths, self.bans = Rows(np.int32), Rows(U), Rows(U)
        self.simple = np.zeros(0, bool)

    def _merge(self, unit: str, key: int, path: list[int] | None = None) -> list[str]:
        """The pieces of one unit; key 0 skips nothing, and path is given the merges."""
        n, score = len(unit), self.score
        text = list(unit)
        if n == 1:
            return text
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        agenda = [(score[p], i, p) for i in range(n - 1) if (p := unit[i:i + 2]) in score]
        heapify(agenda)
        threshold = self.threshold if key else 0
        while agenda:
            _, i, piece = heappop(agenda)
            j = after[i]
            if not text[i] or j >= n or text[i] + text[j] != piece:
                continue
            span = (i << 42 | j << 21 | after[j]) * GOLDEN
            if threshold:
                h = (key + span) & MASK
                h = ((h ^ (h >> 29)) * 0xBF58476D1CE4E5B9) & MASK
                if (h >> 32) < threshold:
                    continue
            if path is not None:
                path.append(span & MASK)
            text[i], text[j] = piece, ""
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (p := piece + text[k]) in score:
                    heappush(agenda, (score[p], i, p))
            if (k := before[i]) >= 0 and (p := text[k] + piece) in score:
                heappush(agenda, (score[p], k, p))
        return [p for p in text if p]

    def _skipped(self, h: np.ndarray) -> np.ndarray:
        """Whether keys plus merges are skipped."""
        h = (h ^ (h >> U(29))) * U(0xBF58476D1CE4E5B9)
        return (h >> U(32)) < U(self.threshold)

    def _unit(self, unit: str, key: int = 0, path: list[int] | None = None) -> tuple[int, ...]:
        """Ids of a unit as it stands in the text; its spaces stand for marks."""
        out = []
        # a mark of the text itself is no space: it ends a stretch and becomes bytes
        for i, stretch in enumerate(unit.split(MARK)):
            if i:
                out += [self.bytes[b] for b in MARK.encode()]
            own = None if path is None else []
            for piece in self._merge(stretch.replace(" ", MARK), key and key + i, own) if stretch else ():
                number = self.ids.get(piece)
                out += [number] if number is not None else [self.bytes[b] for b in piece.encode()]
            if own:
                path += [(x + i) & MASK for x in own]
        return tuple(out)

    def _table(self) -> None:
        """Symbols as numbers and the pairs of them that make a piece, for _many."""
        symbols = dict(self.ids)
        for c in sorted(set().union(*self.ids)):
            symbols.setdefault(c, len(self.pieces) + len(symbols))
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        self.base = max(symbols.values()) + 1
        pairs = sorted((symbols[p[:k]] * self.base + symbols[p[k:]], i) for p, i in self.ids.items()
                       for k in range(1, len(p)) if p[:k] in symbols and p[k:] in symbols)
        self.pair = np.array([x for x, _ in pairs] + [np.iinfo(np.int64).max], np.int64)
        self.made = np.array([x for _, x in pairs] + [0], np.int32)
        self.byte_id = np.array([self.bytes[b] for b in range(128)] + [-1], np.int32)
        order = {v: i for i, v in enumerate(sorted({self.score[p] for p in self.ids}))}
        self.rank = np.zeros(self.base, np.int32)
        for p, i in self.ids.items():
            self.rank[i] = order[self.score[p]]

    def _many(self, units: list[str], keys: np.ndarray | None = None, bans: Rows | None = None, most: int = 1 << 14):
        """ids, sizes, merges, sizes of what _unit gives, units of few characters in step; bans are skipped without keys.

        With keys no merges are told.
        """
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        simple = self._simple(units, lengths)
        short = np.flatnonzero(simple)
        short = short[np.argsort(lengths[short], kind="stable")]
        parts = []
        for at in range(0, len(short), most):
            rows = short[at:at + most]
            parts += self._step([units[i] for i in rows], lengths[rows], rows, None if keys is None else keys[rows], bans)
        for i in np.flatnonzero(~simple).tolist():
            own = None if keys is not None else []
            ids = self._unit(units[i], 0 if keys is None else int(keys[i]), own)
            parts.append((np.array([i]), np.array(ids, np.int32), np.array([len(ids)]),
                          np.array(own or [], U), np.array([len(own or [])])))
        if not parts:
            return np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, U), np.zeros(0, np.int64)
        rows, ids, n_ids, merges, n_merges = map(np.concatenate, zip(*parts))
        order = np.argsort(rows)
        return (gather(ids, (np.cumsum(n_ids) - n_ids)[order], n_ids[order]), n_ids[order],
                gather(merges, (np.cumsum(n_merges) - n_merges)[order], n_merges[order]), n_merges[order])

    @staticmethod
    def _simple(units: list[str], lengths: np.ndarray) -> np.ndarray:
        """Few characters, and no mark of the text itself among them."""
        return (lengths <= 40) & ~np.fromiter((MARK in u for u in units), bool, len(units))

    def _step(self, units, lengths, rows, keys, bans) -> list[tuple]:
        """rows, ids, sizes, merges, sizes of these units, in one or two parts."""
        n, wide, none = len(units), int(lengths.max()), np.int32(2**31 - 1)
        flat = np.frombuffer("".join(units).replace(" ", MARK).encode("utf-32-le"), np.uint32)
        cell = np.arange(wide) < lengths[:, None]
        code = np.zeros((n, wide), np.uint32)
        code[cell] = flat
        symbol = np.full((n, wide + 1), -1, np.int32)
        symbol[:, :-1][cell] = self.of_char[flat]
        after = np.tile(np.arange(1, wide + 2, dtype=np.int32), (n, 1))
        after = np.minimum(after, lengths[:, None].astype(np.int32))
        before = np.tile(np.arange(-1, wide, dtype=np.int32), (n, 1))
        made = np.zeros((n, wide + 1), np.int32)
        rank = np.full((n, wide + 1), none, np.int32)
        banned = None
        if bans is not None:  # no span is 0
            size = bans.size[rows]
            banned = np.zeros((n, int(size.max(initial=0))), U)
            banned[np.arange(banned.shape[1]) < size[:, None]] = bans.take(rows)

        def span(i, j, end):
            return (i.astype(U) << U(42) | j.astype(U) << U(21) | end.astype(U)) * U(GOLDEN)

        def offer(r, i):
            """Puts the pair that starts at i of row r into the agenda."""
            j = after[r, i]
            ok = j < lengths[r]
            r, i, j = r[ok], i[ok], j[ok]
            want = symbol[r, i].astype(np.int64) * self.base + symbol[r, j]
            k = np.searchsorted(self.pair, want)
            ok = (self.pair[k] == want) & (symbol[r, i] >= 0) & (symbol[r, j] >= 0)
            r, i, j, k = r[ok], i[ok], j[ok], k[ok]
            if keys is not None:
                ok = ~self._skipped(keys[r] + span(i, j, after[r, j]))
                r, i, k = r[ok], i[ok], k[ok]
            elif banned is not None:
                ok = (banned[r] != span(i, j, after[r, j])[:, None]).all(axis=1)
                r, i, k = r[ok], i[ok], k[ok]
            made[r, i] = self.made[k]
            rank[r, i] = self.rank[self.made[k]]

        every = np.arange(n)
        for i in range(wide - 1):
            r = every[lengths > i + 1]
            offer(r, np.full(len(r), i))
        live, taken = every, []
        while len(live):
            i = rank[live].argmin(axis=1)
            ok = rank[live, i] < none
            live, i = live[ok], i[ok]
            j = after[live, i]
            if keys is None:
                taken.append((live, span(i, j, after[live, j])))
            symbol[live, i] = made[live, i]
            symbol[live, j] = -2
            rank[live, j] = none
            rank[live, i] = none
            k = after[live, i] = after[live, j]
            before[live, k] = i
            offer(live, i)
            p = before[live, i]
            left = p >= 0
            rank[live[left], p[left]] = none
            offer(live[left], p[left])
        merges, n_merges = np.zeros(0, U), np.zeros(n, np.int64)
        if taken:
            row, merges = map(np.concatenate, zip(*taken))
            merges = merges[np.argsort(row, kind="stable")]
            n_merges = np.bincount(row, minlength=n)
        left = symbol[:, :-1]
        keep = (left > -2) & cell
        # characters without a piece: of ASCII one byte piece each, rows with others one by one
        bare = keep & ((left >= len(self.pieces)) | (left == -1))
        left[bare] = self.byte_id[np.minimum(code[bare], 128)]
        odd = (bare & (code >= 128)).any(axis=1)
        plain = ~odd
        size = keep.sum(axis=1)
        of_plain, ends = np.repeat(plain, n_merges), np.cumsum(n_merges)
        parts = [(rows[plain], left[keep & plain[:, None]], size[plain], merges[of_plain], n_merges[plain])]
        for r in np.flatnonzero(odd).tolist():
            found = []
            for at in np.flatnonzero(keep[r]).tolist():
                found += [self.bytes[b] for b in units[r][at].encode()] if bare[r, at] else [int(left[r, at])]
            parts.append((rows[r:r + 1], np.array(found, np.int32), np.array([len(found)]),
                          merges[ends[r] - n_merges[r]:ends[r]], n_merges[r:r + 1]))
        return parts

    def _add(self, units: list[str], bans: Rows) -> None:
        """States of units with these merges skipped."""
        ids, n_ids, merges, n_merges = self._many(units, None, bans)
        self.units += units
        self.ids_of.add(ids, n_ids)
        self.paths.add(merges, n_merges)
        self.bans.add(bans.flat, bans.size)
        lengths = np.fromiter(map(len, units), np.int64, len(units))
        self.simple = np.concatenate([self.simple, self._simple(units, lengths)])

    def _learn(self, units: list[str]) -> None:
        """The states of new units without skips."""
        self.number.update(zip(units, range(len(self.units), len(self.units) + len(units))))
        none = Rows(U)
        none.add(np.zeros(0, U), np.zeros(len(units), np.int64))
        self._add(units, none)

    def unskipped(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a unit without skips, and the merges on the way as offsets to a key."""
        if unit not in self.number:
            self._learn([unit])
        at = np.array([self.number[unit]])
        return self.ids_of.take(at), self.paths.take(at)

    def _units(self, text: str, document: int) -> tuple[list[str], np.ndarray]:
        """The units of a text, and the key of each occurrence."""
        units = text.split(" ")
        # the leading mark joins the first unit; runs of spaces need the general cut
        units = UNITS.findall(" " + text) if "" in units else [" " + u for u in units]
        start = U((self.seed * 0x51ED27 + document * GOLDEN) & MASK)
        # 0 is kept for no skips
        return units, mix(np.arange(len(units), dtype=U) * U(0xD6E8FEB86659FD93) + start) | U(1)

    def _forked(self, state: np.ndarray, mask: np.ndarray) -> np.ndarray:
        """The states that skip these bits of the paths of these states as well; -1 for one asked for once and not known."""
        order = np.lexsort((mask, state))
        state, mask = state[order], mask[order]
        new = np.concatenate([[True], (state[1:] != state[:-1]) | (mask[1:] != mask[:-1])])
        first, group = np.flatnonzero(new), np.cumsum(new) - 1
        asked = list(zip(state[first].tolist(), mask[first].tolist()))
        got = np.array([self.forks.get(a, -1) for a in asked], np.int64)
        add = np.flatnonzero((got < 0) & (np.bincount(group) > 1))
        if len(add):
            before, bits = state[first][add], mask[first][add]
            size, old = self.paths.size[before], self.bans.size[before]
            place = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
            on = (np.repeat(bits, size) >> place.astype(U)) & U(1) == U(1)
            of = np.concatenate([np.repeat(np.arange(len(add)), old), np.repeat(np.arange(len(add)), size)[on]])
            merges = np.concatenate([self.bans.take(before), self.paths.take(before)[on]])
            bans = Rows(U)
            bans.add(merges[np.argsort(of, kind="stable")], np.bincount(of, minlength=len(add)))
            got[add] = np.arange(len(self.units), len(self.units) + len(add))
            self.forks.update(zip((asked[i] for i in add.tolist()), got[add].tolist()))
            self._add([self.units[i] for i in before.tolist()], bans)
        out = np.empty(len(order), np.int64)
        out[order] = got[group]
        return out

    def _settle(self, state: np.ndarray, keys: np.ndarray, most: int = 1 << 18) -> None:
        """Moves occurrences to the states they stay at, in place; -1: to be merged on its own."""
        waiting = np.flatnonzero(state >= 0)
        while len(waiting):
            hit, masks = [], []
            for at in range(0, len(waiting), most):
                some = waiting[at:at + most]
                own = state[some]
                size = self.paths.size[own]
                occurrence = np.repeat(np.arange(len(some)), size)
                skips = np.flatnonzero(self._skipped(keys[some][occurrence] + self.paths.take(own)))
                occurrence, place = occurrence[skips], skips - (np.cumsum(size) - size)[occurrence[skips]]
                mask = np.zeros(len(some), U)
                # a path of over 40 merges has a state that is not simple, and its mask is not asked
                np.bitwise_or.at(mask, occurrence, U(1) << np.minimum(place, 63).astype(U))
                skipped = np.flatnonzero(mask)
                hit.append(some[skipped])
                masks.append(mask[skipped])
            waiting, mask = np.concatenate(hit), np.concatenate(masks)
            simple = self.simple[state[waiting]]
            state[waiting[~simple]] = -1
            waiting, mask = waiting[simple], mask[simple]
            if len(waiting):
                state[waiting] = self._forked(state[waiting], mask)
                waiting = waiting[state[waiting] >= 0]

    def encode_batch(self, texts: list[str], documents: list[int]) -> list[np.ndarray]:
        """Ids of each text; the documents key the skips."""
        cut = [self._units(t, d) if t else ([], np.zeros(0, U)) for t, d in zip(texts, documents)]
        every = [u for units, _ in cut for u in units]
        if len(self.units) > self.cache:
            self._forget()
        self._learn([u for u, n in Counter(every).items() if u not in self.number and (n > 1 or not self.threshold)])
        state = np.array([self.number.get(u, -1) for u in every], np.int64)
        if self.threshold and every:
            keys = np.concatenate([k for _, k in cut])
            self._settle(state, keys)
        own = np.flatnonzero(state < 0)
        ids, n_ids = self._many([every[i] for i in own.tolist()], keys[own])[:2] if len(own) else (np.zeros(0, np.int32), 0)
        known = len(self.ids_of.flat)
        start, size = np.zeros(len(every), np.int64), np.zeros(len(every), np.int64)
        there = state >= 0
        start[there], size[there] = self.ids_of.start[state[there]], self.ids_of.size[state[there]]
        start[own], size[own] = known + np.cumsum(n_ids) - n_ids, n_ids
        flat = gather(np.concatenate([self.ids_of.flat, ids]), start, size)
        ends = np.concatenate([[0], np.cumsum(size)])[np.cumsum([0, *(len(units) for units, _ in cut)])]
        return [flat[a:b] for a, b in zip(ends.tolist(), ends[1:].tolist())]

    def encode(self, text: str, document: int = 0) -> np.ndarray:
        return self.encode_batch([text], [document])[0]

    def decode(self, ids) -> str:
        """The text of an encoding."""
        return self.spell(np.asarray(ids, np.int64)).decode()[1:]

    def spell(self, ids: np.ndarray) -> bytes:
        """The bytes that ids stand for, with the leading mark's space."""
        return gather(self.spelled_bytes, self.spelled_start[ids], self.spelled_size[ids]).tobytes()


def encode_texts(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1,
                 seed: int = 0) -> DataFrame:
    """id, ids (array<int>) per row; null counts as empty, which has no pieces.

    The skips are keyed by the id (null: 0), so equal rows are encoded alike.
    """
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = Coder(path, dropout, seed)
        for part in slices(batches, 1, 4 << 20):
            rows = coder.encode_batch([t or "" for t in part.column(1).to_pylist()], list(map(hash_id, part.column(0).to_pylist())))
            yield pa.RecordBatch.from_arrays([part.column(0), _lists(rows)], [id_col, "ids"])

    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, ids array<int>")


def decode_ids(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """id, text per row; a null list gives a null text."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = Coder(path, 0.0)
        for batch in batches:
            texts = [None if x is None else coder.decode(x) if x else "" for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], [id_col, "text"])

    return arrow_map(df.select(id_col, ids_col), run, f"`{id_col}` {kind}, text string")


def hash_id(value) -> int:
    if isinstance(value, int):
        return value & MASK
    return 0 if value is None else int.from_bytes(hashlib.blake2b(str(value).encode(), digest_size=8).digest(), "little")


def _lists(rows: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)], dtype=np.int64)
    values = np.concatenate([*rows, np.zeros(0, np.int32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def encoding_digest(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", dropout: float = 0.1,
                    seed: int = 0) -> DataFrame:
    """id, n_bytes, n_pieces, n_byte_pieces, ids_sha256 (of little-endian 32-bit ids), lossless per row."""
    kind = df.schema[id_col].dataType.simpleString()

    def run(batches):
        coder = Coder(path, dropout, seed)
        marks = np.zeros(len(coder.pieces), bool)
        marks[list(coder.byte_of)] = True
        for part in slices(batches, 1, 4 << 20):
            texts = [t or "" for t in part.column(1).to_pylist()]
            rows = coder.encode_batch(texts, list(map(hash_id, part.column(0).to_pylist())))
            data = [t.encode() for t in texts]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(map(len, data), pa.int64()),
                 pa.array(map(len, rows), pa.int64()), pa.array([int(marks[r].sum()) for r in rows], pa.int64()),
                 pa.array([hashlib.sha256(r.astype("<i4").tobytes()).hexdigest() for r in rows]),
                 pa.array([coder.spell(r)[1:] == t for r, t in zip(rows, data)], pa.bool_())],
                [id_col, "n_bytes", "n_pieces", "n_byte_pieces", "ids_sha256", "lossless"])

    return arrow_map(df.select(id_col, text_col), run, f"`{id_col}` {kind}, n_bytes long, n_pieces long, "
                                                       "n_byte_pieces long, ids_sha256 string, lossless boolean")
