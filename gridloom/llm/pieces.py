"""Byte-pair pieces: the vocabulary of a SentencePiece model, and its merges
worked off through an agenda, with or without seeded merge-dropout.

The agenda holds the adjacent symbol pairs whose joined text is a piece, best
score first, leftmost first among equals. With dropout, a popped candidate is
skipped if a keyed hash of (seed, document, unit's place in the text, position,
piece) falls below the rate, so each occurrence of a word draws for itself, and
a seed and a document always give the same segmentation, on any executor and
after any retry. No skipped merge changes the text: every segmentation decodes
to what was encoded.

A text is cut into units, a run of spaces and the letters up to the next space:
no piece crosses from a letter to a following space, so units are encoded apart.
What is remembered of a unit is its segmentation without dropout and the merges
that lead there: where none of these is skipped it stands, all other occurrences
work off an agenda of their own. A literal U+2581, which the library would take for a space, is
encoded by its bytes instead and so survives the round trip.

Defined results: a null text counts as empty; an empty text has no pieces. For
a null id the text is the document's key. Repeated rows get equal segmentations. Columns other
than the id and the text are ignored or, with ``encode_column``, passed on.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, types as T

from .workers import kept, parts, task

SEED, RATE = 20_240_601, 0.1
REMEMBERED = 150_000
#: Longer units are not remembered.
LONGEST = 32
_UNIT = re.compile(r" *[^ ]+| +")
_MASK = (1 << 64) - 1
NONE = 1 << 30
K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def skipped(h: np.ndarray, limit: int) -> np.ndarray:
    """Whether a merge is skipped; h is (occurrence's key ^ position * K1) + piece * K2."""
    return (((h ^ (h >> np.uint64(31))) * K3) >> np.uint64(32)) < limit


def _slots(keys: np.ndarray, bits: int, probe: int) -> np.ndarray:
    h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (((h >> np.uint64(64 - bits)) + np.uint64(probe)) & np.uint64((1 << bits) - 1)).astype(np.int64)


def default_model() -> str:
    """Place of the public model; ``GRIDLOOM_PIECE_MODEL`` names another."""
    named = os.environ.get("GRIDLOOM_PIECE_MODEL")
    if named:
        return named
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    """Pieces by text, with " " for the space mark."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte_id, self.raw, score = {}, [b""] * n, [0.0] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_id[int(piece[3:5], 16)] = i
                self.raw[i] = bytes([int(piece[3:5], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                text = piece.replace("▁", " ")
                self.ids[text] = i
                self.raw[i] = text.encode()
                score[i] = model.get_score(i)
        order = sorted(self.ids.values(), key=lambda i: -score[i])
        self.rank = {i: r for r, i in enumerate(order)}
        self.chars = {t for t in self.ids if len(t) == 1}
        self.texts = {i: t for t, i in self.ids.items()}
        self._pairs = self._by_rank = self._letters = None
        self._halves: dict[int, tuple[int, int] | None] = {}

    def symbols(self, unit: str, skip=None, trace: list | None = None) -> list[str]:
        """The unit's final symbols. ``skip(position, piece)`` drops a popped
        merge; ``trace`` gets the length of each merge's left side."""
        n = len(unit)
        if n == 1:
            return [unit]
        ids, rank = self.ids, self.rank
        text: list = list(unit)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        agenda = []
        for i in range(n - 1):
            m = ids.get(text[i] + text[i + 1])
            if m is not None:
                agenda.append((rank[m], i, m, 2))
        heapq.heapify(agenda)
        while agenda:
            _, i, m, size = heapq.heappop(agenda)
            if text[i] is None or right[i] >= n:
                continue
            j = right[i]
            if len(text[i]) + len(text[j]) != size:
                continue  # one of the two has grown since
            if skip is not None and skip(i, m):
                continue
            if trace is not None:
                trace.append(len(text[i]))
            text[i] += text[j]
            text[j] = None
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                m = ids.get(text[i] + text[k])
                if m is not None:
                    heapq.heappush(agenda, (rank[m], i, m, len(text[i]) + len(text[k])))
            h = left[i]
            if h >= 0:
                m = ids.get(text[h] + text[i])
                if m is not None:
                    heapq.heappush(agenda, (rank[m], h, m, len(text[h]) + len(text[i])))
        return [t for t in text if t is not None]

    def of_symbols(self, symbols) -> list[int]:
        out = []
        for s in symbols:
            i = self.ids.get(s)
            if i is None:
                out += [self.byte_id[b] for b in s.encode()]
            else:
                out.append(i)
        return out

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Open-addressed table of left id * 2^20 + right id -> rank of the joined piece."""
        if self._pairs is None:
            keys, vals = [], []
            for text, i in self.ids.items():
                for k in range(1, len(text)):
                    a, b = self.ids.get(text[:k]), self.ids.get(text[k:])
                    if a is not None and b is not None:
                        keys.append(a << 20 | b)
                        vals.append(self.rank[i])
            bits = max(16, (len(keys) * 8).bit_length())
            table, rank = np.full(1 << bits, -1, np.int64), np.full(1 << bits, NONE, np.int32)
            todo_k, todo_v, probe = np.array(keys, np.int64), np.array(vals, np.int32), 0
            while len(todo_k):
                slot = _slots(todo_k, bits, probe)
                free = table[slot] < 0
                table[slot[free]] = todo_k[free]  # the last of equals stays
                rank[slot[free]] = todo_v[free]
                won = table[slot] == todo_k
                todo_k, todo_v, probe = todo_k[~won], todo_v[~won], probe + 1
            self._pairs = table, rank, bits, probe
        return self._pairs

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each joined pair of ids; NONE if it is no piece (ids < 0 join with nothing)."""
        table, rank, bits, probes = self.pairs()
        out = np.full(a.shape, NONE, np.int32)
        key = a.astype(np.int64) << 20 | b
        todo = np.flatnonzero((a >= 0) & (b >= 0))
        key = key.ravel()[todo]
        flat = out.reshape(-1)
        for probe in range(probes):
            slot = _slots(key, bits, probe)
            found = table[slot]
            hit = found == key
            flat[todo[hit]] = rank[slot[hit]]
            on = ~hit & (found >= 0)
            todo, key = todo[on], key[on]
            if not len(todo):
                break
        return out

    def many(self, units: list[str], keys: np.ndarray | None = None, limit: int = 0, merges: list | None = None) -> list[bytes]:
        """Ids (as int32 bytes) of units of about one length, the agendas of all
        worked off side by side: in each round every unit merges its best
        candidate, but for those that its key skips. ``merges`` gets each round's
        units, positions and pieces. Symbols stay where their first letter stands; ``nxt`` and
        ``prv`` lead to their neighbours."""
        n, width = len(units), max(map(len, units))
        points = np.frombuffer("".join([u.ljust(width, "\uffff") for u in units]).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(n, width)
        length = np.array([len(u) for u in units])
        inside = np.arange(width) < length[:, None]
        whole = np.full((n, width + 1), -2, np.int32)
        whole[:, :-1] = np.where(inside, self.letters()[points], -2)
        id_of = self.by_rank()

        def ranked(a, b, place, who):
            got = self.ranks_of(a, b)
            if limit:
                on = np.flatnonzero(got < NONE)
                if len(on):
                    h = (keys[who[on]] ^ (place[on].astype(np.uint64) * K1)) + id_of[got[on]].astype(np.uint64) * K2
                    got[on[skipped(h, limit)]] = NONE
            return got

        live, sym = np.arange(n), whole.copy()
        nxt = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), (n, width + 1)).copy()
        prv = np.broadcast_to(np.arange(-1, width, dtype=np.int32), (n, width + 1)).copy()
        rank = np.full((n, width + 1), NONE, np.int32)
        r, k = np.nonzero((sym[:, :-1] >= 0) & (sym[:, 1:] >= 0))
        rank[r, k] = ranked(sym[r, k], sym[r, k + 1], k, r)
        while len(live):
            best = rank.argmin(axis=1)
            row = np.arange(len(live))
            top = rank[row, best]
            on = top < NONE
            if not on.all():
                whole[live[~on]] = sym[~on]
                if not on.any():
                    break
                live, sym, nxt, prv, rank, best, top = live[on], sym[on], nxt[on], prv[on], rank[on], best[on], top[on]
                row = np.arange(len(live))
            if merges is not None:
                merges.append((live, best, id_of[top]))
            gone = nxt[row, best]
            after = nxt[row, gone]
            sym[row, best], sym[row, gone] = id_of[top], -3
            rank[row, gone] = NONE
            nxt[row, best] = after
            ok = after <= width
            prv[row[ok], after[ok]] = best[ok]
            rank[row, best] = NONE
            rank[row[ok], best[ok]] = ranked(sym[row[ok], best[ok]], sym[row[ok], after[ok]], best[ok], live[ok])
            before = prv[row, best]
            ok = before >= 0
            rank[row[ok], before[ok]] = ranked(sym[row[ok], before[ok]], sym[row[ok], best[ok]], before[ok], live[ok])
        flat, ends = whole[whole >= 0].astype("<i4").tobytes(), (np.cumsum((whole >= 0).sum(axis=1)) * 4).tolist()
        out = [flat[a:b] for a, b in zip([0, *ends], ends)]
        for k in np.flatnonzero((whole == -1).any(axis=1)).tolist():  # with letters that are no pieces
            ids: list[int] = []
            for i, c in zip(whole[k].tolist(), units[k]):
                if i == -1:
                    ids += [self.byte_id[x] for x in c.encode()]
                elif i >= 0:
                    ids.append(i)
            out[k] = np.array(ids, "<i4").tobytes()
        return out

    def by_rank(self) -> np.ndarray:
        if self._by_rank is None:
            self._by_rank = np.zeros(len(self.rank), np.int32)
            for i, r in self.rank.items():
                self._by_rank[r] = i
        return self._by_rank

    def letters(self) -> np.ndarray:
        """Code point -> id of the piece that is this letter; -1 if there is none."""
        if self._letters is None:
            self._letters = np.full(0x110000, -1, np.int32)
            for c in self.chars:
                self._letters[ord(c)] = self.ids[c]
        return self._letters

    def halves(self, i: int) -> tuple[int, int] | None:
        """The two pieces whose merge makes piece i last; None for a letter, and
        for a piece that the merges never make."""
        got = self._halves.get(i, False)
        if got is False:
            text, trace = self.texts[i], []
            whole = self.symbols(text, trace=trace)
            got = None
            if len(text) > 1 and len(whole) == 1:
                k = trace[-1]
                got = self.ids[text[:k]], self.ids[text[k:]]
            self._halves[i] = got
        return got

    def made(self, i: int) -> bool:
        return len(self.texts[i]) == 1 or self.halves(i) is not None

    def fit(self, a: int, b: int) -> bool:
        """Whether pieces a, b side by side are the segmentation of their text.

        The merges are undone, latest first; where the symbols that then meet
        would have merged before the step just undone, a and b don't stand."""
        limit, rank = NONE, self.rank
        while True:
            m = self.ids.get(self.texts[a] + self.texts[b])
            if m is not None and rank[m] < limit:
                return False
            ha, hb = self.halves(a), self.halves(b)
            ra, rb = rank[a] if ha else -1, rank[b] if hb else -1
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, ha[1]
            else:  # of equals the left one merges first
                limit, b = rb + 1, hb[0]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, np.frombuffer(ids, "<i4").tolist())).decode()[1:]


@lru_cache(maxsize=2)
def pieces(model_file: str) -> Pieces:
    return Pieces(model_file)


class Encoder:
    """Texts to piece ids; undropped segmentations of common units are
    remembered, up to a bound after which the memory starts afresh."""

    def __init__(self, model_file: str, seed: int = SEED, rate: float = RATE):
        self.pieces = pieces(model_file)
        self.seed, self.limit = seed, int(rate * (1 << 32))
        #: By key of an occurrence; only of key 0, which skips no merge.
        self.known: list[dict[str, bytes]] = [{}]
        self._forget()

    def _forget(self) -> None:
        """Each unit's number, and by it: letters, where its merges start and,
        ended by the next one's start, the two terms of each merge's hash."""
        self.known[0].clear()
        self.number: dict[str, int] = {}
        self.size, self.start, self.place, self.piece = array("q"), array("q", [0]), array("Q"), array("Q")

    def alone(self, unit: str, key: int) -> list[int]:
        """Ids of one unit, by an agenda of its own."""
        if not (key and self.limit):
            return self.pieces.of_symbols(self.pieces.symbols(unit))
        limit = self.limit

        def skip(position: int, piece: int) -> bool:
            h = ((key ^ (position * 0x9E3779B97F4A7C15 & _MASK)) + piece * 0xC2B2AE3D27D4EB4F) & _MASK
            h = ((h ^ (h >> 31)) * 0xD6E8FEB86659FD93) & _MASK
            return (h >> 32) < limit

        return self.pieces.of_symbols(self.pieces.symbols(unit, skip))

    def occurrences(self, texts: list[str | None], keys: list, counts: list[int]) -> np.ndarray:
        """A key for each unit of each text, never 0."""
        of_text = np.array([xxhash.xxh64_intdigest((t or "") if k is None else str(k), self.seed & _MASK) for t, k in zip(texts, keys)], np.uint64)
        ends = np.cumsum(counts)
        place = np.arange(1, ends[-1] + 1) - np.repeat(ends - counts, counts)
        h = (np.repeat(of_text, counts) ^ place.astype(np.uint64) * K1) * K2
        h = (h ^ (h >> np.uint64(29))) * K3
        return h ^ (h >> np.uint64(32)) | np.uint64(1)

    def encode(self, texts: list[str | None], keys: list | None = None) -> list[bytes]:
        """The ids of each text, as little-endian int32."""
        if not texts:
            return []
        split = [_UNIT.findall(" " + t) if t else [] for t in texts]
        known = self.known[0]
        if len(known) > REMEMBERED:
            self._forget()
        self._learn([u for u in set(chain.from_iterable(split)) if u not in known])
        units = list(chain.from_iterable(split))
        coded, counts = list(map(known.get, units)), list(map(len, split))
        drawn = self.occurrences(texts, keys or [None] * len(texts), counts) if self.limit else np.zeros(len(units), np.uint64)
        numbers = np.fromiter(map(self.number.get, units, repeat(-1)), np.int64, len(units))
        for i in np.flatnonzero(numbers < 0).tolist():
            coded[i] = np.array(self.alone(units[i], int(drawn[i])), "<i4").tobytes()
        if self.limit:
            again, size = self._dropped(numbers, drawn), np.array(self.size)
            again = again[np.argsort(size[numbers[again]], kind="stable")]
            for a, b in _runs(size[numbers[again]].tolist()):
                part = again[a:b].tolist()
                for i, ids in zip(part, self.pieces.many([units[i] for i in part], drawn[part], self.limit)):
                    coded[i] = ids
        ends = np.cumsum(counts).tolist()
        return [b"".join(coded[a:b]) for a, b in zip([0, *ends], ends)]

    def _dropped(self, numbers: np.ndarray, drawn: np.ndarray) -> np.ndarray:
        """The occurrences of remembered units that skip a merge of the undropped segmentation."""
        start, place, piece = np.array(self.start), np.frombuffer(self.place, np.uint64), np.frombuffer(self.piece, np.uint64)
        out = [np.zeros(0, np.int64)]
        for i in range(0, len(numbers), 1 << 14):
            who = i + np.flatnonzero(numbers[i : i + (1 << 14)] >= 0)
            first = start[numbers[who]]
            n = start[numbers[who] + 1] - first
            at = np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum())
            row = np.repeat(np.arange(len(who)), n)
            hit = np.zeros(len(who), bool)
            hit[row[skipped((drawn[who][row] ^ place[at]) + piece[at], self.limit)]] = True
            out.append(who[hit])
        return np.concatenate(out)

    def _learn(self, units: list[str]) -> None:
        units = sorted((u for u in units if len(u) <= LONGEST), key=len)
        for a, b in _runs(list(map(len, units))):
            part, merges = units[a:b], [(np.zeros(0, np.int64),) * 3]
            self.known[0].update(zip(part, self.pieces.many(part, merges=merges)))
            who, place, piece = map(np.concatenate, zip(*merges))
            order = np.argsort(who, kind="stable")
            self.number.update(zip(part, range(len(self.size), len(self.size) + len(part))))
            self.size.extend(map(len, part))
            self.start.frombytes((self.start[-1] + np.cumsum(np.bincount(who, minlength=len(part)))).tobytes())
            self.place.frombytes((place[order].astype(np.uint64) * K1).tobytes())
            self.piece.frombytes((piece[order].astype(np.uint64) * K2).tobytes())


def _runs(sizes: list[int]) -> Iterator[tuple[int, int]]:
    """Bounds of parts of sorted sizes that differ by 2 at most."""
    at = 0
    while at < len(sizes):
        stop = at
        while stop < len(sizes) and stop - at < 8192 and sizes[stop] <= sizes[at] + 2:
            stop += 1
        yield at, stop
        at = stop


@kept("pieces")
@lru_cache(maxsize=2)
def encoder(model_file: str, seed: int, rate: float) -> Encoder:
    return Encoder(model_file, seed, rate)


def _lists(ids: list[bytes]) -> pa.Array:
    ends = np.cumsum([0, *(len(x) // 4 for x in ids)], dtype=np.int32)
    flat = pa.array(np.frombuffer(b"".join(ids), "<i4"))
    return pa.ListArray.from_arrays(pa.array(ends), flat, type=pa.list_(pa.field("element", pa.int32(), False)))


def encode_column(
    documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", out: str = "pieces", seed: int = SEED, rate: float = RATE, model_file: str | None = None
) -> DataFrame:
    """``documents`` with its texts' piece ids (array of int), replacing a
    column of that name. Every row is decoded again and compared; a text that
    did not come back would raise."""
    passed = documents.select([f"`{c}`" for c in documents.columns if c != out])
    schema = T.StructType([*passed.schema.fields, T.StructField(out, T.ArrayType(T.IntegerType(), False))])
    at, key_at, place = passed.columns.index(text_col), passed.columns.index(id_col), model_file or default_model()

    def run(batches):
        coder = encoder(place, seed, rate)
        for batch in batches:
            for part in parts(batch, at):
                keys, texts = part.column(key_at).to_pylist(), part.column(at).to_pylist()
                ids = coder.encode(texts, keys)
                for t, got in zip(texts, ids):
                    if coder.pieces.decode(got) != (t or ""):
                        raise ValueError("a segmentation lost its text")
                yield pa.RecordBatch.from_arrays([*part.columns, _lists(ids)], names=[*part.schema.names, out])

    return passed.mapInArrow(task("pieces", run), schema)


def op5(documents: DataFrame, seed: int = SEED, rate: float = RATE, model_file: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_pieces, ids_sha256 (of the ids as little-endian int32),
    round_trip (the ids decode to the text) of every row of ``documents``."""
    place = model_file or default_model()

    def run(batches):
        coder = encoder(place, seed, rate)
        for batch in batches:
            for part in parts(batch, 1):
                keys, texts = (c.to_pylist() for c in part.columns)
                rows = []
                for key, text, ids in zip(keys, texts, coder.encode(texts, keys)):
                    rows.append((key, len((text or "").encode()), len(ids) // 4, hashlib.sha256(ids).hexdigest(), coder.pieces.decode(ids) == (text or "")))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (batch.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.bool_()))], names=["doc_id", "n_bytes", "n_pieces", "ids_sha256", "round_trip"])

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(task("pieces", run), f"doc_id {kind}, n_bytes long, n_pieces long, ids_sha256 string, round_trip boolean")
