"""Token counts by a finite-state transducer compiled from the vocabulary.

The transducer reads characters. Its state is what the future of a byte-pair
segmentation can depend on: for every start position whose text so far is a
proper prefix of some piece, the place in the pieces' trie, the token that ends
before it, and the number of tokens there relative to now. A transition emits
the change of the token count, which may be negative. States are deterministic:
of the tokens that could end at a position exactly one fits its left neighbour
(two tokens fit if the merges split their joined text into just these two), so
the segmentation of every prefix is unique.

States and transitions are compiled when first met, into a table of bounded
size that starts afresh when it is full; so is every worker's memory bounded.
Frequent letters have a column of a dense table, the others' transitions are in
a hash table; characters that no piece holds behave alike by their bytes.

Texts are cut into chunks of ``CHUNK`` characters that run in lock-step, and
the chunks' state maps compose. A space after a letter resets the transducer:
from its first reset on, a chunk's end doesn't depend on its begin, and its map
there is constant. A chunk without such a space is run from the initial state
first, with its path kept; a run from another begin state soon meets that path
and then shares its end, so nearly all of its map is constant too. So all
chunks' ends are known at once; a scan runs what comes before a reset, or before
the paths meet, from the end of the chunk before, for all chunks together, and
again only for successors of chunks whose end turned out to be another.

Defined results: a null text counts as empty, 0 tokens. Rows with null ids and
repeated rows are counted like others; further columns are ignored.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .pieces import default_model, pieces
from .workers import kept, task

CHUNK = 256
#: Letters that have a column of the dense table; others' transitions are hashed.
WIDTH = 128
#: Bits of a table entry that hold the change of the count.
BITS = 8
STATES = 120_000
#: Up to so many tokens below a place in the trie, left neighbours are told apart
#: by which of these fit them only.
MANY = 64
LIMIT = 4096
PAD, SPACE = 0, 1


class Counter:
    def __init__(self, model_file: str):
        self.p = pieces(model_file)
        self.child: list[dict[str, int]] = [{}]
        self.token: list[int] = [-1]
        for text, i in self.p.ids.items():
            node = 0
            for c in text:
                nxt = self.child[node].get(c)
                if nxt is None:
                    nxt = self.child[node][c] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = nxt
            self.token[node] = i
        self.texts = self.p.texts
        self.below: dict[int, tuple[int, ...] | None] = {}
        self.codes = {" ": SPACE}
        self.lut = np.zeros(0x110000, np.uint16)
        self.unknown: dict[int, int] = {}
        self.lut[ord(" ")] = SPACE
        self.letters = [None, " "]
        self._fresh()

    def _fresh(self):
        self.configs: list[tuple] = []
        self.index: dict[tuple, int] = {}
        self.table = np.full((1024, WIDTH), -1, np.int32)
        self.keys, self.values, self.held = np.full(1 << 14, -1, np.int64), np.zeros(1 << 14, np.int32), 0
        self.same: dict[tuple[int, int], int | None] = {}
        self.likes: dict[tuple, int] = {}
        self.state(((0, -1, 0),))

    def state(self, config: tuple) -> int:
        got = self.index.get(config)
        if got is None:
            got = self.index[config] = len(self.configs)
            self.configs.append(config)
            if got >= len(self.table):
                self.table = np.concatenate([self.table, np.full((len(self.table), WIDTH), -1, np.int32)])
            self.table[got, PAD] = got << BITS | 1 << BITS - 1
        return got

    def _fit(self, last: int, token: int) -> bool:
        return self.p.made(token) and (last < 0 or self.p.fit(last, token))

    def _below(self, node: int) -> tuple[int, ...] | None:
        """Tokens that longer texts from this node can be; None if there are many."""
        if node not in self.below:
            out, stack = [], [node]
            while stack and len(out) <= MANY:
                for nxt in self.child[stack.pop()].values():
                    if self.token[nxt] >= 0:
                        out.append(self.token[nxt])
                    stack.append(nxt)
            self.below[node] = tuple(out) if len(out) <= MANY else None
        return self.below[node]

    def _as(self, node: int, last: int) -> int | None:
        """A token to which the same tokens below ``node`` fit as to ``last``,
        one for all such; None if none fits."""
        key = node, last
        if key not in self.same:
            tokens = self._below(node)
            if tokens is None:
                self.same[key] = last
            else:
                fitting = tuple(t for t in tokens if self._fit(last, t))
                self.same[key] = self.likes.setdefault((node, fitting), last) if fitting else None
        return self.same[key]

    def step(self, state: int, c: str) -> tuple[tuple, int]:
        """The next state's configuration, and the change of the count."""
        if c not in self.p.chars:
            return ((0, -1, 0),), len(c.encode("utf-8", "surrogatepass"))
        live, now, last = [], None, -1
        for node, before, count in self.configs[state]:
            nxt = self.child[node].get(c)
            if nxt is None:
                continue
            live.append((nxt, before, count))
            token = self.token[nxt]
            if now is None and token >= 0 and self._fit(before, token):
                now, last = count + 1, token
        fresh = []
        for node, before, count in live:
            like = self._as(node, before) if self.child[node] else None
            if like is not None:
                fresh.append((node, like, count - now))
        return (*fresh, (0, last, 0)), now

    def compiled(self, state: int, c: str) -> int:
        """next state << BITS | count's change + 2^(BITS - 1)"""
        config = self.configs[state]
        if c == " " and config[-1][0] == 0 and config[-1][1] >= 0 and self.texts[config[-1][1]][-1] != " ":
            nxt, change = self.step(0, c)  # a reset
        else:
            nxt, change = self.step(state, c)
        half = 1 << BITS - 1
        if not -half <= change < half:
            raise ValueError("a vocabulary whose pieces are too long for the table")
        return self.state(nxt) << BITS | change + half

    def encode(self, text: str) -> np.ndarray:
        """Codes of a text."""
        points = np.frombuffer((" " + text).encode("utf-32-le", "surrogatepass"), np.uint32)
        codes = self.lut[points]
        if (codes == 0).any():
            for p in np.unique(points[codes == 0]).tolist():
                c = chr(p)
                size = 0 if c in self.p.chars else len(c.encode("utf-8", "surrogatepass"))
                code = self.unknown.get(size) if size else None
                if code is None:
                    code = len(self.letters)
                    self.letters.append(c)
                    if size:
                        self.unknown[size] = code
                self.lut[p] = code
            codes = self.lut[points]
        return codes

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        """Where each key is in the hash table, or the free place for it."""
        mask = len(self.keys) - 1
        at = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask
        left = np.flatnonzero((self.keys[at] != keys) & (self.keys[at] >= 0))
        while len(left):
            at[left] = (at[left] + 1) & mask
            left = left[(self.keys[at[left]] != keys[left]) & (self.keys[at[left]] >= 0)]
        return at

    def _rare(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """Entries of letters beyond the dense table."""
        keys = at.astype(np.int64) << 16 | codes
        slots = self._slots(keys)
        missing = np.unique(keys[self.keys[slots] < 0])
        for key in missing.tolist():
            made = self.compiled(key >> 16, self.letters[key & 0xFFFF])
            if 2 * self.held >= len(self.keys):
                old, values = self.keys, self.values
                self.keys, self.values = np.full(2 * len(old), -1, np.int64), np.zeros(2 * len(old), np.int32)
                for k, v in zip(old[old >= 0].tolist(), values[old >= 0].tolist()):
                    self._put(k, v)
            self._put(key, made)
            self.held += 1
        return self.values[self._slots(keys) if len(missing) else slots]

    def _put(self, key: int, value: int) -> None:
        slot = self._slots(np.array([key], np.int64))[0]
        self.keys[slot], self.values[slot] = key, value

    def entries(self, at: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """The table's entries for states and letters, compiled where new."""
        rare = codes >= WIDTH
        if rare.any():
            got = np.empty(len(at), np.int32)
            got[rare] = self._rare(at[rare], codes[rare])
            if not rare.all():
                got[~rare] = self.entries(at[~rare], codes[~rare])
            return got
        got = self.table[at, codes]
        if (got < 0).any():
            for x in np.unique(at[got < 0].astype(np.int64) * WIDTH + codes[got < 0]).tolist():
                s, c = divmod(x, WIDTH)
                made = self.compiled(s, self.letters[c])  # may move the table
                self.table[s, c] = made
            got = self.table[at, codes]
        return got

    def run(self, lanes: np.ndarray, begin: np.ndarray, lengths: np.ndarray | None = None, path: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """End states and counts of lanes (one a row) from their begin states.
        lengths: descending, where lanes end early; path: gets the states and
        counts after each step."""
        at, total = begin.astype(np.int32), np.zeros(len(begin), np.int64)
        for k, codes in enumerate(np.ascontiguousarray(lanes.T)):
            n = len(at) if lengths is None else int(np.searchsorted(-lengths, -k, side="left"))
            if not n:
                break
            got = self.entries(at[:n], codes[:n])
            total[:n] += (got & (1 << BITS) - 1) - (1 << BITS - 1)
            at[:n] = got >> BITS
            if path is not None:
                path.append((at.copy(), total.copy()))
        return at, total

    def rejoin(self, lanes: np.ndarray, begin: np.ndarray, path: list, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """As ``run``, but lanes stop where they meet the path of the run from the
        initial state (their place in it is given) and take over its end."""
        end, total = begin.astype(np.int32), np.zeros(len(begin), np.int64)
        left = np.arange(len(begin))
        for k in range(lanes.shape[1]):
            got = self.entries(end[left], lanes[left, k])
            total[left] += (got & (1 << BITS) - 1) - (1 << BITS - 1)
            end[left] = got >> BITS
            states, counts = path[k]
            met = end[left] == states[place[left]]
            done = left[met]
            total[done] += path[-1][1][place[done]] - counts[place[done]]
            end[done] = path[-1][0][place[done]]
            left = left[~met]
            if not len(left):
                break
        return end, total

    def counts(self, texts: list[str | None]) -> list[int]:
        out, coded, where = [0] * len(texts), [], []
        for i, text in enumerate(texts):
            if text:
                text = text.replace("\u2581", " ")  # the library's own mark of a space
                coded.append(self.encode(text))
                where.append(i)
        if coded:
            if len(self.configs) > STATES - STATES // 4 or self.held > 4 * STATES:
                self._fresh()
            for i, n in zip(where, self._scan(coded)):
                out[i] = n
        return out

    def _scan(self, coded: list[np.ndarray]) -> list[int]:
        rows = [-(-len(c) // CHUNK) for c in coded]
        lanes = np.zeros((sum(rows), CHUNK), np.uint16)
        first = np.zeros(len(lanes), bool)
        at = 0
        for c, n in zip(coded, rows):
            lanes[at : at + n].reshape(-1)[: len(c)] = c
            first[at] = True
            at += n
        # resets: a space after another character, and a text's begin
        before = np.empty_like(lanes)
        before[:, 1:] = lanes[:, :-1]
        before[0, 0], before[1:, 0] = 0, lanes[:-1, -1]
        reset = (lanes == SPACE) & (before != SPACE)
        reset[first, 0] = True
        has = reset.any(axis=1)
        head = np.where(has, reset.argmax(axis=1), (lanes != PAD).sum(axis=1))
        place = np.arange(CHUNK)
        end, total = self.run(np.where(place >= head[:, None], lanes, PAD), np.zeros(len(lanes), np.int32))
        alone = np.flatnonzero(~has)
        place, path = np.zeros(len(lanes), np.int64), []
        if len(alone):
            place[alone] = np.arange(len(alone))
            end[alone], total[alone] = self.run(lanes[alone], np.zeros(len(alone), np.int32), path=path)
        before_reset = np.zeros(len(lanes), np.int64)
        todo = np.flatnonzero(~first & (head > 0))
        while len(todo):
            some = todo[has[todo]]
            some = some[np.argsort(-head[some], kind="stable")]
            _, before_reset[some] = self.run(lanes[some], end[some - 1], head[some])
            rest = todo[~has[todo]]
            moved = rest[:0]
            if len(rest):
                old = end[rest]
                new, total[rest] = self.rejoin(lanes[rest], end[rest - 1], path, place[rest])
                end[rest] = new
                moved = rest[new != old]
            # chunks that were run from an end that has changed
            todo = moved[moved + 1 < len(lanes)] + 1
            todo = todo[~first[todo] & (head[todo] > 0)]
        return np.add.reduceat(total + before_reset, np.flatnonzero(first)).tolist()


@kept("tokencount")
@lru_cache(maxsize=2)
def counter(model_file: str) -> Counter:
    return Counter(model_file)


def op7(documents: DataFrame, model_file: str | None = None) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > LIMIT) of every row."""
    place = model_file or default_model()

    def run(batches):
        count = counter(place)
        for batch in batches:
            start = 0
            texts = batch.column(1).to_pylist()
            while start < len(texts):
                stop, size = start, 0
                while stop < len(texts) and (stop == start or size + len(texts[stop] or "") <= 1_000_000):
                    size += len(texts[stop] or "")
                    stop += 1
                n = count.counts(texts[start:stop])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(start, stop - start), pa.array([len((t or "").encode()) for t in texts[start:stop]], pa.int64()), pa.array(n, pa.int64()), pa.array([x > LIMIT for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )
                start = stop

    kind = documents.schema["doc_id"].dataType.simpleString()
    return documents.select("doc_id", "text").mapInArrow(task("tokencount", run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
