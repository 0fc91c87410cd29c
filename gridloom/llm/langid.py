"""Language identification by cross-parsing entropy.

A suffix automaton of labelled text is built for each language. A text is
parsed against each automaton into greedy longest matches; the number of
phrases times log2 of the automaton's text length, per letter, is the
cross-parsing estimate of the relative entropy, and the language that needs the
fewest normalised phrases wins.

Texts are lower-cased; everything but letters becomes one space. Text is parsed
in blocks of ``BLOCK`` letters, and a phrase ends with its block, so that the
blocks of many texts advance in lock-step through one transition table.

Defined results: a null text, or one without letters, is ``und`` with score 0;
so is every text if nothing can be learned from. Equal phrase counts go to the
language first in code-point order. A row with a null id is scored like any
other. Repeated rows are scored each. Columns other than the id, the text and
(while learning) the label are ignored or, with ``identify``, passed through.
"""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .sampling import draw, held_out, learnable
from .workers import kept, parts, task

#: The documented bounds of the sample that is learned from: languages (those of
#: most labelled rows), letters in a language's automaton and in all, rows drawn
#: for a language and letters read of a row.
TRAIN_LANGS = 64
TRAIN_CHARS, TRAIN_TOTAL = 24_000, 160_000
TRAIN_ROWS, ROW_CHARS = 128, 6_000
#: Letters with a column of the dense table; the transitions of others are hashed.
DENSE = 192
#: Letters in a block, and letters of a text normalised at once.
BLOCK = 256
PIECE = 1_000_000
#: With ``reject``, a text of at least this many letters and spaces whose phrases in the best
#: language are shorter than this on average is in none of the languages.
REJECT_CHARS, REJECT_PHRASE = 40, 1.7


def learn(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> dict[str, str]:
    """Normalised training text of each language, from a bounded sample of the
    rows that are not held out."""
    rows = documents.select(F.col(id_col).alias("k"), F.col(lang_col).alias("l")).where(learnable(F.col("k")))
    most = rows.where("l is not null").groupBy("l").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "l").limit(TRAIN_LANGS).collect()
    drawn = draw(rows.where(F.col("l").isin([r["l"] for r in most])), "k", "l", TRAIN_ROWS) if most else []
    if not drawn:
        return {}
    found = (
        documents.where(F.col(id_col).isin([k for k, _ in drawn]) & F.col(lang_col).isin([r["l"] for r in most]) & F.col(text_col).isNotNull())
        .select(F.col(id_col).alias("k"), F.col(lang_col).alias("l"), F.substring(F.col(text_col), 1, ROW_CHARS).alias("t"))
        .groupBy("k", "l")
        .agg(F.min("t").alias("t"))  # an id's rows beyond one are left out
        .collect()
    )
    texts: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (str(r["l"]), r["k"])):
        plain = " ".join("".join(c if c.isalpha() else " " for c in r["t"].lower()).split())
        if plain:
            texts.setdefault(str(r["l"]), []).append(plain)
    room = min(TRAIN_CHARS, TRAIN_TOTAL // max(len(texts), 1))
    return {lang: _even(rows, room) for lang, rows in sorted(texts.items())}


def _even(texts: list[str], room: int) -> str:
    """As many letters of each text; what short ones leave goes to the others."""
    out = []
    for i, text in enumerate(sorted(texts, key=lambda t: (len(t), t))):
        share = room // (len(texts) - i)
        out.append(text[:share])
        room -= len(out[-1])
    return " ".join(t for t in out if t)


def _automaton(codes: list[int]) -> list[dict[int, int]]:
    """Transitions of the suffix automaton of a code sequence; state 0 is the root."""
    to, link, length, last = [{}], [-1], [0], 0
    for c in codes:
        new = len(to)
        to.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in to[p]:
            to[p][c] = new
            p = link[p]
        if p >= 0:
            q = to[p][c]
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                twin = len(to)
                to.append(dict(to[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and to[p].get(c) == q:
                    to[p][c] = twin
                    p = link[p]
        last = new
    return to


class Parser:
    """The automata of all languages in one table.

    An entry holds twice the next state, plus 1 if a phrase starts with this
    letter; so a step is one gather. Only the most frequent letters have a column;
    of the others, what the automata have is in a hash table, and what they
    haven't starts a phrase at the language's root."""

    def __init__(self, trained: dict[str, str]):
        self.langs = sorted(trained)
        often = Counter(c for t in trained.values() for c in t if c != " ")
        letters = [c for c, _ in sorted(often.items(), key=lambda x: (-x[1], x[0]))]
        # 0 is a space, 1 a letter of no language, 2 fills a block
        code = {c: i + 3 for i, c in enumerate(letters)}
        self.unknown, self.pad = 1, 2
        self.width = min(len(letters), DENSE) + 3
        self.lut = self._lookup(code)
        tables, self.roots, self.bits, base, rare = [], [], [], 0, {}
        fallback = np.zeros((len(self.langs), len(letters) + 3), np.int64)
        for k, lang in enumerate(self.langs):
            text = trained[lang]
            to = _automaton([code.get(c, 0) for c in text])
            fallback[k] = base * 2 + 1
            for c, s in to[0].items():
                fallback[k, c] = (base + s) * 2 + 1
            table = np.broadcast_to(fallback[k, : self.width], (len(to), self.width)).copy()
            for s, nexts in enumerate(to[1:], 1):
                for c, t in nexts.items():
                    if c < self.width:
                        table[s, c] = (base + t) * 2
                    else:
                        rare[(base + s) << 21 | c] = (base + t) * 2
            table[:, self.pad] = (np.arange(len(to)) + base) * 2
            tables.append(table.astype(np.int32))
            self.roots.append(base)
            self.bits.append(np.log2(max(len(text), 2)))
            base += len(to)
        self.table = np.concatenate(tables) if tables else np.zeros((0, self.width), np.int32)
        self.fallback = fallback
        self.keys = np.array(sorted(rare), np.int64)
        self.values = np.array([rare[k] for k in self.keys.tolist()], np.int32)

    def _lookup(self, code: dict[str, int]) -> np.ndarray:
        lut = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                lut[i] = code.get(c.lower()[0], self.unknown)
        return lut

    def normalised(self, text: str) -> np.ndarray:
        codes = self.lut[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)]
        keep = codes > 0
        keep[1:] |= codes[:-1] > 0  # one space after a word
        return codes[keep]

    def blocks(self, text: str | None) -> tuple[np.ndarray, int, int]:
        """Padded blocks, letters and spaces, letters of a whole text."""
        parts, n, letters = [], 0, 0
        for i in range(0, len(text or ""), PIECE):
            codes = self.normalised(text[i : i + PIECE])
            if len(codes):
                n += len(codes)
                letters += int(np.count_nonzero(codes))
                rows = -(-len(codes) // BLOCK)
                padded = np.full(rows * BLOCK, self.pad, np.uint32)
                padded[: len(codes)] = codes
                parts.append(padded.reshape(rows, BLOCK))
        return (np.concatenate(parts) if parts else np.zeros((0, BLOCK), np.uint32)), n, letters

    def phrases(self, blocks: np.ndarray) -> np.ndarray:
        """Phrases of each block (columns) in each language (rows)."""
        steps = np.ascontiguousarray(blocks.T).astype(np.int32)
        at = np.repeat(np.array(self.roots, np.int32)[:, None], blocks.shape[0], axis=1)
        count = np.zeros_like(at)
        for step in steps:
            rare = np.flatnonzero(step >= self.width)
            got = self.table[at, np.where(step < self.width, step, 0) if len(rare) else step]
            if len(rare):
                keys = at[:, rare].astype(np.int64) << 21 | step[rare]
                slot = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
                got[:, rare] = np.where(self.keys[slot] == keys, self.values[slot], self.fallback[:, step[rare]])
            count += got & 1
            at = got >> 1
        return count

    def predict(self, texts: list[str | None], reject: bool = False) -> list[tuple[str, float]]:
        out, waiting, size = [], [], 0
        for text in texts:
            blocks = self.blocks(text)
            waiting.append(blocks)
            size += len(blocks[0])
            if size >= 4096:
                out += self._decide(waiting, reject)
                waiting, size = [], 0
        return out + self._decide(waiting, reject)

    def _decide(self, waiting: list, reject: bool) -> list[tuple[str, float]]:
        if not self.langs:
            return [("und", 0.0)] * len(waiting)
        blocks = np.concatenate([w[0] for w in waiting]) if waiting else np.zeros((0, BLOCK), np.uint32)
        total = np.zeros((len(self.langs), len(blocks) + 1), np.int64)
        for i in range(0, len(blocks), 8192):
            total[:, i + 1 : i + 8193] = self.phrases(blocks[i : i + 8192])[:, : len(blocks) - i]
        total = total.cumsum(axis=1)
        out, at = [], 0
        for rows, n, letters in waiting:
            phrases = total[:, at + len(rows)] - total[:, at]
            at += len(rows)
            if not letters:
                out.append(("und", 0.0))
                continue
            rate = phrases * self.bits / n
            best = int(np.argmin(rate))
            if reject and n >= REJECT_CHARS and n / phrases[best] < REJECT_PHRASE:
                out.append(("und", 0.0))
                continue
            # posterior of the codes' lengths
            out.append((self.langs[best], float(1 / np.exp2(-(rate - rate[best]) * n).sum())))
        return out


@kept("langid")
@lru_cache(maxsize=2)
def _parser(trained: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(dict(trained))


def identify(documents: DataFrame, trained: dict[str, str], text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score", reject: bool = False) -> DataFrame:
    """``documents`` with the predicted language and its score. A column of
    ``documents`` that has one of these two names is replaced. With ``reject``,
    long texts in none of the languages are ``und`` with score 0, too."""
    passed = documents.select([F.col(f"`{c}`") for c in documents.columns if c not in (lang_out, score_out)])
    schema = T.StructType([*passed.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())])
    model = passed.sparkSession.sparkContext.broadcast(tuple(trained.items()))
    index = passed.columns.index(text_col)

    def run(batches):
        parser = _parser(model.value)
        for batch in batches:
            for part in parts(batch, index):
                got = parser.predict(part.column(index).to_pylist(), reject)
                yield pa.RecordBatch.from_arrays(
                    [*part.columns, pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())],
                    names=[*part.schema.names, lang_out, score_out],
                )

    return passed.mapInArrow(task("langid", run), schema)


def op1(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of ``documents``."""
    trained = learn(documents)
    out = identify(documents.select("doc_id", "text"), trained)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
