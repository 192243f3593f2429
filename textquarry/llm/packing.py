"""Order-preserving packing by dynamic programming.

The documents' tokens, in input order, form one stream that is cut into windows of at most `window`
tokens. Cuts may lie at document ends (free), sentence ends (a truncation penalty) or, only inside a
stretch without either of more than HARD_STEP tokens, at that step (a higher penalty). The best
cuts minimise padding plus penalties: cost(j) = penalty(j) + window - p(j) + min over i of cost(i) + p(i),
i within a window of j, and the minimum comes from a monotone queue, so the work is linear.

Each task packs the documents of its own partition, in order and without a shuffle. It solves blocks
of tokens; a block's last window is not closed but opens the next block, so that only the last window
of a partition can be short. sequence_id holds the partition and the window's number there.

Words are tokenised once and remembered: white space always ends a token, so a text's ids are its
words' ids one after another. Once the memory holds more than WORDS_KEPT words, those that were met in only
one stretch of text are forgotten. It ends with its task: kept in the worker, it would add to what a later
stage's executors hold.

Defined results: a null or empty text is only the end token; a null doc_id stays null and every other one
is kept to the last digit; a text longer than a window is cut like any other; repeated rows are packed
each; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections import deque
from collections.abc import Sequence
from itertools import chain, compress, repeat
from operator import not_

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table

WINDOW, END_ID, BLOCK, WORDS_KEPT, TEXT_AT_ONCE = 4096, 2, 1 << 20, 800_000, 1 << 21
SENTENCE_PENALTY, HARD_PENALTY, HARD_STEP = 4, 48, 96
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
_CLOSING = "\"')]}»”’"
_STOPS = frozenset(".!?…。！？")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[]^_`{|}~"
_TOGETHER = 100
_BEYOND = re.compile("[^\x00-\u02ff]")
_SPECIAL = "<|"  # begins the tokenizer's special tokens, which it looks for before it lowers case


class WordTokenizer:
    """Ids of whole texts through a memory of words."""

    def __init__(self, path: str, kept: int = WORDS_KEPT):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.encode_batch, self.kept = getattr(tokenizer, "encode_batch_fast", tokenizer.encode_batch), kept
        vocabulary = tokenizer.get_vocab()
        self.closes = np.zeros(1 + max(vocabulary.values()), bool)
        self.closes[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self._clear()

    def _clear(self):
        self.number: dict[str, int] = {}
        self.ids, self.used = np.zeros(1 << 16, np.uint32), 0
        self.at, self.size, self.met, self.ends = (np.zeros(1 << 14, kind) for kind in (np.int32, np.int32, np.int32, bool))

    def _grow(self):
        while len(self.number) > len(self.at):
            self.at, self.size, self.met, self.ends = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.size, self.met, self.ends))

    def _forget(self):
        """Keeps the words met twice or more since it was last called, or none if those are more than half."""
        kept = self.met[: len(self.number)] > 1
        k = np.flatnonzero(kept if 2 * kept.sum() <= len(kept) else np.zeros_like(kept))
        ids, after = self._gathered(k)
        ends, words = self.ends[k], list(self.number)
        self._clear()
        self.number = {words[i]: n for n, i in enumerate(k.tolist())}
        self._grow()
        self._store(np.arange(len(k)), ids, np.diff(after, prepend=0))
        self.ends[: len(k)] = ends

    def _store(self, numbers: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
        used = self.used
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.at[numbers], self.size[numbers] = used + np.cumsum(sizes) - sizes, sizes
        self.used = used + len(ids)

    def _gathered(self, k: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of stored words one after another, and the places where they end."""
        sizes = self.size[k]
        after = np.cumsum(sizes)
        shift = np.repeat(self.at[k] - (after - sizes).astype(np.int32), sizes)
        shift += np.arange(len(shift), dtype=np.int32)
        return self.ids[shift], after

    def _learn(self, fresh: list[str]):
        """Numbers new words in their order and stores their ids.

        Words of letters go to the tokenizer many at a time: each ends with an id that closes a word.

        Letters with ASCII marks behind them are their letters' ids and then the marks' ids, unless lower case
        adds a mark of its own to a letter.
        """
        number = self.number
        plain = list(map(str.isalpha, fresh))
        letters, others = list(compress(fresh, plain)), list(compress(fresh, map(not_, plain)))
        alone, joined, pieces = [], [], []
        for word in others:
            core = word.rstrip(_MARKS)
            if core != word and core.isalpha() and (core.isascii() or len(core.lower()) == len(core)):
                joined.append(word)
                pieces += core, word[len(core) :]
            else:
                alone.append(word)
        known = len(number)
        number.update(zip(fresh, range(known, known + len(fresh))))
        for piece in pieces:
            if piece not in number:
                number[piece] = len(number)
                (letters if piece.isalpha() else alone).append(piece)
        self._grow()
        self.ends[[number[w] for w in chain(others, alone) if w and w.rstrip(_CLOSING)[-1:] in _STOPS]] = True
        groups = [letters[i : i + _TOGETHER] for i in range(0, len(letters), _TOGETHER)]
        for group, got in zip(groups, self.encode_batch([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(got.ids, np.uint32)
            sizes = np.diff(np.flatnonzero(self.closes[ids]), prepend=-1)
            if len(sizes) == len(group):
                self._store(self._numbered(group), ids, sizes)
            else:  # some letters are composed of several
                alone += group
        apart = [got.ids for got in self.encode_batch(alone, add_special_tokens=False)]
        self._store(self._numbered(alone), np.fromiter(chain.from_iterable(apart), np.uint32), np.fromiter(map(len, apart), np.int64, len(apart)))
        ids, after = self._gathered(self._numbered(pieces))
        self._store(self._numbered(joined), ids, np.diff(after[1::2], prepend=0))

    def _numbered(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def encode_all(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
        """Each text's ids and the places after which a sentence ends; Arrow finds the different words of all texts."""
        if len(self.number) > self.kept:
            self._forget()
        # below U+0300 nothing combines, so lower case can come before composition
        plain = [(t.lower() if _SPECIAL not in t and (t.isascii() or not _BEYOND.search(t)) else t).replace("\n", " ") for t in texts]
        lists = pc.split_pattern(pa.array(plain, pa.large_string()), " ")
        coded = lists.values.dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        numbers = np.fromiter(map(self.number.get, words, repeat(-1)), np.int64, len(words))
        new = numbers < 0
        if new.any():
            numbers[new] = len(self.number) + np.arange(new.sum())
            self._learn(list(compress(words, new.tolist())))
        self.met[numbers] += 1
        k = numbers[coded.indices.to_numpy()]
        ids, after = self._gathered(k)
        stops = self.ends[k]
        # word, id and sentence end at which each text begins
        word = lists.offsets.to_numpy()
        place, stop = np.append(0, after)[word].tolist(), np.append(0, np.cumsum(stops))[word].tolist()
        ends = after[stops]
        return [(ids[i:j], ends[a:b] - i) for i, j, a, b in zip(place, place[1:], stop, stop[1:])]

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_all([text])[0]


def _encoded(tokenizer: WordTokenizer, batch: pa.RecordBatch):
    """(doc_id, ids, sentence ends) of a batch's rows, in order, learning TEXT_AT_ONCE characters at a time."""
    some, chars = [], 0

    def done():
        coded = iter(tokenizer.encode_all([t for _, t in some if t]))
        return [(i, *(next(coded) if t else (np.zeros(0, np.uint32), np.zeros(0, np.int64)))) for i, t in some]

    for doc_id, text in zip(batch.column("doc_id").to_pylist(), (text.as_py() for text in batch.column("text"))):
        some.append((doc_id, text))
        chars += len(text or "")
        if chars >= TEXT_AT_ONCE:
            yield from done()
            some, chars = [], 0
    yield from done()


def _queued_cuts(places: list[int], penalties: list[float], window: int) -> list[int]:
    """The cut before each place, by a monotone queue: of equally good ones the last."""
    back = [0] * len(places)
    queue: deque[tuple[float, int]] = deque([(0.0, 0)])
    for j in range(1, len(places)):
        while places[j] - places[queue[0][1]] > window:
            queue.popleft()
        least, back[j] = queue[0]
        key = penalties[j] + window + least
        while queue and queue[-1][0] >= key:
            queue.pop()
        queue.append((key, j))
    return back


def _cuts_by_runs(places: np.ndarray, penalties: np.ndarray, window: int) -> list[int] | None:
    """The same, found for a run of places at a time, or None where penalties outweigh a window.

    A run is all places that reach back to the run before. Their windows begin there: a cut inside their own
    run already costs a window more.
    """
    first = np.searchsorted(places, places - window)
    key, back = np.zeros(len(places)), np.zeros(len(places), np.int64)
    a, b = 0, 1
    while b < len(places):
        c = int(np.searchsorted(first, b))  # places b to c reach back to the run from a to b
        run, reach = key[a:b], first[b:c] - a
        least = np.minimum.accumulate(run[::-1])[::-1]
        last = np.flatnonzero(np.append(run[:-1] < least[1:], True))  # where the least key from there on is last met
        back[b:c] = a + last[np.searchsorted(last, reach)]
        key[b:c] = penalties[b:c] + window + least[reach]
        if b == c or key[b:c].min() <= least[reach[-1]]:
            return None
        a, b = b, c
    return back.tolist()


def best_cuts(places: Sequence[int], penalties: Sequence[float], window: int) -> list[int]:
    """Indices of the best cuts; places ascend from 0, no two neighbours more than a window apart."""
    places, penalties = np.asarray(places), np.asarray(penalties)
    back = _cuts_by_runs(places, penalties, window) or _queued_cuts(places.tolist(), penalties.tolist(), window)
    cuts, j = [], len(places) - 1
    while j:
        cuts.append(j)
        j = back[j]
    return cuts[::-1]


def _places(docs: list[tuple]) -> tuple[np.ndarray, np.ndarray]:
    """Where the docs' tokens may be cut, from 0, and the penalties: (id, ids, first, sentence ends); first: tokens packed before."""
    left = np.array([len(ids) - first for _, ids, first, _ in docs], np.int64)
    end = np.cumsum(left)
    base = end - left
    inner = np.concatenate([ends + at for (_, _, first, ends), at in zip(docs, (base - [d[2] for d in docs]).tolist())])
    of = np.repeat(np.arange(len(docs)), [len(d[3]) for d in docs])
    inner = inner[(inner > base[of]) & (inner < end[of])]
    soft, which = np.unique(np.concatenate([end, inner]), return_index=True)
    gap = np.diff(soft, prepend=0)
    steps = (gap - 1) // HARD_STEP + 1  # the last one reaches the soft place
    after = np.cumsum(steps)
    places = np.repeat(soft - gap - (after - steps) * HARD_STEP, steps) + np.arange(1, after[-1] + 1) * HARD_STEP
    penalties = np.full(len(places), HARD_PENALTY)
    places[after - 1], penalties[after - 1] = soft, np.where(which < len(docs), 0, SENTENCE_PENALTY)
    return np.append(0, places), np.append(0, penalties)


def _solve(docs: list[tuple], window: int) -> list[int]:
    """Window ends (token places) of the docs."""
    places, penalties = _places(docs)
    return places[best_cuts(places, penalties, window)].tolist()


def _emit(docs: list[tuple], ends: list[int], first_window: int, out: list) -> tuple[list[tuple], int]:
    """Pieces of the windows that end at `ends`; returns the docs left and the next window's number."""
    at, k, base = 0, 0, 0  # place in the stream, doc, the doc's place
    number = first_window
    for end in ends:
        offset = 0
        while at < end:
            doc_id, ids, first, cuts = docs[k]
            start = first + at - base
            take = min(len(ids) - start, end - at)
            out.append((doc_id, start, take, zlib.crc32(ids[start : start + take].tobytes()), len(ids), number, offset))
            at, offset = at + take, offset + take
            if start + take == len(ids):
                k, base = k + 1, at
        number += 1
    rest = docs[k:]
    if rest and at > base:
        doc_id, ids, first, cuts = rest[0]
        rest[0] = (doc_id, ids, first + at - base, cuts)
    return rest, number


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Pieces of all documents: which ids of which document lie where in which sequence."""

    def run(batches):
        tokenizer, number = WordTokenizer(tokenizer_path), TaskContext.get().partitionId() << 40
        held, tokens = [], 0

        def frame(out):
            cols = list(zip(*out)) or [()] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=[c.split()[0] for c in _PIECES.split(", ")])

        for batch in batches:
            out: list = []
            for doc_id, ids, ends in _encoded(tokenizer, batch):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4", copy=False)
                held.append((doc_id, ids, 0, ends))
                tokens += len(ids)
                if tokens >= block:
                    held, number = _emit(held, _solve(held, window)[:-1], number, out)
                    tokens = sum(len(ids) - first for _, ids, first, _ in held)
            yield frame(out)
        out = []
        if held:
            _emit(held, _solve(held, window), number, out)
        yield frame(out)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, _PIECES)


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op3_packing(spark, sf_dir) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), tokenizer_path())
