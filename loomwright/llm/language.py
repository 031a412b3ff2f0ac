"""Language identification by segmentation-marginalised unigrams.

Each language has probabilities of the pieces of one fixed public vocabulary. A word's probability is the sum over all its
segmentations into pieces (forward algorithm), so no single segmentation has to be right; a text's is the product over its
words. Piece probabilities are fitted by expected counts (forward-backward) on the word counts of a bounded sample of
training documents; scoring covers every word of every text, and a task computes each distinct word once.
"""

from __future__ import annotations

import os
from collections import Counter
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: File of the vocabulary (a sentencepiece model); never copied, never trained.
VOCABULARY = os.environ.get("LLM_PIECE_VOCABULARY", "/opt/tokenizers/piece_bpe_32k.model")
#: Training documents that the piece probabilities are fitted on, per language: the first by a hash of the id.
FIT_DOCS = 3000
ROUNDS = 2
LONGEST = 8
#: Words longer than this are cut into parts of this length.
WORD_LIMIT = 24
SMOOTH = 0.1
#: Distinct words whose log probabilities a Python worker keeps at a time.
CACHE = 400_000
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}+")


def words_of(text: str) -> list[str]:
    """Lower-cased runs of letters, long ones in parts."""
    out = []
    for w in _WORD.findall(text.lower()):
        if len(w) <= WORD_LIMIT:
            out.append(w)
        else:
            out += [w[i:i + WORD_LIMIT] for i in range(0, len(w), WORD_LIMIT)]
    return out


def vocabulary(path: str) -> list[str]:
    """Pieces of letters only, lower-cased, at most LONGEST letters; every Latin letter alone is a piece as well."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = {model.id_to_piece(i).replace("▁", "").lower() for i in range(model.get_piece_size())}
    return sorted(p for p in found if p and len(p) <= LONGEST and p.isalpha())


_K = np.uint64(0x9E3779B97F4A7C15)


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the words, one row each (0 beyond the end), and their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    width = int(lengths.max()) if len(words) else 0
    flat = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    table = np.zeros((len(words), width), np.uint64)
    table[np.arange(width)[None, :] < lengths[:, None]] = flat
    return table, lengths


class Pieces:
    """Piece numbers of substrings, by hash."""

    def __init__(self, pieces: list[str]):
        self.size = len(pieces)
        table, lengths = _codes(pieces)
        hashes = np.zeros(len(pieces), np.uint64)
        for c in range(table.shape[1]):
            hashes = np.where(c < lengths, self.step(hashes, table[:, c]), hashes)
        order = np.argsort(hashes)
        self.hashes, self.numbers = hashes[order], order
        bits = 20
        self.slot = np.full(1 << bits, -1, np.int64)
        self.shift = np.uint64(64 - bits)
        # open table of one probe: a piece that finds its slot taken is looked up by search
        where = (self.hashes >> self.shift).astype(np.int64)
        self.slot[where[::-1]] = np.arange(len(pieces))[::-1]
        self.crowded = np.zeros(1 << bits, bool)
        values, counts = np.unique(where, return_counts=True)
        self.crowded[values[counts > 1]] = True

    @staticmethod
    def step(h: np.ndarray, c: np.ndarray) -> np.ndarray:
        h = (h ^ (c + np.uint64(1))) * _K
        return h ^ (h >> np.uint64(29))

    def find(self, h: np.ndarray) -> np.ndarray:
        """Piece numbers, or ``size`` where the substring is no piece."""
        where = (h >> self.shift).astype(np.int64)
        at = self.slot[where]
        crowded = np.flatnonzero(self.crowded[where])
        at[crowded] = np.minimum(np.searchsorted(self.hashes, h[crowded]), len(self.hashes) - 1)
        hit = (at >= 0) & (self.hashes[at] == h)
        return np.where(hit, self.numbers[at], self.size)


def lattice(words: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """``grid[i, end, k]``: number of the piece of ``k + 1`` letters that ends at ``end`` in word ``i``; ``size`` if none.

    A single letter that is no piece gets the number ``size + 1``.
    """
    table, lengths = _codes(words)
    n, width = table.shape
    grid = np.full((n, width + 1, LONGEST), pieces.size, np.int32)
    for start in range(width):
        h = np.zeros(n, np.uint64)
        for k in range(min(LONGEST, width - start)):
            h = Pieces.step(h, table[:, start + k])
            live = np.flatnonzero(start + k < lengths)
            if not len(live):
                break
            found = pieces.find(h[live])
            if k == 0:
                found = np.where(found == pieces.size, pieces.size + 1, found)
            grid[live, start + k + 1, k] = found
    return grid, lengths


def forward(grid: np.ndarray, prob: np.ndarray) -> np.ndarray:
    """``alpha[i, end, language]``: summed probability of all segmentations of the first ``end`` letters.

    ``prob`` has a row of zeros at number ``size`` and the probability of an unknown letter after it.
    """
    n, width, _ = grid.shape
    alpha = np.zeros((n, width, prob.shape[1]))
    alpha[:, 0] = 1
    for end in range(1, width):
        for k in range(min(LONGEST, end)):
            number = grid[:, end, k]
            alpha[:, end] += alpha[:, end - k - 1] * prob[number]
    return alpha


class Model:
    """Languages, their priors, and piece probabilities (pieces by languages)."""

    def __init__(self, languages: list[str], prior: np.ndarray, names: list[str], prob: np.ndarray):
        self.languages, self.prior, self.names, self.prob = languages, prior, names, prob

    def word_scores(self, words: list[str], pieces: Pieces) -> np.ndarray:
        out = np.zeros((len(words), len(self.languages)))
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        for at in range(0, len(order), 4096):
            pick = order[at:at + 4096]
            grid, lengths = lattice([words[i] for i in pick], pieces)
            alpha = forward(grid, self.prob)
            out[pick] = np.log(np.maximum(alpha[np.arange(len(pick)), lengths], 1e-300))
        return out


def fit(counts: list[tuple[str, str, int]], priors: dict[str, int], path: str) -> Model:
    """Expected piece counts over all segmentations, ROUNDS times from uniform probabilities."""
    languages = sorted(priors)
    names = vocabulary(path)
    pieces = Pieces(names)
    size, n_lang = len(names), len(languages)
    prob = np.full((size + 2, n_lang), 1.0 / size)
    prob[size] = 0
    prob[size + 1] = 1e-7
    by_word: dict[str, np.ndarray] = {}
    for language, word, n in counts:
        by_word.setdefault(word, np.zeros(n_lang))[languages.index(language)] += n
    words = sorted(by_word, key=lambda w: (len(w), w))
    for _ in range(ROUNDS if words else 0):
        expected = np.zeros((size + 2, n_lang))
        for at in range(0, len(words), 4096):
            part = words[at:at + 4096]
            weight = np.stack([by_word[w] for w in part])
            grid, lengths = lattice(part, pieces)
            alpha = forward(grid, prob)
            beta = np.zeros_like(alpha)
            beta[np.arange(len(part)), lengths] = 1
            for end in range(grid.shape[1] - 1, 0, -1):
                for k in range(min(LONGEST, end)):
                    beta[:, end - k - 1] += beta[:, end] * prob[grid[:, end, k]]
            total = np.maximum(beta[:, 0], 1e-300)
            for end in range(1, grid.shape[1]):
                for k in range(min(LONGEST, end)):
                    number = grid[:, end, k]
                    live = np.flatnonzero(number != size)
                    share = weight[live] * alpha[live, end - k - 1] * prob[number[live]] * beta[live, end] / total[live]
                    for language in range(n_lang):
                        expected[:, language] += np.bincount(number[live], share[:, language], minlength=size + 2)
        expected[:size] += SMOOTH
        expected[size] = 0
        prob = expected / expected.sum(axis=0)
        prob[size + 1] = np.maximum(prob[size + 1], 1e-7)
    total = sum(priors.values())
    return Model(languages, np.array([np.log(priors[x] / total) for x in languages]), names, prob)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of (language, word) in the rows of a task; sent on whenever there are many."""
    counts: dict[str, Counter] = {}

    def out() -> pa.RecordBatch:
        rows = [(language, w, n) for language, c in counts.items() for w, n in c.items()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in ((0, pa.string()), (1, pa.string()), (2, pa.int64()))], names=["lang", "word", "n"])

    for batch in batches:
        for language, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts.setdefault(language, Counter()).update(words_of(text or ""))
            if sum(map(len, counts.values())) > CACHE:
                yield out()
                counts = {}
    yield out()


#: What a Python worker keeps between tasks: the vocabulary with its table, and scores of words under one model.
_WORKER: dict = {}


def _predict(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    mark = hash((tuple(model.languages), model.prob.tobytes()))
    if _WORKER.get("mark") != mark:
        _WORKER.update(mark=mark, pieces=Pieces(model.names), index={}, scores=np.zeros((0, len(model.languages)), np.float32))
    pieces = _WORKER["pieces"]
    for batch in batches:
        texts = batch.column("text")
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            found = [Counter(words_of(t)) if t else Counter() for t in texts.slice(at, 256).to_pylist()]
            index: dict[str, int] = _WORKER["index"]
            fresh = sorted(set().union(*found) - index.keys()) if found else []
            if len(index) + len(fresh) > CACHE:
                index.clear()
                _WORKER["scores"] = _WORKER["scores"][:0]
                fresh = sorted(set().union(*found))
            if fresh:
                for w in fresh:
                    index[w] = len(index)
                _WORKER["scores"] = np.concatenate([_WORKER["scores"], model.word_scores(fresh, pieces).astype(np.float32)])
            scores = _WORKER["scores"]
            best, sure = [], []
            for words in found:
                if not words or not model.languages:
                    best.append(UNKNOWN), sure.append(0.0)
                    continue
                rows = np.fromiter(map(index.__getitem__, words), np.int64, len(words))
                total = model.prior + np.fromiter(words.values(), np.float64, len(words)) @ scores[rows]
                top = int(np.argmax(total))
                best.append(model.languages[top]), sure.append(float(1 / np.exp(total - total[top]).sum()))
            kept = [part.column(i) for i in range(part.num_columns) if part.schema.names[i] != "text"]
            names = [x for x in part.schema.names if x != "text"]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(best, pa.string()), pa.array(sure)], names=[*names, "lang_pred", "score"])


def train(docs: DataFrame, path: str = VOCABULARY) -> Model:
    """Fit on ``docs`` (``doc_id, text, lang``; rows without ``lang`` teach nothing). Priors count all of them; piece
    probabilities use every word of the first FIT_DOCS documents of each language by a hash of the id."""
    known = docs.filter("lang is not null")
    priors = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    total = sum(priors.values())
    counts: list[tuple[str, str, int]] = []
    if total:
        share = F.create_map(*[x for lang, n in priors.items() for x in (F.lit(lang), F.lit(min(1.0, FIT_DOCS / n)))])
        place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)
        sample = known.filter(place < F.element_at(share, F.col("lang"))).select("lang", "text")
        table = sample.mapInArrow(_word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
        found = table.toArrow()
        counts = list(zip(*(found.column(x).to_pylist() for x in ("lang", "word", "n"))))
    return fit(counts, priors, path)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without ``text`` and with ``lang_pred`` and ``score`` (columns of these names are replaced).

    Null texts and texts without a letter are ``und`` with score 0, as is everything under a model without languages. Ties
    go to the language that is first by name; repeated rows get equal answers.
    """
    plain = docs.drop("lang_pred", "score")
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema if f.name != "text")
    return plain.mapInArrow(partial(_predict, model=model), f"{kinds}, lang_pred string, score double")


def languages(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """The columns of the op10 query: learned from two thirds of the documents, predicted for all."""
    from loomwright.llm.factorization import in_part

    held = in_part("doc_id", 3, 1)
    model = train(docs.filter(~held).select("doc_id", "text", "lang"), path)
    return identify(docs.select("doc_id", held.alias("held_out"), "text"), model)
