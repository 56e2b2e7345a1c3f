"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary.  A word's probability is the
sum over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words
(runs of letters, lower-cased, each after the vocabulary's word mark).  The piece probabilities are fitted by
expectation maximisation, whose expected counts also run over all segmentations.

Words are scored many at a time: all of them walk the vocabulary's trie together, and each word is scored
once per worker process while it stays in a bounded cache.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import mapped

PIECES = "piece_bpe_32k.model"
MARK = "▁"
#: What a character without a piece counts for.
UNKNOWN = 1e-7
#: A word's probability below this in some language is summed anew in logarithms: parts of it may lie below the least double.
FAINT = 1e-250
#: Letters of a word up to which that is tried first; longer ones are nearly always as faint.
SHORT = 40


@lru_cache
def letters() -> re.Pattern:
    """Runs of characters of the general category L, as in `\\p{L}+`."""
    is_letter = np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])
    edges = np.flatnonzero(np.diff(is_letter.astype(int), prepend=0, append=0))
    return re.compile("[" + "".join(f"{re.escape(chr(a))}-{re.escape(chr(b - 1))}" for a, b in edges.reshape(-1, 2)) + "]+")


def vocabulary(name: str = PIECES) -> list[str]:
    """The pieces of a public SentencePiece model, without control and byte pieces."""
    model = sentencepiece.SentencePieceProcessor(model_file=name if "/" in name else public_tokenizers.path(name))
    ids = (k for k in range(model.get_piece_size()) if not (model.is_control(k) or model.is_unknown(k) or model.is_byte(k)))
    return [p for p in map(model.id_to_piece, ids) if p == p.lower()]


class Trie:
    """A trie of pieces as sorted arrays: (node, character) to node by binary search."""

    def __init__(self, pieces: list[str]):
        nodes: dict[tuple[int, int], int] = {}
        ends = {}
        for k, piece in enumerate(pieces):
            node = 0
            for c in piece:
                node = nodes.setdefault((node, ord(c)), len(nodes) + 1)
            ends[node] = k
        keys = np.array([a << 21 | b for a, b in nodes], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.fromiter(nodes.values(), dtype=np.int64)[order]
        self.piece = np.full(len(nodes) + 1, -1, dtype=np.int64)
        self.piece[list(ends)] = list(ends.values())
        self.longest = max(map(len, pieces), default=0)

    def step(self, nodes: np.ndarray, chars: np.ndarray) -> np.ndarray:
        """The nodes after a character; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(nodes), -1)
        want = nodes << 21 | chars
        at = np.minimum(np.searchsorted(self.keys, want), len(self.keys) - 1)
        return np.where(self.keys[at] == want, self.targets[at], -1)

    def segments(self, words: list[str]) -> tuple[np.ndarray, list[tuple[int, int, np.ndarray, np.ndarray]]]:
        """The words' lengths, and for each start and end, in order, the words (rows) with a piece there, and the piece.

        A character that starts no piece of its own is a piece -1, so every word has a segmentation.
        """
        lengths = np.array([len(w) for w in words])
        n = int(lengths.max(initial=0))
        chars = np.zeros((len(words), n), dtype=np.int64)
        for k, w in enumerate(words):
            chars[k, : len(w)] = np.frombuffer(w.encode("utf-32-le"), dtype="<u4")
        out = []
        for s in range(n):
            rows = np.flatnonzero(lengths > s)
            nodes = np.zeros(len(rows), dtype=np.int64)
            for e in range(s + 1, min(n, s + self.longest) + 1):
                inside = lengths[rows] >= e
                rows, nodes = rows[inside], nodes[inside]
                nodes = self.step(nodes, chars[rows, e - 1])
                if e == s + 1:
                    lone = (nodes < 0) | (self.piece[nodes] < 0)
                    if lone.any():
                        out.append((s, e, rows[lone], np.full(int(lone.sum()), -1)))
                live = nodes >= 0
                rows, nodes = rows[live], nodes[live]
                if not len(rows):
                    break
                piece = self.piece[nodes]
                ends = piece >= 0
                if ends.any():
                    out.append((s, e, rows[ends], piece[ends]))
        return lengths, out


def forward(lengths: np.ndarray, segments: list, p: np.ndarray) -> np.ndarray:
    """alpha[row, end, language]: the probability of the row's first characters, over all segmentations.

    p has a row for each piece, and a last one for unknown characters."""
    alpha = np.zeros((len(lengths), int(lengths.max(initial=0)) + 1, p.shape[1]))
    alpha[:, 0] = 1
    for s, e, rows, piece in segments:
        alpha[rows, e] += alpha[rows, s] * p[piece]
    return alpha


def forward_log(lengths: np.ndarray, segments: list, logp: np.ndarray) -> np.ndarray:
    """forward() in logarithms."""
    alpha = np.full((len(lengths), int(lengths.max(initial=0)) + 1, logp.shape[1]), -np.inf)
    alpha[:, 0] = 0
    for s, e, rows, piece in segments:
        alpha[rows, e] = np.logaddexp(alpha[rows, e], alpha[rows, s] + logp[piece])
    return alpha


def log_chances(words: list[str], trie: Trie, p: np.ndarray, cells: int = 1 << 20) -> np.ndarray:
    """The logarithm of each word's probability in each language, however long the word and however small p.

    Words of like length are taken together, at most `cells` characters, padding included, or one word at a time.
    """
    out = np.zeros((len(words), p.shape[1]))
    logp = np.log(p)

    def each(rows: list[int]) -> Iterator[tuple[list[int], np.ndarray, list]]:
        for part in _alike([words[k] for k in rows], cells // max(1, p.shape[1])):
            yield (own := [rows[k] for k in part]), *trie.segments([words[k] for k in own])

    faint: list[int] = []
    short = [k for k, w in enumerate(words) if len(w) <= SHORT]
    faint += [k for k, w in enumerate(words) if len(w) > SHORT]
    for own, lengths, segments in each(short):
        chance = forward(lengths, segments, p)[np.arange(len(own)), lengths]
        low = (chance < FAINT).any(axis=1)
        out[own] = np.log(np.where(low[:, None], 1, chance))
        faint += [own[k] for k in np.flatnonzero(low)]
    for own, lengths, segments in each(faint):
        out[own] = forward_log(lengths, segments, logp)[np.arange(len(own)), lengths]
    return out


def _alike(words: list[str], cells: int) -> Iterator[list[int]]:
    """Positions of words in batches of like length."""
    order = sorted(range(len(words)), key=lambda k: len(words[k]))
    at = 0
    while at < len(order):
        stop = at + 1
        while stop < len(order) and (stop + 1 - at) * (len(words[order[stop]]) + 1) <= cells:
            stop += 1
        yield order[at:stop]
        at = stop


def fit_pieces(words: list[str], counts: np.ndarray, trie: Trie, n_pieces: int, rounds: int = 4, smooth: float = 0.1) -> np.ndarray:
    """Piece probabilities of one language from word counts, by expectation maximisation."""
    p = np.full((n_pieces + 1, 1), 1.0 / n_pieces)
    p[-1] = UNKNOWN
    for _ in range(rounds):
        expected, logp = np.zeros(n_pieces + 1), np.log(p)
        for part in _alike(words, 1 << 17):
            weight = counts[part]
            lengths, segments = trie.segments([words[k] for k in part])
            alpha = forward_log(lengths, segments, logp)[..., 0]
            beta = np.full_like(alpha, -np.inf)
            beta[np.arange(len(part)), lengths] = 0
            for s, e, rows, piece in reversed(segments):
                beta[rows, s] = np.logaddexp(beta[rows, s], logp[piece, 0] + beta[rows, e])
            total = alpha[np.arange(len(part)), lengths]
            for s, e, rows, piece in segments:
                share = np.exp(alpha[rows, s] + logp[piece, 0] + beta[rows, e] - total[rows]) * weight[rows]
                expected += np.bincount(np.where(piece < 0, n_pieces, piece), share, n_pieces + 1)
        known = expected[:-1] + smooth
        p = np.append(known / known.sum(), UNKNOWN)[:, None]
    return p[:, 0]


@dataclass
class Model:
    languages: list[str]
    pieces: list[str]
    p: np.ndarray  # pieces and unknown x languages


class Scorer:
    """Log probabilities of words in every language, cached for at most cache_words of them."""

    def __init__(self, model: Model, cache_words: int = 150_000):
        self.model, self.trie, self.cache_words = model, Trie(model.pieces), cache_words
        self._clear()

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.languages)))

    def learn(self, words: list[str]) -> None:
        found = log_chances([MARK + w for w in words], self.trie, self.model.p)
        self.known.update(zip(words, range(len(self.known), len(self.known) + len(words)), strict=True))
        self.table = np.concatenate([self.table, found])

    def texts(self, texts: list[str]) -> list[tuple[str, float]]:
        """(language, score): the likeliest language, and its probability if all were as likely beforehand."""
        split = [words_of(t) for t in texts]
        if len(self.known) > self.cache_words:
            self._clear()
        new = set().union(*split).difference(self.known)
        if new and self.model.languages:
            self.learn(sorted(new))
        out = []
        for words in split:
            if not words or not self.model.languages:
                out.append(("und", 0.0))
                continue
            total = self.table[np.fromiter(map(self.known.__getitem__, words), dtype=np.int64, count=len(words))].sum(axis=0)
            best = int(total.argmax())
            out.append((self.model.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def words_of(text: str) -> list[str]:
    """What counts as a word, in fitting and in scoring."""
    return letters().findall(text.lower())


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, text) to (lang, word, n), added up in each batch."""
    for batch in batches:
        count = Counter((lang, w) for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True) if text for w in words_of(text))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in count], pa.string()), pa.array([k[1] for k in count], pa.string()), pa.array(list(count.values()), pa.int64())], ["lang", "word", "n"])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, pieces: str = PIECES, docs_per_language: int = 1500, words_per_language: int = 30_000) -> Model:
    """A model from labelled docs (doc_id, text, lang), those held out and those without a doc_id left aside.

    It is fitted on a bounded sample: about docs_per_language documents of each language, chosen by a hash of the
    doc_id, and their words_per_language most frequent words.  Every language that is labelled is learned, each in a task of its own.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chance = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) / F.lit(1_000_003.0)
    # a number per language, as the model has a column for each; texts are not shuffled for it
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    share = F.create_map(*(x for lang, n in sizes.items() for x in (F.lit(lang), F.lit(docs_per_language / n)))) if sizes else None
    sample = known.where(chance < share[F.col("lang")]) if sizes else known.limit(0)
    counts = mapped(sample.select("lang", "text"), _word_counts, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    best = counts.withColumn("k", first).where(F.col("k") <= words_per_language)

    def task(table: pa.Table) -> pa.Table:
        table = table.sort_by("k")
        found = vocabulary(pieces)
        p = fit_pieces([MARK + w for w in table["word"].to_pylist()], table["n"].to_numpy().astype(float), Trie(found), len(found))
        return pa.table({"lang": table["lang"][:1], "p": pa.array([p.tobytes()], pa.binary())})

    rows = best.select("lang", "word", "n", "k").groupBy("lang").applyInArrow(task, "lang string, p binary").orderBy("lang").collect()
    found = vocabulary(pieces)
    p = [np.frombuffer(r["p"], dtype=np.float64) for r in rows]
    return Model([r["lang"] for r in rows], found, np.stack(p, axis=1) if p else np.zeros((len(found) + 1, 0)))


_SCORERS: dict[int, Scorer] = {}


def predict(docs: DataFrame, model: Model, batch_texts: int = 256) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, held_out, lang_pred, score.

    A null text, or one without a letter, is `und` with score 0, as is every text if nothing was learned.
    held_out is false for a null doc_id.  Texts are scored whole; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # vocabulary x languages

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = id(shared.value)
        if key not in _SCORERS:
            _SCORERS.clear()
            _SCORERS[key] = Scorer(shared.value)
        for batch in batches:
            for at in range(0, batch.num_rows, batch_texts):
                part = batch.slice(at, batch_texts)
                lang, score = zip(*_SCORERS[key].texts(part.column(2).to_pylist()), strict=True)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(lang), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    source = docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), F.coalesce("text", F.lit("")).alias("text"))
    return mapped(source, task, "doc_id long, held_out boolean, lang_pred string, score double")
