"""Language by segmentation-marginalised unigrams over a fixed public vocabulary.

A language is a distribution over the pieces of a public sentencepiece vocabulary (with
its byte pieces, so that every word can be spelled).  A word's probability is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the
product over its words.  Since words are independent, each distinct word of a block is
scored once, for all languages together, and all words of a length step through
the algorithm side by side.  Long words, and words so improbable that their products
could leave the range of a double, are scored in logarithms.

Learning takes one expectation step over every training text: the forward-backward
posteriors of the pieces under equal piece probabilities, summed per language.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import wordhash as W
from .common import row_blocks, text_buffer, texts
from .quality import held_out
from .tokens import tokenizer_file

VOCABULARY, SMOOTHING, UNDETERMINED = "piece_bpe_32k.model", 0.05, "und"
#: Bytes of a word (with its blank) that steps through in products, and of text between two counts of distinct words.
LONGEST, BLOCK = 40, 8 << 20
#: Bytes of long words side by side; a letter run of more is scored as runs of that many.
LONG_BYTES = 1 << 20
#: Scales the probabilities per byte; a product of 40 bytes above _LEAST has lost nothing to underflow.
_SCALE, _LEAST = 64.0, 1e-200

_LETTERS = np.ones(256, bool)
_LETTERS[65:91] = _LETTERS[97:123] = _LETTERS[128:] = False
_LOW = np.arange(256, dtype=np.uint8)
_LOW[65:91] += 32


class Pieces:
    """The vocabulary as byte strings (a blank marks a word's start), found by hash."""

    def __init__(self, name: str):
        import sentencepiece
        sp = sentencepiece.SentencePieceProcessor(model_file=tokenizer_file(name))
        strings: dict[bytes, int] = {}
        for i in range(sp.get_piece_size()):
            if sp.is_byte(i):
                strings.setdefault(bytes([int(sp.id_to_piece(i)[1:-1], 16)]), i)
        for i in range(sp.get_piece_size()):
            if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)):
                s = sp.id_to_piece(i).replace("▁", " ").encode()
                if b" " not in s[1:] and len(s) <= LONGEST:
                    strings[s] = i
        self.size, self.longest = sp.get_piece_size(), max(map(len, strings))
        flat = np.frombuffer(b"".join(strings), np.uint8)
        ends = np.cumsum([len(s) for s in strings])
        hashes = W.span_hashes(flat, ends - [len(s) for s in strings], ends)
        order = np.argsort(hashes)
        self.hashes, self.ids = hashes[order], np.array(list(strings.values()), np.int64)[order]

    def lattice(self, words: np.ndarray):
        """(start, end, rows, piece ids) for every span of words (n x length bytes) where pieces stand, by end."""
        n, length = words.shape
        up, down = W._powers(length + 1)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * up[:length], axis=1, out=sums[:, 1:])
        out = []
        for e in range(1, length + 1):
            for s in range(max(0, e - self.longest), e):
                h = W.mix((sums[:, e] - sums[:, s]) * down[s] + np.uint64((e - s) * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
                i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
                rows = np.flatnonzero(self.hashes[i] == h)
                if len(rows):
                    out.append((s, e, rows, self.ids[i[rows]]))
        return out

    def long_lattice(self, words: np.ndarray, lens: np.ndarray):
        """The same of words of ``lens`` bytes, padded: in few steps for long words, of which there may be few."""
        n, length = words.shape
        up, down = W._powers(length + 1)
        sums = np.zeros((n, length + 1), np.uint64)
        np.cumsum((words.astype(np.uint64) + np.uint64(1)) * up[:length], axis=1, out=sums[:, 1:])
        found = []
        for k in range(1, min(self.longest, length) + 1):
            h = W.mix((sums[:, k:] - sums[:, :-k]) * down[:length - k + 1] + np.uint64(k * 0xD6E8FEB86659FD93 & (1 << 64) - 1))
            i = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            rows, at = np.nonzero(self.hashes[i] == h)
            inside = at + k <= lens[rows]
            rows, at = rows[inside], at[inside]
            found.append((at, at + k, rows, self.ids[i[rows, at]]))
        s, e, rows, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((rows, s, e))
        s, e, rows, ids = s[order], e[order], rows[order], ids[order]
        cuts = np.flatnonzero((np.diff(s) != 0) | (np.diff(e) != 0)) + 1
        return [(int(s[a]), int(e[a]), rows[a:b], ids[a:b]) for a, b in zip([0, *cuts], [*cuts, len(s)], strict=True)]


@functools.cache
def pieces(name: str) -> Pieces:
    return Pieces(name)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Lower-cased letter runs: bytes, their spans and each row's span range."""
    low = _LOW[data]
    lead = np.flatnonzero(data[:-1] == 0xC3) if len(data) else np.zeros(0, int)
    tail = data[lead + 1] if len(lead) else np.zeros(0, np.uint8)
    low[lead[(tail >= 0x80) & (tail <= 0x9E) & (tail != 0x97)] + 1] += 32
    inside = ~_LETTERS[data]
    edge = np.zeros(len(data), bool)
    edge[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:]
    starts = np.flatnonzero(begin)
    end = inside.copy()
    end[:-1] &= ~inside[1:] | edge[1:]
    ends = np.flatnonzero(end) + 1
    long = ends - starts > LONG_BYTES
    if long.any():
        cut = [np.arange(a, b, LONG_BYTES) for a, b in zip(starts[long], ends[long], strict=True)]
        starts = np.sort(np.concatenate([starts[~long], *cut]))
        ends = np.minimum(starts + LONG_BYTES, ends[np.searchsorted(ends, starts, side="right")])
    return low, starts, ends, np.searchsorted(starts, offsets)


def _by_length(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(indices, matrix of words with a blank before them) per word length below ``LONGEST``, at most 20,000 words each."""
    lens = ends - starts
    order = np.argsort(lens, kind="stable")
    for n in np.unique(lens[lens < LONGEST]):
        own = order[np.searchsorted(lens[order], n):np.searchsorted(lens[order], n, side="right")]
        for k in range(0, len(own), 20_000):
            part = own[k:k + 20_000]
            m = np.full((len(part), n + 1), 0x20, np.uint8)
            m[:, 1:] = low[starts[part][:, None] + np.arange(n)]
            yield part, m


def _forward(lattice, n: int, length: int, probs: np.ndarray) -> np.ndarray:
    """alpha[position, word, language], scaled by position."""
    alpha = np.zeros((length + 1, n, probs.shape[1]))
    alpha[0] = 1
    for s, e, rows, ids in lattice:
        alpha[e, rows] += alpha[s, rows] * (probs[ids] * _SCALE ** (e - s))
    return alpha


def _by_long_length(low: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    """(indices, matrix of words with a blank before them, zeros after them, lengths with the blank) of the longer words, those of about the same length together."""
    lens = ends - starts + 1
    order = np.flatnonzero(lens > LONGEST)
    order = order[np.argsort(lens[order], kind="stable")]
    k = 0
    while k < len(order):
        most = int(lens[order[k]]) * 5 // 4
        own = order[k:min(int(np.searchsorted(lens[order], most, side="right")), k + max(1, LONG_BYTES // 4 // most))]
        at = np.arange(int(lens[own[-1]]) - 1)
        m = np.full((len(own), len(at) + 1), 0x20, np.uint8)
        m[:, 1:] = np.where(at < lens[own][:, None] - 1, low[np.minimum(starts[own][:, None] + at, len(low) - 1)], 0)
        yield own, m, lens[own]
        k += len(own)


def _log_scores(vocab: Pieces, words: np.ndarray, lens: np.ndarray, logs: np.ndarray) -> np.ndarray:
    """log probability of each word (padded, by ascending length) from the logs of the pieces' probabilities; positions older than a piece aren't kept."""
    size = vocab.longest + 1
    alpha = np.full((size, len(words), logs.shape[1]), -np.inf)
    alpha[0] = 0
    out, now = np.full((len(words), logs.shape[1]), -np.inf), 0
    for s, e, rows, ids in vocab.long_lattice(words, lens):
        if e != now:
            now = e
            alpha[e % size] = -np.inf
        alpha[e % size, rows] = np.logaddexp(alpha[e % size, rows], alpha[s % size, rows] + logs[ids])
        a, b = np.searchsorted(lens, (e, e + 1))
        out[a:b] = alpha[e % size, a:b]
    return out


def word_scores(vocab: Pieces, low, starts, ends, probs: np.ndarray) -> np.ndarray:
    """log probability of each word under each language."""
    out, logs = np.zeros((len(starts), probs.shape[1])), np.log(probs)
    for own, m in _by_length(low, starts, ends):
        last = _forward(vocab.lattice(m), len(m), m.shape[1], probs)[-1]
        weak = (last < _LEAST).any(axis=1)
        out[own] = np.log(np.maximum(last, _LEAST)) - m.shape[1] * np.log(_SCALE)
        if weak.any():
            out[own[weak]] = _log_scores(vocab, m[weak], np.full(weak.sum(), m.shape[1]), logs)
    for own, m, lens in _by_long_length(low, starts, ends):
        out[own] = _log_scores(vocab, m, lens, logs)
    return out


def expected_counts(vocab: Pieces, low, starts, ends, weights: np.ndarray) -> np.ndarray:
    """Expected uses of each piece (pieces x languages) if all pieces are equally likely; weights: uses of each word in each language."""
    total = np.zeros((vocab.size, weights.shape[1]))
    p = 1.0 / vocab.size
    one = np.full((vocab.size, 1), p)
    for own, m in _by_length(low, starts, ends):
        lattice = vocab.lattice(m)
        n, length = m.shape
        alpha = _forward(lattice, n, length, one)[:, :, 0]
        beta = np.zeros((length + 1, n))
        beta[length] = 1
        for s, e, rows, ids in reversed(lattice):
            beta[s, rows] += beta[e, rows] * (p * _SCALE ** (e - s))
        for s, e, rows, ids in lattice:
            share = alpha[s, rows] * beta[e, rows] * (p * _SCALE ** (e - s)) / alpha[length, rows]
            for k in range(weights.shape[1]):
                total[:, k] += np.bincount(ids, share * weights[own[rows], k], vocab.size)
    for own, m, lens in _by_long_length(low, starts, ends):
        lattice = vocab.long_lattice(m, lens)
        alpha, beta = (np.full((m.shape[1] + 1, len(m)), -np.inf) for _ in range(2))
        alpha[0], beta[lens, np.arange(len(m))] = 0, 0
        for s, e, rows, ids in lattice:
            alpha[e, rows] = np.logaddexp(alpha[e, rows], alpha[s, rows] + np.log(p))
        for s, e, rows, ids in reversed(lattice):
            beta[s, rows] = np.logaddexp(beta[s, rows], beta[e, rows] + np.log(p))
        used = [(ids, rows, np.exp(alpha[s, rows] + beta[e, rows] + np.log(p) - beta[0, rows])) for s, e, rows, ids in lattice]
        ids, rows, share = (np.concatenate(x) for x in zip(*used, strict=True))
        for k in range(weights.shape[1]):
            total[:, k] += np.bincount(ids, share * weights[own[rows], k], vocab.size)
    return total


def fit(docs: DataFrame, vocabulary: str = VOCABULARY, smoothing: float = SMOOTHING) -> tuple[list[str], np.ndarray]:
    """(languages, piece probabilities as pieces x languages) of all documents with a language that aren't held out."""
    learn = docs.select(F.col("lang").cast("string").alias("lang"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        F.col("doc_id").alias("doc_id")).where(F.col("lang").isNotNull() & ~held_out("doc_id")).select("lang", "text")

    def run(batches):
        vocab, total = pieces(vocabulary), {}
        for b in batches:
            langs = np.array(b.column(0).to_pylist(), object)
            data, offsets = text_buffer(b.column(1))
            for i, j in row_blocks(offsets, BLOCK):
                low, starts, ends, at = _words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                names, of = np.unique(langs[i:j].astype(str), return_inverse=True)
                uniq, first, inverse = np.unique(W.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
                owner = np.repeat(of, np.diff(at))
                weights = np.bincount(inverse * len(names) + owner, minlength=len(uniq) * len(names)).reshape(len(uniq), len(names))
                counts = expected_counts(vocab, low, starts[first], ends[first], weights)
                for k, name in enumerate(names):
                    total[name] = total.get(name, 0) + counts[:, k]
        for name, c in total.items():
            some = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array([str(name)] * len(some)), pa.array(some), pa.array(c[some])], ["lang", "piece", "uses"])

    sums = learn.mapInArrow(run, "lang string, piece long, uses double").groupBy("lang", "piece").agg(F.sum("uses").alias("uses"))
    got = sums.toArrow()  # at most pieces x languages rows
    found = learn.select("lang").distinct().orderBy("lang").toArrow().column(0).to_pylist()
    probs = np.full((pieces(vocabulary).size, len(found)), smoothing)
    index = {x: k for k, x in enumerate(found)}
    cols = np.array([index[x] for x in got.column("lang").to_pylist()], np.int64)
    probs[got.column("piece").to_numpy(), cols] += np.round(got.column("uses").to_numpy(), 6)
    return found, probs / probs.sum(0)


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per document row: doc_id, held_out, lang_pred, score (posterior of the predicted language, all alike beforehand).

    ``und`` with score 0 for texts that are null or have no letter, and for all texts if
    nothing was learned.  Ties go to the first language by name.
    """
    langs, probs = model
    shared = docs.sparkSession.sparkContext.broadcast(probs)  # pieces x languages

    def run(batches):
        vocab, p = pieces(vocabulary), shared.value
        for b in batches:
            data, offsets = text_buffer(b.column(1))
            preds, scores = [], []
            for i, j in row_blocks(offsets, BLOCK):
                low, starts, ends, at = _words(data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i])
                logs = np.zeros((j - i, len(langs)))
                if len(starts) and langs:
                    uniq, first, inverse = np.unique(W.span_hashes(low, starts, ends), return_index=True, return_inverse=True)
                    each = word_scores(vocab, low, starts[first], ends[first], p)[inverse]
                    some = np.flatnonzero(at[1:] > at[:-1])
                    logs[some] = np.add.reduceat(each, at[some], axis=0)
                for r in range(j - i):
                    letters = at[r + 1] > at[r] and langs
                    if letters and not ((data[offsets[i + r]:offsets[i + r + 1]] | 32) - 97 < 26).any():
                        letters = any(c.isalpha() for c in data[offsets[i + r]:offsets[i + r + 1]].tobytes().decode())
                    if letters:
                        k = int(np.argmax(logs[r]))
                        preds.append(langs[k])
                        scores.append(float(1 / np.exp(logs[r] - logs[r, k]).sum()))
                    else:
                        preds.append(UNDETERMINED)
                        scores.append(0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(preds, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    out = texts(docs).mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score")


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, fit(docs))
