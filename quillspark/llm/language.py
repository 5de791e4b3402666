"""Language ID by unigram pieces, with all segmentations of a word summed.

The pieces are those of a fixed public vocabulary. Each language has a probability for each piece; a word's probability is the sum over its
segmentations of the product of their pieces' probabilities, found by a forward pass over the word. Expected counts from
forward and backward passes give the probabilities (expectation maximisation). All words of a batch are passed over together, in numpy.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, fold_of

VOCABULARY = "piece_bpe_32k.model"
#: In words of more letters the sums are kept as logarithms, so that none underflows.
LONG = 40
#: Letters whose passes are held in memory together.
SOME = 200_000
#: The probabilities travel to every task: a row for each piece, a column for each language.
MOST_LANGUAGES = 1000
UNKNOWN = 1e-7
#: The letters below U+0250, all that a Latin text has; any script's letters, with the marks that follow them.
_LATIN = re.compile("[a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f]+")
_LETTERS = regex.compile(r"\p{L}[\p{L}\p{M}]*")
_B = 0xD1342543DE82EF95
_U = np.uint64


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text, in lower case."""
    low = (text or "").lower()
    return (_LATIN if low.isascii() or max(low) < "\u0250" else _LETTERS).findall(low)


def some_words(words: list[str]) -> Iterator[list[int]]:
    """The places of words, short ones and long ones apart, in groups of about SOME letters."""
    for long in (False, True):
        at, held = [], 0
        for i, w in enumerate(words):
            if (len(w) > LONG) == long:
                at.append(i)
                held += len(w)
                if held >= SOME:
                    yield at
                    at, held = [], 0
        if at:
            yield at


class Pieces:
    """The vocabulary's pieces by hash; piece 0 stands for any single character."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        text = sorted({model.id_to_piece(i).lower() for i in range(model.get_piece_size()) if not model.is_control(i) and not model.is_unknown(i) and not model.is_byte(i)})
        flat, lengths = self._flat(text)
        ends = np.cumsum(lengths)
        hashes = self._hash(flat, ends - lengths, lengths)
        order = np.argsort(hashes)
        self.hashes, self.count, self.longest = hashes[order], len(text) + 1, int(lengths.max())

    @staticmethod
    def _flat(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4").astype(_U), np.array([len(w) for w in words], np.int64)

    @staticmethod
    def _hash(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        power, inverse = (np.cumprod(np.append(_U(1), np.full(len(flat), x, _U))) for x in (_B, pow(_B, -1, 1 << 64)))
        x = (flat + _U(1)) * _U(0x9E3779B97F4A7C15)
        x ^= x >> _U(29)
        sums = np.append(_U(0), np.cumsum(x * power[:-1]))
        out = (sums[start + length] - sums[start]) * inverse[start]
        return out ^ (out >> _U(31))

    def lattice(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray, np.ndarray]]]:
        """First and last node of each word, and the edges (from, to, piece) by the place in the word where they end."""
        flat, lengths = self._flat(["▁" + w for w in words])
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        at, left = np.arange(len(flat)), np.repeat(ends, lengths) - np.arange(len(flat))
        starts, stops, pieces = [at], [at + 1], [np.zeros(len(flat), np.int64)]
        for n in range(1, self.longest + 1):
            some = at[left >= n]
            if not len(some):
                break
            h = self._hash(flat, some, np.full(len(some), n))
            k = np.minimum(np.searchsorted(self.hashes, h), len(self.hashes) - 1)
            hit = self.hashes[k] == h
            starts.append(some[hit]), stops.append(some[hit] + n), pieces.append(k[hit] + 1)
        start, stop, piece = map(np.concatenate, (starts, stops, pieces))
        w = word[start]
        place = stop - (ends - lengths)[w]
        order = np.argsort(place, kind="stable")
        start, stop, piece, w, place = start[order] + w[order], stop[order] + w[order], piece[order], w[order], place[order]
        cuts = np.searchsorted(place, np.arange(1, int(lengths.max()) + 2))
        return ends - lengths + np.arange(len(words)), ends + np.arange(len(words)), [(start[a:b], stop[a:b], piece[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]

    def forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        """Log probability of each word in each language; p: pieces x languages."""
        out = np.zeros((len(words), p.shape[1]))
        for at in some_words(words):
            some = [words[i] for i in at]
            out[at] = self._forward_logs(some, np.log(p)) if len(some[0]) > LONG else self._forward(some, p)
        return out

    def _forward(self, words: list[str], p: np.ndarray) -> np.ndarray:
        first, last, layers = self.lattice(words)
        out = np.zeros((last[-1] + 1, p.shape[1]))
        out[first] = 1
        for start, stop, piece in layers:
            order = np.argsort(stop, kind="stable")
            s, e, q = start[order], stop[order], piece[order]
            heads = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            out[e[heads]] += np.add.reduceat(out[s] * p[q], heads, axis=0)
        return np.log(out[last])

    def _forward_logs(self, words: list[str], logs: np.ndarray) -> np.ndarray:
        first, last, layers = self.lattice(words)
        out = np.full((last[-1] + 1, logs.shape[1]), -np.inf)
        out[first] = 0
        for start, stop, piece in layers:
            order = np.argsort(stop, kind="stable")
            s, e, q = start[order], stop[order], piece[order]
            heads = np.flatnonzero(np.append(True, e[1:] != e[:-1]))
            out[e[heads]] = np.logaddexp.reduceat(out[s] + logs[q], heads, axis=0)
        return out[last]

    def expected(self, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
        """Expected piece counts of words that stand n times, under one language's p."""
        counts = np.zeros(self.count)
        for at in some_words(words):
            some = [words[i] for i in at]
            counts += self._expected_logs(some, n[at], np.log(p)) if len(some[0]) > LONG else self._expected(some, n[at], p)
        return counts

    def _expected(self, words: list[str], n: np.ndarray, p: np.ndarray) -> np.ndarray:
        first, last, layers = self.lattice(words)
        a, b = np.zeros(last[-1] + 1), np.zeros(last[-1] + 1)
        a[first] = 1
        for start, stop, piece in layers:
            np.add.at(a, stop, a[start] * p[piece])
        b[last] = 1
        for start, stop, piece in reversed(layers):
            np.add.at(b, start, b[stop] * p[piece])
        weight, counts = np.repeat(n / a[last], last - first + 1), np.zeros(self.count)
        for start, stop, piece in layers:
            np.add.at(counts, piece, a[start] * p[piece] * b[stop] * weight[start])
        return counts

    def _expected_logs(self, words: list[str], n: np.ndarray, logs: np.ndarray) -> np.ndarray:
        first, last, layers = self.lattice(words)
        a, b = np.full(last[-1] + 1, -np.inf), np.full(last[-1] + 1, -np.inf)
        a[first] = 0
        for start, stop, piece in layers:
            np.logaddexp.at(a, stop, a[start] + logs[piece])
        b[last] = 0
        for start, stop, piece in reversed(layers):
            np.logaddexp.at(b, start, b[stop] + logs[piece])
        weight, counts = np.repeat(np.log(n) - a[last], last - first + 1), np.zeros(self.count)
        for start, stop, piece in layers:
            np.add.at(counts, piece, np.exp(a[start] + logs[piece] + b[stop] + weight[start]))
        return counts


_PIECES: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _PIECES:
        _PIECES[path] = Pieces(path)
    return _PIECES[path]


def train(docs: DataFrame, path: str, per_language: int = 1000, rounds: int = 3) -> tuple[list[str], np.ndarray]:
    """Languages and their piece probabilities, from at most per_language texts of each language (those whose ids hash least).

    docs: doc_id, text, lang; rows with a null text or language teach nothing, repeated rows count as one when texts are chosen and each when
    words are counted, a null id is an id of its own. More than MOST_LANGUAGES languages are an error. The words are counted on the
    executors, and only sums for the fixed pieces come back.
    """
    known = docs.filter("text IS NOT NULL AND lang IS NOT NULL").select("doc_id", "lang", F.xxhash64("doc_id").alias("h"))
    sizes = known.groupBy("lang").agg(F.count("*").alias("rows")).limit(MOST_LANGUAGES + 1).collect()
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    # Ids that hash under a bound, about three times as many as wanted, are ranked; no language's rows meet in one task.
    bound = {r["lang"]: float(min(1.0, (3 * per_language + 100) / r["rows"])) for r in sizes}
    share = F.create_map(*[F.lit(x) for kv in bound.items() for x in kv])[F.col("lang")] if bound else F.lit(1.0)
    few = known.filter(F.pmod(F.col("h"), F.lit(1 << 40)) < share * F.lit(float(1 << 40))).distinct()
    first = Window.partitionBy("lang").orderBy(F.pmod(F.col("h"), F.lit(1 << 40)), "doc_id")
    ids = few.withColumn("k", F.row_number().over(first)).filter(F.col("k") <= per_language).select(F.col("doc_id").alias("own"), F.col("lang").alias("of"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from collections import Counter

        for batch in batches:
            seen: Counter = Counter()
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                seen.update((lang, w) for w in words_of(text.as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], names=["lang", "word", "n"])

    texts = docs.join(F.broadcast(ids), F.col("doc_id").eqNullSafe(F.col("own")) & (F.col("lang") == F.col("of"))).select("lang", "text")
    words = cut(texts.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")).repartition(12))
    langs = sorted(r["lang"] for r in words.select("lang").distinct().collect())
    size = pieces(path).count
    p = np.full((size, len(langs)), 1 / size)
    for _ in range(rounds if langs else 0):

        def expect(batches: Iterable[pa.RecordBatch], p=p) -> Iterator[pa.RecordBatch]:
            total = np.zeros_like(p)
            for batch in batches:
                lang, word, n = np.array(batch.column(0).to_pylist()), batch.column(1).to_pylist(), batch.column(2).to_numpy()
                for k, name in enumerate(langs):
                    at = np.flatnonzero(lang == name)
                    if len(at):
                        total[:, k] += pieces(path).expected([word[i] for i in at], n[at].astype(float), p[:, k])
            which, k = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(which), pa.array(k), pa.array(total[which, k])], names=["piece", "k", "n"])

        sums = words.mapInArrow(expect, "piece long, k long, n double").groupBy("piece", "k").agg(F.sum("n").alias("n")).toPandas()  # pieces x languages at most
        counts = np.full(p.shape, 0.05)
        counts[sums["piece"], sums["k"]] += sums["n"]
        p = counts / counts.sum(axis=0)
        p[0] = UNKNOWN
    return langs, p


def identify(docs: DataFrame, langs: list[str], p: np.ndarray, path: str, most_words: int = 400_000) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text): the likeliest language and its posterior under equal priors.

    und and 0 for a null text, one without letters, or if no language was learned. Equal languages: the first in order. Each row is judged by
    its own text: repeated rows get equal results, rows with null ids are kept. Other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(p)  # pieces x languages, MOST_LANGUAGES at most

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, p = pieces(path), sent.value
        known: dict[str, int] = {}
        held = np.zeros((0, len(langs)))
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                part = batch.slice(i, 1000)
                texts = [words_of(t.as_py()) if langs else [] for t in part.column(1)]
                if len(known) > most_words:
                    known, held = {}, held[:0]
                new = list(set().union(*texts).difference(known))
                if new:
                    known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
                    held = np.concatenate([held, tool.forward(new, p)])
                pred, score = [], []
                for w in texts:
                    if not w:
                        pred.append("und"), score.append(0.0)
                        continue
                    total = held[np.fromiter(map(known.__getitem__, w), np.int64, len(w))].sum(axis=0)
                    best = int(total.argmax())
                    pred.append(langs[best]), score.append(float(1 / np.exp(np.maximum(total - total[best], -700)).sum()))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, lang_pred string, score double")


def op10_language_id(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path, docs = public_tokenizers.path(VOCABULARY), documents(spark, sf_dir, "text", "lang")
    langs, p = train(docs.filter(fold_of(F.col("doc_id"), 3) != 1), path)
    out = identify(docs, langs, p, path)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 3) == 1).alias("held_out"), "lang_pred", "score")
