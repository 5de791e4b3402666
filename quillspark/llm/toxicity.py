"""Toxicity by compression distance: windows are compressed after a dictionary of ordinary text, and after that with one of toxic text.

A window is a word. What the second dictionary saves over the first, in bytes, is the window's distance; a text's
counts of windows that save one, two, ... bytes, against thresholds calibrated on labelled texts, give its score.

The dictionary of ordinary text is trained by zstandard. That of toxic text holds the word beginnings that
distinguish the labelled texts: the contexts (words before) in which a beginning stands are counted once each, so that copies of one
text weigh no more than the text, and those are taken whose log-likelihood ratio against ordinary text is high.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, fold_of, table
from .decontaminate import item_words

_WORDS = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: Opens the dictionaries and closes every window: zstandard looks for no match in a block's last bytes.
_PAD = bytes(range(1, 17))
STEPS = 8


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    centre: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]


class Distances(dict):
    """Bytes saved for each word, remembered up to a bound."""

    def __init__(self, ordinary: bytes, toxic: bytes, most: int = 500_000):
        import zstandard as z

        def coder(content: bytes):
            shape = z.ZstdCompressionParameters.from_level(3, dict_size=len(content), source_size=40, write_content_size=False, write_checksum=False, write_dict_id=False)
            return z.ZstdCompressor(compression_params=shape, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)).compress

        super().__init__()
        self.first, self.second, self.most = coder(_PAD + ordinary), coder(_PAD + ordinary + toxic), most

    def __missing__(self, word: bytes) -> int:
        window = b" " + word + b" " + _PAD
        out = len(self.first(window)) - len(self.second(window))
        if len(self) < self.most:
            self[word] = out
        return out


def features(text: str | None, known: Distances) -> np.ndarray:
    """Counts and rates of the windows that save at least 1, ..., STEPS bytes; of an empty text those of one window that saves none."""
    words = _WORDS.findall((text or "").encode("utf-8", "surrogatepass").lower())
    saved = np.fromiter(map(known.__getitem__, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = np.cumsum(np.bincount(np.clip(saved, 0, STEPS), minlength=STEPS + 1)[::-1])[::-1][1:]
    return np.concatenate((np.log1p(counts), np.log((counts + 0.1) / (len(saved) + 1))))


def _distinctive(sample: DataFrame, most: int, candidates: int) -> list[str]:
    """Word beginnings of 3 to 12 characters, or whole words with a space, that set toxic texts apart; none begins with another.

    Of the candidates that stand out most, those are taken, most at most, that no better one covers.
    """
    w = item_words(F.col("text"))
    pairs = sample.select("toxic", F.explode(F.arrays_zip(w.alias("w"), F.concat(F.array(F.lit("")), w).alias("p"))).alias("x")).filter("x.w IS NOT NULL")
    seen = cut(pairs.select("toxic", F.col("x.w").alias("w"), F.col("x.p").alias("p")).distinct().groupBy("w").agg(F.count_if(F.col("toxic") == 1).alias("a"), F.count_if(F.col("toxic") == 0).alias("b")))
    total = seen.agg(F.sum("a"), F.sum("b")).first()
    if not total[0] or not total[1]:
        return []
    lengths = F.when(F.length("w") > 3, F.sequence(F.lit(3), F.least(F.length("w") - 1, F.lit(12)))).otherwise(F.array().cast("array<int>"))
    starts = F.concat(F.transform(lengths, lambda k: F.substring("w", F.lit(1), k)), F.array(F.concat("w", F.lit(" "))))
    by = seen.filter("length(w) >= 3").select("a", "b", F.explode(starts).alias("start")).groupBy("start").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    share = total[0] / (total[0] + total[1])
    part = lambda n, of: F.when(F.col(n) > 0, F.col(n) * F.log(F.col(n) / ((F.col("a") + F.col("b")) * of))).otherwise(0.0)
    ratio = 2 * (part("a", share) + part("b", 1 - share))
    chosen: list[str] = []
    found = by.filter((F.col("a") >= 5) & (F.col("a") * total[1] > 6 * F.col("b") * total[0])).withColumn("g", F.round(ratio)).filter("g >= 40")
    for r in found.orderBy(F.desc("g"), F.desc(F.length("start")), "start").limit(candidates).collect():
        if len(chosen) < most and not any(r["start"].startswith(c) or c.startswith(r["start"]) for c in chosen):
            chosen.append(r["start"])
    return chosen


def _fitted(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    a, w = np.c_[np.ones(len(x)), x], np.zeros(x.shape[1] + 1)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w += np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + ridge * np.eye(len(w)), a.T @ (y - p) - ridge * w)
    return w


def _pieces(sample: DataFrame, most: int, length: int = 60) -> list[bytes]:
    """At most most stretches of length characters of the ordinary texts' words, those that hash least."""
    line = F.concat(F.lit(" "), F.array_join(item_words(F.col("text")), " "))
    starts = F.sequence(F.lit(0), F.length("line") - 1, F.lit(length))
    cut_up = sample.filter("toxic = 0").select(line.alias("line")).select(F.explode(F.transform(starts, lambda i: F.substring("line", i + 1, F.lit(length)))).alias("piece"))
    least = cut_up.select("piece", F.xxhash64("piece").alias("h")).orderBy("h", "piece").limit(most)
    return [r["piece"].encode("utf-8", "surrogatepass") for r in least.collect()]


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, most_starts: int = 400, candidates: int = 8000, most_pieces: int = 30_000, miss_cost: float = 2.0) -> Model:
    """A model from at most per_class toxic and four times as many ordinary texts, those whose ids hash least. labels: doc_id, toxic (others than 0 and 1 are skipped).

    Whatever the texts' lengths, the driver gets candidates word beginnings, most_pieces stretches of 60 characters to train the dictionary of ordinary text,
    and 2 * STEPS numbers for each text. A toxic text that is missed costs as much as miss_cost false alarms, so a score of 0.5 stands for
    a probability of 1 / (1 + miss_cost). A null id is never sampled; of rows that repeat an id, one text is. Without texts of
    both labels, or where no word beginning sets them apart, the score follows from the labels' shares alone, and is the same for every text or nearly so.
    """
    import zstandard as z

    picked = [labels.filter(F.col("toxic") == y).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n) for y, n in ((1, per_class), (0, 4 * per_class))]
    texts = docs.select("doc_id", "text").join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    sample = cut(texts.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")).select("text", F.col("toxic").cast("int").alias("toxic")))
    starts, pieces = _distinctive(sample, most_starts, candidates), _pieces(sample, most_pieces)
    try:
        ordinary = z.train_dictionary(16_384, pieces).as_bytes()
    except z.ZstdError:  # too little text to train on
        ordinary = b"".join(pieces)[-16_384:]
    toxic = b"".join(b" " + s.encode("utf-8", "surrogatepass") for s in reversed(starts)) + b" "

    def measured(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Distances(ordinary, toxic)
        for batch in batches:
            x = [features(t.as_py(), known).tolist() for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(x, pa.list_(pa.float64()))], names=["toxic", "x"])

    rows = sorted((r["toxic"], r["x"]) for r in sample.mapInArrow(measured, "toxic int, x array<double>").collect())
    x, y = np.array([r[1] for r in rows]).reshape(-1, 2 * STEPS), np.array([r[0] for r in rows], float)
    if not len(set(y.tolist())) == 2:
        return Model(ordinary, toxic, (0.0,) * 2 * STEPS, (1.0,) * 2 * STEPS, (-2.0,) + (0.0,) * 2 * STEPS)
    centre, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    weights = _fitted((x - centre) / scale, y)
    weights[0] += np.log(miss_cost)
    return Model(ordinary, toxic, tuple(centre), tuple(scale), tuple(weights))


_KNOWN: dict[Model, Distances] = {}


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text), by the whole text alone; a null text counts as empty.

    Repeated rows get equal scores, rows with null ids are kept. Other columns are not read.
    """

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if model not in _KNOWN:
            _KNOWN.clear()
            _KNOWN[model] = Distances(model.ordinary, model.toxic)
        known, centre, scale, weights = _KNOWN[model], np.array(model.centre), np.array(model.scale), np.array(model.weights)
        for batch in batches:
            x = np.array([features(t.as_py(), known) for t in batch.column(1)]).reshape(-1, 2 * STEPS)
            z = weights[0] + ((x - centre) / scale) @ weights[1:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(z, -30, 30))))], names=["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "doc_id long, score double")


def op8_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), table(spark, sf_dir, "labels")
    model = train(docs, labels.filter(fold_of(F.col("doc_id"), 5) != 0))
    out = score(docs, model)
    return out.select("doc_id", (fold_of(F.col("doc_id"), 5) == 0).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))
