"""LM scoring: a hashed maximum-entropy model with a class-factored softmax.

The probability of a token is that of its class in its context, times the token's smoothed share of its class. Classes are clusters of
word endings that follow like endings. The class model is a softmax over hashed features: the three last words' endings (the
second and third with a skip), the last word, and the last two words. Its weights come from gradient steps that all
partitions take on their own rows, from common weights, which are averaged by tokens after each round.

Token counts are kept as a table. Frequent tokens, up to a bound, travel to the scoring tasks; the others are joined.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, documents, fold_of
from .minhash import mixed

_U = np.uint64
ENDINGS, CLASSES = 512, 32
#: Slots of a hashed table: as many as there are distinct words, between these bounds. The upper one keeps what a partition sends at half its input.
HASHED, MOST_HASHED = 4096, 65_536
#: The end of a text, and what stands before its first token; both have ending 0, and no word has it.
END, BEFORE = 0x5DEECE66D5DEE200, 0x2545F4914F6CDC00


def tables(hashed: int) -> tuple[int, ...]:
    """The rows of each table of weights."""
    return ENDINGS, ENDINGS, ENDINGS, hashed, hashed, 1


TABLES = tables(HASHED)


class Tokens(dict):
    """64-bit hashes of words whose nine low bits are the ending (1 to 511), remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word) & ~511 | zlib.crc32(word[-3:]) % 511 + 1
        if len(self) < 600_000:
            self[word] = out
        return out


#: What a worker process has hashed serves its next tasks.
_TOKENS = Tokens()


def _groups(batches: Iterable[pa.RecordBatch], known: Tokens, most: int = 400_000) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows, their tokens in a row (each text's, then END), and where each text starts; about most tokens at a time."""
    for batch in batches:
        start, lists, held = 0, [], 0
        for i, text in enumerate(batch.column(1)):
            lists.append((text.as_py() or "").encode("utf-8", "surrogatepass").lower().split())
            held += len(lists[-1]) + 1
            if held >= most or i + 1 == batch.num_rows:
                ends = np.cumsum([len(w) + 1 for w in lists])
                tokens = np.full(ends[-1], END, _U)
                word = np.ones(ends[-1], bool)
                word[ends - 1] = False
                tokens[word] = np.fromiter(map(known.__getitem__, chain.from_iterable(lists)), _U, int(word.sum()))
                yield batch.slice(start, i + 1 - start), tokens, np.append(0, ends)
                start, lists, held = i + 1, [], 0


def _back(tokens: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    """The token n places before each, BEFORE if that is outside of its text."""
    place = np.arange(len(tokens)) - np.repeat(starts[:-1], np.diff(starts))
    return np.where(place >= n, np.roll(tokens, n), _U(BEFORE))


def _features(tokens: np.ndarray, starts: np.ndarray, hashed: int = HASHED) -> list[np.ndarray]:
    one, two, three = (_back(tokens, starts, n) for n in (1, 2, 3))
    ending = lambda t: (t & _U(511)).astype(np.int64)
    pair = mixed(two * _U(0x9E3779B97F4A7C15) + one)
    return [ending(one), ending(two), ending(three), (one >> _U(9) & _U(hashed - 1)).astype(np.int64), (pair & _U(hashed - 1)).astype(np.int64), np.zeros(len(tokens), np.int64)]


@dataclass
class Model:
    n: int  # tokens in training
    v: int  # distinct tokens in training
    cls: np.ndarray  # ending -> class
    mass: np.ndarray  # class -> log10 of its smoothed token count
    frequent: np.ndarray  # sorted tokens that travel along
    counts: np.ndarray  # their counts
    hashed: int = HASHED  # slots of a hashed table
    weights: list[np.ndarray] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.weights = self.weights or [np.zeros((n, CLASSES), np.float32) for n in tables(self.hashed)]


def _sums(weights: list[np.ndarray], features: list[np.ndarray]) -> np.ndarray:
    """Sums of the features' weights, a row for each token, the largest of a row at zero. The last table has one row, the classes' bias."""
    out = weights[0].take(features[0], axis=0)
    for w, f in zip(weights[1:-1], features[1:-1], strict=True):
        out += w.take(f, axis=0)
    out += weights[-1]
    out -= out.max(axis=1, keepdims=True)
    return out


def _probabilities(weights: list[np.ndarray], features: list[np.ndarray]) -> np.ndarray:
    out = _sums(weights, features)
    np.exp(out, out=out)
    out /= out.sum(axis=1, keepdims=True)
    return out


def _target_logs(weights: list[np.ndarray], features: list[np.ndarray], target: np.ndarray) -> np.ndarray:
    """The target classes' log probabilities."""
    out = _sums(weights, features)
    own = out[np.arange(len(out)), target]
    np.exp(out, out=out)
    return own - np.log(out.sum(axis=1))


def _clusters(pairs: np.ndarray, rounds: int = 20) -> np.ndarray:
    """A class for each ending: class 0 is END's, the others are clusters of the endings that follow like endings."""
    total = pairs.sum(axis=0)
    shape = np.sqrt(pairs / np.maximum(total, 1)).T  # ending x ending before it
    u, s, _ = np.linalg.svd(shape * np.sqrt(total)[:, None], full_matrices=False)
    x = (u[:, :12] * s[:12]) / np.sqrt(np.maximum(total, 1))[:, None]
    heavy = np.argsort(-total[1:], kind="stable")[: CLASSES - 1] + 1
    centre = x[heavy].copy()
    for _ in range(rounds):
        near = ((x[:, None, :] - centre[None]) ** 2).sum(axis=2).argmin(axis=1)
        for k in range(len(centre)):
            at = (near == k) & (total > 0)
            if at.any():
                centre[k] = np.average(x[at], axis=0, weights=total[at])
    out = near + 1
    out[0] = 0
    return out


def count(docs: DataFrame) -> DataFrame:
    """(kind, key, n): kind 0 counts tokens, kind 1 pairs of endings (before << 9 | ending), over all rows of docs (doc_id, text)."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, pairs = _TOKENS, np.zeros(ENDINGS * ENDINGS, np.int64)
        for _, tokens, starts in _groups(batches, known, 2_000_000):
            key, n = np.unique(tokens, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(key), np.int64)), pa.array(key.view(np.int64)), pa.array(n)], names=["kind", "key", "n"])
            both = (_back(tokens, starts, 1) & _U(511)) << _U(9) | tokens & _U(511)
            pairs += np.bincount(both.astype(np.int64), minlength=len(pairs))
        at = np.flatnonzero(pairs)
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(at), np.int64)), pa.array(at), pa.array(pairs[at])], names=["kind", "key", "n"])

    return docs.mapInArrow(rows, "kind long, key long, n long").groupBy("kind", "key").agg(F.sum("n").alias("n"))


def _step(docs: DataFrame, model: Model, rate: float, small: int) -> list[np.ndarray]:
    """One round: every partition steps through its rows from the common weights; the average of what they change, by tokens."""
    common, cls, hashed = model.weights, model.cls, model.hashed
    sizes = np.cumsum((0, *tables(hashed)))
    blocks = 16

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, squares, seen = [w.copy() for w in common], [np.ones(len(w), np.float32) for w in common], 0
        for _, tokens, starts in _groups(batches, _TOKENS):
            features, target = _features(tokens, starts, hashed), cls[(tokens & _U(511)).astype(np.int64)]
            seen += len(tokens)
            for i in range(0, len(tokens), small):
                part = [f[i : i + small] for f in features]
                g = _probabilities(weights, part)
                g[np.arange(len(g)), target[i : i + small]] -= 1
                for w, q, f in zip(weights, squares, part, strict=True):
                    if len(w) == 1:
                        sums, at = g.sum(axis=0, keepdims=True), np.zeros(1, np.int64)
                    else:
                        order = np.argsort(f.astype(np.uint16 if len(w) <= 65_536 else np.uint32), kind="stable")  # 16 bits: a radix sort
                        own = f[order]
                        heads = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
                        sums, at = np.add.reduceat(g.take(order, axis=0), heads, axis=0), own[heads]
                    q[at] += (sums * sums).mean(axis=1)
                    w[at] -= rate * sums / np.sqrt(q[at])[:, None]
        if seen:
            change = np.concatenate([w - old for w, old in zip(weights, common, strict=True)])
            pieces = [c.astype(np.float16).tobytes() for c in np.array_split(change, blocks)]
            yield pa.RecordBatch.from_pydict({"block": list(range(blocks)), "tokens": [seen] * blocks, "change": pieces})

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, list] = {}
        for batch in batches:
            for block, n, change in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                held = sums.setdefault(block, [0, 0.0])
                held[0] += n
                held[1] = held[1] + n * np.frombuffer(change, np.float16).astype(np.float64)
        if sums:
            yield pa.RecordBatch.from_pydict({"block": list(sums), "tokens": [v[0] for v in sums.values()], "change": [(v[1] / v[0]).astype(np.float32).tobytes() for v in sums.values()]})

    kind = "block long, tokens long, change binary"
    merged = docs.mapInArrow(rows, kind).repartition(blocks, "block").mapInArrow(add, kind).collect()  # the size of the weights
    if not merged:
        return model.weights
    change = np.concatenate([np.frombuffer(r["change"], np.float32) for r in sorted(merged)]).reshape(-1, CLASSES)
    return [w + change[a:b] for w, a, b in zip(model.weights, sizes[:-1], sizes[1:], strict=True)]


def train(docs: DataFrame, rounds: int = 2, rate: float = 0.3, small: int = 16_384, most_frequent: int = 400_000, most_hashed: int = MOST_HASHED) -> tuple[Model, DataFrame]:
    """A model of all rows of docs (doc_id, text), and the token counts (key, n). Round k steps through the rows whose id's hash is k modulo rounds.

    most_frequent bounds the tokens that travel to the tasks, most_hashed the slots of a hashed table. Without rows all tokens are unknown.
    """
    table = cut(count(docs))
    counts = table.filter("kind = 0").select("key", "n")
    pairs = np.zeros(ENDINGS * ENDINGS)
    for r in table.filter("kind = 1").select("key", "n").collect():  # ENDINGS ** 2 at most
        pairs[r["key"]] = r["n"]
    cls = _clusters(pairs.reshape(ENDINGS, ENDINGS))
    by = counts.groupBy(F.col("key").bitwiseAND(511).alias("ending")).agg(F.sum("n").alias("n"), F.count("*").alias("v")).collect()
    n_of, v_of = np.zeros(CLASSES), np.zeros(CLASSES)
    for r in by:
        n_of[cls[r["ending"]]] += r["n"]
        v_of[cls[r["ending"]]] += r["v"]
    # The least count that most_frequent tokens or fewer reach, from a histogram over powers of two.
    steps = sorted(counts.groupBy(F.floor(F.log2("n")).alias("p")).count().collect(), reverse=True)
    reach, least = 0, None
    for r in steps:
        reach += r["count"]
        if reach > most_frequent:
            break
        least = 2 ** r["p"]
    some = counts.filter(F.col("n") >= least).toPandas() if least is not None else None
    keys = some["key"].to_numpy().view(_U) if some is not None else np.zeros(0, _U)
    order = np.argsort(keys)
    slots = min(max(HASHED, most_hashed), max(HASHED, 1 << (int(v_of.sum()) - 1).bit_length()))
    model = Model(int(n_of.sum()), int(v_of.sum()), cls, np.log10(n_of + 0.1 * (v_of + 1)), keys[order], some["n"].to_numpy()[order] if some is not None else np.zeros(0, np.int64), slots)
    for k in range(rounds):
        model.weights = _step(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == k), model, rate, small)
    return model, counts


def score(docs: DataFrame, model: Model, counts: DataFrame) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_tokens, n_known, base_score, score (log10 probabilities).

    A null or empty text is its end token alone. Rows that share an id, or have none, are scored each by its own text.
    """
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(model)  # bounded by most_frequent and the weights' shape

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, at_row = sent.value, TaskContext.get().partitionId() << 40
        share = np.log10(m.counts + 0.1)
        for batch, tokens, starts in _groups(batches, _TOKENS):
            text = np.repeat(np.arange(batch.num_rows), np.diff(starts))
            features, cls = _features(tokens, starts, m.hashed), m.cls[(tokens & _U(511)).astype(np.int64)]
            of_class = np.empty(len(tokens))
            for i in range(0, len(tokens), 16_384):
                of_class[i : i + 16_384] = _target_logs(m.weights, [f[i : i + 16_384] for f in features], cls[i : i + 16_384])
            of_class /= np.log(10)
            k = np.minimum(np.searchsorted(m.frequent, tokens), max(len(m.frequent) - 1, 0))
            here = m.frequent[k] == tokens if len(m.frequent) else np.zeros(len(tokens), bool)
            head = np.zeros(len(tokens))
            head[here] = share[k[here]]
            sums = lambda x: np.bincount(text, x, batch.num_rows)  # noqa: B023, E731
            rest = tokens[~here].view(np.int64)
            cuts = np.append(0, np.cumsum(np.bincount(text[~here], minlength=batch.num_rows)))
            yield pa.RecordBatch.from_arrays([
                pa.array(at_row + np.arange(batch.num_rows)), batch.column(0), pa.array(np.diff(starts)), pa.array(sums(here).astype(np.int64)),
                pa.array(sums(head)), pa.array(sums(of_class - m.mass[cls])), pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(rest)),
            ], names=["row", "doc_id", "n_tokens", "n_known", "shares", "classes", "rest"])
            at_row += batch.num_rows

    first = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(rows, "row long, doc_id long, n_tokens long, n_known long, shares double, classes double, rest array<long>"))
    tail = first.select("row", F.explode("rest").alias("key")).join(counts, "key", "left")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.1)).alias("more"), F.count("n").alias("known"))
    out = first.drop("rest").join(tail, "row", "left")
    shares = F.col("shares") + F.coalesce("more", F.lit(0.0))
    return out.select(
        "doc_id", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        (shares - F.col("n_tokens") * F.log10(F.lit(model.n + 0.1 * (model.v + 1)))).alias("base_score"), (shares + F.col("classes")).alias("score"),
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = fold_of(F.col("doc_id"), 10) == 0
    model, counts = train(docs.filter(~held))
    out = score(docs, model, counts)
    return out.select("doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(model.n).cast("long").alias("train_tokens"), "base_score", "score")
