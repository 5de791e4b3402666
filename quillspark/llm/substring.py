"""Substring dedup by relative parsing: documents are factored against blocks of every text that stands earlier.

A block is a run of windows that share one anchor: the least hashed short word run (gram) inside a window. What a window's
anchor is depends on the window's words alone, so equal windows have equal anchors wherever they stand.

1. Factoring. Every text is cut into its blocks. A block whose words are those of an earlier block is a factor: all of its windows
   are duplicates. Neighbouring factors join to long ones, a whole copied document to a single one.
2. Factor boundaries. A block that is no factor but shares its anchor with a block of other words can hold a shorter match. Only
   of such blocks, and only of the first of equal ones, the single windows are compared with each other.
3. The spans of both steps are cut from the texts.

Equal blocks and windows of one batch of rows are reduced to the first before any shuffle, and those reduced carry no common key. Of those
that a batch repeats, the first is remembered for the task's later batches, so a passage that stands in a third of all documents puts about
one row for each partition into its group.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import cut, documents
from .minhash import BROADCAST_IDS, WordHashes, mixed, rolled, word_hashes

_B1, _B2 = 0xD1342543DE82EF95, 0xAF251AF3B0F025B5
_U = np.uint64
#: Kinds of a packed place: start << 10 | windows << 2 | kind.
OPEN, SIGNAL, MARK, ASK = 0, 1, 2, 3


class _Texts:
    """Some texts' words in a row: hashes, where each text starts, and hashes of any run of words."""

    def __init__(self, texts: list[str | None], known: WordHashes):
        lists = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.starts = np.cumsum([0, *map(len, lists)])
        self.h = word_hashes([w for ws in lists for w in ws], known)
        self._sums: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def runs(self, start: np.ndarray, length: np.ndarray | int, b: int) -> np.ndarray:
        """Hashes of the words [start, start + length): polynomials in b, freed of the place they stand at."""
        if b not in self._sums:
            power, inverse = (np.cumprod(np.append(_U(1), np.full(len(self.h), x, _U))) for x in (b, pow(b, -1, 1 << 64)))
            self._sums[b] = np.append(_U(0), np.cumsum(self.h * power[:-1])), inverse
        sums, inverse = self._sums[b]
        return mixed((sums[start + length] - sums[start]) * inverse[start] + np.asarray(length).astype(_U))


def _blocks(t: _Texts, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all windows: text number, first window's start in the row, number of windows, anchor hash, for each block."""
    n, wide = len(t.h) - window + 1, window - gram + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    g = rolled(t.h, gram)
    low = (g >> _U(24) << _U(24)) | (np.arange(len(g), dtype=_U) & _U(0xFFFFFF))
    have = 1
    while have * 2 <= wide:
        low, have = np.minimum(low[:-have], low[have:]), have * 2
    if wide > have:
        low = np.minimum(low[: n], low[wide - have : wide - have + n])
    s = np.arange(n)
    at = s + (((low[:n] & _U(0xFFFFFF)).astype(np.int64) - s) & 0xFFFFFF)
    text = np.searchsorted(t.starts, s, "right") - 1
    ok = s + window <= t.starts[text + 1]
    s, at, text = s[ok], at[ok], text[ok]
    if not len(s):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),)
    first = np.flatnonzero(np.append(True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])))
    return text[first], s[first], np.diff(np.append(first, len(s))), g[at[first]]


def _some(batches: Iterable[pa.RecordBatch], chars: int = 3_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about chars characters of their second column."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(sizes, (sizes[start - 1] if start else 0) + chars, "right")))
            yield batch.slice(start, end - start)
            start = end


def _spread(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    return mixed(doc.view(_U) * _U(_B1) + place.view(_U))


def _longs(*columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c).view(np.int64)) for c in columns], names=[f"c{i}" for i in range(len(columns))])


def _reduced(key: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by (key, more, doc, place); which rows open a (key, more) group; which stand later than their group's first."""
    order = np.lexsort((place, doc, more, key))
    key, more, doc, place = key[order], more[order], doc[order], place[order]
    opens = np.append(True, (key[1:] != key[:-1]) | (more[1:] != more[:-1])) if len(key) else np.zeros(0, bool)
    first = np.flatnonzero(opens)[np.cumsum(opens) - 1] if len(key) else np.zeros(0, np.int64)
    return order, opens, (doc != doc[first]) | (place != place[first])


class _Repeated(dict):
    """Of blocks or windows that a batch repeats: where the first of the task's stands, for as many as the bound allows."""

    def __init__(self, least: int = 4, most: int = 100_000):
        super().__init__()
        self.least, self.most, self.keys = least, most, np.zeros(0, _U)

    def later(self, key: np.ndarray, more: np.ndarray, doc: np.ndarray, place: np.ndarray, opens: np.ndarray) -> np.ndarray:
        """Which of the rows, in the order of _reduced, open a group that an earlier batch has at a smaller place."""
        out, first = np.zeros(len(key), bool), np.flatnonzero(opens)
        several = np.diff(np.append(first, len(key))) >= self.least
        some, before = several | np.isin(key[first], self.keys), len(self)
        for i, known in zip(first[some].tolist(), several[some].tolist(), strict=True):
            name = (int(key[i]), int(more[i]))
            at, held = (int(doc[i]), int(place[i])), self.get(name)
            if held is not None:
                out[i] = held < at
                self[name] = min(held, at)
            elif known and len(self) < self.most:
                self[name] = at
        if len(self) > before:
            self.keys = np.fromiter((k for k, _ in self), _U, len(self))
        return out


def _ambiguous(docs: DataFrame) -> DataFrame:
    """Ids that stand with different texts."""
    h = F.xxhash64("text")
    return docs.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(h).alias("x"), F.max(h).alias("y")).filter("x <> y").select("doc_id")


def duplicate_places(docs: DataFrame, window: int = 20, gram: int = 8) -> DataFrame:
    """(doc_id, places): for each document with duplicate windows, packed (start << 10 | windows << 2 | kind), starts counted in words.

    A window is duplicate if its words also start earlier: at a smaller doc_id, or earlier in the same document. Rows
    repeated whole are one document. Rows without doc_id, and rows whose doc_id also stands with another text, are neither
    compared nor compared with. A null text, or one shorter than a window, has no window.
    """
    if not 0 < gram <= window or window - gram + 1 > 255:
        raise ValueError("gram must be between window - 254 and window")
    docs = docs.select("doc_id", "text").filter("doc_id IS NOT NULL")

    def factor(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, repeated = WordHashes(), _Repeated()
        for batch in _some(batches):
            ids, t = batch.column(0).cast(pa.int64()).to_numpy(), _Texts(batch.column(1).to_pylist(), known)
            text, s, n, anchor = _blocks(t, window, gram)
            if not len(s):
                continue
            words = t.runs(s, n + window - 1, _B1)
            doc, place = ids[text], (s - t.starts[text]) << 10 | n << 2
            order, opens, later = _reduced(anchor, words, doc, place)
            anchor, words, doc, place = anchor[order], words[order], doc[order], place[order]
            later |= repeated.later(anchor, words, doc, place, opens)
            group = np.cumsum(np.append(True, anchor[1:] != anchor[:-1])) - 1
            several = (np.bincount(group[opens]) > 1)[group]  # the anchor stands in blocks of different words here
            kind = np.where(later, MARK, np.where(several, ASK, OPEN))
            signal = np.flatnonzero(several & np.append(True, group[1:] != group[:-1]))
            key = np.where(kind == OPEN, anchor, _spread(doc, place))
            yield _longs(np.append(key, anchor[signal]), np.append(words, words[signal]), np.append(doc, doc[signal]), np.append(place | kind, place[signal] | SIGNAL))

    blocks = docs.mapInArrow(factor, "key long, words long, doc_id long, place long").repartition("key")
    kind = F.col("place").bitwiseAND(3)
    same = F.rank().over(Window.partitionBy("key", "words").orderBy("doc_id", F.shiftright("place", 10)))
    all_of = Window.partitionBy("key")
    seen = blocks.withColumn("kind", kind).withColumn("rank", same)
    seen = seen.withColumn("least", F.min("words").over(all_of)).withColumn("most", F.max("words").over(all_of)).withColumn("signal", F.max(F.col("kind") == SIGNAL).over(all_of))
    now = F.when(F.col("kind") != OPEN, F.col("kind")).when(F.col("rank") > 1, MARK).when(F.col("signal") | (F.col("least") != F.col("most")), ASK)
    placed = seen.select("doc_id", now.alias("now"), F.col("place").bitwiseAND(-4).alias("place")).filter(F.col("now") >= MARK)
    found = cut(placed.groupBy("doc_id").agg(F.collect_set(F.col("place").bitwiseOR(F.col("now").cast("long"))).alias("places")))

    of_kind = lambda k: F.filter("places", lambda p: p.bitwiseAND(3) == k)
    asked = found.select("doc_id", of_kind(ASK).alias("places")).filter(F.size("places") > 0)
    ids = asked.select("doc_id")
    # Only the texts that are asked for are shuffled, while their ids are few enough to be sent to every task.
    texts = docs.join(F.broadcast(ids), "doc_id", "left_semi") if ids.count() <= BROADCAST_IDS else docs

    def windows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, repeated = WordHashes(), _Repeated()
        for batch in _some(batches):
            ids, t = batch.column(0).cast(pa.int64()).to_numpy(), _Texts(batch.column(1).to_pylist(), known)
            lists = batch.column(2)
            places, text = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy())
            n = places >> 2 & 0xFF
            text, s = np.repeat(text, n), np.repeat(places >> 10, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = s + t.starts[text]
            one, two, doc = t.runs(at, window, _B1), t.runs(at, window, _B2), ids[text]
            order, opens, later = _reduced(one, two, doc, s)
            one, two, doc, s = one[order], two[order], doc[order], s[order]
            later |= repeated.later(one, two, doc, s, opens)
            keep = opens | later
            yield _longs(*(c[keep] for c in (np.where(later, _spread(doc, s), one), two, doc, s << 10 | 1 << 2 | np.where(later, MARK, OPEN))))

    single = texts.join(asked, "doc_id").select("doc_id", "text", "places").mapInArrow(windows, "key long, words long, doc_id long, place long").repartition("key")
    rank = F.rank().over(Window.partitionBy("key", "words").orderBy("doc_id", F.shiftright("place", 10)))
    also = single.withColumn("rank", rank).filter((F.col("rank") > 1) | (kind == MARK)).select("doc_id", F.col("place").bitwiseOR(F.lit(MARK).cast("long")).alias("place"))
    also = also.groupBy("doc_id").agg(F.collect_set("place").alias("more"))
    both = found.select("doc_id", of_kind(MARK).alias("places")).join(also, "doc_id", "full")
    none = F.array().cast("array<bigint>")
    return both.select("doc_id", F.concat(F.coalesce("places", none), F.coalesce("more", none)).alias("places")).filter(F.size("places") > 0)


_PARTS = re.compile(rb"([\x20\x09-\x0d]+)")


def without_duplicates(docs: DataFrame, window: int = 20, gram: int = 8, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs (doc_id, text, and the columns named in carry): those, and n_words, n_removed, kept, kept_sha256.

    Each word inside a duplicate window goes (see duplicate_places; windows are judged on the input). kept is the text without these words and
    the white space after them, unchanged if none goes, null if the text is null; kept_sha256 is of the kept words joined
    by spaces. Rows that are not compared keep all words.
    """
    import hashlib

    rows = docs.select("doc_id", "text", *carry)
    unclear = cut(_ambiguous(rows))
    clear = rows.join(unclear, "doc_id", "left_anti") if not unclear.isEmpty() else rows
    places = duplicate_places(clear, window, gram)
    names = [*rows.columns, "n_words", "n_removed", "kept", "kept_sha256"]

    def apply(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[], [], [], []]
            for text, at in zip(batch.column(1), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py()
                raw = (text or "").encode("utf-8", "surrogatepass")
                words = raw.split()
                kept, gone = words, 0
                if at.is_valid:
                    p = at.values.to_numpy()
                    edge = np.zeros(len(words) + 1, np.int64)
                    np.add.at(edge, p >> 10, 1)
                    np.add.at(edge, (p >> 10) + (p >> 2 & 0xFF) + window - 1, -1)
                    drop = (np.cumsum(edge)[:-1] > 0).tolist()
                    kept, gone = [w for w, d in zip(words, drop, strict=True) if not d], sum(drop)
                    parts, i, left = _PARTS.split(raw), 0, []
                    for k in range(0, len(parts), 2):
                        after = parts[k + 1 : k + 2]
                        if not parts[k]:
                            left += after
                            continue
                        if not drop[i]:
                            left += [parts[k], *after]
                        i += 1
                    text = b"".join(left).decode("utf-8", "surrogatepass")
                for c, v in zip(out, (len(words), gone, text, hashlib.sha256(b" ".join(kept)).hexdigest()), strict=True):
                    c.append(v)
            made = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.string()), pa.array(out[3], pa.string())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *made], names=names)

    joined = rows.join(places, "doc_id", "left")
    if not unclear.isEmpty():
        joined = joined.join(unclear.withColumn("unclear", F.lit(True)), "doc_id", "left").withColumn("places", F.when(F.col("unclear").isNull(), F.col("places"))).drop("unclear")
    kind = StructType(list(rows.schema.fields)).add("n_words", "long").add("n_removed", "long").add("kept", "string").add("kept_sha256", "string")
    return joined.select(*rows.columns, "places").mapInArrow(apply, kind)


def op7_substring_dedup(spark, sf_dir: str) -> DataFrame:
    return without_duplicates(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")
