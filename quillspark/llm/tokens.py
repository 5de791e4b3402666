"""Token ids: encoding with a public tokenizer, id files, and packing into sequences."""

from __future__ import annotations

import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, qualified, scratch

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: White space of any kind, as a class of Arrow's regular expressions, and the same but for the line feed.
_SPACE, _NO_FEED = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}]", r"[\t\x0b-\r \x1c-\x1f\x{85}\p{Z}]"
#: Runs of white space that don't part before each of their spaces and line feeds.
_RUNS = rf"{_SPACE} (?:{_SPACE}|$)|{_NO_FEED}\n|\n(?:{_NO_FEED}|\n\n|\n$)"
#: A word's letters and digits, and the marks that follow: the tokenizer parts there.
_CLOSED = r"(?s)^(?P<stem>.*[0-9A-Za-zÀ-ÖØ-öø-ʯ])(?P<marks>[!-&(-/:-@\[-`{-~]+)$"


class Encoder:
    """Whole texts to the ids that the tokenizer gives them.

    A byte-level tokenizer parts a text before every space and line feed between words, so what follows one is a unit, and of the texts of a
    call each distinct unit is encoded once. Nothing is remembered between calls. Texts with other runs of white space, texts that hold the
    content of an added token (it becomes that token's id, as the library has it by default), and all texts of other
    tokenizers, are encoded directly.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        size = self.tokenizer.get_vocab_size()
        self.dtype = np.dtype("<u2" if size <= 1 << 16 else "<u4")
        with open(path) as f:
            made = json.load(f)
        self.added = [a["content"] for a in made.get("added_tokens") or []]
        parts = made.get("pre_tokenizer") or {}
        self.by_unit = parts.get("type") == "ByteLevel" and parts.get("use_regex", True) and not parts.get("add_prefix_space") and not made.get("normalizer")
        # An added token without white space lies inside one unit, or before the first.
        self.by_unit = self.by_unit and not any(re.search(r"\s", a) for a in self.added)
        self.opens = [np.array([(self.tokenizer.id_to_token(i) or "").startswith(c) for i in range(size)]) for c in "ĠĊ"]

    def _direct(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Their ids in a row, and how many each has."""
        ids = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        sizes = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), self.dtype, int(sizes.sum())), sizes

    def _following(self, units: pa.Array, kind: int, some: int = 256) -> tuple[np.ndarray, np.ndarray]:
        """The same of units that follow a space (kind 0) or a line feed (kind 1); some are encoded at a time, and parted where an id opens with that."""
        import pyarrow.compute as pc

        odd = pc.match_substring_regex(units, rf"^$|^{_SPACE}|{_SPACE}$").to_numpy(zero_copy_only=False)
        order, n_plain = np.argsort(odd, kind="stable"), len(units) - int(odd.sum())
        before, names = " \n"[kind], (units.take(pa.array(order)) if n_plain < len(units) else units).to_pylist()
        parts = [names[i : min(i + some, n_plain)] for i in range(0, n_plain, some)]
        ids, sizes = [], []
        for k in range(0, len(parts), 64):
            for part, e in zip(parts[k : k + 64], self.tokenizer.encode_batch_fast([before + before.join(p) for p in parts[k : k + 64]], add_special_tokens=False), strict=True):
                own = np.array(e.ids, self.dtype)
                cuts = np.flatnonzero(self.opens[kind][own])
                if len(cuts) != len(part) or cuts[0]:
                    own, lengths = self._direct([before + n for n in part])
                else:
                    lengths = np.diff(np.append(cuts, len(own)))
                ids.append(own), sizes.append(lengths)
        own, lengths = self._direct([before + n for n in names[n_plain:]])
        sizes = np.concatenate([*sizes, lengths])
        back = np.argsort(order)
        return _taken(np.concatenate([*ids, own]), sizes, back), sizes[back]

    def _units(self, units: pa.Array, kind: int) -> tuple[np.ndarray, np.ndarray]:
        """The same of distinct units; a word with marks after it is put together from both, so that it is encoded once for all that follows it."""
        import pyarrow.compute as pc

        closed = pc.extract_regex(units, _CLOSED)
        stems = pc.if_else(closed.is_valid(), closed.field("stem"), units).dictionary_encode()
        marks = pc.if_else(closed.is_valid(), closed.field("marks"), "").dictionary_encode()
        (ids, sizes), (more, lengths) = self._following(stems.dictionary, kind), self._direct(marks.dictionary.to_pylist())
        both = np.column_stack((stems.indices.to_numpy(), marks.indices.to_numpy().astype(np.int64) + len(sizes))).reshape(-1)
        sizes = np.concatenate((sizes, lengths))
        return _taken(np.concatenate((ids, more)), sizes, both), sizes[both].reshape(-1, 2).sum(axis=1)

    def encode(self, texts: pa.Array, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in a row, and how many each has; end_id, if given, follows each text. A null text is empty."""
        import pyarrow.compute as pc

        texts, n = pc.fill_null(texts, ""), len(texts)
        direct = np.ones(n, bool)
        if self.by_unit:
            tests = [pc.match_substring_regex(texts, _RUNS), *(pc.match_substring(texts, a) for a in self.added)]
            direct = np.logical_or.reduce([t.to_numpy(zero_copy_only=False) for t in tests])
        lines = pc.split_pattern(pc.if_else(pa.array(direct), "", texts), "\n")
        units = pc.split_pattern(lines.flatten(), " ")
        of_line, of_text = (a.offsets.to_numpy().astype(np.int64) - a.offsets[0].as_py() for a in (units, lines))
        coded = units.flatten().dictionary_encode()
        # A code is twice a unit's number, one more after a line feed; codes from heads on stand for the texts' first units, or for whole texts.
        heads, first = 2 * len(coded.dictionary), of_line[of_text[:-1]]
        code = coded.indices.to_numpy().astype(np.int64) * 2
        opening = coded.dictionary.take(pa.array(code[first] >> 1))
        code[of_line[:-1]] += 1
        code[first] = heads + np.arange(n)
        used = np.bincount(code, minlength=heads + n) > 0
        sizes, held, after = np.zeros(heads + n + 1, np.int64), [], 0
        for kind in (0, 1):
            at = np.flatnonzero(used[kind:heads:2])
            ids, lengths = self._units(coded.dictionary.take(pa.array(at)), kind)
            held.append(ids)
            sizes[2 * at + kind] = lengths
        ids, lengths = self._direct(pc.if_else(pa.array(direct), texts, opening).to_pylist())
        sizes[heads : heads + n] = lengths
        starts = np.zeros(heads + n + 1, np.int64)
        for kind in (0, 1):
            own = sizes[kind:heads:2]
            starts[kind:heads:2] = after + np.cumsum(own) - own
            after += len(held[kind])
        starts[heads : heads + n] = after + np.cumsum(lengths) - lengths
        held.append(ids)
        of_code = of_line[of_text]
        if end_id is not None:
            starts[-1], sizes[-1] = after + len(ids), 1
            held.append(np.array([end_id], self.dtype))
            code = np.insert(code, of_code[1:], heads + n)
            of_code = of_code + np.arange(n + 1)
        size = sizes[code]
        ends = np.append(0, np.cumsum(size))
        return np.concatenate(held)[np.repeat(starts[code] - ends[:-1], size) + np.arange(ends[-1])], np.diff(ends[of_code])


def _taken(flat: np.ndarray, sizes: np.ndarray, order: np.ndarray) -> np.ndarray:
    """flat holds runs of these sizes; the runs that order names, one after the other."""
    size = sizes[order]
    ends = np.append(0, np.cumsum(size))
    return flat[np.repeat((np.cumsum(sizes) - sizes)[order] - ends[:-1], size) + np.arange(ends[-1])]


def encoded(batches: Iterable[pa.RecordBatch], path: str, end_id: int, some_chars: int = 8_000_000) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """(doc_ids, ids in a row, ids of each) for groups of rows of about some_chars characters; a null text is empty, and end_id follows each text."""
    import pyarrow.compute as pc

    coder = Encoder(path)
    for batch in batches:
        chars = np.cumsum(pc.fill_null(pc.utf8_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            end = max(start + 1, int(np.searchsorted(chars, (chars[start - 1] if start else 0) + some_chars, "right")))
            yield batch.column(0).slice(start, end - start).cast(pa.int64()), *coder.encode(batch.column(1).slice(start, end - start), end_id)
            start = end
        pa.default_memory_pool().release_unused()


# -- id files: frequency ranks in byte-aligned variable length, with separate control bytes

_MAGIC = b"QTK1"
_LENGTHS = np.array([[(c >> 2 * k & 3) + 1 for k in range(4)] for c in range(256)], np.uint8)
_PLACES = np.arange(4, dtype=np.uint8)


def pack_file(doc_ids: list, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    """One file: counts, the ids by falling frequency, doc_ids with a null flag, lengths, control bytes, data bytes.

    An id is stored as its rank in one to four bytes, least first; a control byte holds the byte counts of four ids.
    """
    counts = np.bincount(ids) if len(ids) else np.zeros(0, np.int64)
    used = np.flatnonzero(counts)
    ranked = used[np.argsort(-counts[used], kind="stable")].astype("<u4")
    rank = np.zeros(len(counts), "<u4")
    rank[ranked] = np.arange(len(ranked), dtype="<u4")
    r = rank[ids]
    extra = (r > 0xFF).astype(np.uint8) + (r > 0xFFFF) + (r > 0xFFFFFF)
    padded = np.zeros(-(-len(r) // 4) * 4, np.uint8)
    padded[: len(r)] = extra
    quads = padded.reshape(-1, 4)
    control = quads[:, 0] | quads[:, 1] << 2 | quads[:, 2] << 4 | quads[:, 3] << 6
    data = r.view(np.uint8).reshape(-1, 4)[_PLACES <= extra[:, None]]
    head = np.array([len(doc_ids), len(ids), len(ranked)], "<u8").tobytes()
    named = np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
    null = np.array([d is None for d in doc_ids], np.uint8).tobytes()
    return b"".join((_MAGIC, head, ranked.tobytes(), named, null, np.asarray(lengths, "<u8").tobytes(), control.tobytes(), data.tobytes()))


def unpack_file(raw: bytes) -> tuple[list, np.ndarray, np.ndarray]:
    """doc_ids, lengths and ids of a file; the control bytes look up how many bytes each id takes."""
    if raw[:4] != _MAGIC:
        raise ValueError("not an id file")
    n_docs, n_ids, n_ranked = (int(x) for x in np.frombuffer(raw, "<u8", 3, 4))
    at = 28

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(raw, kind, n, at)
        at += out.nbytes
        return out

    ranked, named, null, lengths = take("<u4", n_ranked), take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    size = _LENGTHS[take("u1", -(-n_ids // 4))].reshape(-1)[:n_ids]
    rank = np.zeros((n_ids, 4), np.uint8)
    rank[size[:, None] > _PLACES] = take("u1", int(size.sum()))
    return [None if x else d for d, x in zip(named.tolist(), null.tolist(), strict=True)], lengths, ranked[rank.view("<u4").reshape(-1)]


FILES = "task long, k long, name string, n_docs long, n_ids long"


def write_ids(docs: DataFrame, folder: str, path: str, end_id: int, file_ids: int = 4_000_000) -> DataFrame:
    """Writes the ids of docs (doc_id, text) in ascending doc_id order to files of about file_ids ids, and their manifest, which is returned.

    Null ids come first; rows that share an id stay side by side. A null text is empty; end_id follows each text. A
    document lies in one file. Files have names of their own for each attempt, and only those of the attempts that
    counted are in the manifest, a Parquet table beside them: name, n_docs, n_ids, start (ids in all files before). folder must be open to
    the executors through pyarrow's file systems. An empty table gives no file.
    """

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(folder)
        task, held, k = TaskContext.get().partitionId(), [], 0

        def flush() -> pa.RecordBatch:
            nonlocal k
            name = f"ids-{task:06d}-{k:05d}-{uuid.uuid4().hex}.qtk"
            doc_ids, ids, sizes = ([h[i] for h in held] for i in range(3))
            ids, sizes = np.concatenate(ids), np.concatenate(sizes)
            with files.open_output_stream(f"{place}/{name}") as out:
                out.write(pack_file([d for a in doc_ids for d in a.to_pylist()], sizes, ids))
            k += 1
            held.clear()
            return pa.RecordBatch.from_pydict({"task": [task], "k": [k], "name": [name], "n_docs": [len(sizes)], "n_ids": [len(ids)]})

        total = 0
        for doc_ids, ids, sizes in encoded(batches, path, end_id):
            ends, start = np.append(0, np.cumsum(sizes)), 0
            while start < len(sizes):  # up to the document that fills the file
                end = min(len(sizes), int(np.searchsorted(ends, ends[start] + file_ids - total)))
                held.append((doc_ids.slice(start, end - start), ids[ends[start] : ends[end]], sizes[start:end]))
                total, start = total + int(ends[end] - ends[start]), end
                if total >= file_ids:
                    yield flush()
                    total = 0
        if held:
            yield flush()

    from pyarrow import fs

    files, place = fs.FileSystem.from_uri(folder)
    files.create_dir(place, recursive=True)
    ordered = docs.select("doc_id", "text").repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    written = cut(ordered.mapInArrow(write, FILES)).withColumn("block", F.expr("task DIV 1000"))
    # Prefix sums in two levels: over blocks of tasks, and in each block over its files.
    blocks = written.groupBy("block").agg(F.sum("n_ids").alias("n"))
    blocks = blocks.select("block", (F.sum("n").over(Window.orderBy("block")) - F.col("n")).alias("base"))
    own = F.sum("n_ids").over(Window.partitionBy("block").orderBy("task", "k")) - F.col("n_ids")
    manifest = written.withColumn("own", own).join(F.broadcast(blocks), "block")  # a row for each thousand tasks
    manifest.select("name", "n_docs", "n_ids", (F.col("base") + F.col("own")).alias("start")).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.parquet(f"{folder}/manifest")


def read_ids(folder: str, manifest: DataFrame) -> DataFrame:
    """One row per document of the manifest's files: doc_id, start, n_tokens, ids_crc32. A file that is missing or holds other numbers is an error."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, place = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for m in batch.to_pylist():
                with files.open_input_file(f"{place}/{m['name']}") as f:
                    doc_ids, lengths, ids = unpack_file(f.read())
                if (len(doc_ids), len(ids)) != (m["n_docs"], m["n_ids"]):
                    raise ValueError(f"{m['name']} isn't the file that the manifest names")
                ends = np.cumsum(lengths.astype(np.int64))
                first, view = ends - lengths.astype(np.int64), memoryview(ids.astype("<u4").tobytes())
                crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(first.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_pydict({"doc_id": pa.array(doc_ids, pa.int64()), "start": pa.array(first + m["start"]), "n_tokens": pa.array(ends - first), "ids_crc32": pa.array(crc, pa.int64())})

    dealt = manifest.repartition(min(max(manifest.count(), 1), 100_000))  # a task for each file, as far as that goes
    return dealt.select("name", "n_docs", "n_ids", "start").mapInArrow(rows, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op3_token_ids(spark, sf_dir: str) -> DataFrame:
    folder = qualified(spark, scratch(spark, "ids"))
    return read_ids(folder, write_ids(documents(spark, sf_dir), folder, tokenizer_path(), end_id=2))


# -- packing: concatenate and cut


def pack(docs: DataFrame, path: str, end_id: int, length: int = 2048) -> DataFrame:
    """Pieces of the documents (doc_id, text) in sequences of length ids: all ids in a row, cut at every length-th.

    First pass: each partition's ids, with places from the partition's start, and the partition's total. The totals' prefix
    sums give every document its place in the whole row of ids; no row moves. Second pass: a piece for each
    sequence that a document reaches into, so a sequence across partitions gets its pieces from each. Only the last
    sequence is short. A null or empty text is end_id alone. Rows that share an id, or have none, are documents of their
    own. Columns: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids (binary, unsigned 32 bits).
    """

    def first(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, place = TaskContext.get().partitionId(), 0
        for doc_ids, ids, sizes in encoded(batches, path, end_id):
            n, ends = len(sizes), np.append(0, np.cumsum(sizes))
            raw = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((ends * ids.itemsize).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_pydict({"part": pa.array(np.full(n, part, np.int64)), "place": pa.array(place + ends[:-1]), "doc_id": doc_ids, "n": pa.array(sizes), "width": pa.array(np.full(n, ids.itemsize, np.int32)), "ids": raw})
            place += len(ids)

    placed = cut(docs.select("doc_id", "text").mapInArrow(first, "part long, place long, doc_id long, n long, width int, ids binary"))
    base, bases = 0, {}
    for part, total in sorted(placed.groupBy("part").agg(F.sum("n")).collect()):  # a row for each partition
        bases[part] = base
        base += total

    def second(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids")}
            part, place, doc_ids, n, width = (batch.column(i).to_pylist() for i in range(5))
            for i in range(batch.num_rows):
                ids = np.frombuffer(batch.column(5)[i].as_buffer(), f"<u{width[i]}").astype("<u4").tobytes()
                at, start = bases[part[i]] + place[i], 0
                while start < n[i]:
                    size = min(length - at % length, n[i] - start)
                    piece = ids[4 * start : 4 * (start + size)]
                    for k, v in zip(out, (doc_ids[i], start, size, zlib.crc32(piece), n[i], at // length, at % length, piece), strict=True):
                        out[k].append(v)
                    at, start = at + size, start + size
            yield pa.RecordBatch.from_pydict({k: pa.array(v, pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()})

    return placed.mapInArrow(second, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary")


PIECE = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_packing(spark, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path(), end_id=1).select(*PIECE)
