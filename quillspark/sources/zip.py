"""ZIP packages as DataFrames: entries without inflating, contents with checks, and whole archives as a sink.

Files are found, listed and read by Spark's binaryFile source. Row code parses bytes only; what compares entries with each other is
done by DataFrame operations in zip_problems.
"""

from __future__ import annotations

import io
import struct
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.paths import ancestors, name_problem
from ..functions.text import composed

ENTRY = (
    "package_id string, entry_index long, path string, name_encoding string, is_directory boolean, method long, flags long, crc32 long, compressed_size long, "
    "uncompressed_size long, offset long, end long, directory_offset long, problem string"
)
_FIELDS = [f.strip().split(" ")[0] for f in ENTRY.split(",")]


def packages(spark: SparkSession, path: str) -> DataFrame:
    """(package_id, content) of every file under path; the id is the file's path."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("package_id"), "content")


def _name(raw: bytes, flags: int) -> tuple[str, str]:
    if flags & 0x800:
        return raw.decode("utf-8", "replace"), "utf8-flag"
    if raw.isascii():
        return raw.decode("ascii"), "ascii"
    try:
        return raw.decode("utf-8"), "utf8-guess"
    except UnicodeDecodeError:
        return raw.decode("cp437"), "cp437"


def _wide(extra: bytes, values: list[int]) -> list[int]:
    """values (size, packed size, offset) with the wide forms of the ZIP64 field in place of full ones."""
    at = 0
    while at + 4 <= len(extra):
        kind, size = struct.unpack_from("<HH", extra, at)
        if kind == 1:
            wide = iter(struct.unpack_from(f"<{size // 8}Q", extra, at + 4))
            return [next(wide, v) if v == 0xFFFFFFFF else v for v in values]
        at += 4 + size
    return values


def _end(raw: bytes) -> tuple[int, str | None]:
    """Where the end record stands: the last mark whose comment reaches exactly to the file's end."""
    least, seen, end = max(0, len(raw) - 22 - 65535), False, len(raw) - 18
    while (end := raw.rfind(b"PK\5\6", least, end)) >= 0:
        if end + 22 <= len(raw):
            seen = True
            if end + 22 + struct.unpack_from("<H", raw, end + 20)[0] == len(raw):
                return end, None
        end += 3
    return -1, "trailing-data" if seen else "truncated"


def _descriptor(raw: bytes, at: int, crc: int, packed: int, size: int) -> int:
    """The length of the data descriptor at a place, with or without its mark, with sizes of 32 or 64 bits; 0 if none tells these values."""
    for mark in (b"PK\7\x08", b""):
        for shape in ("<III", "<IQQ"):
            length = len(mark) + struct.calcsize(shape)
            if raw[at : at + len(mark)] == mark and at + length <= len(raw) and struct.unpack_from(shape, raw, at + len(mark)) == (crc, packed, size):
                return length
    return 0


def _directory(raw: bytes) -> Iterator[dict]:
    """Rows of the central directory; a row with a problem and nothing else if the archive can't be read."""
    if not raw.startswith((b"PK\3\4", b"PK\5\6")):
        yield {"problem": "not-a-zip"}
        return
    end, problem = _end(raw)
    if problem:
        yield {"problem": problem}
        return
    disk, start_disk, here, n, size, at, _ = struct.unpack_from("<4H2IH", raw, end + 4)
    if raw[end - 20 : end - 16] == b"PK\6\7":
        (record,) = struct.unpack_from("<Q", raw, end - 12)
        wide_here, wide_n, wide_size, wide_at = struct.unpack_from("<4Q", raw, record + 24)
        # What the classic record can hold must be the same in both.
        if raw[record : record + 4] != b"PK\6\6" or any(c not in (w, most) for c, w, most in ((here, wide_here, 0xFFFF), (n, wide_n, 0xFFFF), (size, wide_size, 0xFFFFFFFF), (at, wide_at, 0xFFFFFFFF))):
            yield {"problem": "zip64-differs"}
            return
        here, n, size, at = wide_here, wide_n, wide_size, wide_at
    if disk or start_disk or here != n:
        yield {"problem": "multi-volume"}
        return
    directory = at
    for i in range(n):
        if raw[at : at + 4] != b"PK\1\2" or at + 46 > len(raw):
            yield {"entry_index": i, "problem": "bad-directory"}
            return
        flags, method, _, _, crc, packed, size, n_name, n_extra, n_comment, _, _, outer, offset = struct.unpack_from("<4H3I5H2I", raw, at + 8)
        name, encoding = _name(raw[at + 46 : at + 46 + n_name], flags)
        size, packed, offset = _wide(raw[at + 46 + n_name : at + 46 + n_name + n_extra], [size, packed, offset])
        at += 46 + n_name + n_extra + n_comment
        row = {"entry_index": i, "path": name, "name_encoding": encoding, "is_directory": name.endswith("/"), "method": method, "flags": flags, "crc32": crc, "compressed_size": packed, "uncompressed_size": size, "offset": offset, "directory_offset": directory}
        if raw[offset : offset + 4] != b"PK\3\4":
            yield row | {"problem": "no-local-header"}
            continue
        l_flags, l_method, _, _, l_crc, l_packed, l_size, l_name, l_extra = struct.unpack_from("<HHHHIIIHH", raw, offset + 6)
        data = offset + 30 + l_name + l_extra
        stop = data + packed
        told = flags & 8 and _descriptor(raw, stop, crc, packed, size)
        stop += told or 0
        problem = None
        if flags & 1:
            problem = "encrypted"
        elif method not in (0, 8):
            problem = "unsupported-method"
        elif outer >> 28 == 0xA:
            problem = "symlink"
        elif l_flags != flags or l_method != method or raw[offset + 30 : offset + 30 + l_name] != raw[at - n_comment - n_extra - n_name : at - n_comment - n_extra]:
            problem = "local-header-differs"
        elif stop > directory:
            problem = "out-of-bounds"
        elif flags & 8 and not told:
            problem = "descriptor-differs"
        elif not flags & 8 and (l_crc != crc or l_packed not in (packed, 0xFFFFFFFF) or l_size not in (size, 0xFFFFFFFF)):
            problem = "local-header-differs"
        yield row | {"end": stop, "problem": problem}


def zip_entries(archives: DataFrame) -> DataFrame:
    """One row per entry of archives (package_id, content); an archive that can't be read gives one row with a problem."""

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string() if f in ("package_id", "path", "name_encoding", "problem") else pa.bool_() if f == "is_directory" else pa.int64() for f in _FIELDS]
        for batch in batches:
            for package, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                try:
                    found = list(_directory(raw.as_py() or b""))
                except struct.error:
                    found = [{"problem": "truncated"}]
                yield pa.RecordBatch.from_arrays([pa.array([package if f == "package_id" else r.get(f) for r in found], k) for f, k in zip(_FIELDS, kinds, strict=True)], names=_FIELDS)

    return archives.select("package_id", "content").mapInArrow(rows, ENTRY)


def zip_contents(archives: DataFrame, wanted: DataFrame, slice_bytes: int = 8 << 20) -> DataFrame:
    """(package_id, path, content, problem) of the wanted entries (rows of zip_entries): inflated, never past the declared size, size and CRC checked.

    A task holds about slice_bytes of contents, or one entry, at a time.
    """

    def table(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.binary(), pa.string()))], names=["package_id", "path", "content", "problem"])

    def rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for package, raw, entries in zip(*(batch.column(k) for k in range(3)), strict=True):
                package, raw = package.as_py(), raw.as_py()
                for e in entries.as_py():
                    n_name, n_extra = struct.unpack_from("<HH", raw, e["offset"] + 26)
                    at = e["offset"] + 30 + n_name + n_extra
                    data, problem = raw[at : at + e["compressed_size"]], None
                    if e["method"] == 8:
                        tool = zlib.decompressobj(-15)
                        try:
                            data = tool.decompress(data, e["uncompressed_size"] + 1)
                        except zlib.error:
                            data, problem = b"", "bad-data"
                    if problem is None and len(data) != e["uncompressed_size"]:
                        problem = "size-differs"
                    elif problem is None and zlib.crc32(data) != e["crc32"]:
                        problem = "crc-differs"
                    out.append((package, e["path"], None if problem else data, problem))
                    held += len(data)
                    if held >= slice_bytes or len(out) >= 10_000:
                        yield table(out)
                        out, held = [], 0
            if out:
                yield table(out)

    lists = wanted.filter("NOT is_directory AND problem IS NULL").groupBy("package_id").agg(F.array_sort(F.collect_list(F.struct("offset", "path", "method", "compressed_size", "uncompressed_size", "crc32"))).alias("entries"))
    return archives.select("package_id", "content").join(lists, "package_id").mapInArrow(rows, "package_id string, path string, content binary, problem string")


def zip_problems(entries: DataFrame, most_entries: int = 50_000, most_bytes: int = 32 << 30, most_ratio: int = 1000) -> DataFrame:
    """(package_id, path, problem): everything that bars a package or deserves a warning, found by comparing its entries.

    The entries are read for each of four comparisons: settle them first where they are costly.
    """
    e = entries.filter("path IS NOT NULL")
    say = lambda df, what: df.select("package_id", "path", F.lit(what).alias("problem"))
    path = F.regexp_replace("path", "/$", "")
    keyed = e.withColumns({"bare": path, "nfc": composed(path)}).withColumn("lower", F.lower("nfc"))
    later = lambda key: F.row_number().over(Window.partitionBy("package_id", key).orderBy("entry_index")) > 1
    same = keyed.withColumns({"d": later("bare"), "u": later("nfc"), "c": later("lower")})
    twice = F.when(F.col("d"), "duplicate-name").when(F.col("u"), "same-after-composition").when(F.col("c"), "same-but-for-case")
    files = keyed.filter("NOT is_directory").select("package_id", F.concat("bare", F.lit("/")).alias("above"))
    inside = e.select("package_id", "path", F.explode(ancestors(path)).alias("above")).join(files, ["package_id", "above"], "left_semi")
    by_offset = Window.partitionBy("package_id").orderBy("offset")
    by_index = Window.partitionBy("package_id").orderBy("entry_index")
    placed = e.withColumns({"before": F.lag("end", 1, 0).over(by_offset), "total": F.sum("uncompressed_size").over(by_index.rowsBetween(Window.unboundedPreceding, 0)), "k": F.row_number().over(by_index)})
    every = lambda df, *found: df.select("package_id", "path", F.explode(F.array_compact(F.array(*found))).alias("problem"))
    ratio = (F.col("uncompressed_size") > 1 << 20) & (F.col("uncompressed_size") > most_ratio * F.col("compressed_size"))
    parts = [
        every(entries, "problem", F.when(F.col("path").isNotNull(), name_problem(path)), F.when(F.col("path").isNotNull() & ratio, "ratio")),
        every(same, twice), say(inside, "inside-a-file"),
        every(placed, F.when(F.col("offset") < F.col("before"), "overlap").when(F.col("offset") > F.col("before"), "gap"), F.when(F.col("k") > most_entries, "too-many-entries"), F.when(F.col("total") > most_bytes, "too-large")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def detect_packages(entries: DataFrame) -> DataFrame:
    """(package_id, kind): the first rule that fits."""
    has = lambda test: F.bool_or(F.coalesce(test, F.lit(False)))
    p = F.col("path")
    flags = entries.groupBy("package_id").agg(
        has(p == "content.xml").alias("content"), has(p == "contentv3.xml").alias("legacy"), has(p == "META-INF/container.xml").alias("epub"),
        has(F.lower(p).rlike("\\.(elpx|elp)$")).alias("nested"), has(p.rlike("^[^/]+/content\\.xml$")).alias("wrapped"), has(p == "index.html").alias("html"),
    )
    kind = F.when(F.col("content"), "elpx").when(F.col("legacy"), "legacy-elp").when(F.col("epub"), "epub").when(F.col("nested"), "nested").when(F.col("wrapped"), "wrapped").when(F.col("html"), "html-export")
    return flags.select("package_id", kind.otherwise("unknown-zip").alias("kind"))


def packed(files: DataFrame) -> DataFrame:
    """files (package_id, entry_index, path, content) as one archive per package: (package_id, content). Entries keep their order; texts are deflated."""

    def build(group: pa.Table) -> pa.Table:
        group, buffer = group.sort_by("entry_index"), io.BytesIO()
        with zipfile.ZipFile(buffer, "w") as out:
            for path, content in zip(group.column("path").to_pylist(), group.column("content").to_pylist(), strict=True):
                info = zipfile.ZipInfo(path, (2026, 1, 15, 10, 0, 0))
                info.compress_type = zipfile.ZIP_STORED if path.lower().endswith((".png", ".jpg", ".mp3", ".mp4", ".zip")) else zipfile.ZIP_DEFLATED
                out.writestr(info, content or b"", compresslevel=6)
        return pa.table({"package_id": group.column("package_id").slice(0, 1), "content": pa.array([buffer.getvalue()], pa.binary())})

    rows = files.select("package_id", F.col("entry_index").cast("long").alias("entry_index"), "path", F.col("content").cast("binary").alias("content"))
    return rows.groupBy("package_id").applyInArrow(build, "package_id string, content binary")
