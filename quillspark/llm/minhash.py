"""MinHash near-dedup: banded candidates, sequential Bayesian pruning on the signatures, exact check on the whole sets.

1. One pass over the texts gives each row its set's size, fingerprint and signature. Rows of equal sets are one class from then on.
2. The classes' bands make buckets. In rounds, each bucket names one member, the members of other components are paired with it, and of
   the pairs that the signatures leave a document's likeliest is checked on the whole sets. Links make components, and
   a bucket whose members are in one component is done.
3. In buckets whose members are still in different components, the members outside of the bucket's largest component are
   held against all its members, so no link is lost that a bucket could show. Small buckets do this in a join; large ones in
   blocks of bounded size, where 16 bits of each shingle give an upper bound of the similarity, and only pairs that reach it leave the task.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, documents, release

#: Up to so many ids are broadcast (16 bytes each); beyond it they are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Buckets up to SMALL members are joined with themselves; larger ones are dealt in blocks of BLOCK members.
SMALL, BLOCK = 8, 512
#: Edges of a task while components are found.
EDGES_A_TASK = 100_000
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, remembered up to a bound."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(self) < 500_000:
            self[word] = out
        return out


def word_hashes(words: list[bytes], known: WordHashes) -> np.ndarray:
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def rolled(h: np.ndarray, width: int) -> np.ndarray:
    """A hash for each run of width words."""
    n = len(h) - width + 1
    out = np.zeros(max(n, 0), np.uint64)
    if n > 0:
        for k in range(width):
            out = out * _M1 + h[k : k + n]
        out = mixed(out + np.uint64(width))
    return out


def shingles(text: str | None, width: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct hashes of a text's word shingles; A-Z in lower case, ASCII white space between words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    return np.unique(rolled(word_hashes(words, known), min(width, len(words))))


def _fingerprint(s: np.ndarray) -> tuple[int, int]:
    import xxhash

    both = np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8")
    return int(both[0]), int(both[1])


def signature(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    high, out = (s >> np.uint64(32)).astype(np.uint32), np.full(len(a), 0xFFFFFFFF, np.uint32)
    for i in range(0, len(high), 256):
        np.minimum(out, (high[i : i + 256, None] * a + b).min(axis=0), out=out)
    return out.astype(np.uint16)


def _permutations(n: int) -> tuple[np.ndarray, np.ndarray]:
    r = np.random.default_rng(20)
    return r.integers(0, 1 << 32, n, np.uint32) | np.uint32(1), r.integers(0, 1 << 32, n, np.uint32)


def least_matches(n: int, similarity: float, miss: float) -> int:
    """The fewest of n equal signature values at which similarity or more keeps a posterior probability over miss.

    With a uniform prior the posterior after m of n is Beta(m + 1, n - m + 1), and its mass above t is the chance of at most m
    successes in n + 1 trials of chance t.
    """
    below = 0.0
    for m in range(n + 1):
        below += math.comb(n + 1, m) * similarity**m * (1 - similarity) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def least_bits(n: int, similarity: float, miss: float) -> int:
    """The fewest of n equal bits, one of each signature value, that pairs of this similarity or more fall under with a chance of at most miss."""
    equal, below = (1 + similarity) / 2, 0.0
    for m in range(n + 1):
        below += math.comb(n, m) * equal**m * (1 - equal) ** (n - m)
        if below > miss:
            return m
    return n


def components(edges: DataFrame) -> DataFrame:
    """(id, component: least id reachable) for every end of edges (a, b); rounds of large-star and small-star.

    Each round shuffles the edges by key with the minima pre-aggregated; no list of neighbours is ever gathered.
    """
    spark, e = edges.sparkSession, cut(edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        now = e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        if now == state or not now[0]:
            break
        state = now
        few = lambda df: df.coalesce(-(-state[0] // EDGES_A_TASK))  # noqa: B023, E731
        both = few(e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        least = few(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = cut(few(few(both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))).distinct()))
        small = few(large.groupBy("u").agg(F.min("v").alias("m")))
        joined = few(large.join(small, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.*").filter("u <> v"))
        e = cut(few(joined.distinct()))
        release(spark)
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())


def _small(df: DataFrame) -> DataFrame:
    return F.broadcast(df) if df.count() <= BROADCAST_IDS else df


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, bands: int = 40, rows: int = 6, rounds: int = 2, miss: float = 1e-6) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_shingles, component_id, kept.

    Documents are linked when 100 * common >= percent * all of their distinct shingles of width words; a shorter text is one
    shingle. bands and rows set the chance that a linked pair shares no bucket ((1 - s**rows)**bands, 5e-6 at
    80 %), miss the chance that the signatures of a linked pair are pruned. A null, empty or blank text has no shingles and is linked with
    nothing. Rows that share a doc_id are one document: of differing texts the one with the least fingerprint links it, and every row gets its
    component. A row without doc_id is linked with nothing, and kept. Other columns are not read.
    """
    docs, size = docs.select("doc_id", "text"), bands * rows
    a, b = _permutations(size)
    spare = np.zeros(-size % 64, np.uint8)
    b_names = [f"b{k}" for k in range(-(-size // 64))]

    def sketch(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            n, one, two, sig, bits = [], [], [], [], []
            for text in batch.column(1):
                s = shingles(text.as_py(), width, known)
                x, y = _fingerprint(s)
                n.append(len(s)), one.append(x), two.append(y), sig.append(signature(s, a, b))
                bits.append(np.packbits(np.append(sig[-1] & 1, spare)).view("<i8"))
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(n, pa.int64()), pa.array(one, pa.int64()), pa.array(two, pa.int64()), pa.array([x.tobytes() for x in sig], pa.binary()), *(pa.array([x[k] for x in bits], pa.int64()) for k in range(len(b_names)))], names=["doc_id", "n", "f1", "f2", "sig", *b_names])

    sketches = cut(docs.mapInArrow(sketch, "doc_id long, n long, f1 long, f2 long, sig binary, " + ", ".join(f"{x} long" for x in b_names)))
    one = sketches.filter("doc_id IS NOT NULL AND n > 0").groupBy("doc_id").agg(F.min(F.struct("f1", "f2", "n")).alias("f")).select("doc_id", "f.*")
    classes = cut(one.groupBy("f1", "f2", "n").agg(F.min("doc_id").alias("id")))
    repeated = sketches.filter("doc_id IS NOT NULL AND n > 0").count() > one.count()
    once = lambda df: df.dropDuplicates(["id"]) if repeated else df
    own = classes.select("id", F.col("f1").alias("g1"), F.col("f2").alias("g2"))
    signed = sketches.withColumnRenamed("doc_id", "id").join(own, "id").filter("f1 = g1 AND f2 = g2")
    signed = cut(once(signed.select("id", "n", "sig", *b_names)))

    def banded(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = np.frombuffer(b"".join(batch.column(2).to_pylist()), "<u2").reshape(-1, bands, rows).astype(np.uint64)
            h = np.broadcast_to(np.arange(bands, dtype=np.uint64), sig.shape[:2]).copy()
            for k in range(rows):
                h = mixed(h * _M1 + sig[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(h.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column(0).to_numpy(), bands)), pa.array(np.repeat(batch.column(1).to_numpy(), bands))], names=["bucket", "id", "n"])

    entries = signed.select("id", "n", "sig").mapInArrow(banded, "bucket long, id long, n long")
    several = entries.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    shared = cut(entries.join(several, "bucket"))
    members = cut(shared.select("id").distinct().join(classes, "id"))

    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            keep, sets = [], []
            for i, (text, x, y) in enumerate(zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
                s = shingles(text.as_py(), width, known)
                if _fingerprint(s) == (x, y):
                    keep.append(i), sets.append(s.tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keep, pa.int64())), pa.array(sets, pa.binary())], names=["id", "shingles"])

    texts = docs.withColumnRenamed("doc_id", "id").join(_small(members.select("id", "f1", "f2")), "id").select("id", "text", "f1", "f2")
    sets = cut(once(texts.mapInArrow(whole, "id long, shingles binary"))) if members.count() else None
    release(docs.sparkSession)
    steps = [(n, least_matches(n, percent / 100, miss)) for n in range(32, size + 1, 32)]

    def likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), "<u2").reshape(-1, size) for i in (2, 3))
            alive, equal, before = np.arange(batch.num_rows), np.zeros(batch.num_rows, np.int64), 0
            for n, least in steps:  # a batch of signature values at a time, for the pairs still alive
                equal[alive] += (x[alive, before:n] == y[alive, before:n]).sum(axis=1)
                alive, before = alive[equal[alive] >= least], n
            yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(alive)) for i in (0, 1)), pa.array(equal[alive])], names=["a", "b", "equal"])

    def exact(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for i, (x, y) in enumerate(zip(batch.column(2), batch.column(3), strict=True)):
                x, y = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                both = len(x) + len(y) - len(np.unique(np.concatenate((x, y))))
                if 100 * both >= percent * (len(x) + len(y) - both):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([batch.column(i).take(pa.array(keep, pa.int64())) for i in (0, 1)], names=["a", "b"])

    def side(df: DataFrame, pairs: DataFrame, name: str, value: str) -> DataFrame:
        """What df holds of the ids at one side of pairs; only that is shuffled, while the ids are few enough to be sent to every task."""
        ids = pairs.select(F.col(name).alias("id")).distinct()
        some = df.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= BROADCAST_IDS else df
        return some.select(F.col("id").alias(name), F.col(value).alias(f"{value}_{name}"))

    def pruned(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that the signatures leave, with the number of equal values."""
        both = pairs.join(side(signed, pairs, "a", "sig"), "a").join(side(signed, pairs, "b", "sig"), "b")
        return both.select("a", "b", "sig_a", "sig_b").mapInArrow(likely, "a long, b long, equal long")

    def linked(pairs: DataFrame) -> DataFrame:
        """Of pairs (a, b), those that are linked."""
        both = pairs.select("a", "b").join(side(sets, pairs, "b", "shingles"), "b").join(side(sets, pairs, "a", "shingles"), "a")
        return cut(both.select("a", "b", "shingles_a", "shingles_b").mapInArrow(exact, "a long, b long"))

    def open_buckets(part: DataFrame | None) -> DataFrame:
        """The entries of the buckets whose members are in several components."""
        if part is None:
            return shared.withColumn("component", F.col("id"))
        known = shared.join(part, "id", "left").withColumn("component", F.coalesce("component", "id"))
        several = known.groupBy("bucket").agg(F.min("component").alias("x"), F.max("component").alias("y")).filter("x < y").select("bucket")
        return cut(known.join(several, "bucket"))

    sizes = lambda x, y: 100 * F.least(x, y) >= percent * F.greatest(x, y)
    part, links, tested = None, None, None
    for k in range(rounds if sets is not None else 0):
        left = open_buckets(part)
        leads = left.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "component")).alias("lead"))
        pairs = left.join(leads, "bucket").filter((F.col("component") != F.col("lead.component")) & sizes("n", "lead.n"))
        pairs = pairs.select(F.least("id", "lead.id").alias("a"), F.greatest("id", "lead.id").alias("b"), F.col("id").alias("of")).distinct()
        few = Window.partitionBy("of").orderBy(F.xxhash64("a", "b"))
        pairs = pairs.withColumn("k", F.row_number().over(few)).filter("k <= 4").select("a", "b", "of")
        if tested is not None:
            pairs = pairs.join(tested, ["a", "b"], "left_anti")
        pairs = cut(pairs)
        best = Window.partitionBy("of").orderBy(F.desc("equal"), "a", "b")
        best = pruned(cut(pairs.select("a", "b").distinct())).join(pairs, ["a", "b"]).withColumn("k", F.row_number().over(best)).filter("k = 1")
        now = cut(best.select("a", "b").distinct())
        if now.isEmpty():
            break
        tested = now if tested is None else tested.unionByName(now)
        found = linked(now)
        release(docs.sparkSession)
        links = found if links is None else links.unionByName(found)
        part = components(links)
    def short(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(np.frombuffer(x.as_buffer(), "<u8") >> np.uint64(48)).astype("<u2").tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.binary())], names=["id", "short"])

    def reaching(block: pa.Table) -> pa.Table:
        """Pairs of a query and a row of one block, of different components, that may be similar enough."""
        ids, n, part_of = (block.column(c).to_numpy() for c in ("id", "n", "component"))
        asks = block.column("asks").to_numpy(zero_copy_only=False)
        parts = [np.frombuffer(x.as_buffer(), "<u2") for x in block.column("short")]
        rows_at, a_out, b_out = np.flatnonzero(~asks), [], []
        if len(rows_at):
            flat = np.concatenate([parts[i] for i in rows_at])
            starts = np.cumsum([0, *(len(parts[i]) for i in rows_at[:-1])])
            own, has = n[rows_at], np.zeros(1 << 16, np.int32)
            for q in np.flatnonzero(asks):
                has[parts[q]] = 1
                common = np.minimum(np.add.reduceat(has[flat], starts), n[q])
                has[parts[q]] = 0
                hit = (100 * common >= percent * (own + n[q] - common)) & (part_of[rows_at] != part_of[q])
                b_out += ids[rows_at[hit]].tolist()
                a_out += [int(ids[q])] * int(hit.sum())
        return pa.table({"a": pa.array(a_out, pa.int64()), "b": pa.array(b_out, pa.int64())})

    if sets is not None:
        left = open_buckets(part)
        largest = left.groupBy("bucket", "component").agg(F.count("*").alias("c")).groupBy("bucket").agg(F.sum("c").alias("m"), F.max(F.struct("c", "component")).alias("main"))
        left = cut(left.join(largest.select("bucket", "m", F.col("main.component").alias("main"), (F.col("m") - F.col("main.c")).alias("q")), "bucket"))
        few = left.filter(F.col("m") <= SMALL).join(signed.select("id", *b_names), "id")
        l, r = few.alias("l"), few.alias("r")
        bits = sum((F.bit_count(F.col(f"l.{x}").bitwiseXOR(F.col(f"r.{x}"))) for x in b_names), F.lit(0))
        fits = (F.col("l.bucket") == F.col("r.bucket")) & (F.col("l.component") != F.col("r.component")) & (F.col("l.id") < F.col("r.id"))
        fits = fits & sizes("l.n", "r.n") & (bits <= size - least_bits(size, percent / 100, miss))
        joined = l.join(r, fits).select(F.col("l.id").alias("a"), F.col("r.id").alias("b"))
        many = left.filter(F.col("m") > SMALL).join(sets.select("id", "shingles").mapInArrow(short, "id long, short binary"), "id")
        deal = lambda count: F.ceil(F.col(count) / BLOCK).cast("int")
        block = lambda count: F.pmod(F.xxhash64("id"), deal(count)).cast("int")
        each = lambda count: F.explode(F.sequence(F.lit(0), deal(count) - 1))
        base = ("bucket", "id", "n", "component", "short")
        dealt = many.select(*base, F.lit(False).alias("asks"), block("m").alias("rows"), each("q").alias("queries"))
        dealt = dealt.unionByName(many.filter("component <> main").select(*base, F.lit(True).alias("asks"), each("m").alias("rows"), block("q").alias("queries")))
        found = dealt.groupBy("bucket", "rows", "queries").applyInArrow(reaching, "a long, b long")
        more = joined.unionByName(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))).distinct()
        if tested is not None:
            more = more.join(tested, ["a", "b"], "left_anti")
        found = linked(cut(pruned(cut(more))))
        if not found.isEmpty():
            part = components(found if links is None else links.unionByName(found))
    if part is None:
        part = classes.select("id", F.col("id").alias("component")).limit(0)
    by_id = one.join(classes.select("f1", "f2", "id"), ["f1", "f2"]).join(part, "id", "left").select("doc_id", F.coalesce("component", "id").alias("least"))
    out = sketches.select("doc_id", F.col("n").alias("n_shingles")).join(by_id, "doc_id", "left").withColumn("component_id", F.coalesce("least", "doc_id"))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)).alias("kept"))


def op1_minhash_dedup(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir), width=2)
