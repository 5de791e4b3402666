import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quillspark.llm import decontaminate, language, maxent, minhash, quality, shards, substring, tokens, toxicity

from . import brute
from .conftest import SCHEMA, words


def rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


def test_quality_measures_and_edges(odd, odd_rows, clashing, empty):
    got = rows(quality.judge(odd), "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    want = [(r[0], *brute.quality(r[1])) for r in odd_rows]
    strip = lambda x: sorted(((*r[:5], None if r[1] >= 2000 else r[5]) for r in x), key=repr)
    assert strip(got) == strip(want)
    assert {r["doc_id"] for r in quality.judge(odd).filter("base_failed").collect()} >= {2, 3, 4, 10, 12}
    assert rows(quality.judge(clashing), "doc_id", "kept") == rows(quality.judge(odd), "doc_id", "kept")
    assert quality.judge(empty).count() == 0


def test_quality_rules_reject_and_keep(spark):
    clean = "the man and the dog of that house is in the garden with a ball and it is on for the day that he was by the tree"
    texts = [clean, "!!".join(clean.upper().split()) + " " + " ".join(f"Q{i}X" for i in range(40)), " | ".join(f"cell{i}" for i in range(40)), "\n".join(["same line here now"] * 30)]
    got = quality.judge(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"))
    assert [r["kept"] for r in got.orderBy("doc_id").collect()] == [True, False, False, False]


@pytest.mark.parametrize("width", [2, 5])
def test_near_duplicates(odd, odd_rows, clashing, empty, width):
    sets = {d: brute.shingle_set(t, width) for d, t, *_ in odd_rows if d is not None}
    want = brute.components(sets)
    got = minhash.near_duplicates(odd, width=width).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["n_shingles"], r["component_id"], r["kept"]) == (len(sets[r["doc_id"]]), want[r["doc_id"]], want[r["doc_id"]] == r["doc_id"])
    if width == 2:
        assert rows(minhash.near_duplicates(clashing, width=2), "doc_id", "component_id") == rows(minhash.near_duplicates(odd, width=2), "doc_id", "component_id")
        assert minhash.near_duplicates(empty).count() == 0


def test_near_duplicates_group_of_mutual_misses(spark):
    """Copies of one text with edits: about half of the pairs reach 80 %, and the group is one class all the same."""
    import random

    base, r = words(9, 150, 10_000), random.Random(3)
    texts = [" ".join(w if r.random() > 0.055 else f"e{r.random()}" for w in base) for _ in range(60)]
    data = [(i, t) for i, t in enumerate(texts)]
    want = brute.components({i: brute.shingle_set(t, 2) for i, t in data})
    got = minhash.near_duplicates(spark.createDataFrame(data, "doc_id long, text string"), width=2)
    assert {x["doc_id"]: x["component_id"] for x in got.collect()} == want


def test_least_matches_and_components(spark):
    assert minhash.least_matches(32, 0.8, 1e-6) < minhash.least_matches(32, 0.8, 1e-2) < 27
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    got = dict(tuple(x) for x in minhash.components(chain).collect())
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_decontamination(spark, odd, odd_rows, clashing, empty):
    passage = odd_rows[8][1].split()[85:110]
    items = [(1, " ".join(passage)), (2, "ONE"), (3, "É é ß"), (4, None), (5, ""), (6, "x x x"), (None, "idiot AND the"), (10, " ".join(passage[:14]))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    named = [("null" if i is None else str(i), t) for i, t in items]
    want = sorted(((r[0], *brute.hits(r[1], named, 13)) for r in odd_rows), key=repr)
    got = decontaminate.contamination(odd, bench).select("doc_id", "n_words", "n_hit", "n_items", F.array_join("item_ids", ",").alias("ids"))
    assert rows(got, "doc_id", "n_words", "n_hit", "n_items", "ids") == want
    again = decontaminate.contamination(clashing, bench.withColumn("win", F.lit(1)))
    assert rows(again, "doc_id", "n_hit") == rows(got, "doc_id", "n_hit")
    assert decontaminate.contamination(empty, bench).count() == 0
    assert decontaminate.contamination(odd, bench.limit(0)).filter("n_hit > 0 OR contaminated").count() == 0


def test_decontamination_without_broadcast(spark, odd, odd_rows, monkeypatch):
    bench = spark.createDataFrame([(1, " ".join(odd_rows[8][1].split()[85:110])), (2, "one")], "item_id long, text string")
    want = rows(decontaminate.contamination(odd, bench), "doc_id", "n_words", "n_hit", "n_items")
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", 0)
    assert rows(decontaminate.contamination(odd, bench), "doc_id", "n_words", "n_hit", "n_items") == want


def test_id_files_round_trip(spark, odd, odd_rows, clashing, empty, tmp_path):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    coder = Tokenizer.from_file(path)
    want, start = [], 0
    for d, t, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or "")):
        ids = [*coder.encode(t or "", add_special_tokens=False).ids, 2]
        want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    for k, df in enumerate((odd, clashing)):
        folder = f"file://{tmp_path}/{k}"
        manifest = tokens.write_ids(df, folder, path, 2, file_ids=5000)
        assert manifest.agg(F.sum("n_docs")).first()[0] == len(want) and manifest.count() > 1
        got = [tuple(r) for r in tokens.read_ids(folder, manifest).orderBy("start").collect()]
        assert got == want
    assert tokens.read_ids(f"file://{tmp_path}/e", tokens.write_ids(empty, f"file://{tmp_path}/e", path, 2)).count() == 0
    gone = manifest.first()["name"]
    (tmp_path / "1" / gone).unlink()
    with pytest.raises(Exception, match=gone):
        tokens.read_ids(folder, manifest).count()


def test_id_coding():
    ids = np.array([0, 7, 7, 300, 70_000, 20_000_000] + list(range(70_000)), np.int64)
    docs, lengths, back = tokens.unpack_file(tokens.pack_file([5, None], np.array([6, 70_000]), ids))
    assert docs == [5, None] and lengths.tolist() == [6, 70_000] and (back == ids).all()


def test_encoder_equals_the_library():
    """Runs of white space of all kinds, marks, contractions, added tokens: the ids are those of the library for each text alone."""
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    path, r = tokens.tokenizer_path(), random.Random(4)
    plain, coder = Tokenizer.from_file(path), tokens.Encoder(path)
    texts = ["", "a  b", "  lead", "trail  ", "a\n \nb", "x  y z", "<|endoftext|> it's", "a   b c", "\n\n", "a\t b", " ", "é ü\r\n ok 12 34x", "a \n", "one two three four five one two", None]
    texts += ["x <|endoftext|> y", "<|endoftext|>", "a<|endoftext|>b c", "x <|endoftext|", "|endoftext|> <|end oftext|> it", "one two  three", "\n", "\nA", "a\n", "a\n\n", "a\n\nb", "a\n\n\nb", "a\nb\nc.\nD!! e_? 'tis"]
    bits = ["a", "Word", "don't", "x's.", "12", "3rd", "é", "ß…", "中文", "٣", "²", "...", "!?", "_", "(q)", "'", "\"", " ", " ", " ", "\n", "\n", "\t", "\r", "\u00a0", "\u2003", "\u0085", "\x1c", "\x0b", "\u200b", "ʰ", "e\u0301"]
    texts += ["".join(r.choices(bits, k=r.randrange(1, 14))) for _ in range(4000)]
    for end, some in ((None, texts), (2, texts), (2, []), (None, texts[:1])):
        ids, sizes = coder.encode(pa.array(some, pa.string()), end)
        want = [plain.encode(t or "", add_special_tokens=False).ids + ([] if end is None else [end]) for t in some]
        assert [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])] == (want or [[]])


def test_literals_in_id_files_and_sequences(spark, tmp_path):
    """The literal of an added token is one id: it counts as one, and moves the start of later documents so."""
    docs, path = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "z")], "doc_id long, text string"), tokens.tokenizer_path()
    folder = f"file://{tmp_path}/ids"
    got = rows(tokens.read_ids(folder, tokens.write_ids(docs, folder, path, 2)), "doc_id", "start", "n_tokens", "ids_crc32")
    assert got[0] == (1, 0, 5, zlib.crc32(np.array([87, 220, 50256, 331, 2], "<u4").tobytes())) and got[1][:3] == (2, 5, 2)
    assert rows(tokens.pack(docs, path, 1), "doc_id", "doc_tokens") == [(1, 5), (2, 2)]


def test_packing(spark, odd, odd_rows, empty):
    from tokenizers import Tokenizer

    path = tokens.tokenizer_path()
    coder = Tokenizer.from_file(path)
    got = tokens.pack(odd.filter("doc_id IS NOT NULL").dropDuplicates(["doc_id"]), path, 1, 256).collect()
    texts = {d: t for d, t, *_ in odd_rows if d is not None}
    parts = {}
    for r in got:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) == r["length"] and zlib.crc32(r["ids"]) == r["ids_crc32"] and r["offset"] + r["length"] <= 256
        parts.setdefault(r["doc_id"], []).append((r["start"], ids))
    for d, t in texts.items():
        whole = np.concatenate([x for _, x in sorted(parts[d], key=lambda p: p[0])])
        assert whole.tolist() == [*coder.encode(t or "", add_special_tokens=False).ids, 1]
    fill = Counter()
    for r in got:
        fill[r["sequence_id"]] += r["length"]
    assert all(n == 256 for s, n in fill.items() if s != max(fill)) and set(fill) == set(range(max(fill) + 1))
    assert tokens.pack(odd, path, 1).filter("doc_id IS NULL").count() >= 2
    assert tokens.pack(empty, path, 1).count() == 0


def test_compaction(spark, odd, empty, tmp_path):
    store = shards.ShardStore(spark, str(tmp_path / "t"), target_bytes=1 << 20, fanout=3, base_bytes=1 << 12)
    store.append(empty)
    for k in range(7):
        store.append(odd.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(7)) == k))
    before = store.versions()[-1]
    frozen = rows(store.read(before), "doc_id", "text")
    store.compact()
    assert rows(store.read(), "doc_id", "text", "lang") == rows(odd, "doc_id", "text", "lang")
    assert rows(store.read(before), "doc_id", "text") == frozen
    assert len(store.manifest()["runs"]) < len(store.manifest(before)["runs"])
    store.vacuum()
    assert rows(store.read(), "doc_id", "text") == frozen
    stale = store.manifest()
    store.append(odd)
    with pytest.raises(shards.Conflict):
        store._commit(stale, stale["schema"], [])


def test_tiers_and_vacuum(spark, tmp_path):
    """Runs of one tier are merged when there are fanout of them; vacuum spares what no manifest names yet, and what the kept versions name."""
    store = shards.ShardStore(spark, str(tmp_path / "t"), target_bytes=1 << 20, fanout=3, base_bytes=1000)
    assert store.read().columns == [] and store.vacuum() == []
    run = lambda n, size: shards.Run(n, ("f",), size)
    assert [store.tier(run("x", n)) for n in (0, 1000, 1001, 2999, 3001, 9001)] == [0, 0, 0, 0, 1, 2]
    few, many = [run("a", 10), run("b", 500)], [run("c", 4000), run("d", 5000), run("e", 8000)]
    assert store._like(few) == [] and store._like(few + many) == many and store._like([*few, run("z", 7), *many])[0].name == "a"
    assert store._like([run(n, 1 << 20) for n in "pqr"]) == []  # full files are never rewritten
    part = lambda k: spark.createDataFrame([(k,)], "doc_id long")
    for k in range(3):
        store.append(part(k))
    store.compact()
    pending = store._write(part(9))
    assert store.vacuum(keep=2) == [] and store.read(store.versions()[-2]).count() == 3
    base = store.manifest()
    assert len(store.vacuum()) == 3 and store.versions() == [base["version"]] and store.read().count() == 3
    store._commit(base, base["schema"], [shards.Run(r["name"], tuple(r["files"]), r["bytes"]) for r in base["runs"]] + [pending])
    assert rows(store.read(), "doc_id") == [(0,), (1,), (2,), (9,)]
    lost = store._write(part(7))
    assert lost.name in store.vacuum(grace_seconds=-1) and store.read().count() == 4


def test_writers_between_claim_and_rename(spark, tmp_path):
    """The second of two writers of one version fails, though the first has claimed it and not yet named it; a lost claim is recovered."""
    part = lambda k: spark.createDataFrame([(k,)], "doc_id long")
    first, second = (shards.ShardStore(spark, str(tmp_path / "t")) for _ in range(2))
    first.append(part(1))
    files, between = first._fs, None

    class Files:
        """What first asks of the file system; between runs before its rename."""

        def __getattr__(self, name):
            return getattr(files, name)

        def rename(self, *paths):
            between()
            return files.rename(*paths)

    first._fs = Files()

    def between():
        with pytest.raises(shards.Conflict):
            second.append(part(3))

    assert first.append(part(2)) == 2
    assert rows(second.read(), "doc_id") == [(1,), (2,)] and second.append(part(3)) == 3 and second.recover() == 3

    def between():
        assert second.recover() == 4 and second.append(part(5)) == 5

    with pytest.raises(shards.Conflict):
        first.append(part(4))
    assert rows(second.read(), "doc_id") == [(1,), (2,), (3,), (5,)] and second.versions() == [1, 2, 3, 4, 5]
    second.vacuum()
    assert second.read().count() == 4


@pytest.mark.parametrize(("window", "gram"), [(20, 8), (5, 2), (3, 3)])
def test_substring_dedup(odd, odd_rows, window, gram):
    # Repeated whole rows are one document; texts of equal words with different ids are copies.
    distinct = dict((d, t) for d, t, *_ in odd_rows if d is not None)
    want = brute.without_repeats(distinct.items(), window)
    got = substring.without_duplicates(odd, window, gram).collect()
    assert len(got) == len(odd_rows)
    for r in got:
        if r["doc_id"] is None:
            assert r["n_removed"] == 0
        else:
            assert (r["n_words"], r["n_removed"], r["kept_sha256"]) == want[r["doc_id"]], r["doc_id"]
            assert hashlib.sha256(b" ".join((r["kept"] or "").encode().split())).hexdigest() == r["kept_sha256"] and (r["n_removed"] or r["kept"] == distinct[r["doc_id"]])


def test_substring_dedup_edges(spark, odd, clashing, empty):
    assert substring.without_duplicates(empty).count() == 0
    assert rows(substring.without_duplicates(clashing), "doc_id", "n_removed") == rows(substring.without_duplicates(odd), "doc_id", "n_removed")
    two = spark.createDataFrame([(1, " ".join(words(1, 50))), (1, " ".join(words(2, 50))), (2, " ".join(words(1, 50)))], "doc_id long, text string")
    assert rows(substring.without_duplicates(two), "doc_id", "n_removed") == [(1, 0), (1, 0), (2, 0)]


def test_substring_dedup_random(spark):
    import random

    r = random.Random(5)
    data = [(i, " ".join(x for _ in range(r.randrange(1, 6)) for x in words(r.randrange(12), 40, 50)[r.randrange(20) : r.randrange(20, 41)])) for i in range(120)]
    want = brute.without_repeats(data, 8)
    got = substring.without_duplicates(spark.createDataFrame(data, "doc_id long, text string").repartition(5), 8, 3)
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.collect()} == want


def test_substring_dedup_over_many_batches(spark):
    """One task reads several batches, ids in no order, and a passage stands many times in each: the least place keeps it."""
    import random

    r, passage = random.Random(8), words(99, 60, 9)
    ids = list(range(36))
    r.shuffle(ids)
    data = [(i, " ".join(x for k in range(5) for x in [*words(1000 + 7 * i + k, 4500, 10**9), *(passage if k or i % 2 else words(i, 20, 10**9))])) for i in ids]
    want = brute.without_repeats(data, 20)
    got = substring.without_duplicates(spark.createDataFrame(data, "doc_id long, text string").coalesce(1), 20, 8)
    assert {x["doc_id"]: (x["n_words"], x["n_removed"], x["kept_sha256"]) for x in got.collect()} == want


def test_repeated_remembers_the_least():
    seen, u = substring._Repeated(least=2, most=1), lambda *x: np.array(x, np.uint64)
    opens = lambda *x: np.array(x, bool)
    at = lambda *x: np.array(x, np.int64)
    assert not seen.later(u(1, 1, 2, 2), u(5, 5, 6, 6), at(7, 8, 1, 2), at(0, 0, 0, 0), opens(1, 0, 1, 0)).any() and dict(seen) == {(1, 5): (7, 0)}
    assert seen.later(u(1, 2), u(5, 6), at(9, 9), at(0, 0), opens(1, 1)).tolist() == [True, False]
    assert seen.later(u(1, 1), u(5, 9), at(3, 9), at(4, 0), opens(1, 1)).tolist() == [False, False] and seen[1, 5] == (3, 4)


def test_queries_equal_brute_force_links(spark):
    """op1 on a given table: every link of all pairs of whole sets is found, so the recall is 1."""
    import os

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("the given tables are absent")
    sets = {r["doc_id"]: brute.shingle_set(r["text"], 2) for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.op1_minhash_dedup(spark, d).collect()}
    assert got == {i: (len(sets[i]), c) for i, c in brute.components(sets).items()}


def test_toxicity_equals_compression_by_hand(spark, odd, odd_rows):
    """Each score is that of two plain compressions of each window."""
    import re

    import zstandard as z

    data = _labelled(spark)
    model = toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic"))

    def plain(content, window):
        shape = z.ZstdCompressionParameters.from_level(3, dict_size=len(content), source_size=40, write_content_size=False, write_checksum=False, write_dict_id=False)
        return len(z.ZstdCompressor(compression_params=shape, dict_data=z.ZstdCompressionDict(content, dict_type=z.DICT_TYPE_RAWCONTENT)).compress(window))

    pad = bytes(range(1, 17))
    texts = {r["doc_id"]: r["text"] for r in data.filter("doc_id < 24").collect()} | {1001: None, 1002: "", 1003: "the SCUMBAG and scumbags"}
    want = {}
    for i, t in texts.items():
        w = [x.encode() for x in re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (t or "").lower())]
        saved = [plain(pad + model.ordinary, b" " + x + b" " + pad) - plain(pad + model.ordinary + model.toxic, b" " + x + b" " + pad) for x in w] or [0]
        counts = [sum(s >= k for s in saved) for k in range(1, toxicity.STEPS + 1)]
        x = [math.log1p(c) for c in counts] + [math.log((c + 0.1) / (len(saved) + 1)) for c in counts]
        logit = model.weights[0] + sum((v - c) / s * b for v, c, s, b in zip(x, model.centre, model.scale, model.weights[1:], strict=True))
        want[i] = 1 / (1 + math.exp(-max(-30, min(30, logit))))
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), model).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-9 for i in want)


def test_language_model_score_by_hand(spark):
    """Each score is the sum, over the tokens, of the class's softmax in its context and of the token's share of its class."""
    import zlib as zl

    import xxhash

    train = spark.createDataFrame([(i, " ".join(words(i % 7, 50, 60))) for i in range(60)], "doc_id long, text string")
    m, counts = maxent.train(train)
    n_of = {r["key"]: r["n"] for r in counts.collect()}
    texts = {1: " ".join(words(3, 12, 60)), 2: "new WORDS w1", 3: None, 4: "w1"}
    mask = (1 << 64) - 1

    def token(w):
        return xxhash.xxh3_64_intdigest(w) & ~511 | zl.crc32(w[-3:]) % 511 + 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    want = {}
    for i, t in texts.items():
        ts, total = [token(w) for w in (t or "").lower().encode().split()] + [maxent.END], 0.0
        for k, now in enumerate(ts):
            one, two, three = (ts[k - n] if k >= n else maxent.BEFORE for n in (1, 2, 3))
            rows = [one & 511, two & 511, three & 511, (one >> 9) & (maxent.HASHED - 1), mix((two * 0x9E3779B97F4A7C15 + one) & mask) & (maxent.HASHED - 1), 0]
            z = sum(w[r].astype(float) for w, r in zip(m.weights, rows, strict=True))
            c = m.cls[now & 511]
            signed = now - (1 << 64) if now >> 63 else now
            total += (z[c] - z.max() - math.log(np.exp(z - z.max()).sum())) / math.log(10) + math.log10(n_of.get(signed, 0) + 0.1) - m.mass[c]
        want[i] = total
    got = {r["doc_id"]: r["score"] for r in maxent.score(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), m, counts).collect()}
    assert all(abs(got[i] - want[i]) < 1e-3 * abs(want[i]) for i in want)


def test_clashing_columns_and_empty_tables(spark, odd, clashing, empty, tmp_path):
    """Columns that operators use inside do no harm, and an empty table goes through every operator and stage."""
    import public_tokenizers

    path = tokens.tokenizer_path()
    assert rows(tokens.pack(clashing, path, 1, 256), *tokens.PIECE[:1], "length") == rows(tokens.pack(odd, path, 1, 256), *tokens.PIECE[:1], "length")
    store = shards.ShardStore(spark, str(tmp_path / "s"))
    store.append(clashing)
    assert rows(store.read(), *clashing.columns) == rows(clashing, *clashing.columns)
    data = _labelled(spark)
    model = toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic"))
    assert rows(toxicity.score(clashing, model), "doc_id", "score") == rows(toxicity.score(odd, model), "doc_id", "score")
    m, counts = maxent.train(clashing)
    assert rows(maxent.score(clashing, m, counts), "doc_id", "n_known") == rows(maxent.score(odd, m, counts), "doc_id", "n_known")
    pieces = public_tokenizers.path(language.VOCABULARY)
    langs, p = language.train(clashing, pieces, rounds=1)
    assert rows(language.identify(clashing, langs, p, pieces), "doc_id", "lang_pred") == rows(language.identify(odd, langs, p, pieces), "doc_id", "lang_pred")
    d = str(tmp_path)
    spark.createDataFrame([(1, "one two three")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, d)
        assert out.count() == 0 and (name == "packing" or tuple(out.columns) == corpus_pipeline.COLUMNS)
        keys = ("doc_id", "length") if name == "packing" else ("doc_id", "text", "lang")
        assert rows(stage(spark, clashing, d), *keys) == rows(stage(spark, odd, d), *keys)


def _labelled(spark):
    bad = ["scumbag", "vileness", "wretched", "nastier"]
    data = [(i, " ".join(words(i, 60, 2000) + ([bad[i % 4], *words(i + 999, 5), bad[(i + 1) % 4]] if i % 4 == 0 else [])), int(i % 4 == 0)) for i in range(400)]
    return spark.createDataFrame(data, "doc_id long, text string, toxic int")


def test_toxicity(spark, odd, odd_rows, empty):
    data = _labelled(spark)
    model = toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic").filter("doc_id % 5 <> 0"))
    held = {r["doc_id"]: r["score"] for r in toxicity.score(data.filter("doc_id % 5 = 0"), model).collect()}
    right = [(s >= 0.5) == (d % 4 == 0) for d, s in held.items()]
    assert np.mean(right) > 0.95
    got = toxicity.score(odd, model).collect()
    assert len(got) == len(odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] in (2, 3, 4)}) == 1
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(data.select("doc_id", "text"), data.select("doc_id", "toxic").limit(0))
    assert {r["score"] < 0.5 for r in toxicity.score(odd, none).collect()} == {True}


def test_language_accuracy_and_edges(spark, odd, odd_rows, empty):
    import public_tokenizers

    path = public_tokenizers.path(language.VOCABULARY)
    parts = {"aa": ["the", "and", "ing", "tion", "er", "st"], "bb": ["der", "die", "ung", "ich", "sch", "zu"], "cc": ["que", "ment", "eau", "les", "oi", "ch"]}
    import random

    r = random.Random(1)
    data = [(i, " ".join("".join(r.choices(parts[k], k=r.randrange(1, 4))) for _ in range(40)), k) for i, k in enumerate(list(parts) * 40)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    langs, p = language.train(df.filter("doc_id % 5 <> 1"), path)
    assert langs == ["aa", "bb", "cc"] and np.allclose(p[1:].sum(axis=0), 1, atol=0.01)
    got = {x["doc_id"]: x["lang_pred"] for x in language.identify(df, langs, p, path).collect()}
    assert np.mean([got[i] == k for i, _, k in data]) > 0.98
    out = {(x["doc_id"], x["lang_pred"]) for x in language.identify(odd, langs, p, path).collect()}
    assert {(d, "und") for d in (2, 3, 4)} <= out and language.identify(odd, langs, p, path).count() == len(odd_rows)
    assert language.identify(empty, langs, p, path).count() == 0
    none, q = language.train(df.limit(0), path)
    assert {x["lang_pred"] for x in language.identify(odd, none, q, path).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    import public_tokenizers

    tool = language.pieces(public_tokenizers.path(language.VOCABULARY))
    p = np.random.default_rng(0).random((tool.count, 2)) / tool.count
    texts = ["a", "the", "thing", "ñu", "straße"]
    first, last, layers = tool.lattice(texts)
    edges = [(int(a), int(b), int(x)) for s, e, q in layers for a, b, x in zip(s, e, q, strict=True)]

    def paths(a, end):
        return np.ones(2) if a == end else sum((p[x] * paths(b, end) for s, b, x in edges if s == a), np.zeros(2))

    want = np.array([np.log(paths(a, b)) for a, b in zip(first.tolist(), last.tolist(), strict=True)])
    assert np.allclose(tool.forward(texts, p), want)
    counts = tool.expected(texts, np.ones(len(texts)), p[:, 0])
    assert counts.sum() >= len(texts)
    # The same by logarithms, which long words take; those don't underflow, and nothing of them is cut off.
    assert np.allclose(tool._forward_logs(texts, np.log(p)), want) and np.allclose(tool._expected_logs(texts, np.ones(len(texts)), np.log(p[:, 0])), counts)
    long = ["thing" * 400, "a", "straße" * 9]
    got = tool.forward(long, p)
    assert np.isfinite(got).all() and (got[0] < got[2]).all() and np.allclose(got[1], tool.forward(["a"], p))
    assert np.isfinite(tool.expected(long, np.ones(3), p[:, 0])).all()


def test_letters():
    assert language.words_of("² ½ 12 _ Ⅷ") == [] == language.words_of(None)
    assert language.words_of("Straße x²y É-e\u0301t 中文 हिन्दी") == ["straße", "x", "y", "é", "e\u0301t", "中文", "हिन्दी"]
    assert len(language.words_of("a" * 1000)) == 1


def test_language_sample_has_no_cut(spark):
    """Rows that repeat an id, null ids and a hot language: the sample is that of a plain ranking."""
    import public_tokenizers

    path = public_tokenizers.path(language.VOCABULARY)
    data = [(i, f"the word{'abcdefghij'[i % 10]} und", "en" if i % 20 else "de") for i in range(600)] + [(None, "nada mas", "es"), (5, None, "en"), (6, "x", None)]
    df = spark.createDataFrame(data * 2, "doc_id long, text string, lang string").repartition(5)
    langs, p = language.train(df, path, per_language=20, rounds=1)
    assert langs == ["de", "en", "es"] and np.isfinite(p).all()
    one, q = language.train(df.coalesce(1), path, per_language=20, rounds=1)
    assert one == langs and np.allclose(p, q)


def test_language_model(spark, odd, odd_rows, empty):
    train = spark.createDataFrame([(i, " ".join(words(i % 7, 50, 60))) for i in range(60)] + [(99, None)], "doc_id long, text string")
    for most in (400_000, 5):
        model, counts = maxent.train(train, most_frequent=most)
        c = Counter(w for i in range(60) for w in [*words(i % 7, 50, 60), None]) + Counter([None])
        n, v = sum(c.values()), len(c)
        assert (model.n, model.v) == (n, v)
        got = maxent.score(odd, model, counts).collect()
        want = []
        for d, t, *_ in odd_rows:
            w = [x.decode() for x in brute.tokens(t)] + [None]
            want.append((repr(d), len(w), sum(c[x] > 0 for x in w), round(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), 6)))
        assert sorted((repr(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == sorted(want)
        assert all(r["score"] < 0 for r in got)
        own = maxent.score(train, model, counts).agg(F.sum("score"), F.sum("base_score")).first()
        assert own[0] > own[1]  # the context helps
    assert maxent.score(empty, model, counts).count() == 0
    none, nothing = maxent.train(empty.select("doc_id", "text"))
    assert none.n == 0 and maxent.score(odd, none, nothing).filter("n_known > 0").count() == 0


def test_language_model_is_a_distribution():
    """In any context the classes' probabilities sum to one."""
    weights = [np.random.default_rng(k).normal(size=(n, maxent.CLASSES)).astype(np.float32) for k, n in enumerate(maxent.TABLES)]
    features = [np.array([1, 2, 0]) for _ in maxent.TABLES[:-1]] + [np.zeros(3, int)]
    assert np.allclose(maxent._probabilities(weights, features).sum(axis=1), 1, atol=1e-5)
    target = np.array([3, 0, 5])
    assert np.allclose(np.exp(maxent._target_logs(weights, features, target)), maxent._probabilities(weights, features)[np.arange(3), target], atol=1e-5)


def test_pipeline(spark, odd_rows, tmp_path):
    """Each stage's decisions take effect, judged on its own input by brute force."""
    r = [(d, t, lang, s, n) for d, t, lang, s, n in odd_rows]
    filler = "the man and the dog of that house is in the garden with "
    docs = [(100 + i, filler + " ".join(words(50 + i, 120)), "en", "s", 0) for i in range(6)]
    docs += [(200, docs[0][1] + " extra", "en", "s", 0), (201, filler + " ".join(words(70, 90) + words(71, 70)), "en", "s", 0), (202, filler + " ".join(words(72, 90) + words(71, 70)), "en", "s", 0)]
    d = str(tmp_path)
    spark.createDataFrame(r + docs, SCHEMA).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(1, " ".join(words(52, 120)[20:60]))], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    out = {}
    table = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, table, d).write.parquet(f"{d}/{name}")
        table = out[name] = spark.read.parquet(f"{d}/{name}")
        if name != "packing":
            assert tuple(table.columns) == corpus_pipeline.COLUMNS
    ids = {k: {x["doc_id"] for x in v.select("doc_id").collect()} for k, v in out.items()}
    assert not ids["quality_rules"] & {2, 3, 4, 10, 12} and ids["quality_rules"] >= {x[0] for x in docs}
    texts = {x["doc_id"]: x["text"] for x in out["quality_rules"].collect()}
    want = brute.components({i: brute.shingle_set(t, 5) for i, t in texts.items() if i is not None})
    assert ids["near_dedup"] - {None} == {i for i, c in want.items() if i == c} and 200 not in ids["near_dedup"]
    assert ids["substring_dedup"] == ids["near_dedup"]
    cut = {x["doc_id"]: x for x in out["substring_dedup"].collect()}
    assert " ".join(words(71, 70)) in cut[201]["text"] and words(71, 70)[30] + " " + words(71, 70)[31] not in cut[202]["text"] and cut[202]["n_chars"] == len(cut[202]["text"])
    assert ids["decontamination"] == ids["substring_dedup"] - {102}
    assert ids["packing"] == ids["decontamination"]
    assert corpus_pipeline.run(spark, d).count() == out["packing"].count()


def test_pipeline_judges_rows(spark, tmp_path):
    """Rows without an id, and rows that share one, stay or go each by its own text."""
    held, other, third = words(80, 40), words(81, 40), words(82, 40)
    bad, clean = " ".join(held), " ".join(other)
    near = " ".join([*words(83, 100), "end"])
    d = str(tmp_path)
    spark.createDataFrame([(1, bad)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs = [(None, bad, "en", "s", 0), (None, clean, "en", "s", 1), (None, None, "en", "s", 2), (7, bad, "en", "s", 3), (7, clean, "en", "s", 4), (7, None, "en", "s", 5), (8, clean, "en", "s", 6)]
    got = corpus_pipeline.decontamination(spark, spark.createDataFrame(docs, SCHEMA).repartition(3), d)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS and [r[4] for r in rows(got.orderBy("n_chars"), *corpus_pipeline.COLUMNS)] == [r[4] for r in sorted((x for x in docs if x[1] != bad), key=repr)]
    docs = [(7, clean, "en", "s", 1), (7, clean, "de", "s", 2), (7, " ".join(third), "en", "s", 3), (7, near, None, "s", 4), (9, near, "en", "s", 5), (3, " ".join(third), "en", "s", 6), (5, "", "en", "s", 7), (None, clean, "en", "s", 8), (None, clean, "en", "s", 8), (6, bad, "en", "s", 9)]
    got = corpus_pipeline.near_dedup(spark, spark.createDataFrame(docs, SCHEMA).repartition(4), d)
    assert tuple(got.columns) == corpus_pipeline.COLUMNS and sorted(r["n_chars"] for r in got.collect()) == [2, 4, 6, 7, 8, 8, 9]


def test_hashed_tables_grow_with_the_words(spark):
    """Slots follow the distinct words up to a bound, so that contexts share fewer; both sides of a split pair of contexts get weights of their own."""
    few = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    many = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(600))) for k in range(20)], "doc_id long, text string")
    assert maxent.train(few)[0].hashed == maxent.HASHED
    model, counts = maxent.train(many)
    assert model.hashed == 16_384 and [len(w) for w in model.weights] == [512, 512, 512, 16_384, 16_384, 1]
    assert np.flatnonzero(np.abs(model.weights[4]).sum(axis=1)).max() >= maxent.HASHED
    assert maxent.score(many, model, counts).count() == 20
    assert maxent.train(many, most_hashed=8192)[0].hashed == 8192
