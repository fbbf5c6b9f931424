"""Each operator against a brute-force version on small hand-made tables, with the cases its docstring defines."""

import bisect
import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash

from corpusmill.llm import bpe, common, exact_dedup, line_dedup, lm_scoring, mixing, pieces, sharding, simhash, token_files, topk, toxicity

LONG = "word " * 30_000
TEXTS = [(1, "a  b"), (2, "a b"), (3, None), (4, ""), (5, "A b c d e"), (6, "a b c d e"), (7, LONG), (8, "x\ny\n\nx"), (9, "<|endoftext|> end  "), (10, "über naïve 한국 😀"), (10, "über naïve 한국 😀")]
EMPTY = []


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(pieces.tokenizer_path())


def test_exact_dedup(make_docs):
    rows = exact_dedup.exact_dedup(make_docs(TEXTS)).collect()
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in TEXTS}
    keep, size = {}, Counter()
    for i, t in sorted(TEXTS, key=lambda r: r[0]):
        keep.setdefault(norm[i], i)
        size[norm[i]] += 1
    assert len(rows) == len(TEXTS)
    for r in rows:
        n = norm[r.doc_id]
        assert (r.keep_id, r.group_size, r.text_sha256) == (keep[n], size[n], hashlib.sha256(n.encode()).hexdigest())
    assert sum(r.kept for r in rows) == len(keep)
    assert exact_dedup.exact_dedup(make_docs(EMPTY)).count() == 0


def test_exact_dedup_verifies_bytes(make_docs):
    """With a digest that collides, texts are still told apart; null ids never win over others."""
    from pyspark.sql import functions as F

    rows = exact_dedup.exact_dedup(make_docs([(1, "aa"), (2, "bb"), (3, "aa"), (None, "bb"), (None, "zz")]), digest=lambda c: F.encode(F.length(c).cast("string"), "UTF-8")).collect()
    assert sorted((r.keep_id or 0, r.group_size, r.kept) for r in rows) == [(0, 1, True), (1, 2, False), (1, 2, True), (2, 2, False), (2, 2, True)]


def test_simhash(make_docs):
    rng = random.Random(1)
    docs = TEXTS + [(100 + i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 5)))) for i in range(60)]
    fps = {}
    for i, t in docs:
        w = (t or "").encode().lower().split()
        n = max(1, len(w) - 2)
        hs = [xxhash.xxh64_intdigest(b" ".join(w[k : k + 3]), 42) for k in range(n)] if w else []
        fps[i] = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > n) if w else 0
    parent = {i: i for i in fps}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in fps:
        for j in fps:
            if (fps[i] ^ fps[j]).bit_count() <= 2 and root(i) != root(j):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    rows = simhash.near_duplicates(make_docs(docs)).collect()
    assert len(rows) == len(docs)
    assert all((r.fingerprint, r.component_id) == (f"{fps[r.doc_id]:016x}", root(r.doc_id)) for r in rows)
    assert simhash.near_duplicates(make_docs(EMPTY)).count() == 0


def test_simhash_splits_large_shards(spark):
    rng = np.random.default_rng(1)
    values = sorted({int(b) ^ (1 << int(rng.integers(0, 60))) ^ (1 << int(rng.integers(0, 60))) for b in rng.integers(0, 2**62, 8) for _ in range(40)})
    fps = spark.createDataFrame([(v,) for v in values], "fp long")
    split, whole = (sorted(map(tuple, simhash.components(simhash.links_within(fps, 2, n)).collect())) for n in (16, 4096))
    assert split == whole and len(whole) > 100


def test_bk_tree():
    rng = random.Random(2)
    values = [rng.getrandbits(12) for _ in range(200)]
    tree = simhash.BkTree()
    for v in values:
        tree.add(v)
    for q in values[:50]:
        assert {tree.values[n] for n in tree.within(q, 2)} == {v for v in values if (v ^ q).bit_count() <= 2}


def test_bpe_and_files(make_docs, tokenizer, spark):
    texts = TEXTS + [(20 + i, t) for i, t in enumerate([" ", "  ", "\n \nfoo", "it's  'll", "aaaa" * 500, "\x1cx\x85y", "²½Ⅷ१", "a\0 \0b"])]
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids for i, t in texts}
    for r in bpe.round_trip(make_docs(texts)).collect():
        x = ids[r.doc_id]
        decoded = tokenizer.decode(x, skip_special_tokens=False)
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(x), hashlib.sha256(",".join(map(str, x)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
    docs = make_docs([*texts, (None, "none")])
    start = len(tokenizer.encode("none").ids) + 1
    rows = token_files.token_file_round_trip(docs).collect()
    found = {r.doc_id: r for r in rows}
    assert len(rows) == len(texts) + 1 and found[None].start == 0
    for i in sorted(ids):
        x = [*ids[i], 0]
        assert (found[i].n_tokens, found[i].ids_crc32) == (len(x), zlib.crc32(np.array(x, "<u4").tobytes()))
        if i != 10:
            assert found[i].start == start
        start += len(x) * (2 if i == 10 else 1)
    out = common.new_path(spark, "one")
    token_files.write_ids(docs, out)
    assert token_files.read_ids(spark, out, doc_id=6).first().ids == [*ids[6], 0]
    assert token_files.token_file_round_trip(make_docs(EMPTY)).count() == 0


def test_random_pieces(tokenizer):
    rng, codec = random.Random(3), bpe.codec(pieces.tokenizer_path())
    parts = ["a", "the", " ", "  ", "\n", "\t", "'s", "é", "한", "<|endoftext|>", "1", "xx", ".", "ll", "\r"]
    for _ in range(1500):
        x = "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))
        assert codec.encode(x) == tokenizer.encode(x, add_special_tokens=False).ids
        assert codec.decode(codec.encode(x)) == x


def test_line_dedup(make_docs):
    rng = random.Random(4)
    docs = TEXTS[:8] + [(50 + i, "\n".join(" ".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(0, 12))) for _ in range(8))) for i in range(25)]
    seen, expected = [], {}
    for i, t in docs:
        gone = []
        for k, line in enumerate((t or "").split("\n")):
            w = frozenset(x for x in re.split(r"[\x20\x09-\x0D]+", line) if x)
            if w and any(len(w & v) * 5 >= 4 * len(w | v) for v in seen):
                gone.append(k)
            if w:
                seen.append(w)
        expected[i] = gone
    found = line_dedup.dedup_lines(make_docs(docs))
    assert {r.doc_id: r.removed for r in found.collect()} == expected
    kept = {r.doc_id: r.text for r in line_dedup.remove_lines(make_docs(docs), found).collect()}
    assert kept[8] == "x\ny\n" and kept[3] is None
    assert line_dedup.dedup_lines(make_docs(EMPTY)).count() == 0
    odd = {r.doc_id: r.removed for r in line_dedup.dedup_lines(make_docs([(None, "a b c d e f"), (1, "x\na b c d e f\na b c d e"), (2, None)]).withColumnRenamed("lang", "doc")).collect()}
    assert odd == {None: [], 1: [1, 2], 2: []}


def test_line_dedup_of_a_very_long_line(make_docs):
    """More different tokens on a line than a short counts."""
    words = [f"w{i}" for i in range(40_000)]
    found = line_dedup.dedup_lines(make_docs([(1, " ".join(words)), (2, "few words\n" + " ".join([*words[100:], "other"])), (3, " ".join(words[:20_000]))]))
    assert {r.doc_id: r.removed for r in found.collect()} == {1: [], 2: [1], 3: []}


def test_mixing(make_docs):
    docs = make_docs([(i, "t") for i in range(3000)], source=lambda i: None if i % 50 == 0 else "big" if i % 3 else "small")
    rows = sorted(mixing.mix_sources(docs).collect(), key=lambda r: r.position)
    assert [r.position for r in rows] == list(range(3000))
    assert all(r.release <= r.slot < r.deadline for r in rows)
    given = mixing.mix_sources(docs, {"big": 3, "small": 1}, block_rows=4).collect()
    assert len(given) == 3000 and {r.period_slots for r in given} == {5}
    assert mixing.mix_sources(make_docs(EMPTY)).count() == 0
    repeated = make_docs([(1, "a"), (1, "a"), (2, "b")])
    assert mixing.stage(repeated.sparkSession, repeated, "").count() == 3


def test_mixing_pools_no_source(make_docs):
    """Each of many equal sources has a slot of its own in the period, and its rows lie where its share says."""
    rows = mixing.mix_sources(make_docs([(i, "t") for i in range(3300)], source=lambda i: f"s{i % 1100:04}"), block_rows=1).collect()
    assert {(r.weight, r.period_slots) for r in rows} == {(1, 1100)}
    assert all(r.position == r.slot == r.doc_id and r.block == r.doc_id // 1100 for r in rows)


def test_sharding(make_docs):
    docs = [(i, "x" * (i % 97)) for i in range(4000)] + [(5000 + i, "copy " * 20) for i in range(2000)] + [(9999, None), (9999, None)]
    rows = sharding.assign_shards(make_docs(docs)).collect()
    sizes, slots = Counter(), {}
    for r in rows:
        sizes[r.shard] += r.size
        slots.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(docs) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(sizes.values()) - min(sizes.values()) <= 0.02 * sum(sizes.values()) / 24 + 200
    assert {r.text_crc32 for r in rows if r.doc_id == 3} == {zlib.crc32(b"xxx")}
    assert sharding.assign_shards(make_docs(EMPTY)).count() == 0


def test_splitters_against_sorted_keys(spark):
    """Each boundary leaves the target's bytes below it but for the tolerance or one row; a hot text and equal rows are split."""
    rng = random.Random(7)
    rows = [(rng.getrandbits(63), rng.getrandbits(63), rng.getrandbits(63), rng.randint(8, 900)) for _ in range(3000)]
    rows += [(5 << 50, rng.getrandbits(63), rng.getrandbits(63), 50) for _ in range(3000)]
    rows += [(5 << 50, 77, rng.getrandbits(63), 40) for _ in range(3000)] + [(9, 9, 9, 30_000)]
    keys = spark.createDataFrame(rows, "_k0 bigint, _k1 bigint, _k2 bigint, size bigint")
    rows.sort()
    ends = list(itertools.accumulate(r[3] for r in rows))
    for shards in (1, 2, 24):
        edges = sharding.splitters(keys, shards)
        assert edges == sorted(edges) and len(edges) == shards - 1
        for i, edge in enumerate(edges):
            at = bisect.bisect_left(rows, edge)  # rows below the edge
            below, target = ends[at - 1] if at else 0, ends[-1] * (i + 1) / shards
            apart = abs(below - target) - sharding.TOLERANCE * ends[-1] / shards
            assert apart <= 0 or abs(below - target) <= max(rows[at - 1][3] if at else 0, rows[at][3])


def test_sharding_of_equal_rows(make_docs, spark):
    docs = make_docs([(1, "same text")] * 3000 + [(2, "x" * 2000)])
    sizes: Counter = Counter()
    for r in sharding.assign_shards(docs).collect():
        sizes[r.shard] += r.size
    assert len(sizes) == 24 and max(sizes.values()) - min(sizes.values()) <= 2008
    out = common.new_path(spark, "shards")
    sharding.write_shards(docs.withColumnRenamed("lang", "_row"), out, shards=4)
    back = spark.read.parquet(out)
    assert back.count() == 3001 and sorted(r.shard for r in back.select("shard").distinct().collect()) == [0, 1, 2, 3]
    with pytest.raises(ValueError):
        sharding.write_shards(back, out)


def test_topk(spark):
    rng = np.random.default_rng(5)
    vectors = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(800)] + [(800, None), (801, [1.0, None]), (802, [float("nan")] * 8), (803, [1e4] * 3), (900, [0.5] * 8), (901, [0.5] * 8)]
    df = spark.createDataFrame(vectors, "vec_id bigint, embedding array<float>")
    whole = {i: [math.floor(1024 * float(np.float32(x))) for x in v] + [0] * (8 - len(v)) for i, v in vectors if v and None not in v and not any(math.isnan(x) for x in v)}
    expected = {q: sorted(((-sum(a * b for a, b in zip(whole[q], v)), i) for i, v in whole.items() if i != q))[:10] for q in whole if q % 100 == 0}
    found: dict = {}
    for r in topk.top_k(df).collect():
        found.setdefault(r.query_id, {})[r.rank] = (-r.score, r.vec_id)
    assert {q: [s[k] for k in sorted(s)] for q, s in found.items()} == expected
    assert topk.top_k(df.filter("vec_id < 0")).count() == 0


def test_toxicity_held_out(spark):
    """On held-out labels of the small table the ranking is far better than chance, and empty texts have a score."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    docs = docs.join(labels.select("doc_id"), "doc_id").unionByName(docs.limit(2).selectExpr("doc_id * 0 - 1 AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars"))
    rows = toxicity.score_toxicity(docs, labels).toPandas()
    assert rows.score.between(0, 1).all() and ((rows.score >= 0.5) == (rows.predicted == 1)).all()
    both = rows[rows.held_out].merge(labels.toPandas(), on="doc_id")
    good, bad = both[both.toxic == 0].score.to_numpy(), both[both.toxic == 1].score.to_numpy()
    assert (bad[:, None] > good[None]).mean() > 0.85
    assert toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_keeps_the_true_share(make_docs, spark, monkeypatch):
    """Texts that tell nothing score the share of toxic labels, also where the sample holds as many of each class."""
    monkeypatch.setattr(toxicity, "SAMPLE", 10)
    labels = [(i, int(i % 10 == 0)) for i in range(1000)]
    rows = toxicity.score_toxicity(make_docs([(i, "the same words") for i, _ in labels]), spark.createDataFrame(labels, "doc_id bigint, toxic int")).collect()
    part = [toxic for i, toxic in labels if zlib.crc32(str(i).encode()) % toxicity.FOLDS == toxicity.CALIBRATION]
    assert sum(part) > 10
    assert len(rows) == 1000 and all(r.score == pytest.approx(sum(part) / len(part), rel=0.02) and r.predicted == 0 for r in rows)


def test_lm_scoring(make_docs):
    docs = TEXTS + [(200 + i, "the cat sat on the mat " * 5 + f"w{i}") for i in range(80)]
    rows = lm_scoring.score_texts(make_docs(docs)).collect()
    counts: Counter = Counter()
    for i, t in docs:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            counts.update(lm_scoring.tokens(t))
    n, v = sum(counts.values()), len(counts)
    texts = dict(docs)
    for r in rows:
        w = lm_scoring.tokens(texts[r.doc_id])
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w), sum(counts[x] > 0 for x in w), n, zlib.crc32(str(r.doc_id).encode()) % 7 == 2)
    held = [r for r in rows if r.held_out and r.doc_id >= 200]
    assert held and sum(r.score for r in held) > sum(r.base_score for r in held)
    assert lm_scoring.score_texts(make_docs(EMPTY)).count() == 0


CLASHING = "doc_id bigint, text string, lang string, source string, _row string, _ROW2 string, _id string, _key string, _sha string, _gone string, _bad string, _position string, id string, ids string, position string, n_chars bigint"


@pytest.mark.parametrize("repeats", [False, True])
@pytest.mark.parametrize("name", ["toxicity", "exact dedup", "SimHash near-dedup", "mixing sources to target weights", "BPE encoding and decoding"])
def test_stages_on_odd_tables(spark, name, repeats):
    """Null ids, texts and sources, repeated rows, a long text, clashing names, an empty table."""
    import corpus_pipeline

    stage, d = dict(corpus_pipeline.STAGES)[name], "/root/testdata/sf0.001"
    rows = [(1, "one text of some words here", "a"), (2, None, None), (3, "", "b"), (4, LONG, "a"), (5, "another text that is not like it", "b")]
    rows += [(None, "no id", "a"), (None, "no id at all, and other words", "b"), (1, "one text of some words here", "a")] if repeats else [(None, "no id", "a")]
    docs = spark.createDataFrame([(i, t, None, s, *"abcdefghijk", 7) for i, t, s in rows], CLASHING)
    found = stage(spark, docs, d).collect()
    n = {"exact dedup": 5, "SimHash near-dedup": 5}.get(name, len(rows)) + (1 if repeats and name in ("exact dedup", "SimHash near-dedup") else 0)
    if name == "toxicity":  # a handful of labelled rows: only that rows come out as they went in
        assert {tuple(r) for r in found} <= {tuple(r) for r in docs.collect()}
    else:
        assert len(found) == n
    if name != "BPE encoding and decoding":
        assert all(tuple(r)[4:] == (*"abcdefghijk", 7) for r in found)
    empty = stage(spark, docs.limit(0), d)
    assert empty.count() == 0 and (name == "BPE encoding and decoding" or empty.columns == docs.columns)


def test_added_columns_replace_their_namesakes(make_docs):
    docs = bpe.decode_documents(bpe.encode_documents(make_docs([(1, "a text"), (2, None)]).withColumnRenamed("lang", "ids")))
    assert docs.columns.count("ids") == 1 and {r.doc_id: r.decoded for r in docs.collect()} == {1: "a text", 2: ""}


def test_pipeline(spark):
    import corpus_pipeline

    docs = common.documents(spark, "/root/testdata/sf0.001")
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    found = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = common.written(stage(spark, found, "/root/testdata/sf0.001"), "stage")
        assert found.columns == docs.columns, name
    kept = {r.doc_id for r in found.select("doc_id").collect()}
    assert kept <= ids and len(kept) > 0.5 * len(ids)
    assert corpus_pipeline.STAGES[-1][1](spark, found, "").count() == len(kept)


@pytest.mark.parametrize("name, run, sql", [("exact", exact_dedup.op5_exact_dedup, exact_dedup.ORACLE), ("mix", mixing.op8_mix_sources, mixing.ORACLE), ("topk", topk.op9_top_k, topk.ORACLE)])
def test_sql(spark, name, run, sql):
    d, c = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet'")
    df = run(spark, d)
    columns = sorted(df.columns)
    assert sorted(map(str, (list(r) for r in df.select(*columns).collect()))) == sorted(map(str, (list(r) for r in c.sql(sql).select(*columns).fetchall())))
