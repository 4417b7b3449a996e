"""The corpus operators against brute force, exact round trips and odd inputs."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from sitelens.llm import bpe, components, htmltext, katz, langid, minhash, mixing, neardup, quality, queries, shards, simhash, tokenfile
from sitelens.llm.common import packed, range_bounds, range_of, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()), StructField("source", StringType()), StructField("kept", StringType()), StructField("fp", StringType())])

_rng = random.Random(5)
_vocabulary = ["".join(_rng.choice("abcdefgh") for _ in range(_rng.randint(1, 7))) for _ in range(60)]
_prose = [" ".join(_rng.choice(_vocabulary) for _ in range(_rng.randint(1, 120))) for _ in range(60)]
ODD = [None, "", " \t\n", "one", "two words", "A b\nA b\n\nA b", "x " * 5000, "é ü ß 日本 👍\x00\x1c", "####", "<|endoftext|> the end", _prose[0], _prose[0], _prose[0] + " more"]
TEXTS = ODD + _prose


@pytest.fixture(scope="module")
def docs(spark):
    """Odd and plain documents, a repeated row, null ids, and extra columns that clash with computed names."""
    rows = [(i, t, ("en", "de", None)[i % 3], None if i == 4 else f"s{i % 3}", "extra", "mine") for i, t in enumerate(TEXTS)]
    rows += [rows[20], rows[20], (None, _prose[3], "en", "s0", None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def _store(df, spark):
    """A stable scan, as katz asks for."""
    path = shared_dir(spark, "test")
    df.write.parquet(path)
    return spark.read.parquet(path)


# -- helpers ----------------------------------------------------------------------------------


def test_range_of(spark):
    t = spark.range(100).select(F.col("id").alias("v"))
    bounds = range_bounds(t, "v", 7)
    got = {r["v"]: r["b"] for r in t.withColumn("b", range_of(F.col("v"), bounds)).collect()}
    assert all(got[v] == sum(b <= v for b in bounds) for v in range(100)) and len(bounds) == 6


def test_components_against_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(1000 + i, 1001 + i) for i in range(70)] + [(5000, 6000 + i) for i in range(50)] + [(7, 7)]
    parent = {v: v for e in edges for v in e}

    def find(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        parent[b] = a
    got = dict(map(tuple, components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got.get(v, v) == find(v) for v in parent)
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 1 simhash ----------------------------------------------------------------------------------


def _simhash(text):
    w = WORD.findall((text or "").translate(LOWER))
    sh = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_components(spark, docs):
    rows = [(r["doc_id"], _simhash(r["text"])) for r in docs.collect()]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        if (rows[i][1] ^ rows[j][1]).bit_count() <= 3:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    expected = Counter((d, f, min(least[find(i)])) for i, (d, f) in enumerate(rows))
    got = Counter((r["doc_id"], r["fp"] % 2**64, r["component_id"]) for r in simhash.near_duplicates(docs).collect())
    assert got == expected


def test_simhash_links_in_crowded_buckets(spark):
    rng = np.random.default_rng(4)
    base = rng.integers(0, 2**63, 12, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base.tolist():
        for _ in range(60):
            v = b
            for bit in rng.integers(0, 64, rng.integers(1, 6)).tolist():
                v ^= 1 << bit
            fps.add(v)
    fps = np.array(sorted(fps), np.uint64)
    group = simhash.linked_groups(np.zeros(len(fps), np.int64), fps)
    parent = list(range(len(fps)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in (np.flatnonzero(np.bitwise_count(fps[i + 1 :] ^ fps[i]) <= 3) + i + 1).tolist():
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    assert group.tolist() == [find(i) for i in range(len(fps))]
    t = spark.createDataFrame([(int(f),) for f in fps.view(np.int64)], "fp long")
    for cell in (4096, 50):
        roots = dict(map(tuple, components.connected_components(simhash.near_links(t, len(fps), cell=cell)).collect()))
        groups, own = defaultdict(set), defaultdict(set)
        for i, f in enumerate(fps.view(np.int64).tolist()):
            groups[find(i)].add(f)
            own[roots.get(f, f)].add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, own.values()))


@pytest.mark.parametrize("rows", [10, 2**23, 2**33])
def test_bucket_masks_miss_nothing(rows):
    masks = simhash.bucket_masks(rows)
    rng = random.Random(rows)
    for _ in range(200):
        diff = sum(1 << b for b in rng.sample(range(64), 3))
        assert any(not m & diff for m in masks)


def test_keep_first(spark, docs, empty):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    ids = [r["doc_id"] for r in kept.collect()]
    named = [i for i in ids if i is not None]
    assert len(named) == len(set(named)) and 10 in named and 11 not in named and ids.count(None) == 1
    assert simhash.keep_first(empty).count() == 0 and simhash.near_duplicates(empty).count() == 0


# -- 2 shards -------------------------------------------------------------------------------------


def test_shards_compact_and_keep_versions(spark, docs):
    store = shards.ShardStore(spark, shared_dir(spark, "s"))
    for k in range(6):
        store.append(docs.filter(F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(6)) == k).coalesce(2))
    before = store.manifest()
    assert before.version == 6 and len(before.shards) > 6
    plain = sorted(map(str, docs.collect()))
    assert sorted(map(str, store.read().collect())) == plain
    after = store.compact(target=1 << 22)
    assert len(after.shards) < 4 and sum(s.rows for s in after.shards) == docs.count()
    assert sorted(map(str, store.read().collect())) == plain and store.read().columns == docs.columns


def test_shards_conflicts(spark, docs, empty):
    root = shared_dir(spark, "s")
    a, b = shards.ShardStore(spark, root), shards.ShardStore(spark, root)
    a.append(empty)
    assert a.read().count() == 0 and a.manifest().shards == ()
    base = a.manifest()
    b.append(docs.limit(3))
    with pytest.raises(shards.CommitConflict):
        a._publish(shards.Manifest(base.version + 1, base.schema, ()))
    assert a.append(docs.limit(2)).version == base.version + 2
    gone = shards.Shard("nowhere", 1, 1)
    with pytest.raises(shards.CommitConflict):
        a._commit([], frozenset({gone.path}))


def test_runs_stay_within_target():
    s = [shards.Shard(str(i), 1, 1000 + i) for i in range(50)]
    runs = shards.plan_runs(s, target=10_000)
    assert all(sum(x.bytes for x in r) <= 10_000 and len(r) > 1 for r in runs)
    assert shards.plan_runs(s[:3]) == [] and shards.plan_runs([shards.Shard("a", 1, 9_000)] * 9, target=10_000) == []


# -- 3 language ---------------------------------------------------------------------------------


def test_language_accuracy(spark, sf):
    got = queries.op3_language_id(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang"] == r["lang_pred"] for r in held) / len(held) > 0.98
    assert all(0 <= r["score"] <= 1 for r in got)


def test_language_odd_inputs(spark, docs, empty):
    rows = {r["doc_id"]: r for r in langid.identify(packed(docs, "doc_id", "text"), docs).collect()}
    assert all(rows[i]["lang_pred"] == "und" and not rows[i]["accepted"] for i in (0, 1, 2, 8))
    assert rows[11]["document"]["kept"] == "extra"
    assert {r["lang_pred"] for r in langid.identify(docs.select("text"), empty).collect()} == {"und"}
    assert langid.identify(empty, docs).count() == 0


# -- 4 html --------------------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h2>Site</h2></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="ad">Buy</div>
<article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b><br>line.</p><!-- no --><div class="share">Share</div><p>Second.<p>Third &eacute;</article>
<section id="comments"><p>Nice article, a very long comment that goes on and on.</p></section><form>Mail <input></form><footer>&copy; x</footer></body></html>"""


def test_html_article():
    assert htmltext.main_text(PAGE) == "Title & more\nFirst bold\nline.\nSecond.\nThird é"


def test_html_without_article():
    page = '<body><div id="menu"><a>One</a> <a>Two</a></div><div><p>A long enough paragraph of text.</p><p>And another one.</p></div><div><a>link link link</a></div></body>'
    assert htmltext.main_text(page).startswith("A long enough paragraph of text.\nAnd another one.")


@pytest.mark.parametrize("page", [None, "", "<p", "<!-- open", "<script>x", "<nav>all", "</article></nav>", "<div class='ad'"])
def test_html_odd(page):
    assert htmltext.main_text(page) == ""


def test_html_frame(spark):
    t = spark.createDataFrame([(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, None), (None, None, "<p>é</p>", None)], "page_id long, url string, html string, n_chars string")
    assert sorted((r["page_id"] or 0, r["n_chars"]) for r in htmltext.extract(t).collect()) == [(0, 1), (1, 45), (1, 45), (2, 0)]
    assert htmltext.extract(t.limit(0)).count() == 0


def test_stretches():
    assert htmltext.stretches(np.array([0, 5, 0, 0, 0, 0, 2, 3])) == [(1, 4), (6, 8)]
    assert htmltext.stretches(np.zeros(0, np.int64)) == []


# -- 5 mixing -------------------------------------------------------------------------------------


def test_poisson_inverse(spark):
    rate = 2.7
    t = spark.range(1).select(mixing.poisson_steps(F.lit(rate)).alias("s")).first()["s"]
    exact = np.cumsum([math.exp(-rate) * rate**k / math.factorial(k) for k in range(len(t))])
    assert np.allclose(t, exact, atol=1e-14)
    assert spark.range(1).select(mixing.poisson_steps(F.lit(0.0)).alias("s")).first()["s"] == [1.0]
    assert abs(spark.range(1).select(mixing.poisson_steps(F.lit(900.0)).alias("s")).first()["s"][-1] - 1) < 1e-9


def test_mixing_reaches_the_weights(spark):
    t = spark.range(6000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").otherwise(F.concat(F.lit("s"), (F.col("id") % 4).cast("string"))).alias("source"), F.lit("ten chars ").alias("text"))
    wish = {"big": 0.1, "s0": 0.3, "s1": 0.3, "s2": 0.3}
    out = mixing.mix(t, weights=wish)
    got = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    total = sum(got.values())
    assert "s3" not in got and all(abs(got[s] / total - w) < 0.03 for s, w in wish.items()) and abs(total - 6000) < 400
    again = sorted((r["doc_id"], r["copy_no"]) for r in mixing.mix(t.repartition(7), weights=wish).collect())
    assert again == sorted((r["doc_id"], r["copy_no"]) for r in out.collect())


def test_mixing_odd_inputs(spark, docs, empty):
    out = mixing.mix_rows(docs).select("document.*")
    assert out.columns == docs.columns and {r["fp"] for r in out.collect()} <= {"mine", None}
    assert mixing.mix(empty).count() == 0
    assert mixing.mix(docs.filter("text is null")).count() == 0


# -- 6 bpe -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_bpe_equals_the_library(name):
    from tokenizers import Tokenizer

    own, lib = bpe.load(name), Tokenizer.from_file(bpe.tokenizer_path(name))
    lib.no_truncation()
    lib.no_padding()
    rng = random.Random(1)
    texts = [t or "" for t in TEXTS] + ["ab" * 3000, "the" * 2000, "=" * 4000, "ΑΣ Σ", "İ ½ ² x²", "don't we'll 'S", "<|endof", "\x1c a\x1fb\x85c"]
    texts += ["".join(rng.choice("etaoinshrd ") for _ in range(rng.randint(1, 5000))) for _ in range(20)]
    texts += ["".join(rng.choice("etaoinshrd") for _ in range(6000))]
    for t in texts:
        expected = lib.encode(t, add_special_tokens=False).ids
        ids = own.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == expected
        assert own.decode(ids) == lib.decode(expected, skip_special_tokens=False)


def test_bpe_window_does_not_matter():
    own = bpe.load("byte_bpe_50k.json")
    rng = random.Random(2)
    piece = bytes(rng.choice(b"etaoinshrdl") for _ in range(9000))
    whole = own._merge([own.first[b] for b in piece])
    assert list(own.stream(piece)) == whole


def test_bpe_frame(spark, docs, empty):
    rows = {r["doc_id"]: r for r in docs.select("doc_id", bpe.round_trip(F.col("text")).alias("d")).select("doc_id", "d.*").collect()}
    none = hashlib.sha256(b"").hexdigest()
    assert (rows[0]["n_tokens"], rows[0]["ids_sha256"], rows[0]["decoded_sha256"]) == (0, none, none)
    assert rows[9]["ids"][:4] == (49407).to_bytes(4, "little")
    decoded = docs.select("doc_id", bpe.decode(bpe.encode(F.col("text"))).alias("t")).filter("doc_id = 3").first()["t"]
    assert decoded == "one</w>" and bpe.with_ids(empty).count() == 0


# -- 7 katz ----------------------------------------------------------------------------------------


def _katz(texts, held):
    tokens = [[*WORD.findall((t or "").translate(LOWER)), 0] for t in texts]
    c, b = Counter(), Counter()
    for w, h in zip(tokens, held, strict=True):
        if not h:
            c.update(w)
            b.update(zip([1, *w], w, strict=False))
    mass = sum(c.values()) + 0.5 * (len(c) + 1)
    d = katz.Discounts([sum(k == r for k in b.values()) for r in range(1, katz.GT_MAX + 2)])
    off = lambda k: float(d.discounted(np.array([k]))[0])
    context = defaultdict(dict)
    for (u, v), k in b.items():
        context[u][v] = k
    weight = {u: (1 - sum(map(off, m.values())) / sum(m.values())) / (1 - sum((c[v] + 0.5) / mass for v in m)) for u, m in context.items()}

    def p(u, v):
        base = (c[v] + 0.5) / mass
        m = context.get(u)
        return base if not m else off(m[v]) / sum(m.values()) if v in m else weight[u] * base

    for u in context:
        assert abs(sum(p(u, v) for v in c) + weight[u] * 0.5 / mass - 1) < 1e-9
    return [(len(w), sum(c[v] > 0 for v in w), sum(math.log10((c[v] + 0.5) / mass) for v in w), sum(math.log10(p(u, v)) for u, v in zip([1, *w], w, strict=False))) for w in tokens], sum(c.values())


@pytest.mark.parametrize("block", [40, 10**6])
def test_katz_against_brute_force(spark, docs, monkeypatch, block):
    monkeypatch.setattr(katz, "BLOCK_TOKENS", block)
    stored = _store(docs, spark)
    rows = stored.collect()
    held = [r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1 for r in rows]
    expected, total = _katz([r["text"] for r in rows], held)
    key = lambda x: (x[0] is None, x[0], *(round(v, 6) for v in x[1:]))
    want = sorted(((r["doc_id"], h, n, k, b, s) for r, h, (n, k, b, s) in zip(rows, held, expected, strict=True)), key=key)
    found = sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["base_score"], r["score"]) for r in katz.score_documents(stored).collect()), key=key)
    for a, b in zip(found, want, strict=True):
        assert a[:4] == b[:4] and a[4] == pytest.approx(b[4], rel=1e-9) and a[5] == pytest.approx(b[5], rel=1e-9)
    assert {r["train_tokens"] for r in katz.score_documents(stored).collect()} == {total}


def test_katz_without_training(spark, docs, empty):
    rows = katz.score_documents(_store(docs, spark), F.lit(True)).collect()
    assert all(r["score"] == 0 == r["base_score"] and r["n_known"] == 0 for r in rows) and len(rows) == docs.count()
    assert katz.score_documents(_store(empty, spark)).count() == 0


def test_katz_packing():
    a = np.array([0, 1, 2**63, 2**64 - 1], np.uint64)
    assert [x.tolist() for x in katz.unpack(katz.pack(a, np.zeros(0, np.uint64), np.zeros(3, np.int64)))] == [a.tolist(), [], [0, 0, 0]]


# -- 8 quality -------------------------------------------------------------------------------------


def _surface(text):
    t = text or ""
    w = WORD.findall(t)
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    covered = {i + k for places in at.values() if len(places) > 1 for i in places for k in range(5)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    failed = len(w) < 10 or 100 * len(covered) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered), failed


def test_quality_surface(spark, docs):
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    loops = spark.createDataFrame([(1, "a b c d e f a b c d e g a b c d e"), (2, "a " * 11), (3, "l one\nl one\n \nm\nl one")], "doc_id long, text string")
    for frame in (docs.select("doc_id", "text"), loops):
        for r in quality.surface_rules(frame).collect():
            assert tuple(r[n] for n in names) == _surface(r["text"])


def test_quality_ratio_is_the_formula(spark, docs):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(15, 40)] + [(14, 1, 1), (16, 1, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in quality.quality_rules(docs.select("doc_id", "text"), labels).collect()}
    piece = re.compile(r"[^\W_]+|[^\w\s]+|_+")
    bucket = lambda *p: xxhash_chain(p) % quality.BUCKETS

    def grams(t):
        w = re.findall(r"[a-z0-9é日本üßA-Z]+|[^\sa-z0-9é日本üßA-Z]+", t)
        return [bucket(x) for x in w] + [bucket(*w[i : i + 2]) for i in range(len(w))]

    assert piece
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    raw, target = Counter(), Counter()
    for i, t in rows:
        raw.update(grams(t or ""))
        if i is not None and 15 <= i < 40:
            target.update(grams(t or ""))
    nr, nt, a = sum(raw.values()), sum(target.values()), quality.ALPHA
    for i, t in rows:
        if i is None or not t or not re.fullmatch(r"[a-h ]+", t):
            continue
        g = grams(t)
        score = sum(math.log((target[b] + a) / (nt + a * quality.BUCKETS)) - math.log((raw[b] + a) / (nr + a * quality.BUCKETS)) for b in g) / len(g)
        assert got[i]["llr"] == pytest.approx(score, rel=1e-9)
        assert got[i]["kept"] == (not got[i]["base_failed"] and score >= quality.THRESHOLD)
    assert not got[0]["kept"] and got[0]["llr"] is None


def xxhash_chain(parts):
    """Spark's xxhash64 of several strings: each hash seeds the next."""
    seed = 42
    for p in parts:
        seed = xxhash.xxh64_intdigest(p.encode(), seed % 2**64)
    return seed - 2**64 if seed >> 63 else seed


def test_quality_without_labels(spark, docs, empty):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.quality_rules(docs.select("doc_id", "text"), none).collect()
    assert all(r["kept"] == (not r["base_failed"]) for r in rows if r["llr"] is not None)
    assert quality.quality_rules(empty, none).count() == 0


def test_quality_separates_junk(spark):
    out = queries.op8_quality_rules(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id").collect()
    good = [r["kept"] for r in out if r["quality"] == 1 and not r["base_failed"]]
    bad = [r["kept"] for r in out if r["quality"] == 0 and not r["base_failed"]]
    assert sum(good) / len(good) > 0.99 and sum(bad) / len(bad) < 0.05


# -- 9 token files ----------------------------------------------------------------------------------


@pytest.mark.parametrize("n", [0, 1, 1023, 1025, 20_000])
def test_coder_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 50_257, n), np.full(n, 50_256), (rng.zipf(1.3, n) % 50_257), np.tile([5, 6, 7, 8], n)[:n]):
        blocks = tokenfile.encode_blocks(ids.astype(np.uint32))
        assert np.array_equal(tokenfile.decode_blocks(blocks), ids)


def test_blocks_are_independent_and_checked():
    ids = (np.random.default_rng(1).zipf(1.2, 10_000) % 50_257).astype(np.uint32)
    blocks = tokenfile.encode_blocks(ids)
    assert np.array_equal(tokenfile.decode_blocks(blocks[1:2]), ids[1024:2048])
    assert sum(map(len, blocks)) < 1.7 * len(ids)
    broken = bytearray(blocks[0])
    broken[40] ^= 1
    with pytest.raises(ValueError):
        tokenfile.decode_blocks([bytes(broken)])
    with pytest.raises(ValueError):
        tokenfile.decode_blocks([blocks[0][:-2]])


def test_token_files(spark, docs, empty):
    path = shared_dir(spark, "t")
    tokenfile.write(docs, path)
    lib = tokenfile._tokenizer(tokenfile.BYTE_BPE)
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    at = 0
    got = sorted(map(tuple, tokenfile.read(spark, path).collect()), key=lambda r: r[1])
    for (i, t), row in zip(rows, got, strict=True):
        ids = np.array([*lib.encode(t, add_special_tokens=False).ids, 0], "<u4")
        assert row == (i, at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    nothing = shared_dir(spark, "t")
    tokenfile.write(empty, nothing)
    assert tokenfile.read(spark, nothing).count() == 0


# -- 10 minhash -------------------------------------------------------------------------------------


def test_minhash_report(spark, docs, empty):
    rows = sorted(((r["doc_id"], r["text"] or "") for r in docs.collect()), key=lambda r: (r[0] is None, -(r[0] or 0), r[1]))
    got = minhash.edit_report(docs).collect()
    key = lambda i, h: (i is None, i or 0, h)
    want = sorted((key(i, hashlib.sha256(minhash.edited_text(t, rows[(k + 1) % len(rows)][1]).encode()).hexdigest()), len(t)) for k, (i, t) in enumerate(rows))
    assert sorted((key(r["doc_id"], r["edited_sha256"]), r["n_chars"]) for r in got) == want
    by_text = defaultdict(set)
    for r in got:
        by_text[dict(rows).get(r["doc_id"]) if r["doc_id"] is not None else _prose[3]].add(r["fingerprint"])
    assert all(len(f) == 1 for f in by_text.values())
    assert minhash.edit_report(empty).count() == 0
    one = minhash.edit_report(docs.filter("doc_id = 30")).first()
    assert one["near_next"] == 1.0


def test_signatures_estimate_jaccard():
    rng = random.Random(9)
    words = [f"w{i}" for i in range(5000)]
    a = [rng.choice(words) for _ in range(1500)]
    b = a[:1000] + [rng.choice(words) for _ in range(500)]
    s = minhash.signatures([" ".join(a).encode(), " \n".join(b).encode(), b"", b" "])
    sets = [{tuple(w[max(0, i - 4) : i + 1]) for i in range(len(w))} for w in (a, b)]
    j = len(sets[0] & sets[1]) / len(sets[0] | sets[1])
    assert abs(minhash.likeness(s[:1], s[1:2])[0] - j) < 0.13 and np.array_equal(s[2], s[3])


def test_chunks_do_not_matter(monkeypatch):
    texts = [(t or "").encode() for t in TEXTS]
    whole = minhash.signatures(texts)
    monkeypatch.setattr(minhash, "CHUNK_BYTES", 100)
    assert np.array_equal(minhash.signatures(texts), whole)


def test_similar_classes(spark, docs, empty):
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]
    sets = [{tuple(w[max(0, i - 4) : i + 1]) for i in range(len(w))} for w in (t.encode().split() for _, t in rows)]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in combinations(range(len(rows)), 2):
        u = len(sets[i] | sets[j])
        if rows[i][1] == rows[j][1] or not u or len(sets[i] & sets[j]) / u >= 0.8:
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)].append(d)
    assert Counter(map(tuple, neardup.similar(docs).collect())) == Counter((d, min(least[find(i)])) for i, (d, _) in enumerate(rows) if least[find(i)])
    assert neardup.similar(empty).count() == 0


# -- pipeline ---------------------------------------------------------------------------------------


def test_pipeline_against_its_parts(spark):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    out = corpus_pipeline.run(spark, d)
    docs = spark.read.parquet(f"{d}/documents.parquet")
    good = {r["doc_id"] for r in queries.op8_quality_rules(spark, d).filter("kept").collect()}
    left = docs.filter(F.col("doc_id").isin(sorted(good)))
    spoken = {r["doc_id"]: r for r in langid.identify(left, left.filter(~langid.held_out())).filter("accepted").collect()}
    # near copies: 5-word shingles, a Jaccard similarity of 0.8 or more
    seen: list[tuple[int, set]] = []
    for i, r in sorted(spoken.items()):
        w = r["text"].translate(LOWER).encode().split()
        seen.append((i, {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}))
    parent = {i: i for i, _ in seen}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for (i, f), (j, g) in combinations(seen, 2):
        if 5 * len(f & g) >= 4 * len(f | g):
            a, b = sorted((find(i), find(j)))
            parent[b] = a
    first = {i for i in parent if find(i) == i}
    mixed = mixing.mix(left.filter(F.col("doc_id").isin(sorted(first)))).collect()
    own = bpe.load(bpe.WORD_BPE)
    want = Counter((r["doc_id"], hashlib.sha256(own.encode(r["text"])).hexdigest()) for r in mixed)
    assert Counter((r["doc_id"], r["ids_sha256"]) for r in out.collect()) == want and want


def test_stages_keep_columns(spark, docs):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    stored = _store(docs, spark)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, stored, d).columns == docs.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, stored.limit(0), d).count() == 0
