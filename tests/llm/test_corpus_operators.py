"""Operators over whole tables against plain versions, on awkward rows and on the given tables."""

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from llm_tables import SF, rows_of
from pyspark.sql import functions as F

import __spark_entry__ as entry
from compare import compare, connect
from fenceline import session
from fenceline.llm import common, components, mixing, nearest, oracle, sharding, simhash, suffixes


@pytest.mark.parametrize("name", list(oracle.SQL))
def test_query_against_sql(spark, name):
    assert compare(spark, connect(SF), name, SF) > 0


# --- helpers ---------------------------------------------------------------------------------------


def test_gapless_ranks(spark, monkeypatch):
    monkeypatch.setattr(common, "CELL_ROWS", 10)
    df = spark.range(500).select((F.col("id") % 3).alias("g"), (F.col("id") % 50).alias("o"))
    got = defaultdict(list)
    for r in common.gapless(df, ["g"], ["o"], "rank", 500).collect():
        got[r["g"]].append(r["rank"])
    assert all(sorted(v) == list(range(len(v))) for v in got.values()) and sum(map(len, got.values())) == 500


def plain_components(n, pairs):
    label = list(range(n))

    def top(x):
        while label[x] != x:
            label[x] = label[label[x]]
            x = label[x]
        return x

    for a, b in pairs:
        a, b = top(a), top(b)
        label[max(a, b)] = min(a, b)
    return [top(x) for x in range(n)]


@pytest.mark.parametrize("kind", ["path", "star", "random", "none"])
def test_components(spark, kind):
    rng = np.random.default_rng(1)
    pairs = {"path": [(i, i + 1) for i in range(60)], "star": [(0, i) for i in range(1, 40)], "none": [(3, 3)]}.get(kind)
    pairs = pairs or [tuple(map(int, rng.integers(0, 200, 2))) for _ in range(120)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    want = plain_components(200, pairs)
    linked = {x for a, b in pairs if a != b for x in (a, b)}
    assert got == {x: want[x] for x in linked}


# --- mixing ----------------------------------------------------------------------------------------


def test_mixing_on_awkward_rows(spark, docs, empty):
    rates = mixing.rates(docs, {"src0": 2.0, "src1": 1.0, None: 1.0}, total=40_000.0)
    by_source = {r["source"]: r for r in rates.collect()}
    assert by_source["src2"]["rate"] == 0.0
    assert sum(r["rate"] * r["size"] for r in by_source.values()) == pytest.approx(40_000)
    counts = mixing.counted(docs, rates).select("row.*", "count").collect()
    assert len(counts) == docs.count() and all(r["count"] == 0 for r in counts if r["source"] == "src2")
    copies = mixing.mixed(docs, rates).select("row.doc_id", "copy", "count", "order_key").collect()
    assert len(copies) == sum(r["count"] for r in counts)
    assert [r["order_key"] for r in copies] == sorted(r["order_key"] for r in copies)
    assert mixing.mixed(empty, mixing.rates(empty)).collect() == []
    assert mixing.mixed(docs, mixing.rates(docs, {})).collect() == []


@pytest.mark.parametrize("rate", [0.2, 1.0, 7.5, 900.0])
def test_counts_follow_the_distribution(spark, rate):
    own = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("a").alias("source"), F.lit("t").alias("text"))
    counts = [r["count"] for r in mixing.counted(own, spark.createDataFrame([("a", 1, rate)], "source string, size long, rate double")).select("count").collect()]
    assert np.mean(counts) == pytest.approx(rate, rel=0.08)
    assert np.var(counts) == pytest.approx(rate, rel=0.15)


# --- suffixes --------------------------------------------------------------------------------------


def plain_spans(texts, length):
    seen = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        mark, stop = bytearray(len(t)), 0
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                for j in range(max(i, stop), i + length):
                    mark[j] = 1
                stop = i + length
        runs = sum(1 for i in range(len(t)) if mark[i] and (not i or not mark[i - 1]))
        out.append((len(t), sum(mark), runs, hashlib.sha256(bytes(b for b, m in zip(t, mark, strict=True) if not m)).hexdigest()))
    return out


@pytest.mark.parametrize("batches, many", [(1, 50_000), (3, 50_000), (7, 0)])
def test_suffixes_on_awkward_rows(spark, docs, empty, batches, many):
    rows = docs.select("doc_id", "text").collect()
    got = suffixes.cleaned(docs, 50, 20, batches, many).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    want = plain_spans([(r["text"] or "").encode() for r in rows], 50)
    assert Counter(map(tuple, got.collect())) == Counter((r["doc_id"], *w) for r, w in zip(rows, want, strict=True))
    assert suffixes.cleaned(empty, 50, 20, batches, many).collect() == []


def test_suffixes_on_periodic_and_random_bytes(spark):
    rng = np.random.default_rng(2)
    texts = ["".join("ab"[x] for x in rng.integers(0, 2, 400)) for _ in range(30)]
    texts += ["ab" * 300, "a" * 299, "aab" * 200, texts[0][17:200] + texts[1][5:250], texts[2] * 2]
    own = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for length, gram in ((12, 5), (40, 16), (3, 3)):
        got = suffixes.cleaned(own, length, gram).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256))
        want = plain_spans([t.encode() for t in texts], length)
        assert {r[0]: tuple(r)[1:] for r in got.collect()} == dict(enumerate(want))


def test_long_texts_in_parts(spark, docs, monkeypatch):
    monkeypatch.setattr(suffixes, "CHUNK", 97)
    rows = docs.select("doc_id", "text").collect()
    got = suffixes.cleaned(docs, 50, 20).select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("h"))
    want = plain_spans([(r["text"] or "").encode() for r in rows], 50)
    assert Counter(map(tuple, got.collect())) == Counter((r["doc_id"], *w) for r, w in zip(rows, want, strict=True))


def test_levels_grow_geometrically(spark):
    index = suffixes.Index()
    sizes = []
    for b in range(7):
        index.add(spark.createDataFrame([(b,), (b + 1,), (100 + b,)], "key long"))
        sizes.append([n for n, _ in index.levels])
    assert sizes == [[1], [1, 1], [2, 1], [2, 1, 1], [4, 1], [4, 1, 1], [4, 2, 1]]
    assert sorted(r["key"] for r in index.repeated().collect()) == list(range(1, 7))


def test_suffixes_on_given_documents(spark):
    rows = rows_of(spark, "documents", "doc_id", "text")
    got = {r[0]: r for r in entry.queries()["op2_suffix_index_dedup"](spark, SF).collect()}
    want = plain_spans([(t or "").encode() for _, t in rows], 200)
    for (i, _), w in zip(rows, want, strict=True):
        r = got[i]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == w


# --- sharding --------------------------------------------------------------------------------------


def test_flows_move_as_little_as_possible():
    rng = np.random.default_rng(4)
    for _ in range(30):
        supply = [int(x) for x in rng.integers(0, 100, rng.integers(1, 8))]
        demand = sharding.capacities(sum(supply), int(rng.integers(1, 8)))
        moves = sharding.flows(supply, demand)
        assert all(sum(v for (i, _), v in moves.items() if i == k) == s for k, s in enumerate(supply))
        assert all(sum(v for (_, j), v in moves.items() if j == k) == d for k, d in enumerate(demand))
        stay = sum(min(s, d) for s, d in zip(supply, demand, strict=False))
        assert sum(v for (i, j), v in moves.items() if i != j) == sum(supply) - stay


def shard_laws(rows, shards):
    slots, sizes = defaultdict(list), Counter({s: 0 for s in range(shards)})
    for r in rows:
        slots[r["shard"]].append(r["slot"])
        sizes[r["shard"]] += r["size"]
    assert all(sorted(v) == list(range(len(v))) for v in slots.values()) and set(slots) <= set(range(shards))
    return max(sizes.values()) - min(sizes.values())


def test_resharding(spark, docs, empty, tmp_path, monkeypatch):
    monkeypatch.setattr(sharding, "BLOCK_ROWS", 4)
    old = F.pmod(F.xxhash64("source"), F.lit(3))
    moved = sharding.resharded(docs, old, 3, 5).cache()
    rows = moved.select("row.doc_id", "row.text", "size", "text_crc32", "old_shard", "shard", "slot").collect()
    assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter(map(tuple, docs.select("doc_id", "text").collect()))
    for r in rows:
        data = (r["text"] or "").encode()
        assert r["size"] == len(data) + 8 and r["text_crc32"] == zlib.crc32(data)
    assert shard_laws(rows, 5) <= 2 * max(r["size"] for r in rows)
    sharding.rewrite(moved, str(tmp_path / "out"))
    changed = {r["shard"] for r in sharding.affected(moved).collect()}
    again = spark.read.parquet(str(tmp_path / "out"))
    assert set(again.columns) == {*docs.columns, "shard", "slot"}
    assert Counter((r["shard"], r["slot"], r["doc_id"]) for r in again.collect()) == Counter((r["shard"], r["slot"], r["doc_id"]) for r in rows if r["shard"] in changed)
    assert sharding.resharded(empty, old, 3, 5).collect() == []


def test_resharding_of_given_documents(spark):
    got = entry.queries()["op4_flow_resharding"](spark, SF).collect()
    assert len(got) == len(rows_of(spark, "documents", "doc_id"))
    assert shard_laws(got, 24) <= 2 * max(r["size"] for r in got)


# --- SimHash ---------------------------------------------------------------------------------------


def plain_fingerprint(text, width=4):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def test_fingerprints(docs, monkeypatch):
    monkeypatch.setattr(simhash, "AT_ONCE", 7)
    for r in docs.select("text").collect():
        assert simhash.fingerprint((r["text"] or "").encode()) == plain_fingerprint(r["text"])


@pytest.mark.parametrize("bits", [3, 4, 6])
def test_every_close_pair_shares_a_probe(bits):
    rng = np.random.default_rng(bits)
    segments = 2 * bits + 1
    at, ways = simhash.borders(segments), simhash.probes(segments, bits)
    for _ in range(300):
        x = sum(1 << int(b) for b in rng.choice(64, rng.integers(0, bits + 1), replace=False))
        agree = [x >> at[s] & ((1 << (at[s + 1] - at[s])) - 1) == 0 for s in range(segments)]
        a = int(rng.integers(0, 1 << 63))
        assert any(
            any(all(agree[(s + p) % segments] for p in way) for way in ways)
            and len(simhash.within(np.array([a], "u8"), np.array([a ^ x], "u8"), np.array([s]), bits))
            for s in range(segments)
        )


@pytest.mark.parametrize("block", [4096, 3])
def test_links_connect_as_all_pairs_do(spark, block):
    rng = np.random.default_rng(9)
    fps = [int(x) for x in rng.integers(0, 1 << 62, 40)]
    for base in (fps[0], fps[1]):  # dense groups, and chains of small steps
        for _ in range(60):
            fps.append(base ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 6), replace=False)))
    fps = sorted({x - (1 << 64) if x >> 63 else x for x in fps})
    pairs = [(i, j) for i in range(len(fps)) for j in range(i) if ((fps[i] ^ fps[j]) & ((1 << 64) - 1)).bit_count() <= 4]
    want = plain_components(len(fps), pairs)
    number = {x: i for i, x in enumerate(fps)}
    found = simhash.links(spark.createDataFrame([(x,) for x in fps], "fp long"), block=block).collect()
    for r in found:
        assert ((r["a"] ^ r["b"]) & ((1 << 64) - 1)).bit_count() <= 64
    assert plain_components(len(fps), [(number[r["a"]], number[r["b"]]) for r in found]) == want


def test_probe_keys_are_not_broadcast_by_size(spark, tmp_path):
    """A small table of fingerprints makes 45 times as many keys, which Spark takes for as small."""
    spark.range(500).select(F.xxhash64("id").alias("fp")).write.parquet(str(tmp_path / "fps"))
    found = simhash.links(spark.read.parquet(str(tmp_path / "fps")))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def plain_clusters(rows):
    fps = [plain_fingerprint(t) for _, t in rows]
    known = sorted(set(fps))
    pairs = [(i, j) for i in range(len(known)) for j in range(i) if (known[i] ^ known[j]).bit_count() <= 4]
    root = plain_components(len(known), pairs)
    roots = [root[known.index(f)] for f in fps]
    least = {}
    for (i, _), r in zip(rows, roots, strict=True):
        if i is not None:
            least[r] = min(least.get(r, i), i)
    return fps, roots, [least.get(r) for r in roots]


def test_clusters_on_awkward_rows(docs, empty):
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    fps, roots, least = plain_clusters(rows)
    got = simhash.clustered(docs).collect()
    assert Counter((r["doc_id"], r["fp"] % (1 << 64), r["component_id"]) for r in got) == Counter(
        (i, f, c) for (i, _), f, c in zip(rows, fps, least, strict=True)
    )
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns and kept.count() == len(set(roots))
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({r: c for r, c in zip(roots, least, strict=True)}.values())
    assert simhash.clustered(empty).collect() == [] and simhash.one_of_each(empty).collect() == []


def test_clusters_of_given_documents(spark):
    rows = rows_of(spark, "documents", "doc_id", "text")
    fps, _, least = plain_clusters(rows)
    got = {r["doc_id"]: (int(r["fingerprint"], 16), r["component_id"]) for r in entry.queries()["op5_pigeonring_simhash"](spark, SF).collect()}
    assert got == {i: (f, c) for (i, _), f, c in zip(rows, fps, least, strict=True)}


# --- nearest neighbours ----------------------------------------------------------------------------


def plain_nearest(rows, queries, k):
    out = {}
    for q, v in rows:
        if queries(q):
            score = [(-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for i, w in rows if i != q]
            out[q] = [(i, -s) for s, i in sorted((round(s, 12), i) for s, i in score)[:k]]
    return out


def test_nearest_on_awkward_vectors(spark):
    rng = np.random.default_rng(5)
    good = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(60)]
    good += [(60 + i, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) for i in range(9)]  # ties
    bad = [(200, None), (201, [0.0] * 6), (202, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (203, [float("nan")] * 6), (204, [float("inf")] + [0.0] * 5), (205, []), (206, [1.0]), (None, [1.0] * 6)]
    own = spark.createDataFrame([(i, v, 1.0) for i, v in good + bad], "vec_id long, embedding array<double>, score double")
    got = defaultdict(list)
    for r in nearest.searched(own, "id % 3 = 0", probes=99).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], pytest.approx(r["score"])))
    assert got == plain_nearest([(i, np.array(v)) for i, v in good], lambda i: i % 3 == 0, 5)
    # One list only is looked into, and those who find too little look into all.
    few = nearest.searched(own, "id % 3 = 0", k=20, probes=1)
    assert {r["count"] for r in few.groupBy("query_id").count().collect()} == {20}
    assert nearest.searched(own.where("vec_id < 3"), "id = 0").count() == 2
    assert nearest.searched(own.where("false"), "true").collect() == []
    assert nearest.searched(own.where("vec_id >= 200"), "true").count() == 0


def test_repeated_ids_and_copies_are_rows_of_their_own(spark):
    rng = np.random.default_rng(9)
    vectors = [(0, rng.standard_normal(6)), (0, rng.standard_normal(6)), *((i, rng.standard_normal(6)) for i in range(1, 30))]
    vectors.append((50, vectors[5][1]))
    vectors.append((50, vectors[5][1]))  # a copy of a query, and of another row
    own = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in vectors], "vec_id long, embedding array<double>")
    want = []
    for place, (q, v) in enumerate(vectors):
        if q % 50 == 0:
            score = [(-float(np.dot(v, w) / (np.linalg.norm(v) * np.linalg.norm(w))), i) for k, (i, w) in enumerate(vectors) if k != place]
            want += [(q, rank, i) for rank, (_, i) in enumerate(sorted((round(x, 12), i) for x, i in score)[:5], 1)]
    for probes in (1, 99):
        got = [(r["query_id"], r["rank"], r["vec_id"]) for r in nearest.searched(own, "id % 50 = 0", probes=probes).collect()]
        assert len(got) == 20 and (probes == 1 or sorted(got) == sorted(want))
    near = [r for r in nearest.searched(own, "id = 50", probes=99).collect() if r["rank"] <= 2]
    assert sorted(r["vec_id"] for r in near) == [4, 4, 50, 50]


def test_a_list_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART_ROWS", 7)
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.standard_normal(20)]) for i in range(90)]
    got = nearest.searched(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "id % 9 = 0", probes=99).orderBy("query_id", "rank").collect()
    want = plain_nearest([(i, np.array(v)) for i, v in rows], lambda i: i % 9 == 0, 5)
    assert [(r["query_id"], r["vec_id"]) for r in got] == [(q, i) for q in sorted(want) for i, _ in want[q]]


def test_recall_on_given_vectors(spark):
    rows = [(i, np.array(v, dtype=float)) for i, v in rows_of(spark, "embeddings", "vec_id", "embedding")]
    want = plain_nearest(rows, lambda i: i % 50 == 0, 5)
    got = defaultdict(set)
    for r in entry.queries()["op9_adaptive_scan"](spark, SF).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = sum(len(got[q] & {i for i, _ in v}) for q, v in want.items())
    assert set(got) == set(want) and hits >= 0.9 * sum(map(len, want.values()))


def test_abandoned_rows_are_far(spark):
    rng = np.random.default_rng(8)
    v = rng.standard_normal((3000, 64))
    turned = nearest.unit(v) @ nearest.rotation(64)
    blocks = [np.ascontiguousarray(turned[:, d : d + 16]) for d in range(0, 64, 16)]
    hits = 0
    for q in range(20):
        ids, _ = nearest.scan(blocks, np.arange(3000), np.arange(3000), v, turned[q], q, v[q], 5)
        score = v @ v[q] / np.linalg.norm(v, axis=1)
        score[q] = -math.inf
        hits += len(set(ids.tolist()) & set(np.argsort(-score)[:5].tolist()))
    assert hits >= 95


def test_texts_that_agree_in_one_hash_are_told_apart(spark):
    # Two texts with one XXH64 of seed 42: the second stripe makes up for the first.
    p1, p2, all_ = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, (1 << 64) - 1

    def after(word):
        v = (42 + p1 + p2 + word * p2) & all_
        return ((v << 31 | v >> 33) * p1) & all_

    a = bytes(range(33, 97)) * 4
    first, second = (int.from_bytes(a[k : k + 8], "little") for k in (0, 32))
    other = first ^ 1
    made_up = (second + (after(first) - after(other)) * pow(p2, -1, 1 << 64)) & all_
    b = other.to_bytes(8, "little") + a[8:32] + made_up.to_bytes(8, "little") + a[40:]
    docs = spark.createDataFrame([(bytearray(a),), (bytearray(b),)], "text binary").select(F.col("text").cast("string").alias("text"))
    one, two = suffixes._texts(docs, "text").collect()
    assert one["text"] != two["text"] and one["t1"] == two["t1"] and one["t2"] != two["t2"]


@pytest.fixture
def shuffled(spark, monkeypatch):
    """No broadcast by size, no adaptive splitting, so that a plan has to split hot keys itself."""
    before = {k: spark.conf.get(k) for k in ("spark.sql.adaptive.enabled", "spark.sql.autoBroadcastJoinThreshold")}
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    monkeypatch.setattr(session, "BROADCAST_MAX_ROWS", 100)
    yield spark
    for k, v in before.items():
        spark.conf.set(k, v)


def largest_part(df):
    sizes = [r["n"] for r in df.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n")).collect()]
    return max(sizes) / (sum(sizes) / len(sizes))


def test_a_star_and_a_frequent_fingerprint_are_split(shuffled, monkeypatch):
    spark = shuffled
    star = spark.range(1, 20_001, 1, 8).select(F.col("id").alias("a"), F.lit(0).cast("long").alias("b"))
    found = components.components(star)
    assert found.count() == 20_001 and found.select("root").distinct().count() == 1
    near = star.unionByName(star.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = near.groupBy("a").agg(F.min("b").alias("_m"))
    assert largest_part(session.lookup_join(near, least, "a")) <= 2
    signed = spark.range(0, 20_000, 1, 8).select(F.col("id").alias("doc_id"), F.when(F.col("id") < 18_000, 5).otherwise(F.col("id")).alias("fp"))
    monkeypatch.setattr(simhash, "fingerprints", lambda *a: signed.withColumn("row_hash", F.xxhash64("doc_id")))
    clusters = simhash.clustered(spark.range(1), bits=0)
    assert clusters.count() == 20_000
    assert largest_part(clusters) <= 2
