"""Stateful scans over shuffled chunks against scans of the joined text."""

import datetime
import glob
import random
import re

from pyspark.sql import functions as F

from fenceline.functions import patterns as P
from fenceline.operators import terms as T
from fenceline.sources import readers
from fenceline.plans import catalog
from fenceline.plans import views as V
from fenceline.streaming import alerts, chunks, ordered

ALL = [p.regex for p in P.PII]
SCHEMA = "seq_id BIGINT, chunk_no INT, piece STRING, is_last BOOLEAN"


def cut(rng, text):
    pieces = []
    while text:
        n = rng.choice([1, 1, 2, 3, 5, 8, 40])
        pieces.append(text[:n])
        text = text[n:]
    return pieces


def first_end(text, regexes=ALL):
    for n in range(1, len(text) + 1):
        if any(re.search(r, text[:n]) for r in regexes):
            return n
    return None


def write_files(spark, rng, texts, path, files):
    rows = [
        (s, i, p, i == len(pieces) - 1)
        for s, pieces in ((s, cut(rng, t)) for s, t in enumerate(texts))
        for i, p in enumerate(pieces)
    ]
    rng.shuffle(rows)
    for k in range(files):
        spark.createDataFrame(rows[k::files], SCHEMA).coalesce(1).write.mode("append").parquet(path)


def texts_of(rng, n):
    bits = ["a", "b@", "@", ".", "co", ".co", "-", "123-", "45-", "6789", "4567-", " ", "\n", "é", "d" * 30, "x@y", "_"]
    return ["".join(rng.choice(bits) for _ in range(rng.randint(1, 20))) for _ in range(n)]


def test_scan_equals_joined_text(spark, tmp_path):
    rng = random.Random(13)
    texts = texts_of(rng, 250)
    write_files(spark, rng, texts, str(tmp_path / "in"), 5)
    want = {s: first_end(t) for s, t in enumerate(texts) if first_end(t) is not None}
    for last in (False, True):
        stream = readers.stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=2)
        rows = alerts.drain(chunks.first_completions(stream if last else stream.drop("is_last"))).collect()
        assert len(rows) == len(want) and {r["seq_id"]: r["end"] for r in rows} == want


def test_scan_for_terms(spark, tmp_path):
    rng = random.Random(14)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 40))) for _ in range(120)]
    terms = ["abab", "cab", "bcabc", "xcabx"]
    write_files(spark, rng, texts, str(tmp_path / "in"), 3)
    lex = T.lexicon(spark.createDataFrame([(t,) for t in terms], "term STRING"), T.ENFORCE)
    stream = readers.stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=1)
    rows = alerts.drain(chunks.first_completions(stream, (T.term_pattern(lex),))).collect()
    want = {s: first_end(t, terms) for s, t in enumerate(texts) if first_end(t, terms) is not None}
    assert {r["seq_id"]: r["end"] for r in rows} == want


def test_restart_goes_on_with_its_state(spark, tmp_path):
    source, out, mark = (str(tmp_path / n) for n in ("in", "out", "mark"))

    def arrive(rows):
        spark.createDataFrame(rows, "seq_id BIGINT, chunk_no INT, piece STRING").coalesce(1).write.mode("append").parquet(source)

    def run():
        stream = readers.stream(spark, source, "seq_id BIGINT, chunk_no INT, piece STRING")
        alerts.write_alerts(chunks.first_completions(stream), out, mark).awaitTermination()
        return sorted(tuple(r) for r in spark.read.schema(chunks.ALERT).parquet(out).collect())

    arrive([(1, 0, "a@b"), (1, 2, "o"), (2, 0, "x@" + "d" * 50)])
    assert run() == []
    arrive([(1, 1, ".c"), (2, 1, "e" * 50), (2, 2, ".c")])
    assert run() == [(1, "email", 6, 2)]
    arrive([(1, 3, " c@d.ef"), (2, 3, "om")])
    assert run() == [(1, "email", 6, 2), (2, "email", 105, 3)]


def test_stream_filter(spark, tmp_path):
    df = spark.createDataFrame([(1, "a@b.co"), (2, "x")], "doc_id BIGINT, text STRING")
    df.write.parquet(str(tmp_path / "in"))
    stream = readers.stream(spark, str(tmp_path / "in"), "doc_id BIGINT, text STRING")
    kept = alerts.drain(alerts.violating(stream).select(F.col("doc_id")))
    assert [r[0] for r in kept.collect()] == [1]


TIMED = "seq_id BIGINT, chunk_no INT, piece STRING, is_last BOOLEAN, sent TIMESTAMP"


class Feed:
    """Batches of timed chunks, each followed by a run of the query."""

    def __init__(self, spark, folder, **patience):
        self.spark, self.patience = spark, ordered.Patience(**patience)
        self.source, self.out, self.mark = (str(folder / n) for n in ("in", "out", "mark"))

    def arrive(self, *rows):
        """Rows (seq_id, chunk_no, piece, is_last, second)."""
        made = [(s, n, p, last, datetime.datetime.fromtimestamp(1_700_000_000 + t, datetime.UTC)) for s, n, p, last, t in rows]
        self.spark.createDataFrame(made, TIMED).coalesce(1).write.mode("append").parquet(self.source)
        with ordered.rocksdb(self.spark):
            stream = readers.stream(self.spark, self.source, TIMED)
            alerts.write_alerts(ordered.first_completions(stream, "0 seconds", self.patience), self.out, self.mark).awaitTermination()
        schema = "seq_id BIGINT, kind STRING, pattern STRING, end BIGINT, chunk_no INT, upto INT"
        return sorted(((r["seq_id"], r["kind"], r["end"], r["chunk_no"], r["upto"]) for r in self.spark.read.schema(schema).parquet(self.out).collect()), key=str)


def test_lost_chunks_are_given_up(spark, tmp_path):
    feed = Feed(spark, tmp_path, gap=10_000)
    assert feed.arrive((1, 0, "a@b", False, 0), (1, 2, "x@y.co", False, 2), (2, 0, "a@b", False, 0)) == []
    # Within patience the lost chunk may still come; it does for the second sequence.
    assert feed.arrive((2, 2, "m", True, 5), (2, 1, ".co", False, 5)) == [(2, "match", 6, 1, None)]
    # The match does not reach over the gap; behind it the state starts anew, also after a restart.
    gone = [(1, "gap", None, 1, 1), (1, "match", 9, 2, None), (2, "match", 6, 1, None)]
    assert feed.arrive((9, 0, "", True, 100)) == gone
    # Late, and more of a sequence that has reported: nothing.
    assert feed.arrive((1, 1, ".com", False, 101), (1, 3, " p@q.de", True, 102)) == gone


def test_many_waiting_chunks_end_a_gap(spark, tmp_path):
    feed = Feed(spark, tmp_path, gap=10**9, most_waiting=3)
    early = [(1, n, "z", False, n) for n in range(2, 5)]
    assert feed.arrive(*early) == []
    assert feed.arrive((1, 6, "a@b.co", True, 6)) == [(1, "gap", None, 0, 1), ]
    assert feed.arrive((1, 5, "", False, 7)) == [(1, "gap", None, 0, 1), (1, "match", 9, 6, None)]


def test_late_chunk_of_a_finished_sequence(spark, tmp_path):
    feed = Feed(spark, tmp_path, gap=1_000, idle=50_000)
    feed.arrive((1, 0, "a", False, 0), (1, 2, "c", True, 1))
    ended = feed.arrive((9, 0, "", True, 10))
    assert ended == [(1, "gap", None, 1, 1)]
    assert feed.arrive((1, 1, "a@b.co", False, 11)) == ended
    # Given up after a while without news.
    assert feed.arrive((9, 0, "", True, 500)) == ended


def test_terms_across_chunks_equal_the_batch(spark, tmp_path):
    rng = random.Random(15)
    texts = ["".join(rng.choice("abc ") for _ in range(rng.randint(1, 60))) for _ in range(80)]
    terms = ["abab", "cab", "bcabc", "xcabx", "a" * 9, "bb"]
    rows = []
    for s, t in enumerate(texts):
        pieces = cut(rng, t)
        rows += [(s, i, p, i == len(pieces) - 1, datetime.datetime.fromtimestamp(1_700_000_000 + i, datetime.UTC)) for i, p in enumerate(pieces)]
    rng.shuffle(rows)
    for k in range(4):
        spark.createDataFrame(rows[k::4], TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    lex = T.lexicon(spark.createDataFrame([(t,) for t in terms], "term STRING"), T.ENFORCE, 0)
    with ordered.rocksdb(spark):
        stream = readers.stream(spark, str(tmp_path / "in"), TIMED, files_per_trigger=1)
        alerts.write_term_completions(stream, lex, str(tmp_path / "out"), str(tmp_path / "mark"), delay="1 day").awaitTermination()
    got = spark.read.schema("seq_id BIGINT, end BIGINT, chunk_no INT").parquet(str(tmp_path / "out")).collect()
    want = {s: first_end(t, terms) for s, t in enumerate(texts) if first_end(t, terms) is not None}
    assert len(got) == len(want) and {r["seq_id"]: r["end"] for r in got} == want


def test_filter_queries_read_a_table_of_part_files(spark, tmp_path):
    rows = [(1, "a@b.co moron"), (2, "clean"), (3, "idiot"), (4, "555-12-1234")]
    table = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    table.repartition(3).write.parquet(str(tmp_path / "parts" / "documents.parquet"))
    (tmp_path / "one").mkdir()
    table.toPandas().to_parquet(tmp_path / "one" / "documents.parquet")
    for sf in (str(tmp_path / "parts"), str(tmp_path / "one")):
        assert sorted(r[0] for r in catalog.stream_filter(spark, sf).collect()) == [1, 4]
        assert sorted(r[0] for r in catalog.stream_filter_terms(spark, sf).collect()) == [1, 3]


def test_early_chunks_take_one_write_a_batch():
    class Value:
        held = None

        def exists(self):
            return self.held is not None

        def get(self):
            return self.held

        def update(self, v):
            self.held = v

        def clear(self):
            self.held = None

    class Listed:
        def __init__(self):
            self.rows, self.calls = [], 0

        def get(self):
            return iter(self.rows)

        def put(self, rows):
            self.rows, self.calls = list(rows), self.calls + 1

        def appendList(self, rows):
            self.rows, self.calls = self.rows + list(rows), self.calls + 1

        def clear(self):
            self.rows, self.calls = [], self.calls + 1

    class Handle:
        def getValueState(self, *_):
            return Value()

        def getListState(self, *_):
            return Listed()

        def registerTimer(self, _):
            pass

        def deleteTimer(self, _):
            pass

    carrier = ordered._Carrier(3, ordered.Patience())
    carrier.init(Handle())
    got = list(carrier._go_on((1,), {n: (str(n), False, n) for n in range(1, 9, 2)}, 0))
    assert not got and carrier.early.calls == 1 and len(carrier.early.rows) == 4
    got = list(carrier._go_on((1,), {n: (str(n), False, n) for n in (0, 2)}, 0))
    assert list(got[0].chunk_no) == [0, 1, 2, 3] and carrier.early.calls == 2
    assert [r[0] for r in carrier.early.rows] == [5, 7]


def test_sequences_that_share_a_state(spark, tmp_path):
    rng = random.Random(16)
    texts = texts_of(rng, 120)
    rows = []
    for s, t in enumerate(texts):
        pieces = cut(rng, t)
        # A NULL number is a sequence of its own; numbers of others stay whole.
        rows += [(None if s == 7 else 2**60 + s, i, p, i == len(pieces) - 1) for i, p in enumerate(pieces)]
    rng.shuffle(rows)
    for k in range(5):
        spark.createDataFrame(rows[k::5], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    want = {None if s == 7 else 2**60 + s: first_end(t) for s, t in enumerate(texts) if first_end(t) is not None}
    ending = {}  # the chunk that holds the completing character
    for s, n, p, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        start = ending.get(s, (0, None))[0]
        ending[s] = start + len(p), n if s in want and start < want[s] <= start + len(p) else ending.get(s, (0, None))[1]
    for last in (False, True):
        stream = readers.stream(spark, str(tmp_path / "in"), SCHEMA, files_per_trigger=2)
        found = chunks.first_completions(stream if last else stream.drop("is_last"), buckets=3)
        got = alerts.drain(found).collect()
        assert len(got) == len(want) and {r["seq_id"]: r["end"] for r in got} == want
        assert all(r["chunk_no"] == ending[r["seq_id"]][1] for r in got)


def test_states_are_fewer_than_sequences(spark, tmp_path):
    rows = spark.range(3 * chunks.BUCKETS).selectExpr("id AS seq_id", "0 AS chunk_no", "'a' AS piece")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = readers.stream(spark, str(tmp_path / "in"), "seq_id BIGINT, chunk_no INT, piece STRING")
    query = alerts.write_alerts(chunks.first_completions(stream), str(tmp_path / "out"), str(tmp_path / "mark"))
    query.awaitTermination()
    held = [p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]]
    assert 0 < max(held) <= chunks.BUCKETS


def test_a_text_is_cut_once(spark):
    docs = spark.createDataFrame([(1, "x" * 150), (2, ""), (3, None), (4, "é\n" * 32)], "doc_id BIGINT, text STRING")
    cut_ = V.chunks(docs)
    plan = cut_._jdf.queryExecution().executedPlan().toString()
    assert plan.count("regexp_extract_all") == 1
    got = sorted((r["seq_id"], r["chunk_no"], len(r["piece"]), r["is_last"]) for r in cut_.collect())
    assert got == [(1, 0, 64, False), (1, 1, 64, False), (1, 2, 22, True), (4, 0, 64, True)]


def test_chunks_are_sent_by_as_many_tasks_as_a_shuffle_has(spark, tmp_path, monkeypatch):
    rows = [(i, "word " * 100 + "a@b.co" * (i % 2)) for i in range(40)]
    spark.createDataFrame(rows, "doc_id BIGINT, text STRING").write.parquet(str(tmp_path / "documents.parquet"))
    asked, stream, before = [], readers.stream, spark.conf.get("spark.sql.shuffle.partitions")

    def watched(session, path, *args, **more):
        asked.append((len(glob.glob(f"{path}/part-*")), more["files_per_trigger"]))
        return stream(session, path, *args, **more)

    monkeypatch.setattr(readers, "stream", watched)
    spark.conf.set("spark.sql.shuffle.partitions", "9")
    try:
        got = {r["seq_id"]: r["end_first"] for r in catalog.stream_scan(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == {i: 506 for i in range(1, 40, 2)}
    assert asked == [(9, 5)]


def test_sequences_in_order_share_states(spark, tmp_path):
    rng = random.Random(17)
    rows = []
    for s, t in enumerate(texts_of(rng, 60)):
        pieces = cut(rng, t)
        lost = rng.randrange(len(pieces)) if s % 3 == 0 else None
        # A NULL number is a sequence of its own; numbers of others stay whole.
        rows += [(None if s == 7 else 2**60 + s, i, p, i == len(pieces) - 1, datetime.datetime.fromtimestamp(1_700_000_000 + i, datetime.UTC)) for i, p in enumerate(pieces) if i != lost]
    rng.shuffle(rows)
    for k in range(3):
        spark.createDataFrame(rows[k::3], TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    end = datetime.datetime.fromtimestamp(1_710_000_000, datetime.UTC)
    spark.createDataFrame([(-1, 0, "", True, end)], TIMED).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        with ordered.rocksdb(spark):
            stream = readers.stream(spark, str(tmp_path / "in"), TIMED, files_per_trigger=1)
            found = ordered.first_completions(stream, "1 day", buckets=3)
            query = alerts.write_alerts(found, str(tmp_path / "out"), str(tmp_path / "mark"))
            query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    got = [(r["seq_id"], r["kind"], r["end"], r["chunk_no"] if r["kind"] == "gap" else None) for r in spark.read.schema(found.schema).parquet(str(tmp_path / "out")).collect()]
    want = set()
    for s in {r[0] for r in rows}:
        came = {r[1]: r[2] for r in rows if r[0] == s}
        gap = next((n for n in range(max(came)) if n not in came), None)
        ahead = "".join(came[n] for n in sorted(came) if gap is None or n < gap)
        behind = "".join(came[n] for n in sorted(came) if gap is not None and n > gap)
        if first_end(ahead):
            want.add((s, "match", first_end(ahead), None))
        elif gap is not None:
            want.add((s, "gap", None, gap))
            if first_end(behind):
                want.add((s, "match", len(ahead) + first_end(behind), None))
    assert sorted(got, key=str) == sorted(want, key=str) and {r[1] for r in want} == {"gap", "match"}
    # Three states and the NULL's, each with its timer in two orders.
    assert 0 < max(p["stateOperators"][0]["numRowsTotal"] for p in query.recentProgress if p["stateOperators"]) <= 12


def test_queries_in_order_share_states_by_default(spark):
    source = spark.readStream.format("rate").load().selectExpr("value AS seq_id", "0 AS chunk_no", "'' AS piece", "timestamp AS sent")
    for out in (ordered.first_completions(source), ordered.carried(source, 3)):
        assert "pmod(xxhash64(seq_id" in out._jdf.queryExecution().analyzed().toString()
