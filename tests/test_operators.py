"""Change-log operators against a dict that replays operations one by one, and hand-written cases."""

import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from tidelog.functions import fixtures, scalars
from tidelog.operators import batch, bloom, compaction, cursor, manifest, merge, ranges, resolve
from tidelog.stats import percentiles

LOG = "cf_id int, user_key binary, seq long, op int, value binary"


def make(spark, rows, cf=0):
    data = [(cf, bytearray(k), s, op, None if v is None else bytearray(v)) for s, (op, k, v) in enumerate(rows, 1)]
    return spark.createDataFrame(data, LOG)


def live(df):
    return {bytes(r["user_key"]): bytes(r["value"]) for r in df.collect()}


def random_ops(seed, n=300, merges=True):
    r = random.Random(seed)
    keys = [bytes(r.randrange(256) for _ in range(r.randint(1, 6))) for _ in range(25)] + [b"\x00", b"\xff", b"a\x00b", b""]
    for _ in range(n):
        op = r.choice([0, 1, 1, 2] if merges else [0, 1, 1])
        yield op, r.choice(keys), None if op == 0 else str(r.randint(-50, 50)).encode() if r.random() < 0.9 else r.choice([b"", b"x", b" 7", b"+1", b"99999999999999999999"])


def replay(rows, full, upto=None):
    """Dict model: base and operands of each key."""
    state = {}
    for s, (op, k, v) in enumerate(rows, 1):
        if upto and s > upto:
            break
        if op == 2 and full:
            base, ops, _ = state.get(k, (None, [], True))
            state[k] = (base, [*ops, v], False)
        else:
            state[k] = (v if op else None, [], op == 0)
    return {k: full(b, o) if o else b for k, (b, o, dead) in state.items() if not dead}


def number(x):
    import re

    ok = x is not None and re.fullmatch(rb"[+-]?[0-9]+", x) and -(1 << 63) <= int(x) < 1 << 63
    return int(x) if ok else 0


def counter(base, ops):
    return str(number(base) + sum(map(number, ops))).encode()


def append(base, ops):
    joined = b",".join(ops)
    return joined if not base else base + b"," + joined


@pytest.mark.parametrize("seed", range(3))
def test_resolve_and_fold_equal_a_replay(spark, seed):
    rows = list(random_ops(seed))
    log = make(spark, rows)
    assert live(resolve.latest_wins(log)) == replay(rows, None)
    assert live(resolve.latest_wins(log, snapshot=150)) == replay(rows, None, 150)
    assert live(merge.fold(log, merge.CounterMerge())) == replay(rows, counter)
    assert live(merge.fold(log, merge.CounterMerge(), snapshot=99)) == replay(rows, counter, 99)
    assert live(merge.fold(log, merge.StringAppendMerge())) == replay(rows, append)


@pytest.mark.parametrize("seed", range(2))
def test_compaction_changes_no_read(spark, seed):
    rows = list(random_ops(seed, merges=False))
    log = make(spark, rows)
    older, newer = log.filter("seq <= 150"), log.filter("seq > 150")
    mixed = older.unionByName(compaction.compact(newer, output_level=1))
    assert live(resolve.latest_wins(mixed)) == replay(rows, None)
    bottom = compaction.compact(log, output_level=6)
    assert live(bottom) == replay(rows, None) and bottom.filter("op = 0").count() == 0
    assert live(compaction.sorted_runs(bottom, 4)) == replay(rows, None)
    assert live(resolve.latest_wins(compaction.flush(log))) == replay(rows, None)


def test_hand_written_cases(spark):
    a = b"a"
    assert live(resolve.latest_wins(make(spark, [(1, a, b"1"), (0, a, None), (1, a, b"2")]))) == {a: b"2"}
    dead = make(spark, [(1, a, b"1"), (0, a, None)])
    assert live(resolve.latest_wins(dead)) == {} and resolve.history(dead).count() == 2
    assert live(resolve.latest_wins(make(spark, [(1, a, b"")]))) == {a: b""}
    assert compaction.compact(dead, output_level=6).count() == 0 and compaction.compact(dead, output_level=1).collect()[0]["op"] == 0
    c = merge.CounterMerge()
    assert live(merge.fold(make(spark, [(1, a, b"10"), (2, a, b"5"), (2, a, b"-2")]), c)) == {a: b"13"}
    assert live(merge.fold(make(spark, [(1, a, b"10"), (0, a, None), (2, a, b"5")]), c)) == {a: b"5"}
    assert live(merge.fold(make(spark, [(1, a, b"x"), (2, a, b"5"), (2, a, b" 7"), (2, a, b"+1")]), c)) == {a: b"6"}
    p = merge.StringAppendMerge(",")
    assert live(merge.fold(make(spark, [(1, a, b""), (2, a, b"p"), (2, a, b"q")]), p)) == {a: b"p,q"}
    assert live(merge.fold(make(spark, [(2, a, b""), (2, a, b"q")]), p)) == {a: b",q"}
    part = merge.partial_fold(make(spark, [(2, a, b"5"), (2, a, b"x"), (2, b"b", b"5"), (2, b"b", b"7")]), c)
    assert {bytes(r["user_key"]): r["value"] for r in part.collect()} == {a: None, b"b": "12"}
    state = resolve.lookup(make(spark, [(0, a, None), (1, b"b", b"1")]), make(spark, [(1, a, b""), (1, b"b", b""), (1, b"c", b"")]).select("cf_id", "user_key"))
    assert {bytes(r["user_key"]): r["state"] for r in state.collect()} == {a: "deleted", b"b": "found", b"c": "miss"}


def test_custom_merge(spark):
    class Longest(merge.MergeOperator):
        def full_merge(self, key, base, operands):
            return max([x for x in [base, *operands] if x is not None], key=len)

    rows = [(1, b"a", b"1"), (2, b"a", b"333"), (2, b"b", b"22"), (1, b"c", b"4"), (0, b"c", None)]
    assert live(merge.fold(make(spark, rows), Longest())) == {b"a": b"333", b"b": b"22"}


def test_cursor(spark):
    keys = [b"b", b"aa", b"a\x00", b"\xff", b"ab", b"a"]
    rows = spark.createDataFrame([(bytearray(k),) for k in keys], "user_key binary")
    order = sorted(keys)

    def at(df):
        return [bytes(r["user_key"]) for r in df.collect()]

    assert at(cursor.scan(rows)) == order and at(cursor.scan(rows, reverse=True)) == order[::-1]
    for t in [b"", b"a", b"a\x01", b"aaa", b"b", b"c", b"\xff\xff"]:
        lit = F.lit(bytearray(t))
        assert at(cursor.seek(rows, lit)) == [k for k in order if k >= t][:1]
        assert at(cursor.seek_for_prev(rows, lit)) == [k for k in order if k <= t][-1:]
    assert at(cursor.first(rows)) == order[:1] and at(cursor.last(rows)) == order[-1:]
    assert sorted(at(cursor.prefix(rows, b"a"))) == [k for k in order if k.startswith(b"a")]
    assert sorted(at(cursor.key_range(rows, F.lit(bytearray(b"aa")), F.lit(bytearray(b"b"))))) == [b"aa", b"ab"]
    near = {bytes(r["user_key"]): (r["prev_key"] and bytes(r["prev_key"]), r["next_key"] and bytes(r["next_key"])) for r in cursor.neighbours(rows).collect()}
    assert near == {k: (order[i - 1] if i else None, order[i + 1] if i + 1 < len(order) else None) for i, k in enumerate(order)}
    probes = spark.createDataFrame([(bytearray(t),) for t in [b"", b"a\x00", b"aaa", b"zz", b"\xff"]], "probe binary")
    found = {bytes(r["probe"]): r["user_key"] and bytes(r["user_key"]) for r in cursor.batch_seek_for_prev(rows, probes).collect()}
    assert found == {b"": None, b"a\x00": b"a\x00", b"aaa": b"aa", b"zz": b"b", b"\xff": b"\xff"}
    assert at(cursor.seek(rows.filter("false"), F.lit(bytearray(b"a")))) == []


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_neighbours_of_many_rows(spark, reuse):
    """Ranges are fixed, so boundaries agree whether Spark computes the rows once or twice, with columns beside the key or without."""
    spark.conf.set("spark.sql.exchange.reuse", reuse)
    try:
        n = 300_000
        rows = spark.range(n).select(F.format_string("k%08d", F.pmod(F.col("id") * 7919, F.lit(n)) * 3).alias("user_key"), F.col("id").alias("value")).repartition(7)
        for df in (rows, rows.select("user_key")):
            near = cursor.neighbours(df, 16)
            at = F.substring("user_key", 2, 8).cast("long")
            wrong = near.filter(~F.col("prev_key").eqNullSafe(F.when(at > 0, F.format_string("k%08d", at - 3))) | ~F.col("next_key").eqNullSafe(F.when(at < 3 * n - 3, F.format_string("k%08d", at + 3))))
            assert near.count() == n and wrong.count() == 0
        probes = spark.range(0, 3 * n, 17).select(F.format_string("k%08d", F.col("id")).alias("probe"))
        found = cursor.batch_seek_for_prev(rows, probes.union(probes.limit(3)))
        at = F.substring("probe", 2, 8).cast("long")
        assert found.count() == probes.count() + 3 and found.filter(~F.col("user_key").eqNullSafe(F.format_string("k%08d", at - at % 3))).count() == 0
        tiles = compaction.subcompaction_ranges(rows, 7).orderBy("tile").collect()
        assert sum(t["n_keys"] for t in tiles) == n and max(t["n_keys"] for t in tiles) - min(t["n_keys"] for t in tiles) <= 1
        got = {r["percentile"]: r["value"] for r in percentiles(rows, "value", [0.0, 50.0, 99.9]).collect()}
        assert got == {0.0: 0.0, 50.0: n / 2, 99.9: float(n * 999 // 1000)}
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_ranges(spark):
    rows = spark.createDataFrame([(x,) for x in [None, *range(1000)]], "x long")
    cuts = ranges.splitters(rows, "x", 50)
    assert 40 <= len(cuts) < 50
    got = rows.select("x", ranges.number(F.col("x"), cuts).alias("r")).collect()
    assert all(r["r"] == (0 if r["x"] is None else sum(c <= r["x"] for c in cuts)) for r in got)
    assert ranges.splitters(rows.filter("x < 0"), "x") == []


def test_overlap_pairs_of_many_runs(spark):
    r = random.Random(2)
    files = [(i, r.randrange(3), *sorted(f"{r.randrange(500):04}" for _ in range(2))) for i in range(150)]
    frame = spark.createDataFrame(files, "run_id long, level int, smallest string, largest string")
    want = {(a[0], b[0]) for a in files for b in files if a[0] < b[0] and a[1] == b[1] and a[2] <= b[3] and b[2] <= a[3]}
    found = [(x["run_a"], x["run_b"]) for x in compaction.overlap_pairs(frame, ["level"]).collect()]
    assert len(found) == len(set(found)) and set(found) == want


def test_partial_merge_of_a_custom_operator(spark, monkeypatch):
    """Operands are joined by stretches before full_merge, in the order of seq; where that gives None they stay."""

    class Join(merge.MergeOperator):
        def full_merge(self, key, base, operands):
            return b"|".join([base or b"-", *operands])

        def partial_merge(self, key, operands):
            return None if key == b"b" else b"+".join(operands)

    monkeypatch.setattr(merge, "OPERANDS", 10)
    rows = [(1, b"a", b"0"), *((2, b"a" if i % 2 else b"b", str(i).encode()) for i in range(30))]
    got = live(merge.fold(make(spark, rows), Join()))
    assert got[b"a"].startswith(b"0|") and got[b"a"].replace(b"+", b"|") == b"|".join([b"0", *(str(i).encode() for i in range(1, 30, 2))]) and 1 <= got[b"a"].count(b"|") <= 4
    assert got[b"b"] == b"|".join([b"-", *(str(i).encode() for i in range(0, 30, 2))])
    part = {bytes(r["user_key"]): r["value"] and bytes(r["value"]) for r in merge.partial_fold(make(spark, rows), Join()).collect()}
    assert part == {b"a": b"+".join(str(i).encode() for i in range(1, 30, 2)), b"b": None}


def test_filter_policies(spark, tmp_path):
    class Twice(bloom.FilterPolicy):
        def writer_options(self, column):
            return {f"parquet.bloom.filter.enabled#{column}": "true", f"parquet.bloom.filter.expected.ndv#{column}": "1000"}

    assert bloom.NoFilter().writer_options("k") == {} and "parquet.bloom.filter.fpp#k" in bloom.BloomPolicy(10).writer_options("k")
    with pytest.raises(ValueError):
        bloom.BloomPolicy(0)
    for n, policy in enumerate((bloom.NoFilter(), bloom.BloomPolicy(10), bloom.BloomPolicy(20), Twice())):
        path = f"{tmp_path}/{n}"
        spark.range(5000).select(F.col("id").cast("string").cast("binary").alias("k")).coalesce(1).write.options(**policy.writer_options("k")).parquet(path)
        file = next(p for p in (tmp_path / str(n)).iterdir() if p.suffix == ".parquet")
        assert (pq.read_metadata(file).row_group(0).column(0).to_dict().get("has_bloom_filter", None) in (None, n > 0)) and spark.read.parquet(path).filter("k = X'3432'").count() == 1


def test_runs_and_levels(spark):
    files = spark.createDataFrame([(i, 0, 0, 100, 10, b"a", b"c") for i in range(5)] + [(9, 1, 0, 30 << 20, 10, b"b", b"d"), (8, 6, 0, 1 << 40, 1, b"x", b"z")], "run_id long, level int, cf_id int, bytes long, rows long, smallest binary, largest binary")
    scores = {r["level"]: r["score"] for r in compaction.level_scores(files).collect()}
    assert scores[0] == 1.25 and scores[1] == 3.0
    assert compaction.pick_level(compaction.level_scores(files)).first()["level"] == 1
    assert compaction.overlap_pairs(files).count() == 15
    assert {r["run_id"] for r in compaction.overlapping(files, bytearray(b"d"), bytearray(b"x")).collect()} == {8, 9}
    assert compaction.stalls(files).first()[:] == (5, True, False)
    assert {r["property"]: r["value"] for r in manifest.properties(files).collect()}["num-files-at-level0"] == "5"
    assert manifest.level_stats(files).count() == 7
    tiles = compaction.subcompaction_ranges(spark.range(10).select(F.col("id").cast("string").alias("user_key")), 4).orderBy("tile").collect()
    assert [r["n_keys"] for r in tiles] == [3, 3, 2, 2]


def model_hash(key):
    h = bloom.SEED
    for b in key:
        h = (h * bloom.FACTOR + b) & 0xFFFFFFFF
    return h


def test_bloom(spark):
    keys = [b"", b"a", b"\x00\xff", "é日".encode(), *(f"present{i:05}".encode() for i in range(200))]
    frame = spark.createDataFrame([(bytearray(k),) for k in keys], "user_key binary")
    got = {bytes(r["user_key"]): r["h"] for r in frame.select("user_key", bloom.bloom_hash(F.col("user_key")).alias("h")).collect()}
    assert got == {k: model_hash(k) for k in keys}
    bits, k = bloom.n_bits(len(keys), 10), bloom.n_probes(10)
    want = set()
    for key in keys:
        h = model_hash(key)
        delta = ((h << 15) | (h >> 17)) & 0xFFFFFFFF
        want |= {((h + i * delta) & 0xFFFFFFFF) % bits for i in range(k)}
    made = bloom.create(frame, 10)
    assert {r["bit"] for r in made.collect()} == want
    assert bloom.probe(frame, made, bits, k).filter("NOT may_contain").count() == 0
    absent = spark.createDataFrame([(f"absent{i}",) for i in range(1000)], "user_key string")
    assert bloom.probe(absent, made, bits, k).filter("may_contain").count() < 60
    assert bloom.probe(absent, made.filter("false"), bits, k).filter("may_contain").count() == 0
    raw = bloom.packed(made, bits)
    assert {8 * i + j for i, b in enumerate(raw) for j in range(8) if b >> j & 1} == want
    assert [bloom.n_probes(x) for x in (1, 10, 20, 100)] == [1, 6, 13, 30] and bloom.n_bits(1, 10) == 64


def test_generated_values(spark):
    def model(seed, size):
        out, x = bytearray(), seed
        for _ in range(size):
            x = (x * 1103515245 + 12345) % (1 << 64)
            out.append(x >> 16 & 255)
        return bytes(out)

    got = spark.range(5).select("id", fixtures.lcg_bytes(F.col("id"), 40).alias("v")).collect()
    assert all(bytes(r["v"]) == model(r["id"], 40) for r in got)


def test_batches_and_locks(spark):
    log = make(spark, [(1, b"a", b"1"), (1, b"b", b"1"), (1, b"c", b"1")])
    ops = [(1, 0, bytearray(b"a"), 1, bytearray(b"x")), (2, 0, bytearray(b"a"), 0, None), (3, 0, bytearray(b"a"), 1, bytearray(b"2")), (4, 0, bytearray(b"b"), 0, None)]
    frame = spark.createDataFrame(ops, "ordinal long, cf_id int, user_key binary, op int, value binary")
    assert live(batch.applied(log, frame)) == {b"a": b"2", b"c": b"1"}
    assert live(batch.applied(log, frame, snapshot=2)) == {b"a": b"2"}
    assert {bytes(r["user_key"]) for r in batch.conflicts(log, frame, 1).collect()} == {b"b"}
    assert batch.last_in_batch(frame).count() == 2
    locks = spark.createDataFrame([(0, "k", 1, "READ"), (0, "k", 2, "READ"), (0, "k", 3, "WRITE"), (1, "k", 4, "WRITE"), (0, "k", 1, "READ")], "cf_id int, user_key string, txn_id long, mode string")
    assert {(r["cf_id"], r["txn_id"]): (r["mode"], r["conflicts"]) for r in batch.lock_conflicts(locks).collect()} == {(0, 1): ("READ", 1), (0, 2): ("READ", 1), (0, 3): ("WRITE", 2), (1, 4): ("WRITE", 0)}
    more = [(1, 0, bytearray(b"a"), 2, bytearray(b"5")), (2, 0, bytearray(b"z"), 2, bytearray(b"7")), (3, 0, bytearray(b"b"), 0, None), (4, 0, bytearray(b"b"), 2, bytearray(b"2"))]
    own = batch.applied(log, spark.createDataFrame(more, frame.schema), merge.CounterMerge())
    assert {bytes(r["user_key"]): (bytes(r["value"]), r["own"]) for r in own.collect()} == {b"a": (b"6", True), b"b": (b"2", True), b"c": (b"1", False), b"z": (b"7", True)}


def test_scalars(spark):
    keys = [b"", b"\x00", b"\x00\x00", b"\x00\xff", b"\x01", b"a", b"a\x00", b"a\x00b", b"aa", b"\xff"]
    frame = spark.createDataFrame([(bytearray(k), s, 1) for k in keys for s in (1, 2, 500)], "user_key binary, seq long, op int")
    rows = frame.select("user_key", "seq", scalars.internal_key(F.col("user_key"), F.col("seq"), F.col("op")).alias("x")).collect()
    by_bytes = [(bytes(r["user_key"]), r["seq"]) for r in sorted(rows, key=lambda r: bytes(r["x"]))]
    assert by_bytes == sorted(((k, s) for k in keys for s in (1, 2, 500)), key=lambda x: (x[0], -x[1]))
    numbers = [0, 1, 127, 128, 300, 16383, 16384, 1 << 31, (1 << 62) + 5]

    def varint(n):
        out = bytearray()
        while n >= 128:
            out.append(n & 127 | 128)
            n >>= 7
        return bytes([*out, n])

    got = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", scalars.varint(F.col("n")).alias("v"), scalars.from_varint(scalars.varint(F.col("n"))).alias("back")).collect()
    assert all(bytes(r["v"]) == varint(r["n"]) and r["back"] == r["n"] for r in got)
    x = spark.createDataFrame([(bytearray(b"\xffa"), "+12"), (bytearray(b"\xc3\xa9"), " 5 ")], "b binary, s string")
    r = x.select(scalars.text(F.col("b")), scalars.parse_integer(F.col("s")), scalars.checksum(F.col("b")), scalars.big_endian(F.lit(258), 4), scalars.size(F.col("b"))).collect()
    assert r[0][0] == "�a" and r[1][0] == "é" and (r[0][1], r[1][1]) == (12, None)
    assert r[0][2] == zlib.crc32(b"\xffa") and bytes(r[0][3]) == b"\x00\x00\x01\x02" and r[0][4] == 2
