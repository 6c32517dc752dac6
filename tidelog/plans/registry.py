"""Named queries over the driver tables, and the same in SQL.

In the SQL, cl is the change-log of views.CHANGELOG_SQL (cl3 with three column families), rv its live rows, ord the rows of
views.ORDERS_SQL and files those of views.FILES_SQL; what a query names of them is put before it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixtures, scalars
from ..operators import batch as batches
from ..operators import bloom, compaction, cursor, manifest, merge, resolve
from .views import CHANGELOG_SQL, FILES_SQL, ORDERS_SQL, changelog, orders_rows, run_files, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

_COMMON = {
    "cl": CHANGELOG_SQL.format(cf="0"),
    "cl3": CHANGELOG_SQL.format(cf="user_id % 3"),
    "rv": "SELECT cf_id, user_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY cf_id, user_key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1 AND op <> 0",
    "ord": ORDERS_SQL,
    "files": FILES_SQL,
    "base": "SELECT *, coalesce(max(CASE WHEN op < 2 THEN seq END) OVER (PARTITION BY user_key), -1) AS b FROM cl",
    "live": "SELECT user_key, seq, op, value FROM base WHERE seq >= b AND op <> 0",
}
_ORDER = ("cl", "cl3", "rv", "ord", "files", "base", "live")
_NEEDS = {"rv": {"cl"}, "files": {"cl"}, "base": {"cl"}, "live": {"base", "cl"}}


def _with(sql: str) -> str:
    used = {n for n in _ORDER if re.search(rf"\b{n}\b", sql)}
    used |= {m for n in used for m in _NEEDS.get(n, ())}
    parts = ",\n".join(f"{n} AS ({_COMMON[n].strip()})" for n in _ORDER if n in used)
    if not used:
        return sql.strip()
    return f"WITH {parts}\n{sql}" if not sql.lstrip().upper().startswith("WITH") else sql.lstrip().replace("WITH ", f"WITH {parts},\n" if parts else "WITH ", 1)


def query(sql: str | None = None):
    """Register a function under its name; sql gets the common tables that it names."""

    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = _with(sql)
        return f

    return add


def _live(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.latest_wins(changelog(spark, sf_dir)).select("cf_id", "user_key", "seq", "value")


# Version resolution


@query("SELECT * FROM rv")
def latest_wins(spark, sf_dir):
    return _live(spark, sf_dir)


@query("SELECT cf_id, user_key, seq, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM cl WHERE seq <= 500) WHERE rn = 1 AND op <> 0")
def snapshot_read(spark, sf_dir):
    return resolve.latest_wins(changelog(spark, sf_dir), snapshot=500).select("cf_id", "user_key", "seq", "value")


@query("""
SELECT user_key, seq, op, row_number() OVER w AS version, lag(seq) OVER w AS replaced_by, lead(seq) OVER w AS replaces
FROM cl WINDOW w AS (PARTITION BY cf_id, user_key ORDER BY seq DESC)""")
def version_history(spark, sf_dir):
    return resolve.history(changelog(spark, sf_dir)).select("user_key", "seq", "op", "version", "replaced_by", "replaces")


@query("SELECT user_key, seq FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1 AND op = 0")
def tombstone_keys(spark, sf_dir):
    return resolve.tombstones(changelog(spark, sf_dir)).select("user_key", "seq")


_PROBES = "SELECT DISTINCT CAST(0 AS INTEGER) AS cf_id, concat('u', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) AS user_key FROM customer"


def _probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.lit(0).alias("cf_id"), F.concat(F.lit("u"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("user_key")).distinct()


@query(f"""
SELECT p.user_key, CASE WHEN n.op IS NULL THEN 'miss' WHEN n.op = 0 THEN 'deleted' ELSE 'found' END AS state, n.seq, CASE WHEN n.op <> 0 THEN n.value END AS value
FROM ({_PROBES}) p LEFT JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1) n ON n.user_key = p.user_key""")
def three_state_lookup(spark, sf_dir):
    return resolve.lookup(changelog(spark, sf_dir), _probes(spark, sf_dir)).select("user_key", "state", "seq", "value")


@query(f"SELECT rv.user_key, rv.seq, rv.value FROM rv JOIN ({_PROBES}) p USING (user_key)")
def multi_get(spark, sf_dir):
    return resolve.multi_get(changelog(spark, sf_dir), _probes(spark, sf_dir)).select("user_key", "seq", "value")


@query("SELECT user_key, seq, value FROM rv WHERE user_key = 'u000007'")
def point_get(spark, sf_dir):
    log = changelog(spark, sf_dir).filter("user_key = 'u000007'")
    return resolve.latest_wins(log).select("user_key", "seq", "value")


@query(f"SELECT user_key FROM ({_PROBES}) p WHERE user_key IN (SELECT user_key FROM rv)")
def existing_keys(spark, sf_dir):
    return resolve.existing(changelog(spark, sf_dir), _probes(spark, sf_dir)).select("user_key")


@query(f"SELECT user_key FROM ({_PROBES}) p WHERE user_key NOT IN (SELECT user_key FROM rv)")
def missing_keys(spark, sf_dir):
    return resolve.missing(changelog(spark, sf_dir), _probes(spark, sf_dir)).select("user_key")


# Ordered reads


@query("SELECT user_key, value FROM rv ORDER BY user_key")
def full_scan(spark, sf_dir):
    return cursor.scan(_live(spark, sf_dir).select("user_key", "value"))


@query("SELECT user_key, value FROM rv ORDER BY user_key DESC")
def reverse_scan(spark, sf_dir):
    return cursor.scan(_live(spark, sf_dir).select("user_key", "value"), reverse=True)


@query("SELECT user_key, value FROM rv ORDER BY user_key LIMIT 1")
def seek_to_first(spark, sf_dir):
    return cursor.first(_live(spark, sf_dir).select("user_key", "value"))


@query("SELECT user_key, value FROM rv ORDER BY user_key DESC LIMIT 1")
def seek_to_last(spark, sf_dir):
    return cursor.last(_live(spark, sf_dir).select("user_key", "value"))


@query("SELECT user_key, value FROM rv WHERE user_key >= 'u000042' ORDER BY user_key LIMIT 1")
def seek(spark, sf_dir):
    return cursor.seek(_live(spark, sf_dir).select("user_key", "value"), "u000042")


@query("SELECT user_key, value FROM rv WHERE user_key <= 'u0000425' ORDER BY user_key DESC LIMIT 1")
def seek_for_prev(spark, sf_dir):
    return cursor.seek_for_prev(_live(spark, sf_dir).select("user_key", "value"), "u0000425")


@query("SELECT user_key, lead(user_key) OVER (ORDER BY user_key) AS next_key, lag(user_key) OVER (ORDER BY user_key) AS prev_key FROM rv")
def next_prev(spark, sf_dir):
    return cursor.neighbours(_live(spark, sf_dir).select("user_key"))


@query("SELECT user_key, value, lead(user_key) OVER (ORDER BY user_key) AS next_key, lag(user_key) OVER (ORDER BY user_key) AS prev_key FROM ord")
def next_prev_values(spark, sf_dir):
    return cursor.neighbours(orders_rows(spark, sf_dir), 16)


@query("SELECT user_key, value FROM ord WHERE user_key >= 'o0000000100' AND user_key < 'o0000000900'")
def range_scan(spark, sf_dir):
    return cursor.key_range(orders_rows(spark, sf_dir), "o0000000100", "o0000000900")


@query("SELECT user_key, value FROM ord WHERE user_key LIKE 'o00000001%'")
def prefix_scan(spark, sf_dir):
    return cursor.prefix(orders_rows(spark, sf_dir), "o00000001")


@query("SELECT url AS user_key, strlen(html) AS n_bytes FROM pages WHERE starts_with(url, 'https://www')")
def prefix_scan_urls(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.col("url").alias("user_key"), F.octet_length("html").cast("long").alias("n_bytes"))
    return cursor.prefix(rows, "https://www")


@query("SELECT user_key, value FROM ord ORDER BY user_key DESC LIMIT 25")
def top_k(spark, sf_dir):
    return cursor.last(orders_rows(spark, sf_dir), 25)


@query("SELECT count(*) AS n_keys, count(DISTINCT value) AS n_values, min(user_key) AS smallest, max(user_key) AS largest FROM rv")
def count_keys(spark, sf_dir):
    return _live(spark, sf_dir).agg(F.count("*").alias("n_keys"), F.countDistinct("value").alias("n_values"), F.min("user_key").alias("smallest"), F.max("user_key").alias("largest"))


@query("""
WITH p AS (SELECT DISTINCT concat('o', lpad(CAST(c_custkey * 7 AS VARCHAR), 10, '0'), 'x') AS probe FROM customer)
SELECT probe, max(user_key) AS user_key FROM p ASOF LEFT JOIN ord ON p.probe >= ord.user_key GROUP BY probe""")
def batch_seek_for_prev(spark, sf_dir):
    probes = table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), F.lpad((F.col("c_custkey") * 7).cast("string"), 10, "0"), F.lit("x")).alias("probe")).distinct()
    return cursor.batch_seek_for_prev(orders_rows(spark, sf_dir), probes)


# Merge operators


@query("SELECT user_key, seq, value FROM rv")
def merge_as_put(spark, sf_dir):
    return merge.fold(changelog(spark, sf_dir)).select("user_key", "seq", "value")


@query("""
SELECT user_key, max(seq) AS seq, CASE WHEN count(*) FILTER (WHERE op = 2) = 0 THEN max(value) FILTER (WHERE op = 1)
       ELSE CAST(CAST(sum(CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN CAST(value AS BIGINT) ELSE 0 END) AS BIGINT) AS VARCHAR) END AS value
FROM live GROUP BY user_key""")
def counter_full(spark, sf_dir):
    return merge.fold(changelog(spark, sf_dir), merge.CounterMerge()).select("user_key", "seq", "value")


@query("""
SELECT user_key, max(seq) AS seq, CAST(CAST(sum(CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN CAST(value AS BIGINT) ELSE 0 END) AS BIGINT) AS VARCHAR) AS value
FROM (SELECT *, coalesce(max(CASE WHEN op < 2 THEN seq END) OVER (PARTITION BY user_key), -1) AS b FROM cl WHERE seq <= 700) WHERE seq >= b AND op <> 0 GROUP BY user_key""")
def counter_at_snapshot(spark, sf_dir):
    return merge.fold(changelog(spark, sf_dir), merge.CounterMerge(), snapshot=700).select("user_key", "seq", "value")


@query("SELECT user_key, count(*) AS n, CAST(CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS VARCHAR) AS value FROM cl WHERE op = 2 GROUP BY user_key")
def counter_partial(spark, sf_dir):
    return merge.partial_fold(changelog(spark, sf_dir), merge.CounterMerge()).select("user_key", "n", "value")


@query("SELECT user_key, max(seq) AS seq, string_agg(value, ',' ORDER BY seq) AS value FROM live GROUP BY user_key")
def append_full(spark, sf_dir):
    return merge.fold(changelog(spark, sf_dir), merge.StringAppendMerge(",")).select("user_key", "seq", "value")


@query("SELECT user_key, count(*) AS n, string_agg(value, '-' ORDER BY seq) AS value FROM cl WHERE op = 2 GROUP BY user_key")
def append_partial(spark, sf_dir):
    return merge.partial_fold(changelog(spark, sf_dir), merge.StringAppendMerge("-")).select("user_key", "n", "value")


@query("SELECT concat('c', CAST(conv_id AS VARCHAR)) AS user_key, count(*) AS n, string_agg(role, '>' ORDER BY turn) AS value FROM conversations GROUP BY conv_id")
def append_roles(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").select(F.lit(0).alias("cf_id"), F.concat(F.lit("c"), F.col("conv_id").cast("string")).alias("user_key"), F.col("turn").alias("seq"), F.lit(2).alias("op"), F.col("role").alias("value"))
    return merge.partial_fold(turns, merge.StringAppendMerge(">")).select("user_key", "n", "value")


class _Longest(merge.MergeOperator):
    """The longest of base and operands, the earliest of equals."""

    name = "longest"

    def full_merge(self, key, base, operands):
        return max([x for x in [base, *operands] if x is not None], key=len, default=None)


@query("""
SELECT user_key, max(seq) AS seq, CASE WHEN count(*) FILTER (WHERE op = 2) = 0 THEN max(value) FILTER (WHERE op = 1) ELSE arg_max(value, (strlen(value), -seq)) END AS value
FROM live GROUP BY user_key""")
def custom_merge(spark, sf_dir):
    return merge.fold(changelog(spark, sf_dir), _Longest()).select("user_key", "seq", "value")


# Runs and compaction


@query("""
SELECT run_id, count(*) AS n_rows, count(DISTINCT user_key) AS n_keys, CAST(sum(CASE WHEN op = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tombstones,
       CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes, min(user_key) AS smallest, max(user_key) AS largest, min(seq) AS min_seq, max(seq) AS max_seq
FROM cl GROUP BY run_id""")
def run_metadata(spark, sf_dir):
    return compaction.run_metadata(changelog(spark, sf_dir))


@query("SELECT a.run_id AS run_a, b.run_id AS run_b FROM files a JOIN files b ON a.run_id < b.run_id AND NOT (a.largest < b.smallest OR b.largest < a.smallest)")
def overlap_pairs(spark, sf_dir):
    return compaction.overlap_pairs(run_files(spark, sf_dir))


@query("SELECT run_id, level, smallest, largest FROM files WHERE NOT (largest < 'u000020' OR smallest > 'u000030')")
def overlapping_files(spark, sf_dir):
    return compaction.overlapping(run_files(spark, sf_dir), "u000020", "u000030").select("run_id", "level", "smallest", "largest")


@query("SELECT run_id, user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY run_id, user_key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1")
def flush_dedupe(spark, sf_dir):
    return compaction.flush(changelog(spark, sf_dir), by=["run_id"]).select("run_id", "user_key", "seq", "op", "value")


@query("SELECT user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1")
def compact_non_bottom(spark, sf_dir):
    """Deletions stay above the bottom level."""
    return compaction.compact(changelog(spark, sf_dir), output_level=1).select("user_key", "seq", "op", "value")


@query("SELECT user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1 AND op <> 0")
def compact_bottom(spark, sf_dir):
    return compaction.compact(changelog(spark, sf_dir), output_level=6).select("user_key", "seq", "op", "value")


@query("SELECT user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1 AND op <> 0 ORDER BY user_key")
def parallel_compaction(spark, sf_dir):
    return compaction.sorted_runs(compaction.compact(changelog(spark, sf_dir), output_level=6), 4).select("user_key", "seq", "op", "value")


@query("""
WITH newer AS (SELECT user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM cl WHERE run_id >= 3) WHERE rn = 1),
mixed AS (SELECT user_key, seq, op, value FROM cl WHERE run_id < 3 UNION ALL SELECT * FROM newer),
a AS (SELECT user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM mixed) WHERE rn = 1 AND op <> 0),
b AS (SELECT user_key, seq, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM cl) WHERE rn = 1 AND op <> 0)
SELECT (SELECT count(*) FROM a) AS n_after, (SELECT count(*) FROM b) AS n_before,
       (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) + (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS n_differences""")
def compaction_equivalence(spark, sf_dir):
    """A store of which the newer half is compacted to level 1 reads the same as before: live rows after and before, and how many differ."""
    log = changelog(spark, sf_dir)
    columns = ["cf_id", "user_key", "seq", "op", "value"]
    newer = compaction.compact(log.filter("run_id >= 3"), output_level=1).select(*columns)
    mixed = log.filter("run_id < 3").select(*columns).unionByName(newer)
    return compaction.differences(*(resolve.latest_wins(x).select(*columns) for x in (mixed, log)))


@query("""
SELECT level, count(*) AS n_files, CAST(sum(bytes) AS BIGINT) AS bytes,
       CASE WHEN level = 0 THEN count(*) / 4.0::DOUBLE ELSE CAST(sum(bytes) AS BIGINT)::DOUBLE / (10485760::DOUBLE * pow(10::DOUBLE, level - 1)) END AS score
FROM files GROUP BY level""")
def score_by_level(spark, sf_dir):
    return compaction.level_scores(run_files(spark, sf_dir))


@query("""
SELECT level, score FROM (
  SELECT level, CASE WHEN level = 0 THEN count(*) / 2.0::DOUBLE ELSE CAST(sum(bytes) AS BIGINT)::DOUBLE / (8000::DOUBLE * pow(10::DOUBLE, level - 1)) END AS score FROM files GROUP BY level)
WHERE score > 1 AND level < 6 ORDER BY score DESC, level LIMIT 1""")
def pick_level(spark, sf_dir):
    return compaction.pick_level(compaction.level_scores(run_files(spark, sf_dir), trigger=2, base=8000)).select("level", "score")


@query("SELECT tile, min(user_key) AS smallest, max(user_key) AS largest, count(*) AS n_keys FROM (SELECT user_key, ntile(4) OVER (ORDER BY user_key) AS tile FROM (SELECT DISTINCT user_key FROM ord)) GROUP BY tile")
def subcompaction_ranges(spark, sf_dir):
    return compaction.subcompaction_ranges(orders_rows(spark, sf_dir), 4)


@query("SELECT run_id, 'u000020' >= smallest AND 'u000020' <= largest AS holds FROM files")
def range_contains(spark, sf_dir):
    return run_files(spark, sf_dir).select("run_id", compaction.contains(F.col("smallest"), F.col("largest"), F.lit("u000020")).alias("holds"))


@query("SELECT CAST(sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_l0, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) >= 4 AS trigger, sum(CASE WHEN level = 0 THEN 1 ELSE 0 END) >= 12 AS stall FROM files")
def write_stall(spark, sf_dir):
    return compaction.stalls(run_files(spark, sf_dir))


# Manifest, column families, properties

_EDITS = """edits AS (
  SELECT run_id + 1 AS version, 'add' AS action, cf_id, level, run_id, bytes, rows FROM files
  UNION ALL SELECT run_id + 5, 'remove', cf_id, level, run_id, bytes, rows FROM files WHERE run_id % 3 = 0)"""


def _edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = run_files(spark, sf_dir)
    names = ["version", "action", "cf_id", "level", "run_id", "bytes", "rows"]
    added = files.withColumns({"version": F.col("run_id") + 1, "action": F.lit("add")}).select(*names)
    removed = files.filter("run_id % 3 = 0").withColumns({"version": F.col("run_id") + 5, "action": F.lit("remove")}).select(*names)
    return added.unionByName(removed)


@query(f"WITH {_EDITS} SELECT run_id, level, bytes, rows FROM files WHERE run_id NOT IN (SELECT run_id FROM edits WHERE action = 'remove')")
def manifest_fold(spark, sf_dir):
    return manifest.live_files(_edits(spark, sf_dir)).select("run_id", "level", "bytes", "rows")


@query(f"WITH {_EDITS} SELECT run_id, level FROM edits a WHERE action = 'add' AND version <= 6 AND NOT EXISTS (SELECT 1 FROM edits r WHERE r.run_id = a.run_id AND r.action = 'remove' AND r.version <= 6)")
def manifest_as_of(spark, sf_dir):
    return manifest.live_files(_edits(spark, sf_dir), version=6).select("run_id", "level")


@query("SELECT n_nationkey AS cf_id, n_name AS name FROM nation WHERE n_nationkey % 4 <> 1")
def cf_catalog(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    created = nation.select(F.col("n_nationkey").alias("cf_id"), F.col("n_name").alias("name"), F.lit("create").alias("event"), F.col("n_nationkey").cast("long").alias("event_seq"))
    dropped = created.filter("cf_id % 4 = 1").withColumns({"event": F.lit("drop"), "event_seq": F.col("event_seq") + 100})
    return manifest.live_families(created.unionByName(dropped))


@query("SELECT cf_id, count(*) AS n_keys, min(user_key) AS smallest FROM (SELECT *, row_number() OVER (PARTITION BY cf_id, user_key ORDER BY seq DESC) AS rn FROM cl3) WHERE rn = 1 AND op <> 0 GROUP BY cf_id")
def cf_isolation(spark, sf_dir):
    live = resolve.latest_wins(changelog(spark, sf_dir, 3))
    return live.groupBy("cf_id").agg(F.count("*").alias("n_keys"), F.min("user_key").alias("smallest"))


@query("SELECT cf_id, max(seq) AS last_seq, count(*) AS n_rows FROM cl3 WHERE cf_id <> 1 GROUP BY cf_id")
def wal_replay(spark, sf_dir):
    families = spark.createDataFrame([(0, "default"), (2, "cf2")], "cf_id int, name string")
    return manifest.last_sequences(manifest.of_live_families(changelog(spark, sf_dir, 3), families))


@query("SELECT l.level, count(run_id) AS n_files, CAST(coalesce(sum(bytes), 0) AS BIGINT) AS bytes, CAST(coalesce(sum(rows), 0) AS BIGINT) AS n_rows FROM (SELECT CAST(range AS INTEGER) AS level FROM range(7)) l LEFT JOIN files USING (level) GROUP BY l.level")
def level_stats(spark, sf_dir):
    return manifest.level_stats(run_files(spark, sf_dir))


@query("""
SELECT concat('num-files-at-level', CAST(l.range AS VARCHAR)) AS property, CAST(count(run_id) AS VARCHAR) AS value FROM range(7) l LEFT JOIN files ON files.level = l.range GROUP BY l.range
UNION ALL SELECT 'total-size', CAST(CAST(sum(bytes) AS BIGINT) AS VARCHAR) FROM files
UNION ALL SELECT 'num-entries', CAST(CAST(sum(rows) AS BIGINT) AS VARCHAR) FROM files""")
def properties(spark, sf_dir):
    return manifest.properties(run_files(spark, sf_dir))


@query("""
SELECT level, bytes_read, bytes_written, compactions, CASE WHEN bytes_written = 0 THEN 0.0::DOUBLE ELSE bytes_read::DOUBLE / bytes_written END AS read_amp, 1.0::DOUBLE + compactions AS write_amp
FROM (SELECT level, CAST(sum(bytes) AS BIGINT) AS bytes_read, CAST(sum(CASE WHEN run_id % 2 = 0 THEN bytes ELSE 0 END) AS BIGINT) AS bytes_written, count(*) AS compactions FROM files GROUP BY level)""")
def amplification(spark, sf_dir):
    files = run_files(spark, sf_dir)
    levels = files.groupBy("level").agg(F.sum("bytes").alias("bytes_read"), F.sum(F.when(F.col("run_id") % 2 == 0, F.col("bytes")).otherwise(0)).alias("bytes_written"), F.count("*").alias("compactions"))
    return manifest.amplification(levels)


@query(f"""
WITH s AS (
  SELECT count(*) AS probes, count(n.user_key) AS hits FROM ({_PROBES}) p LEFT JOIN rv n USING (user_key))
SELECT probes, hits, CASE WHEN probes > 0 THEN hits::DOUBLE / probes ELSE 0 END AS hit_rate FROM s""")
def hit_rates(spark, sf_dir):
    found = resolve.lookup(changelog(spark, sf_dir), _probes(spark, sf_dir))
    counts = found.agg(F.count("*").alias("probes"), F.sum((F.col("state") == "found").cast("long")).alias("hits"))
    return counts.withColumn("hit_rate", F.coalesce(F.try_divide(F.col("hits").cast("double"), F.col("probes").cast("double")), F.lit(0.0)))


@query("""
WITH r AS (SELECT CAST(o_totalprice AS DOUBLE) AS x, row_number() OVER (ORDER BY o_totalprice) - 1 AS i, count(*) OVER () AS n FROM orders)
SELECT p.p AS percentile, min(x) AS value FROM r JOIN (SELECT unnest([50.0, 95.0, 99.0, 99.9])::DOUBLE AS p) p ON r.i = least(CAST(floor(n * p.p / 100) AS BIGINT), n - 1) GROUP BY p.p""")
def percentiles(spark, sf_dir):
    from ..stats import percentiles as nearest

    return nearest(table(spark, sf_dir, "orders").select(F.col("o_totalprice").alias("x")), "x", [50.0, 95.0, 99.0, 99.9])


# Bloom filters

_HASH = "list_reduce(list_prepend(3164544308::HUGEINT, list_transform(range(1, strlen(user_key) + 1), lambda i: ascii(substr(user_key, i, 1))::HUGEINT)), lambda h, b: (h * 2654435769 + b) % 4294967296)"


@query(f"SELECT user_key, CAST({_HASH.replace('3164544308', str(bloom.SEED))} AS BIGINT) AS h FROM (SELECT DISTINCT user_key FROM cl)")
def bloom_hash(spark, sf_dir):
    keys = changelog(spark, sf_dir).select("user_key").distinct()
    return keys.select("user_key", bloom.bloom_hash(F.col("user_key")).alias("h"))


def _bloom_sql(tail: str) -> str:
    return f"""
WITH ks AS (SELECT DISTINCT user_key FROM cl),
m AS (SELECT greatest(64, count(*) * 10) AS want FROM ks),
nb AS (SELECT ((want + 7) // 8) * 8 AS n FROM m),
hashed AS (SELECT user_key, CAST({_HASH.replace('3164544308', str(bloom.SEED))} AS HUGEINT) AS h FROM (SELECT user_key FROM ks UNION SELECT concat('u', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) FROM customer)),
bits AS (
  SELECT user_key, CAST((h + i.range * ((h * 32768) % 4294967296 + h // 131072)) % 4294967296 % nb.n AS BIGINT) AS bit FROM hashed, range(6) i, nb),
filter_bits AS (SELECT DISTINCT bit FROM bits WHERE user_key IN (SELECT user_key FROM ks)),
probed AS (SELECT user_key, bool_and(bit IN (SELECT bit FROM filter_bits)) AS may_contain FROM bits GROUP BY user_key)
{tail}"""


def _bloom(spark: SparkSession, sf_dir: str):
    keys = changelog(spark, sf_dir).select("user_key").distinct()
    n = keys.count()
    return keys, bloom.create(keys, 10, n=n), bloom.n_bits(n, 10)


@query(_bloom_sql("SELECT bit FROM filter_bits"))
def bloom_create(spark, sf_dir):
    return _bloom(spark, sf_dir)[1]


@query(_bloom_sql("SELECT user_key, may_contain FROM probed"))
def bloom_probe(spark, sf_dir):
    keys, bits, n = _bloom(spark, sf_dir)
    probes = _probes(spark, sf_dir).select("user_key").union(keys).distinct()
    return bloom.probe(probes, bits, n, bloom.n_probes(10))


@query(_bloom_sql("SELECT count(*) AS n, CAST(sum(may_contain::INTEGER) AS BIGINT) AS false_positives, avg(may_contain::INTEGER) AS rate FROM probed WHERE user_key NOT IN (SELECT user_key FROM ks)"))
def bloom_fp_rate(spark, sf_dir):
    keys, bits, n = _bloom(spark, sf_dir)
    absent = _probes(spark, sf_dir).select("user_key").join(keys, "user_key", "left_anti")
    hit = F.col("may_contain").cast("int")
    return bloom.probe(absent, bits, n, bloom.n_probes(10)).agg(F.count("*").alias("n"), F.sum(hit).alias("false_positives"), F.avg(hit).alias("rate"))


# Batches and transactions

_BATCH = """batch AS (
  SELECT c_custkey + 1 AS ordinal, CAST(0 AS INTEGER) AS cf_id, concat('u', lpad(CAST((c_custkey * 3) % 200 AS VARCHAR), 6, '0')) AS user_key,
         CAST(CASE WHEN c_nationkey % 5 = 0 THEN 0 ELSE 1 END AS INTEGER) AS op, CASE WHEN c_nationkey % 5 <> 0 THEN concat(c_mktsegment, CAST(c_custkey AS VARCHAR)) END AS value
  FROM customer)"""


def _batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customer as one batch: a customer's number is its place."""
    op = F.when(F.col("c_nationkey") % 5 == 0, 0).otherwise(1).cast("int")
    return table(spark, sf_dir, "customer").select(
        (F.col("c_custkey") + 1).alias("ordinal"), F.lit(0).alias("cf_id"), F.concat(F.lit("u"), F.lpad(((F.col("c_custkey") * 3) % 200).cast("string"), 6, "0")).alias("user_key"), op.alias("op"), F.when(op != 0, F.concat("c_mktsegment", F.col("c_custkey").cast("string"))).alias("value")
    )


@query(f"WITH {_BATCH} SELECT user_key, op, value FROM (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY ordinal DESC) AS rn FROM batch) WHERE rn = 1")
def last_in_batch(spark, sf_dir):
    return batches.last_in_batch(_batch(spark, sf_dir)).select("user_key", "op", "value")


@query(f"WITH {_BATCH} SELECT count(*) AS n_ops, CAST(sum(strlen(user_key) + coalesce(strlen(value), 0)) AS BIGINT) AS bytes FROM batch")
def batch_size(spark, sf_dir):
    return batches.data_size(_batch(spark, sf_dir))


_APPLIED = f"""WITH {_BATCH},
either AS (SELECT user_key, seq, op, value FROM cl UNION ALL SELECT user_key, 1000000000 + ordinal, op, value FROM batch),
n AS (SELECT *, row_number() OVER (PARTITION BY user_key ORDER BY seq DESC) AS rn FROM either)
"""


@query(_APPLIED + "SELECT user_key, seq, value FROM n WHERE rn = 1 AND op <> 0")
def batch_apply(spark, sf_dir):
    log = changelog(spark, sf_dir).drop("run_id")
    return resolve.latest_wins(log.unionByName(batches.stamp(_batch(spark, sf_dir), 1_000_000_000))).select("user_key", "seq", "value")


@query(_APPLIED + "SELECT user_key, value, seq > 1000000000 AS own FROM n WHERE rn = 1 AND op <> 0")
def read_your_writes(spark, sf_dir):
    return batches.applied(changelog(spark, sf_dir), _batch(spark, sf_dir)).select("user_key", "value", "own")


@query(f"WITH {_BATCH} SELECT user_key, max(seq) AS last_seq FROM cl WHERE seq > 900 AND user_key IN (SELECT user_key FROM batch) GROUP BY user_key")
def conflict_detect(spark, sf_dir):
    return batches.conflicts(changelog(spark, sf_dir), _batch(spark, sf_dir), 900).select("user_key", "last_seq")


@query(f"""WITH {_BATCH}, ops AS (
  SELECT user_key, seq, op, value FROM cl
  UNION ALL SELECT user_key, 4611686018427387904 + ordinal, CASE WHEN op = 1 AND ordinal % 2 = 0 THEN 2 ELSE op END, CASE WHEN op = 1 THEN CAST(ordinal AS VARCHAR) END FROM batch),
based AS (SELECT *, coalesce(max(CASE WHEN op < 2 THEN seq END) OVER (PARTITION BY user_key), -1) AS b FROM ops)
SELECT user_key, max(seq) > 4611686018427387904 AS own, CASE WHEN count(*) FILTER (WHERE op = 2) = 0 THEN max(value) FILTER (WHERE op = 1)
       ELSE CAST(CAST(sum(CAST(value AS BIGINT)) AS BIGINT) AS VARCHAR) END AS value
FROM based WHERE seq >= b AND op <> 0 GROUP BY user_key""")
def read_your_merges(spark, sf_dir):
    """A batch of puts, deletions and counter merges, folded into what is stored."""
    own = _batch(spark, sf_dir)
    own = own.withColumns({"op": F.when((F.col("op") == 1) & (F.col("ordinal") % 2 == 0), 2).otherwise(F.col("op")), "value": F.when(F.col("op") == 1, F.col("ordinal").cast("string"))})
    return batches.applied(changelog(spark, sf_dir), own, merge.CounterMerge()).select("user_key", "own", "value")


@query("""
WITH l AS (SELECT concat('u', CAST(user_id AS VARCHAR)) AS user_key, event_id % 40 AS txn_id, max(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) AS w FROM events GROUP BY ALL)
SELECT a.user_key, a.txn_id, CASE WHEN a.w = 1 THEN 'WRITE' ELSE 'READ' END AS mode, count(b.txn_id) AS conflicts
FROM l a LEFT JOIN l b ON a.user_key = b.user_key AND a.txn_id <> b.txn_id AND (a.w = 1 OR b.w = 1) GROUP BY a.user_key, a.txn_id, a.w""")
def lock_compatibility(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    locks = events.select(F.lit(0).alias("cf_id"), F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_key"), (F.col("event_id") % 40).alias("txn_id"), F.when(F.col("event_type") == "purchase", "WRITE").otherwise("READ").alias("mode"))
    return batches.lock_conflicts(locks).select("user_key", "txn_id", "mode", "conflicts")


@query("""
SELECT user_key, strlen(user_key) AS n_bytes, strlen(value) = 0 AS no_value, starts_with(user_key, 'u0001') AS early, CASE WHEN user_key < 'u000100' THEN -1 WHEN user_key > 'u000100' THEN 1 ELSE 0 END AS cmp,
       CASE WHEN regexp_full_match(value, '[+-]?[0-9]+') THEN TRY_CAST(value AS BIGINT) END AS number
FROM rv""")
def scalar_functions(spark, sf_dir):
    return _live(spark, sf_dir).select(
        "user_key", scalars.size(F.col("user_key")).cast("long").alias("n_bytes"), scalars.is_empty(F.col("value")).alias("no_value"), scalars.starts_with(F.col("user_key"), "u0001").alias("early"), scalars.compare(F.col("user_key"), F.lit("u000100")).alias("cmp"), scalars.parse_integer(F.col("value")).alias("number")
    )


_CRC = """crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda h, k: xor(h >> 1, CASE WHEN h & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c FROM (SELECT unnest(range(256)) AS b)))"""


@query(f"""WITH {_CRC}
SELECT seq, hex(encode(user_key)) || '0000' || lpad(hex(18446744073709551615::UBIGINT - seq::UBIGINT), 16, '0') || lpad(hex(op), 2, '0') AS internal_key,
       array_to_string(list_transform(list_filter(range(0, 9), lambda i: i = 0 OR (seq >> (7 * i)::INTEGER) > 0),
         lambda i: lpad(hex(((seq >> (7 * i)::INTEGER) & 127) + CASE WHEN (seq >> (7 * i + 7)::INTEGER) > 0 THEN 128 ELSE 0 END), 2, '0')), '') AS varint, seq AS back,
       xor(list_reduce(list_prepend(4294967295, list_transform(regexp_extract_all(hex(encode(user_key)), '..'), lambda x: ('0x' || x)::BIGINT)),
         lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)])), 4294967295)::BIGINT AS crc
FROM cl, crc""")
def key_codecs(spark, sf_dir):
    """Internal keys, varints there and back, and checksums."""
    log = changelog(spark, sf_dir)
    return log.select(
        "seq", F.hex(scalars.internal_key(F.col("user_key"), F.col("seq"), F.col("op"))).alias("internal_key"), F.hex(scalars.varint(F.col("seq"))).alias("varint"), scalars.from_varint(scalars.varint(F.col("seq"))).alias("back"), scalars.checksum(F.col("user_key")).alias("crc")
    )


@query("""
WITH RECURSIVE g AS (
  SELECT c_custkey AS seed, 0 AS i, c_custkey::HUGEINT AS x FROM customer
  UNION ALL SELECT seed, i + 1, (x * 1103515245 + 12345) % 18446744073709551616 FROM g WHERE i < 100)
SELECT concat('key', lpad(CAST(seed AS VARCHAR), 8, '0')) AS user_key, string_agg(lpad(hex(((x // 65536) % 256)::INTEGER), 2, '0'), '' ORDER BY i) AS value FROM g WHERE i > 0 GROUP BY seed""")
def generated_values(spark, sf_dir):
    """Fixture values of 100 bytes for each customer, in hexadecimal."""
    keys = table(spark, sf_dir, "customer").select(F.concat(F.lit("key"), F.lpad(F.col("c_custkey").cast("string"), 8, "0")).alias("user_key"), F.col("c_custkey").alias("seed"))
    return keys.select("user_key", F.hex(fixtures.lcg_bytes(F.col("seed"), 100)).alias("value"))
