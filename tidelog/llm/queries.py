"""The queries opN_<name>, their SQL, and what they share."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontam, exact, jaccard, lines, mixing, quality, sharding, substrings, tokens


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontam.digest(decontam.scan(docs, _table(spark, sf_dir, "benchmark")))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: all repeated chunks counted, and the text that is left; spans as "start-end", joined by commas."""
    out = substrings.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",")
    firsts = F.array_join(F.transform("first_ids", lambda x: x.cast("string")), ",")
    return out.select("doc_id", "n_bytes", "n_chunks", "n_repeated", "repeated_bytes", "removed_bytes", spans.alias("removed"), firsts.alias("first_ids"), "text")


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact.dedup(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op5_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(_table(spark, sf_dir, "documents"))
    return out.withColumn("grown_shard", F.lit(None).cast("int"))


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(_table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.round_trip(_table(spark, sf_dir, "documents"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality.train(docs, _table(spark, sf_dir, "labels")))
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document, with the text that is left; numbers of deleted lines, and documents that keep them, joined by commas."""
    out = lines.dedup(_table(spark, sf_dir, "documents").select("doc_id", "text"))

    def joined(x):
        return F.array_join(F.transform(x, lambda y: y.cast("string")), ",")

    firsts = F.array_sort(F.array_distinct(F.filter(F.col("runs.first_id"), lambda x: x.isNotNull())))
    return out.select("doc_id", "n_lines", "n_deleted", F.size("runs").cast("long").alias("n_runs"), joined("deleted").alias("deleted"), joined(firsts).alias("first_ids"), "text")


def op10_preferences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations 2 k (chosen) and 2 k + 1 (rejected), masks as "start-end", joined by commas."""
    chats = _table(spark, sf_dir, "conversations")
    out = chat.preferences(chats, chat.adjacent_pairs(chats))

    def spans(name: str):
        return F.array_join(F.transform(name, lambda x: F.concat(x["start"], F.lit("-"), x["end"])), ",").alias(name)

    return out.select("pair_id", "chosen_id", "rejected_id", "n_prompt", "prompt", "chosen", "rejected", spans("chosen_mask"), spans("rejected_mask"))


QUERIES = {
    "op1_mix": op1_mix,
    "op2_decontaminate": op2_decontaminate,
    "op3_substring_dedup": op3_substring_dedup,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_shard": op5_shard,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_token_ids": op7_token_ids,
    "op8_quality": op8_quality,
    "op9_line_dedup": op9_line_dedup,
    "op10_preferences": op10_preferences,
}

ORACLE_SQL = {
    "op1_mix": r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         substr(md5('mix:' || coalesce(doc_id::VARCHAR, md5(text), '')), 1, 15) AS k
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS w,
         row_number() OVER (ORDER BY source NULLS LAST) AS rk, source_size * 2 AS cap FROM src),
filled AS (
  SELECT *, cap / w::DOUBLE AS ratio,
         coalesce(sum(cap) OVER (ORDER BY cap / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS caps,
         coalesce(sum(w) OVER (ORDER BY cap / w::DOUBLE, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS used,
         (sum(source_size) OVER ())::BIGINT AS total, (sum(w) OVER ())::BIGINT AS weight
  FROM weighed),
lvl AS (
  SELECT (1.5::DOUBLE * total - caps) / (weight - used)::DOUBLE AS level FROM filled
  WHERE ratio >= (1.5::DOUBLE * total - caps) / (weight - used)::DOUBLE ORDER BY ratio, rk LIMIT 1),
goals AS (
  SELECT source, source_size, coalesce(least(w * (SELECT level FROM lvl), cap::DOUBLE), cap::DOUBLE) AS target FROM weighed),
run AS (
  SELECT s.doc_id, s.size, g.source_size, g.target, floor(g.target + 0.5)::BIGINT AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.k, s.doc_id NULLS LAST, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM sized s JOIN goals g ON s.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END::BIGINT AS taken
FROM run""",
    "op2_decontaminate": r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS r,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []::VARCHAR[]) AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
item_at AS (SELECT item_id, w, unnest(range(1, greatest(len(w) - 8, 2))) AS i FROM items WHERE len(w) > 0),
wins AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS g FROM item_at),
sizes AS (SELECT DISTINCT n FROM wins),
doc_at AS (SELECT r, n, w, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n),
grams AS (SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc_at),
hits AS (SELECT r, i, n, item_id FROM grams JOIN wins USING (n, g)),
marked AS (SELECT r, count(*) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r),
named AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS item_id FROM hits) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN marked USING (r) LEFT JOIN named USING (r)""",
    "op3_substring_dedup": r"""
WITH m0 AS (SELECT range AS v, (range + 1)::UBIGINT AS x FROM range(256)),
m1 AS (SELECT v, ((xor(x, x >> 33)::UHUGEINT * 18397679294719823053::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM m0),
m2 AS (SELECT v, ((xor(x, x >> 33)::UHUGEINT * 14181476777654086739::UHUGEINT) % 18446744073709551616::UHUGEINT)::UBIGINT AS x FROM m1),
gear AS (SELECT v, (xor(x, x >> 33) >> 48)::BIGINT AS g FROM m2),
d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS LAST) AS r, strlen(coalesce(text, ''))::BIGINT AS n, coalesce(text, '') AS text, hex(encode(coalesce(text, ''))) AS hx
  FROM documents),
u AS (SELECT r, unnest(regexp_extract_all(hx, '..')) AS h, unnest(range(0, n)) AS k FROM d),
b AS (SELECT r, k, ('0x' || h)::BIGINT AS v FROM u),
rolled AS (
  SELECT r, k, (g + lag(g, 1, 0) OVER w * 2 + lag(g, 2, 0) OVER w * 4 + lag(g, 3, 0) OVER w * 8 + lag(g, 4, 0) OVER w * 16 + lag(g, 5, 0) OVER w * 32
    + lag(g, 6, 0) OVER w * 64 + lag(g, 7, 0) OVER w * 128 + lag(g, 8, 0) OVER w * 256 + lag(g, 9, 0) OVER w * 512 + lag(g, 10, 0) OVER w * 1024
    + lag(g, 11, 0) OVER w * 2048 + lag(g, 12, 0) OVER w * 4096 + lag(g, 13, 0) OVER w * 8192 + lag(g, 14, 0) OVER w * 16384 + lag(g, 15, 0) OVER w * 32768) % 65536 AS h
  FROM b JOIN gear USING (v) WINDOW w AS (PARTITION BY r ORDER BY k)),
proposed AS (SELECT r, k + 1 AS p FROM rolled WHERE k >= 15 AND h < 4096),
cuts AS (SELECT r, p FROM (SELECT *, lag(p) OVER (PARTITION BY r ORDER BY p) AS q FROM proposed) WHERE q IS NULL OR p - q >= 12),
ends AS (SELECT r, p FROM cuts UNION SELECT r, n FROM d WHERE n > 0),
whole AS (SELECT r, lag(p, 1, 0) OVER (PARTITION BY r ORDER BY p) AS s, p AS e FROM ends),
pieces AS (SELECT r, e, unnest(range(s, e, 128)) AS a FROM whole),
chunks AS (
  SELECT d.r, a, least(a + 128, e) AS z, substr(hx, 2 * a + 1, 2 * (least(a + 128, e) - a)) AS x, row_number() OVER (PARTITION BY d.r ORDER BY a) AS i FROM pieces JOIN d USING (r)),
edges AS (
  SELECT r, k, v, v = 32 OR v BETWEEN 9 AND 13 AS blank, lag(v, 1, 32) OVER (PARTITION BY r ORDER BY k) AS before, lead(v, 1, 32) OVER (PARTITION BY r ORDER BY k) AS after FROM b),
begins AS (SELECT r, k, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM edges WHERE NOT blank AND (before = 32 OR before BETWEEN 9 AND 13)),
stops AS (SELECT r, k + 1 AS k, row_number() OVER (PARTITION BY r ORDER BY k) AS i FROM edges WHERE NOT blank AND (after = 32 OR after BETWEEN 9 AND 13)),
units AS (SELECT begins.r, unnest(range(begins.k + 6, stops.k, 6)) AS k FROM begins JOIN stops USING (r, i) WHERE stops.k - begins.k > 32),
marks AS (SELECT r, k, 1 AS word, 0 AS more FROM begins UNION ALL SELECT r, k, 0, 1 FROM units),
words AS (SELECT m.r, c.a, sum(word) AS words, sum(more) AS more FROM marks m ASOF JOIN chunks c ON m.r = c.r AND m.k >= c.a GROUP BY m.r, c.a),
known AS (
  SELECT *, min(r) OVER (PARTITION BY x) AS f, row_number() OVER (PARTITION BY r, x ORDER BY a) AS own, lag(x) OVER (PARTITION BY r ORDER BY a) IS NOT DISTINCT FROM x AS ruler FROM chunks),
repeated AS (
  SELECT k.*, coalesce(words, 0) + CASE WHEN ruler AND k.r = f THEN 0 ELSE coalesce(more, 0) END AS w, i - row_number() OVER (PARTITION BY k.r ORDER BY i) AS run
  FROM known k LEFT JOIN words USING (r, a) WHERE k.r <> f OR own > 1),
runs AS (SELECT r, run, min(a) AS s, max(z) AS e, sum(w) >= 20 AS goes, list(DISTINCT f) AS fs FROM repeated GROUP BY r, run),
heads AS (SELECT r, k FROM b WHERE v NOT BETWEEN 128 AND 191 UNION ALL SELECT r, n FROM d),
up AS (SELECT r, run, fs, s0, e, least(e, k) AS s FROM (
  SELECT q.r, q.run, q.fs, q.s AS s0, q.e, h.k FROM (SELECT * FROM runs WHERE goes) q ASOF JOIN heads h ON q.r = h.r AND q.s <= h.k)),
spans AS (SELECT up.r, run, fs, s, greatest(s, h.k) AS e FROM up ASOF JOIN heads h ON up.r = h.r AND up.e >= h.k),
gone AS (SELECT r, sum(e - s)::BIGINT AS removed_bytes, string_agg(s || '-' || e, ',' ORDER BY s) AS removed FROM spans GROUP BY r),
firsts AS (
  SELECT r, string_agg(doc_id, ',' ORDER BY doc_id) AS first_ids FROM (
    SELECT DISTINCT q.r, d.doc_id FROM (SELECT r, unnest(fs) AS f FROM spans) q JOIN d ON d.r = q.f WHERE d.doc_id IS NOT NULL) GROUP BY r),
kept AS (SELECT r, lag(e, 1, 0) OVER (PARTITION BY r ORDER BY s) AS a, s AS z FROM (SELECT r, s, e FROM spans UNION ALL SELECT d.r, n, n FROM d JOIN gone USING (r))),
left_over AS (SELECT r, decode(unhex(string_agg(substr(hx, 2 * a + 1, 2 * (z - a)), '' ORDER BY a, z))) AS text FROM kept JOIN d USING (r) GROUP BY r),
n_chunks AS (SELECT r, count(*) AS n_chunks FROM chunks GROUP BY r),
n_repeated AS (SELECT r, count(*) AS n_repeated, sum(z - a)::BIGINT AS repeated_bytes FROM repeated GROUP BY r)
SELECT doc_id, n AS n_bytes, coalesce(n_chunks, 0)::BIGINT AS n_chunks, coalesce(n_repeated, 0)::BIGINT AS n_repeated, coalesce(repeated_bytes, 0)::BIGINT AS repeated_bytes,
       coalesce(removed_bytes, 0)::BIGINT AS removed_bytes, coalesce(removed, '') AS removed, coalesce(first_ids, '') AS first_ids, coalesce(left_over.text, d.text) AS text
FROM d LEFT JOIN n_chunks USING (r) LEFT JOIN n_repeated USING (r) LEFT JOIN gone USING (r) LEFT JOIN firsts USING (r) LEFT JOIN left_over USING (r)""",
    "op4_exact_dedup": r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS len, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
       doc_id IS NOT DISTINCT FROM first_value(doc_id) OVER w AND len = first_value(len) OVER w AS kept, sha256(norm) AS text_sha256
FROM n WINDOW w AS (PARTITION BY norm ORDER BY len DESC, doc_id NULLS LAST)""",
    "op5_shard": r"""
WITH crc AS (
  SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(list_prepend(b, range(8)), lambda h, k: xor(h >> 1, CASE WHEN h & 1 = 1 THEN 3988292384 ELSE 0 END)) AS c
    FROM (SELECT unnest(range(256)) AS b))),
d AS (
  SELECT doc_id, (strlen(coalesce(text, '')) + 16)::BIGINT AS size, substr(md5(coalesce(text, '')), 1, 30) AS k,
         list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda x: ('0x' || x)::BIGINT) AS bytes
  FROM documents),
g AS (SELECT k, min(size) AS s, count(*) AS n FROM d GROUP BY k),
tot AS (SELECT coalesce(sum(s * n), 0)::BIGINT AS total FROM g),
big AS (SELECT k, s, n, greatest(1, total // (40 * s)) AS e FROM g, tot WHERE s * n * 4000 > total),
pieces AS (SELECT *, unnest(range(0, (n - 1) // e + 1)) AS piece FROM big),
dealt AS (
  SELECT *, least(e, n - piece * e) * s AS bytes, (row_number() OVER (ORDER BY least(e, n - piece * e) * s DESC, k, piece) - 1) % 80 AS i FROM pieces),
units AS (SELECT k, piece, bytes, CASE WHEN i < 40 THEN i ELSE 79 - i END AS shard FROM dealt),
load AS (SELECT r.range AS shard, coalesce(sum(bytes), 0)::BIGINT AS b FROM range(40) r LEFT JOIN units ON units.shard = r.range GROUP BY r.range),
lvl AS (
  SELECT min((small + below) // j) AS level FROM (
    SELECT (sum(b) OVER (ORDER BY b, shard))::BIGINT AS below, row_number() OVER (ORDER BY b, shard) AS j, total - (sum(b) OVER ())::BIGINT AS small FROM load, tot)),
ends AS (SELECT (sum(greatest(0, level - b)) OVER (ORDER BY shard))::BIGINT AS e FROM load, lvl),
small AS (
  SELECT k, s * n AS bytes, coalesce(sum(s * n) OVER (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS at_
  FROM g WHERE k NOT IN (SELECT k FROM big)),
placed AS (SELECT k, least(39, count(e)) AS shard FROM small LEFT JOIN ends ON 2 * e <= 2 * at_ + bytes GROUP BY k),
ranked AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST) - 1 AS r FROM d),
rows_ AS (
  SELECT doc_id, size, bytes, k, shard FROM ranked JOIN placed USING (k)
  UNION ALL SELECT doc_id, size, ranked.bytes, k, units.shard FROM ranked JOIN big USING (k) JOIN units ON units.k = ranked.k AND units.piece = r // e)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, bytes), lambda h, b: xor(h >> 8, t[1 + (xor(h, b) & 255)])), 4294967295)::BIGINT AS text_crc32,
       'bytes' AS law, shard::INTEGER AS shard, row_number() OVER (PARTITION BY shard ORDER BY k, doc_id NULLS FIRST) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM rows_, crc""",
    "op6_jaccard_join": r"""
WITH RECURSIVE w AS (
  SELECT row_number() OVER () AS r, doc_id,
         coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []::VARCHAR[]) AS w
  FROM documents),
places AS (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0),
grams AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM places),
sizes AS (SELECT r, count(*) AS n FROM grams GROUP BY r),
pairs AS (SELECT a.r AS x, b.r AS y, count(*) AS s FROM grams a JOIN grams b ON a.g = b.g AND a.r < b.r GROUP BY a.r, b.r),
links AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.r = x JOIN sizes q ON q.r = y WHERE 100 * s >= 80 * (p.n + q.n - s)),
both_ways AS (SELECT x, y FROM links UNION SELECT y, x FROM links),
reach AS (
  SELECT r AS x, r AS y FROM w
  UNION SELECT reach.x, b.y FROM reach JOIN both_ways b ON reach.y = b.x)
SELECT w.doc_id, coalesce(sizes.n, 0)::BIGINT AS n_shingles, c.component_id
FROM w LEFT JOIN sizes USING (r)
JOIN (SELECT reach.x AS r, min(v.doc_id) AS component_id FROM reach JOIN w v ON v.r = reach.y GROUP BY reach.x) c USING (r)""",
    "op9_line_dedup": r"""
WITH whole AS (SELECT row_number() OVER () AS r, doc_id, text, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
raw AS (SELECT r, doc_id, unnest(parts) AS x, unnest(range(0, len(parts))) AS line FROM whole),
l AS (SELECT r, doc_id, line, trim(regexp_replace(x, '[\x09\x0B-\x0D]', ' ', 'g'), ' ') AS x FROM raw),
seq AS (
  SELECT *, row_number() OVER (PARTITION BY r ORDER BY line) AS i, len(regexp_extract_all(x, '[^ ]+')) AS w FROM l WHERE x <> ''),
wins AS (
  SELECT doc_id, r, i, 1 AS span, x AS g FROM seq WHERE w >= 20
  UNION ALL SELECT a.doc_id, a.r, a.i, 2, a.x || chr(10) || b.x FROM seq a JOIN seq b ON b.r = a.r AND b.i = a.i + 1 WHERE a.w + b.w >= 20
  UNION ALL SELECT a.doc_id, a.r, a.i, 3, a.x || chr(10) || b.x || chr(10) || c.x
  FROM seq a JOIN seq b ON b.r = a.r AND b.i = a.i + 1 JOIN seq c ON c.r = a.r AND c.i = a.i + 2),
first AS (SELECT g, min({'n': doc_id IS NULL, 'd': doc_id, 'i': i}) AS f FROM wins GROUP BY g),
later AS (SELECT r, i, i + span AS e, f.n AS n, f.d AS d, i - f.i AS shift FROM wins JOIN first USING (g) WHERE {'n': doc_id IS NULL, 'd': doc_id, 'i': i} > f),
reached AS (
  SELECT *, max(e) OVER (PARTITION BY r, n, d, shift ORDER BY i, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM later),
heads AS (SELECT r, count(*) AS n_runs FROM reached WHERE upto IS NULL OR i > upto GROUP BY r),
firsts AS (SELECT r, string_agg(d, ',' ORDER BY d) AS first_ids FROM (SELECT DISTINCT r, d FROM later WHERE d IS NOT NULL) GROUP BY r),
gone AS (SELECT DISTINCT r, unnest(range(i, e)) AS i FROM later),
marked AS (
  SELECT seq.r, count(*) AS n_deleted, string_agg(line, ',' ORDER BY line) AS deleted, list(line) AS gone_lines
  FROM seq JOIN gone USING (r, i) GROUP BY seq.r),
left_over AS (
  SELECT raw.r, string_agg(x, chr(10) ORDER BY line) AS text FROM raw JOIN marked USING (r)
  WHERE NOT list_contains(gone_lines, line) GROUP BY raw.r),
counts AS (SELECT r, count(*) AS n FROM seq GROUP BY r)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_lines, coalesce(n_deleted, 0)::BIGINT AS n_deleted, coalesce(n_runs, 0)::BIGINT AS n_runs, coalesce(deleted, '') AS deleted,
       coalesce(first_ids, '') AS first_ids, CASE WHEN n_deleted > 0 THEN coalesce(left_over.text, '') ELSE whole.text END AS text
FROM whole LEFT JOIN counts USING (r) LEFT JOIN marked USING (r) LEFT JOIN heads USING (r) LEFT JOIN firsts USING (r) LEFT JOIN left_over USING (r)""",
    "op10_preferences": r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, ''), coalesce(text, '')) AS at_
  FROM conversations WHERE conv_id IS NOT NULL),
p AS (
  SELECT floor(conv_id / 2)::BIGINT AS pair_id, max(CASE WHEN conv_id % 2 = 0 THEN conv_id END) AS chosen_id,
         max(CASE WHEN conv_id % 2 <> 0 THEN conv_id END) AS rejected_id
  FROM (SELECT DISTINCT conv_id FROM t) GROUP BY 1),
d AS (
  SELECT pair_id, 'c' AS side, at_, role, text FROM p JOIN t ON t.conv_id = p.chosen_id
  UNION ALL SELECT pair_id, 'r', at_, role, text FROM p JOIN t ON t.conv_id = p.rejected_id),
pos AS (SELECT pair_id, at_, count(*) = 2 AND min(role) = max(role) AND min(text) = max(text) AS same FROM d GROUP BY 1, 2),
pre AS (
  SELECT pair_id, coalesce(min(CASE WHEN NOT same THEN at_ END) - 1, max(at_)) AS n_prompt FROM pos GROUP BY 1),
x AS (
  SELECT pair_id, side, at_, n_prompt, '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS x,
         length(role) + 5 AS head, role = 'assistant' AS learn FROM d JOIN pre USING (pair_id)),
y AS (
  SELECT *, (sum(length(x)) OVER (PARTITION BY pair_id, side ORDER BY at_))::BIGINT AS upto FROM x),
s AS (
  SELECT pair_id, side, any_value(n_prompt) AS n_prompt,
         coalesce(string_agg(x, '' ORDER BY at_) FILTER (WHERE at_ <= n_prompt), '') AS prompt,
         coalesce(string_agg(x, '' ORDER BY at_) FILTER (WHERE at_ > n_prompt), '') AS rest,
         coalesce(string_agg((upto - length(x) + head)::VARCHAR || '-' || upto::VARCHAR, ',' ORDER BY at_) FILTER (WHERE at_ > n_prompt AND learn), '') AS mask
  FROM y GROUP BY pair_id, side)
SELECT p.pair_id, chosen_id, rejected_id, coalesce(c.n_prompt, r.n_prompt, 0)::INTEGER AS n_prompt, coalesce(c.prompt, r.prompt, '') AS prompt,
       coalesce(c.rest, '') AS chosen, coalesce(r.rest, '') AS rejected, coalesce(c.mask, '') AS chosen_mask, coalesce(r.mask, '') AS rejected_mask
FROM p LEFT JOIN s c ON c.pair_id = p.pair_id AND c.side = 'c' LEFT JOIN s r ON r.pair_id = p.pair_id AND r.side = 'r'""",
}
