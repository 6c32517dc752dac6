"""Each operator against a plain Python version, on small tables that have all the odd cases."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.functions import monotonically_increasing_id

from tidelog.llm import bytetext, chat, common, decontam, exact, jaccard, lines, mixing, quality, rans, sharding, substrings, tokens

from . import data

BLANK = re.compile(r"[\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x20\x09-\x0D]+")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def some_docs(spark, n=60, seed=5):
    """Odd texts, groups of near copies, passages that documents share."""
    r = random.Random(seed)
    texts = data.odd_texts()
    passage = data.words(60, 99)
    for i in range(n):
        w = data.words(r.randint(5, 120), i % 12).split()
        for _ in range(r.randint(0, 3)):
            w[r.randrange(len(w))] = "edit"
        if i % 4 == 0:
            w[len(w) // 2 : len(w) // 2] = passage.split()
        texts.append(" ".join(w) if i % 2 else "\n".join(" ".join(w[k : k + 9]) for k in range(0, len(w), 9)))
    return data.docs(spark, texts)


def rows_of(df):
    return [r.asDict() for r in df.collect()]


def test_exact_dedup(spark):
    docs = some_docs(spark)
    got = Counter((r["doc_id"], r["keep_id"], r["group_size"], r["kept"], bytes(r["digest"]).hex()) for r in rows_of(exact.dedup(docs, memtable_rows=7)))
    rows = [(r["doc_id"], r["text"] or "") for r in rows_of(docs)]
    groups = defaultdict(list)
    for i, t in rows:
        groups[BLANK.sub("", t)].append((-len(t), i is None, i))
    want = Counter()
    for i, t in rows:
        norm = BLANK.sub("", t)
        best = min(groups[norm], key=lambda x: (x[0], x[1], x[2] or 0))
        want[(i, best[2], len(groups[norm]), i == best[2] and len(t) == -best[0], hashlib.sha256(norm.encode()).hexdigest())] += 1
    assert got == want


def test_exact_dedup_survives_digest_collisions(spark):
    """With a digest of four bits, only the verification of bytes keeps unlike texts apart."""
    from pyspark.sql import functions as F

    docs = some_docs(spark)
    weak = exact.dedup(docs, digest=lambda t: F.encode(F.substring(F.md5(t), 1, 1), "utf-8"))
    strong = exact.dedup(docs)
    columns = ["doc_id", "keep_id", "group_size", "kept"]
    assert Counter(map(tuple, weak.select(*columns).collect())) == Counter(map(tuple, strong.select(*columns).collect()))


def test_index_filters(spark):
    """Runs that can't hold a digest are not opened, and only digests that two runs may hold are merged."""
    from pyspark.sql import functions as F

    rows = [(i, data.words(9, i % 900)) for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    entries = common.saved(docs.select("doc_id", (-F.length("text")).cast("long").alias("_rank"), exact.sha256(exact.normalised(F.col("text"))).alias("digest")))
    index = exact.DigestIndex(spark, memtable_rows=100)
    index.ingest(entries, 1000)
    assert len(index.runs) == 10
    held = {bytes(r["digest"]): (set(r["runs"]), set(r["_runs"])) for r in index.may_hold(index.level0().groupBy("digest").agg(F.collect_set("_run").alias("runs"))).collect()}
    assert len(held) == 900 and all(true <= said for true, said in held.values())
    assert sum(len(said - true) for true, said in held.values()) < 0.05 * 900 * 9
    one = hashlib.sha256(data.words(9, 500).replace(" ", "").encode()).digest()
    opened = {f.split("/_run=")[1].split("/")[0] for f in index.lookup([one]).inputFiles()}
    assert opened == {str(i) for i in held[one][1]} and len(opened) < 10 and [r["n"] for r in index.lookup([one]).collect()] == [1]
    assert index.lookup([b"not there"]).count() == 0
    level = index.compact()
    two = hashlib.sha256(data.words(9, 50).replace(" ", "").encode()).digest()
    assert level.count() == 900 and [r["n"] for r in index.lookup([two]).collect()] == [2] and level.agg(F.sum("n")).first()[0] == 1000


def brute_targets(sizes):
    """Words due to each source of sizes: shares of 150 % by weight, capped at twice its size, the excess shared out again."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        free = [s for s in order if s not in capped]
        left = total - sum(2 * sizes[s] for s in capped)
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        over = {s for s in free if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def brute_mix(rows):
    """Of each row the words that the mix takes, in the order of rows."""
    sizes, sources = defaultdict(int), defaultdict(list)
    for n, r in enumerate(rows):
        size = len(WORD.findall(r["text"] or ""))
        sizes[r["source"]] += size
        text_md5 = "" if r["text"] is None else hashlib.md5(r["text"].encode()).hexdigest()
        key = hashlib.md5(f"mix:{text_md5 if r['doc_id'] is None else r['doc_id']}".encode()).hexdigest()[:15]
        sources[r["source"]].append((key, r["doc_id"] is None, r["doc_id"] or 0, size, n))
    target, taken = brute_targets(sizes), [0] * len(rows)
    for source, docs in sources.items():
        left = int(target[source] + 0.5)
        while left > 0:
            for *_, size, n in sorted(docs):
                taken[n] += min(size, left)
                left -= min(size, left)
    return taken, target


def test_mixing(spark):
    docs = some_docs(spark)
    got = rows_of(mixing.mix(docs))
    rows = rows_of(docs)
    taken, target = brute_mix(rows)
    sizes = defaultdict(int)
    for r in rows:
        sizes[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert Counter((r["doc_id"], r["size"], r["source_size"], r["taken"]) for r in got) == Counter((r["doc_id"], len(WORD.findall(r["text"] or "")), sizes[r["source"]], t) for r, t in zip(rows, taken, strict=True))
    done = defaultdict(int)
    for r in got:
        assert r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["taken"] <= 2 * r["size"]
        done[r["source"]] += r["taken"]
    assert all(abs(done[s] - target[s]) <= 0.5 for s in target)
    again = Counter(map(str, rows_of(mixing.mix(docs.repartition(5)))))
    assert again == Counter(map(str, got))


def test_mixed_documents(spark):
    docs = some_docs(spark)
    want = defaultdict(int)
    for r in rows_of(mixing.mix(docs)):
        want[r["source"]] += r["taken"]
    got = defaultdict(int)
    out = mixing.mixed_documents(docs)
    assert out.columns == docs.columns
    for r in rows_of(out):
        got[r["source"]] += len(WORD.findall(r["text"] or ""))
        assert r["text"] is None or r["n_chars"] == len(r["text"])
    assert {k: v for k, v in got.items() if v} == {k: v for k, v in want.items() if v}


def brute_contamination(docs, items, size=10):
    windows = defaultdict(set)
    for item, text in items:
        w = TERM.findall((text or "").translate(LOWER))
        n = min(size, len(w))
        for i in range(len(w) - n + 1 if w else 0):
            windows[tuple(w[i : i + n])].add(str(item))
    out = Counter()
    for r in docs:
        w = TERM.findall((r["text"] or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (k := tuple(w[i : i + n])) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[k]
        out[(r["doc_id"], len(w), len(hit), len(found), decontam.items_digest(list(found)), bool(hit))] += 1
    return out


@pytest.mark.parametrize("block_bytes", [decontam.BLOCK_BYTES, 200])
def test_decontamination(spark, block_bytes):
    docs = some_docs(spark)
    texts = [r["text"] for r in rows_of(docs) if r["text"]]
    items = [(1, " ".join(data.words(60, 99).split()[:14])), (2, data.words(60, 99).upper()), (3, "edit"), (3, "two, words"), (10, None), (11, "..."), (12, texts[-1][:80]), (13, data.words(30, 1234)), (14, "日本語 テキスト")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontam.scan(docs, bench, block_bytes=block_bytes)
    assert Counter(map(tuple, decontam.digest(found).collect())) == brute_contamination(rows_of(docs), items)
    clean = decontam.decontaminate(docs, bench, block_bytes=block_bytes)
    assert clean.columns == docs.columns
    assert clean.count() == sum(n for k, n in brute_contamination(rows_of(docs), items).items() if not k[-1])
    cut = decontam.decontaminate(docs, bench, mode="spans", block_bytes=block_bytes)
    assert cut.columns == docs.columns and cut.count() >= clean.count()
    assert "edit" not in " ".join(r["text"] or "" for r in rows_of(cut)).split()


def shingles(text):
    w = WORD.findall((text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)])


def brute_components(rows):
    sets = [shingles(r["text"]) for r in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= 80 * len(a | sets[j]):
                parent[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        ids = [x for x in (least.get(find(i)), r["doc_id"]) if x is not None]
        least[find(i)] = min(ids) if ids else None
    return Counter((r["doc_id"], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


@pytest.mark.parametrize("group,hot", [(jaccard.GROUP, jaccard.HOT), (300, jaccard.HOT), (jaccard.GROUP, 2), (300, 3)])
def test_jaccard_join(spark, group, hot):
    """group 300 reduces candidate components and cuts them into blocks; hot 2 and 3 make hashes and classes hot."""
    docs = some_docs(spark, 120)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(docs, group=group, tight=min(group, jaccard.TIGHT), hot=hot)))
    assert got == brute_components(rows_of(docs))


def test_jaccard_join_of_words_built_to_collide(spark):
    """Words that a polynomial modulo 2^64 can't tell apart, whatever its base: a Thue-Morse word and its complement."""
    flip = str.maketrans("ab", "ba")
    texts = []
    for n in (256, 1024, 2048, 8192):
        word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
        texts += [word, word.translate(flip), f"one {word} two three four five", f"one {word.translate(flip)} two three four five"]
    docs = data.table(spark, [(i, t, "en", "s", 0) for i, t in enumerate(texts)])
    assert Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(docs))) == brute_components([{"doc_id": i, "text": t} for i, t in enumerate(texts)])
    raw = np.frombuffer("".join(texts).encode(), np.uint8)
    ends = np.cumsum([len(t) for t in texts])
    for column in bytetext.span_hashes(raw, ends - [len(t) for t in texts], ends, wide=True):
        assert len(set(column.tolist())) == len(texts)


def test_jaccard_join_with_clashing_class_names(spark):
    """With names of six bits nearly all classes share one; their checks keep them apart."""
    docs = some_docs(spark, 120)
    got = Counter((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows_of(jaccard.join(docs, bits=6)))
    assert got == brute_components(rows_of(docs))


def test_jaccard_near_the_threshold(spark):
    """Chains of edits whose similarity lies on both sides of 0.8."""
    r = random.Random(8)
    texts = []
    for g in range(12):
        w = data.words(60, 1000 + g).split()
        for _ in range(8):
            texts.append(" ".join(w))
            for _ in range(r.randint(1, 2)):
                w[r.randrange(len(w))] = f"e{r.random()}"
    docs = data.docs(spark, texts)
    got = Counter((x["doc_id"], x["n_shingles"], x["component_id"]) for x in rows_of(jaccard.join(docs)))
    assert got == brute_components(rows_of(docs))


def test_representatives_of_null_and_repeated_ids(spark):
    """Null ids whose texts are unique, empty or copies, and ids that repeat, with texts of their own and copies."""
    a, b, c = (data.words(80, 600 + i) for i in range(3))
    near = a.replace(a.split()[40], "changed")
    rows = [(None, a), (1, a), (None, near), (None, b), (None, b), (None, ""), (2, c), (2, near), (3, c), (3, c), (4, data.words(80, 604)), (4, data.words(80, 605))]
    docs = data.table(spark, [(i, t, "en", "s", len(t)) for i, t in rows]).repartition(3)
    kept = Counter((r["doc_id"], r["text"]) for r in rows_of(jaccard.representatives(docs)))
    assert kept == Counter([(1, a), (None, b), (None, ""), (2, c), *rows[-2:]])


def test_representatives_equal_brute_components(spark):
    """One row of each component, and none with a larger doc_id than another row of its own has."""
    docs = common.saved(some_docs(spark).withColumn("source", monotonically_increasing_id().cast("string")))
    rows = rows_of(docs)
    by_row = brute_components([{"doc_id": i, "text": r["text"]} for i, r in enumerate(rows)])
    assert sum(by_row.values()) == len(rows)
    least = {}
    for i, _, component in by_row:
        best = (rows[i]["doc_id"] is None, rows[i]["doc_id"] or 0)
        least[component] = min(least.get(component, best), best)
    got = rows_of(jaccard.representatives(docs))
    assert len({r["source"] for r in got}) == len(got) < len(rows)
    assert Counter((r["doc_id"] is None, r["doc_id"] or 0) for r in got) == Counter(least.values())


def test_link_with_large_groups():
    """Many near copies of one set, searched once, and sets in the ring around them."""
    r = np.random.default_rng(3)
    base = r.integers(0, 1 << 60, 200).astype(np.uint64)
    sets = [np.unique(np.concatenate([np.delete(base, r.integers(0, 200, k)), r.integers(0, 1 << 60, k).astype(np.uint64)])) for k in r.integers(0, 45, 150)]
    roots = jaccard.link(sets)
    found = [set(s.tolist()) for s in sets]
    parent = list(range(len(sets)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if 5 * len(found[i] & found[j]) >= 4 * len(found[i] | found[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    assert roots.tolist() == [find(i) for i in range(len(sets))]


def brute_shards(rows, n):
    """(doc_id, size, crc, shard, slot) by the rule of sharding's docstring."""
    keyed = sorted(((hashlib.md5((r["text"] or "").encode()).hexdigest()[:30], r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in rows))
    groups = defaultdict(list)
    for k, some, i, t in keyed:
        groups[k].append((some, i, len(t.encode()) + 16, zlib.crc32(t.encode())))
    total = sum(x[2] for g in groups.values() for x in g)
    units, small = [], []
    for k, g in groups.items():
        size, each = g[0][2], max(1, total // (n * g[0][2]))
        if size * len(g) * 100 * n > total:
            units += [(-size * len(g[a : a + each]), k, a // each, g[a : a + each]) for a in range(0, len(g), each)]
        else:
            small.append((k, g))
    load, out = [0] * n, [[] for _ in range(n)]
    for i, (size, k, _, g) in enumerate(sorted(units, key=lambda u: u[:3])):
        s = i % (2 * n) if i % (2 * n) < n else 2 * n - 1 - i % (2 * n)
        load[s] -= size
        out[s] += [(k, *x) for x in g]
    rest, below = total - sum(load), np.cumsum(sorted(load))
    level = min((rest + int(b)) // (j + 1) for j, b in enumerate(below))
    ends, at = np.cumsum([max(0, level - x) for x in load]), 0
    for k, g in small:
        size = g[0][2] * len(g)
        out[min(n - 1, sum(2 * e <= 2 * at + size for e in ends.tolist()))] += [(k, *x) for x in g]
        at += size
    return Counter((i if some else None, size, crc, s, slot) for s in range(n) for slot, (_, some, i, size, crc) in enumerate(sorted(out[s])))


def shards_of(df):
    return Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"], r["slot"]) for r in rows_of(df))


@pytest.mark.parametrize("ranges", [None, 2])
def test_sharding(spark, ranges):
    """ranges 2: overfull ranges are subdivided."""
    docs = some_docs(spark, 300)
    assert shards_of(sharding.shard(docs, 7, ranges=ranges)) == brute_shards(rows_of(docs), 7)


@pytest.mark.parametrize("ranges", [None, 3])
def test_sharding_of_groups(spark, ranges):
    """Groups of 1, 4, 30 and 150 percent of a shard: only the last is parted, into as many pieces as it needs; sizes stay near."""
    n, size = 8, 100
    groups = {"a": 10, "b": 40, "c": 300, "d": 1500}
    texts = [f"{c * 4} {c * (size - 16 - 5)}" for c, times in groups.items() for _ in range(times)]
    texts += [f"{i:0{size - 16}d}" for i in range(n * 1000 - len(texts))]
    random.Random(3).shuffle(texts)
    docs = data.table(spark, [(i, t, "en", "s", 1) for i, t in enumerate(texts)]).repartition(5)
    out = common.saved(sharding.shard(docs, n, ranges=ranges))
    assert shards_of(out) == brute_shards(rows_of(docs), n)
    sizes, where = Counter(), defaultdict(Counter)
    for r in rows_of(out):
        sizes[r["shard"]] += r["size"]
        where[texts[r["doc_id"]][0] if texts[r["doc_id"]][0] in groups else texts[r["doc_id"]]][r["shard"]] += 1
    assert {len(w) for g, w in where.items() if g != "d"} == {1} and sorted(where["d"].values()) == [500, 1000]
    assert all(abs(sizes[s] - 1000 * size) <= 1000 * size / sharding.LARGE for s in range(n))


def test_rans_round_trip():
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 300, 70_001):
        ids = np.minimum(r.zipf(1.3, n), 49_000).astype(np.uint32)
        table = rans.Frequencies(np.bincount(ids, minlength=49_409))
        raw = rans.encode(ids, table)
        assert (rans.decode(raw, table) == ids).all()
        if n > 60_000:
            block = rans.Block(raw)
            step = block.every * block.lanes
            assert len(block.marks) > 1 and all((block.decode(table, k, k + 1) == ids[k * step : (k + 1) * step]).all() for k in range(len(block.marks)))
            with pytest.raises(ValueError):
                rans.decode(raw[:-1] + bytes([raw[-1] ^ 1]), table)


def test_token_container(spark):
    from tokenizers import Tokenizer

    docs = some_docs(spark)
    config = tokens.default_config()
    tokenizer = Tokenizer.from_str(config)
    path = f"{common.scratch_dir(spark)}/container-test"
    tokens.write(docs, config, path, segment=5000)
    got = sorted((r["start"], r["n_tokens"], r["ids_crc32"], r["doc_id"], r["ids"]) for r in rows_of(tokens.read(spark, path, with_ids=True)))
    want = Counter()
    for r in rows_of(docs):
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        want[(r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), tuple(ids))] += 1
    assert Counter((g[3], g[1], g[2], tuple(g[4])) for g in got) == want
    assert [g[0] for g in got] == np.cumsum([0, *(g[1] for g in got[:-1])]).tolist()
    ids = [g[3] for g in got]
    assert ids == sorted(ids, key=lambda i: (i is None, i or 0))


def test_encoder_equals_the_tokenizer():
    from tokenizers import Tokenizer

    config = tokens.default_config()
    tokenizer, texts = Tokenizer.from_str(config), [t or "" for t in data.odd_texts()] + ["it's I'LL a.́ (x) 'S", "İ ΟΔΟΣ क़ ﬁ K Å ŉ ß ẞ \x85 ​ ", "abcdefgh abcdefghi abcdefghabcdefghi"]
    for encoder in (tokens.Encoder(config), tokens.Encoder(config, slots=7, pool=50)):
        for _ in range(2):
            found = [x[:-1].tolist() for n, flat in encoder(pa.array(texts), 1) for x in np.split(flat, np.cumsum(n)[:-1])]
            assert found == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_words_of_bytes():
    texts = [t or "" for t in data.odd_texts()]
    for _, _, raw, offsets in bytetext.batches(pa.array(texts)):
        starts, ends, first = bytetext.word_spans(~bytetext.BLANK[raw], offsets)
        hashes = bytetext.word_hashes(raw, starts, ends)
        found = [[raw[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)]
        assert found == [WORD.findall(t) for t in texts]
        every = [w for ws in found for w in ws]
        assert len({(w, h) for w, h in zip(every, hashes.tolist(), strict=True)}) == len(set(every)) == len(set(hashes.tolist()))


def finalised(x):
    for factor in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        x = (x ^ x >> 33) * factor % (1 << 64)
    return x ^ x >> 33


BRUTE_GEAR = [finalised(b) >> 48 for b in range(1, 257)]


def brute_gear(raw):
    h, out = 0, []
    for b in raw:
        h = ((h << 1) + BRUTE_GEAR[b]) & 0xFFFF
        out.append(h)
    return out


def brute_chunks(raw):
    """Starts and ends of the chunks of one text."""
    proposed = [k + 1 for k, h in enumerate(brute_gear(raw)) if k >= 15 and h >> 12 == 0]
    cuts = [p for i, p in enumerate(proposed) if not i or p - proposed[i - 1] >= 12]
    ends = sorted({*cuts, len(raw)} - {0})
    return [(a, min(a + 128, e)) for s, e in zip([0, *ends[:-1]], ends, strict=True) for a in range(s, e, 128)] if raw else []


def test_gear_and_chunks():
    texts = [t for t in data.odd_texts() if t]
    for _, _, raw, offsets in bytetext.batches(pa.array(texts)):
        h = substrings.gear(raw)
        starts, ends, owner = substrings.chunks(raw, offsets)
        for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)):
            alone = brute_gear(raw[a:b].tolist())
            assert h[a + 15 : b].tolist() == alone[15:]
            mine = owner == i
            assert starts[mine][0] == a and ends[mine][-1] == b and (starts[mine][1:] == ends[mine][:-1]).all()
            assert (ends[mine] - starts[mine]).max() <= substrings.MAX
            assert [(int(s - a), int(e - a)) for s, e in zip(starts[mine], ends[mine], strict=True)] == brute_chunks(raw[a:b].tobytes())
    moved, same = "zz yy " + data.words(400, 4), data.words(400, 4)
    pieces = []
    for t in (moved, same):
        raw = np.frombuffer(t.encode(), np.uint8)
        s, e, _ = substrings.chunks(raw, np.array([0, len(raw)]))
        pieces.append({t[a:b] for a, b in zip(s, e, strict=True)})
    assert len(pieces[0] & pieces[1]) >= len(pieces[1]) - 3


def brute_substrings(rows, min_words=20):
    """Of rows (doc_id, text) in their order: doc_id, chunks, repeated ones and their bytes, spans, keepers, text left."""
    order = sorted(range(len(rows)), key=lambda n: (rows[n][0] is None, rows[n][0] or 0, n))
    first, found = {}, []
    for n in order:
        raw = (rows[n][1] or "").encode()
        words = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
        units = [u for a, b in words if b - a > 32 for u in range(a + 6, b, 6)]
        out, last = [], {}
        for a, b in brute_chunks(raw):
            x = raw[a:b]
            new = x not in first
            first.setdefault(x, n)
            ruler = first[x] == n and last.get(x) == a
            last[x] = b
            count = sum(a <= w < b for w, _ in words) + (0 if ruler else sum(a <= u < b for u in units))
            out.append((a, b, count, None if new else first[x]))
        found.append((n, raw, out))
    result = Counter()
    for n, raw, chunks in found:
        runs, run = [], []
        for c in [*chunks, (0, 0, 0, None)]:
            if c[3] is not None:
                run.append(c)
            elif run:
                runs.append(run)
                run = []
        spans, ids, left, at = [], set(), b"", 0
        for run in runs:
            if sum(c[2] for c in run) >= min_words:
                a, b = run[0][0], run[-1][1]
                while a < b and raw[a] & 0xC0 == 0x80:
                    a += 1
                while a < b < len(raw) and raw[b] & 0xC0 == 0x80:
                    b -= 1
                spans.append((a, b))
                left, at = left + raw[at:a], b
                ids |= {rows[c[3]][0] for c in run} - {None}
        repeated = [c for c in chunks if c[3] is not None]
        result[(rows[n][0], len(raw), len(chunks), len(repeated), sum(b - a for a, b, *_ in repeated), sum(b - a for a, b in spans), tuple(spans), tuple(sorted(ids)), (left + raw[at:]).decode())] += 1
    return result


@pytest.mark.parametrize("repeats,min_words", [(False, 20), (True, 20), (True, 0)])
def test_substring_dedup(spark, repeats, min_words):
    """repeats: rows without doc_id and rows that share one; min_words 0 cuts every repeated chunk."""
    r = random.Random(11)
    texts = [t for t in (x["text"] for x in rows_of(some_docs(spark)))]
    halves = [data.words(30, 900), data.words(30, 901)]
    texts += [*halves, " ".join(halves), "z" * 900, "z" * 900, "ab" * 400]
    ids = [r.choice([None, *range(20)]) if repeats else i for i in range(len(texts))]
    rows = list(zip(ids, texts, strict=True))
    docs = data.table(spark, [(i, t, "en", f"own {n}", 0) for n, (i, t) in enumerate(rows)]).coalesce(1)
    from pyspark.sql import functions as F

    out = rows_of(substrings.dedup(docs.withColumns({c: F.col("source") for c in ("_row", "_id", "_rank", "removed", "digest")}), min_words=min_words))
    got = Counter((x["doc_id"], x["n_bytes"], x["n_chunks"], x["n_repeated"], x["repeated_bytes"], x["removed_bytes"], tuple((s["start"], s["end"]) for s in x["removed"]), tuple(x["first_ids"]), x["text"]) for x in out)
    assert got == brute_substrings(rows, min_words)
    assert all(x["_row"] == x["_id"] == x["_rank"] == x["digest"] == x["source"] for x in out)
    if not repeats:
        assert {tuple(x["first_ids"]) for x in out if x["text"] is not None} >= {(len(texts) - 6, len(texts) - 5)}


def test_substring_dedup_of_planted_passages(spark):
    passages = [data.words(60, 7000 + i) for i in range(30)]
    texts = [data.words(150, 8000 + i) + " " + passages[i % 30] + " " + data.words(80, 9000 + i) for i in range(90)] + [data.words(200, 9500 + i) for i in range(30)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r for r in rows_of(substrings.dedup(data.table(spark, rows)))}
    assert all(not got[i]["removed"] for i in [*range(30), *range(90, 120)])
    hit = [i for i in range(30, 90) if got[i]["removed"] and i % 30 in got[i]["first_ids"]]
    assert len(hit) >= 59
    for i in hit:
        assert passages[i % 30] not in got[i]["text"] and data.words(150, 8000 + i)[:600] in got[i]["text"]


def test_substring_dedup_without_blanks(spark):
    """Passages and copies in text without blanks go; a short address that texts share stays, and so does a ruler."""
    r = random.Random(8)

    def han(n):
        return "".join(chr(0x4E00 + r.randrange(4000)) for _ in range(n))

    def thai(n):
        return "".join(chr(0x0E01 + r.randrange(46)) for _ in range(n))

    code = "".join(r.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/") for _ in range(3000))
    address = "https://example.org/" + code[:50]
    shared, other = han(400), thai(400)
    texts = [han(300) + shared + han(300), han(300) + shared + han(300), thai(300) + other, other + thai(300), code, code]
    texts += [f"{data.words(40, 700 + i)} {address} {data.words(40, 710 + i)}" for i in range(2)] + [data.words(40, 720) + "\n" + "=" * 1000]
    twice = han(300)
    texts += [twice + han(100) + twice, "z" * 3000, "z" * 3000]
    got = {x["doc_id"]: x for x in rows_of(substrings.dedup(data.table(spark, [(i, t, "zh", "s", len(t)) for i, t in enumerate(texts)])))}
    for i, size in ((1, 1200), (3, 1200), (5, 3000), (9, 900), (11, 3000)):
        assert size - 400 <= got[i]["removed_bytes"] <= size, i
    assert got[5]["text"] == "" and got[11]["text"] == "" and got[5]["first_ids"] == [4]
    assert sorted(i for i in got if not got[i]["removed"]) == [0, 2, 4, 6, 7, 8, 10]


def brute_lines(rows, run=3):
    seqs = []
    for r in rows:
        parts = [(k, re.sub(r"[\x09\x0B-\x0D]", " ", x).strip(" ")) for k, x in enumerate((r["text"] or "").split("\n"))]
        seqs.append((r["doc_id"], [(k, x) for k, x in parts if x]))
    first = {}
    for d, s in seqs:
        for i in range(len(s) - run + 1):
            g, at = tuple(x for _, x in s[i : i + run]), (d is None, d or 0, i)
            first[g] = min(first.get(g, at), at)
    out = Counter()
    for d, s in seqs:
        gone = set()
        for i in range(len(s) - run + 1):
            if first[tuple(x for _, x in s[i : i + run])] < (d is None, d or 0, i):
                gone |= {s[k][0] for k in range(i, i + run)}
        out[(d, len(s), tuple(sorted(gone)))] += 1
    return out


@pytest.mark.parametrize("run,gram", [(3, 2), (4, 2), (2, 2), (3, 1)])
def test_line_dedup(spark, run, gram):
    r = random.Random(6)
    pool = [data.words(3, i) for i in range(8)]
    docs = data.docs(spark, data.odd_texts() + ["\n".join(r.choice(pool) + r.choice(["", "\t", " \r"]) for _ in range(r.randint(0, 14))) for _ in range(60)])
    out = rows_of(lines.dedup(docs, run=run, gram=gram, min_words=None))
    assert Counter((x["doc_id"], x["n_lines"], tuple(x["deleted"])) for x in out) == brute_lines(rows_of(docs), run)
    for x in out:
        assert x["n_deleted"] == len(x["deleted"])


def brute_words(rows, min_words, run=3):
    """Numbers of lines that go by runs of run lines, or of fewer lines and min_words words; a Counter as brute_lines has it."""
    seqs = []
    for r in rows:
        parts = [(k, re.sub(r"[\x09\x0B-\x0D]", " ", x).strip(" ")) for k, x in enumerate((r["text"] or "").split("\n"))]
        seqs.append((r["doc_id"], [(k, x) for k, x in parts if x]))
    runs = [
        (tuple(x for _, x in s[i : i + m]), (d is None, d or 0, i), n, [k for k, _ in s[i : i + m]])
        for n, (d, s) in enumerate(seqs) for m in range(1, run + 1) for i in range(len(s) - m + 1)
        if m == run or sum(len(BLANK.split(x)) for _, x in s[i : i + m]) >= min_words
    ]
    first = {}
    for g, at, _, _ in runs:
        first[g] = min(first.get(g, at), at)
    gone = defaultdict(set)
    for g, at, n, numbers in runs:
        if first[g] < at:
            gone[n] |= set(numbers)
    return Counter((d, len(s), tuple(sorted(gone[n]))) for n, (d, s) in enumerate(seqs))


@pytest.mark.parametrize("run,gram", [(3, 2), (2, 1), (1, 1)])
def test_line_dedup_by_words(spark, run, gram):
    r = random.Random(7)
    pool = [data.words(r.choice((3, 9, 12, 25)), 40 + i) for i in range(20)]
    docs = data.docs(spark, data.odd_texts() + ["\n".join(r.choice(pool) + r.choice(["", "\t", " \r"]) for _ in range(r.randint(0, 7))) for _ in range(40)])
    out = rows_of(lines.dedup(docs, run=run, gram=gram, min_words=20))
    assert Counter((x["doc_id"], x["n_lines"], tuple(x["deleted"])) for x in out) == brute_words(rows_of(docs), 20, run)


def test_line_dedup_of_planted_passages(spark):
    """A passage on one line between lines of the document's own, and copies of a document of one and of two lines."""
    passage, two = data.words(60, 400), data.words(12, 401) + "\n" + data.words(12, 402)
    texts = [*(f"{data.words(8, 410 + i)}\n{passage}\n{data.words(8, 420 + i)}" for i in range(3)), passage, two, two, "a short line", "a short line"]
    docs = data.table(spark, [(i, t, "en", "s", len(t)) for i, t in enumerate(texts)])
    got = {x["doc_id"]: list(x["deleted"]) for x in rows_of(lines.dedup(docs, min_words=20))}
    assert got == {0: [], 1: [1], 2: [1], 3: [0], 4: [], 5: [0, 1], 6: [], 7: []}
    assert not any(x["deleted"] for x in rows_of(lines.dedup(docs, min_words=None)))


def test_line_dedup_runs(spark):
    """A match is extended both ways over all lines that agree, and names the place that stays."""
    own = iter(data.words(4, 5000 + i) for i in range(100))
    passage = [data.words(4, 4900 + i) for i in range(9)]
    texts = ["\n".join([next(own), *passage, next(own)]), "\n\n".join([next(own), next(own), *passage, next(own), *passage[2:6]]), "\n".join(passage[:2])]
    rows = [(7, texts[0], "own", "own", 0), (9, texts[1], "own", "own", 0), (None, texts[2], "own", "own", 0)]
    docs = data.table(spark, rows).withColumnsRenamed({"lang": "_row", "source": "_n"})
    got = {x["doc_id"]: x for x in rows_of(lines.dedup(docs, min_words=None))}
    assert [tuple(r) for r in got[9]["runs"]] == [(2, 11, 7, 1), (12, 16, 7, 3)] and got[9]["n_deleted"] == 13
    assert got[7]["runs"] == got[None]["runs"] == [] and got[7]["text"] == texts[0]
    assert got[9]["text"].split("\n\n")[:2] == texts[1].split("\n\n")[:2]
    assert all((x["_row"], x["_n"]) == ("own", "own") for x in got.values())


def test_line_dedup_of_very_long_texts(spark):
    """Time grows with the lines of a text, not with their square."""
    took = []
    for n in (20_000, 160_000):
        docs = common.saved(data.table(spark, [(0, "\n".join(f"line {i}" for i in range(n)), "en", "s", 0), (1, "\n".join(f"line {i}" for i in range(n)) + "\nend", "en", "s", 0)]))
        began = time.monotonic()
        got = {x["doc_id"]: x for x in rows_of(lines.dedup(docs).select("doc_id", "n_deleted", "text"))}
        took.append(time.monotonic() - began)
        assert got[1]["n_deleted"] == n and got[1]["text"] == "end" and got[0]["n_deleted"] == 0
    assert took[1] < 20
    began = time.monotonic()
    same = rows_of(lines.dedup(common.saved(data.table(spark, [(0, "the same line\n" * 160_000, "en", "s", 0)]))).select("n_deleted", "text"))
    assert same[0]["n_deleted"] == 160_000 - 1 and same[0]["text"].strip() == "the same line" and time.monotonic() - began < 20


def test_preferences(spark):
    turns = [(0, 0, "user", "hi"), (0, 1, "assistant", "yes"), (0, 2, "user", "more"), (0, 3, "assistant", "good"), (1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (1, 5, "user", "more"), (1, 9, "assistant", "bad"), (1, 10, "user", None),
             (2, 0, None, None), (5, 0, "user", "alone"), (6, 0, "user", "q"), (6, 0, "user", "q"), (7, 0, "user", "q"), (None, 0, "user", "x"), (-2, 0, "assistant", "é😀"), (-1, None, "user", "z")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r["pair_id"]: r for r in rows_of(chat.preferences(frame, chat.adjacent_pairs(frame)))}
    assert set(got) == {0, 1, 2, 3, -1}
    zero = got[0]
    assert zero["n_prompt"] == 3 and zero["prompt"].count("<|end|>") == 3
    assert zero["chosen"] == "<|assistant|>\ngood<|end|>\n" and zero["rejected"] == "<|assistant|>\nbad<|end|>\n<|user|>\n<|end|>\n"
    for side in ("chosen", "rejected"):
        whole = zero["prompt"] + zero[side]
        assert [whole[m["start"] : m["end"]] for m in zero[f"{side}_mask"]] == [("good" if side == "chosen" else "bad") + "<|end|>\n"]
    assert got[1]["prompt"] == "" and got[1]["chosen"] == "<|" + "|>\n<|end|>\n" and got[1]["rejected"] == ""
    assert got[2]["chosen_id"] is None and got[2]["rejected"] == "<|user|>\nalone<|end|>\n"
    assert got[3]["n_prompt"] == 1 and got[3]["chosen"] == "<|user|>\nq<|end|>\n"
    assert [(m["start"], m["end"]) for m in got[-1]["chosen_mask"]] == [(14, 24)]


def brute_preferences(turns):
    """Of turns (conv_id, turn, role, text): each pair's ids, prompt turns, texts and spans that are learnt."""
    chats = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            chats[c].append((t is None, t or 0, role or "", text or ""))
    out = {}
    for pair in {c // 2 for c in chats}:
        sides = [[(role, text) for _, _, role, text in sorted(chats.get(c, []))] for c in (2 * pair, 2 * pair + 1)]
        n = 0
        while all(len(s) > n for s in sides) and sides[0][n] == sides[1][n]:
            n += 1

        def render(rows):
            return "".join(f"<|{role}|>\n{text}<|end|>\n" for role, text in rows)

        prompt, masks = render(sides[0][:n]), []
        for side in sides:
            at, spans = len(prompt), []
            for role, text in side[n:]:
                end = at + len(render([(role, text)]))
                if role == "assistant":
                    spans.append((at + len(f"<|{role}|>\n"), end))
                at = end
            masks.append(tuple(spans))
        ids = [c if c in chats else None for c in (2 * pair, 2 * pair + 1)]
        out[pair] = (*ids, n, prompt, *(render(s[n:]) for s in sides), *masks)
    return out


def test_preferences_of_random_chats(spark):
    """Also with columns that have the names of results and of the operator's own columns."""
    from pyspark.sql import functions as F

    r = random.Random(9)
    turns = []
    for pair in range(-5, 60):
        shared = [(r.choice(["user", "assistant", "", None]), r.choice(["a", "bb", "é😀", "", None, data.words(200, pair)])) for _ in range(r.randint(0, 4))]
        for c in (2 * pair, 2 * pair + 1):
            rows = shared[: r.randint(0, len(shared))] + [(r.choice(["user", "assistant"]), data.words(r.randint(0, 4), r.randrange(6))) for _ in range(r.randint(0, 3))]
            turns += [(c, t if r.random() < 0.9 else None, role, text) for t, (role, text) in enumerate(rows)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(4)
    frame = frame.withColumns({c: F.lit(f"own {c}") for c in ("pair_id", "side", "at", "n_prompt", "prompt", "part", "rows", "chosen", "p", "c", "r", "learn", "head")})
    got = {x["pair_id"]: x for x in rows_of(chat.preferences(frame, chat.adjacent_pairs(frame)))}
    names = ("chosen_id", "rejected_id", "n_prompt", "prompt", "chosen", "rejected")
    assert {k: (*(x[n] for n in names), *(tuple((m["start"], m["end"]) for m in x[n]) for n in ("chosen_mask", "rejected_mask"))) for k, x in got.items()} == brute_preferences(turns)


def brute_statistics(raw):
    """The row of statistics of one text, by plain Python."""
    n = len(raw)
    words = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    lines = [x for x in raw.split(b"\n") if x]
    some, rows = max(1, len(words)), max(1, len(lines))
    classes = [
        lambda b: b < 128 and chr(b).isalpha(), lambda b: 65 <= b <= 90, lambda b: 48 <= b <= 57, lambda b: b >= 128, lambda b: 32 < b < 127 and not chr(b).isalnum(), lambda b: chr(b) in "aeiouyAEIOUY", lambda b: b in b"\x20\x09\x0a\x0b\x0c\x0d",
        *((lambda b, c=c: b == ord(c)) for c in "|!?%$&*#.,;:-_=+<>/\\@\"'()[]{}~^`"),
    ]
    shares = [sum(map(f, raw)) / max(1, n) for f in classes]
    length = [len(w) for w in words]
    mean = sum(length) / some
    lower = Counter(bytes(b + 32 if 65 <= b <= 90 else b for b in w) for w in words)
    return [
        *shares, np.log1p(n), np.log1p(len(words)), mean, max(0, sum(x * x for x in length) / some - mean * mean) ** 0.5, max(length, default=0), sum(x > 20 for x in length) / some,
        sum(65 <= w[0] <= 90 for w in words) / some, sum(w[-1] in b"!%$&*#|?" for w in words) / some, len(lower) / some, max(lower.values(), default=0) / some, n / rows, len(lines) / some, (len(lines) - len(set(lines))) / rows,
        -sum(c / n * np.log2(c / n) for c in Counter(raw).values()),
    ]


def test_statistics_of_texts():
    texts = [t or "" for t in data.odd_texts()] + ["A line\nA line\n\nB! c? $5\n", "the The THE a b"]
    for _, _, raw, offsets in bytetext.batches(pa.array(texts)):
        found = quality.statistics(raw, offsets)
        assert found.shape == (len(texts), len(quality.NAMES))
        for i, t in enumerate(texts):
            np.testing.assert_allclose(found[i], np.array(brute_statistics(t.encode()), dtype=np.float32), rtol=1e-4, atol=1e-5, err_msg=repr(t[:40]))


def test_quality_takes_one_row_a_document(spark):
    """Rows that repeat a labelled doc_id don't reach the driver, and the bound holds to the row."""
    import tidelog.llm.quality as module

    seen = []
    rows = [(i % 40, f"text {i} " + data.words(20, i), "en", "s", 0) for i in range(400)]
    docs, labels = data.table(spark, rows), spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    fit, module.fit = module.fit, lambda x, y, **k: seen.append(len(y))
    try:
        quality.train(docs, labels)
        quality.train(docs, labels, rows=7)
    finally:
        module.fit = fit
    assert seen[0] == sum(zlib.crc32(str(i).encode()) % 3 != 1 for i in range(40)) and seen[1] == 7


def test_trees_learn_and_flatten():
    r = np.random.default_rng(0)
    x = r.normal(size=(3000, 6)).astype(np.float32)
    y = ((x[:, 0] > 0.2) ^ (x[:, 3] < -0.5)).astype(float)
    model = quality.fit(x[:2000], y[:2000])
    assert ((model.score(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.97
    one = quality.fit(x[:50], np.ones(50))
    assert (one.score(x[:5]) > 0.9).all() and np.allclose(quality.fit(x[:0], y[:0]).score(x[:5]), 0.5)
    t = model.feature.shape[0] - 1
    for row in x[:50]:  # a walk through the last tree
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + int(row[model.feature[t][node]] > model.threshold[t][node])
        part = quality.Trees(0.0, model.feature[t:], model.threshold[t:], model.leaf[t:])
        assert part.score(row[None])[0] == pytest.approx(1 / (1 + np.exp(-model.leaf[t][node - model.feature.shape[1]])))


def test_quality_held_out_accuracy(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, labels)).join(labels, "doc_id").filter(quality.held_out(F.col("doc_id")))
    right, n = scored.agg(F.sum((F.col("predicted") == F.col("quality")).cast("int")), F.count("*")).first()
    assert n > 100 and right / n > 0.95


def test_quality_ignores_held_out_labels(spark):
    from pyspark.sql import functions as F

    sf = "/root/testdata/sf0.001"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    a, b = (quality.train(docs, x) for x in (labels, turned))
    assert a.base == b.base and (a.leaf == b.leaf).all() and (a.threshold == b.threshold).all()


def test_pipeline_equals_brute_force(spark):
    """All five stages one after another, each by plain Python on what the one before kept."""
    from tokenizers import Tokenizer

    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs, labels, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "labels", "benchmark"))
    rows = sorted(rows_of(docs), key=lambda r: r["doc_id"])
    model = quality.train(docs, labels)
    good = []
    for a, b, raw, offsets in bytetext.batches(pa.array([r["text"] or "" for r in rows])):
        good += [r for r, p in zip(rows[a:b], model.score(quality.statistics(raw, offsets)), strict=True) if p >= 0.5]
    component = {i: c for i, _, c in brute_components(good)}
    unique = [r for r in good if component[r["doc_id"]] == r["doc_id"]]
    hit = {k[0] for k in brute_contamination(unique, [(r["item_id"], r["text"]) for r in rows_of(items)]) if k[-1]}
    clean = [r for r in unique if r["doc_id"] not in hit]
    taken, target = brute_mix(clean)
    mixed = []
    for r, n in zip(clean, taken, strict=True):
        words = WORD.findall(r["text"] or "")
        if not words:
            mixed += [(r["doc_id"], r["text"])] * (target[r["source"]] > 0)
            continue
        mixed += [(r["doc_id"], r["text"])] * (n // len(words))
        if n % len(words):
            mixed.append((r["doc_id"], " ".join(words[: n % len(words)])))
    tokenizer = Tokenizer.from_str(tokens.default_config())
    want = Counter()
    for i, t in mixed:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1]
        want[(i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))] += 1
    got = sorted((r["start"], r["n_tokens"], r["doc_id"], r["ids_crc32"]) for r in rows_of(corpus_pipeline.run(spark, sf)))
    assert len(rows) > len(good) > len(unique) > len(clean) > 0
    assert Counter((i, n, crc) for _, n, i, crc in got) == want
    assert [g[0] for g in got] == np.cumsum([0, *(g[1] for g in got[:-1])]).tolist() and [g[2] for g in got] == sorted(g[2] for g in got)
