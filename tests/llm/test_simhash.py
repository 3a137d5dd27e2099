import random
import time

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from keyloom.llm import simhash


def brute_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", words) if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(rows, radius):
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, (_, a) in enumerate(rows):
        for j, (_, b) in enumerate(rows[:i]):
            if (a ^ b).bit_count() <= radius:
                root[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return [least.get(find(i)) for i in range(len(rows))]


@pytest.mark.parametrize("radius", [0, 2, 3])
def test_forest_equals_brute_force(radius):
    rng = random.Random(radius)
    points = set()
    for _ in range(40):
        center = rng.getrandbits(64)
        for _ in range(rng.choice([1, 3, 60])):
            x = center
            for _ in range(rng.randrange(6)):
                x ^= 1 << rng.randrange(64)
            points.add(x)
    points |= {rng.getrandbits(64) for _ in range(2000)}
    x = np.array(sorted(points), np.uint64)
    tree = simhash.build(x, 64, radius)
    links, homes = [], 0
    for _, home, guests in simhash.dealt(tree, x, radius, np.arange(len(x)), np.zeros(0, int)):
        rows = np.concatenate([home, guests])
        homes += len(home)
        root = simhash.forest(x[rows], np.arange(len(home)), np.arange(len(home), len(rows)), radius)
        links += [(rows[i], rows[r]) for i, r in enumerate(root) if i != r]
    assert homes == len(x) and len(links) < 10 * len(x)
    label = np.arange(len(x))
    for _ in range(50):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    want = brute_groups(list(enumerate(x.tolist())), radius)
    assert label.tolist() == want


def test_groups_over_odd_rows(spark):
    base = "one two three four five six seven eight nine ten eleven twelve"
    texts = [None, "", " \n", "Word", "word", "two words", base, base.upper(), base + " end", base, "ÀB c\x1cd   e f g", "z" * 200_000, "many words " * 30_000]
    rows = [(None if i == 4 else 6 if i == 9 else i, t, "x") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(3)
    got = simhash.near_groups(docs, 2, 3).collect()
    fps = [(d, brute_fingerprint(t, 3)) for d, t, _ in rows]
    want = sorted((d is None, d or 0, f, c) for (d, f), c in zip(fps, brute_groups(fps, 2), strict=True))
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fp % (1 << 64), r.component_id) for r in got) == want
    kept = simhash.keep_one(docs, 2, 0.8, 3)
    assert kept.columns == docs.columns
    groups = brute_groups(fps, 2)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == sorted({g for g in groups if g is not None} - {8})  # 8 is similar to 6


def test_keep_one_catches_similar_texts(spark):
    rng = random.Random(3)
    words = [f"v{i}" for i in range(5000)]
    rows, n = [], 0
    for group in range(30):
        base = rng.choices(words, k=400)
        for copy in range(3):
            own = list(base)
            for _ in range(copy * 6):
                own[rng.randrange(400)] = rng.choice(words)
            rows.append((n, " ".join(own), group))
            n += 1
    docs = spark.createDataFrame(rows, "doc_id long, text string, g int")
    sets = {d: {tuple(t.split()[i : i + 5]) for i in range(396)} for d, t, _ in rows}
    alike = [len(sets[3 * g] & sets[3 * g + k]) / len(sets[3 * g] | sets[3 * g + k]) for g in range(30) for k in (1, 2)]
    want = {3 * g for g in range(30)} | {3 * g + k for g in range(30) for k in (1, 2) if len(sets[3 * g] & sets[3 * g + k]) / len(sets[3 * g] | sets[3 * g + k]) < 0.8}
    got = {r.doc_id for r in simhash.keep_one(docs).collect()}
    assert min(alike) < 0.8 < max(alike)
    assert {3 * g for g in range(30)} <= got <= want
    assert sum(d not in got for d in want) <= 3  # a chain may link a copy further off


def test_recall_of_the_stage_on_a_whole_table(spark):
    """Of all pairs of similarity 0.8 no more than one in a hundred stays; what has no such partner and no close fingerprint stays."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    sets = {d: set(simhash.shingle_hashes(t, 5).tolist()) for d, t in texts.items()}
    prints = {d: simhash.fingerprint(simhash.shingle_hashes(t, 5)) for d, t in texts.items()}
    holders, shared = {}, {}
    for d, own in sets.items():
        for h in own:
            holders.setdefault(h, []).append(d)
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[:i]:
                shared[b, a] = shared.get((b, a), 0) + 1
    alike = {p for p, n in shared.items() if n >= 0.8 * (len(sets[p[0]]) + len(sets[p[1]]) - n)}
    ids = sorted(prints)
    close = {d for i, d in enumerate(ids) for e in ids[:i] if (prints[d] ^ prints[e]).bit_count() <= 3}
    got = {r.doc_id for r in simhash.keep_one(docs).collect()}
    lost = [p for p in alike if p[0] in got and p[1] in got]
    assert len(alike) > 50 and len(lost) <= 0.01 * len(alike)
    assert set(ids) - {d for p in alike for d in p} - close <= got


def test_groups_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_groups(docs).count() == 0 and simhash.keep_one(docs).count() == 0


def test_chain_of_links_is_one_group(spark):
    from keyloom.llm.components import components

    n = 200
    links = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(1000, 1001)], "a long, b long")
    got = {r.node: r.root for r in components(links).collect()}
    assert got == {**dict.fromkeys(range(1, n + 1), 0), 1001: 1000}


def test_query_equals_brute_force(spark):
    from keyloom.llm import queries

    sf = "/root/testdata/sf0.001"
    rows = [(r.doc_id, brute_fingerprint(r.text, 3)) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = queries.op3_simhash_groups(spark, sf).orderBy("doc_id").collect()
    assert [(r.doc_id, r.fingerprint, r.component_id) for r in got] == [(d, f"{f:016x}", c) for (d, f), c in zip(rows, brute_groups(rows, 2), strict=True)]


def test_links_of_a_boilerplate_family_equal_brute_force(spark, monkeypatch):
    rng = random.Random(8)
    shared, n = [f"b{i}" for i in range(350)], 240
    rows = []
    for i in range(n):  # two of the family have similarity 0.76; a pair shares 0.81
        own = [f"o{i}x{k}" for k in range(50)]
        if i % 2:
            own = rows[-1][1].split()[350 : 350 + 11] + own[11:]
        rows.append((i, " ".join(shared + own)))
    rng.shuffle(rows)
    sets = {d: {tuple(t.split()[k : k + 5]) for k in range(396)} for d, t in rows}
    alike = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert alike == {(i, i + 1) for i in range(0, n, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for block in (1_024, 50):
        monkeypatch.setattr(simhash, "BLOCK", block, raising=False)
        assert sorted(r.doc_id for r in simhash.keep_one(docs, radius=0).collect()) == list(range(0, n, 2))


@pytest.mark.parametrize("split", [16_384, 300, 60])
def test_shards_dealt_into_blocks_lose_no_link(spark, split):
    """A ball of fingerprints that no tree can split, and strangers: the components are those of all pairs."""
    rng = random.Random(11)
    centre = rng.getrandbits(64)
    points = {centre ^ (1 << i) ^ (1 << j) ^ (1 << k) for i, j, k in (rng.sample(range(64), 3) for _ in range(700))}
    points |= {rng.getrandbits(64) for _ in range(300)}
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(points)]
    rows = spark.createDataFrame([(p,) for p in signed], "fp long").repartition(3)
    links = [(r.a, r.b) for r in simhash.linked(rows, 2, split).collect()]
    prints = [(p, p % (1 << 64)) for p in signed]
    label = {p: p for p in signed}
    for _ in range(len(signed)):
        before = dict(label)
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
        if label == before:
            break
    assert [label[p] for p in signed] == brute_groups(prints, 2)


def test_tasks_of_a_split_shard_are_bounded(spark):
    rows = spark.range(5_000).selectExpr("0L AS shard", "xxhash64(id) AS fp", "id % 3 > 0 AS home")
    sizes = simhash.paired(rows, 500).groupBy("shard", "low", "high").count().collect()
    assert len(sizes) == 45 and max(r["count"] for r in sizes) < 1_300


def test_batches_of_long_texts_end_by_bytes(spark):
    from pyspark.sql import functions as F

    from keyloom.llm.shared import in_batches

    def run(found):
        for batch in found:
            yield pa.RecordBatch.from_pydict({"rows": [batch.num_rows]})

    texts = spark.range(0, 400, 1, 1).select(F.repeat(F.lit("x"), 100_000).alias("text"))
    got = [r.rows for r in in_batches(texts, run, "rows long").collect()]
    assert sum(got) == 400 and max(got) < 100


def test_rows_of_the_search_grow_with_the_points(spark, monkeypatch):
    """Uniform fingerprints with planted pairs: each is dealt a fixed number of times, and no link is lost between shards."""
    monkeypatch.setattr(simhash, "SHARD", 50)
    seen, paired = [], simhash.paired

    def counted(rows, split):
        found = paired(rows, split)
        seen.append(found.count())
        return found

    monkeypatch.setattr(simhash, "paired", counted)
    rng = random.Random(5)
    for n in (400, 2_000):
        points = [rng.getrandbits(64) for _ in range(n - n // 10)]
        pairs = [(p, p ^ sum(1 << b for b in rng.sample(range(64), 3))) for p in points[: n // 10]]
        signed = [(p - (1 << 64) if p >> 63 else p,) for p in points + [q for _, q in pairs]]
        links = simhash.linked(spark.createDataFrame(signed, "fp long").repartition(3), 3, 400).collect()
        assert {frozenset((r.a % (1 << 64), r.b % (1 << 64))) for r in links} == {frozenset(p) for p in pairs}
    assert seen == [4 * 400, 4 * 2_000]


def shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    return {x for x in manager.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}


def test_steps_that_are_kept_leave_no_shuffle_files(spark):
    """Rounds of joins need the disk of one round: what is checkpointed or written gives its shuffle files back."""
    from keyloom.llm.components import components
    from keyloom.llm.shared import cut, written

    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    rows = spark.range(2_000).selectExpr("id % 500 AS a", "id % 500 + 1 AS b").distinct()
    for step in (cut, lambda df: written(df, "rows"), components):
        before = shuffle_files(spark)
        assert step(rows).count() == 500
        for _ in range(50):
            left = shuffle_files(spark) - before
            if len(left) <= 5:  # those of the count itself
                break
            time.sleep(0.2)
        assert len(left) <= 5
    assert spark.conf.get(key, None) is None
    spark.conf.set(key, "false")
    cut(rows)
    assert spark.conf.get(key) == "false"
    spark.conf.unset(key)


def test_copies_of_a_text_meet_before_their_shingles(spark, monkeypatch):
    seen, in_batches = [], simhash.in_batches

    def counted(rows, run, schema):
        if "hashes" in schema:
            seen.append(rows.count())
        return in_batches(rows, run, schema)

    monkeypatch.setattr(simhash, "in_batches", counted)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)] * 300 + [" ".join(base[:-1] + ["end"])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert [r.doc_id for r in simhash.keep_one(docs, radius=0).collect()] == [0]
    assert seen == [2]
