import random

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from crestline.llm import simhash
from crestline.llm._components import components, runs
from crestline.llm.edit_fingerprints import edit_fingerprints, near_components
from crestline.llm.embedding_dedup import near_duplicate_vectors


def closure(nodes, links):
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


@pytest.mark.parametrize("tail", [None, 0, 40])
def test_components_of_chains_stars_and_nothing(spark, tail):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(rng.randrange(2000, 2300), rng.randrange(2000, 2300)) for _ in range(200)] + [(5, 5), (1, 0)]
    rng.shuffle(links)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(links, "a long, b long"), tail).collect()}
    want = closure({x for ab in links for x in ab}, links)
    groups, seen = {}, {}
    for n, root in got.items():
        groups.setdefault(root, set()).add(n)
    for n, root in want.items():
        seen.setdefault(root, set()).add(n)
    assert sorted(map(sorted, groups.values())) == sorted(sorted(g) for g in seen.values() if len(g) > 1)
    assert components(spark.createDataFrame([], "a string, b string"), tail).count() == 0


def test_components_of_a_long_chain_and_a_large_star(spark):
    chain = spark.range(100_000).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    star = spark.range(1, 1_000_000).select((F.col("id") + 1_000_000).alias("a"), F.lit(1_000_000).cast("long").alias("b"))
    got = components(chain.unionByName(star).repartition(7), tail=1000)
    assert sorted(r["count"] for r in got.groupBy("root").count().collect()) == [100_001, 1_000_000]


def test_runs_over_batches():
    keys = [1, 1, 1, 2, 3, 3, 3, 3, 4]
    for step in (1, 2, 3, 9):
        batches = [pd.DataFrame({"k": keys[i : i + step], "v": range(i, min(i + step, 9))}) for i in range(0, 9, step)]
        out = [frame["v"].tolist()[a:b] for frame, edges in runs(iter(batches), ["k"]) for a, b in zip(edges, edges[1:], strict=False)]
        assert out == [[0, 1, 2], [3], [4, 5, 6, 7], [8]]


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [b" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_against_the_definition():
    rng = random.Random(4)
    for text in [None, "", " \t\n", "one", "One two three", "a b c d", "É à b c d e", *(" ".join(rng.choice("abcdefg") for _ in range(rng.randrange(60))) for _ in range(40))]:
        assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_masks_cover_every_pair_within_the_radius():
    rng, masks = random.Random(5), simhash.masks()
    assert len(masks) == 31
    for _ in range(3000):
        diff = sum(1 << b for b in rng.sample(range(64), rng.randrange(5)))
        assert any(diff & m & (1 << 64) - 1 == 0 for m in masks)


@pytest.mark.parametrize("chunk", [8192, 16])
def test_covering_links_lose_no_pair(spark, chunk):
    rng = random.Random(6)
    fps = {0}
    for _ in range(40):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(rng.randrange(30)):
            base ^= sum(1 << b for b in rng.sample(range(64), rng.randrange(1, 5)))
            fps.add(base)
    signed = {f: f - (1 << 64) if f >> 63 else f for f in fps}
    want = closure(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    links = simhash.covering_links(spark.createDataFrame([(s,) for s in signed.values()], "fp long"), chunk=chunk).collect()
    unsigned = lambda x: x & (1 << 64) - 1
    assert all((unsigned(r["a"]) ^ unsigned(r["b"])).bit_count() <= 64 for r in links)
    assert closure(fps, [(unsigned(r["a"]), unsigned(r["b"])) for r in links]) == want


DOCS = "doc_id long, text string, fp long, component_id long, lang string"


def test_simhash_components_and_dropping(spark):
    rng = random.Random(7)
    base = [" ".join(f"w{rng.randrange(5000)}" for _ in range(300)) for _ in range(4)]
    rows = [(10 + i, t) for i, t in enumerate(base)] + [(3, base[0] + " tail"), (90, base[0]), (91, base[0].upper()), (50, None), (51, ""), (52, " \n"), (None, base[1]), (60, "x"), (60, "x"), (70, base[2]), (70, "unlike all " + base[3][:200])]
    docs = spark.createDataFrame([(i, t, 1, 2, "en") for i, t in rows], DOCS)
    got = simhash.simhash_components(docs).collect()
    assert len(got) == len(rows)
    fps = [(i, simhash.fingerprint(t)) for i, t in rows]
    nodes = {f for _, f in fps}
    root = closure(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    least = {}
    for i, f in fps:
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    assert sorted(((r["doc_id"], r["fp"] & (1 << 64) - 1, r["component_id"]) for r in got), key=key) == sorted(((i, f, least.get(root[f])) for i, f in fps), key=key)
    kept = simhash.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    ids = sorted((r["doc_id"] or -1 for r in kept.collect()))
    assert ids == sorted([-1, 3, 11, 12, 13, 50, 60, 70])
    assert simhash.simhash_components(docs.limit(0)).count() == 0 and simhash.drop_near_duplicates(docs.limit(0)).count() == 0


VECTORS = "vec_id long, embedding array<float>, label int, node string, n int"


def test_vectors_against_brute_force(spark):
    rng = np.random.default_rng(8)
    rows = []
    for c in range(30):
        centre = rng.standard_normal(64)
        rows += [centre + rng.standard_normal(64) * rng.choice([0.05, 0.15, 0.3]) for _ in range(int(rng.integers(1, 40)))]
    rows += [rows[0]] * 5 + [rows[3] * 2.0]
    sound = np.array(rows, dtype=np.float32)
    odd = [None, [], [0.0] * 64, [float("nan")] * 64, [None] + [1.0] * 63, [float("inf")] + [1.0] * 63, [1.0, 2.0], [2.0, 4.0]]
    data = [(i, v.tolist()) for i, v in enumerate(sound)] + [(5000 + i, v) for i, v in enumerate(odd)]
    df = spark.createDataFrame([(i, v, 1, "x", 2) for i, v in data], VECTORS)
    got = {r["vec_id"]: r for r in near_duplicate_vectors(df).collect()}
    assert len(got) == len(data)
    x = sound.astype(float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = x @ x.T >= 0.95
    root = closure(range(len(x)), [(i, j) for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True)])
    assert all(got[i]["n_links"] == near[i].sum() - 1 for i in range(len(x)))
    assert all(got[i]["component_id"] == root[i] and got[i]["kept"] == (root[i] == i) for i in range(len(x)))
    for i in range(6):
        assert (got[5000 + i]["n_links"], got[5000 + i]["component_id"], got[5000 + i]["kept"]) == (0, 5000 + i, True)
    assert got[5006]["component_id"] == got[5007]["component_id"] == 5006 and got[5007]["n_links"] == 1
    assert near_duplicate_vectors(df.limit(0)).count() == 0


def brute_force_links(x, threshold=0.95):
    found = []
    for at in range(0, len(x), 2000):
        i, j = np.nonzero(x[at : at + 2000] @ x.T >= threshold)
        found += [(a + at, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a + at < b]
    return found


@pytest.mark.parametrize("kind", ["even", "mean 0.85", "mean 0.9", "third in a cone"])
def test_recall_on_large_tables_of_any_shape(spark, kind):
    """Of 20,000 vectors and 1,000 planted pairs of 0.951 to 0.96, 0.99 of all true links are found, whatever the common mean."""
    rng = np.random.default_rng(21)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    x, top = unit(rng.standard_normal((20_000, 64))), unit(rng.standard_normal(64))
    mean = {"even": 0.0, "mean 0.85": 0.85, "mean 0.9": 0.9, "third in a cone": np.where(np.arange(20_000) % 3 == 0, 0.9, 0.0)[:, None]}[kind]
    x = np.sqrt(mean) * top + np.sqrt(1 - mean) * unit(x - (x @ top)[:, None] * top)
    c = rng.uniform(0.951, 0.96, size=(1000, 1))
    e = rng.standard_normal((1000, 64))
    e = unit(e - (e * x[:1000]).sum(1, keepdims=True) * x[:1000])
    x = np.concatenate([x, c * x[:1000] + np.sqrt(1 - c * c) * e]).astype(np.float32)
    got = near_duplicate_vectors(spark.createDataFrame(pd.DataFrame({"vec_id": range(len(x)), "embedding": x.tolist()}), "vec_id long, embedding array<float>"))
    links = brute_force_links(unit(x.astype(float)))
    found = got.agg(F.sum("n_links")).first()[0] / 2
    assert 0.99 * len(links) <= found <= len(links)


def test_large_groups_are_counted_tile_by_tile(spark, monkeypatch):
    import crestline.llm.embedding_dedup as e

    rng = np.random.default_rng(9)
    x = (rng.standard_normal(16) + rng.standard_normal((700, 16)) * 0.02).astype(np.float32)
    nodes = spark.createDataFrame([(str(i), v.tolist(), 1, "r", 700) for i, v in enumerate(x)], "node string, embedding array<float>, n long, root string, size long")
    got = {r["node"]: r["linked"] for r in e.count_links(nodes, tile=100).collect()}
    u = x.astype(float) / np.linalg.norm(x.astype(float), axis=1)[:, None]
    assert got == {str(i): int(n) for i, n in enumerate((u @ u.T >= 0.95).sum(1) - 1)}


def test_edit_fingerprints(spark):
    import hashlib

    import crestline.llm.edit_fingerprints as e

    rng = random.Random(10)
    texts = ["".join(rng.choice("abcdefgh é日") for _ in range(rng.randrange(200, 3000))) for _ in range(30)]
    rows = list(enumerate(texts)) + [(100, None), (101, ""), (102, "z"), (102, "z"), (103, texts[0]), (104, "long " * 40000)]
    docs = spark.createDataFrame([(i, t, 5, 6, "en") for i, t in rows], DOCS)
    got = edit_fingerprints(docs).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    ordered = sorted((i, t or "") for i, t in rows)
    for (i, t), (_, nxt) in zip(ordered, ordered[1:] + ordered[:1], strict=True):
        h = len(t) // 2
        edited = t[: len(t) - h] + nxt[:h]
        assert hashlib.sha256(edited.encode()).hexdigest() in [r["edited_sha256"] for r in by[i]]
        assert e._pack(e.fingerprints([edited])[0][:, 0])[0].hex() in [r["edited_fingerprint"] for r in by[i]]
        assert all(r["n_chars"] == len(t) for r in by[i])
    assert by[0][0]["fingerprint"] == by[103][0]["fingerprint"] != by[1][0]["fingerprint"]
    assert {r["fingerprint"] for i in (100, 101) for r in by[i]} == {"0" * 256}
    assert all(0.3 < by[i][0]["near_edited"] < 0.9 and by[i][0]["near_next"] < 0.3 for i in range(29))
    assert by[0][0]["component_id"] == by[103][0]["component_id"] == 0 and by[1][0]["component_id"] == 1
    alone = edit_fingerprints(docs.filter("doc_id = 3")).collect()[0]
    assert alone["near_next"] == 1.0
    assert edit_fingerprints(docs.limit(0)).count() == 0


@pytest.mark.parametrize("one_id", [False, True])
def test_edit_fingerprints_do_not_depend_on_ranges(spark, monkeypatch, one_id):
    """Whatever the ranges: null ids, ids of over 53 bits, and a single id that fills all ranges."""
    import crestline.llm.edit_fingerprints as e

    ids = lambda i: 7 if one_id else (1 << 60) + i * 999_999 if i % 17 else None
    docs = spark.createDataFrame([(ids(i), f"text {i} " * (i % 9), 1, 2, "x") for i in range(120)], DOCS)
    cols = ["doc_id", "edited_sha256", "edited_fingerprint", "near_edited", "near_next", "component_id"]
    whole = sorted(map(str, e.edit_fingerprints(docs).select(*cols).collect()))
    monkeypatch.setattr(e, "RANGE_BYTES", (200, 1 << 20))
    _, _, times, nulls = e._ranges(e._text(docs))
    assert times.sum() + nulls > 10
    assert sorted(map(str, e.edit_fingerprints(docs.repartition(6)).select(*cols).collect())) == whole


@pytest.mark.parametrize("which", [0, 2])
def test_the_walk_against_a_plain_one(which):
    import crestline.llm.edit_fingerprints as e

    rng = random.Random(12)
    for size in (0, 1, 7, 300):
        text = "".join(rng.choice("abcé 日x") for _ in range(size))
        codes, moves, j, steps, line = e._codes(text), e._BITS[which], 0, [], []
        for c in codes.tolist():  # the definition: write the character at every step until its bit says to go on
            steps.append(j)
            while True:
                line.append(c)
                j += 1
                if moves[(c * e._KINDS[which] & 0xFFFFFFFF) >> 28, (j - 1) % e.PERIOD]:
                    break
        (place, got, ends), _ = e.walk([codes, e._codes("other")], np.zeros(2, dtype=np.int64), e.WALKS) if size > 5 else [next(e.walk([codes], np.zeros(1, dtype=np.int64), e.WALKS)), None]
        assert place == 0 and got[which].tolist() == steps and ends[which] == j
        nibbles = e.sampled(codes, got[which], e.sampled_steps(ends)[which])
        assert len(line) or not nibbles.any()
        for k in range(e.SAMPLES if line else 0):
            last = max(r for r in e._RECORDS[k].tolist() if r <= j)
            mixed = ((line[last - 1] + 1) * int(e._SALT[k]) * 0x9E3779B97F4A7C15 & (1 << 64) - 1) >> 60
            assert nibbles[k] == mixed


def edited_copies(rng, words, at_once, count):
    """Texts of words and copies of them with some words replaced."""
    base = [[f"w{rng.randrange(9000)}" for _ in range(words)] for _ in range(count)]
    copies = []
    for text in base:
        copy = list(text)
        for at in rng.sample(range(words), at_once):
            copy[at] = f"x{rng.randrange(9000)}"
        copies.append(copy)
    return [" ".join(t) for t in base], [" ".join(t) for t in copies]


@pytest.mark.parametrize(("at_once", "least"), [(1, 0.97), (3, 0.92), (6, 0.85)])
@pytest.mark.parametrize("chunk", [8192, 4])
def test_recall_of_edited_copies(spark, at_once, least, chunk):
    """Copies of 300 words with 1, 3 and 6 words replaced are found; other texts are left alone."""
    base, copies = edited_copies(random.Random(13), 300, at_once, 150)
    docs = spark.createDataFrame([(i, t, 1, 2, "en") for i, t in enumerate(base + copies + base[:2])], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in near_components(docs, chunk=chunk).collect()}
    assert all(got[i] == i for i in range(150)) and [got[300], got[301]] == [0, 1]
    assert all(got[150 + i] in (i, 150 + i) for i in range(150))
    assert sum(got[150 + i] == i for i in range(150)) >= least * 150
