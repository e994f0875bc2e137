import random

import pytest

from crestline.llm import shingle_dedup, simhash


def plain_set(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_components(rows):
    sets, root = [(i, plain_set(t)) for i, t in rows], {i: i for i, _ in rows}
    pairs = []
    for k, (a, x) in enumerate(sets):
        for b, y in sets[:k]:
            if x == y or len(x & y) / len(x | y) >= 0.8:
                pairs.append((a, b))
    for _ in rows:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    return root, pairs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    texts = [None, "", " \n", "one two", "One  two", "one two three four five", "ONE two three four five"]
    for _ in range(25):
        text = [word() for _ in range(rng.randrange(60, 300))]
        texts.append(" ".join(text))
        for _ in range(4):
            copy = list(text)
            for at in rng.sample(range(len(copy)), max(1, len(copy) // rng.choice((30, 50, 60, 100)))):
                copy[at] = word()
            texts.append(" ".join(copy))
    hot = [word() for _ in range(200)]
    for _ in range(60):
        copy = list(hot)
        copy[rng.randrange(200)] = word()
        texts.append(" ".join(copy))
    return list(enumerate(texts))


@pytest.mark.parametrize(("pivots", "chunk"), [(shingle_dedup.PIVOTS, shingle_dedup.CHUNK), ((), 512), ((), 7), ((1,), 7)])
def test_stage_against_all_pairs(spark, rows, pivots, chunk):
    want, pairs = plain_components(rows)
    docs = spark.createDataFrame([(i, t, "s") for i, t in rows], "doc_id long, text string, source string")
    kept = shingle_dedup.drop_similar(docs, pivots, chunk)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted({*want.values()})
    # The rule of op7 reaches few of these pairs.
    fps = {i: simhash.fingerprint(t) for i, t in rows}
    assert sum((fps[a] ^ fps[b]).bit_count() > simhash.RADIUS for a, b in pairs) > 100


def test_pipeline_takes_five_words_and_verifies(spark, rows):
    import corpus_pipeline

    want, _ = plain_components(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, "")
    assert {r.doc_id for r in got.collect()} == {*want.values()}
    assert shingle_dedup.drop_similar(docs.limit(0)).count() == 0


def test_similarity_is_exact():
    base = " ".join(f"v{i}" for i in range(94))  # 90 shingles
    for cut, near in ((18, True), (19, False)):  # 72 and 71 of 90 shared
        other = " ".join(f"v{i}" for i in range(94 - cut))
        assert shingle_dedup.similar(shingle_dedup.shingles(base), shingle_dedup.shingles(other)) is near
