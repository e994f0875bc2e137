"""The corpus pipeline as a whole, and tables of one id, of null ids and of very long texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from crestline.llm import language_id, mixing, simhash
from crestline.llm.packing import best_fit_packing
from crestline.llm.queries import tokenizer_path
from crestline.llm.sharding import interleaved_shards

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, component_id string, _h string, tokens string"
SYLLABLES = {"aa": "ka lo mi tu re".split(), "bb": "sch ung ein ber keit".split()}


def table(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 1, "x", "y", "z") for i, t, lang, s in rows], SCHEMA)


def text(rng, lang, words=60):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 5))) for _ in range(words))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(31)
    rows = [(i, text(rng, lang := rng.choice(["aa", "bb"])), lang, rng.choice(["web", "web", "web", "books", None])) for i in range(240)]
    rows += [(1000 + i, rows[i][1], rows[i][2], "web") for i in range(30)]  # exact copies
    rows += [(2000 + i, rows[40 + i][1] + " tail", rows[40 + i][2], "web") for i in range(30)]  # near copies
    return rows + [(3000, None, None, "web"), (3001, "12 34 !", "aa", "web"), (3002, "", None, None), (3003, "ka lo mi tu re " * 9000, "aa", "books")]


def test_pipeline_keeps_clean_documents_and_packs_what_is_left(spark, corpus, tmp_path):
    table(spark, corpus).write.parquet(f"{tmp_path}/documents.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "mix_sources", "pack_sequences"]
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    ids = {i for i, *_ in corpus}
    assert set(kept["language_id"]) == ids - {3000, 3001, 3002}
    assert set(kept["near_dedup"]) == {i for i in ids if i < 1000 or i == 3003} and set(kept["near_dedup"].values()) == {1}
    assert set(kept["mix_sources"]) == set(kept["near_dedup"]) and max(kept["mix_sources"].values()) > 1
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter(r["doc_id"] for r in packed if r["piece"] == 0) == kept["mix_sources"]
    used = Counter()
    for r in packed:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and len(used) <= sum(used.values()) / 2048 * 1.1 + 2


def test_pipeline_over_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_without_an_id_of_their_own(spark, corpus, doc_id):
    docs = table(spark, [(doc_id, t, lang, s) for _, t, lang, s in corpus[:200]])
    shards = Counter(r["shard"] for r in interleaved_shards(docs).collect())
    assert sum(shards.values()) == 200 and max(shards.values()) - min(shards.values()) <= 1
    plan = mixing.mix_schedule(docs).collect()
    assert Counter(r["epoch"] for r in plan)[0] == 200
    read = Counter(r["source"] for r in mixing.mix_documents(docs).collect())
    assert read == Counter(r["source"] for r in plan)  # texts tell the rows apart, so quotas are met exactly
    packed = best_fit_packing(docs, tokenizer_path()).collect()
    assert len(packed) >= 200
    offsets = {}
    for r in packed:
        offsets.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in offsets.values():
        places.sort()
        assert [p for p, _ in places] == [sum(n for _, n in places[:k]) for k in range(len(places))]
    got = simhash.simhash_components(docs)
    assert got.count() == 200 and {r["component_id"] for r in got.collect()} == {doc_id}


def test_very_long_texts(spark):
    rng = random.Random(32)
    long = text(rng, "aa", 150_000)
    rows = [(1, long, "aa", "s"), (2, long + " x", "aa", "s"), (3, "a" * 500_000, "aa", "s"), (5, text(rng, "bb"), "bb", "t"), (6, text(rng, "aa"), "aa", "t")]
    docs = table(spark, rows)
    out = {r["doc_id"]: r for r in interleaved_shards(docs, shards=2).collect()}
    assert out[3]["size"] == 500_001 and out[1]["size"] == len(long) + 1
    tokens = {r["doc_id"]: r["tokens"] for r in mixing.mix_schedule(docs).collect()}
    assert tokens[1] == 150_000 and tokens[3] == 1
    told = {r["doc_id"]: r["lang_pred"] for r in language_id.predict_languages(docs).collect()}
    assert set(told) == {1, 2, 3, 5, 6} and "und" not in told.values()
    found = {r["doc_id"]: r["component_id"] for r in simhash.simhash_components(docs).collect()}
    assert found[1] == found[2] == 1 and found[3] == 3
    kept = {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()}
    assert kept == {1, 3, 5, 6}
    # A piece of 2,048 tokens is a sequence of its own; pieces that are shorter share sequences.
    packed = best_fit_packing(docs, tokenizer_path())
    assert packed.filter("length = 2048").count() == packed.filter("sequence_id < 0").count() > 100
    assert packed.filter("sequence_id < 0").agg(F.count_distinct("sequence_id")).first()[0] == packed.filter("sequence_id < 0").count()


def test_stages_keep_columns_called_like_helpers(spark, corpus):
    """Any column of the input comes out with its values, also those called like a stage's own helpers."""
    odd = ["_h", "__h", "__n", "_n", "_stratum", "__stratum", "_last", "__last", "_epoch", "__epoch", "_times", "__times", "_turn", "rows", "_rows", "_FACT", "_fact", "_told", "__crestline_told", "tokens", "epoch", "quota", "sid", "keys", "fp"]
    names = [c for i, c in enumerate(odd) if c.lower() not in {x.lower() for x in odd[:i]}]
    base = spark.createDataFrame([(i, t, lang, s, 1) for i, t, lang, s in corpus], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.withColumns({c: F.concat(F.lit(c), F.col("doc_id").cast("string")) for c in names})
    for name, apply in corpus_pipeline.STAGES[:3]:
        out = apply(spark, docs, "")
        assert out.columns == docs.columns, name
        rows = out.select("doc_id", *names).collect()
        assert rows and all(r[c] == f"{c}{r['doc_id']}" for r in rows for c in names), name
