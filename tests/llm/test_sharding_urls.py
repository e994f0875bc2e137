from collections import Counter

import pytest
from pyspark.sql import functions as F

from crestline.llm.sharding import interleaved_shards
from crestline.llm.url_filters import default_log, filter_urls, validity_intervals

DOCS = "doc_id long, text string, source string, shard string, slot string, _h int"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", "y", 1) for i, t, s in rows], DOCS)


def test_shards_are_gapless_even_and_proportional(spark):
    rows = [(i, f"text {i}", "hot" if i % 3 else f"s{i % 5}") for i in range(1600)]
    out = interleaved_shards(docs(spark, rows)).collect()
    assert len(out) == 1600
    sizes = Counter(r["shard"] for r in out)
    assert set(sizes) == set(range(16)) and max(sizes.values()) - min(sizes.values()) <= 1
    for shard in range(16):
        assert sorted(r["slot"] for r in out if r["shard"] == shard) == list(range(sizes[shard]))
    per = Counter((r["shard"], r["source"]) for r in out)
    for source, n in Counter(s for _, _, s in rows).items():
        assert all(abs(per[shard, source] - n / 16) <= 2.5 for shard in range(16))


def test_shards_with_nulls_repeats_and_no_rows(spark):
    rows = [(1, None, None), (1, None, None), (None, "a", "s"), (None, "", None), (2, "é", "s")] + [(5, "t", "s")] * 40
    out = interleaved_shards(docs(spark, rows), shards=4).collect()
    assert len(out) == 45
    assert {(r["size"], r["text_crc32"]) for r in out if r["doc_id"] == 1} == {(1, 0)}
    assert next(r["size"] for r in out if r["doc_id"] == 2) == 3
    sizes = Counter(r["shard"] for r in out)
    assert sorted(sizes.values()) == [11, 11, 11, 12]
    assert interleaved_shards(docs(spark, [])).collect() == []


def test_shards_do_not_depend_on_partitions(spark):
    d = docs(spark, [(i, f"t{i}", f"s{i % 3}") for i in range(300)])
    a = {(r["doc_id"], r["shard"], r["slot"]) for r in interleaved_shards(d).collect()}
    b = {(r["doc_id"], r["shard"], r["slot"]) for r in interleaved_shards(d.repartition(7)).collect()}
    assert a == b


PAGES = "page_id long, url string, host string, rule string"


def pages(spark, urls):
    return spark.createDataFrame([(i, u, "h", "r") for i, u in enumerate(urls)], PAGES)


LOG = "list string, effect string, kind string, pattern string, action string, effective string"


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_url_verdicts_follow_the_active_entries(spark, broadcast_rows):
    log = spark.createDataFrame(
        [
            ("a", "block", "domain", "bad.org", "add", "2024-01-10"),
            ("a", "block", "domain", "bad.org", "add", "2024-01-12"),
            ("a", "block", "domain", "bad.org", "remove", "2024-02-01"),
            ("b", "allow", "prefix", "www.bad.org/ok", "add", "2024-01-01"),
            ("c", "block", "host", "exact.org", "add", "2024-01-01"),
            ("c", "block", "host", "exact.org", "remove", "2024-01-01"),
            (None, "block", "domain", None, "add", "2024-01-01"),
        ],
        LOG,
    )
    urls = ["http://www.bad.org/x?y", "https://www.bad.org/ok/1", "https://www.bad.org/okay", "http://notbad.org/", "http://u@BAD.org:80", "http://exact.org", None, "nonsense", ""]
    for day, blocked in (("2024-01-09", {0: False}), ("2024-01-10", {0: True, 1: False, 2: True, 3: False, 4: True, 5: False, 6: False, 7: False, 8: False}), ("2024-01-31", {0: True}), ("2024-02-01", {0: False, 4: False})):
        out = {r["page_id"]: r for r in filter_urls(pages(spark, urls * 2), log, F.lit(day), broadcast_rows).collect()}
        assert len(out) == 18
        for i, want in blocked.items():
            assert out[i]["blocked"] == want, (day, urls[i])
    never = filter_urls(pages(spark, urls), log, F.lit(None)).collect()
    assert not any(r["blocked"] or r["n_active"] for r in never)
    assert filter_urls(pages(spark, []), log, F.lit("2024-01-10")).count() == 0


def test_intervals_of_the_default_log(spark):
    spans = validity_intervals(default_log(spark)).collect()
    assert all(r["valid_to"] is None or r["valid_to"] > r["valid_from"] for r in spans)
    assert sum(r["pattern"] == "ads-track.example.org" for r in spans) == 2


@pytest.mark.parametrize("broadcast_rows", [100_000, 0])
def test_long_urls_and_lists_that_tie_on_a_pattern(spark, broadcast_rows):
    """A URL of many labels and path parts is matched at every depth; of two lists with one pattern a block goes before an allow."""
    deep = ".".join(f"h{i}" for i in range(60)) + ".tie.org"
    long = f"https://{deep}/" + "/".join(f"p{i}" for i in range(400)) + "?" + "q" * 20_000
    log = spark.createDataFrame(
        [
            ("b", "allow", "domain", "tie.org", "add", "2024-01-01"), ("a", "block", "domain", "tie.org", "add", "2024-01-01"),
            ("z", "block", "host", "www.same.org", "add", "2024-01-01"), ("y", "allow", "domain", "www.same.org", "add", "2024-01-01"),
            ("c", "allow", "prefix", f"{deep}/p0/p1", "add", "2024-01-01"),
        ],
        LOG,
    )
    got = filter_urls(pages(spark, [long, f"https://{deep}/q", "http://www.same.org/x"]), log, F.lit("2024-06-01"), broadcast_rows)
    out = {r["page_id"]: r for r in got.collect()}
    assert not out[0]["blocked"] and out[0]["n_active"] == 3 and out[0]["lists"] == "a,b,c" and out[0]["rule"].startswith("prefix ")
    assert out[1]["blocked"] and out[1]["lists"] == "a,b" and out[1]["rule"] == "domain tie.org"
    assert out[2]["blocked"] and out[2]["lists"] == "y,z" and out[2]["rule"] == "host www.same.org"
