import hashlib
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from crestline.llm.fill_in_middle import CODE_POINTS, DIGIT_GROUPS, WORDS, EventScan, Units, fill_in_middle, restored

DOCS = "doc_id long, text string, n string, form string, cut string, h1 string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "x", "x", "x", "x") for i, t in rows], DOCS)


def plainly(doc_id, text):
    """The contract, code point by code point."""
    text, d = text or "", hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    spm = h4 % 100 < 20
    return n, "spm" if spm else "psm", a, b - a, f"<S>{s}<P>{p}<M>{m}" if spm else f"<P>{p}<S>{s}<M>{m}"


def test_equals_the_plain_form_and_restores(spark):
    rng = random.Random(5)
    letters = "ab <>PSM/é漢😀\n\t\r\0'"
    rows = [(i, "".join(rng.choice(letters) for _ in range(rng.choice([1, 2, 3, 9, 200])))) for i in range(400)]
    rows += [(None, None), (None, "null id"), (7, ""), (7, "twice"), (7, "twice"), (9, "a<S>b"), (-3, "x" * 300_000 + "é" * 50_000)]
    out = fill_in_middle(docs(spark, rows).repartition(3))
    assert out.columns == ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
    got = out.withColumn("back", restored(F.col("output"), F.col("form"))).collect()
    want = sorted(((i, *plainly(i, t), t or "") for i, t in rows), key=repr)
    assert sorted((tuple(r) for r in got), key=repr) == want
    assert {r["form"] for r in got} == {"plain", "psm", "spm"}


@pytest.mark.parametrize(
    "units, pattern",
    [
        (CODE_POINTS, r"(?s)."),
        (WORDS, r"\n|[ \t]+|[^ \t\n]+"),
        (DIGIT_GROUPS, r"\n|[ \t]+|[0-9]{1,3}|[^ \t\n0-9]+"),
        (Units(2, {"#": 1, "-": 1, "=": 5}), r"(?s)[#-]|={1,5}|[^#=-]{1,2}"),
        (Units(1, {"0123456789": 3, "#": 1}), r"(?s)[0-9]{1,3}|[^0-9]"),
    ],
)
def test_ranks_of_units_against_listed_units(units, pattern):
    rng, scan = random.Random(1), EventScan(units)
    for _ in range(400):
        text = "".join(rng.choice("ab  \n\t123#-=é<P>") for _ in range(rng.randrange(40)))
        listed = [m.start() for m in re.finditer(pattern, text)] + [len(text)]
        marked, *gaps = scan.scan(text)
        assert gaps[1][-1] == len(listed) - 1 and marked == ("<P>" in text)
        assert [scan.place(r, *gaps) for r in range(len(listed))] == listed


def test_code_points_leave_one_gap_and_other_classes_must_be_ascii():
    assert len(EventScan().scan("many words 123\nand lines " * 50)[3]) == 1
    with pytest.raises(ValueError):
        EventScan(Units(0, {"é": 1}))


def test_whole_units_are_cut(spark):
    rows = [(i, "some words, and 12345678 digits\nover lines") for i in range(60)]
    for r in fill_in_middle(docs(spark, rows), WORDS, rate=100).collect():
        cuts = [m.start() for m in re.finditer(r"\n|[ \t]+|[^ \t\n]+", rows[0][1])] + [len(rows[0][1])]
        assert r["n"] == len(cuts) - 1 and r["prefix_chars"] in cuts and r["prefix_chars"] + r["middle_chars"] in cuts


def test_empty_table(spark):
    assert fill_in_middle(docs(spark, [])).collect() == []


def test_query_equals_its_sql(spark):
    from crestline.llm import queries

    sf = "/root/testdata/sf0.001"
    got = queries.op13_fill_in_middle(spark, sf)
    want = duckdb.sql(queries.oracle_sql()["op13_fill_in_middle"].replace("FROM documents", f"FROM '{sf}/documents.parquet'"))
    assert sorted(want.columns) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*want.columns).collect()), key=repr) == sorted(want.fetchall(), key=repr)
