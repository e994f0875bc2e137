import bisect
import random
import zlib

import numpy as np
import pytest

from crestline.llm.license_scan import PHRASES, TEMPLATES, LicenceAutomaton, scan_licences, words_of
from crestline.llm.packing import PackingPlan, best_fit_packing

DOCS = "doc_id long, text string, length string, piece string, labels string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "a", "b", "c") for i, t in rows], DOCS)


def brute_bases(text):
    words = words_of(text)
    found = []
    for phrase, label in PHRASES:
        p = words_of(phrase)
        found += [(i, label) for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
    return sorted(found)


def test_automaton_against_brute_force():
    automaton, rng = LicenceAutomaton(), random.Random(1)
    vocabulary = ["mit", "license", "apache", "general", "public", "the", "under", "licensed", "GNU", "x", "é"]
    for _ in range(300):
        text = " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(40)))
        assert sorted(automaton.matches(words_of(text))[0]) == brute_bases(text)
    # Matching statistics: the run at each end of a match is the longest substring of a template.
    texts = [words_of(t) for _, t in TEMPLATES]
    everywhere = {tuple(t[i:j]) for t in texts for i in range(len(t)) for j in range(i + 1, min(len(t), i + 30) + 1)}
    for _ in range(50):
        words = []
        for _ in range(6):
            t = rng.choice(texts)
            i = rng.randrange(len(t))
            words += t[i : i + rng.randrange(1, 9)]
        for a, b, _ in automaton.matches(words)[1]:
            assert tuple(words[a:b]) in everywhere
            assert b == len(words) or tuple(words[a : b + 1]) not in everywhere


def test_scan_cases(spark):
    mit = next(t for label, t in TEMPLATES if label == "mit" and t.startswith("Permission"))
    rows = [
        (1, "Released under the MIT License. Thanks."), (2, None), (3, ""), (4, "nothing here"), (5, "word " * 30000 + "Apache LICENSE"),
        (6, mit), (7, mit[: len(mit) * 3 // 4].replace("copy", "c0py", 1)), (None, "mit-license, mit license"), (9, "the general public licenses"),
        (9, "the general public licenses"), (10, "Licensed under CC BY-NC 4.0"),
    ]
    out = {(r["doc_id"], r["n_words"]): r for r in scan_licences(docs(spark, rows)).collect()}
    by = {k[0]: r for k, r in out.items()}
    assert by[1]["base_labels"] == "mit" and by[1]["score"] == 1.0 and by[1]["first_word"] == 3
    for i in (2, 3, 4):
        assert (by[i]["n_base"], by[i]["labels"], by[i]["score"], by[i]["first_word"]) == (0, "", 0.0, None)
    assert by[5]["n_words"] == 30002 and by[5]["last_word"] == 30000 and by[5]["base_labels"] == "apache"
    assert by[6]["labels"] == "mit" and by[6]["base_labels"] == "" and by[6]["score"] == 1.0
    assert by[7]["labels"] == "mit" and 0.6 <= by[7]["score"] < 1
    assert by[None]["n_base"] == 2
    assert by[9]["labels"] == ""
    assert by[10]["labels"] == "cc-by-nc"
    assert scan_licences(docs(spark, [])).count() == 0


def plain_spans(text):
    """Labels by definition: chains of the longest common runs of a text with a template, in order, close together."""
    words, labels = words_of(text), set()
    for label, template in TEMPLATES:
        t, i, found = words_of(template), 0, []
        while i < len(words):
            best = max((next((k for k in range(min(len(words) - i, len(t) - j)) if words[i + k] != t[j + k]), min(len(words) - i, len(t) - j)), -j) for j in range(len(t)))
            if best[0] >= 4:
                found.append((i, -best[1], best[0]))
            i += max(1, best[0])
        covered, end, place = 0, None, 0
        for at, j, n in found:
            if end is None or at - end > 12 or j + n <= place:
                covered, place = 0, 0
            covered, end, place = covered + min(n, j + n - max(place, j)), at + n, j + n
            if covered >= 0.6 * len(t):
                labels.add(label)
    return labels


def test_whole_notices_and_their_shares_against_a_plain_scan():
    automaton, rng = LicenceAutomaton(), random.Random(5)
    for label, template in TEMPLATES:
        words = template.split()
        assert label in automaton.scan("intro " + template + " outro")["labels"].split(",")
        if len(words) < 30:
            continue
        kept = words[: len(words) * 7 // 10]
        kept[len(kept) // 2] = "zzz"
        assert label in automaton.scan(" ".join(kept))["labels"].split(",")
        few = words[: max(4, len(words) * 3 // 10)]
        assert plain_spans(" ".join(few)) >= {x for x in automaton.scan(" ".join(few))["labels"].split(",") if x} - {x for _, x in PHRASES}
        noise = " ".join(rng.choice(["alpha", "beta", "the", "of", "software"]) for _ in range(80))
        assert automaton.scan(noise)["labels"] == ""


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_everything_near_the_bound(seed):
    rng = random.Random(seed)
    lengths = [rng.choice([1, 3, 60, 700, 1024, 1025, 2048, rng.randrange(1, 2049), rng.randrange(200, 1400)]) for _ in range(5000)]
    histogram = {}
    for n in lengths:
        histogram[n] = histogram.get(n, 0) + 1
    plan = PackingPlan(histogram)
    used, count = {}, {}
    for n, lo, hi, first, each, offset in plan.intervals:
        count[n] = count.get(n, 0) + hi - lo
        for k in range(hi - lo):
            used.setdefault(first + k // each, []).append((offset + k % each * n, n))
    assert count == histogram and len(used) == plan.sequences
    for places in used.values():
        places.sort()
        assert [a for a, _ in places] == [sum(n for _, n in places[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    rooms, plain = [], 0
    for n in sorted(lengths, reverse=True):  # best fit, one by one
        i = bisect.bisect_left(rooms, n)
        plain += i == len(rooms)
        bisect.insort(rooms, (2048 if i == len(rooms) else rooms.pop(i)) - n)
    assert plan.sequences <= plain * 1.01 + 2


def test_packing_against_the_tokenizer(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = [(1, "hello world " * 1500), (2, None), (3, ""), (4, "Été  \n\n très $$$ 12345"), (4, "same"), (4, "same"), (None, "null id"), (6, "<|endoftext|> spelled <|endoftext|>"), (7, "a" * 20000), (8, "　日本 " * 400)]
    out = best_fit_packing(docs(spark, rows), path).collect()
    want = []
    for i, text in rows:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], dtype="<u4")
        first = len(ids) % 2048 or 2048
        edges = [0, *range(first, len(ids) + 1, 2048)]
        want += [(i, n, a, b - a, zlib.crc32(ids[a:b].tobytes())) for n, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]
    key = lambda r: tuple(-1 if x is None else x for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in out), key=key) == sorted(want, key=key)
    sequences = {}
    for r in out:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        places.sort()
        assert places[0][0] == 0 and all(a[0] + a[1] == b[0] for a, b in zip(places, places[1:], strict=False)) and sum(n for _, n in places) <= 2048
    assert best_fit_packing(docs(spark, []), path).count() == 0
