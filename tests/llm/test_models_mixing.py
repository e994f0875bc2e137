import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from crestline.llm import gru_lm, language_id, mixing
from crestline.llm._common import stage

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, epoch string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, 7, "a", "b") for i, t, lang, s in rows], DOCS)


# -- language ID

SYLLABLES = {"aa": "ka lo mi tu re", "bb": "sch ung ein ber keit", "cc": "que oux lle eau tion"}


def invented(rng, lang, words):
    parts = SYLLABLES[lang].split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randrange(1, 4))) for _ in range(words))


def test_languages_of_held_out_texts(spark):
    rng = random.Random(1)
    rows = [(i, invented(rng, lang := rng.choice("aa bb cc".split()), rng.randrange(3, 60)), lang, "s") for i in range(600)]
    rows += [(1000, None, "aa", "s"), (1001, "", None, "s"), (1002, "123 !? 45", "bb", "s"), (None, rows[0][1], "aa", None), (5, rows[5][1], rows[5][2], "s"), (1003, "ka lo mi " * 40000, "aa", "s")]
    got = language_id.predict_languages(docs(spark, rows)).collect()
    assert len(got) == len(rows)
    assert all(r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and by[1003]["lang_pred"] == "aa"
    told = [(by[i]["lang_pred"], lang) for i, _, lang, _ in rows[:600] if by[i]["held_out"]]
    assert len(told) > 100 and sum(a == b for a, b in told) / len(told) > 0.97
    assert all(0 <= r["score"] <= 1 for r in got)
    kept = language_id.drop_unidentified(docs(spark, rows))
    assert kept.columns == docs(spark, []).columns
    assert not {1000, 1001, 1002} & {r["doc_id"] for r in kept.collect()} and kept.count() >= 0.97 * 600


def test_predictions_use_the_text_alone(spark):
    rng = random.Random(2)
    rows = [(i, invented(rng, lang := rng.choice(["aa", "bb"]), 20), lang, "s") for i in range(200)]
    held = [i for i, *_ in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    lied = [(i, t, "cc" if i in held else lang, "other") for i, t, lang, _ in rows]
    a, b = ({r["doc_id"]: (r["lang_pred"], r["score"]) for r in language_id.predict_languages(docs(spark, x)).collect()} for x in (rows, lied))
    assert a == b


def test_without_languages_all_are_unknown(spark):
    got = language_id.predict_languages(docs(spark, [(1, "some text", None, "s"), (2, None, None, None)])).collect()
    assert {r["lang_pred"] for r in got} == {"und"}
    assert language_id.predict_languages(docs(spark, [])).count() == 0
    kept = language_id.drop_unidentified(docs(spark, [(1, "some text", None, "s"), (2, None, None, None), (3, "12 !", None, "s")]))
    assert [r["doc_id"] for r in kept.collect()] == [1]


@pytest.mark.parametrize("doc_id", [None, 4])
def test_null_and_repeated_ids_are_learned_from(spark, monkeypatch, doc_id):
    """All rows share one id, and a hash sample of a few rows a language still holds every language."""
    monkeypatch.setattr(language_id.train, "__defaults__", ("lang-1", 40))
    rng = random.Random(14)
    rows = [(doc_id, invented(rng, lang := rng.choice(["aa", "bb", "cc"]), rng.randrange(8, 60)), lang, "s") for _ in range(400)]
    rows += [(doc_id, "zz zyzz zzy " * 9, "zz", "s")] * 300
    d = docs(spark, rows)
    told = d.select("lang", language_id._predictor(d, language_id.train(d)).alias("t")).select("lang", "t.lang_pred").collect()
    assert {r["lang_pred"] for r in told} == {"aa", "bb", "cc", "zz"}
    assert sum(r["lang"] == r["lang_pred"] for r in told) > 0.97 * len(told)


def test_many_languages_are_all_learned(spark):
    rows = [(3 * i, f"{chr(0x4E00 + i)}{chr(0x4E00 + i)} " * 5, f"l{i}", "s") for i in range(300) for _ in range(2)]
    model = language_id.train(docs(spark, rows))
    assert len(model.languages) == 300
    assert sum(model.predict(t)[0] == lang for _, t, lang, _ in rows) > 0.95 * len(rows)


def plain_ftrl(rows, labels, classes):
    """Coordinate by coordinate, as published: alpha, beta, L1 and L2 per coordinate and class."""
    z, n = ([[0.0] * classes for _ in range(language_id.DIMS + 1)] for _ in range(2))
    e = language_id

    def weight(i, k):
        if abs(z[i][k]) <= e.L1:
            return 0.0
        return -(z[i][k] - math.copysign(e.L1, z[i][k])) / ((e.BETA + math.sqrt(n[i][k])) / e.ALPHA + e.L2)

    for _ in range(e.EPOCHS):
        for (at, x), label in zip(rows, labels, strict=True):
            w = {(i, k): weight(i, k) for i in at for k in range(classes)}
            scores = [sum(v * w[i, k] for i, v in zip(at, x, strict=True)) for k in range(classes)]
            total = sum(math.exp(s) for s in scores)
            for i, v in zip(at, x, strict=True):
                for k in range(classes):
                    g = v * (math.exp(scores[k]) / total - (k == label))
                    sigma = (math.sqrt(n[i][k] + g * g) - math.sqrt(n[i][k])) / e.ALPHA
                    z[i][k] += g - sigma * w[i, k]
                    n[i][k] += g * g
    return {(i, k): weight(i, k) for at, _ in rows for i in at for k in range(classes)}


def test_follow_the_leader_and_features_against_plain_forms():
    texts = ["ka lo mi", "schung ein", "que oux lle", "mi tu re ka", "keit ber", "eau tion que"]
    rng = np.random.default_rng(15)
    idf = rng.uniform(1, 4, language_id.DIMS)
    rows = [language_id.tf_idf(t, idf) for t in texts]
    for t, (at, x) in zip(texts, rows, strict=True):  # TF-IDF by definition
        grams = Counter()
        for size in (1, 2, 3):
            for i in range(len(t) - size + 1):
                h = 0
                for c in t[i : i + size]:
                    h = (h * 0x100000001B3 + ord(c)) & (1 << 64) - 1
                grams[(h * int(language_id._MIX[size - 1]) & (1 << 64) - 1) >> 49] += 1
        raw = {b: (1 + math.log(c)) * idf[b] for b, c in grams.items()}
        norm = math.sqrt(sum(v * v for v in raw.values()))
        assert dict(zip(at.tolist(), x.tolist(), strict=True)) == pytest.approx({b: v / norm for b, v in raw.items()} | {language_id.DIMS: 1.0})
    labels = [0, 1, 2, 0, 1, 2]
    got = language_id.fit_ftrl(rows, labels, 3)
    for (i, k), w in plain_ftrl([(at.tolist(), x.tolist()) for at, x in rows], labels, 3).items():
        assert got[i, k] == pytest.approx(w, abs=1e-9)


def test_the_temperature_is_the_best_of_a_grid():
    rng = np.random.default_rng(17)
    logits = rng.standard_normal((400, 4)) * 5
    labels = np.array([rng.choice(4, p=language_id.softmax(z / 2.5)) for z in logits])
    loss = lambda t: -sum(math.log(language_id.softmax(z / t)[y]) for z, y in zip(logits, labels, strict=True))
    found = language_id.fit_temperature(logits, labels)
    assert loss(found) <= min(loss(t) for t in np.exp(np.linspace(-3, 3, 121))) + 1e-6


def test_follow_the_leader_separates_and_prunes():
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for _ in range(300):
        label = int(rng.integers(2))
        at = np.array([label, 2 + int(rng.integers(50)), language_id.DIMS])
        rows.append((at, np.array([0.7, 0.7, 1.0])))
        labels.append(label)
    w = language_id.fit_ftrl(rows, labels, 2)
    assert all((x @ w[at]).argmax() == y for (at, x), y in zip(rows, labels, strict=True))
    assert (w[100:200] == 0).all()


# -- language model


def lm_rows():
    rng = random.Random(4)
    rows = [(i, " ".join(rng.choice(["the", "cat", "sat", f"w{rng.randrange(400)}", "é"]) for _ in range(rng.randrange(0, 80))), "x", "s") for i in range(150)]
    return rows + [(900, None, None, None), (901, "", "x", "s"), (902, " \n\t", "x", "s"), (903, "The CAT never-seen", "x", "s"), (903, "The CAT never-seen", "x", "s"), (None, "no id", "x", "s"), (904, "the cat " * 20000, "x", "s")]


@pytest.mark.parametrize("hot", [gru_lm.HOT, 6])
def test_scores_against_plain_counts(spark, monkeypatch, hot):
    """The base score by definition, with the counts broadcast or joined."""
    monkeypatch.setattr(gru_lm.frequent, "__defaults__", (hot,))
    rows = lm_rows()
    words = lambda t: [w.decode() for w in (t or "").encode().lower().split()] + [""]
    out = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c = Counter(w for i, t, *_ in rows if not out(i) for w in words(t))
    n, v = sum(c.values()), len(c)
    got = gru_lm.score_documents(docs(spark, rows)).collect()
    key = lambda x: tuple(-1 if y is None else y for y in x)
    want = sorted(((i, out(i), len(words(t)), sum(c[w] > 0 for w in words(t)), n) for i, t, *_ in rows), key=key)
    assert sorted(((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got), key=key) == want
    base = {i: sum(math.log10((c[w] + 1) / (n + v + 1)) for w in words(t)) for i, t, *_ in rows}
    assert all(math.isclose(r["base_score"], base[r["doc_id"]], rel_tol=1e-9) for r in got)
    assert all(r["score"] < 0 for r in got)
    twice = [r["score"] for r in got if r["doc_id"] == 903]
    assert twice[0] == pytest.approx(twice[1])
    assert gru_lm.score_documents(docs(spark, [])).count() == 0


def test_the_network_learns_order(spark):
    """On text with an order the network beats word counts by far, held-out documents included."""
    cycle = [f"w{i}" for i in range(12)]
    rng = random.Random(5)
    rows = [(i, " ".join(cycle[(k + at) % 12] for k in range(120)), "x", "s") for i in range(250) for at in [rng.randrange(12)]]
    got = gru_lm.score_documents(docs(spark, rows)).collect()
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] for r in held) > 0.75 * sum(r["base_score"] for r in held)


def plain_log_probability(p, line):
    """Natural log probability of one document under the network, word by word, by definition."""
    n, h, before, total = gru_lm.HIDDEN, np.zeros(gru_lm.HIDDEN), gru_lm._START, 0.0
    p = {k: v.astype(float) for k, v in p.items()}
    for token in line.tolist():
        x, u = p["x"][before], h @ p["u"]
        z, r = (1 / (1 + np.exp(-(x[i * n : (i + 1) * n] + u[i * n : (i + 1) * n]))) for i in (0, 1))
        cand = np.tanh(x[2 * n :] + r * u[2 * n :])
        h = z * h + (1 - z) * cand
        kind = token // gru_lm._EACH if token < gru_lm.HEAD else token - gru_lm.HEAD + gru_lm.HEAD_CLASSES
        logits = h @ p["c"][:-1] + p["c"][-1]
        total += logits[kind] - np.log(np.exp(logits).sum())
        if token < gru_lm.HEAD:
            logits = h @ p["w"][kind, :-1] + p["w"][kind, -1]
            total += logits[token % gru_lm._EACH] - np.log(np.exp(logits).sum())
        before = token
    return total


def test_scores_against_a_plain_forward_pass():
    rng = np.random.default_rng(16)
    model = gru_lm.GRU.fresh(rng.integers(1, 90, gru_lm.HEAD).astype(float), np.ones(gru_lm.TAIL_CLASSES))
    lines = [np.append(rng.integers(1, gru_lm._START, size=n), 0) for n in (0, 5, 40, 90)]
    assert np.allclose(gru_lm.network_scores(_lm(model.pack()), lines), [plain_log_probability(model.params, x) for x in lines], rtol=1e-4)


def test_gradients_by_differences():
    """The way back against central differences of a plain forward pass, weights of every kind."""
    rng = np.random.default_rng(6)
    model = gru_lm.GRU.fresh(np.ones(20) * 5, np.ones(gru_lm.TAIL_CLASSES))
    lines = np.stack([rng.integers(1, 20, size=12) for _ in range(3)])
    lines[:, 3] = gru_lm.HEAD + 5
    lines[1, 5] = 0  # a document ends within the window: what follows starts afresh
    got, h = gru_lm.window_gradients(model, np.zeros((3, gru_lm.HIDDEN), dtype=np.float32), np.full(3, gru_lm._START), np.ascontiguousarray(lines.T))
    assert h.shape == (3, gru_lm.HIDDEN)
    lines = [lines[0], lines[1][:6], lines[1][6:], lines[2]]
    loss = lambda p: -sum(plain_log_probability(p, x) for x in lines)
    for k, grad in got.items():
        places = [np.unravel_index(i, grad.shape) for i in np.argsort(-np.abs(grad).ravel())[rng.integers(0, 60, 6)]]
        for at in places:
            sides = []
            for e in (1e-4, -1e-4):
                moved = {n: v.astype(float) for n, v in model.params.items()}
                moved[k][at] += e
                sides.append(loss(moved))
            assert grad[at] == pytest.approx((sides[0] - sides[1]) / 2e-4, rel=2e-2, abs=2e-3)


def test_training_lowers_the_loss_and_reads_all_parts():
    rng = np.random.default_rng(6)
    model = gru_lm.GRU.fresh(np.ones(20) * 5, np.ones(gru_lm.TAIL_CLASSES))
    line = [np.append(rng.integers(1, 20, size=400), 0) for _ in range(8)]
    before = gru_lm.network_scores(_lm(model.pack()), line).sum()
    flat, tokens = gru_lm.train_shard(model.pack(), iter(line))
    assert tokens == 8 * 401
    assert gru_lm.network_scores(_lm(flat), line).sum() > before
    assert gru_lm.train_shard(model.pack(), iter([]))[1] == 0


@pytest.mark.parametrize("sizes", [[1], [7], [9, 1, 1], [100, 3], [5000, 77, 1, 12]])
def test_every_token_is_a_target_once(monkeypatch, sizes):
    """Ends of lines that fill no row of streams count like all tokens, each once."""
    monkeypatch.setattr(gru_lm, "TOKENS", 4000)
    rng, seen, real = np.random.default_rng(2), Counter(), gru_lm.window_gradients

    def told(model, h, before, target):
        seen.update(target[target >= 0].tolist())
        return real(model, h, before, target)

    monkeypatch.setattr(gru_lm, "window_gradients", told)
    lines = [np.append(rng.integers(1, gru_lm._START, size=n), 0) for n in sizes]
    model = gru_lm.GRU.fresh(np.ones(20) * 5, np.ones(gru_lm.TAIL_CLASSES))
    assert gru_lm.train_shard(model.pack(), iter(lines))[1] == sum(n + 1 for n in sizes)
    assert seen == Counter(np.concatenate(lines).tolist())


def test_places_beyond_the_end_have_no_gradient():
    rng = np.random.default_rng(8)
    model = gru_lm.GRU.fresh(np.ones(20) * 5, np.ones(gru_lm.TAIL_CLASSES))
    grid = rng.integers(1, 20, size=(10, 3))
    start = lambda n: (np.zeros((n, gru_lm.HIDDEN), dtype=np.float32), np.full(n, gru_lm._START))
    ended = grid.copy()
    ended[6:, 1] = -1
    got, _ = gru_lm.window_gradients(model, *start(3), ended)
    parts = [gru_lm.window_gradients(model, *start(1), np.ascontiguousarray(grid[:n, i : i + 1]))[0] for i, n in enumerate((10, 6, 10))]
    for k in got:
        assert np.allclose(got[k], sum(p[k] for p in parts), rtol=1e-3, atol=1e-5)


@pytest.mark.parametrize("doc_id", [None, 5])
def test_rows_that_share_an_id_are_learned_from(spark, doc_id):
    """The network trains whatever the ids are: order is learned from rows without one, and from rows of one id."""
    cycle = [f"w{i}" for i in range(12)]
    rng = random.Random(5)
    rows = [(doc_id, " ".join(cycle[(k + at) % 12] for k in range(120)), "x", "s") for at in (rng.randrange(12) for _ in range(250))]
    got = gru_lm.score_documents(docs(spark, rows)).collect()
    assert sum(r["score"] for r in got) > 0.75 * sum(r["base_score"] for r in got)


def _lm(flat):
    e = np.zeros(0)
    return gru_lm.LanguageModel({}, e, e, 0, 0, 0, e, e, flat)


def test_windows_carry_the_state():
    """Scores do not depend on how documents are batched or where windows end."""
    rng = np.random.default_rng(7)
    model = _lm(gru_lm.GRU.fresh(np.ones(50), np.ones(gru_lm.TAIL_CLASSES)).pack())
    texts = [rng.integers(0, 50, size=n) for n in (1, 23, 24, 25, 100, 7)]
    together = gru_lm.network_scores(model, texts)
    assert np.allclose(together, [gru_lm.network_scores(model, [t])[0] for t in texts], atol=1e-3)
    assert np.allclose(together, gru_lm.network_scores(model, texts, most=2), atol=1e-3)


def test_few_long_documents_ask_the_output_layer_seldom(monkeypatch):
    """States wait for the output layer over windows, as a window of the longest documents alone has few of them."""
    rng, asked, real = np.random.default_rng(9), [], gru_lm.GRU.log_probs
    monkeypatch.setattr(gru_lm.GRU, "log_probs", lambda self, h, token: asked.append(len(token)) or real(self, h, token))
    model = _lm(gru_lm.GRU.fresh(np.ones(50), np.ones(gru_lm.TAIL_CLASSES)).pack())
    texts = [rng.integers(0, gru_lm._START, size=n) for n in (3000, 40, 1, 700)]
    gru_lm.network_scores(model, texts)
    assert sum(asked) == sum(map(len, texts)) and len(asked) == 1


def test_words_are_told_as_by_definition():
    """Whole arrays of texts are split and looked up at once, word for word as one by one."""
    texts = [None, "", " ", "Ab\x1ccD\x85e\tF\x0b\x0cg\r\nÄÖ İ\u2003K\xa0", " the THE [@`z{ \0 x ", "é", "ab a", None, "the  \ud7ff \U0001f600b"]
    plain = [(t or "").encode().lower().split() for t in texts]
    tail = lambda w: (w[-1] * 31 + (w[-2] if len(w) > 1 else 0) * 17) % gru_lm.TAIL_CLASSES
    want = [w for x in plain for w in x]
    for array in (pa.array(texts, pa.string()), pa.array(texts, pa.large_string()), pa.array(["cut off", *texts], pa.string())[1:]):
        words, sizes = gru_lm.words_of(array)
        assert [w.encode() for w in words.to_pylist()] == want
        assert sizes.tolist() == [len(x) for x in plain]
        assert gru_lm.tail_classes(words).tolist() == [tail(w) for w in want]
        assert gru_lm.tail_classes(words[5:]).tolist() == [tail(w) for w in want[5:]]
        model = _lm(None)
        model.hot, model.hot_token = pa.array(["the", "é"]), np.array([1, gru_lm.HEAD + 2, 0], dtype=np.int16)
        sizes, at, token, rare = model.read(array)
        assert at.tolist() == [{b"the": 0, "é".encode(): 1}.get(w, -1) for w in want]
        assert token.tolist() == [{b"the": 1, "é".encode(): gru_lm.HEAD + 2}.get(w, gru_lm.HEAD + tail(w)) for w in want]
        assert [w.encode() for w in rare.to_pylist()] == [w for w, k in zip(want, at, strict=True) if k < 0]
        lines = model.lines(sizes, token)
        assert [len(x) for x in lines] == [len(x) + 1 for x in plain] and all(x[-1] == 0 for x in lines)
        assert [k for x in lines for k in x[:-1]] == token.tolist()
    assert gru_lm.tail_classes(gru_lm.words_of(pa.array([None, " "], pa.string()))[0]).tolist() == []


@pytest.mark.parametrize("most", [1, 5, 12, 1 << 20])
def test_pieces_hold_every_row_once(monkeypatch, most):
    monkeypatch.setattr(gru_lm, "BYTES", most)
    texts = ["aaaa", None, "", "b" * 30, "éé", "c", None]
    batch = pa.RecordBatch.from_pydict({"text": pa.array(["cut off", *texts], pa.string()), "at": pa.array(range(-1, 7))})[1:]
    got = [piece.to_pylist() for piece in gru_lm.pieces(batch)]
    assert [r for piece in got for r in piece] == batch.to_pylist()
    assert all(len(piece) == 1 or sum(len((r["text"] or "").encode()) for r in piece) <= most for piece in got)
    assert list(gru_lm.pieces(batch[:0])) == []


# -- mixing


def mix_rows():
    rng = random.Random(8)
    sizes = {"hot": 400, "mid": 150, "tiny": 20, None: 30}
    rows = [(s, n) for s, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    return [(i, " ".join("w" for _ in range(rng.randrange(1, 60))), "x", s) for i, (s, _) in enumerate([(s, 0) for s, _ in rows])]


def test_weights_meet_the_limits_and_nothing_is_dropped(spark):
    rows = mix_rows()
    tokens = Counter()
    for _, t, _, s in rows:
        tokens[s] += len(t.split())
    got = mixing.mix_schedule(docs(spark, rows)).collect()
    assert Counter(r["doc_id"] for r in got).keys() == {i for i, *_ in rows}
    alpha, total = got[0]["alpha"], sum(tokens.values())
    power = {s: (n / total) ** alpha for s, n in tokens.items()}
    z = sum(power.values())
    weight = {s: p / z for s, p in power.items()}
    assert all(r["weight"] == pytest.approx(weight[r["source"]], abs=1e-8) for r in got)
    share = {s: n / total for s, n in tokens.items()}
    entropy = lambda q: -sum(x * math.log(x) for x in q.values())
    assert entropy(weight) <= entropy(share) + 0.5 * (math.log(4) - entropy(share)) + 1e-5
    epochs = {s: weight[s] / share[s] for s in share}
    assert max(epochs.values()) / min(epochs.values()) <= 2 + 1e-5
    read = Counter()
    for r in got:
        read[r["source"]] += r["tokens"]
    whole = sum(read.values())
    assert all(abs(read[s] / whole - weight[s]) < 0.02 for s in read)
    for s in tokens:  # every epoch before the last is a whole permutation
        last = max(r["epoch"] for r in got if r["source"] == s)
        for e in range(last):
            assert sorted(r["doc_id"] for r in got if r["source"] == s and r["epoch"] == e) == sorted(i for i, _, _, x in rows if x == s)


def test_blocks_hold_the_weights_and_slots_have_no_gaps(spark):
    got = mixing.mix_schedule(docs(spark, mix_rows()), block_tokens=3000).collect()
    blocks = {r["block"] for r in got}
    assert len(blocks) > 3 and blocks == set(range(len(blocks)))
    weight = {r["source"]: r["weight"] for r in got}
    for b in blocks:
        own = [r for r in got if r["block"] == b]
        assert sorted(r["slot"] for r in own) == list(range(len(own)))
        total = sum(r["tokens"] for r in own)
        for s in ("hot", "mid"):
            assert abs(sum(r["tokens"] for r in own if r["source"] == s) / total - weight[s]) < 0.06


def test_documents_are_repeated_as_the_schedule_says(spark):
    rows = mix_rows() + [(3, "twin", "x", "hot"), (3, "twin", "x", "hot"), (None, None, None, "mid")]
    d = stage(docs(spark, rows))
    want = Counter(r["doc_id"] for r in mixing.mix_schedule(d).collect())
    out = mixing.mix_documents(d)
    assert out.columns == d.columns
    got = Counter(r["doc_id"] for r in out.collect())
    assert got.keys() == want.keys()
    assert sum(abs(got[i] - want[i]) for i in got) <= 4  # rows that tie at a source's edge
    assert mixing.mix_documents(docs(spark, [])).count() == 0 and mixing.mix_schedule(docs(spark, [])).count() == 0
