import math
import re
import zlib

import numpy as np
import pyarrow as pa

from weftline.llm import toxicity
from weftline.llm.toxicity import DISCOUNT, LEAST_RATIO, STEMS, TELLING, THRESHOLD, UNSEEN, calibrate, code, count_models, distinct_marks, drop_toxic, likelihood_ratio, score_toxicity, words_of

SCHEMA = "doc_id long, text string, lang string, source string"


def corpus(n, rng, every=5):
    """Every fifth text is toxic: two in a hundred of its words are a toxic word or a toxic stem with any ending."""
    words, ends = [f"{a}{b}" for a in "ba de ki lo mu na".split() for b in "ra st ton vel wu xi".split()], "la me no pi ru sa to ve".split()
    rows, labels = [], []
    for i in range(n):
        text, toxic = rng.choice(words, int(rng.integers(40, 300))).tolist(), int(i % every == 0)
        for k in rng.choice(len(text), max(1, len(text) // 50), replace=False) if toxic else ():
            text[k] = "vile" if rng.random() < 0.5 else "grob" + "".join(rng.choice(ends, 2))
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 0, toxic))
    return rows, labels


def test_held_out_quality(spark):
    rows, labels = corpus(900, np.random.default_rng(0))
    rows += [(5000 + i, f"{rows[1][1]} w{i}", "en", "s") for i in range(60)]
    got = score_toxicity(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    truth = {i: t for i, _, t in labels}
    assert len(got) == len(rows)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and r.predicted == int(r.score >= THRESHOLD) and 0 <= r.score <= 1 for r in got)
    out = [r for r in got if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted for r in out if truth[r.doc_id]]) >= 0.95
    assert np.mean([r.predicted for r in out if not truth[r.doc_id]]) <= 0.02


def test_table_runs_whole_and_leaves_most_alone(spark, sf):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = score_toxicity(docs, labels).collect()
    assert len(got) == docs.count() and np.mean([r.predicted for r in got]) < 0.25


def test_odd_rows(spark):
    rows, labels = corpus(300, np.random.default_rng(1))
    rows += [(900, None, None, None), (901, "", None, None), (902, "12 !", None, None), (None, "vile vile vile", None, None), (903, "vile " * 100_000, None, None), (7, rows[7][1], "en", "s")]
    labels += [(900, 0, 1), (None, 0, 1), (1, 0, None), (2, 0, 7), (12345, 1, 1)]
    df, ls = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("source", "score"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = score_toxicity(df, ls)
    assert got.columns == ["doc_id", "held_out", "score", "predicted"]
    by = {r.doc_id: r for r in got.collect()}
    assert len({by[k].score for k in (900, 901, 902)}) == 1 and by[900].predicted == 0
    assert by[None].predicted == by[903].predicted == 1 and by[None].held_out is False
    left = drop_toxic(df, ls)
    assert left.columns == df.columns and {903, None} & {r.doc_id for r in left.collect()} == set() and 900 in {r.doc_id for r in left.collect()}
    assert score_toxicity(df.filter("false"), ls).count() == 0
    assert {(r.score, r.predicted) for r in score_toxicity(df, ls.filter("toxic = 0")).collect()} == {(0.0, 0)}


def as_texts(spark, rows, labels):
    return spark.createDataFrame([(t[-1], r[1]) for r, t in zip(rows, labels, strict=True)], "label long, text string")


def test_copies_of_a_text_add_no_counts(spark):
    rows, labels = corpus(300, np.random.default_rng(2), every=2)
    odd = "zug ".join(["", *"abcdefgh"])
    near = [(1000 + i, f"{odd} n{chr(97 + i)}", "en", "s") for i in range(20)]
    model = count_models(as_texts(spark, rows + near, labels + [(1000 + i, 0, 1) for i in range(20)]))
    assert code("vile") in model.words and code("grob") in model.stems
    assert model.ratio("vile") > 1.5 and model.ratio("grobnie") > 1.5 and abs(model.ratio("zug")) < 0.1 and model.ratio("neverseen") == 0


def plain_model(texts):
    """A second, slow statement of the models: {expression: (rest, toxic, ordinary, odds)} of words, stems and pairs."""
    of, seen, in_texts = [0, 0], {}, {}
    for n, (label, text) in enumerate(texts):
        words = re.findall(r"[^\W\d_]+", (text or "").lower())
        of[label] += 1
        for k, w in enumerate(words):
            v, u = words[k - 1] if k else "", words[k - 2] if k > 1 else ("" if k else None)
            for e, context in ((("word", w), v), *(((f"stem", w[:x]), w) for x in STEMS if len(w) > x), *([(("pair", v, w), u)] if k else [])):
                seen.setdefault(e, (set(), set()))[label].add(context)
                in_texts.setdefault(e, ({}, {}))[label].setdefault(context if e[0] == "stem" else 0, set()).add(n)
    out = {}
    for kind in ("word", "stem", "pair"):
        names = [e for e in seen if e[0] == kind]
        k = {e: [len(c) for c in seen[e]] for e in names}
        total, types = [max(1, sum(k[e][c] for e in names)) for c in (0, 1)], [sum(k[e][c] > 0 for e in names) for c in (0, 1)]
        for e in names:
            t = [min(of[c], sum(map(len, in_texts[e][c].values()))) for c in (0, 1)]

            def g(n, every):
                cells = [(n[c], sum(n) * every[c] / sum(every)) for c in (0, 1)] + [(every[c] - n[c], (sum(every) - sum(n)) * every[c] / sum(every)) for c in (0, 1)]
                return 2 * sum(a * math.log(a / b) for a, b in cells if a > 0)

            same = (k[e][1] * total[0] > k[e][0] * total[1]) == (t[1] * of[0] > t[0] * of[1])
            sure = min(g(k[e], total), g(t, of)) if same else 0.0
            weight = 1 / (1 + max(len(names) / TELLING, 1) * math.exp(-sure / 2))
            pooled = (sum(k[e]) + UNSEEN) / (sum(total) + UNSEEN * len(names))
            shared = (min(k[e]) + UNSEEN) / (sum(min(k[x]) for x in names) + UNSEEN * len(names))
            own = [weight * (max(k[e][c] - DISCOUNT, 0) + DISCOUNT * types[c] * shared) / total[c] / pooled for c in (0, 1)]
            odds = math.log((1 - weight + own[1]) / (1 - weight + own[0]))
            if abs(odds) >= LEAST_RATIO and sum(t) >= 4:
                out[e] = (1 - weight, own[1], own[0], odds)
    return out


def test_models_against_plain_kneser_ney(spark):
    rng = np.random.default_rng(5)
    rows, labels = corpus(160, rng, every=2)
    rows = [(i, t.replace("bara bast", "you rotten") if labels[i][2] else t.replace("bara bast", "you fine"), a, b) for i, t, a, b in rows]
    texts = [(y, t) for (_, t, *_), (*_, y) in zip(rows, labels, strict=True)]
    model, want = count_models(as_texts(spark, rows, labels).repartition(3)), plain_model(texts)
    words = {e[1]: x for e, x in want.items() if e[0] == "word"}
    assert {code(w) for w in words} == set(model.words) and len(words) > 2
    assert all(np.allclose(model.words[code(w)], x[:3]) for w, x in words.items())
    stems = {e[1]: x for e, x in want.items() if e[0] == "stem"}
    assert {code(w) for w in stems} == set(model.stems) and all(np.allclose(model.stems[code(w)], x[:3]) for w, x in stems.items())
    # The odds of a text by the plain tables, word after word, word, stem; pairs' contexts are estimated in the model.
    assert set(model.after) <= {code(e[1]) for e in seen_pairs(texts)}

    def odds(w):
        o = 1.0
        for rest, toxic, ordinary, _ in [stems[w[:n]] for n in STEMS if len(w) > n and w[:n] in stems] + [words[x] for x in [w] if x in words]:
            o = (rest * o + toxic) / (rest + ordinary)
        return math.log(o)

    for _, t in texts[:40]:
        ws, model_total = words_of(t), sum(map(model.ratio, words_of(t)))
        assert abs(model_total - sum(map(odds, ws))) < 1e-6


def seen_pairs(texts):
    return {("pair", a, b) for _, t in texts for a, b in zip(words_of(t), words_of(t)[1:])}


def test_a_telling_pair_of_ordinary_words(spark):
    """Words that both classes use alike, one after the other in toxic texts only."""
    rng = np.random.default_rng(8)
    filler = [f"{a}{b}{c}" for a in "bcdfg" for b in "aeiou" for c in "lmnrst"]
    rows, labels = [], []
    for i in range(400):
        text = rng.choice(filler, 80).tolist()
        at = rng.permutation(70)[:4]
        for k in at:
            text[k : k + 2] = ["get", "lost"] if i % 2 else [["get", "home"], ["keys", "lost"]][k % 2]
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 0, i % 2))
    model = count_models(as_texts(spark, rows, labels))
    assert code("lost") in model.after.get(code("get"), {})
    assert model.log_odds("x y get lost z".split()) > model.log_odds("x y get home keys lost z".split()) + 1


def test_pieces():
    n, of = np.array([[0.0, 10, 5], [10, 10, 6]]), np.array([100.0, 100])
    g = likelihood_ratio(n, of)
    assert g[0] > 13 and g[1] < 1e-9 and 0 < g[2] < 1
    x = np.concatenate([np.zeros(300), np.full(100, 0.5)])
    y = np.concatenate([np.zeros(290), np.ones(110)])
    slope, middle = calibrate(x, y)
    assert 1 / (1 + np.exp(slope * middle)) < 0.1 and 1 / (1 + np.exp(-slope * (0.5 - middle))) > 0.9
    assert np.allclose(distinct_marks(np.array([0, 1, -1])), [0, 64 * np.log(64 / 63), 64 * np.log(64)])


def test_nothing_to_learn_from(spark):
    assert count_models(spark.createDataFrame([(0, "a b"), (0, None)], "label long, text string")) is None
    assert count_models(spark.createDataFrame([(0, ""), (1, None)], "label long, text string")).words == {}


def test_clashing_columns_and_repeated_ids(spark):
    rows, labels = corpus(300, np.random.default_rng(4))
    df = spark.createDataFrame([(i, t, "x", 1) for i, t, *_ in rows] + [(5, rows[1][1], "y", 2), (5, rows[1][1], "y", 2)], "doc_id long, text string, _toxicity string, _ID long")
    ls = spark.createDataFrame(labels + [(5, 1, 1), (5, 0, 0)], "doc_id long, quality int, toxic int")
    left = drop_toxic(df, ls)
    assert left.columns == df.columns and {r._toxicity for r in left.collect()} == {"x", "y"}
    one, two = (sorted(tuple(r) for r in score_toxicity(d, ls).collect()) for d in (df, df.repartition(7)))
    assert one == two


def test_no_labelled_text_is_left_out(spark, monkeypatch):
    """Far more ordinary texts than toxic ones: every labelled text outside the fold is counted and places the curve."""
    from weftline.llm import toxicity

    rows, labels = corpus(400, np.random.default_rng(6), every=8)
    grams, seen, made, fit = [], [], toxicity._grams, toxicity.calibrate
    monkeypatch.setattr(toxicity, "_grams", lambda *a: grams.append(made(*a)) or grams[-1])
    monkeypatch.setattr(toxicity, "calibrate", lambda x, y, times: seen.append((y, times)) or fit(x, y, times))
    model = toxicity.learn(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    kept = [t for i, _, t in labels if zlib.crc32(str(i).encode()) % 4 != 2]
    texts = grams[0].filter(f"kind = {toxicity._OF_TEXTS}").groupBy().sum().first().asDict()
    assert [sum(texts[f"sum(t{c}{h})"] for h in (0, 1)) for c in (0, 1)] == [kept.count(0), kept.count(1)]
    assert [seen[0][1][seen[0][0] == c].sum() for c in (0, 1)] == [kept.count(0), kept.count(1)]
    assert model.ratio("vile") > 1


def test_expected_contexts_of_the_larger_class(spark):
    """Ten ordinary texts to two toxic ones: a context of t ordinary texts counts as 1 - 0.8 ** t, whole blocks and slots or not."""
    from weftline.llm import toxicity

    texts = [(1, "a x"), (1, "b x")] + [(0, "a x c")] * 3 + [(0, "b x")] + [(0, f"q{chr(97 + i)} y") for i in range(6)]
    df = spark.createDataFrame(texts, "label long, text string").withColumn("half", toxicity.F.lit(0)).repartition(3)
    rows = [tuple(sorted(tuple(r) for r in toxicity._grams(df, n).groupBy("kind", "w", "head").sum("t00", "t10").collect())) for n in (1, 100_000)]
    assert rows[0] == rows[1]
    held = []
    level = toxicity._level
    toxicity._level = lambda r, n, *a: held.append(r) or level(r, n, *a)
    try:
        toxicity._model(toxicity._grams(df, 1), (0,))
    finally:
        toxicity._level = level
    (x,) = held[0].filter(toxicity.F.col("w") == code("x")).collect()
    assert (x.t0, x.t1, x.k1 / toxicity._PART) == (4, 2, 2) and abs(x.k0 / toxicity._PART - (1 - 0.8**3 + 0.2)) < 1e-7


def test_counts_travel_small_and_dealt_evenly():
    rng = np.random.default_rng(3)
    v, w = rng.integers(0, 300, 20_000), np.sort(rng.integers(-(1 << 62), 1 << 62, 400)[rng.integers(0, 400, 20_000)])
    cell, t = rng.integers(0, 4, 20_000).astype("u1"), np.where(rng.random(20_000) < 0.01, rng.integers(250, 100_000, 20_000), 1)
    mask = np.where(rng.random(20_000) < 0.05, rng.integers(1, 1 << 62, 20_000), np.int64(1) << rng.integers(0, 63, 20_000))
    pairs = pa.Table.from_batches(toxicity._packed(toxicity._OF_PAIR, 8, v, w, cell, t, mask, {}))
    assert sum(len(x.as_py()) for c in pairs.columns[2:] for x in c) < 10 * len(v)  # 23 when each number came whole
    got = zip(*(x.tolist() for x in toxicity._unpacked(pairs)), strict=True)
    assert sorted(got) == sorted(zip(*(x.tolist() for x in (v, w, cell, t, mask)), strict=True))

    long = rng.integers(-(1 << 62), 1 << 62, 8000)
    words = pa.Table.from_batches(toxicity._packed(toxicity._OF_WORD, 8, np.zeros_like(long), np.sort(long), cell[:8000], t[:8000], mask[:8000], {0: ""}))
    held = {s.as_py(): len(x.as_py()) // 8 for s, x in zip(words.column("slot"), words.column("w"), strict=True)}
    assert len(held) == 8 and max(held.values()) < 1200  # two tasks had 4000 each


def test_long_runs_and_lists():
    n = 70_000
    for v, w in ((np.arange(n) * toxicity.SPREAD, np.zeros(n, np.int64)), (np.zeros(n, np.int64), np.arange(n))):
        rows = pa.Table.from_batches(toxicity._packed(toxicity._OF_PAIR, toxicity.SPREAD, v, w, np.zeros(n, "u1"), np.ones(n, np.int64), np.ones(n, np.int64), {}))
        a, b, *_ = toxicity._unpacked(rows)
        assert (a == v).all() and (b == w).all()


def test_words_of_latin_1_texts_need_no_pattern(monkeypatch):
    """Every character of Latin-1 between letters, in both cases, splits as the pattern does; only other texts are given to the pattern."""
    texts = ["".join(f"Ab{chr(c)}Cd " for c in range(256)), "", "A_b9c²d½ª º", *[chr(c) for c in range(256)]]
    want, other = [toxicity._WORD.findall(t.lower()) for t in texts], ["Łódź İx 中文 K1", "a\ud800b"]
    assert [words_of(t) for t in other] == [toxicity._WORD.findall(t.lower()) for t in other] and words_of(None) == []
    monkeypatch.setattr(toxicity, "_WORD", None)
    assert [words_of(t) for t in texts] == want and len(want[0]) > 256


def test_ratio_of_a_word_by_its_stems():
    own = {"vil": (0.5, 2.0, 0.1), "viler": (0.7, 0.1, 0.4), "gröb": (0.2, 3.0, 1.0), "中文字": (0.3, 0.2, 0.9)}
    model = toxicity.KneserNey({code("vilerous"): (0.6, 1.0, 0.2)}, {}, {code(k): v for k, v in own.items()})
    for word in ("vilerous", "vil", "viler", "vilest", "gröbere", "中文字文", "plain", "a"):
        r = 0.0
        for e in [*[own.get(word[:n]) for n in STEMS if len(word) > n], (0.6, 1.0, 0.2) if word == "vilerous" else None]:
            if e is not None:
                r = math.log((e[0] * math.exp(r) + e[1]) / (e[0] + e[2]))
        assert model.ratio(word) == r


def test_models_of_any_size_count_whole(spark, monkeypatch):
    """With more expressions than are held at a time every one still counts: each text's score is that of the whole models."""
    rng = np.random.default_rng(11)
    rows, labels = corpus(300, rng, every=2)
    rows = [(i, t.replace("bara bast", "you rotten") if labels[i][2] else t.replace("bara bast", "you fine"), a, b) for i, t, a, b in rows]
    rows += [(900, None, None, None), (901, "", None, None), (None, "vile vile you rotten grobsa", None, None), (7, rows[7][1], "en", "s")]
    df, ls = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    held = toxicity.learn(df, ls)
    assert len(held.words) > 1 and len(held.stems) > 1 and len(held.after) > 0
    monkeypatch.setattr(toxicity, "MOST_EXPRESSIONS", 80)
    model = toxicity.learn(df, ls)
    found = [model.lot(k) for k in range(model.lots)]
    size = lambda m: len(m.words) + len(m.stems) + sum(map(len, m.after.values()))
    assert model.lots > 2 and sum(map(size, found)) == size(held) > 80 and sum(size(m) > 0 for m in found) > 2
    words = words_of("vile you rotten grobsa bara you fine")
    assert abs(sum(m.log_odds(words) for m in found) - held.log_odds(words)) < 1e-9
    one, two = (sorted((str(r.doc_id), r.text or "", round(r.score, 6)) for r in toxicity.score_texts(df, m).collect()) for m in (held, model))
    assert one == two and len(one) == len(rows)
