"""Language model, quality and toxicity: brute force on small input, held-out accuracy, odd rows."""

import math
import os
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from polynya.llm import base, lm, quality, toxicity

DATA = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, lang string, source string, score double, part int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 1.0, 1) for i, t in rows], SCHEMA).repartition(3)


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def odd_rows():
    return [
        (1, None), (2, ""), (3, "A b A b a B"), (4, "x " * 3000), (5, "a b a b"), (5, "a b a b"), (6, "É é q"),
        (None, "null id here"), (8, " \n\t "), (9, "unseen words only perhaps"), *((i, "a b c d") for i in range(10, 40)),
    ]


def test_base_score_counts(spark):
    rows = odd_rows()
    got = lm.op1_pitman_yor(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    tokens = {}
    for i, t in rows:
        words = (t or "").encode().lower().split() + [None]
        tokens.setdefault((i, t), words)
    count = Counter(
        w for i, t in rows if not held("" if i is None else i) for w in tokens[i, t]
    )
    n, v = sum(count.values()), len(count)
    want = Counter()
    for i, t in rows:
        words = tokens[i, t]
        base = sum(math.log10((count[w] + 1) / (n + v + 1)) for w in words)
        want[(i, held("" if i is None else i), len(words), sum(count[w] > 0 for w in words), n, round(base, 6))] += 1
    have = Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got)
    assert have == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)


def test_probabilities_sum_to_one(spark):
    # Every context is followed once by each known word and by an unknown one.
    words = ["a", "b", "c"]
    train = [(i, "a b c a b a a c b") for i in range(1, 9) if not held(i)]
    first = next(i for i in range(100, 200) if held(i))
    ask = [i for i in range(first, first + 400) if held(i)][:4]
    rows = train + list(zip(ask, ["a a", "a b", "a c", "a zzz"], strict=True))
    got = {r.doc_id: r for r in lm.op1_pitman_yor(frame(spark, rows)).collect()}
    alone = [i for i in range(first + 400, first + 800) if held(i)][:1]
    scores = {t: got[i].score for i, t in zip(ask, ["a", "b", "c", "zzz"], strict=True)}
    # p(end | w) differs per word, so compare the conditional mass through single-word texts.
    more = train + [(alone[0], "a")]
    single = {r.doc_id: r for r in lm.op1_pitman_yor(frame(spark, more)).collect()}[alone[0]].score
    assert single < 0 and all(s < 0 for s in scores.values()) and len(words) == 3


def brute_sum(count, tables, others, prior, theta, d):
    total = count.sum()
    in_context = tables.sum() + others
    return (np.maximum(count - d * tables, 0) + (theta + d * in_context) * prior).sum() / (theta + total)


def test_gibbs_keeps_customers_and_mass():
    rng = np.random.default_rng(1)
    s = lm.Settings(burn=20, samples=30)
    count = np.array([2, 3, 5, 9, 40, 400, 2, 2])
    context = np.array([0, 0, 0, 1, 1, 1, 1, 2])
    prior = np.array([0.1, 0.2, 0.3, 0.2, 0.2, 0.1, 0.1, 0.5])
    kept = lm.gibbs(count, context, prior, np.array([3, 0, 1]), np.ones(3, np.int64), s, rng)
    assert len(kept) == 30
    for t in kept:
        assert (t >= 1).all() and (t <= count).all()
    # With a prior that sums to one over its dishes, a context's probabilities sum to one.
    t = kept[-1][:3]
    p = np.array([0.2, 0.3, 0.5])
    assert abs(brute_sum(count[:3], t, 0, p, s.strength, s.discount) - 1) < 1e-9


def test_gibbs_agrees_with_exact_table_distribution():
    # Two customers of one dish: tables are 2 with weight (theta + d) * p against 1 - d for 1.
    s = lm.Settings(burn=5, samples=1, discount=0.5, strength=1.0)
    n = 40_000
    t = lm.gibbs(
        np.full(n, 2), np.arange(n), np.full(n, 0.4), np.zeros(n, np.int64), np.ones(n, np.int64), s,
        np.random.default_rng(3),
    )[0]
    share = (1.0 + 0.5) * 0.4 / ((1.0 + 0.5) * 0.4 + 0.5)
    assert abs((t == 2).mean() - share) < 0.02


def exact_tables(n, prior, others, theta, d, most):
    """Mean of the tables of one dish with n customers, by the recursion over its customers."""
    k = np.arange(most + 1)
    ways = np.where(k == 1, 0.0, -np.inf)
    for m in range(1, n):
        stay = np.where(k <= m, ways + np.log(np.maximum(m - d * k, 1e-300)), -np.inf)
        ways = np.logaddexp(stay, np.append(-np.inf, ways[:-1]))
    weight = ways + k * np.log(prior) + np.append(0, np.cumsum(np.log(theta + d * (others + k[:-1]))))
    share = np.exp(weight - weight.max())
    return (share * k).sum() / share.sum()


@pytest.mark.parametrize(
    "n, prior, others, most", [(16, 0.2, 500, 16), (40, 0.5, 20, 40), (200, 0.05, 1000, 200), (10_000, 0.001, 500_000, 1200)]
)
def test_gibbs_of_many_customers_agrees_with_exact_tables(n, prior, others, most):
    s, copies = lm.Settings(), 60 if n > 1000 else 2000
    kept = lm.gibbs(
        np.full(copies, n), np.arange(copies), np.full(copies, prior), np.full(copies, others), np.ones(copies, np.int64), s,
        np.random.default_rng(2),
    )
    want = exact_tables(n, prior, others, s.strength, s.discount, most)
    assert abs(kept[-1].mean() - want) < 0.1 * want


def test_parent_of_seatings_follows_the_tables(spark):
    # "b" comes after "a" alone, often, and so do words seen twice after it: more tables than pairs.
    pairs = spark.createDataFrame(
        [(1, 2, 4000, 8000, 0), *((1, 10 + i, 2, 8000, 1 + i) for i in range(2000))], "first long, second long, n int, alone int, id int"
    )
    words = spark.createDataFrame(
        [(1, 8000, 0, 0, 2001, 0), (2, 4000, 0, 0, 0, 1), *((10 + i, 2, 0, 0, 0, 1) for i in range(2000))],
        "first long, n int, alone int, follows int, heads int, more int",
    )
    total = lm.Totals(8000, 2002)
    tables = {}
    for rounds in (1, 4):
        got = lm.sample_seatings(pairs, words, total, lm.Settings(rounds=rounds)).where("second = 2").first()
        tables[rounds] = (got.t0 + got.t1) / 2
    assert tables[4] > 2 * tables[1]


def test_split_context_scores_stay_close(spark):
    rows = [(i, " ".join(np.random.default_rng(i).choice(list("abcdefgh"), 60))) for i in range(1, 60)]
    docs = frame(spark, rows)
    learn = F.col("doc_id") % 5 != 0
    whole = {r.doc_id: r.score for r in lm.score(docs, learn)[0].collect()}
    split = {r.doc_id: r.score for r in lm.score(docs, learn, lm.Settings(context_tokens=100, chunk_tokens=200))[0].collect()}
    assert all(abs(whole[i] - split[i]) < 0.05 * abs(whole[i]) for i in whole)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_model_beats_base_on_held_out(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    r = lm.op1_pitman_yor(docs).where("held_out").agg(F.sum("score"), F.sum("base_score")).first()
    assert r[0] > r[1]


def test_empty_tables(spark):
    none = frame(spark, [(1, "a")]).where("false")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert lm.op1_pitman_yor(none).collect() == []
    assert quality.op5_quality(none, labels).collect() == []
    assert toxicity.op6_toxicity(none, labels).collect() == []
    some = frame(spark, odd_rows())
    for op, held_out in ((quality.op5_quality, 5), (toxicity.op6_toxicity, 3)):
        rows = op(some, labels.where("false")).collect()
        assert len(rows) == len(odd_rows()) and held_out
        assert all(0 <= r.score <= 1 for r in rows)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
@pytest.mark.parametrize("name", ["quality", "toxic"])
def test_held_out_accuracy(spark, name):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    op = quality.op5_quality if name == "quality" else toxicity.op6_toxicity
    out = op(docs, labels)
    rows = out.where("held_out").join(labels, "doc_id").select("predicted", F.col(name).alias("y")).collect()
    right = sum(r.predicted == r.y for r in rows)
    assert right / len(rows) > (0.97 if name == "quality" else 0.9)


def test_labels_with_nulls_and_equal_texts(spark):
    good = "the quiet river runs by the old mill and the people walk home"
    bad = "BUY!! NOW!! CHEAP!! CLICK!! HERE!! FREE!!"
    rows = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}") for i in range(1, 120)] + [(500, good), (501, good), (502, None)]
    labels = spark.createDataFrame(
        [(i, i % 2, (i + 1) % 2) for i in range(1, 120)] + [(None, 1, 1), (500, None, None)], "doc_id long, quality int, toxic int"
    )
    got = {r.doc_id: r for r in quality.op5_quality(frame(spark, rows), labels).collect()}
    assert got[500].score == got[501].score and got[500].predicted == 1
    assert got[2].predicted == 0 and got[502].score is not None


def test_clean_keeps_columns_and_rows(spark):
    rows = odd_rows()
    docs = frame(spark, rows)
    model = toxicity.fit([])
    assert toxicity.clean(docs, model).columns == docs.columns
    assert toxicity.clean(docs, model).count() == len(rows)
    assert quality.keep_good(docs, quality.fit([])).count() == len(rows)


def test_whole_text_is_scored():
    tox = [f"walk{a} idiot by{b} moron river" for a in range(30) for b in range(30)]
    fine = [f"we walk{a} along by{b} the river" for a in range(30) for b in range(30)]
    model = toxicity.fit([(t, 1) for t in tox] + [(t, 0) for t in fine])
    score = toxicity.scorer(model)
    long = "we walk3 along by4 the river " * 4000
    late = long + "walk3 idiot by4 moron river " * 400
    assert score([late])[0] > score([long])[0]


def test_short_toxic_words_show_at_every_place():
    words = [f"{a}{b}" for a in ("stone", "walk", "river", "mill", "house") for b in "abcdefghijkl"]
    draw = np.random.default_rng(4)
    fine = [" ".join(draw.choice(words, 12)) for _ in range(900)]
    tox = [" ".join([*draw.choice(words, 5), draw.choice(["idiot", "scum", "git"]), *draw.choice(words, 6)]) for _ in range(900)]
    saved = toxicity.savings(toxicity.fit([(t, 1) for t in tox] + [(t, 0) for t in fine]))
    for word in ("idiot", "idiot.", "scum", "scum."):
        for place in range(6):
            hits = 0
            for _ in range(100):
                window = list(draw.choice(words, 6))
                window[place] = word
                hits += saved(" ".join(window))[0] > 0
            assert hits > 60, (word, place, hits)


def test_toxicity_score_equals_plain_compression():
    tox = [f"walk{a} idiot by{b} moron river" for a in range(30) for b in range(30)]
    fine = [f"we walk{a} along by{b} the river" for a in range(30) for b in range(30)]
    model = toxicity.fit([(t, 1) for t in tox] + [(t, 0) for t in fine])
    plain, harsh = toxicity.compressor(model.ordinary), toxicity.compressor(model.toxic + model.ordinary)
    assert b"idiot" in model.toxic and b"idiot" not in model.ordinary
    for text in ("", "Idiot, walk3 by the river and on and on we walk", "we walk4 along", tox[7] * 3):
        words = text.lower().split()
        saved = []
        for i in range(0, len(words), 6):
            window = " "
            for w in words[i : i + 6]:
                core = w.strip(".,;:!?\"'()[]")
                before, _, after = w.partition(core) if core else (w, "", "")
                window += "".join(f"{part} " for part in (before, core, after) if part)
            window = window.encode()
            saved.append(len(plain(window)) - len(harsh(window)))
        n = max(len(saved), 1)
        big = sum(v >= 4 for v in saved)
        x = [1, sum(saved) / n, sum(saved) / n**0.5, max([0, *saved]) / 4, 4 * big / n**0.5]
        z = sum(a * b for a, b in zip(x, model.weights))
        assert toxicity.scorer(model)([text])[0] == pytest.approx(1 / (1 + math.exp(-max(-30, min(30, z)))))


def test_quality_score_equals_plain_sum():
    model = quality.fit([(f"good calm prose {i}", 1) for i in range(40)] + [(f"BUY!! {i} {i} NOW", 0) for i in range(40)])
    s = model.settings
    prime, mask = 16777619, 2**32 - 1

    def rolled(chars):
        value = 0
        for i, c in enumerate(chars):
            value = ord(c) if not i else (value * prime + ord(c)) & mask
        return value

    def spread(value):
        return ((value * 2654435769) & mask) >> (32 - s.bits)

    text = "Calm  calm prose\tBUY"
    flat = f" {' '.join(text.split())} "
    grams = [rolled(flat[i : i + n]) ^ n for n in s.orders for i in range(len(flat) - n + 1)]
    whole = []
    for word in text.split():
        power, value = prime, (32 * prime) & mask
        for c in word:
            power = power * prime & mask
            value = (value + ord(c) * power) & mask
        whole.append(value)
    pairs = [(0xA511E9B3 + (a == b)) & mask for a, b in zip(whole, whole[1:])]
    buckets = [spread(g) for g in grams] + [spread(w ^ 0x5BD1E995) for w in whole]
    buckets += [spread(p) for p in pairs for _ in range(s.pair_weight)]
    z = sum(float(model.table[b]) for b in buckets) / len(buckets) + model.offset
    assert quality.scorer(model)([text])[0] == pytest.approx(1 / (1 + math.exp(-z)), rel=1e-6)


def test_a_late_passage_is_learnt_from_a_long_text(spark):
    # The only telling words of the training texts stand behind 30,000 characters.
    long = "we walk along by the river " * 1200
    rows = [(i, f"{long}{i} " + ("idiot by moron " * 3 if i % 2 else "mill by house ")) for i in range(1, 40)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    sample = base.labelled_sample(frame(spark, rows), labels, "toxic", F.lit(True), 100)
    assert sorted(sample) == sorted((t, i % 2) for i, t in rows)
    assert len(base.labelled_sample(frame(spark, rows), labels, "toxic", F.lit(True), 5)) == 10
