"""Jaccard join, components, fingerprints and top-k against brute force, and odd rows."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from polynya.llm import fingerprints, graph, jaccard, topk

SCHEMA = "doc_id long, text string, lang string, source string, sid long, kept string, body string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", "s", 7, "k", "b") for i, t in rows], SCHEMA).repartition(3)


def shingle_set(text):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    if len(words) < 5:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + 5]) for i in range(len(words) - 4))


def brute(rows):
    """Component ids and link counts per row."""
    sets = [shingle_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
                links[a] += 1
                links[b] += 1
    groups = {}
    for i in range(len(rows)):
        groups.setdefault(find(i), []).append(i)
    out = {}
    for members in groups.values():
        ids = [rows[i][0] for i in members if rows[i][0] is not None]
        for i in members:
            out[i] = min(ids) if ids else None
    return [(rows[i][0], len(sets[i]), out[i], links[i]) for i in range(len(rows))]


def near_rows(seed=4, groups=12, each=14):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    boiler = [rng.choice(words) for _ in range(60)]
    rows, n = [], 1
    for g in range(groups):
        base = [rng.choice(words) for _ in range(rng.choice([3, 8, 40, 120, 300]))]
        if g % 3 == 0:
            base = boiler + base
        for _ in range(each):
            text = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 4, 9])):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((n, " ".join(text).upper() if n % 5 == 0 else " ".join(text)))
            n += 1
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, rows[3][1]), (n + 3, rows[3][1]), (None, rows[5][1])]
    rows += [(n + 4, "one"), (n + 5, "one"), (n + 6, "a b c d"), (n + 7, "Éa b c d e f g"), (n + 8, "éa b c d e f g")]
    rng.shuffle(rows)
    return rows


def key(r):
    return tuple((v is not None, v) for v in r)


@pytest.mark.parametrize(
    "s",
    [
        jaccard.Settings(count_links=True),
        jaccard.Settings(count_links=True, chunk_shingles=300, chars_per_part=4000, task_elements=700),
    ],
)
def test_join_equals_brute_force(spark, s):
    rows = near_rows()
    got = [tuple(r) for r in jaccard.jaccard_join(frame(spark, rows), s).collect()]
    assert sorted(got, key=key) == sorted(brute(rows), key=key)


def test_components_without_counting_links(spark):
    rows = near_rows(9)
    s = jaccard.Settings(chunk_shingles=500, task_elements=900)
    got = [tuple(r) for r in jaccard.jaccard_join(frame(spark, rows), s).collect()]
    assert sorted(got, key=key) == sorted([r[:3] for r in brute(rows)], key=key)


def test_one_of_each_keeps_one_row_per_component(spark):
    rows = near_rows(2)
    docs = frame(spark, rows)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    got = sorted(r.doc_id for r in kept.collect())
    want = {r[2] for r in brute(rows) if r[1]}
    empty = [r[0] for r in brute(rows) if not r[1]]
    assert got == sorted([*want, *empty])


def test_join_of_empty_table(spark):
    none = frame(spark, [(1, "a")]).where("false")
    assert jaccard.op2_ngram_jaccard(none).collect() == []
    assert jaccard.one_of_each(none).collect() == []


def test_components_of_chain_and_star(spark):
    edges = [(i + 1, i) for i in range(10, 60)] + [(100, i) for i in range(101, 130)] + [(7, 7)]
    got = {tuple(r) for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {(i, 10) for i in range(10, 61)} | {(i, 100) for i in range(100, 130)}


def test_fingerprints_follow_the_contract(spark):
    rng = random.Random(1)
    rows = [(i * 3, "".join(rng.choice("abcdef é\U0001f600") for _ in range(rng.choice([0, 1, 3, 7, 50, 900])))) for i in range(90)]
    rows += [(1000, None), (1001, "same text here"), (1002, "same text here"), (1003, "x" * 70_000)]
    got = {r.doc_id: r for r in fingerprints.op4_order_minhash(frame(spark, rows)).collect()}
    assert len(got) == len(rows)
    ordered = sorted((i, t or "") for i, t in rows)
    signer = fingerprints.Signer(fingerprints.Settings())
    for at, (i, text) in enumerate(ordered):
        after = ordered[(at + 1) % len(ordered)][1]
        q = len(text) // 4
        changed = text[: len(text) - q] + after[:q]
        r = got[i]
        assert r.n_chars == len(text)
        assert r.edited_sha256 == hashlib.sha256(changed.encode()).hexdigest()
        assert r.fingerprint == fingerprints.hexed(signer.sign(text))
        assert r.edited_fingerprint == fingerprints.hexed(signer.sign(changed))
        assert r.near_next == fingerprints.likeness(signer.sign(text), signer.sign(after))
    assert got[1001].fingerprint == got[1002].fingerprint and got[1001].near_next == 1.0


def test_successor_crosses_buckets(spark):
    rows = [(i, f"text {i} " * 5) for i in range(-50, 450)] + [(None, "none"), (None, "nine")]
    out = fingerprints.with_next(frame(spark, rows), chars_each=300)
    assert out.where("not _extra").count() == len(rows)
    got = fingerprints.compare_edits(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    single = fingerprints.op4_order_minhash(frame(spark, [(5, "abcdefgh")])).collect()
    assert single[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and single[0].near_next == 1.0
    assert fingerprints.op4_order_minhash(frame(spark, rows).where("false")).collect() == []


def test_order_changes_the_signature():
    signer = fingerprints.Signer(fingerprints.Settings(functions=256))
    rng = random.Random(5)
    a = "".join(rng.choice("abcdefghijklmnop") for _ in range(600))
    swapped = a[300:] + a[:300]
    edited = a[:300] + "zz" + a[302:]
    near = fingerprints.likeness(signer.sign(a), signer.sign(edited))
    moved = fingerprints.likeness(signer.sign(a), signer.sign(swapped))
    assert near > 0.9 and moved < 0.8


def vectors(seed=3, n=700, dim=9):
    rng = np.random.default_rng(seed)
    v = rng.normal(0, 0.3, (n, dim)).astype(np.float32)
    v[100:180] = v[100]
    rows = [(i, [float(x) for x in row], 1, 2) for i, row in enumerate(v)]
    rows += [(n, None, 1, 2), (n + 50, [float("nan")] * dim, 1, 2), (n + 1, [None] * dim, 1, 2), (n + 2, [float("inf")] * dim, 1, 2)]
    rows += [(n + 3, [0.5] * 4, 1, 2), (750, [0.25] * 4, 1, 2), (3, rows[3][1], 1, 2), (None, rows[4][1], 1, 2)]
    return rows


def brute_top(rows, k=5, factor=256):
    fine = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            fine[i] = [int(np.floor(factor * np.float64(np.float32(x)))) for x in v]
    out = []
    for q in sorted(fine):
        if q % 50 == 0:
            scores = sorted(
                (-sum(a * b for a, b in zip(fine[q], v, strict=True)), i) for i, v in fine.items()
                if i != q and len(v) == len(fine[q])
            )
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return out


@pytest.mark.parametrize("s", [topk.Settings(), topk.Settings(shard_rows=60, leaf=8, block_queries=4)])
def test_top_k_equals_brute_force(spark, s):
    rows = vectors()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, shard int, dim int").repartition(3)
    got = topk.top_k(topk.whole_numbers(df), F.col("vec_id") % 50 == 0, s).collect()
    assert sorted(tuple(r) for r in got) == brute_top(rows)
    assert topk.op3_exact_top_k(df.where("false")).collect() == []


def test_top_k_with_scores_beyond_doubles():
    rng = np.random.default_rng(2)
    v = rng.integers(-(2**28), 2**28, (50, 4))
    search = topk.Search(v, np.arange(50), v[:3], np.arange(3), topk.Settings(leaf=5))
    search.walk(topk.ball_tree(search.points, np.arange(50), 5))
    exact = v.astype(object) @ v[:3].astype(object).T
    for q in range(3):
        want = sorted((-exact[i, q], i) for i in range(50) if i != q)[:5]
        assert [(-s, i) for s, i in want] == list(zip(search.score[q].tolist(), search.found[q].tolist(), strict=True))
