"""Periodic runs, conversation repair and line dedup: brute force, known answers, odd rows."""

import hashlib
import itertools
import os
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from polynya.llm import dialogue, lines, periodic

DATA = "/root/testdata/sf0.001"


def brute_runs(w):
    n, out = len(w), []
    for q in range(1, n // 2 + 1):
        i = q
        while i < n:
            if w[i] != w[i - q]:
                i += 1
                continue
            start = i - q
            while i < n and w[i] == w[i - q]:
                i += 1
            smaller = any(all(w[j] == w[j - p] for j in range(start + p, i)) for p in range(1, q))
            if i - start >= max(12, 2 * q) and not smaller:
                out.append((start, i - start, q))
    return sorted(out)


pieces = st.lists(
    st.tuples(st.lists(st.sampled_from([b"a", b"b", b"c"]), min_size=1, max_size=9), st.integers(1, 9)), max_size=6
)


@settings(max_examples=400, deadline=None)
@given(pieces)
def test_runs_equal_brute_force(parts):
    words = [w for block, times in parts for w in block * times][:160]
    runs = periodic.periodic_runs(words)
    assert runs == brute_runs(words)
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    assert periodic.collapsed(words, runs) == [w for i, w in enumerate(words) if i not in gone]


def test_long_texts():
    assert periodic.periodic_runs([b"w"] * 300_000) == [(0, 300_000, 1)]
    words = [b"x%d" % (i % 7001) for i in range(50_000)]
    assert periodic.periodic_runs(words) == [(0, 50_000, 7001)]
    assert periodic.periodic_runs([b"%d" % i for i in range(100_000)]) == []


def test_runs_of_odd_rows(spark):
    line = "one two three four "
    rows = [(1, None, 7), (2, "", 7), (3, line * 4, 7), (3, line * 4, 7), (None, "a b", 7), (4, "é x\x0b" * 13, 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, period int").repartition(3)
    runs = sorted(tuple(r) for r in periodic.find_runs(docs).collect())
    assert runs == [(3, 0, 16, 4), (3, 0, 16, 4), (4, 0, 13, 1)]
    short = {(r.doc_id, r.text, r.period) for r in periodic.collapse_runs(docs).collect()}
    assert short == {(1, None, 7), (2, "", 7), (3, line.strip(), 7), (None, "a b", 7), (4, "é x", 7)}
    out = periodic.op11_periodic_runs(docs).collect()
    assert len(out) == 6 and {r.n_runs for r in out if r.doc_id in (1, 2)} == {0}
    assert {r.collapsed_sha256 for r in out if r.doc_id in (1, 2)} == {hashlib.sha256(b"").hexdigest()}
    assert periodic.op11_periodic_runs(docs.limit(0)).count() == 0
    assert periodic.find_runs(docs.limit(0)).count() == 0


def brute_repair(turns):
    """Least (cost, audit, roles) over all edits with at most two insertions at each place."""
    best = None
    choices = []
    for role, keepable, cut in turns:
        extra = 5 if cut else 0
        some = [(2, "D", None)]
        if keepable:
            some += [(extra, "K", role[:1])] if role[:1] else []
            some += [(1 + extra, "R", "u"), (1 + extra, "R", "a")]
        choices.append(some)
    inserts = [(5 * len(r), "I" * len(r), r) for r in ("", "u", "a", "ua", "au")]
    steps = [inserts]
    for c in choices:
        steps += [c, inserts]
    for path in itertools.product(*steps):
        roles = "".join(p[2] or "" for p in path)
        if re.fullmatch(r"(s?(ua)+)?", roles):
            found = (sum(p[0] for p in path), "".join(p[1] for p in path), roles)
            best = found if best is None or found < best else best
    return best


@settings(max_examples=60, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "tool"]), st.booleans(), st.booleans()), max_size=4))
def test_repair_equals_brute_force(turns):
    repair, out = dialogue.Repair(), []
    for i, (role, keepable, cut) in enumerate(turns):
        out += repair.feed(role, str(i), keepable, keepable and cut)
    cost, audit, rest = repair.finish()
    assert (cost, audit, "".join(r[0] for r, _ in out + rest)) == brute_repair(
        [(r, k, k and c) for r, k, c in turns]
    )


def test_long_conversation_settles_on_the_way():
    repair, out, most = dialogue.Repair(), [], 0
    for i in range(20_000):
        role = "user" if i % 7 == 3 else ("user", "assistant")[i % 2]
        out += repair.feed(role, str(i), i % 11 > 0, i % 13 == 0)
        most = max(most, i + 1 - len(repair.audit))
    cost, audit, rest = repair.finish()
    roles = "".join(r[0] for r, _ in out + rest)
    assert re.fullmatch("(ua)*", roles) and most < 300
    assert sum(e != "I" for e in audit) == 20_000


def conversation(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, gaps int").drop("gaps")


def test_faults_and_repair_of_odd_rows(spark):
    rows = [
        (1, 0, "system", "Be kind.", 1), (1, 1, "user", "Hi.", 1), (1, 2, "assistant", "Hello!", 1),
        (2, 0, "user", "A?", 1), (2, 2, "user", "A?", 1), (2, 5, "assistant", "cut", 1),
        (3, None, None, None, 1), (None, 0, "user", " \t", 1), (4, 0, "assistant", "x" * 200_000 + ".", 1),
    ]
    table = conversation(spark, rows).repartition(4)
    got = {r.conv_id: r for r in dialogue.summarised(
        table.select("conv_id", "turn", dialogue.or_blank(F.col("role")).alias("role"),
                     dialogue.or_blank(F.col("text")).alias("text"))).collect()}
    digest = lambda text: hashlib.sha256(text.encode()).hexdigest()
    assert got[1].audit == "KKK" and got[1].cost == 0 and got[1].illegal == 0
    assert got[1].repaired_sha256 == digest("system:Be kind.\nuser:Hi.\nassistant:Hello!")
    assert (got[2].gaps, got[2].duplicate, got[2].truncated, got[2].illegal) == (3, 1, 1, 1)
    assert (got[2].cost, got[2].audit, got[2].repaired_sha256) == (6, "DDD", digest(""))
    assert (got[3].blank, got[3].audit, got[3].gaps) == (1, "D", 0)
    assert got[None].blank == 1 and got[4].audit == "D"
    turns = [(r.conv_id, r.place, r.role, r.text) for r in dialogue.repaired(table).collect()]
    assert sorted(turns) == [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "assistant", "Hello!")]
    assert dialogue.op12_conversation_repair(table.limit(0)).count() == 0
    assert dialogue.repaired(table.limit(0)).count() == 0


def test_a_conversation_without_rows_after_damage(spark):
    import zlib

    lost = next(i for i in range(500) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    out = dialogue.op12_conversation_repair(conversation(spark, [(lost, 0, "user", "Hi.", 1)])).collect()
    assert [tuple(r) for r in out] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def brute_lines(rows, min_chars=10, min_docs=2):
    key = lambda l: "".join(c.lower() if "A" <= c <= "Z" else c for c in l.strip(" \t\n\x0b\x0c\r"))
    held = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                held.setdefault(key(line), set()).add(doc)
    last = lambda d: (d is None, d or 0)
    out = []
    for doc, text in rows:
        all_ = (text or "").split("\n")
        kept = [l for l in all_ if not (len(held.get(key(l), ())) >= min_docs and min(held[key(l)], key=last) != doc)]
        out.append((doc, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def test_line_dedup_equals_brute_force(spark):
    shared = "A line that all of them hold"
    rows = [(i, f"own line number {i}\n{shared}\n  {shared.upper()}\t\n\nshort\n{shared} twice {i % 3}") for i in range(40)]
    rows += [
        (50, None), (51, ""), (52, "\n\n"), (5, "another text of five\n" + shared), (5, "another text of five\n" + shared),
        (None, shared + "\nonly the null document"), (None, "only the null document"), (60, "Ünïcode line É\nünïcode line É"),
        (61, "ünïcode line É"), (62, "Ünïcode line É\n" + "word " * 50_000), (63, "x\n" * 20_000 + shared),
    ]
    docs = spark.createDataFrame([(d, t, "q", 3) for d, t in rows], "doc_id long, text string, gone string, at int")
    for least in (2, 3):
        out = lines.dedup_lines(docs.repartition(5), min_docs=least).collect()
        got = sorted(((r.doc.doc_id, r.n_lines, r.n_dropped, r.doc.text) for r in out), key=str)
        assert got == brute_lines(rows, min_docs=least)
        assert {(r.doc.gone, r.doc["at"]) for r in out} == {("q", 3)}
    digest = {(r.doc_id, r.kept_sha256) for r in lines.op13_line_dedup(docs).collect()}
    assert digest == {(d, hashlib.sha256(t.encode()).hexdigest()) for d, _, _, t in brute_lines(rows)}
    assert lines.op13_line_dedup(docs.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
@pytest.mark.parametrize("key", ["op11_periodic_runs", "op12_conversation_repair", "op13_line_dedup"])
def test_query_equals_sql(spark, key):
    import duckdb

    import __spark_entry__ as entry
    from tools.check import TABLES, compare

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    verdict, _ = compare(spark, con, key, entry.queries()[key], entry.oracle_sql()[key], DATA)
    assert verdict.startswith("ok"), verdict


def naive_signature(text, s):
    """Order MinHash spelled out: number the k-mers, sort all hashes, put the smallest in text order."""
    import numpy as np

    from polynya.llm import fingerprints as fp

    signer = fp.Signer(s)
    kmer = [int(x) for x in signer.kmers(text)]
    seen, numbered = {}, []
    for x in kmer:
        n = seen[x] = seen.get(x, -1) + 1
        numbered.append(int(fp.mixed(np.array([x], np.uint64) + fp.GOLD * np.uint64(n))[0]) >> 32)
    out = []
    for factor, shift in zip(signer.factor[:, 0].tolist(), signer.shift[:, 0].tolist(), strict=True):
        hashes = [((x ^ shift) * factor) % 2**32 for x in numbered]
        hashes = [h ^ (h >> 15) for h in hashes]
        picked = sorted(sorted(range(len(kmer)), key=lambda i: (hashes[i], i))[: s.tuple_size])
        state = fp.GOLD
        for i in picked:
            state = fp.mixed(np.array([state * fp.FNV + np.uint64(kmer[i])], np.uint64))[0]
        out.append(int(state) >> 32)
    return out if kmer else [0] * s.functions


@pytest.mark.filterwarnings("ignore::RuntimeWarning")
def test_signatures_equal_naive_order_minhash(monkeypatch):
    import numpy as np

    from polynya.llm import fingerprints as fp

    s = fp.Settings()
    texts = ["", "a", "abcabcabcabc", "aaaaaaaaaaaaaaaaaaaaaaaa", "é\U0001f600 " * 20, "the quick brown fox " * 9]
    plain = [fp.Signer(s).sign(t).tolist() for t in texts]
    assert plain == [naive_signature(t, s) for t in texts]
    monkeypatch.setattr(fp, "BLOCK", 7)
    assert plain == [fp.Signer(s).sign(t).tolist() for t in texts]
    assert np.isfinite(plain).all()


def test_shards_leave_other_columns_alone(spark):
    from polynya.llm import sharding

    df = spark.createDataFrame([(i, f"w{i}", i * 2, "s", 9) for i in range(50)], "k int, won string, at int, split string, shard int")
    out = sharding.slots(sharding.assign(df, "k", [1.0, 2.0]), ["k"])
    got = {r["k"]: r for r in out.collect()}
    assert all((r["won"], r["at"], r["split"]) == (f"w{k}", k * 2, "s") for k, r in got.items())
    for shard in (0, 1):
        slots = sorted(r["slot"] for r in got.values() if r["shard"] == shard)
        assert slots == list(range(len(slots)))
