"""HTML, mixing, packing, sharding and the pipeline: known answers, round trips, odd rows."""

import os
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from polynya.llm import html, mixing, packing, sharding

DATA = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, size long, rate double, copies int, shard int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, 1, 0.5, 3, 9) for i, t, s in rows], SCHEMA).repartition(3)


def odd_rows():
    return [
        (1, None, "a"), (2, "", "a"), (3, "one two three", None), (4, "w " * 9000, "b"), (5, "x y", "b"), (5, "x y", "b"),
        (None, "p q r s", "c"), (7, "é \U0001f600", "c"), (8, "tab\tand\x0bmore   kept", ""), (9, "<|endoftext|> mid", "d"),
    ]


@pytest.mark.parametrize(
    "markup, text",
    [
        (None, None),
        ("", ""),
        ("<p>a<p>b", "a\n\nb"),
        ("a<br>b<br><br>c", "a\nb\n\nc"),
        ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol></ul>z", "- a\n- b\n  3. x\n  4. y\n\nz"),
        ("<table><tr><td>ab<td>c<tr><td>d<td>ef</table>", "ab | c\nd  | ef"),
        ("<div hidden>no</div><div style='display: none'>no</div><span>yes</span>", "yes"),
        ("<script>var a='</p>'</script>t<style>x</style><!-- c -->u", "tu"),
        ("<pre>\n a  b\n  c</pre>", "a  b\n  c"),
        ("x &amp; y &lt;z&gt; &eacute;", "x & y <z> é"),
        ("<h1>T</h1>text", "T\n\ntext"),
        ("a </b></i> b <i>c", "a b c"),
        ("<details><summary>s</summary>inside</details>", "s"),
        ("<dl><dt>k<dd>v</dl>", "k\n    v"),
        ("<p>1 < 2 and <unknown>t</unknown>", "1 < 2 and t"),
        ("<blockquote>q</blockquote>", "> q"),
        ("<p>one<div>two</p>three", "one\n\ntwo\n\nthree"),
        ("<table><tr>stray<td>1</table>", "stray\n1"),
        ("<table><tr><td><ul><li>a<li>b</ul><td>c<tr><td>d<td>e</table>", "- a | c\n- b\nd   | e"),
        ("<table><tr><td rowspan=2>ab<td>c<tr><td>d<tr><td>e<td>f</table>", "ab | c\n   | d\ne  | f"),
        ("<table><tr><td>" + "x" * 70 + "<td>y<tr><td>z<td>w</table>", "x" * 70 + " | y\nz" + " " * 69 + " | w"),
        ("<svg><title>no</title><text>yes</text></svg> <math><mi>x</mi></math>", "yes x"),
        ("<div style='visibility:hidden'>no <b style='visibility:visible'>yes</b></div>", "yes"),
        ("<style>.x, p.y{display:none} @media print{b{display:none}}</style><i class='a x'>no</i><p class=y>no</p><b class=y>yes</b>", "yes"),
        ("<style>.x{display:none} #k{display:block}</style><i class=x id=k>yes</i>", "yes"),
        ("<ul style='visibility:hidden'><li>no<li style='visibility:visible'>yes</ul>", "- yes"),
    ],
)
def test_rendering(markup, text):
    got = html.rendered(markup)
    assert (got.strip() if got else got) == text


def test_deep_and_broken_markup():
    deep = "<div>" * 30_000 + "core" + "</div>" * 10
    assert html.rendered(deep) == "core"
    assert html.rendered("<table><tr><td>" * 300 + "x").replace("|", "").strip() == "x"
    assert html.rendered("<a href='unclosed>end") == "<a href='unclosed>end"
    wide = "<table>" + "<tr><td>a<td>b" * 3000 + "<tr><td>" + "x" * 200_000 + "<td>c</table>"
    assert Counter(html.rendered(wide).replace("|", " ").split()) == {"a": 3000, "b": 3000, "x" * 200_000: 1, "c": 1}


@pytest.mark.parametrize("times", [1, 40, 400])
def test_tables_of_any_size_are_aligned(times):
    rows = "<tr><td>a<td>b<tr><td><ul><li>c<li>d</ul><td rowspan=2>e<tr><td>f" * times
    for wide in (70, 9000):
        got = html.rendered("<table>" + rows + "<tr><td>" + "x" * wide + "<td>y</table>").rstrip().split("\n")
        text = lambda first, then: first.ljust(wide) + " | " + then
        assert got == [text("a", "b"), text("- c", "e"), "- d", "f"] * times + [text("x" * wide, "y")]


def test_pages_are_handed_on_in_small_batches(spark):
    pages = spark.createDataFrame([(i, None if i % 5 == 0 else f"<p>{'w' * i}") for i in range(60)], "page_id int, html string")
    got = {r.page_id: r.text for r in html.extract(pages.coalesce(1), batch_chars=100).collect()}
    assert got == {i: None if i % 5 == 0 else "w" * i for i in range(60)}


def test_visible_words_of_nested_markup_equal_brute_force():
    draw = np.random.default_rng(3)
    tags = ["div", "span", "b", "ul", "li", "section", "table", "blockquote", "svg", "h2", "td"]
    hides = ["", "", "", " hidden", " style='display:none'", " class=gone", " style='visibility:hidden'", " style='visibility:visible'"]
    for _ in range(150):
        parts, want, count = ["<style>.gone{display:none}</style>"], Counter(), 0

        def grow(depth, shown, seen):
            nonlocal count
            for _ in range(int(draw.integers(1, 4))):
                count += 1
                parts.append(f" w{count} ")
                if shown and seen:
                    want[f"w{count}"] += 1
                if depth < 5 and draw.random() < 0.7:
                    tag, hide = draw.choice(tags), draw.choice(hides)
                    now = "visible" in hide or (seen and "visibility" not in hide)
                    inner = "<tr><td>" if tag == "table" else ""
                    before = {"td": "<table><tr>", "li": "<ul>"}.get(tag, "<div>")
                    parts.append(f"{before}<{tag}{hide}>{inner}")
                    grow(depth + 1, shown and not ("hidden" == hide.strip() or "none" in hide or "gone" in hide), now)
                    parts.append(f"</{tag}>" + {"td": "</table>", "li": "</ul>"}.get(tag, "</div>"))

        grow(0, True, True)
        got = html.rendered("".join(parts)).replace("|", " ").replace("- ", " ").replace("> ", " ")
        assert Counter(w for w in got.split() if w.startswith("w")) == want, "".join(parts)


def test_every_visible_word_once(spark):
    words = [f"w{i}" for i in range(200)]
    markup = "<body>" + "".join(f"<{t}>{w}</{t}>" for t, w in zip(["p", "div", "span", "li", "td"] * 40, words, strict=True))
    assert Counter(html.rendered(markup).replace("-", " ").replace("|", " ").split()) == Counter(words)
    pages = spark.createDataFrame([(1, "u", "<p>a"), (2, "u", None), (None, "u", "")], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html.op7_html_rendering(pages).collect()}
    assert got == {1: "a", 2: None, None: ""}
    assert html.op7_html_rendering(pages.where("false")).collect() == []


def brute_targets(sizes, cap=3):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    total, target, free = sum(sizes.values()), dict.fromkeys(order, 0.0), set(order)
    while True:
        left = total - sum(target[s] for s in order if s not in free)
        w = sum(weight[s] for s in free)
        for s in free:
            target[s] = left * weight[s] / w
        over = {s for s in free if target[s] > cap * sizes[s]}
        if not over:
            return target
        for s in over:
            target[s] = cap * sizes[s]
        free -= over


def test_targets_equal_repeated_resharing(spark):
    rng = np.random.default_rng(7)
    for n in (1, 2, 5, 23):
        sizes = {f"s{i}": int(10 ** rng.uniform(0, 5)) for i in range(n)}
        sizes[None] = 40
        df = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute_targets(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) <= 1e-6 * max(1, want[s]) for s in want)


def test_mix_copies(spark):
    rows = odd_rows() + [(i, "a b c d e", f"s{i % 4}") for i in range(100, 900)]
    docs = frame(spark, rows)
    mixed = mixing.mix(docs)
    got = mixed.select("doc.doc_id", "doc.source", "size", "source_size", "target", "copies").collect()
    assert len(got) == len(rows)
    taken, target = defaultdict(int), {}
    for r in got:
        assert 0 <= r.copies <= 3
        taken[r.source] += r.size * r.copies
        target[r.source] = r.target
    for s in ("s0", "s1", "s2", "s3"):
        assert abs(taken[s] - target[s]) < 0.15 * target[s]
    out = mixing.emit(mixed)
    assert out.columns == docs.columns
    assert out.count() == sum(r.copies for r in got)
    assert sorted(map(tuple, mixing.mix(docs).select("doc.doc_id", "copies").where("doc_id > 0").collect())) == sorted(
        (r.doc_id, r.copies) for r in got if r.doc_id is not None
    )
    assert mixing.op8_source_mixing(docs.where("false")).collect() == []


def test_packing_round_trip(spark):
    rows = odd_rows() + [(i, f"document {i} " * (i % 90), "s") for i in range(100, 400)]
    docs = frame(spark, rows)
    settings = packing.public_vocabulary()
    settings = packing.Settings(model=settings.model, ranks=settings.ranks, with_ids=True, docs_per_group=50)
    got = packing.pack(docs, settings).collect()
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(settings.model)
    want = Counter((i, *full.encode(t or "", add_special_tokens=False).ids, 1) for i, t, _ in rows)
    pieces = defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes()) and r.length == len(r.ids)
        pieces[r.doc_id].append(r)
    once = Counter({k: n for k, n in want.items() if k[0] != 5})
    have = Counter()
    for i, parts in pieces.items():
        if i != 5:
            parts.sort(key=lambda r: r.start)
            assert [r.start for r in parts] == list(np.cumsum([0, *(r.length for r in parts[:-1])]))
            have[(i, *(x for r in parts for x in r.ids))] += 1
    assert have == once and len(pieces[5]) == 2
    filled = defaultdict(list)
    for r in got:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(docs.where("false")).collect() == []


def test_chunked_encoding_equals_whole():
    from tokenizers import Tokenizer

    s = packing.public_vocabulary()
    encode, full = packing.encoder(s.model, s.ranks), Tokenizer.from_file(s.model)
    for t in [
        "", " ", "  a  b\n\n c \n", "\n", "don't we'll  I'm\n'tis", "café 中文 \U0001f600!!", "tab\t x y  z",
        "a\x1cb \x85c", "<|endoftext|>", "x" * 500 + " " * 40 + "y", "1234 56%%% $$$&&&", " trailing   ",
    ]:
        assert encode(t).tolist() == full.encode(t, add_special_tokens=False).ids, t


def test_first_fit_is_first_fit():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 2049, 400))[::-1]
    bins, offsets = packing.first_fit(lengths, 2048)
    room, want = [], []
    for n in lengths.tolist():
        at = next((i for i, r in enumerate(room) if r >= n), len(room))
        if at == len(room):
            room.append(2048)
        want.append((at, 2048 - room[at]))
        room[at] -= n
    assert list(zip(bins, offsets, strict=True)) == want


def test_sharding_moves_only_into_the_new_shard(spark):
    rows = odd_rows() + [(i, "t", "s") for i in range(1000, 5000)] + [(77, "hot", "s")] * 500
    docs = frame(spark, rows)
    a = sharding.op10_rendezvous_sharding(docs, 16).collect()
    b = sharding.op10_rendezvous_sharding(docs, 17).collect()
    more = {r.doc_id: r.shard for r in b}
    assert len(a) == len(rows)
    for r in a:
        assert r.grown_shard == more[r.doc_id]
        assert r.grown_shard in (r.shard, 16)
        text = next(t for i, t, _ in rows if i == r.doc_id and zlib.crc32((t or "").encode()) == r.text_crc32)
        assert r.size == len((text or "").encode()) + 1
    slots = defaultdict(list)
    for r in a:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    spread = Counter(r.shard for r in a if r.doc_id is not None and 1000 <= r.doc_id)
    assert len(spread) == 16 and max(spread.values()) < 1.4 * 250
    assert sharding.op10_rendezvous_sharding(docs.where("false")).collect() == []


def test_weights_share_in_proportion(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    got = {r.shard: r["count"] for r in sharding.assign(df, "k", [1.0, 2.0, 5.0]).groupBy("shard").count().collect()}
    assert abs(got[0] - 2500) < 300 and abs(got[1] - 5000) < 400 and abs(got[2] - 12500) < 500


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables not present")
def test_pipeline_stages(spark):
    import corpus_pipeline as p

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    columns = docs.columns
    from polynya.llm import jaccard, quality, toxicity

    kept = p.drop_toxic(spark, docs, DATA)
    score = toxicity.rate(docs, toxicity.learnt(docs, labels)).where("predicted = 0").select("doc_id")
    assert kept.columns == columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(r.doc_id for r in score.collect())
    good = p.keep_quality(spark, docs, DATA)
    score = quality.rate(docs, quality.learnt(docs, labels)).where("predicted = 1").select("doc_id")
    assert sorted(r.doc_id for r in good.collect()) == sorted(r.doc_id for r in score.collect())
    one = p.drop_near_duplicates(spark, docs, DATA)
    components = jaccard.jaccard_join(docs).select("component_id").distinct()
    assert one.columns == columns and one.count() == components.count()
    mixed = p.mix_sources(spark, docs, DATA)
    taken = mixing.mix(docs).agg(F.sum("copies")).first()[0]
    assert mixed.columns == columns and mixed.count() == taken
    assert p.run(spark, DATA).count() > 0
    none = docs.where("false")
    for _, stage in p.STAGES:
        assert stage(spark, none, DATA).collect() == []


def test_a_worker_keeps_its_encoder_and_long_runs_pass():
    from tokenizers import Tokenizer

    s = packing.public_vocabulary()
    encode, full = packing.encoder(s.model, s.ranks), Tokenizer.from_file(s.model)
    assert packing.encoder(s.model, s.ranks) is encode
    for text in ("a" + " " * 2_000_000 + "x", "b" * 300_000, "\t \x0b\n it's\x1c 12"):
        assert encode(text).tolist() == full.encode(text, add_special_tokens=False).ids
