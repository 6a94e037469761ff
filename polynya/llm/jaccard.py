"""N-gram Jaccard join with prefix trees.

Documents with the same shingle set form a class; the join runs over classes.

1. Each distinct shingle is counted over classes. What occurs in one class links nothing, so
   only shared shingles travel back, and a class with too few of them is done.
2. Shingles are ordered by (number of classes, hash), the rarest first. Two sets that are similar enough
   share a shingle within their prefixes, so sets are joined only within the connected parts
   of the graph "share a prefix shingle". A part that is too large for one task is cut in
   blocks and every pair of blocks meets in a task.
3. In a task the ordered sets are stored in a trie. A set walks the trie, its overlap with a
   shared beginning is counted once for all sets below, and a subtree is left when the overlap so far
   plus what remains in both cannot reach the overlap that the sizes below require.
4. The links found are joined to components over all tasks.

Shingles are 64-bit hashes of five words; sets are told apart by 64 bits of a hash of the whole
set. Words are case-folded for A-Z only.

Definitions: a text with fewer words than a shingle has the one shingle of all its words; a null
text or one without words has an empty set, links with nothing and is its own component.
Repeated rows are copies. A component's id is its smallest doc_id that is not null.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polynya.llm.base import pack, pieces, text_size, unpack, written
from polynya.llm.graph import components

PRIME = np.uint64(0x9E3779B97F4A7C15)
STEPS = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 80
    chars_per_part: int = 12_000_000
    chunk_shingles: int = 1_000_000
    task_elements: int = 2_000_000
    count_links: bool = False


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


POWERS = np.cumprod(np.full(4096, PRIME, np.uint64), dtype=np.uint64)


def word_hashes(text: str) -> np.ndarray:
    """One 64-bit hash per word, in text order."""
    code = np.frombuffer(text.encode("utf-8", "replace").lower(), np.uint8)
    blank = SPACE[code]
    edge = np.flatnonzero(np.diff(blank, prepend=True, append=True))
    start, end = edge[::2], edge[1::2]
    if not len(start):
        return np.empty(0, np.uint64)
    first = start if start[0] == 0 else np.append(0, start)
    within = np.arange(len(code)) - np.repeat(first, np.diff(np.append(first, len(code))))
    value = (code.astype(np.uint64) + np.uint64(1)) * POWERS[within % len(POWERS)]
    value[blank] = 0
    total = np.add.reduceat(value, start)
    return mixed(total + (end - start).astype(np.uint64) * STEPS[0])


def shingles(text: str | None, n: int) -> np.ndarray:
    """The distinct n-word shingles, sorted by hash."""
    words = word_hashes(text) if text else np.empty(0, np.uint64)
    if not len(words):
        return words
    wide = min(n, len(words))
    total = np.full(len(words) - wide + 1, wide, np.uint64)
    for i in range(wide):
        total = mixed(total * PRIME + words[i : len(words) - wide + 1 + i])
    return np.unique(total)


def set_id(found: np.ndarray) -> int:
    """64 bits of a whole set, as a signed number."""
    a = np.add.reduce(mixed(found ^ STEPS[1]), keepdims=True)
    b = np.bitwise_xor.reduce(mixed(found + STEPS[2]), keepdims=True)
    return int(mixed(a * PRIME + b + np.uint64(len(found))).view(np.int64)[0])


def sets(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc_id, n_shingles, sid`` of every row; sid is null for an empty set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, s.words) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array([len(f) for f in found], pa.int64()),
                    pa.array([set_id(f) if len(f) else None for f in found], pa.int64()),
                ],
                names=["doc_id", "n_shingles", "sid"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(
        run, f"doc_id {kind}, n_shingles long, sid long"
    )


def with_sets(docs: DataFrame, s: Settings) -> DataFrame:
    """``doc, sid``: every row as a struct, so its columns may have any names, and its set."""
    at = docs.columns.index("text")
    name = "sid"
    while name in {c.lower() for c in docs.columns}:
        name += "_"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingles(t, s.words) for t in b.column(at).to_pylist()]
            ids = pa.array([set_id(f) if len(f) else None for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns, ids], names=[*b.schema.names, name])

    marked = docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))
    return marked.select(F.struct(*docs.columns).alias("doc"), F.col(name).alias("sid"))


def dealt(sid: np.ndarray, size: np.ndarray, count: np.ndarray, value: np.ndarray, parts: int) -> Iterator[tuple]:
    """Entries of many sets dealt by their value: (part, sids, sizes, counts, values)."""
    part = (value % np.uint64(parts)).astype(np.int32)
    owner = np.repeat(np.arange(len(sid)), count)
    order = np.argsort(part, kind="stable")
    edge = np.flatnonzero(np.diff(part[order], prepend=-1))
    for at in np.split(order, edge[1:]):
        who, n = np.unique(owner[at], return_counts=True)
        yield int(part[at[0]]), pack(sid[who], size[who], n.astype(np.uint32), value[at])


def postings(docs: DataFrame, parts: int, s: Settings) -> DataFrame:
    """``part, body``: the shingles of each set, dealt by shingle. A task sends a set once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        sid, held, n = [], [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            size = np.array([len(f) for f in held], np.uint32)
            rows = list(dealt(np.array(sid, np.int64), size, size, np.concatenate(held), parts))
            for at in range(0, len(rows), 64):
                part, body = zip(*rows[at : at + 64], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(body, pa.binary())], names=["part", "body"])

        for b in batches:
            for t in b.column(0).to_pylist():
                found = shingles(t, s.words)
                if not len(found) or (key := set_id(found)) in sent:
                    continue
                sent.add(key)
                sid.append(key)
                held.append(found)
                n += len(found)
                if n >= s.chunk_shingles:
                    yield from flush()
                    sid, held, n = [], [], 0
        if held:
            yield from flush()

    return docs.select(F.col("text").cast("string")).mapInArrow(run, "part int, body binary")


def shared(found: DataFrame, parts: int) -> DataFrame:
    """``part, body`` dealt by set: per set its size, and the shingles that other sets have too
    with the number of sets that have them."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        sid, size, value = [], [], []
        for body in group["body"]:
            who, n, count, hashes = unpack(body)
            sid.append(np.repeat(who, count))
            size.append(np.repeat(n, count))
            value.append(hashes)
        sid, size, value = np.concatenate(sid), np.concatenate(size), np.concatenate(value)
        order = np.argsort(value)
        same = value[order][1:] == value[order][:-1]
        often = order[np.append(same, False) | np.append(False, same)]
        order = often[np.lexsort((sid[often], value[often]))]
        sid, size, value = sid[order], size[order], value[order]
        new = np.ones(len(order), bool)
        new[1:] = (value[1:] != value[:-1]) | (sid[1:] != sid[:-1])
        sid, size, value = sid[new], size[new], value[new]
        _, which, df = np.unique(value, return_inverse=True, return_counts=True)
        df = df[which].astype(np.uint32)
        more = df > 1
        sid, size, value, df = sid[more], size[more], value[more], df[more]
        to = (sid.view(np.uint64) % np.uint64(parts)).astype(np.int32)
        order = np.lexsort((sid, to))
        rows = []
        for at in np.split(order, np.flatnonzero(np.diff(to[order], prepend=-1))[1:]):
            if len(at):
                who, first, n = np.unique(sid[at], return_index=True, return_counts=True)
                rows.append((int(to[at[0]]), pack(who, size[at][first], n.astype(np.uint32), value[at], df[at])))
        return pd.DataFrame(rows, columns=["part", "body"])

    return found.groupBy("part").applyInPandas(run, "part int, body binary")


CANDIDATE = "sid long, size long, kept long, body binary, prefix array<long>"


def prefix_length(n: np.ndarray | int, percent: int):
    """Of two sets that are similar enough, the first so many elements of each have one in common."""
    return n - (n * percent + 99) // 100 + 1


def candidates(replies: DataFrame, s: Settings) -> DataFrame:
    """Per set with enough shared shingles: these in global order, and those of its prefix."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        parts = [unpack(b) for b in group["body"]]
        count = [p[2] for p in parts]
        sid = np.concatenate([np.repeat(p[0], c) for p, c in zip(parts, count, strict=True)])
        size = np.concatenate([np.repeat(p[1], c) for p, c in zip(parts, count, strict=True)]).astype(np.int64)
        value, df = np.concatenate([p[3] for p in parts]), np.concatenate([p[4] for p in parts])
        order = np.lexsort((value, df, sid))
        sid, size, value, df = sid[order], size[order], value[order], df[order]
        rows = []
        first = np.flatnonzero(np.append(True, sid[1:] != sid[:-1]))
        for a, b in zip(first, np.append(first[1:], len(sid)), strict=True):
            n, kept = int(size[a]), int(b - a)
            if 100 * kept < s.percent * n:
                continue
            lead = prefix_length(n, s.percent) - (n - kept)
            rows.append((int(sid[a]), n, kept, pack(df[a:b], value[a:b]), value[a : a + lead].view(np.int64)))
        return pd.DataFrame(rows, columns=["sid", "size", "kept", "body", "prefix"])

    return replies.groupBy("part").applyInPandas(run, CANDIDATE)


class Trie:
    """Ordered sets as a compressed trie, in flat arrays.

    Rows are sorted by their sequences; a node covers rows [low, high) and the stretch
    [begin, end) of their common sequence. ``leaves`` are nodes of one row.
    """

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        order = sorted(range(len(sequences)), key=lambda i: sequences[i].astype(">u4").tobytes())
        self.rows = np.array(order, np.int64)
        self.seq = [sequences[i] for i in order]
        self.size = sizes[self.rows]
        self.length = np.array([len(x) for x in self.seq], np.int64)
        self.start = np.append(0, np.cumsum(self.length))[:-1]
        self.flat = np.concatenate(self.seq) if self.seq else np.empty(0, np.uint32)
        self.children: dict[tuple[int, int], tuple] = {}
        common = [0] * (len(order) + 1)
        for i in range(1, len(order)):
            a, b = self.seq[i - 1], self.seq[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            common[i] = int(differ[0]) if len(differ) else n
        self.common = np.array(common, np.int64)

    def split(self, low: int, high: int, begin: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
        """Children of the node that covers [low, high) and ends at ``begin``: its leaves, and
        (low, high, end) of the others."""
        known = self.children.get((low, begin))
        if known is None:
            cut = low + 1 + np.flatnonzero(self.common[low + 1 : high] <= begin)
            ends = np.concatenate(([low], cut, [high]))
            one = np.diff(ends) == 1
            wide = [
                (int(a), int(b), int(self.common[a + 1 : b].min()))
                for a, b in zip(ends[:-1][~one], ends[1:][~one], strict=True)
            ]
            known = self.children[low, begin] = (ends[:-1][one], wide)
        return known


class Joiner:
    """Links of sets to the sets of a trie, with the groups known so far."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray, ranks: int, s: Settings):
        self.s, self.sequences, self.sizes = s, sequences, sizes
        self.group = np.arange(len(sequences))
        self.members = {i: [i] for i in range(len(sequences))}
        self.weight = np.ones(len(sequences), np.int64)
        self.links = np.zeros(len(sequences), np.int64)
        self.mark = np.zeros(ranks + 1, bool)

    def needed(self, mine: int, other):
        """Overlap from which on sets of these sizes are similar enough."""
        p = self.s.percent
        return -(-(p * (mine + other)) // (100 + p))

    def link(self, x: int, y: int) -> None:
        if self.s.count_links:
            self.links[x] += self.weight[y]
            self.links[y] += self.weight[x]
        a, b = self.group[x], self.group[y]
        if a != b:
            if len(self.members[a]) < len(self.members[b]):
                a, b = b, a
            self.group[self.members[b]] = a
            self.members[a] += self.members.pop(b)

    def join(self, trie_of: np.ndarray, asking: np.ndarray, both_ways: bool) -> None:
        """Link each asking set with the sets of the trie; with ``both_ways`` the trie holds the
        asking sets themselves and a pair is looked at from its later row only."""
        trie = Trie([self.sequences[i] for i in trie_of], self.sizes[trie_of])
        name = trie_of[trie.rows]
        row_of = {int(i): r for r, i in enumerate(name)} if both_ways else {}
        for x in asking.tolist():
            sequence = self.sequences[x]
            self.mark[sequence] = True
            self.walk(trie, name, x, sequence, row_of.get(x, len(name)))
            self.mark[sequence] = False

    def walk(self, trie: Trie, name: np.ndarray, x: int, sequence: np.ndarray, below: int) -> None:
        mine, left_all = int(self.sizes[x]), len(sequence)
        # (rows, depth reached, overlap so far, elements of x that may still come)
        todo = [(0, len(trie.rows), 0, 0, left_all)]
        while todo:
            low, high, depth, overlap, left = todo.pop()
            single, wide = trie.split(low, high, depth)
            for a, b, end in wide:
                if a >= below or not self.s.count_links and (self.group[name[a:b]] == self.group[x]).all():
                    continue
                part = trie.flat[trie.start[a] + depth : trie.start[a] + end]
                got = overlap + int(self.mark[part].sum())
                rest = left_all - int(np.searchsorted(sequence, part[-1], "right")) if len(part) else left
                most = got + min(rest, int(trie.length[a:b].max()) - end)
                if most >= self.needed(mine, int(trie.size[a:b].min())):
                    todo.append((a, b, end, got, rest))
            self.visit(trie, name, x, single[: np.searchsorted(single, below)], depth, overlap, left)

    def visit(self, trie: Trie, name: np.ndarray, x: int, rows: np.ndarray, depth: int, overlap: int, left: int) -> None:
        """The leaves below one node at once: a short look at each, then all of what is left."""
        if not len(rows):
            return
        if not self.s.count_links:
            rows = rows[self.group[name[rows]] != self.group[x]]
        need = self.needed(int(self.sizes[x]), trie.size[rows])
        rest = trie.length[rows] - depth
        fits = overlap + np.minimum(rest, left) >= need
        rows, need, rest = rows[fits], need[fits], rest[fits]
        got = np.full(len(rows), overlap, np.int64)
        at = trie.start[rows] + depth
        for look in (16, None):
            if not len(rows):
                return
            count = rest if look is None else np.minimum(rest, look)
            got = got + self.counted(trie, at, count)
            at, rest = at + count, rest - count
            fits = got + rest >= need
            rows, need, rest, got, at = rows[fits], need[fits], rest[fits], got[fits], at[fits]
        for r in rows.tolist():
            self.link(x, int(name[r]))

    def counted(self, trie: Trie, at: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Elements of the marked set in stretches of the flat array."""
        total = int(count.sum())
        if not total:
            return np.zeros(len(at), np.int64)
        before = np.cumsum(count) - count
        where = np.arange(total) + np.repeat(at - before, count)
        hit = np.append(0, np.cumsum(self.mark[trie.flat[where]]))
        return hit[before + count] - hit[before]


def joined(group: pd.DataFrame, s: Settings) -> pd.DataFrame:
    """Links within one task: ``sid, root, links``."""
    out = []
    for _, part in group.groupby("part_root", sort=True):
        part = part.sort_values(["size", "sid"]).reset_index(drop=True)
        bodies = [unpack(b) for b in part["body"]]
        # Elements are renumbered by the global order of (number of sets, hash).
        key = np.concatenate([np.rec.fromarrays(b, names="df,hash") for b in bodies])
        unique, rank = np.unique(key, return_inverse=True)
        ends = np.cumsum(part["kept"].to_numpy())
        sequences = np.split(rank.astype(np.uint32), ends[:-1])
        join = Joiner(sequences, part["size"].to_numpy(np.int64), len(unique), s)
        join.weight = part["weight"].to_numpy(np.int64)
        side = part["side"].to_numpy()
        mine, other = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        if part["i"].iloc[0] == part["j"].iloc[0]:
            join.join(mine, mine, True)
        elif len(mine) and len(other):
            join.join(mine, other, False)
        sid = part["sid"].to_numpy(np.int64)
        out.append(pd.DataFrame({"sid": sid, "root": sid[join.group], "links": join.links}))
    return pd.concat(out, ignore_index=True)


def tasks_of(found: DataFrame, parts: DataFrame, classes: DataFrame, s: Settings) -> DataFrame:
    """Candidates with the tasks they go to: ``task_key, i, j, side`` and ``part_root``.

    Small connected parts share tasks. A larger part is cut into blocks; block i meets block j >= i.
    """
    placed = found.join(parts.select(F.col("node").alias("sid"), F.col("root").alias("part_root")), "sid")
    weight = classes.select("sid", F.col("n_docs").alias("weight"))
    placed = placed.join(weight, "sid")
    size = placed.groupBy("part_root").agg(F.sum("kept").alias("_elements"))
    total = size.agg(F.sum("_elements")).first()[0] or 0
    buckets = pieces(total, s.task_elements / 4, 16)
    blocks = F.ceil(F.col("_elements") / s.task_elements).cast("int")
    placed = placed.join(size.withColumn("_blocks", blocks), "part_root")
    own = F.pmod(F.xxhash64("sid"), F.col("_blocks")).cast("int")
    others = F.transform(
        F.sequence(F.lit(0), F.col("_blocks") - 1),
        lambda k: F.struct(
            F.least(own, k).alias("i"), F.greatest(own, k).alias("j"), (own > k).cast("int").alias("side")
        ),
    )
    return placed.withColumn("_to", F.explode(others)).select(
        "sid", "size", "kept", "body", "part_root", "weight",
        F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("part_root"), F.lit(buckets))).otherwise(F.col("part_root")).alias("task"),
        "_blocks", F.col("_to.i").alias("i"), F.col("_to.j").alias("j"), F.col("_to.side").alias("side"),
    )


def class_components(docs: DataFrame, rows: DataFrame, s: Settings) -> DataFrame:
    """``sid, first, n_docs, root, component_id, links`` of every class of ``rows``."""
    parts = pieces(text_size(docs), s.chars_per_part, 16)
    classes = written(
        rows.where(F.col("sid").isNotNull()).groupBy("sid").agg(
            F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_docs")
        ),
        "classes",
    )
    replies = shared(postings(docs, parts, s), parts)
    found = written(candidates(replies, s), "candidates")
    lead = found.select("sid", F.explode("prefix").alias("h"))
    least = lead.groupBy("h").agg(F.min("sid").alias("b"), F.count(F.lit(1)).alias("n")).where("n > 1")
    near = lead.join(least.select("h", "b"), "h").where("sid <> b").select(F.col("sid").alias("a"), "b").distinct()
    dealt_out = tasks_of(found, components(near), classes, s)
    linked = dealt_out.groupBy("task", "_blocks", "i", "j").applyInPandas(
        lambda g: joined(g, s), "sid long, root long, links long"
    )
    linked = written(linked, "links")
    edges = linked.where("sid <> root").select(F.col("sid").alias("a"), F.col("root").alias("b"))
    grouped = components(edges)
    of_class = classes.join(grouped.withColumnRenamed("node", "sid"), "sid", "left")
    of_class = of_class.withColumn("root", F.coalesce("root", "sid"))
    least_id = of_class.groupBy("root").agg(F.min("first").alias("component_id"))
    counts = linked.groupBy("sid").agg(F.sum("links").alias("_links"))
    return of_class.join(least_id, "root").join(counts, "sid", "left").select(
        "sid", "first", "n_docs", "root", "component_id",
        (F.coalesce("_links", F.lit(0)) + F.col("n_docs") - 1).alias("links"),
    )


def jaccard_join(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """``doc_id, n_shingles, component_id`` of every row, and with ``count_links`` its ``links``."""
    rows = written(sets(docs, s), "sets")
    found = class_components(docs, rows, s).select("sid", "component_id", "links")
    out = rows.join(found, "sid", "left").select(
        "doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"),
        F.coalesce("links", F.lit(0)).alias("links"),
    )
    return out if s.count_links else out.drop("links")


def one_of_each(docs: DataFrame, s: Settings = Settings()) -> DataFrame:
    """The rows of ``docs`` without near duplicates, columns as they were: of each component the
    row with the smallest doc_id. Texts without words all stay."""
    marked = with_sets(docs, s)
    rows = written(marked.select("doc.doc_id", "sid"), "sets")
    found = class_components(docs, rows, s)
    best = Window.partitionBy("root").orderBy(F.col("first").asc_nulls_last(), "sid")
    kept = found.withColumn("_n", F.row_number().over(best)).where("_n = 1").select(
        F.col("sid").alias("kept"), F.col("first").alias("kept_id")
    )
    repeated = rows.where("sid is not null").groupBy("doc_id", "sid").count().where("count > 1")
    again = repeated.limit(1).count() > 0
    on = (F.col("sid") == F.col("kept")) & F.col("doc.doc_id").eqNullSafe(F.col("kept_id"))
    out = marked.join(kept, on, "left").where(F.col("kept").isNotNull() | F.col("sid").isNull())
    if again:
        out = out.withColumn("doc_id", F.col("doc.doc_id"))
        own = out.where("sid is not null").dropDuplicates(["sid", "doc_id"])
        out = own.unionByName(out.where("sid is null"))
    return out.select("doc.*")


def op2_ngram_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs)


OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(
           translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents
), s AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) END) AS sh
  FROM d
), n AS MATERIALIZED (SELECT doc_id, len(sh)::BIGINT AS n FROM s),
e AS MATERIALIZED (SELECT doc_id, unnest(sh) AS h FROM s),
p AS MATERIALIZED (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o
  FROM e a JOIN e b ON a.h = b.h AND a.doc_id <> b.doc_id GROUP BY ALL
), l AS MATERIALIZED (
  SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y
  WHERE 100 * o >= 80 * (a.n + b.n - o)
), r AS (
  SELECT doc_id, doc_id AS reach FROM n
  UNION
  SELECT r.doc_id, l.y FROM r JOIN l ON l.x = r.reach
)
SELECT n.doc_id, n.n AS n_shingles, min(r.reach) AS component_id
FROM n JOIN r USING (doc_id) GROUP BY ALL
"""
