"""Language-model scores: a hierarchical Pitman-Yor model of words in the context of the word before.

Every context is a restaurant whose customers are the words that follow it and whose dishes are
words; its tables send customers to the one restaurant that all contexts share as parent, which in
turn draws from all words alike. Seatings are sampled by Gibbs moves that take a customer from its table
and seat it anew. Scores average the predictive probability over several sampled seatings.

How it is laid out:

1. Documents are encoded in chunks, and each chunk asks for the training counts of its words and word
   pairs. Requests and answers are packed arrays, dealt by a hash of the word or pair, so a
   frequent word or pair is counted within each chunk before anything moves.
2. A pair seen once sits alone at its table, whatever happens; it enters as a number in its
   context and its word. Only pairs seen more often have a seating to sample. They are dealt by
   context (a very frequent context is split by its words, each part standing for the whole in
   proportion), given the parent's probabilities; then the parent is seated given their tables.
3. Chunks ask for tables and probabilities the way they asked for counts, and score their documents.

Words are told apart by 64 bits, pairs by 48 bits within a part.

Definitions: a null text is empty; every text ends with one end token, which also opens the next
context. Unknown words share the mass of one more word. Repeated rows count and score each for
themselves. Without any training document all words are unknown.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from polynya.llm.base import crc_mod, forget, pack, pieces, text_size, unpack, written

END = 0x9E3779B97F4A7C15
K1, K2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
LOW48 = np.uint64((1 << 48) - 1)


@dataclass(frozen=True)
class Settings:
    discount: float = 0.8
    strength: float = 1.0
    root_discount: float = 0.6
    root_strength: float = 1.0
    burn: int = 3
    samples: int = 2
    draws: int = 4
    rounds: int = 2
    chunk_tokens: int = 750_000
    chars_per_part: int = 12_000_000
    context_tokens: int = 2_000_000
    seed: int = 5


def squeeze(body: bytes) -> bytes:
    return zstandard.compress(body, 1)


def loosen(body: bytes) -> list[np.ndarray]:
    return unpack(zstandard.decompress(body))


class Codes(dict):
    """Numbers words in the order they come; 0 is the end."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def encode(docs: DataFrame, learn, s: Settings) -> DataFrame:
    """``chunk, doc_id (list), body``: tokens of some documents as codes, with the hashes of the words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk = TaskContext.get().partitionId() << 24
        ids, train, tokens, ends, n, codes = [], [], [], [], 0, Codes()

        def flush() -> pa.RecordBatch:
            # Bytes of equal rank lie together, which squeezes better.
            hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in codes), np.uint64, len(codes))
            body = pack(
                *np.concatenate(tokens).view(np.uint8).reshape(-1, 4).T, np.array(ends, np.int64), np.array(train, bool),
                np.append(np.uint64(END), hashes),
            )
            return pa.RecordBatch.from_arrays(
                [pa.array([chunk], pa.int64()), pa.array([ids], pa.list_(id_type)), pa.array([squeeze(body)], pa.binary())],
                names=["chunk", "doc_id", "body"],
            )

        id_type = None
        for b in batches:
            id_type = b.schema.field("doc_id").type
            for doc_id, learns, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                found = list(map(codes.__getitem__, (text or "").encode("utf-8", "replace").lower().split()))
                found.append(0)
                tokens.append(np.array(found, np.int32))
                n += len(found)
                ids.append(doc_id)
                train.append(bool(learns))
                ends.append(n)
                if n >= s.chunk_tokens:
                    yield flush()
                    chunk += 1
                    ids, train, tokens, ends, n, codes = [], [], [], [], 0, Codes()
        if ids:
            yield flush()

    kind = docs.schema["doc_id"].dataType
    schema = T.StructType([
        T.StructField("chunk", T.LongType()), T.StructField("doc_id", T.ArrayType(kind)),
        T.StructField("body", T.BinaryType()),
    ])
    return docs.select("doc_id", learn.alias("learn"), F.col("text").cast("string")).mapInArrow(run, schema)


class Chunk:
    """A decoded chunk: tokens, their pairs, and where each document lies."""

    def __init__(self, body: bytes, parts: int):
        *planes, self.ends, train, self.hashes = loosen(body)
        self.code = np.stack(planes, 1).view(np.int32).ravel()
        starts = np.append(0, self.ends[:-1])
        before = np.append(0, self.code[:-1]).astype(np.int64)
        before[starts] = 0
        self.pair, self.which = np.unique(before * len(self.hashes) + self.code, return_inverse=True)
        self.starts = starts
        self.learn = np.repeat(train.astype(bool), np.diff(self.ends, prepend=0))
        self.first, self.second = np.divmod(self.pair, len(self.hashes))
        place, self.pair_key = pair_place(self.hashes[self.first], self.hashes[self.second], np.uint64(parts))
        self.word_at = dict(by_part((self.hashes % np.uint64(parts)).astype(np.int32), self.hashes))
        self.pair_at = dict(by_part(place, self.pair_key))


def pair_place(first: np.ndarray, second: np.ndarray, parts: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Part of a pair, and the 48 bits that name it there."""
    x = first * K1 + (second ^ (second >> np.uint64(29))) * K2
    x = (x ^ (x >> np.uint64(32))) * K1
    x ^= x >> np.uint64(31)
    return (x % parts).astype(np.int32), (x >> np.uint64(16)) & LOW48


def by_part(part: np.ndarray, key: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each part, in ascending order of the keys when these are given."""
    order = np.arange(len(part)) if key is None else np.argsort(key)
    order = order[np.argsort(slim(part[order]), kind="stable")]
    for at in np.split(order, np.flatnonzero(np.diff(part[order], prepend=-1))[1:]):
        if len(at):
            yield int(part[at[0]]), at


def slim(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def steps(ids: np.ndarray) -> np.ndarray:
    """Ascending numbers as their differences."""
    return slim(np.diff(ids, prepend=0))


def halves(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (key >> np.uint64(32)).astype(np.uint16), key.astype(np.uint32)


def whole(high: np.ndarray, low: np.ndarray) -> np.ndarray:
    return (high.astype(np.uint64) << np.uint64(32)) | low


ASK = "part int, chunk long, body binary"


def ask_counts(corpus: DataFrame, parts: int) -> DataFrame:
    """Words and pairs of each chunk with their training counts there, dealt by key."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number, body in zip(frame["chunk"], frame["body"], strict=True):
                c = Chunk(body, parts)
                words = np.bincount(c.code[c.learn], minlength=len(c.hashes)).astype(np.uint32)
                pairs = np.bincount(c.which[c.learn], minlength=len(c.pair)).astype(np.uint32)
                rows = []
                for part in sorted(c.word_at.keys() | c.pair_at.keys()):
                    w, p = c.word_at.get(part, NONE), c.pair_at.get(part, NONE)
                    asked = pack(c.hashes[w], slim(words[w]), *halves(c.pair_key[p]), slim(pairs[p]))
                    rows.append((part, number, asked))
                yield pd.DataFrame(rows, columns=["part", "chunk", "body"])

    return corpus.select("chunk", "body").mapInPandas(run, ASK)


NONE = np.empty(0, np.int64)


def totals(keys: np.ndarray, counts: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per key asked: its total count, whether this place owns it (one place of each key does),
    and its number among the keys, in order, whose total is at least ``least``."""
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.append(True, ordered[1:] != ordered[:-1])[: len(keys)]
    lead = np.flatnonzero(new)
    which = np.empty(len(keys), np.int64)
    which[order] = np.cumsum(new) - 1
    total = np.bincount(which, counts, len(lead)).astype(np.int64)
    owns = np.zeros(len(keys), bool)
    owns[order[lead]] = True
    return total[which], owns, (np.cumsum(total >= least) - 1)[which]


def answer_counts(asks: DataFrame) -> DataFrame:
    """``chunk, part, body``: totals in the order of the request; of each key, who owns it; and the
    numbers of the words that occur and of the pairs that occur more than once."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("chunk")
        bodies = [unpack(b) for b in group["body"]]
        words = totals(np.concatenate([b[0] for b in bodies]), np.concatenate([b[1] for b in bodies]), 1)
        pairs = totals(
            np.concatenate([whole(b[2], b[3]) for b in bodies]), np.concatenate([b[4] for b in bodies]), 2
        )
        rows, at, to = [], 0, 0
        for chunk, part, b in zip(group["chunk"], group["part"], bodies, strict=True):
            told = []
            for (total, owns, number), here, least in (
                (words, slice(at, at + len(b[0])), 1), (pairs, slice(to, to + len(b[2])), 2)
            ):
                told += [slim(total[here]), owns[here], steps(number[here][total[here] >= least])]
            rows.append((chunk, part, squeeze(pack(*told))))
            at, to = at + len(b[0]), to + len(b[2])
        return pd.DataFrame(rows, columns=["chunk", "part", "body"])

    return asks.groupBy("part").applyInPandas(run, "chunk long, part int, body binary")


class Counted:
    """Answers put back into the order of the chunk: of its words and its pairs the total counts,
    whether the chunk owns them, and their numbers (-1 without one)."""

    def __init__(self, c: Chunk, answers: pd.DataFrame):
        self.words, self.pairs = np.zeros(len(c.hashes), np.int64), np.zeros(len(c.pair), np.int64)
        self.owns, self.owned = np.zeros(len(c.hashes), bool), np.zeros(len(c.pair), bool)
        self.word_id, self.pair_id = np.full(len(c.hashes), -1), np.full(len(c.pair), -1)
        for part, body in zip(answers["part"], answers["body"], strict=True):
            told = loosen(body)
            for at, total, own, number, least, (count, mine, step) in (
                (c.word_at.get(part, NONE), self.words, self.owns, self.word_id, 1, told[:3]),
                (c.pair_at.get(part, NONE), self.pairs, self.owned, self.pair_id, 2, told[3:]),
            ):
                total[at], own[at] = count, mine
                number[at[total[at] >= least]] = np.cumsum(step, dtype=np.int64)


FACT = (
    "pair boolean, first long, second long, n int, alone int, follows int, heads int, more int, id int"
)


def facts(corpus: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Rows of the model, each from the chunk that owns it.

    ``pair``: first and second word and count of a pair seen more than once, and (``alone``) the
    count of its first word. ``word``: a word, its count, and of the pairs that the chunk owns, in how many seen
    once it is the first (``alone``) and the second (``follows``), and in how many seen more often
    (``heads``, ``more``).
    """

    def run(corpus_rows: pd.DataFrame, answer_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, body in zip(corpus_rows["chunk"], corpus_rows["body"], strict=True):
            c = Chunk(body, parts)
            got = Counted(c, answer_rows[answer_rows["chunk"] == number])
            words, owns, pairs, owned = got.words, got.owns, got.pairs, got.owned
            single, many = owned & (pairs == 1), owned & (pairs > 1)
            roles = {
                name: np.bincount(side[which], minlength=len(words))
                for name, side, which in (
                    ("alone", c.first, single), ("follows", c.second, single), ("heads", c.first, many), ("more", c.second, many)
                )
            }
            tell = np.logical_or.reduce([owns & (words > 0), *(r > 0 for r in roles.values())])
            names = c.hashes.view(np.int64)
            out.append(pd.DataFrame({
                "pair": False, "first": names[tell], "second": 0, "n": words[tell],
                **{name: r[tell] for name, r in roles.items()}, "id": got.word_id[tell],
            }))
            out.append(pd.DataFrame({
                "pair": True, "first": names[c.first[many]], "second": names[c.second[many]], "n": pairs[many],
                "alone": words[c.first[many]], "follows": 0, "heads": 0, "more": 0,
                "id": got.pair_id[many],
            }))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame(columns=FACT_NAMES)

    left = corpus.select("chunk", "body").groupBy("chunk")
    return left.cogroup(answers.groupBy("chunk")).applyInPandas(run, FACT)


FACT_NAMES = [f.split()[0] for f in FACT.split(", ")]


def seat_root(customers: np.ndarray, base: float, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of the parent for each dish: its customers come in one after the other.

    ``base`` is the weight of a new table. Beyond the first customers they come in growing
    groups, within which the chance of a new table is that of the group's first.
    """
    tables = np.minimum(customers, 1).astype(np.int64)
    seated = tables.copy()
    while True:
        more = np.flatnonzero(seated < customers)
        if not len(more):
            return tables
        come = np.minimum(np.maximum(1, seated[more] // 32), customers[more] - seated[more])
        chance = base / (base + np.maximum(seated[more] - discount * tables[more], 1e-9))
        tables[more] += rng.binomial(come, chance)
        seated[more] += come


def singles_and_more(rate: np.ndarray, tilt: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """Tables and customers of each row when tables of size k come at the Poisson rate of
    ``rate * (1-d)(2-d)...(k-1-d) / k! * tilt ** k``."""
    came = rng.poisson(rate * tilt / d)
    ends = np.cumsum(came)
    tables, customers = np.zeros(len(rate), np.int64), np.zeros(len(rate))
    for at in range(0, int(came.sum()), 1 << 20):
        row = np.searchsorted(ends, np.arange(at, min(at + (1 << 20), int(ends[-1]))), "right")
        # Sizes of Sibuya's law, thinned to the tilted one.
        size = rng.geometric(np.maximum(rng.beta(d, 1 - d, len(row)), 1e-15)).astype(float)
        kept = rng.random(len(row)) < np.exp((size - 1) * np.log(tilt[row]))
        tables += np.bincount(row[kept], minlength=len(rate))
        customers += np.bincount(row[kept], size[kept], len(rate))
    return tables, customers


def seat_many(
    count: np.ndarray, marked: np.ndarray, tables: np.ndarray, new: np.ndarray, s: Settings, rng: np.random.Generator
) -> None:
    """Seat all customers of each dish anew, in place, given the weight ``new`` of every table.

    ``marked`` is the size of the first customer's table. The other tables are proposed all at
    once, as tables that come independently, and taken by the chance of the size they leave to
    the first one (Metropolis): the law of the tables is that of single moves without end,
    whatever the count.
    """
    d = s.discount
    # Tilt under which the proposed tables hold about as many customers as there are.
    low, high = np.full(len(count), -60.0), np.full(len(count), -1e-9)
    for _ in range(40):
        mid = (low + high) / 2
        over = np.log(new) + np.log(-np.expm1(mid)) - (1 - d) * mid > np.log(count)
        low, high = np.where(over, mid, low), np.where(over, high, mid)
    tilt = np.maximum(-np.expm1(high), 1e-12)

    def weight(size: np.ndarray) -> np.ndarray:
        # log of gamma(size - d) / gamma(size) * tilt ** size
        def far(z: np.ndarray) -> np.ndarray:
            return (z - 0.5) * np.log(z) - z + 1 / (12 * z)

        near = sum(np.log((size + i) / (size + i - d)) for i in range(8))
        return near + far(size + 8 - d) - far(size + 8) + size * np.log(tilt)

    for _ in range(s.draws):
        others, held = singles_and_more(new, tilt, d, rng)
        left = count - held
        take = left >= 1
        take[take] = np.log(rng.random(int(take.sum()))) < (weight(np.maximum(left, 1)) - weight(marked))[take]
        tables[take] = others[take] + 1
        marked[take] = left[take]


def gibbs(
    count: np.ndarray, context: np.ndarray, prior: np.ndarray, others: np.ndarray, stretch: np.ndarray,
    s: Settings, rng: np.random.Generator,
) -> list[np.ndarray]:
    """Sampled table counts of (context, dish) pairs, one array per kept sweep.

    ``prior``: the parent's probability of the dish; ``others``: tables of the context's pairs seen
    once; ``stretch``: how many parts like this one the context was split into. All customers of
    a dish first share a table. A move takes a customer at random from its table and seats it at an
    occupied table with weight size - discount, or at a new one with weight (strength +
    discount * tables of the context) * prior; a sweep makes as many moves as a pair has
    customers. From 16 customers on they are seated anew together (``seat_many``).
    """
    d, theta = s.discount, s.strength
    tables = np.ones(len(count), np.int64)
    in_context = others + np.bincount(context, minlength=len(others)) * stretch
    blocks = []
    two = np.flatnonzero(count == 2)
    for low, high in ((3, 4), (4, 8), (8, 16)):
        rows = np.flatnonzero((count >= low) & (count < high))
        if len(rows):
            rows = rows[np.argsort(-count[rows], kind="stable")]
            sizes = np.zeros((len(rows), high - 1), np.int32)
            sizes[:, 0] = count[rows]
            blocks.append((rows, sizes))
    many = np.flatnonzero(count >= 16)
    marked = count[many].astype(float)
    kept = []
    for sweep in range(s.burn + s.samples):
        # Two customers of a dish are seated anew together: at two tables or at one.
        of, were = context[two], tables[two]
        apart = (theta + d * (in_context[of] - (were - 1) * stretch[of])) * prior[two]
        now = 1 + (rng.random(len(two)) * (apart + 1 - d) < apart)
        tables[two] = now
        in_context = in_context + np.bincount(of, now - were, len(others)) * stretch
        for block in blocks:
            rows, sizes = block
            for move in range(int(count[rows[0]])):
                k = int(np.searchsorted(-count[rows], -move, "left")) if move else len(rows)
                own, who = sizes[:k], np.arange(k)
                at = (np.cumsum(own, 1) <= (rng.random(k) * count[rows[:k]])[:, None]).sum(1)
                own[who, at] -= 1
                left = own[who, at] == 0
                weight = np.where(own > 0, own - np.float32(d), np.float32(0))
                filled = np.cumsum(weight, 1, dtype=np.float64)
                of = context[rows[:k]]
                new = (theta + d * (in_context[of] - left * stretch[of])) * prior[rows[:k]]
                pick = rng.random(k) * (filled[:, -1] + new)
                to = (filled <= pick[:, None]).sum(1)
                opens = to >= own.shape[1]
                to = np.where(opens, (own == 0).argmax(1), to)
                own[who, to] += 1
                change = opens.astype(np.int64) - left
                tables[rows[:k]] += change
                moved = np.flatnonzero(change)
                in_context = in_context + np.bincount(of[moved], change[moved], len(others)) * stretch
        if len(many):
            # Given this draw for their context, the weight of a new table is the same for all
            # tables, and dishes do not depend on each other.
            of, were = context[many], tables[many]
            given = rng.gamma(theta / d + in_context)
            now = were.copy()
            seat_many(count[many], marked, now, np.maximum(d * given[of] * prior[many], 1e-12), s, rng)
            tables[many] = now
            in_context = in_context + np.bincount(of, now - were, len(others)) * stretch
        if sweep >= s.burn:
            kept.append(tables.copy())
    return kept


@dataclass(frozen=True)
class Totals:
    """What is said in a few numbers: training tokens and distinct words."""

    tokens: int
    words: int


def sample_seatings(pairs: DataFrame, words: DataFrame, total: Totals, s: Settings) -> DataFrame:
    """``first, second, id, t0 ...`` of every pair seen more than once: tables in each sample.

    The first round draws with the parent as it stands when every pair has one table, each later one
    with the parent as the tables of the round before leave it.
    """
    types = words.select("first", (F.col("follows") + F.col("more")).alias("customers"))
    for _ in range(s.rounds - 1):
        drawn = sample_round(pairs, types, words, total, replace(s, samples=1))
        sent = drawn.groupBy(F.col("second").alias("first")).agg(F.sum("t0").alias("_sent"))
        types = written(
            words.join(sent, "first", "left").select(
                "first", (F.col("follows") + F.coalesce("_sent", F.lit(0))).alias("customers")
            ),
            "customers",
        )
    return sample_round(pairs, types, words, total, s)


def sample_round(pairs: DataFrame, types: DataFrame, words: DataFrame, total: Totals, s: Settings) -> DataFrame:
    """``first, second, id, t0 ...`` given the ``customers`` of each dish at the parent (``types``)."""
    all_types = types.agg(F.sum("customers")).first()[0] or 0
    base = (s.root_strength + s.root_discount * total.words) / (total.words + 1)
    # Tables of a dish at the parent grow with the log of its customers at the weight of a new one.
    expected = 1 + base * F.log(F.greatest(F.col("customers"), F.lit(1)))
    prior = (
        F.greatest(F.col("customers") - s.root_discount * expected, F.lit(0.0)) + base
    ) / (s.root_strength + all_types)
    given = pairs.join(types.select(F.col("first").alias("second"), prior.alias("prior")), "second")
    split = F.greatest(F.ceil(F.col("alone") / s.context_tokens), F.lit(1)).cast("int")
    given = given.select(
        "first", "second", "n", "id", "prior", split.alias("split"),
        F.pmod(F.xxhash64("second"), split).cast("int").alias("salt"),
    )
    last = F.greatest(F.ceil(F.col("n") / s.context_tokens), F.lit(1)).cast("int") - 1
    of_context = words.where("heads > 0").select(
        "first", "alone", F.explode(F.sequence(F.lit(0), last)).alias("salt")
    )
    part = F.pmod(F.xxhash64("first", "salt"), F.lit(pieces(pairs.count(), 400_000, 16))).cast("int")
    names = [f"t{i}" for i in range(s.samples)]
    schema = "first long, second long, id long, " + ", ".join(f"{n} int" for n in names)

    def run(key: tuple, group: pd.DataFrame, contexts: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["first", "salt", "second"]).merge(contexts, on=["first", "salt"])
        new = ((group["first"].diff().fillna(1) != 0) | (group["salt"].diff().fillna(1) != 0)).to_numpy()
        lead = group[new]
        rng = np.random.default_rng([s.seed, int(key[0])])
        drawn = gibbs(
            group["n"].to_numpy(np.int64), np.cumsum(new) - 1, group["prior"].to_numpy(float),
            lead["alone"].to_numpy(np.int64), lead["split"].to_numpy(np.int64), s, rng,
        )
        return group[["first", "second", "id"]].assign(**dict(zip(names, drawn, strict=True)))

    left = given.withColumn("part", part).groupBy("part")
    return left.cogroup(of_context.withColumn("part", part).groupBy("part")).applyInPandas(run, schema)


def seat_parent(words: DataFrame, seated: DataFrame, total: Totals, s: Settings) -> DataFrame:
    """``first, r0 ..., c0 ..., p0 ...`` of every word: in each sample the tables of its context, its
    customers and its tables at the parent."""
    names = range(s.samples)
    into = seated.groupBy(F.col("second").alias("first")).agg(*[F.sum(f"t{i}").alias(f"_c{i}") for i in names])
    out = seated.groupBy("first").agg(*[F.sum(f"t{i}").alias(f"_r{i}") for i in names])
    both = words.join(into, "first", "left").join(out, "first", "left").select(
        "first", "id",
        *[(F.col("alone") + F.coalesce(f"_r{i}", F.lit(0))).cast("long").alias(f"r{i}") for i in names],
        *[(F.col("follows") + F.coalesce(f"_c{i}", F.lit(0))).cast("long").alias(f"c{i}") for i in names],
    )
    base = (s.root_strength + s.root_discount * total.words) / (total.words + 1)
    kinds = ", ".join(["first long", "id long"] + [f"{k}{i} long" for k in "rcp" for i in names])

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in names:
                # Written once by the caller, so every later step sees the same draw.
                order = np.argsort(f["first"].to_numpy(), kind="stable")
                rng = np.random.default_rng([s.seed, i, int(f["first"].min()) & 0x7FFFFFFF])
                drawn = np.empty(len(f), np.int64)
                drawn[order] = seat_root(f[f"c{i}"].to_numpy(np.int64)[order], base, s.root_discount, rng)
                f[f"p{i}"] = drawn
            yield f[["first", "id", *[f"{k}{i}" for k in "rcp" for i in names]]]

    return both.mapInPandas(run, kinds)


def ask_tables(corpus: DataFrame, answers: DataFrame, parts: int) -> DataFrame:
    """Numbers of the words of each chunk that occur, and of its pairs seen more than once."""

    def run(corpus_rows: pd.DataFrame, answer_rows: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for number, body in zip(corpus_rows["chunk"], corpus_rows["body"], strict=True):
            c = Chunk(body, parts)
            got = Counted(c, answer_rows[answer_rows["chunk"] == number])
            for part in sorted(c.word_at.keys() | c.pair_at.keys()):
                w, p = got.word_id[c.word_at.get(part, NONE)], got.pair_id[c.pair_at.get(part, NONE)]
                rows.append((part, number, squeeze(pack(steps(w[w >= 0]), steps(p[p >= 0])))))
        return pd.DataFrame(rows, columns=["part", "chunk", "body"])

    left = corpus.select("chunk", "body").groupBy("chunk")
    return left.cogroup(answers.groupBy("chunk")).applyInPandas(run, ASK)


MODEL = "part int, word boolean, body binary"


def model_rows(seated: DataFrame, parent: DataFrame, parts: int, s: Settings) -> DataFrame:
    """What is known of words (tables of their context, customers and tables at the parent) and of
    pairs (tables), per sample, packed by the part that will be asked for it."""
    names = range(s.samples)
    of_word, of_pair = [f"{k}{i}" for k in "rcp" for i in names], [f"t{i}" for i in names]

    def packed(word: bool, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def flush(f: pd.DataFrame) -> pd.DataFrame:
            first = f["first"].to_numpy(np.int64).view(np.uint64)
            if word:
                part = (first % np.uint64(parts)).astype(np.int32)
            else:
                part, _ = pair_place(first, f["second"].to_numpy(np.int64).view(np.uint64), np.uint64(parts))
            number, values = f["id"].to_numpy(np.int64), f[of_word if word else of_pair].to_numpy(np.int64)
            rows = [
                (p, word, squeeze(pack(steps(number[at]), *map(slim, values[at].T)))) for p, at in by_part(part, number)
            ]
            return pd.DataFrame(rows, columns=["part", "word", "body"])

        held, n = [], 0
        for f in frames:
            held.append(f)
            n += len(f)
            if n >= 400_000:
                yield flush(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield flush(pd.concat(held, ignore_index=True))

    pairs = seated.mapInPandas(lambda frames: packed(False, frames), MODEL)
    return pairs.unionByName(parent.mapInPandas(lambda frames: packed(True, frames), MODEL))


def answer_tables(asks: DataFrame, model: DataFrame, s: Settings) -> DataFrame:
    def run(asked: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        found = {}
        for word, width in ((True, 3 * s.samples), (False, s.samples)):
            bodies = [loosen(b) for b in rows["body"][rows["word"] == word]]
            ids = [np.cumsum(b[0], dtype=np.int64) for b in bodies]
            found[word] = np.zeros((1 + max((int(i.max(initial=-1)) for i in ids), default=-1), width), np.int32)
            for i, b in zip(ids, bodies, strict=True):
                found[word][i] = np.stack(b[1:], 1)
        out = []
        for part, chunk, body in zip(asked["part"], asked["chunk"], asked["body"], strict=True):
            w, p = (np.cumsum(x, dtype=np.int64) for x in loosen(body))
            told = [slim(v) for v in (*found[True][w].T, *found[False][p].T)]
            out.append((chunk, part, squeeze(pack(*told))))
        return pd.DataFrame(out, columns=["chunk", "part", "body"])

    return asks.groupBy("part").cogroup(model.groupBy("part")).applyInPandas(run, "chunk long, part int, body binary")


def score_chunks(corpus: DataFrame, answers: DataFrame, total: Totals, root: list[tuple[int, int]], parts: int, s: Settings) -> DataFrame:
    """``doc_id, n_tokens, n_known, base_score, score`` of every document."""
    kind = corpus.schema["doc_id"].dataType.elementType
    schema = T.StructType([
        T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
        T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType()),
    ])

    def run(corpus_rows: pd.DataFrame, answer_rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for number, ids, body in zip(corpus_rows["chunk"], corpus_rows["doc_id"], corpus_rows["body"], strict=True):
            c = Chunk(body, parts)
            mine = answer_rows[answer_rows["chunk"] == number]
            got = Counted(c, mine[~mine["tables"]])
            words, pairs = got.words, got.pairs
            of_word = np.zeros((3 * s.samples, len(words)))
            of_pair = np.repeat((pairs > 0).astype(float)[None, :], s.samples, 0)
            tables = mine[mine["tables"]]
            for part, given in zip(tables["part"], tables["body"], strict=True):
                told = loosen(given)
                w, p = c.word_at.get(part, NONE), c.pair_at.get(part, NONE)
                w, p = w[got.word_id[w] >= 0], p[got.pair_id[p] >= 0]
                for i, values in enumerate(told[: 3 * s.samples]):
                    of_word[i, w] = values
                for i, values in enumerate(told[3 * s.samples :]):
                    of_pair[i, p] = values
            chance = np.zeros(len(c.pair))
            follow = words[c.first].astype(float)
            for i, (customers, root_tables) in enumerate(root):
                in_context, came, at_root = (of_word[k * s.samples + i] for k in range(3))
                up = (s.root_strength + s.root_discount * root_tables) / (total.words + 1)
                parent = (came - s.root_discount * at_root + up) / (s.root_strength + customers)
                passed = s.strength + s.discount * in_context[c.first]
                given = (pairs - s.discount * of_pair[i] + passed * parent[c.second]) / (s.strength + follow)
                chance += given / len(root)
            base = np.log10((words + 1) / (total.tokens + total.words + 1))
            out.append(pd.DataFrame({
                "doc_id": ids, "n_tokens": np.diff(c.ends, prepend=0),
                "n_known": np.add.reduceat((words > 0)[c.code].astype(np.int64), c.starts),
                "base_score": np.add.reduceat(base[c.code], c.starts),
                "score": np.add.reduceat(np.log10(chance)[c.which], c.starts),
            }))
        return pd.concat(out, ignore_index=True)

    left = corpus.groupBy("chunk")
    return left.cogroup(answers.groupBy("chunk")).applyInPandas(run, schema)


def score(docs: DataFrame, learn, s: Settings = Settings()) -> tuple[DataFrame, Totals]:
    """Scores of all documents under the model of those for which ``learn`` (a column) holds."""
    parts = pieces(text_size(docs), s.chars_per_part, 16)
    corpus = written(encode(docs, learn, s), "encoded")
    answers = written(answer_counts(ask_counts(corpus, parts)), "counts")
    found = written(facts(corpus, answers, parts), "facts")
    pairs = found.where("pair").select("first", "second", "n", "alone", "id")
    words = found.where("not pair").groupBy("first").agg(
        F.max("n").alias("n"), F.max("id").alias("id"), *[F.sum(c).alias(c) for c in ("alone", "follows", "heads", "more")]
    )
    words = written(words, "words")
    sums = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("n") > 0, 1))).first()
    total = Totals(int(sums[0]), int(sums[1]))
    seated = written(sample_seatings(pairs, words, total, s), "seated")
    forget(found)
    parent = written(seat_parent(words, seated, total, s), "parent")
    forget(words)
    sums = parent.agg(*[F.coalesce(F.sum(f"{k}{i}"), F.lit(0)) for i in range(s.samples) for k in "cp"]).first()
    root = [(int(sums[2 * i]), int(sums[2 * i + 1])) for i in range(s.samples)]
    asks = written(ask_tables(corpus, answers, parts), "asks")
    tables = written(answer_tables(asks, model_rows(seated, parent, parts, s), s), "tables")
    forget(seated)
    forget(parent)
    forget(asks)
    both = answers.withColumn("tables", F.lit(False)).unionByName(tables.withColumn("tables", F.lit(True)))
    return score_chunks(corpus, both, total, root, parts, s), total


def op1_pitman_yor(docs: DataFrame) -> DataFrame:
    held = crc_mod(F.col("doc_id"), 7) == 2
    scores, total = score(docs, ~held)
    return scores.select(
        "doc_id", held.alias("held_out"), "n_tokens", "n_known", F.lit(total.tokens).cast("long").alias("train_tokens"),
        "base_score", "score",
    )
