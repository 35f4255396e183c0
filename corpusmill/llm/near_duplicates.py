"""Groups of chunks that share most of their three-word runs.

A chunk's set of word runs is reduced to a code of SEGMENTS x WIDTH symbols,
each a minimum of a random order over the set, so two sets agree in a symbol
with the probability of their similarity. The code is cut into few enough
segments that, at the threshold, one segment differs by at most one symbol;
every segment is indexed once per position with that position left out, an
equality join of these variants gives the candidates, and these are verified
on the sets themselves.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from corpusmill.operators.components import connected_components
from corpusmill.session import materialise, release

RUN = 3
#: Shared runs over all runs of either text, as a fraction, for a link.
THRESHOLD = (3, 5)
SEGMENTS, WIDTH = 20, 5
SYMBOLS = SEGMENTS * WIDTH
#: Buckets up to this size give all their pairs; larger ones a star first.
STAR_FROM = 64
#: Members outside the star's class up to which they meet the whole bucket; more
#: are told apart by a second segment first.
FEW = 64
#: Least equal 2-bit symbols of SYMBOLS for a candidate to be verified: five
#: standard deviations below what similarity 0.6 is expected to have.
LEAST_EQUAL = 47
WORD = re.compile(r"[^\W_]+")
_MUL = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = 4096
_rng = np.random.default_rng(20240229)
_A = _rng.integers(1, 2**63, SYMBOLS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, SYMBOLS, dtype=np.uint64)
_hash_of: dict[str, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    return x * np.uint64(0x94D049BB133111EB)


def word_runs(text: str | None) -> np.ndarray:
    """64-bit hashes of the distinct runs of RUN words, sorted."""
    words = WORD.findall(text.lower()) if text else []
    if len(words) < RUN:
        return np.zeros(0, np.uint64)
    memo = _hash_of
    if len(memo) > 500_000:
        memo.clear()
    codes = []
    for w in words:
        h = memo.get(w)
        if h is None:
            h = memo[w] = xxhash.xxh64_intdigest(w)
        codes.append(h)
    c = np.array(codes, np.uint64)
    with np.errstate(over="ignore"):
        h = c[:-2]
        for k in (1, 2):
            h = _mix(h * _MUL + c[k : len(c) - 2 + k])
    return np.unique(h)


def symbols(runs: np.ndarray) -> np.ndarray:
    """The code: per symbol the least of the runs under its own order."""
    least = np.full(SYMBOLS, np.iinfo(np.uint64).max, np.uint64)
    with np.errstate(over="ignore"):
        for at in range(0, len(runs), _BLOCK):
            block = runs[at : at + _BLOCK, None] * _A + _B
            np.minimum(least, block.min(0), out=least)
        return (_mix(least) >> np.uint64(32)).astype(np.uint32)


def variants(codes: np.ndarray) -> np.ndarray:
    """Keys of all one-wildcard segment variants, (n, SEGMENTS * WIDTH)."""
    n = len(codes)
    s = codes.astype(np.uint64).reshape(n, SEGMENTS, WIDTH)
    out = np.empty((n, SEGMENTS, WIDTH), np.uint64)
    place = np.arange(SEGMENTS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for skip in range(WIDTH):
            key = np.broadcast_to(_mix(place * np.uint64(WIDTH) + np.uint64(skip + 1)), (n, SEGMENTS))
            for k in range(WIDTH):
                if k != skip:
                    key = _mix((key ^ s[:, :, k]) * _MUL)
            out[:, :, skip] = key
    return out.reshape(n, -1)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        runs = [word_runs(t) for t in batch.column(2).to_pylist()]
        keep = [k for k, r in enumerate(runs) if len(r)]
        codes = np.array([symbols(runs[k]) for k in keep], np.uint32).reshape(-1, SYMBOLS)
        with np.errstate(over="ignore"):
            f1 = np.array([runs[k].sum() for k in keep], np.uint64)
            f2 = np.array([_mix(runs[k]).sum() for k in keep], np.uint64)
        two = (codes & 3).astype(np.uint64)
        packed = [
            (two[:, q * 25 : q * 25 + 25] << (np.arange(25, dtype=np.uint64) * np.uint64(2))).sum(
                1, dtype=np.uint64
            )
            for q in range(4)
        ]
        at = pa.array(keep, pa.int32())
        flat = pa.array(codes.reshape(-1).view(np.int32))
        offsets = pa.array(np.arange(len(keep) + 1, dtype=np.int32) * SYMBOLS)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(at),
                batch.column(1).take(at),
                *(pa.array(x.view(np.int64)) for x in (f1, f2)),
                *(pa.array(x.view(np.int64)) for x in packed),
                pa.ListArray.from_arrays(offsets, flat),
            ],
            ["id", "at", "f1", "f2", "q0", "q1", "q2", "q3", "code"],
        )


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    step = 2000
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            codes = batch.column(1).flatten().to_numpy().view(np.uint32).reshape(-1, SYMBOLS)
            keys = variants(codes)
            ids = np.repeat(batch.column(0).to_numpy(), keys.shape[1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys.reshape(-1).view(np.int64)), pa.array(ids)], ["key", "id"]
            )


def _refined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of crowded buckets in (bucket, id, code), their keys within the
    bucket out: the variants of every segment but the one of the bucket."""
    step = 2000
    own = np.repeat(np.arange(SEGMENTS), WIDTH)
    for whole in batches:
        for at in range(0, whole.num_rows, step):
            batch = whole.slice(at, step)
            bucket = batch.column(0).to_numpy().view(np.uint64)
            keys = variants(batch.column(2).flatten().to_numpy().view(np.uint32).reshape(-1, SYMBOLS))
            segment = own[(keys == bucket[:, None]).argmax(1)]
            row, place = np.nonzero(own[None, :] != segment[:, None])
            with np.errstate(over="ignore"):
                inside = _mix(keys[row, place] ^ _mix(bucket[row] * _MUL))
            ids = batch.column(1).take(pa.array(row))
            yield pa.RecordBatch.from_arrays([pa.array(inside.view(np.int64)), ids], ["key", "id"])


def _met(indexed: DataFrame) -> DataFrame:
    """Candidates ``(a, b, bucket)`` of an index; bucket is 0 but for stars."""
    return (
        indexed.repartition("key")
        .sortWithinPartitions("key", "id")
        .mapInArrow(_pairs, "a bigint, b bigint, bucket bigint")
        .distinct()
    )


class _Runs:
    """Rows sorted by key in, candidate pairs out; holds STAR_FROM ids at most."""

    def __init__(self) -> None:
        self.key, self.ids, self.star = None, [], False
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.k: list[np.ndarray] = []

    def _out(self, a: np.ndarray, b: np.ndarray, key: int | None) -> None:
        self.a.append(a)
        self.b.append(b)
        # only pairs of a star name their bucket; 0 stands for none
        self.k.append(np.full(len(a), 0 if key is None else key, np.int64))

    def add(self, key: int, ids: np.ndarray) -> None:
        if key != self.key:
            self.close()
            self.key, self.ids, self.star = key, [], False
        ids = np.unique(ids)
        if self.star:
            ids = ids[ids != self.ids[0]]
            self._out(np.full(len(ids), self.ids[0]), ids, key)
            return
        self.ids = np.unique(np.concatenate([np.array(self.ids, np.int64), ids])).tolist()
        if len(self.ids) > STAR_FROM:
            rest = np.array(self.ids[1:], np.int64)
            self._out(np.full(len(rest), self.ids[0]), rest, key)
            self.star, self.ids = True, self.ids[:1]

    def close(self) -> None:
        if not self.star and len(self.ids) > 1:
            ids = np.array(self.ids, np.int64)
            x, y = np.triu_indices(len(ids), 1)
            self._out(ids[x], ids[y], None)
        self.ids = []

    def batch(self) -> pa.RecordBatch | None:
        if not self.a:
            return None
        columns = [pa.array(np.concatenate(x)) for x in (self.a, self.b, self.k)]
        self.a, self.b, self.k = [], [], []
        return pa.RecordBatch.from_arrays(columns, ["a", "b", "bucket"])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    runs = _Runs()
    for batch in batches:
        key, ids = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        if not len(key):
            continue
        starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
        ends = np.append(starts[1:], len(key))
        # single rows inside the batch have no partner; its ends may go on
        use = ends - starts > 1
        use[0] = use[-1] = True
        for s, e in zip(starts[use], ends[use]):
            runs.add(int(key[s]), ids[s:e])
        if out := runs.batch():
            yield out
    runs.close()
    if out := runs.batch():
        yield out


def _equal_symbols(suffix_a: str, suffix_b: str) -> Column:
    differ = F.lit(0)
    for q in range(4):
        x = F.col(f"q{q}{suffix_a}").bitwiseXOR(F.col(f"q{q}{suffix_b}"))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        differ = differ + F.bit_count(either.bitwiseAND(F.lit(0x5555555555555555)))
    return F.lit(SYMBOLS) - differ


def _likely(pairs: DataFrame, short: DataFrame) -> DataFrame:
    a = short.select(F.col("id").alias("a"), *(F.col(f"q{q}").alias(f"q{q}a") for q in range(4)))
    b = short.select(F.col("id").alias("b"), *(F.col(f"q{q}").alias(f"q{q}b") for q in range(4)))
    return pairs.join(a, "a").join(b, "b").where(_equal_symbols("a", "b") >= LEAST_EQUAL)


def _verified(pairs: DataFrame, chunks: DataFrame, text: str) -> DataFrame:
    """Those of ``(a, b)`` that are linked; pairs must be few next to chunks."""
    ids = pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()
    wanted = (
        chunks.where("chunk_kind = 'leaf'")
        .select("id", F.col("created_at"), F.col(text).alias("text"))
        .join(ids, "id", "left_semi")
    )

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            runs = [word_runs(t).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(runs, pa.list_(pa.int64()))],
                ["id", "at", "runs"],
            )

    runs = wanted.mapInArrow(sets, "id bigint, at timestamp_ntz, runs array<bigint>")
    runs = runs.groupBy("id").agg(F.max_by("runs", "at").alias("runs"))
    runs = materialise(runs, "p2-runs")
    a = runs.select(F.col("id").alias("a"), F.col("runs").alias("ra"))
    b = runs.select(F.col("id").alias("b"), F.col("runs").alias("rb"))
    both = F.size(F.array_intersect("ra", "rb"))
    union = F.size("ra") + F.size("rb") - F.col("n")
    return (
        pairs.join(a, "a")
        .join(b, "b")
        .withColumn("n", both)
        .where(F.col("n") * THRESHOLD[1] >= union * THRESHOLD[0])
        .select("a", "b")
    )


class Groups:
    """Links and classes of near-duplicate leaf chunks.

    Exact copies (same set of runs) are collapsed to the smallest id before
    candidates are sought. Texts under RUN words, empty and null ones have no
    runs and no partner; re-delivered rows count once, by their latest
    delivery; an empty table gives none. A bucket of more than STAR_FROM
    members is not expanded into all its pairs: its members are compared with
    its first. Those that end up outside the first one's class meet the members
    of other classes: all of them where they are few, else those with which
    they share a second segment too, which a linked pair does with a
    probability of 0.9996 in each of its buckets.

    ``links``: (a, b) of linked representatives, enough to connect every class.
    ``members``: (id, rep, class) of every chunk with a partner.
    """

    def __init__(self, chunks: DataFrame, text: str = "content"):
        if "created_at" not in chunks.columns:
            chunks = chunks.withColumn("created_at", F.lit(None).cast("timestamp_ntz"))
        chunks = chunks.withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
        chunks = chunks.withColumn(
            "created_at", F.coalesce("created_at", F.lit("0001-01-01").cast("timestamp_ntz"))
        )
        leaves = chunks.where(f"chunk_kind = 'leaf' and id is not null and {text} is not null")
        sketch = materialise(
            leaves.select("id", "created_at", text).mapInArrow(
                _sketch,
                "id bigint, at timestamp_ntz, f1 bigint, f2 bigint, q0 bigint, q1 bigint, "
                "q2 bigint, q3 bigint, code array<int>",
            ),
            "p2-sketch",
        )
        latest = sketch.groupBy("id").agg(F.max_by(F.struct("f1", "f2"), "at").alias("f"))
        latest = latest.select("id", "f.f1", "f.f2")
        first = latest.groupBy("f1", "f2").agg(
            F.min("id").alias("rep"), F.count("*").alias("copies")
        )
        self.reps = materialise(first, "p2-reps")
        copies = latest.join(self.reps.where("copies > 1"), ["f1", "f2"]).select("id", "rep")
        self.copies = materialise(copies, "p2-copies")
        keys = self.reps.select(F.col("rep").alias("id"), "f1", "f2")
        own = sketch.join(keys, ["id", "f1", "f2"], "left_semi").dropDuplicates(["id"])
        own = materialise(own.drop("at", "f1", "f2"), "p2-own")
        release(sketch)
        indexed = own.select("id", "code").mapInArrow(_index, "key bigint, id bigint")
        short = own.select("id", "q0", "q1", "q2", "q3")
        candidates = materialise(_met(indexed), "p2-candidates")
        pairs = _likely(candidates.select("a", "b").distinct(), short).select("a", "b")
        links = materialise(
            _verified(materialise(pairs, "p2-likely"), chunks, text), "p2-links"
        )
        label = connected_components(links)
        stars = candidates.where("bucket <> 0")
        for last in (False, True):
            if stars.isEmpty():
                break
            more, stars = self._outside(stars, label, own, last)
            more = materialise(_likely(more.distinct(), short).select("a", "b"), "p2-likely")
            links = materialise(links.union(_verified(more, chunks, text)).distinct(), "p2-links")
            label = connected_components(links)
        self.links = links
        of = label.select(F.col("node").alias("rep"), "component")
        linked = of.select(F.col("rep").alias("id"), "rep", F.col("component").alias("class"))
        held = self.copies.join(of, "rep", "left").select(
            "id", "rep", F.coalesce("component", "rep").alias("class")
        )
        self.members = linked.unionByName(held).distinct()

    @staticmethod
    def _outside(
        stars: DataFrame, label: DataFrame, own: DataFrame, last: bool
    ) -> tuple[DataFrame, DataFrame]:
        """Pairs (a, b) still to compare in the buckets of ``stars``, and the
        stars of those buckets that were divided by a second segment."""
        named = label.select(F.col("node").alias("id"), F.col("component").alias("class"))
        ends = F.array(
            F.struct(F.col("a").alias("id"), F.lit(True).alias("first")),
            F.struct(F.col("b").alias("id"), F.lit(False).alias("first")),
        )
        held = (
            stars.select("bucket", F.explode(ends).alias("e"))
            .select("bucket", "e.id", "e.first")
            .distinct()
            .join(named, "id", "left")
            .select("bucket", "id", "first", F.coalesce("class", "id").alias("class"))
        )
        centre = held.where("first").groupBy("bucket").agg(F.min("class").alias("centre"))
        held = held.join(centre, "bucket").withColumn("out", F.col("class") != F.col("centre"))
        held = materialise(held, "p2-held")
        count = held.groupBy("bucket").agg(F.count_if("out").alias("n")).where("n > 0")
        count = materialise(count, "p2-outside")
        few = count if last else count.where(F.col("n") <= FEW)
        side = lambda name: held.join(few, "bucket").select(
            "bucket", F.col("id").alias(name), F.col("class").alias(f"c{name}"), "out"
        )
        more = (
            side("x").where("out").drop("out").join(side("y").drop("out"), "bucket")
            .where("cx <> cy")
            .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
        )
        if last:
            return more, stars.where("false")
        many = held.join(count.where(F.col("n") > FEW), "bucket").select("bucket", "id").distinct()
        divided = many.join(own.select("id", "code"), "id").select("bucket", "id", "code")
        divided = materialise(_met(divided.mapInArrow(_refined, "key bigint, id bigint")), "p2-divided")
        return more.union(divided.select("a", "b")), divided.where("bucket <> 0")


def case_pairs(chunks: DataFrame) -> DataFrame:
    """``(id_a, id_b)``, id_a < id_b: all pairs within a class.

    The result's own size is quadratic in a class; classes are what
    :func:`classes` gives without that expansion.
    """
    members = materialise(Groups(chunks).members.select("id", "class"), "p2-members")
    a = members.select("class", F.col("id").alias("id_a"))
    b = members.select("class", F.col("id").alias("id_b"))
    return a.join(b, "class").where("id_a < id_b").select("id_a", "id_b")


def classes(chunks: DataFrame) -> DataFrame:
    """``(id, class_id)`` of every leaf chunk: the smallest id of its class, its
    own if it has no partner."""
    members = Groups(chunks).members.select("id", "class")
    ids = chunks.where("chunk_kind = 'leaf' and id is not null").select("id").distinct()
    return ids.join(members, "id", "left").select("id", F.coalesce("class", "id").alias("class_id"))
