"""Most similar vectors of every vector, by multi-index hashing.

Per model, rotations are learned so that the signs of the rotated, centred
vectors lose little (iterative quantisation of the principal axes). The signs
of all rotations form one binary code, which is cut into m substrings of s
bits, each with an index of its own. A substring of a vector is looked up at
its own key and at all keys that differ in one bit, so by the pigeonhole
principle every code within a Hamming distance of 2 m - 1 is retrieved.
Retrieved codes within the radius that belongs to the least similarity are
reranked on floats.

Nothing in this is set by the data: s is the logarithm of the number of vectors
over LOAD, so that buckets stay as full as they are, and m is what makes the
chance that a pair of the least similarity is retrieved by no substring MISS.
Each bit of such a pair differs with the probability of its angle over pi.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window as W, functions as F

from corpusmill.operators.topk import search
from corpusmill.session import materialise

DIMENSION = 64
#: Vectors per key that the length of substrings aims at, and their least length.
#: A bucket is cheap to scan and an index row dear to move, so buckets are large.
LOAD, LEAST_BITS = 2048, 7
#: Chance that no substring retrieves a pair of the least similarity.
MISS = 0.005
#: Standard deviations of the Hamming distance that candidates are allowed, and
#: the 64-bit words of the code that it is taken over.
SLACK, WORDS = 3.5, 4
#: Vectors per model that the rotations are learned from; the index has all.
SAMPLE = 8192
#: Models that get rotations of their own, the others share random ones.
MODELS = 64
#: Buckets beyond HOT rows, or with more near pairs than CROWD for each row, are
#: not listed: their rows are searched exactly instead.
HOT, CROWD = 16384, 64
K, LEAST = 10, 0.9
_BLOCK = 1024


class Plan(NamedTuple):
    """Substring length, number of substrings, rotations, Hamming radii.

    ``radii`` are over the first half of the WORDS, tested first, and over all.
    """

    bits: int
    tables: int
    rotations: int
    radii: tuple[int, int]

    @staticmethod
    def of(vectors: int, least: float) -> "Plan":
        differ = math.acos(max(min(least, 1 - 1e-9), 0.0)) / math.pi
        bits = min(max(math.ceil(math.log2(max(vectors, 1) / LOAD)), LEAST_BITS), 32)
        hit = (1 - differ) ** bits + bits * differ * (1 - differ) ** (bits - 1)
        tables = math.ceil(math.log(MISS) / math.log(1 - hit))
        radius = lambda n: math.floor(n * differ + SLACK * math.sqrt(n * differ * (1 - differ)))
        rotations = max(WORDS, math.ceil(tables / (64 // bits)))
        return Plan(bits, tables, rotations, (radius(32 * WORDS), radius(64 * WORDS)))


def learn(vectors: np.ndarray, rotations: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, matrix of shape (d, rotations * d)) from unit vectors."""
    d = vectors.shape[1] if len(vectors) else DIMENSION
    mean = vectors.mean(0) if len(vectors) else np.zeros(d)
    centred = vectors - mean if len(vectors) else np.zeros((0, d))
    axes = np.eye(d)
    if len(vectors) > d:
        axes = np.linalg.eigh(np.cov(centred.T))[1]
    out = []
    for seed in range(rotations):
        turn = np.linalg.qr(np.random.default_rng(seed).normal(size=(d, d)))[0]
        if len(vectors) > d:
            projected = centred @ axes
            for _ in range(30):
                u, _, v = np.linalg.svd(np.where(projected @ turn > 0, 1.0, -1.0).T @ projected)
                turn = (u @ v).T
        out.append(axes @ turn)
    return mean, np.concatenate(out, 1)


def usable(chunks: DataFrame) -> DataFrame:
    """``(id, model, v)`` of leaf chunks whose embedding takes part.

    Left out are embeddings that are null, not of DIMENSION values, not finite
    or all zero, and chunks without a model, which are of no same model.
    Re-delivered rows count once, by the latest.
    """
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    wanted = (
        (F.col("chunk_kind") == "leaf")
        & F.col("id").isNotNull()
        & F.col("embedding_model").isNotNull()
    )
    columns = {f.name for f in chunks.schema}
    at = F.col("created_at") if "created_at" in columns else F.lit(None).cast("timestamp")
    one = W.partitionBy("id").orderBy(F.col("at").desc_nulls_last(), "model")
    return (
        chunks.where(wanted)
        .select("id", F.col("embedding_model").alias("model"), "embedding", at.alias("at"))
        .withColumn("n", F.row_number().over(one))
        .where("n = 1")
        .where((F.size("embedding") == DIMENSION) & finite)
        .where(F.exists("embedding", lambda x: x != 0))
        .select("id", "model", F.col("embedding").cast("array<float>").alias("v"))
    )


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    m = flat.reshape(-1, DIMENSION).astype(np.float64)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def _learned(vectors: DataFrame, rotations: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Rotations of the MODELS largest models, each from SAMPLE vectors.

    A hash of the id first keeps about twice as many, so the task that takes
    the sample of a model reads no more than that, whatever the model's size.
    """
    top = vectors.groupBy("model").count().orderBy(F.desc("count"), "model").limit(MODELS)
    few = W.partitionBy("model").orderBy(F.xxhash64("id"), "id")
    sample = (
        vectors.join(F.broadcast(top), "model")
        .where(F.pmod(F.xxhash64("id"), F.lit(2**30)).cast("double") * F.col("count") < 2 * SAMPLE * 2**30)
        .withColumn("n", F.row_number().over(few))
        .where(F.col("n") <= SAMPLE)
        .select("model", "v")
    )

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        m = np.array(pdf["v"].tolist(), np.float64)
        m /= np.sqrt((m * m).sum(1, keepdims=True))
        mean, turn = learn(m, rotations)
        return pd.DataFrame(
            {"model": [pdf["model"].iloc[0]], "mean": [mean.tolist()], "turn": [turn.ravel().tolist()]}
        )

    rows = sample.groupBy("model").applyInPandas(
        fit, "model string, mean array<double>, turn array<double>"
    )
    return {
        r["model"]: (np.array(r["mean"]), np.array(r["turn"]).reshape(DIMENSION, -1))
        for r in rows.collect()  # at most MODELS rows
    }


def _coded(vectors: DataFrame, rotations: int) -> DataFrame:
    """``(id, model, v, code)``: the code has 64 bits per rotation."""
    learned = vectors.sparkSession.sparkContext.broadcast(_learned(vectors, rotations))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        default = learn(np.zeros((0, DIMENSION)), rotations)
        bits = np.uint64(1) << np.arange(64, dtype=np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            m = _matrix(batch.column(2))
            models = batch.column(1).dictionary_encode()
            number = models.indices.to_numpy()
            codes = np.zeros((len(m), rotations), np.uint64)
            for k, model in enumerate(models.dictionary.to_pylist()):
                own = number == k
                mean, turn = learned.value.get(model, default)
                signs = ((m[own] - mean) @ turn > 0).reshape(-1, rotations, DIMENSION)
                codes[own] = (signs * bits).sum(2, dtype=np.uint64)
            at = pa.array(np.arange(len(m) + 1, dtype=np.int32) * rotations)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.ListArray.from_arrays(at, pa.array(codes.reshape(-1).view(np.int64)))],
                ["id", "model", "v", "code"],
            )

    return vectors.mapInArrow(run, "id bigint, model string, v array<float>, code array<bigint>")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _index(coded: DataFrame, plan: Plan) -> DataFrame:
    """``(key, probe, id, c0..)``: each substring under its own key, and as a
    probe under the keys with one of its zero bits set.

    Of two codes that differ in one bit of a substring, the one that has zero
    there probes the key of the other, so each such pair meets once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mask = np.uint64((1 << plan.bits) - 1)
        for whole in batches:
            for start in range(0, whole.num_rows, 8 * _BLOCK):
                batch = whole.slice(start, 8 * _BLOCK)
                codes = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(-1, plan.rotations)
                models = batch.column(1).dictionary_encode()
                salt = np.array([xxhash.xxh64_intdigest(x) for x in models.dictionary.to_pylist()], np.uint64)
                salt = salt[models.indices.to_numpy()]
                keys, rows, probes = [], [], []
                with np.errstate(over="ignore"):
                    for table in range(plan.tables):
                        place, rotation = divmod(table, plan.rotations)
                        own = (codes[:, rotation] >> np.uint64(place * plan.bits)) & mask
                        base = _mix(salt + np.uint64(table + 1) * np.uint64(0x9E3779B97F4A7C15))
                        keys.append(_mix(base ^ own))
                        rows.append(np.arange(len(own)))
                        probes.append(np.zeros(len(own), bool))
                        for bit in range(plan.bits):
                            zero = np.flatnonzero((own >> np.uint64(bit)) & np.uint64(1) == 0)
                            keys.append(_mix(base[zero] ^ (own[zero] | np.uint64(1 << bit))))
                            rows.append(zero)
                            probes.append(np.ones(len(zero), bool))
                at = np.concatenate(rows)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate(keys).view(np.int64)),
                        pa.array(np.concatenate(probes)),
                        batch.column(0).take(pa.array(at)),
                        *(pa.array(codes[at, k].view(np.int64)) for k in range(WORDS)),
                    ],
                    ["key", "probe", "id", *(f"c{k}" for k in range(WORDS))],
                )

    words = "".join(f", c{k} bigint" for k in range(WORDS))
    return coded.select("id", "model", "code").mapInArrow(
        run, f"key bigint, probe boolean, id bigint{words}"
    )


class _Buckets:
    """Rows sorted by key, own ones first, in; candidate pairs out.

    Holds at most HOT own rows of a bucket; probes pass by in blocks. A bucket
    with more rows, or with more near pairs than CROWD for each, gives one row
    ``(key, key, true)`` and no further pairs.
    """

    def __init__(self, radii: tuple[int, int]):
        self.radii, self.key = radii, None
        self.ids, self.codes, self.hot = np.zeros(0, np.int64), np.zeros((0, WORDS), np.uint64), False
        self.pairs = 0
        self.out: list[tuple[np.ndarray, np.ndarray, bool]] = []

    def _near(self, ids: np.ndarray, codes: np.ndarray, other: np.ndarray, codes_of: np.ndarray, below: bool) -> None:
        half = WORDS // 2
        most = CROWD * (len(self.ids) + _BLOCK)
        for i in range(0, len(ids), _BLOCK):
            a = codes[i : i + _BLOCK]
            for j in range(i if below else 0, len(other), _BLOCK):
                if self.pairs > most:
                    self._give_up()
                    return
                b = codes_of[j : j + _BLOCK]
                d = np.bitwise_count(a[:, None, 0] ^ b[None, :, 0])
                for k in range(1, half):
                    d += np.bitwise_count(a[:, None, k] ^ b[None, :, k])
                x, y = np.nonzero(d <= self.radii[0])
                if below:
                    x, y = x[x + i < y + j], y[x + i < y + j]
                rest = np.bitwise_count(a[x, half:] ^ b[y, half:]).sum(1, dtype=np.int64)
                near = d[x, y] + rest <= self.radii[1]
                if near.any():
                    self.pairs += np.count_nonzero(near)
                    p, q = ids[i + x[near]], other[j + y[near]]
                    self.out.append((np.minimum(p, q), np.maximum(p, q), False))

    def _give_up(self) -> None:
        if not self.hot:
            self.hot = True
            self.out.append((np.array([self.key]), np.array([self.key]), True))

    def add(self, key: int, probe: bool, ids: np.ndarray, codes: np.ndarray) -> None:
        if key != self.key:
            self.key, self.hot, self.pairs = key, False, 0
            self.ids, self.codes = ids[:0], codes[:0]
        if self.hot:
            return
        if probe:
            if len(self.ids):
                self._near(ids, codes, self.ids, self.codes, False)
            return
        if len(self.ids) + len(ids) > HOT:
            self._give_up()
            return
        # own rows that were there before meet the new ones, and these one another
        if len(self.ids):
            self._near(ids, codes, self.ids, self.codes, False)
        self._near(ids, codes, ids, codes, True)
        self.ids, self.codes = np.concatenate([self.ids, ids]), np.concatenate([self.codes, codes])

    def batch(self) -> pa.RecordBatch | None:
        if not self.out:
            return None
        a, b = (np.concatenate([o[k] for o in self.out]) for k in (0, 1))
        hot = np.repeat([o[2] for o in self.out], [len(o[0]) for o in self.out])
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(hot)], ["a", "b", "hot"])


def _candidates(radii: tuple[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets(radii)
        for batch in batches:
            key, ids = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            probe = batch.column(1).to_numpy(zero_copy_only=False)
            codes = np.stack([batch.column(k).to_numpy().view(np.uint64) for k in range(3, 3 + WORDS)], 1)
            if not len(key):
                continue
            change = (key[1:] != key[:-1]) | (probe[1:] != probe[:-1])
            starts = np.concatenate([[0], np.flatnonzero(change) + 1])
            for s, e in zip(starts, np.append(starts[1:], len(key))):
                buckets.add(int(key[s]), bool(probe[s]), ids[s:e], codes[s:e])
            if (out := buckets.batch()) is not None:
                yield out
        if (out := buckets.batch()) is not None:
            yield out

    return run


def _exact(vectors: DataFrame, asked: DataFrame, k: int, least: float, digits: int = 12) -> DataFrame:
    """Best ``k`` of all ``vectors`` for each of ``asked``, compared in blocks:
    ``(query_id, chunk_id, rank, score)``, same model, not the row itself."""
    rows = vectors.select("id", "v", "model")

    def scorer(block: list) -> Callable[[pa.RecordBatch], np.ndarray]:
        q = np.array([r[1] for r in block], np.float64)
        q /= np.sqrt((q * q).sum(1, keepdims=True))
        ids = np.array([r[0] for r in block], np.int64)
        number = {m: n for n, m in enumerate(dict.fromkeys(r[2] for r in block))}
        models = np.array([number[r[2]] for r in block])
        place = {r[0]: n for n, r in enumerate(block)}

        def score(batch: pa.RecordBatch) -> np.ndarray:
            s = np.round(q @ _matrix(batch.column(1)).T, digits)
            coded = batch.column(2).dictionary_encode()
            of = np.array([number.get(m, -1) for m in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
            s[(models[:, None] != of[None, :]) | (s < least)] = -np.inf
            if len(place) < len(ids):  # an id may be asked for more than once
                s[ids[:, None] == batch.column(0).to_numpy()[None, :]] = -np.inf
            else:
                for at, x in enumerate(batch.column(0).to_pylist()):
                    if x in place:
                        s[place[x], at] = -np.inf
            return s

        return score

    named = asked.select(F.col("id").alias("query_id"), "v", "model")
    return search(rows, named, ["query_id", "v", "model"], scorer, k)


def similar_pairs(coded: DataFrame, plan: Plan, least: float = LEAST, k: int = K + 1) -> DataFrame:
    """``(a, b, similarity)`` of distinct vectors with at least ``least``.

    A dense region, even one with a third of all rows, would fill buckets whose
    pairs no task can list. What meets in a bucket beyond HOT or CROWD is
    searched exactly instead, the rows of such buckets among themselves, in
    blocks, for the ``k`` best of each; nothing is dropped.
    """
    index = _index(coded, plan)
    found = materialise(
        index.repartition("key")
        .sortWithinPartitions("key", "probe")
        .mapInArrow(_candidates(plan.radii), "a bigint, b bigint, hot boolean")
        .distinct(),
        "p4-candidates",
    )
    hot = found.where("hot").select(F.col("a").alias("key"))
    exact = None
    if not hot.isEmpty():
        ids = index.select("key", "id").join(hot, "key", "left_semi").select("id").distinct()
        crowded = materialise(coded.join(ids, "id", "left_semi"), "p4-crowded")
        exact = _exact(crowded, crowded, k, least).select(
            F.least("query_id", "chunk_id").alias("a"),
            F.greatest("query_id", "chunk_id").alias("b"),
            F.col("score").alias("similarity"),
        )
    va = coded.select(F.col("id").alias("a"), F.col("v").alias("va"))
    vb = coded.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    both = found.where("not hot").select("a", "b").join(va, "a").join(vb, "b")

    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            s = (_matrix(batch.column(2)) * _matrix(batch.column(3))).sum(1)
            keep = np.flatnonzero(s >= least)
            at = pa.array(keep)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(1).take(at), pa.array(s[keep])],
                ["a", "b", "similarity"],
            )

    links = both.select("a", "b", "va", "vb").mapInArrow(
        rerank, "a bigint, b bigint, similarity double"
    )
    if exact is None:
        return links
    return links.unionByName(exact).groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def neighbours(chunks: DataFrame, k: int = K, least: float = LEAST) -> DataFrame:
    """``(id, neighbour, similarity, place)``: up to ``k`` most similar vectors
    of the same model with at least ``least``, of every usable vector.

    Ties are broken by the smaller id. Exact copies are collapsed before the
    index; of a class of copies only its ``k + 1`` smallest ids can be anyone's
    neighbours under that rule, so no group is expanded into its pairs.
    """
    # two hashes name a vector; the smallest id of equal ones stands for all
    rows = usable(chunks).withColumns({"f1": F.xxhash64("v"), "f2": F.xxhash64(F.lit(1), "v")})
    rows = materialise(rows, "p4-rows")
    same = ["model", "f1", "f2"]
    reps = rows.groupBy(*same).agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    reps = materialise(reps, "p4-reps")
    plan = Plan.of(reps.count(), least)
    own = rows.select("id", "model", "v").join(reps.select(F.col("rep").alias("id")), "id", "left_semi")
    own = materialise(_coded(own, plan.rotations), "p4-own")
    links = similar_pairs(own, plan, least, k + 1)
    sides = links.select(
        F.explode(
            F.array(
                F.struct(F.col("a").alias("x"), F.col("b").alias("y")),
                F.struct(F.col("b").alias("x"), F.col("a").alias("y")),
            )
        ).alias("e"),
        F.round("similarity", 12).alias("similarity"),
    ).select("e.x", "e.y", "similarity")
    twins = reps.where("copies > 1")
    selves = twins.select(F.col("rep").alias("x"), F.col("rep").alias("y"), F.lit(1.0).alias("similarity"))
    nearest = W.partitionBy("x").orderBy(F.desc("similarity"))
    sides = (
        sides.unionByName(selves)
        .withColumn("place", F.rank().over(nearest))
        .where(F.col("place") <= k + 1)
        .drop("place")
    )
    # inner joins only: of these, adaptive execution can split a hot class on either side
    members = materialise(rows.select("id", *same).join(reps, same).select("id", "rep"), "p4-members")
    first = (
        members.withColumn("n", F.row_number().over(W.partitionBy("rep").orderBy("id")))
        .where(F.col("n") <= k + 1)
        .select(F.col("rep").alias("y"), F.col("id").alias("neighbour"))
    )
    rows = (
        sides.join(members.select("id", F.col("rep").alias("x")), "x")
        .join(first, "y")
        .where("id <> neighbour")
    )
    by = W.partitionBy("id").orderBy(F.desc("similarity"), "neighbour")
    return (
        rows.select("id", "neighbour", "similarity")
        .withColumn("place", F.row_number().over(by))
        .where(F.col("place") <= k)
    )


def mutual_pairs(chunks: DataFrame, k: int = K, least: float = LEAST) -> DataFrame:
    """``(id_a, id_b)``: each among the ``k`` most similar of the other, with a
    cosine of at least ``least``."""
    near = neighbours(chunks, k, least)
    return (
        near.select(
            F.least("id", "neighbour").alias("id_a"), F.greatest("id", "neighbour").alias("id_b")
        )
        .groupBy("id_a", "id_b")
        .count()
        .where("count = 2")
        .select("id_a", "id_b")
    )


def nearest(chunks: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """``(id, neighbour, place, similarity)``: the ``k`` nearest of a stated
    set of chunks (``queries``: id), however far, searched exactly in blocks.

    The code index serves close pairs; where a chunk has no close neighbour,
    its nearest ones are hardly nearer than others and no radius finds them.
    """
    rows = usable(chunks)
    asked = rows.join(queries.select("id").distinct(), "id", "left_semi")
    return _exact(rows, asked, k, -2.0, 6).select(
        F.col("query_id").alias("id"),
        F.col("chunk_id").alias("neighbour"),
        F.col("rank").alias("place"),
        F.col("score").alias("similarity"),
    )


def recall(chunks: DataFrame, queries: DataFrame, k: int = K, least: float = LEAST) -> DataFrame:
    """``(band, exact, found, recall)``: per band of 0.02 of the similarity, the
    exact neighbours of ``queries`` with at least ``least``, how many of them
    the index found, and their share."""
    want = nearest(chunks, queries, k).where(F.col("similarity") >= least)
    have = neighbours(chunks, k, least).select("id", "neighbour", F.lit(1).alias("found"))
    band = F.least(F.floor(F.col("similarity") * 50 + 1e-9), F.lit(49)) / 50
    return (
        want.join(have, ["id", "neighbour"], "left")
        .groupBy(F.round(band, 2).alias("band"))
        .agg(F.count("*").alias("exact"), F.count("found").alias("found"))
        .withColumn("recall", F.round(F.col("found") / F.col("exact"), 6))
    )
