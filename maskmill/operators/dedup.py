"""Exact and near duplicates: groups by digest, pairs by Hamming distance and correlation."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskmill.functions.scalars import four_digits, join_sorted
from maskmill.runtime import cut, lookup, shuffle_width


#: Bits that a band must have for the band join.
NARROW = 8


def exact_groups(df: DataFrame, digest: str, key: str, label: str) -> DataFrame:
    """Groups of equal digests: id in digest order, members, labels, contradictory flag."""
    held = df.filter(F.col(digest).isNotNull() & (F.col(digest) != ""))
    groups = held.groupBy(digest).agg(F.count("*").alias("n"), join_sorted(F.collect_set(key)).alias("sample_ids"), join_sorted(F.collect_set(label)).alias("labels"), F.min(label).alias("lo"), F.max(label).alias("hi"))
    found = groups.filter("n > 1").withColumn("contradictory", (F.col("lo") != F.col("hi")).cast("int"))
    return number_in_order(found, digest, "exact_group", "exact").select("exact_group", digest, "sample_ids", "labels", "contradictory", F.when(F.col("contradictory") == 1, "quarantine").otherwise("group").alias("action"))


def number_in_order(df: DataFrame, order: str, name: str, prefix: str) -> DataFrame:
    """Number rows from 0 in the order of a unique column, without a single-task window:
    range partitions are counted, and each starts where those before it end."""
    placed = df.repartitionByRange(order).sortWithinPartitions(order).withColumn("__part", F.spark_partition_id())
    placed = cut(placed)
    counts = placed.groupBy("__part").agg(F.count("*").alias("__n"))  # one row a partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(F.col("__part").alias("__p"), F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(order)) - 1
    joined = placed.withColumn("__i", inside).join(F.broadcast(starts), F.col("__part") == F.col("__p"))
    return joined.withColumn(name, four_digits(prefix, (F.col("__i") + F.col("__start")).cast("long"))).drop("__part", "__p", "__start", "__i")


def bits_above_median(vector: Column, size: int = 64) -> Column:
    """64-bit perceptual hash: bit i, first highest, is set where a value exceeds the
    median of all but the first value."""
    values = F.slice(vector, 1, size)
    rest = F.array_sort(F.slice(values, 2, size - 1))
    middle = F.element_at(rest, (size - 1) // 2 + 1)
    held = F.struct(values.alias("v"), middle.alias("m"))  # bound once, not once per element
    bit = lambda h: F.transform(h["v"], lambda x, i: F.when(x > h["m"], F.call_function("shiftleft", F.lit(1).cast("long"), (size - 1 - i).cast("int"))).otherwise(F.lit(0).cast("long")))
    return F.get(F.transform(F.array(held), lambda h: F.aggregate(bit(h), F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b))), 0)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hamming_pairs(df: DataFrame, key: str, value: str, most: int, rows_per_block: int = 2048) -> DataFrame:
    """Pairs of different hashes within ``most`` bits, exactly.

    64 bits in ``most + 1`` bands: a pair that differs in at most ``most`` bits agrees in
    one band, so it stands in one bucket of (band, bits); it is taken in the first band it
    agrees in. A bucket is compared in pairs of its blocks, so a band value that a third of
    the hashes share (blank pictures) is many tasks. Where bands would be narrower than
    ``NARROW`` bits, which hardly separate anything, all hashes are compared in blocks
    instead. Equal hashes count once, as representatives of their ids (see
    ``representatives``). Keys are whole numbers.
    """
    bands = most + 1
    unique = df.filter(F.col(value).isNotNull() & F.col(key).isNotNull()).groupBy(value).agg(F.min(key).alias(key))
    if 64 // bands < NARROW:
        pairs = block_pairs(unique, key, value, most, how="hamming")
    else:
        edges = [round(i * 64 / bands) for i in range(bands + 1)]
        cut_out = [F.shiftrightunsigned(F.col(value), a).bitwiseAND(F.lit(-1 if b - a == 64 else (1 << (b - a)) - 1).cast("long")) for a, b in zip(edges, edges[1:])]
        pairs = _bucket_pairs(unique.select(F.col(key).cast("long").alias("k"), F.col(value).alias("v"), F.array(*cut_out).alias("s")), key, most, "hamming", rows_per_block)
    return pairs.select(f"{key}_a", f"{key}_b", F.col("score").cast("int").alias("distance"))


#: Ids of equal hashes that are joined as one part.
PART = 2048


def all_hamming_pairs(df: DataFrame, key: str, value: str, most: int, part: int = PART) -> DataFrame:
    """Pairs of ids whose hashes differ in at most ``most`` bits, exactly; equal hashes are
    pairs at distance 0.

    In blocks, ids are compared as they are. By bands, the pairs of ``hamming_pairs`` are
    carried over to all ids of their hashes, which come in parts, so a hash that a third
    of the ids share is spread over many keys. The result is as large as there are pairs:
    quadratic in the ids of one hash. Where that is too much, ``hamming_pairs`` with
    ``representatives`` says the same.
    """
    ids = df.select(key, value).filter(F.col(key).isNotNull() & F.col(value).isNotNull()).distinct()
    if 64 // (most + 1) < NARROW:
        pairs = block_pairs(ids, key, value, most, how="hamming")
        return pairs.select(f"{key}_a", f"{key}_b", F.col("score").cast("int").alias("distance"))
    sizes = ids.groupBy(value).agg(F.min(key).alias("__r"), F.count("*").alias("__n")).withColumn("__parts", F.ceil(F.col("__n") / part).cast("int"))
    members = ids.join(sizes.withColumnRenamed(value, "__v"), F.col(value) == F.col("__v")).select(F.col(key).alias("__id"), F.col("__r"), F.pmod(F.xxhash64(F.lit(5), key), F.col("__parts")).cast("int").alias("__p"))
    across = hamming_pairs(ids, key, value, most).select(F.col(f"{key}_a").alias("__ra"), F.col(f"{key}_b").alias("__rb"), "distance")
    within = sizes.filter("__n > 1").select(F.col("__r").alias("__ra"), F.col("__r").alias("__rb"), F.lit(0).alias("distance"))
    links = across.unionByName(within)
    for side in "ab":
        parts = sizes.select(F.col("__r").alias(f"__r{side}"), F.explode(F.sequence(F.lit(0), F.col("__parts") - 1)).alias(f"__p{side}"))
        links = links.join(parts, f"__r{side}")
    for side in "ab":
        own = members.select(F.col("__r").alias(f"__r{side}"), F.col("__p").alias(f"__p{side}"), F.col("__id").alias(f"__id{side}"))
        links = links.join(own, [f"__r{side}", f"__p{side}"])
    kept = links.filter((F.col("__ra") != F.col("__rb")) | (F.col("__ida") < F.col("__idb")))
    return kept.select(F.least("__ida", "__idb").alias(f"{key}_a"), F.greatest("__ida", "__idb").alias(f"{key}_b"), "distance")


def representatives(df: DataFrame, key: str, value: str) -> DataFrame:
    """Membership of ids in the representative of their equal values."""
    return df.withColumn("representative", F.min(key).over(Window.partitionBy(value))).select(key, "representative")


def aligned(a: np.ndarray, b: np.ndarray, side: int = 8, reach: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best correlation of image pairs over shifts, re-centred on the overlap; the shift
    (dy, dx) is that of the first maximum, scanning dy then dx upward."""
    x, y = a.reshape(-1, side, side), b.reshape(-1, side, side)
    best = np.full(len(x), -np.inf)
    dy_best, dx_best = np.zeros(len(x), int), np.zeros(len(x), int)
    for dy in range(-reach, reach + 1):
        for dx in range(-reach, reach + 1):
            u = x[:, max(0, dy) : side + min(0, dy), max(0, dx) : side + min(0, dx)].reshape(len(x), -1)
            v = y[:, max(0, -dy) : side + min(0, -dy), max(0, -dx) : side + min(0, -dx)].reshape(len(x), -1)
            u, v = u - u.mean(1, keepdims=True), v - v.mean(1, keepdims=True)
            norm = np.sqrt((u * u).sum(1) * (v * v).sum(1))
            score = np.clip(np.divide((u * v).sum(1), norm, out=np.zeros(len(x)), where=norm > 0), -1, 1)
            better = score > best
            best[better], dy_best[better], dx_best[better] = score[better], dy, dx
    return best, dy_best, dx_best


def _close(a_ids: np.ndarray, a: np.ndarray, b_ids: np.ndarray, b: np.ndarray, least: float, how: str) -> tuple[np.ndarray, np.ndarray, tuple]:
    """Places in ``a`` and ``b`` of the pairs that are close enough, with (score, dy, dx)."""
    places_a, places_b, scores = [np.zeros(0, int)], [np.zeros(0, int)], [np.zeros((0, 3))]
    for start in range(0, len(a), 256):
        part = a[start : start + 256]
        if how == "hamming":
            score = np.bitwise_count(part[:, None] ^ b[None, :])
            at, bt = np.nonzero(score <= least)
            found = np.stack([score[at, bt], np.zeros(len(at)), np.zeros(len(at))], axis=1)
        elif how == "cosine":
            norm = np.linalg.norm(part, axis=1)[:, None] * np.linalg.norm(b, axis=1)[None, :]
            score = np.clip(np.divide(part @ b.T, norm, out=np.zeros((len(part), len(b))), where=norm > 0), -1, 1)
            at, bt = np.nonzero(score >= least)
            found = np.stack([score[at, bt], np.zeros(len(at)), np.zeros(len(at))], axis=1)
        else:
            at, bt = (x.ravel() for x in np.meshgrid(np.arange(len(part)), np.arange(len(b)), indexing="ij"))
            # a pair is oriented from its smaller id, so the shift has one meaning
            swap = a_ids[start + at] > b_ids[bt]
            first, second = np.where(swap[:, None], b[bt], part[at]), np.where(swap[:, None], part[at], b[bt])
            s, dy, dx = aligned(first, second, int(round(a.shape[1] ** 0.5)))
            ok = s >= least
            at, bt, found = at[ok], bt[ok], np.stack([s[ok], dy[ok], dx[ok]], axis=1)
        places_a.append(start + at)
        places_b.append(bt)
        scores.append(found)
    every = np.concatenate(scores)
    return np.concatenate(places_a), np.concatenate(places_b), (every[:, 0], every[:, 1], every[:, 2])


def _pair_table(key: str, x: np.ndarray, y: np.ndarray, found) -> pa.Table:
    names = {f"{key}_a": np.minimum(x, y).astype(np.int64), f"{key}_b": np.maximum(x, y).astype(np.int64)}
    return pa.table(names | {"score": np.asarray(found[0], float), "dy": np.asarray(found[1]).astype(np.int32), "dx": np.asarray(found[2]).astype(np.int32)})


#: Rows of a block; a shifted correlation is that of twenty-five pairs.
BLOCK = {"cosine": 2048, "hamming": 2048, "aligned": 256}


def block_pairs(df: DataFrame, key: str, vector: str, least: float, rows_per_block: int | None = None, how: str = "cosine") -> DataFrame:
    """Pairs whose cosine (or best shifted correlation) is at least ``least``, or whose
    64-bit hashes differ in at most ``least`` bits, exactly.

    Rows go to hash blocks; a task holds one pair of blocks and multiplies them as
    matrices, so memory is two blocks whatever the table. This is the exhaustive way, for
    scores that have no key to join on; the number of block pairs is quadratic in the
    table. Vectors must have equal lengths; null vectors match nothing.
    """
    held = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("long" if how == "hamming" else "array<double>").alias("v"))
    n = max(1, -(-held.count() // (rows_per_block or BLOCK[how])))
    block = F.pmod(F.xxhash64(F.lit(3), "k"), F.lit(n)).cast("int")
    spread = held.withColumn("b", block).withColumn("o", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).select("k", "v", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b")
    schema = f"{key}_a long, {key}_b long, score double, dy int, dx int"

    def compare(pair: tuple, t: pa.Table) -> pa.Table:
        ids, blocks = t["k"].to_numpy(), t["b"].to_numpy()
        vectors = t["v"].to_numpy().view(np.uint64) if how == "hamming" else np.array(t["v"].to_pylist(), float)
        left, right = (blocks == pair[0].as_py()), (blocks == pair[1].as_py())
        at, bt, found = _close(ids[left], vectors[left], ids[right], vectors[right], least, how)
        x, y = ids[left][at], ids[right][bt]
        keep = (x < y) if pair[0].as_py() == pair[1].as_py() else np.ones(len(x), bool)
        return _pair_table(key, x[keep], y[keep], [f[keep] for f in found])

    placed = spread.repartition(min(n * (n + 1) // 2, shuffle_width(df.sparkSession)), "i", "j")  # much work in few bytes
    return placed.groupBy("i", "j").applyInArrow(compare, schema)


#: Random hyperplanes: bits of a band, and bands. A pair of cosine 0.9 meets in a band
#: with a chance of 0.97, one of 0.95 of 0.999.
PLANE_BITS, PLANE_BANDS = 8, 12


def banded_pairs(df: DataFrame, key: str, vector: str, least: float, bits: int = PLANE_BITS, bands: int = PLANE_BANDS, rows_per_block: int = 2048, seed: int = 5) -> DataFrame:
    """Pairs whose cosine is at least ``least``, among those that lie on the same side of all
    hyperplanes of a band; each is compared exactly, once.

    Equal vectors count once, by their smallest id (see ``representatives``), so copies
    cost nothing. A bucket is compared in pairs of its hash blocks, so none is unbounded in
    a task. Recall grows with the cosine; it is for high ``least`` and large tables, where
    ``block_pairs`` would be quadratic. Null vectors match nothing.
    """
    held = df.filter(F.col(vector).isNotNull() & F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(vector).cast("array<double>").alias("v"))
    unique = held.groupBy("v").agg(F.min("k").alias("k"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            v = np.array(b.column(1).to_pylist(), float)
            planes = np.random.default_rng(seed).normal(size=(v.shape[1], bits * bands))
            side = (v @ planes > 0).reshape(len(v), bands, bits) @ (1 << np.arange(bits))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(side.tolist(), pa.list_(pa.int64()))], names=["k", "v", "s"])

    signed = unique.select("k", "v").mapInArrow(sign, "k long, v array<double>, s array<long>")
    return _bucket_pairs(signed, key, least, "cosine", rows_per_block).select(f"{key}_a", f"{key}_b", "score")


def _bucket_pairs(signed: DataFrame, key: str, least: float, how: str, rows_per_block: int) -> DataFrame:
    """Close pairs of the rows (k, v, s) that agree in one of the bands ``s``, each once, in
    the first band they agree in. Every bucket is compared in pairs of its hash blocks."""
    signed = cut(signed)
    long = signed.select("k", "v", "s", F.posexplode("s").alias("band", "side")).withColumn("__at", F.concat_ws(":", "band", "side"))
    sizes = long.groupBy(F.col("__at").alias("__bucket")).agg(F.ceil(F.count("*") / rows_per_block).cast("int").alias("n"), F.count("*").alias("rows"))
    placed = lookup(long, cut(sizes.filter("rows > 1").drop("rows")), "__at", "__bucket", "inner", counts=long.select("__at"))
    spread = placed.withColumn("b", F.pmod(F.xxhash64(F.lit(3), "k"), F.col("n")).cast("int")).withColumn("o", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    spread = spread.select("band", "side", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "k", "v", "s")

    def compare(bucket: tuple, t: pa.Table) -> pa.Table:
        band, _, i, j = (x.as_py() for x in bucket)
        ids, blocks, sides = t["k"].to_numpy(), t["b"].to_numpy(), np.array(t["s"].to_pylist())
        vectors = t["v"].to_numpy().view(np.uint64) if how == "hamming" else np.array(t["v"].to_pylist(), float)
        left, right = blocks == i, blocks == j
        at, bt, found = _close(ids[left], vectors[left], ids[right], vectors[right], least, how)
        x, y = ids[left][at], ids[right][bt]
        agree = sides[left][at] == sides[right][bt]
        keep = agree.argmax(1) == band if len(at) else np.zeros(0, bool)  # the first band the two share
        if i == j:
            keep &= x < y
        return _pair_table(key, x[keep], y[keep], [f[keep] for f in found])

    spread = spread.repartition(shuffle_width(signed.sparkSession), "band", "side", "i", "j")
    return spread.groupBy("band", "side", "i", "j").applyInArrow(compare, f"{key}_a long, {key}_b long, score double, dy int, dx int")


def near_search(df: DataFrame, key: str, image: str, mask: str, bits: int = 6, least: float = 0.90) -> DataFrame:
    """Near-duplicate candidates of pictures (square, as arrays) with their masks.

    Pairs of different pictures whose hashes are within ``bits`` bits, or whose best shifted
    correlation is at least ``least``; then, at the best shift, the Dice of the masks, and
    the evidence. Pairs without any evidence are no candidates. Equal pictures count once,
    by their smallest id and its mask (see ``representatives``), so copies form no pairs.
    The correlation has no key to join on and is exhaustive over blocks; hashes are joined
    by bands. Rows with a null are left out.
    """
    held = df.select(F.col(key).alias("__k"), F.col(image).cast("array<double>").alias("__v"), F.col(mask).cast("array<int>").alias("__m")).filter("__k is not null and __v is not null and __m is not null")
    held = cut(held.groupBy("__v").agg(F.min(F.struct("__k", "__m")).alias("r")).select("r.__k", "__v", "r.__m"))
    hashed = held.withColumn("__h", bits_above_median(F.col("__v")))
    close = all_hamming_pairs(hashed, "__k", "__h", bits).select("__k_a", "__k_b")
    alike = block_pairs(held, "__k", "__v", least, how="aligned").select("__k_a", "__k_b")
    pairs = cut(close.unionByName(alike).distinct())
    for side in "ab":
        own = hashed.select(F.col("__k").alias(f"__id_{side}"), F.col("__v").alias(f"v{side}"), F.col("__m").alias(f"m{side}"), F.col("__h").alias(f"h{side}"))
        pairs = pairs.join(own, F.col(f"__k_{side}") == F.col(f"__id_{side}")).drop(f"__id_{side}")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            cols = {n: b.column(i) for i, n in enumerate(b.schema.names)}
            va, vb, ma, mb = (np.array(cols[n].to_pylist(), float) for n in ("va", "vb", "ma", "mb"))
            side = int(round(va.shape[1] ** 0.5))
            norm = np.linalg.norm(va - va.mean(1, keepdims=True), axis=1) * np.linalg.norm(vb - vb.mean(1, keepdims=True), axis=1)
            zero = np.divide(((va - va.mean(1, keepdims=True)) * (vb - vb.mean(1, keepdims=True))).sum(1), norm, out=np.zeros(len(va)), where=norm > 0)
            best, dy, dx = aligned(va, vb, side)
            dice = [shifted_dice(x.reshape(side, side), y.reshape(side, side), int(p), int(q)) for x, y, p, q in zip(ma, mb, dy, dx, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [cols["__k_a"], cols["__k_b"], cols["ha"], cols["hb"], pa.array(zero), pa.array(best), pa.array(dy.astype(np.int32)), pa.array(dx.astype(np.int32)), pa.array(dice, pa.float64())],
                names=["a", "b", "ha", "hb", "zero", "best", "dy", "dx", "dice"],
            )

    slim = pairs.select(F.col("__k_a").cast("long"), F.col("__k_b").cast("long"), "va", "vb", "ma", "mb", "ha", "hb")
    scored = slim.mapInArrow(score, "a long, b long, ha long, hb long, zero double, best double, dy int, dx int, dice double")
    distance = hamming(F.col("ha"), F.col("hb"))
    why = evidence(distance, F.col("best"), F.col("dice"), bits)
    return scored.select(
        candidate_id(F.col("a").cast("string"), F.col("b").cast("string")).alias("candidate_id"), F.col("a").alias("sample_a"), F.col("b").alias("sample_b"), distance.alias("phash_distance"), F.bround("zero", 8).alias("zero_shift_correlation"),
        F.bround("best", 8).alias("aligned_correlation"), F.col("dy").alias("alignment_dy"), F.col("dx").alias("alignment_dx"), F.bround("dice", 8).alias("registered_mask_dice"), why.alias("evidence"),
    ).filter("evidence <> ''")


def shifted_dice(a: np.ndarray, b: np.ndarray, dy: int, dx: int) -> float:
    """Dice of two masks where they overlap at a shift; two empty ones agree fully."""
    h, w = a.shape
    u = a[max(0, dy) : h + min(0, dy), max(0, dx) : w + min(0, dx)] > 0
    v = b[max(0, -dy) : h + min(0, -dy), max(0, -dx) : w + min(0, -dx)] > 0
    size = int(u.sum()) + int(v.sum())
    return 1.0 if size == 0 else float(2 * (u & v).sum() / size)


def exact_members(df: DataFrame, digest: str, key: str) -> DataFrame:
    """(exact_group, digest, key, members) in long form: a row a member, so a digest that a
    third of all rows share is no single row."""
    held = df.filter(F.col(digest).isNotNull() & (F.col(digest) != "")).select(digest, key)
    sizes = held.groupBy(digest).agg(F.count("*").alias("members")).filter("members > 1")
    numbered = number_in_order(sizes, digest, "exact_group", "exact").withColumnRenamed(digest, "__d")
    return lookup(held, numbered, digest, "__d", "inner").select("exact_group", digest, key, "members")


def mask_dice(a: Column, b: Column) -> Column:
    """Dice of two 0/1 arrays; two empty masks agree fully."""
    both = F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0).cast("long"), lambda s, x: s + x)
    size = F.aggregate(a, F.lit(0).cast("long"), lambda s, x: s + x) + F.aggregate(b, F.lit(0).cast("long"), lambda s, x: s + x)
    return F.when(size == 0, 1.0).otherwise(2.0 * both / size)


def evidence(distance: Column, correlation: Column, dice: Column, bits: int = 6, high: float = 0.95, low: float = 0.90, overlap: float = 0.70) -> Column:
    """Why a pair is a near-duplicate candidate, ``;``-joined in fixed order; empty if not."""
    parts = F.array_compact(F.array(
        F.when(distance <= bits, F.lit(f"phash_le_{bits}")), F.when(correlation >= high, F.lit(f"aligned_corr_ge_{high:.2f}")),
        F.when((correlation >= low) & (dice >= overlap), F.lit(f"corr_ge_{low:.2f}_and_mask_dice_ge_{overlap:.2f}")),
    ))
    return F.when((distance > bits) & (correlation < low), "").otherwise(F.array_join(parts, ";"))


def candidate_id(a: Column, b: Column) -> Column:
    return F.concat(F.lit("near_"), F.substring(F.sha2(F.concat_ws("|", F.least(a, b), F.greatest(a, b)), 256), 1, 12))


def phash_of_images(side: int = 32):
    """Perceptual hash of gray images (height, width, bytes): area resize, DCT, median bit."""
    n = np.arange(side)
    basis = np.cos(np.pi * (2 * n[None, :] + 1) * n[:, None] / (2 * side)) * np.sqrt(2 / side)
    basis[0] /= np.sqrt(2)

    @F.pandas_udf("long")
    def run(batches: Iterator[tuple]) -> Iterator:
        import pandas as pd

        from maskmill.operators.images import resize_area

        for heights, widths, data in batches:
            out = []
            for h, w, d in zip(heights, widths, data, strict=True):
                small = resize_area(np.frombuffer(d, np.uint8).reshape(h, w).astype(float), side, side)
                low = (basis @ small @ basis.T)[:8, :8].ravel()
                bits = low > np.median(low[1:])
                out.append(int(np.packbits(bits).view(">u8")[0].astype(np.uint64).view(np.int64)))
            yield pd.Series(out, dtype="int64")

    return run
