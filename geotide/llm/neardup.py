"""Near-duplicate documents by b-bit MinHash.

A document is the set of its distinct word shingles. Its signature has ``bands * rows`` minima; each run of ``rows``
minima is a band key, and of each minimum only the low ``bits`` bits are kept, packed in longs. Texts with equal sets
are one class. Classes that share a band key are candidates; the share of equal packed fields, found by bit counts and
corrected for chance collisions (2**-bits), estimates their similarity and drops hopeless ones. Links are confirmed on
the full sets.

Groups are never expanded into all pairs. First every member of a bucket is compared with the bucket's smallest class
only, then with the smallest of a hashed part of the bucket, and the confirmed links give components. What a bucket
still holds in different components is then compared across components, less the pairs whose similarities to the
common leader rule a link out (1 - similarity is a metric) and those whose intersection is bounded below a link's, by
the shingles that no other of these sets has and by bit counts of the sets' marks. So each link between candidates is
found or implied by links found, at the cost of a star for groups of copies. A leader of many members is read by hashed
parts of them, and a crowded bucket is compared by pairs of parts, so that no key holds a large group.

With 32 bands of 4 rows a pair at similarity 0.75 shares no band with a chance of 5e-6; an estimate below ``floor``
(0.5) at a true 0.75 lies more than five standard deviations off.

Texts that are null or without words have the empty set and link with nothing. A text shorter than a shingle is one
shingle. Rows with one id count as that document. Rows without id link as others do and are named by the smallest id
of their group, or have none. Shingles are 64-bit hashes; classes are named by 64 bits of the set's hash.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .components import components
from .runtime import LITTLE, drop, ready, table
from .words import blocks, mix, shingles


@dataclass(frozen=True)
class Settings:
    words: int = 5
    percent: int = 75
    bands: int = 32
    rows: int = 4
    bits: int = 2
    floor: float = 0.5
    part: int = 16
    marks: int = 1024
    crowd: int = 1024

    @property
    def longs(self) -> int:
        return self.bands * self.rows * self.bits // 64


def _signature(s: np.ndarray, cfg: Settings, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    least = np.full(len(a), 2**32 - 1, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    for at in range(0, len(x), 4096):
        least = np.minimum(least, (a[:, None] * x[None, at : at + 4096] + b[:, None]).min(axis=1))
    return least


def _bands(least: np.ndarray, cfg: Settings) -> np.ndarray:
    h = np.arange(cfg.bands, dtype=np.uint64)
    for k in range(cfg.rows):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + least.reshape(cfg.bands, cfg.rows)[:, k])
    return h


def _pack(least: np.ndarray, cfg: Settings) -> np.ndarray:
    low = mix(least.astype(np.uint64)) & np.uint64((1 << cfg.bits) - 1)
    per = 64 // cfg.bits
    return (low.reshape(-1, per) << (np.arange(per, dtype=np.uint64) * np.uint64(cfg.bits))).sum(axis=1, dtype=np.uint64)


def _set_key(s: np.ndarray) -> int:
    return int(mix(np.array([mix(s).sum(dtype=np.uint64) ^ np.uint64(len(s))]))[0].astype(np.int64))


def _features(cfg: Settings):
    rs = np.random.RandomState(5)
    a = rs.randint(0, 2**31, cfg.bands * cfg.rows).astype(np.uint32) * np.uint32(2) + np.uint32(1)
    b = rs.randint(0, 2**32, cfg.bands * cfg.rows, dtype=np.int64).astype(np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, sigs, bands = [], [], [], []
            for block in blocks(batch.column(1).to_pylist()):
                for i in range(len(block)):
                    s = np.unique(shingles(block.words(i), cfg.words))
                    n.append(len(s))
                    if not len(s):
                        keys.append(None), sigs.append(None), bands.append(None)
                        continue
                    least = _signature(s, cfg, a, b)
                    keys.append(_set_key(s))
                    sigs.append(_pack(least, cfg).view(np.int64))
                    bands.append(_bands(least, cfg).view(np.int64))
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.int64()), pa.array(sigs, longs), pa.array(bands, longs)], ["doc_id", "n_shingles", "class", "sig", "bands"])

    return run


def _marks(s: np.ndarray, n: int) -> np.ndarray:
    """A bit for each of ``n`` remainders that the set's shingles have, packed."""
    on = np.zeros(n, np.uint8)
    on[(s % np.uint64(n)).astype(np.int64)] = 1
    return np.packbits(on).view(np.int64)


def _sets(cfg: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(0).to_pylist()):
                own = [np.unique(shingles(block.words(i), cfg.words)) for i in range(len(block))]
                own = [s for s in own if len(s)]
                longs = pa.list_(pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([_set_key(s) for s in own], pa.int64()), pa.array([s.view(np.int64) for s in own], longs), pa.array([_marks(s, cfg.marks) for s in own], longs)], ["class", "set", "marks"])

    return run


def estimate(x: Column, y: Column, cfg: Settings) -> Column:
    """Similarity from packed signatures: equal fields by bit counts, less chance collisions."""
    odd = int(sum(1 << k for k in range(0, 64, cfg.bits)))
    mask = F.lit(odd - (1 << 64) if odd >> 63 else odd)
    differ = F.lit(0)
    for k in range(cfg.longs):
        d = x[k].bitwiseXOR(y[k])
        folded = d
        for s in range(1, cfg.bits):
            folded = folded.bitwiseOR(F.shiftrightunsigned(d, s))
        differ = differ + F.bit_count(folded.bitwiseAND(mask))
    chance = 2.0**-cfg.bits
    return (1 - differ / float(cfg.bands * cfg.rows) - chance) / (1 - chance)


def _dealt(pairs: DataFrame, table_: DataFrame, value: str, name: str) -> DataFrame:
    """``pairs`` with the ``value`` of their class a as ``name``. A class of many pairs is read by each of its parts alone: the
    parts are the root of the pairs, so neither a part nor the parts of one class are many."""
    parts = pairs.select("a", "part").distinct().join(table_.select(F.col("class").alias("a"), F.col(value).alias(name)), "a")
    return pairs.join(parts, ["a", "part"])


def _confirm(pairs: DataFrame, sets: DataFrame, cfg: Settings) -> DataFrame:
    """Pairs (a, b, part) of classes with the size of their sets' union and intersection."""
    both = _dealt(pairs.join(sets.select(F.col("class").alias("b"), F.col("set").alias("_y")), "b"), sets, "set", "_x")
    common = F.size(F.array_intersect("_x", "_y"))
    return both.select("a", "b", common.alias("common"), (F.size("_x") + F.size("_y")).alias("sizes")).select("a", "b", "common", (F.col("sizes") - F.col("common")).alias("either")).distinct()


def _likely(pairs: DataFrame, sigs: DataFrame, cfg: Settings) -> DataFrame:
    """The pairs (a, b, part) whose signatures do not rule a link out."""
    both = _dealt(pairs.join(sigs.select(F.col("class").alias("b"), F.col("sig").alias("_y")), "b"), sigs, "sig", "_x")
    return both.filter(estimate(F.col("_x"), F.col("_y"), cfg) >= cfg.floor).select("a", "b", "part")


def _parted(pairs: DataFrame, n: Column) -> DataFrame:
    """Distinct pairs (a, b) with the part of a's pairs that b falls in, a having up to ``n`` of them."""
    most = pairs.groupBy("a", "b").agg(F.max(n).alias("_n"))
    return most.select("a", "b", F.pmod(F.xxhash64("b"), F.ceil(F.sqrt("_n"))).alias("part"))


def _needed(spark: SparkSession, docs: DataFrame, classes: DataFrame, pairs: DataFrame, cfg: Settings) -> DataFrame:
    """Full sets of the classes in ``pairs``, from the texts that carry a class's smallest id."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct()
    ids = classes.join(nodes, "class").select(F.col("id").alias("_gt_id")).distinct().hint("shuffle_hash")
    texts = docs.join(ids, F.col("doc_id").eqNullSafe(F.col("_gt_id")), "left_semi").select(F.col("text").cast("binary").alias("text"))
    return table(spark, texts.mapInArrow(_sets(cfg), "class long, set array<long>, marks array<long>"), "sets")


def _unresolved(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members (band, class, leader) of the buckets with several components, with component and the bucket's size n."""
    named = members.drop("n").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    open_ = named.groupBy("band").agg(F.min("component").alias("_lo"), F.max("component").alias("_hi"), F.count(F.lit(1)).alias("n")).filter("_lo <> _hi and n > 2").select("band", "n")
    return named.join(open_, "band")


def _shared(sets: DataFrame) -> DataFrame:
    """For each class of ``sets``: its set's size, how many of its shingles stand in another class's set too, its marks."""
    each = sets.select("class", F.explode("set").alias("shingle"))
    alone = each.groupBy("shingle").agg(F.min("class").alias("class"), F.max("class").alias("_hi")).filter("class = _hi")
    alone = alone.groupBy("class").agg(F.count(F.lit(1)).alias("_alone"))
    one = sets.groupBy("class").agg(F.max(F.size("set")).alias("size"), F.any_value("marks").alias("marks"))
    one = one.withColumn("marked", F.aggregate("marks", F.lit(0), lambda n, m: n + F.bit_count(m)))
    return one.join(alone, "class", "left").select("class", "size", (F.col("size") - F.coalesce("_alone", F.lit(0))).alias("shared"), "marks", "marked")


def _across(cfg: Settings):
    """Of rows ordered by (band, low, high), each such key's pairs of different components that may be linked.

    A row of part m stands under the keys of all pairs of parts with m in them; pairs within a part meet where low = high.
    """
    odd = np.uint64(sum(1 << k for k in range(0, 64, cfg.bits)))
    chance = 2.0**-cfg.bits
    span = (100 - cfg.percent) / 100 + 1e-9

    def pairs(r: dict[str, np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        n, cross = len(r["class"]), r["low"][0] != r["high"][0]
        step = max(1, (1 << 20) // n)
        for at in range(0, n - 1, step):
            apart = r["component"][at : at + step, None] != r["component"][None, at + 1 :]
            apart &= np.arange(at + 1, n)[None, :] > np.arange(at, min(n, at + step))[:, None]
            if cross:
                apart &= r["mine"][at : at + step, None] != r["mine"][None, at + 1 :]
            i, j = np.nonzero(apart)
            i, j = i + at, j + at + 1
            keep = ~(np.abs(r["far"][i] - r["far"][j]) > span)  # not a number, where one distance is unknown: kept
            i, j = i[keep], j[keep]
            for lo in range(0, len(i), 1 << 18):
                p, q = i[lo : lo + (1 << 18)], j[lo : lo + (1 << 18)]
                need = (r["size"][p] + r["size"][q]) * cfg.percent
                keep = np.minimum(r["shared"][p], r["shared"][q]) * (100 + cfg.percent) >= need
                p, q, need = p[keep], q[keep], need[keep]
                d = r["sig"][p] ^ r["sig"][q]
                for s in range(1, cfg.bits):
                    d = d | ((r["sig"][p] ^ r["sig"][q]) >> np.uint64(s))
                differ = np.bitwise_count(d & odd).sum(axis=1, dtype=np.int64)
                keep = (1 - differ / float(cfg.bands * cfg.rows) - chance) / (1 - chance) >= cfg.floor
                p, q, need = p[keep], q[keep], need[keep]
                # A mark that one set alone has is at least one shingle that it has alone.
                both = np.bitwise_count(r["marks"][p] & r["marks"][q]).sum(axis=1, dtype=np.int64)
                lone = r["size"] - r["marked"]
                keep = (np.minimum(lone[p], lone[q]) + both) * (100 + cfg.percent) >= need
                yield r["class"][p[keep]], r["class"][q[keep]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in itertools.chain(batches, [None]):
            if batch is not None:
                held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
            if held is None or not len(held):
                continue
            r = {c: held[c].combine_chunks() for c in held.column_names}
            r = {c: x.flatten().to_numpy().view(np.uint64).reshape(len(held), -1) if c in ("sig", "marks") else x.to_numpy(zero_copy_only=False) for c, x in r.items()}
            new = (np.diff(r["band"]) != 0) | (np.diff(r["low"]) != 0) | (np.diff(r["high"]) != 0)
            ends = np.flatnonzero(new) + 1
            if batch is None:
                ends = np.append(ends, len(held))
            found = []
            for lo, hi in zip([0, *ends[:-1].tolist()], ends.tolist()):
                if hi - lo > 1:
                    found += [x for x in pairs({c: x[lo:hi] for c, x in r.items()}) if len(x[0])]
                if found and (hi == ends[-1] or sum(len(a) for a, _ in found) > 1 << 20):
                    a, b = (np.concatenate(x) for x in zip(*found))
                    ab = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b))), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in ab], ["a", "b"])
                    found = []
            held = held.slice(ends[-1]) if len(ends) else held

    return run


def _stars(labels: DataFrame) -> DataFrame:
    return labels.filter("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def near_duplicates(spark: SparkSession, docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest id that links reach), kept, for each row of ``docs`` (doc_id, text)."""
    ready(spark, LITTLE)
    docs = docs.select("doc_id", "text")
    found = docs.select(F.col("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_features(cfg), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_shingles long, class long, sig array<long>, bands array<long>")
    found = table(spark, found, "features")
    classes = found.filter("class is not null").groupBy("class").agg(F.min("doc_id").alias("id"), F.any_value("sig").alias("sig"), F.any_value("bands").alias("bands"))
    classes = table(spark, classes, "classes")
    keyed = classes.select("class", F.explode("bands").alias("band"))
    shared = keyed.groupBy("band").agg(F.min("class").alias("leader"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = table(spark, keyed.join(shared, "band").filter("class is not null"), "members")
    sigs = classes.select("class", "sig")
    stars = _parted(members.filter("class <> leader").select(F.col("leader").alias("a"), F.col("class").alias("b"), "n"), F.col("n"))
    stars = table(spark, _likely(stars, sigs, cfg), "stars")
    linked = F.col("common") * 100 >= F.col("either") * cfg.percent
    sets = _needed(spark, docs, classes, stars, cfg)
    tested = table(spark, _confirm(stars, sets, cfg), "tested")
    drop(spark, sets), drop(spark, stars)
    links = tested.filter(linked).select("a", "b")
    labels = table(spark, components(spark, links), "labels")

    # Buckets that still hold several components: members meet the leaders of small parts of the bucket, chosen anew
    # by hash in each band, so that a large group with many links falls into one component for the most part.
    rest = table(spark, _unresolved(members, labels), "rest")
    part = F.pmod(F.xxhash64("class", "band"), F.ceil(F.col("n") / cfg.part))
    small = rest.withColumn("part", part)
    heads = small.groupBy("band", "part").agg(F.min_by(F.struct("class", "component"), "class").alias("head"))
    met = small.join(heads, ["band", "part"]).filter("head.component <> component").select(F.least("head.class", "class").alias("a"), F.greatest("head.class", "class").alias("b")).distinct()
    met = met.join(tested.select("a", "b"), ["a", "b"], "left_anti")
    met = table(spark, _likely(_parted(met, F.lit(cfg.part * cfg.bands)), sigs, cfg), "met")
    if not met.isEmpty():
        sets = _needed(spark, docs, classes, met, cfg)
        more = table(spark, _confirm(met, sets, cfg), "tested")
        drop(spark, sets), drop(spark, met)
        tested = tested.unionByName(more)
        labels = table(spark, components(spark, _stars(labels).unionByName(more.filter(linked).select("a", "b"))), "labels")

    # What is left is compared pair by pair across components, unless distances to a common leader rule it out.
    # Shingles that stand in one set only, and marks that one of two sets lacks, bound an intersection too.
    rest = table(spark, _unresolved(members, labels).filter("class <> leader"), "rest")
    sets = _needed(spark, docs, classes, rest.select(F.col("class").alias("a"), F.col("class").alias("b")), cfg)
    shared = table(spark, _shared(sets).filter(F.col("shared") * 100 >= F.col("size") * cfg.percent), "shared")
    far = tested.select(F.col("a").alias("leader"), F.col("b").alias("class"), (1 - F.col("common") / F.col("either")).alias("far"))
    rest = rest.join(shared, "class").join(far, ["leader", "class"], "left").join(sigs, "class")
    # A crowded bucket is cut in parts, and each pair of parts meets under a key of its own.
    rest = rest.withColumn("_parts", F.ceil(F.sqrt(F.col("n") / cfg.crowd))).withColumn("mine", F.pmod(F.xxhash64("class"), F.col("_parts")))
    rest = rest.withColumn("_other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_parts") - 1)))
    rest = rest.select("band", F.least("mine", "_other").alias("low"), F.greatest("mine", "_other").alias("high"), "mine", "class", "component", "sig", "far", F.col("size").cast("long").alias("size"), F.col("shared").cast("long").alias("shared"), F.col("marked").cast("long").alias("marked"), "marks")
    cross = rest.repartition("band", "low", "high").sortWithinPartitions("band", "low", "high").mapInArrow(_across(cfg), "a long, b long").distinct()
    cross = table(spark, cross.join(tested.select("a", "b"), ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        more = _confirm(cross.withColumn("part", F.pmod(F.xxhash64("b"), F.lit(cfg.part))), sets, cfg).filter(linked).select("a", "b")
        labels = table(spark, components(spark, _stars(labels).unionByName(more)), "labels")
    of_class = classes.select("class", "id").join(labels.withColumnRenamed("node", "class"), "class", "left").withColumn("component", F.coalesce("component", "class"))
    least = of_class.groupBy("component").agg(F.min("id").alias("component_id"))
    names = table(spark, of_class.join(least, "component").select("class", "component_id"), "names")
    for done in (classes, members, sets, shared, cross):
        drop(spark, done)
    # Rows with an empty set have no class: they stand alone.
    out = found.select("doc_id", "n_shingles", "class").join(names, "class", "left")
    out = out.withColumn("component_id", F.when(F.col("class").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()).alias("kept"))


def one_of_each(spark: SparkSession, docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """``docs`` less the documents whose group has a smaller id; of the rows of a kept id one stays.

    Rows without id go when their group has an id, else they stay.
    """
    judged = table(spark, near_duplicates(spark, docs, cfg), "judged")
    gone = judged.filter("not kept").select(F.col("doc_id").alias("_gt_id")).distinct()
    left = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_gt_id")), "left_anti")
    again = judged.filter("kept and doc_id is not null").groupBy(F.col("doc_id").alias("_gt_id")).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1").select("_gt_id")
    if again.isEmpty():
        return left
    once = left.join(again, F.col("doc_id") == F.col("_gt_id"), "left_semi").dropDuplicates(["doc_id"])
    return left.join(again, F.col("doc_id") == F.col("_gt_id"), "left_anti").unionByName(once)
