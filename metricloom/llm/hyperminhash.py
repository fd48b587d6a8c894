"""Near-duplicates by HyperMinHash: banded compressed registers, estimate, exact check, classes.

A text's set holds its distinct two-word shingles. Its sketch has ``BANDS`` groups of ``ROWS``
buckets; in each group every shingle is hashed into one bucket, and a bucket keeps of its smallest
hash value only the number of leading zeros and ``MANTISSA`` bits (an empty bucket is a value of its
own). Texts that agree in all registers of a group are candidates. A link at similarity 0.8 is
missed by all bands with probability (1 - 0.8^6)^46 < 1e-6.

Candidates are compared with one member per bucket, the centre, chosen anew by hash in each band, so a
group of n copies costs about n pairs a band and never all pairs. Each pair passes a size bound, the
collision-corrected estimate (five standard errors of slack) and then the exact check on full sets.

A bucket may still hold members of several classes: texts that share a long passage with a large group,
or near misses. Its commonest class is its home; every member of another class is a stray of that home.
Once per home, strays are compared exactly with all members of its mixed buckets, in blocks of bounded
size whose tasks count common shingles by posting lists and return only links.

Defined cases: null, empty and blank texts have no set, link with nothing and stay; a text of one
word has the word as its set; repeated rows are copies of each other; a null identifier never is a
class's smallest unless all are null; an empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.store import fresh, written
from metricloom.llm.tokens import NON_SPACE, mix, pieces, words

BANDS, ROWS, MANTISSA = 46, 6, 10
_VALUE_BITS = 40
EMPTY = 0xFFFF
_SEEDS = np.random.default_rng(7).integers(1, 2**64, (BANDS, 2), np.uint64) | np.uint64(1)
_FACTORS = np.random.default_rng(8).integers(1, 2**64, ROWS + 1, np.uint64) | np.uint64(1)
_A, _B, _C = (np.uint64(x) for x in (0x9FB21C651E98DF25, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F))


def shingles(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text begins."""
    found = words(texts, NON_SPACE)
    h, bounds = found.hashes(), found.bounds
    count = np.diff(bounds)
    parts = []
    with np.errstate(over="ignore"):
        pair = mix(h[:-1] * _A + h[1:] * _B) if len(h) else h
        for first, n in zip(bounds[:-1].tolist(), count.tolist(), strict=True):
            part = pair[first : first + n - 1] if n > 1 else mix(h[first : first + n] * _C)
            part = np.sort(part)
            if n > 2:
                keep = np.empty(len(part), bool)
                keep[0] = True
                np.not_equal(part[1:], part[:-1], out=keep[1:])
                part = part[keep]
            parts.append(part)
    sizes = np.fromiter((len(p) for p in parts), np.int64, len(parts))
    return (np.concatenate(parts) if parts else h), np.concatenate([[0], np.cumsum(sizes)])


def registers(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Registers (texts x BANDS x ROWS) of shingle sets."""
    texts = len(bounds) - 1
    at = np.repeat(np.arange(texts) * ROWS, np.diff(bounds))
    least = np.full((BANDS, texts * ROWS), 2**_VALUE_BITS, np.int64)
    low = np.uint64(2**_VALUE_BITS - 1)
    for g in range(BANDS):
        x = values * _SEEDS[g, 0] + _SEEDS[g, 1]
        x = (x ^ (x >> np.uint64(32))) * _SEEDS[g, 1]
        x ^= x >> np.uint64(29)
        bucket = ((x >> np.uint64(40)) * np.uint64(ROWS)) >> np.uint64(24)
        np.minimum.at(least[g], at + bucket.astype(np.int64), (x & low).astype(np.int64))
    fraction, exponent = np.frexp(np.maximum(least, 1).astype(np.float64))
    packed = ((_VALUE_BITS - exponent) << MANTISSA) | ((fraction * 2 - 1) * 2**MANTISSA).astype(np.int64)
    packed[least == 2**_VALUE_BITS] = EMPTY
    return packed.astype(np.uint16).reshape(BANDS, texts, ROWS).transpose(1, 0, 2)


def _set_keys(values: np.ndarray, bounds: np.ndarray) -> list[np.ndarray]:
    """128 bits that name a set."""
    keys = []
    for factor in (_A, _C):
        sums = np.zeros(len(bounds) - 1, np.uint64)
        full = bounds[:-1] < bounds[1:]
        if full.any():
            sums[full] = np.add.reduceat(mix(values * factor + _B), bounds[:-1][full])
        keys.append(mix(sums + np.diff(bounds).astype(np.uint64)).view(np.int64))
    return keys


SKETCH = "doc_id {id}, n long, k1 long, k2 long, bands array<long>, sketch binary"


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text"):
        values, bounds = shingles(part.column("text"))
        regs = np.ascontiguousarray(registers(values, bounds))
        wide = regs.astype(np.uint64)
        keys = wide @ _FACTORS[:ROWS] + np.arange(1, BANDS + 1, dtype=np.uint64) * _FACTORS[ROWS]
        keys = mix(keys).view(np.int64)
        k1, k2 = _set_keys(values, bounds)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel()))
        raw = regs.tobytes()
        sketch = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(np.arange(0, len(raw) + 1, BANDS * ROWS * 2, dtype=np.int32)), pa.py_buffer(raw)])
        yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(bounds)), pa.array(k1), pa.array(k2), bands, sketch], names=["doc_id", "n", "k1", "k2", "bands", "sketch"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part in pieces(batches, "text"):
        values, bounds = shingles(part.column("text"))
        k1, k2 = _set_keys(values, bounds)
        full = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer((bounds * 8).astype(np.int32)), pa.py_buffer(values.tobytes())])
        yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), full], names=["k1", "k2", "shingles"])


def estimate(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Similarity of sketches (rows x registers) of sets of ``n`` and ``m`` members.

    Of the registers that one of the two fills, a share J agrees because of a common smallest member.
    Others agree by chance: with rates n and m of the smallest values, two independent ones fall into
    one cell of width 2^-MANTISSA of their magnitude with probability 0.72 * 2^-MANTISSA * nm/(n+m)^2.
    """
    filled = ((a != EMPTY) | (b != EMPTY)).sum(1)
    equal = ((a == b) & (a != EMPTY)).sum(1) / np.maximum(filled, 1)
    chance = 0.5 / np.log(2) * 2.0**-MANTISSA * (n * m) / np.maximum(n + m, 1.0) ** 2
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def _near(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    registers_each = BANDS * ROWS
    for batch in batches:
        if batch.num_rows == 0:
            continue
        a, b = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint16).reshape(-1, registers_each) for c in ("sketch_a", "sketch_b"))
        n, m = (batch.column(c).to_numpy().astype(float) for c in ("n_a", "n_b"))
        filled = np.maximum(((a != EMPTY) | (b != EMPTY)).sum(1), 1)
        slack = 5 * np.sqrt(threshold * (1 - threshold) / filled)
        yield batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(estimate(a, b, n, m) >= threshold - slack))


def _linked(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        keep = []
        for x, y in zip(batch.column("shingles_a").to_pylist(), batch.column("shingles_b").to_pylist(), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            both = np.sort(np.concatenate([x, y]))
            common = int((both[1:] == both[:-1]).sum())
            keep.append(100 * common >= percent * (len(x) + len(y) - common))
        yield batch.select(["a1", "a2", "b1", "b2"]).filter(pa.array(keep, pa.bool_()))


_PAIR = "a1 long, a2 long, b1 long, b2 long"
_ID = ["k1", "k2"]


def _sides(pairs: DataFrame, table: DataFrame, columns: list[str]) -> DataFrame:
    """The pairs with columns of both of their sets."""
    for side in "ab":
        own = table.select(F.col("k1").alias(f"{side}1"), F.col("k2").alias(f"{side}2"), *[F.col(c).alias(f"{c}_{side}") for c in columns])
        pairs = pairs.join(own, [f"{side}1", f"{side}2"])
    return pairs


def _ordered(x1: Column, x2: Column, y1: Column, y2: Column) -> list[Column]:
    first = (x1 < y1) | ((x1 == y1) & (x2 < y2))
    return [F.when(first, x).otherwise(y).alias(c) for x, y, c in ((x1, y1, "a1"), (x2, y2, "a2"), (y1, x1, "b1"), (y2, x2, "b2"))]


BLOCK, STRAYS = 512, 2048


def _blocks(percent: int):
    """Links between the strays and the members of one block."""

    def run(table: pa.Table) -> pa.Table:
        side = table["stray"].to_numpy()
        k1, k2 = (table[c].to_numpy() for c in _ID)
        sets = [np.frombuffer(x, np.uint64) for x in table["shingles"].to_pylist()]
        members, strays = np.flatnonzero(~side), np.flatnonzero(side)
        sizes = np.array([len(sets[i]) for i in members], np.int64)
        flat = np.concatenate([np.zeros(0, np.uint64), *[sets[i] for i in members]])
        order = np.argsort(flat, kind="stable")
        values, owner = flat[order], np.repeat(np.arange(len(members)), sizes)[order]
        out = []
        for i in strays:
            low, high = np.searchsorted(values, sets[i], "left"), np.searchsorted(values, sets[i], "right")
            count = high - low
            at = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
            common = np.bincount(owner[at], minlength=len(members))
            for j in members[100 * common >= percent * (sizes + len(sets[i]) - common)]:
                x, y = (int(k1[i]), int(k2[i])), (int(k1[j]), int(k2[j]))
                if x != y:
                    out.append((*min(x, y), *max(x, y)))
        return pa.table({c: pa.array([r[k] for r in out], pa.int64()) for k, c in enumerate(("a1", "a2", "b1", "b2"))})

    return run


class Matcher:
    """Candidate sets of one run and the checks that pairs of them pass."""

    def __init__(self, docs: DataFrame, sketches: DataFrame, members: DataFrame, percent: int):
        self.percent = percent
        wanted = members.select(*_ID).distinct()
        rows = sketches.join(wanted, _ID, "left_semi").groupBy(*_ID).agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch"))
        self.sets = written(rows, "near-sets")
        # The texts of those sets once more, found by identifier and confirmed by the set's name.
        ids = self.sets.select(F.col("doc_id").alias("id")).distinct()
        texts = docs.join(ids, docs["doc_id"].eqNullSafe(ids["id"]), "left_semi").mapInArrow(_sets, "k1 long, k2 long, shingles binary")
        texts = texts.join(self.sets.select(*_ID), _ID, "left_semi").groupBy(*_ID).agg(F.first("shingles").alias("shingles"))
        self.full = written(texts, "near-shingles")

    def links(self, pairs: DataFrame) -> DataFrame:
        percent = self.percent
        sized = _sides(pairs, self.sets, ["n", "sketch"]).filter(100 * F.least("n_a", "n_b") >= percent * F.greatest("n_a", "n_b"))
        near = sized.mapInArrow(lambda it: _near(it, percent / 100), _PAIR)
        return written(_sides(near, self.full, ["shingles"]).mapInArrow(lambda it: _linked(it, percent), _PAIR), "near-links")

    def strays(self, members: DataFrame, labels: DataFrame) -> DataFrame:
        """Links of members with those of other classes in the buckets they share."""
        own = F.concat(F.hex("k1"), F.lit(":"), F.hex("k2"))
        labelled = members.join(labels, _ID, "left").select("band", *_ID, F.coalesce("label", own).alias("label"))
        mixed = labelled.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high"), F.mode("label", True).alias("home")).filter("low != high")
        own = labelled.join(mixed.select("band", "home"), "band").groupBy("home", *_ID).agg(F.first(F.col("label") != F.col("home")).alias("stray"))
        own = written(own, "near-homes")
        sizes = own.groupBy("home").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("ms"), F.ceil(F.count_if("stray") / STRAYS).alias("ss"))
        dealt = own.join(sizes, "home").join(self.full, _ID)
        place = lambda n: F.pmod(F.xxhash64("k2", "k1"), F.col(n))
        every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
        listed = dealt.select("home", place("ms").alias("m"), every("ss").alias("s"), *_ID, "shingles", F.lit(False).alias("stray"))
        asking = dealt.filter("stray").select("home", every("ms").alias("m"), place("ss").alias("s"), *_ID, "shingles", F.lit(True).alias("stray"))
        return written(listed.unionByName(asking).groupBy("home", "m", "s").applyInArrow(_blocks(self.percent), _PAIR).distinct(), "near-strays")


def classes(links: DataFrame) -> DataFrame:
    """``k1, k2, label``: the label of each linked set's class.

    Every round gives each node its smallest neighbour, or itself, as parent and follows parents once
    more; then links are drawn between parents, and those within one fall away. A group of copies
    shrinks to a few nodes in its first round, so later rounds read next to nothing.
    """
    name = lambda a, b: F.concat(F.hex(a), F.lit(":"), F.hex(b))
    ends = links.select(name("a1", "a2").alias("x"), name("b1", "b2").alias("y"))
    edges = written(ends.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "near-edges")
    labels = edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("label", F.col("node"))
    while edges.limit(1).count():
        # Edges run from the smaller to the larger end.
        parents = edges.groupBy(F.col("v").alias("child")).agg(F.min("u").alias("parent"))
        parents = written(parents, "near-parents")
        above = parents.select(F.col("child").alias("parent"), F.col("parent").alias("grand"))
        parents = written(parents.join(above, "parent", "left").select("child", F.coalesce("grand", "parent").alias("parent")), "near-parents")
        up = lambda c: parents.select(F.col("child").alias(c), F.col("parent").alias(f"{c}_up"))  # noqa: E731, B023
        drawn = edges.join(up("u"), "u", "left").join(up("v"), "v").select(F.coalesce("u_up", "u").alias("x"), F.col("v_up").alias("y"))
        edges = written(drawn.filter("x != y").select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct(), "near-edges")
        labels = written(labels.join(up("label"), "label", "left").select("node", F.coalesce("label_up", "label").alias("label")), "near-labels")
    part = F.split("node", ":")
    back = lambda i: F.conv(part[i], 16, -10).cast("long")
    return labels.select(back(0).alias("k1"), back(1).alias("k2"), "label")


def group(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """One row per input row: ``doc_id, n_shingles, component_id, kept``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    sketches = written(docs.mapInArrow(_sketch, SKETCH.format(id=docs.schema["doc_id"].dataType.simpleString())), "near-sketches")

    # Copies of a set fall together before anything is grouped by band.
    bands = sketches.filter("n > 0").select(F.explode("bands").alias("band"), *_ID).distinct()
    order = F.xxhash64("band", *_ID)
    mixed = bands.groupBy("band").agg(F.min(order).alias("centre"), F.max(order).alias("last")).filter("centre != last").select("band", "centre")
    members = written(bands.join(mixed, "band").withColumn("is_centre", order == F.col("centre")).drop("centre"), "near-members")
    matcher = Matcher(docs, sketches, members, percent)

    centres = members.filter("is_centre").select("band", F.col("k1").alias("c1"), F.col("k2").alias("c2"))
    star = members.filter("not is_centre").join(centres, "band")
    pairs = written(star.select(*_ordered(*[F.col(c) for c in ("k1", "k2", "c1", "c2")])).distinct(), "near-pairs")
    links = matcher.links(pairs)
    labels = classes(links)

    # What the centres left apart although it shares a bucket.
    more = matcher.strays(members, labels)
    if more.limit(1).count():
        labels = classes(links.union(more))

    # Smallest identifier of each class, over all copies of its sets.
    named = sketches.select("doc_id", F.col("n").alias("n_shingles"), *_ID)
    sets = named.filter("n_shingles > 0").groupBy(*_ID).agg(F.min("doc_id").alias("least")).join(labels, _ID, "left")
    linked = sets.filter("label is not null")
    low = linked.groupBy("label").agg(F.min("least").alias("low"))
    # Sets without a link have no label to join on, which would bring them together in one task.
    alone = sets.filter("label is null").select(*_ID, F.col("least").alias("low"))
    found = linked.join(low, "label").select(*_ID, "low").unionByName(alone)
    out = named.join(found, _ID, "left").withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("low")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", percent: int = 80) -> DataFrame:
    """The rows of which one per class stays, with all their columns. Of rows that repeat the kept
    identifier one stays; rows without a set all stay."""
    id_, low, place = fresh(docs, "id_", "low_", "place_")
    found = group(docs, doc_id, text, percent)
    gone = found.filter("not kept").select(F.col("doc_id").alias(id_)).distinct()
    rows = docs.join(gone, docs[doc_id].eqNullSafe(gone[id_]), "left_anti")
    again = found.filter("n_shingles > 0").groupBy("doc_id").count().filter("count > 1").select(F.col("doc_id").alias(id_))
    once = rows.join(again, rows[doc_id].eqNullSafe(again[id_]), "left_semi").dropDuplicates([doc_id])
    return rows.join(again, rows[doc_id].eqNullSafe(again[id_]), "left_anti").unionByName(once).select(*docs.columns)
