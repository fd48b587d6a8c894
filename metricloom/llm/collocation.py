"""Phrases whose words come together more often than apart, counted in a HAT-trie.

Texts are cut at ``.,;:!?`` and line ends into pieces and these at blanks into words; all counts are per
language. A phrase of 2 or 3 words is a candidate from ``LEAST`` occurrences. Its score is the lowest,
over its cuts into two parts, of floor(10^6 * a^2 / (l * r)), in decimal arithmetic.

Counting has three steps.

1. Words. A phrase is never more frequent than one of its words, so only words with ``LEAST``
   occurrences get a number; this is exact. Numbers reach the texts through the blocks' dictionaries.
2. Runs. Each block feeds (first, second, third) word numbers to a HAT-trie: under a shallow trie over
   word numbers hang hash containers of the remaining words with their counts; a container that grows
   beyond ``BURST`` entries bursts into a node with one container per next word. Where the trie holds
   more than ``ROOM`` entries, whole subtrees, the largest first, are spilled as one sorted run. The third
   word is 0 where the piece ends or the next word has no number, so that a pair's count is the sum over
   its thirds.
3. Merge. Runs are cut by prefix (the first two words, hashed to as many parts as the corpus has
   millions of words), shuffled by part and merged there, part by part. A frequent first word is so
   spread over many parts, and a part holds at most a few entries of each block.

Defined cases: null texts are empty; a null language is ``und``, together with that name; repeated rows
count again; an empty table gives an empty result; of other columns nothing is read.
"""

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.blocks import BLOCK_BYTES, Names, coded, packed, unpacked
from metricloom.llm.store import written
from metricloom.llm.tokens import mix, pieces, words

LEAST, TOP = 10, 2000
#: A candidate goes when a longer one that holds its words has at least this share of its occurrences.
ABSORBED_PERCENT = 50
BURST, ROOM = 20_000, 600_000
PART_WORDS = 1_000_000
_NUMBER_BUCKETS = 4096

_BYTES = np.arange(256)
_CUT = np.isin(_BYTES, [ord(c) for c in ".,;:!?"]) | ((_BYTES >= 0x0A) & (_BYTES <= 0x0D))
_WORD = ~(_CUT | (_BYTES == 0x20) | (_BYTES == 0x09))

BLOCKS = "block long, words binary, lang string, number long, word binary, n long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per slice and language: one row with the word numbers (0 between pieces) and the dictionary."""
    names, schema = Names(), pa.schema([("block", pa.int64()), ("words", pa.binary()), ("lang", pa.string()), ("number", pa.int64()), ("word", pa.binary()), ("n", pa.int64())])
    for part in pieces(batches, "text", BLOCK_BYTES):
        for lang in pc.unique(part.column("lang")):
            own = part.filter(pc.equal(part.column("lang"), lang)).column("text").cast(pa.large_binary())
            found = words(own, _WORD)
            if not len(found.starts):
                continue
            own_offsets = np.frombuffer(own.buffers()[1], np.int64)[own.offset : own.offset + len(own) + 1]
            data = np.frombuffer(own.buffers()[2], np.uint8)[own_offsets[0] : own_offsets[-1]]
            cuts = np.cumsum(_CUT[data], dtype=np.int32)[found.starts]
            opens = np.ones(len(cuts), bool)
            opens[1:] = cuts[1:] != cuts[:-1]
            opens[found.bounds[:-1][found.bounds[:-1] < len(opens)]] = True
            told = coded(found)
            stream = np.zeros(len(opens) + int(opens.sum()), np.uint32)
            stream[np.arange(len(opens)) + np.cumsum(opens)] = told.codes
            block, many = names.new(), len(told.terms)
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([packed(stream)], pa.binary()), pa.array([lang.as_py()]), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64())], schema=schema)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(many, block)), pa.nulls(many, pa.binary()), pa.array([lang.as_py()] * many), pa.array(np.arange(1, many + 1)), told.terms, pa.array(told.counts)], schema=schema
            )


class HatTrie:
    """Counts of (first, second, third) word numbers, each below 2^31."""

    def __init__(self, burst: int = BURST, room: int = ROOM):
        self.burst, self.room, self.size = burst, room, 0
        #: First word -> container over second << 32 | third, or node: second word -> container over thirds.
        self.root = {}

    def add(self, first: np.ndarray, rest: np.ndarray) -> None:
        order = np.argsort(first, kind="stable")
        first, rest = first[order], rest[order]
        at = np.flatnonzero(np.diff(first, prepend=-1))
        for key, lo, hi in zip(first[at].tolist(), at.tolist(), [*at[1:].tolist(), len(first)], strict=True):
            child = self.root.get(key)
            if child is None:
                child = self.root[key] = Counter()
            if isinstance(child, Counter):
                before = len(child)
                child.update(rest[lo:hi].tolist())
                self.size += len(child) - before
                if len(child) > self.burst:
                    self.root[key] = self._burst(child)
            else:
                self._below(child, rest[lo:hi])

    def _below(self, node: dict, rest: np.ndarray) -> None:
        rest = np.sort(rest)
        second = rest >> 32
        at = np.flatnonzero(np.diff(second, prepend=-1))
        thirds = (rest & 0xFFFFFFFF).tolist()
        for key, lo, hi in zip(second[at].tolist(), at.tolist(), [*at[1:].tolist(), len(rest)], strict=True):
            leaf = node.get(key)
            if leaf is None:
                leaf = node[key] = Counter()
            before = len(leaf)
            leaf.update(thirds[lo:hi])
            self.size += len(leaf) - before

    @staticmethod
    def _burst(container: Counter) -> dict:
        node = {}
        for key, n in container.items():
            leaf = node.get(key >> 32)
            if leaf is None:
                leaf = node[key >> 32] = Counter()
            leaf[key & 0xFFFFFFFF] = n
        return node

    @staticmethod
    def _weight(child) -> int:
        return len(child) if isinstance(child, Counter) else sum(map(len, child.values()))

    def spill(self, keep: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Takes the largest subtrees out until ``keep`` entries stay: first words, remaining words and
        counts, sorted."""
        weights = {k: self._weight(c) for k, c in self.root.items()}
        firsts, prefixes, leaves = [], [], []
        for key in sorted(weights, key=lambda k: (-weights[k], k)):
            if self.size <= keep:
                break
            self.size -= weights[key]
            child = self.root.pop(key)
            for second, leaf in [(0, child)] if isinstance(child, Counter) else child.items():
                firsts.append(key)
                prefixes.append(second << 32)
                leaves.append(leaf)
        sizes = np.fromiter(map(len, leaves), np.int64, len(leaves))
        total = int(sizes.sum())
        rest = np.fromiter(chain.from_iterable(leaves), np.int64, total) | np.repeat(np.array(prefixes, np.int64), sizes)
        count = np.fromiter(chain.from_iterable(x.values() for x in leaves), np.int64, total)
        first = np.repeat(np.array(firsts, np.int64), sizes)
        order = np.lexsort((rest, first))
        return first[order], rest[order], count[order]


RUNS = "part int, firsts binary, seconds binary, thirds binary, counts binary"
_RUN = pa.schema([("part", pa.int32()), *[(c, pa.binary()) for c in ("firsts", "seconds", "thirds", "counts")]])


def _cut_run(first: np.ndarray, rest: np.ndarray, count: np.ndarray, parts: int) -> pa.Table:
    """A sorted run as one sorted run per part."""
    prefix = (first.astype(np.uint64) << np.uint64(32)) | (rest >> 32).astype(np.uint64)
    part = ((mix(prefix) >> np.uint64(33)) % np.uint64(parts)).astype(np.int32)
    order = np.argsort(part, kind="stable")
    part = part[order]
    at = np.flatnonzero(np.diff(part, prepend=-1))
    bounds = pa.py_buffer((np.append(at, len(part)) * 4).astype(np.int32))
    planes = [first[order], rest[order] >> 32, rest[order] & 0xFFFFFFFF, np.minimum(count[order], 0xFFFFFFFF)]
    columns = [pa.Array.from_buffers(pa.binary(), len(at), [None, bounds, pa.py_buffer(x.astype(np.uint32))]) for x in planes]
    return pa.Table.from_arrays([pa.array(part[at]), *columns], schema=_RUN)


def _count(parts: int, burst: int, room: int):
    def run(block: pa.Table, dictionary: pa.Table) -> pa.Table:
        numbers, ids = (dictionary.column(c).to_numpy() for c in ("number", "id"))
        if len(ids) and ids.max() >= 2**31:
            raise ValueError("more frequent words than numbers")
        trie, runs = HatTrie(burst, room), []
        for raw in block.column("words").to_pylist():
            stream = unpacked(raw)
            known = np.zeros(max(int(stream.max(initial=0)), int(numbers.max(initial=0))) + 3, np.int64)
            known[numbers] = ids
            stream = np.append(known[stream], [0, 0])
            at = np.flatnonzero((stream[:-2] > 0) & (stream[1:-1] > 0))
            for lo in range(0, len(at), 1 << 18):
                here = at[lo : lo + (1 << 18)]
                trie.add(stream[here], (stream[here + 1] << 32) | stream[here + 2])
                if trie.size > room:
                    runs.append(_cut_run(*trie.spill(room // 2), parts))
        runs.append(_cut_run(*trie.spill(), parts))
        return pa.concat_tables(runs)

    return run


GRAMS = "w1 long, w2 long, w3 long, f long"


def merged(runs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], least: int) -> pa.RecordBatch:
    """Phrases of the sorted runs of one part with at least ``least`` occurrences; ``w3`` is null for
    two words."""
    first, rest, count = (np.concatenate([r[i] for r in runs]) for i in range(3))
    # A stable sort of sorted runs, one after the other, is a merge.
    order = np.lexsort((rest, first))
    first, rest, count = first[order], rest[order], count[order]
    at = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(rest, prepend=-1) != 0))
    first, rest, count = first[at], rest[at], np.add.reduceat(count, at)
    second, third = rest >> 32, rest & 0xFFFFFFFF
    pair = np.flatnonzero((np.diff(first, prepend=-1) != 0) | (np.diff(second, prepend=-1) != 0))
    pairs = np.add.reduceat(count, pair)
    two, three = pair[pairs >= least], np.flatnonzero((count >= least) & (third > 0))
    both = np.concatenate([two, three])
    return pa.RecordBatch.from_arrays(
        [pa.array(first[both]), pa.array(second[both]), pa.array(third[both], mask=np.arange(len(both)) < len(two)), pa.array(np.concatenate([pairs[pairs >= least], count[three]]))],
        names=["w1", "w2", "w3", "f"],
    )


def _merge(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by part, so that one part at a time is held."""
        here, runs = None, []
        for batch in batches:
            columns = [batch.column(c) for c in ("firsts", "seconds", "thirds", "counts")]
            for i, part in enumerate(batch.column("part").to_pylist()):
                if part != here and runs:
                    yield merged(runs, least)
                    runs = []
                here = part
                a, b, c, n = (np.frombuffer(x[i].as_py(), np.uint32).astype(np.int64) for x in columns)
                runs.append((a, (b << 32) | c, n))
        if runs:
            yield merged(runs, least)

    return run


def numbered(counts: DataFrame) -> DataFrame:
    """A number from 1 for each row of ``lang, word, f``, dense up to the unevenness of a hash."""
    bucket = F.pmod(F.xxhash64("lang", "word"), F.lit(_NUMBER_BUCKETS))
    place = F.row_number().over(Window.partitionBy("bucket").orderBy("lang", "word"))
    return counts.withColumn("bucket", bucket).withColumn("id", (place * _NUMBER_BUCKETS + F.col("bucket")).cast("long")).drop("bucket")


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(10^6 a^2 / (l r)) in decimals of 38 digits; counts may have up to 16 digits."""
    exact = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", exact(a) * exact(a) * F.lit(1_000_000).cast("decimal(7,0)"), exact(left) * exact(right)).cast("long")


def phrases(docs: DataFrame, text: str = "text", lang: str = "lang", least: int = LEAST, absorbed: int = ABSORBED_PERCENT, burst: int = BURST, room: int = ROOM) -> DataFrame:
    """All candidates that no longer one absorbs: ``lang, phrase, a, l, r, n, score``."""
    own = docs.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    blocks = written(own.mapInArrow(_blocks, BLOCKS), "phrase-blocks")
    dictionary = blocks.filter("word is not null").select("block", "lang", "number", "word", "n")
    counts = dictionary.groupBy("lang", "word").agg(F.sum("n").alias("f"))
    per_lang = dictionary.groupBy("lang").agg(F.sum("n").alias("n"))
    frequent = written(numbered(counts.filter(F.col("f") >= least)), "phrase-words")
    parts = 1 + (dictionary.agg(F.sum("n")).first()[0] or 0) // PART_WORDS

    told = dictionary.join(frequent.select("lang", "word", "id"), ["lang", "word"]).select(F.col("block").alias("of"), "number", "id")
    streams = blocks.filter("words is not null").select("block", "words")
    runs = streams.groupBy("block").cogroup(told.groupBy("of")).applyInArrow(_count(parts, burst, room), RUNS)
    grams = written(runs.repartition("part").sortWithinPartitions("part").mapInArrow(_merge(least), GRAMS), "phrase-grams")

    def one(i: int) -> DataFrame:
        named = [F.col("id").alias(f"w{i}"), F.col("word").cast("string").alias(f"t{i}"), F.col("f").alias(f"f{i}")]
        return frequent.select(*named, *(["lang"] if i == 1 else []))

    pairs = grams.filter("w3 is null").select("w1", "w2", "f")
    triples = grams.filter("w3 is not null")
    inner = lambda x, y: triples.select(F.col(x).alias("w1"), F.col(y).alias("w2"), "f")
    longer = inner("w1", "w2").union(inner("w2", "w3")).groupBy("w1", "w2").agg(F.max("f").alias("longest"))
    two = pairs.join(longer, ["w1", "w2"], "left").filter(F.col("longest").isNull() | (100 * F.col("longest") < absorbed * F.col("f")))
    two = two.join(one(1), "w1").join(one(2), "w2")
    two = two.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), F.col("f").alias("a"), F.col("f1").alias("l"), F.col("f2").alias("r"))
    three = triples.join(pairs.withColumnRenamed("f", "f12"), ["w1", "w2"]).join(pairs.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("f").alias("f23")), ["w2", "w3"])
    three = three.join(one(1), "w1").join(one(2), "w2").join(one(3), "w3")
    cut1, cut2 = score(F.col("f"), F.col("f1"), F.col("f23")), score(F.col("f"), F.col("f12"), F.col("f3"))
    sides = F.when(cut1 <= cut2, F.struct(F.col("f1").alias("l"), F.col("f23").alias("r"))).otherwise(F.struct(F.col("f12").alias("l"), F.col("f3").alias("r")))
    three = three.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), F.col("f").alias("a"), sides.alias("s")).select("lang", "phrase", "a", "s.*")
    found = two.union(three).join(per_lang, "lang")
    return found.select("lang", "phrase", "a", "l", "r", "n", score(F.col("a"), F.col("l"), F.col("r")).alias("score"))


def top(found: DataFrame, most: int = TOP) -> DataFrame:
    """The first phrases of each language, ranked from 1."""
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).filter(F.col("rank") <= most).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
