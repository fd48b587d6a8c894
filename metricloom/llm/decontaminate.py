"""Benchmark decontamination with a distributed positional inverted index.

``build`` cuts the corpus into segments (runs of a task's rows of about ``SEGMENT`` bytes) and stores
for every term of a segment its posting list: the positions of its occurrences, as differences. Next
to the lists stand each segment's rows with the range of positions they own. ``search`` reads only the
lists of test terms, orders the terms of every window by their frequency in the whole corpus, and
intersects the lists, shifted by the term's place in the window, from the rarest term on. A slack of
k positions turns the same intersection into a proximity match.

The test set is a stated query set; its windows go to every segment by broadcast up to
``BROADCAST_BYTES`` and are searched in blocks of that size beyond it.

Defined cases: null, empty and wordless texts have no words and no hits; a wordless item has no
window; repeated rows are each reported; repeated items count once by identifier; items without an
identifier count as one item, whose place among ``items`` is null and which the digest's hash leaves out;
an empty corpus or test set gives rows without hits or no rows.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from metricloom.llm.store import fresh, written
from metricloom.llm.tokens import ALPHANUMERIC, pieces, words

WINDOW = 10
SEGMENT = 8 << 20
BROADCAST_BYTES = 64 << 20
INDEX = "segment long, term binary, n long, postings binary, ids array<{id}>, bounds array<long>"


def _index(batches: Iterator[pa.RecordBatch], id_type: pa.DataType) -> Iterator[pa.RecordBatch]:
    # Rows of a partition come in the same order when a task is repeated, and so do segment numbers.
    number = TaskContext.get().partitionId() << 32
    for part in pieces(batches, "text", SEGMENT):
        found = words(part.column("text"), ALPHANUMERIC)
        coded = found.array().dictionary_encode()
        codes = coded.indices.to_numpy()
        order = np.argsort(codes, kind="stable").astype(np.int32)
        counts = np.bincount(codes, minlength=len(coded.dictionary))
        starts = np.concatenate([[0], np.cumsum(counts)])
        steps = np.diff(order, prepend=np.int32(0))
        steps[starts[:-1][counts > 0]] = order[starts[:-1][counts > 0]]
        n = len(coded.dictionary)
        lists = pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer((starts * 4).astype(np.int32)), pa.py_buffer(steps.astype(np.int32).tobytes())])
        none_id, none_bounds = pa.nulls(n, pa.list_(id_type)), pa.nulls(n, pa.list_(pa.int64()))
        names = ["segment", "term", "n", "postings", "ids", "bounds"]
        segment = pa.array(np.full(n, number))
        yield pa.RecordBatch.from_arrays([segment, coded.dictionary.cast(pa.binary()), pa.array(counts.astype(np.int64)), lists, none_id, none_bounds], names=names)
        ids = pa.ListArray.from_arrays(pa.array([0, part.num_rows], pa.int32()), part.column("doc_id"))
        bounds = pa.ListArray.from_arrays(pa.array([0, part.num_rows + 1], pa.int32()), pa.array(found.bounds.astype(np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.nulls(1, pa.binary()), pa.array([0]), pa.nulls(1, pa.binary()), ids, bounds], names=names)
        number += 1


def build(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The stored index: a row per segment and term, and one per segment with its rows (term null)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = own.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)
    return written(own.mapInArrow(lambda it: _index(it, id_type), INDEX.format(id=kind.simpleString())), "index")


def windows(items: DataFrame, item_id: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """``item_id, terms``: each distinct run of ``size`` words of an item, or all its words if fewer."""
    own = items.select(F.col(item_id).cast("string").alias("item_id"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    low = F.translate("t", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = own.select("item_id", F.regexp_extract_all(low, F.lit(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    start = F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - size + 1)))
    return own.select("item_id", "w", start.alias("i")).select("item_id", F.slice("w", F.col("i"), F.lit(size)).alias("terms")).distinct()


def _nulls_first(item: str | None) -> tuple[bool, str]:
    return item is not None, item or ""


class Plan:
    """Windows of a block of the test set as arrays, their terms in order of corpus frequency."""

    def __init__(self, rows: list, frequency: dict[bytes, int]):
        rows = [(r["item_id"], [t.encode() for t in r["terms"]]) for r in rows]
        rows = sorted(((i, t) for i, t in rows if all(x in frequency for x in t)), key=lambda r: (_nulls_first(r[0]), r[1]))
        self.terms = sorted({x for _, t in rows for x in t})
        place = {t: k for k, t in enumerate(self.terms)}
        self.items = sorted({i for i, _ in rows}, key=_nulls_first)
        item_place = {t: k for k, t in enumerate(self.items)}
        longest = max((len(t) for _, t in rows), default=0)
        self.item = np.array([item_place[i] for i, _ in rows], np.int32)
        self.length = np.array([len(t) for _, t in rows], np.int32)
        self.term = np.full((len(rows), longest), -1, np.int32)
        self.shift = np.zeros((len(rows), longest), np.int32)
        for k, (_, t) in enumerate(rows):
            ranked = sorted(range(len(t)), key=lambda j: (frequency[t[j]], j))
            self.term[k, : len(t)] = [place[t[j]] for j in ranked]
            self.shift[k, : len(t)] = ranked

    def starts(self, keys: np.ndarray, first: np.ndarray, slack: int) -> tuple[np.ndarray, np.ndarray]:
        """Windows and start positions at which each term stands within ``slack`` of its place.

        ``keys``: ``term << 32 | position``, sorted; ``first``: where each term's keys begin.
        """
        rare = self.term[:, 0]
        amount = first[rare + 1] - first[rare]
        window = np.repeat(np.arange(len(rare)), amount)
        nth = np.arange(len(window)) - np.repeat(np.cumsum(amount) - amount, amount)
        start = (keys[np.repeat(first[rare], amount) + nth] & 0xFFFFFFFF) - self.shift[window, 0]
        for k in range(1, self.term.shape[1]):
            term = self.term[window, k].astype(np.int64)
            want = (term << 32) + np.maximum(start + self.shift[window, k], 0)
            low = np.searchsorted(keys, np.maximum(want - slack, term << 32), "left")
            there = (term < 0) | ((low < len(keys)) & (keys[np.minimum(low, len(keys) - 1)] <= want + slack))
            window, start = window[there], start[there]
        return window, start


def _segment(table: pa.Table, plan: Plan, slack: int) -> pa.Table:
    """Hits of one segment: a row for each of its texts."""
    head = table.filter(pc.is_null(table["term"]))
    bounds = np.asarray(head["bounds"][0].as_py(), np.int64)
    n = len(bounds) - 1
    hit, near = np.zeros(bounds[-1] + 1, np.int64), [set() for _ in range(n)]
    exact = [set() for _ in range(n)]
    place = {t: k for k, t in enumerate(plan.terms)}
    lists = table.filter(pc.is_valid(table["term"]))
    found = sorted(((place[t], p) for t, p in zip(lists["term"].to_pylist(), lists["postings"].to_pylist(), strict=True)), key=lambda x: x[0])
    if found:
        keys = np.concatenate([(np.int64(k) << 32) + np.cumsum(np.frombuffer(p, np.int32), dtype=np.int64) for k, p in found])
        first = np.searchsorted(keys, np.arange(len(plan.terms) + 1, dtype=np.int64) << 32)
        for slack_, marks in ((0, exact), (slack, near)) if slack else ((0, exact),):
            window, start = plan.starts(keys, first, slack_)
            last = start + plan.length[window] - 1
            text = np.searchsorted(bounds, np.maximum(start, 0), "right") - 1
            inside = (start >= 0) & (last < bounds[np.minimum(text + 1, n)])
            window, start, last, text = window[inside], start[inside], last[inside], text[inside]
            if marks is exact:
                np.add.at(hit, start, 1)
                np.add.at(hit, last + 1, -1)
            for t, i in {*zip(text.tolist(), plan.item[window].tolist(), strict=True)}:
                marks[t].add(plan.items[i])
    covered = np.concatenate([[0], np.cumsum(np.cumsum(hit)[:-1] > 0)])
    runs = [_runs(covered[a : b + 1]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
    columns = {
        "doc_id": pc.list_flatten(head["ids"]),
        "place": pa.array(np.arange(n)),
        "segment": pa.array(np.full(n, head["segment"][0].as_py())),
        "n_words": pa.array(np.diff(bounds)),
        "n_hit": pa.array(covered[bounds[1:]] - covered[bounds[:-1]]),
        "items": pa.array([sorted(x, key=_nulls_first) for x in exact], pa.list_(pa.string())),
        "near": pa.array([sorted(y - x, key=_nulls_first) for x, y in zip(exact, near, strict=True)], pa.list_(pa.string())),
        "spans": pa.array(runs, pa.list_(pa.list_(pa.int32()))),
    }
    return pa.table(columns)


def _runs(covered: np.ndarray) -> list[list[int]]:
    """Word ranges (begin, end) in which the running count of hit words grows."""
    if len(covered) < 2 or covered[-1] == covered[0]:
        return []
    grows = np.diff(np.diff(covered), prepend=0, append=0)
    return [[int(a), int(b)] for a, b in zip(np.flatnonzero(grows == 1), np.flatnonzero(grows == -1), strict=True)]


def _with(shared, slack: int):
    return lambda table: _segment(table, shared.value, slack)


def search(index: DataFrame, tests: DataFrame, slack: int = 0) -> DataFrame:
    """A row per indexed text: ``doc_id, n_words, n_hit, items, near, spans``. ``items`` have a window
    in the text; ``near`` only with words up to ``slack`` places off; ``spans`` are the hit word ranges."""
    spark = index.sparkSession
    tests = written(tests, "windows")
    vocabulary = tests.select(F.explode(F.col("terms").cast("array<binary>")).alias("term")).distinct()
    counted = index.join(vocabulary, "term").groupBy("term").agg(F.sum("n").alias("n"))
    counted = written(counted, "frequency")
    kind = index.schema["ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, place long, segment long, n_words long, n_hit long, items array<string>, near array<string>, spans array<array<int>>"
    size = tests.agg(F.sum(F.length(F.array_join("terms", " ")) + 64)).first()[0] or 0
    blocks = int(size // BROADCAST_BYTES) + 1
    parts = []
    for k in range(blocks):
        block = tests if blocks == 1 else tests.filter(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == k)
        terms = block.select(F.explode(F.col("terms").cast("array<binary>")).alias("term")).distinct().join(counted, "term")
        plan = Plan(block.collect(), {bytes(r["term"]): r["n"] for r in terms.collect()})
        shared = spark.sparkContext.broadcast(plan)
        wanted = spark.createDataFrame([(t,) for t in plan.terms], "term binary")
        # A block's terms are bounded like its windows, so the lists are picked while the index is read.
        lists = index.join(F.broadcast(wanted), "term", "left_semi").unionByName(index.filter("term is null"))
        parts.append(lists.groupBy("segment").applyInArrow(_with(shared, slack), schema))
    found = parts[0]
    if blocks > 1:
        for part in parts[1:]:
            found = found.unionByName(part)
        # Word ranges of several blocks are merged by their union of words: a range starts at a word
        # without one before it and ends behind a word without one after it.
        hit = F.array_distinct(F.flatten(F.transform(F.flatten(F.collect_list("spans")), lambda s: F.sequence(s[0], s[1] - 1))))
        found = found.groupBy("segment", "place").agg(
            F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), hit.alias("hit"),
            F.sort_array(F.flatten(F.collect_list("items"))).alias("items"), F.sort_array(F.flatten(F.collect_list("near"))).alias("near"),
        )
        after = F.transform("hit", lambda w: w + 1)
        starts, ends = F.sort_array(F.array_except("hit", after)), F.sort_array(F.array_except(after, "hit"))
        found = found.withColumn("n_hit", F.size("hit").cast("long")).withColumn("spans", F.zip_with(starts, ends, lambda a, b: F.array(a, b)))
    return found.select("doc_id", "n_words", "n_hit", "items", "near", "spans")


def digest(found: DataFrame) -> DataFrame:
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def keep_clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", most: float = 0.0) -> DataFrame:
    """The rows of which at most the share ``most`` of the words is hit, with all their columns."""
    found = search(build(docs, doc_id, text), windows(items))
    (id_,) = fresh(docs, "id_")
    gone = found.filter(F.col("n_hit") > most * F.col("n_words")).select(F.col("doc_id").alias(id_)).distinct()
    return docs.join(gone, docs[doc_id].eqNullSafe(gone[id_]), "left_anti")
