"""Search over stored rows by an index of three-character pieces, and pages by stored rank.

The rows are written once in page order, cut into blocks of 64. Pieces are made on Arrow batches. For every piece of three characters that a
column's text holds in lower case, and every block, one posting says by one bit per row where it occurs.
A search reads the postings of its pieces, intersects them bit by bit, and verifies the texts of the rows
that are left, so the result equals that of a full scan. Postings lie sorted by piece, rows in one folder
per range of the order, so both reads skip what they don't need. Texts end with two marks, so a search for
one or two characters is one for pieces that begin with them.

Defined cases: an empty search finds every row; a null text holds nothing else; rows of equal order come in
the order of a hash of all their texts, equal rows in any; an empty table gives an empty index.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .reports import check_page, contains_text

#: Rows per block: one bit each of a bigint.
BLOCK = 64
PIECE = 3
_END = "\0" * (PIECE - 1)
#: Characters whose pieces are made at a time; longer texts are cut into overlapping parts. With so many
#: characters a piece and a bit's number fit 64 bits whatever the alphabet.
_STEP = 1 << 18
_PLACE = ["part", "block"]


def _before(name: str, *part: str, order: str) -> Column:
    """Sum of the rows above."""
    w = Window.partitionBy(*part).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(name).over(w), F.lit(0))


def _within(first: Column, n: Column, offset: int, limit: int) -> Column:
    return (first < offset + limit) & (first + n > offset)


def _runs(batch: pa.RecordBatch, name: str) -> Iterator[tuple[int, int, list[str], np.ndarray]]:
    """Texts of one block, each with the two characters behind its last piece, and the bit of each; at most
    ``_STEP`` characters, or one part of a text."""
    texts = batch.column(name).cast(pa.binary())
    places = zip(batch.column("part").to_pylist(), batch.column("block").to_pylist(), batch.column("bit").to_pylist(), strict=True)
    now, held, bits, size = None, [], [], 0
    for (part, block, bit), raw in zip(places, texts, strict=True):
        text = raw.as_py()
        if not text:
            continue
        text = text.decode("utf-8", "replace") + _END
        for at in range(0, len(text) - len(_END), _STEP):
            cut = text[at : at + _STEP + len(_END)]
            if held and ((part, block) != now or size + len(cut) > _STEP):
                yield *now, held, np.array(bits, np.uint64)
                held, bits, size = [], [], 0
            now = part, block
            held.append(cut)
            bits.append(bit)
            size += len(cut)
    if held:
        yield *now, held, np.array(bits, np.uint64)


def _pieces(texts: list[str], bits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct pieces of the texts, as rows of characters, and the bits of the texts that hold each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    used = np.zeros(int(codes.max()) + 1, bool)
    used[codes] = True
    letters, many = np.flatnonzero(used), np.uint64(used.sum())
    letter = (np.cumsum(used) - 1).astype(np.uint64)[codes]
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    whole = np.ones(len(codes), bool)
    for back in range(1, PIECE):
        whole[np.cumsum(sizes) - back] = False
    at = np.flatnonzero(whole)
    number = letter[at]
    for k in range(1, PIECE):
        number = number * many + letter[at + k]
    found = np.sort(number * np.uint64(BLOCK) + np.repeat(bits, sizes)[at])
    number = found // np.uint64(BLOCK)
    first = np.flatnonzero(np.concatenate([[True], number[1:] != number[:-1]]))
    held = np.bitwise_or.reduceat(np.uint64(1) << found % np.uint64(BLOCK), first)
    number = number[first]
    rows = np.empty((len(first), PIECE), np.uint32)
    for k in reversed(range(PIECE)):
        rows[:, k] = letters[(number % many).astype(np.int64)]
        number = number // many
    return rows, held.view(np.int64)


def _strings(rows: np.ndarray) -> pa.Array:
    raw = rows.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    sizes = (1 + (rows >= 0x80) + (rows >= 0x800) + (rows >= 0x10000)).sum(1)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.string(), len(rows), [None, pa.py_buffer(ends), pa.py_buffer(raw)])


_POSTING = "piece string, column string, part int, block long, bits long"


def _postings(columns: list[str]):
    """Postings per block, made once per run of a block's rows that come together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, column in enumerate(columns):
                for part, block, texts, bits in _runs(batch, f"text{i}"):
                    pieces, held = _pieces(texts, bits)
                    n = len(pieces)
                    made = [_strings(pieces), pa.repeat(pa.scalar(column), n), pa.repeat(pa.scalar(part, pa.int32()), n), pa.repeat(pa.scalar(block, pa.int64()), n), pa.array(held)]
                    yield pa.RecordBatch.from_arrays(made, names=["piece", "column", "part", "block", "bits"])

    return run


def build_index(df: DataFrame, path: str, order: str, columns=None) -> "SearchIndex":
    """Writes rows, postings and block sizes under a new folder."""
    columns = list(columns or df.columns)
    ties = F.xxhash64(*[F.col(f"`{c}`").cast("string") for c in df.columns])
    # The ranges are cut by order and hash: rows of one order value may fill many of them.
    sorted_ = df.repartitionByRange(F.col(order), ties).sortWithinPartitions(F.col(order), ties)
    # The id has the number of the task in its upper bits, so blocks don't cross tasks.
    placed = sorted_.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("pos"))
    placed = placed.withColumn("block", F.shiftright("pos", BLOCK.bit_length() - 1)).withColumn("part", F.shiftright("pos", 33).cast("int"))
    placed.write.partitionBy("part").parquet(f"{path}/rows")

    rows = _stored_rows(df.sparkSession, path, df.schema)
    rows.groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n")).write.parquet(f"{path}/blocks")
    texts = [F.lower(F.col(f"row.`{c}`").cast("string")).alias(f"text{i}") for i, c in enumerate(columns)]
    found = rows.select(*_PLACE, (F.col("pos") % BLOCK).alias("bit"), *texts).mapInArrow(_postings(columns), _POSTING)
    postings = found.groupBy("piece", "column", *_PLACE).agg(F.bit_or("bits").alias("bits"))
    postings.repartitionByRange("piece", *_PLACE).sortWithinPartitions("piece", *_PLACE).write.parquet(f"{path}/postings")
    return open_index(df.sparkSession, path, df.schema, columns)


def _stored_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    stored = StructType().add("row", schema).add("pos", "long").add("block", "long").add("part", "integer")
    return spark.read.schema(stored).parquet(f"{path}/rows")


def open_index(spark: SparkSession, path: str, schema: StructType, columns) -> "SearchIndex":
    """A written index of a table with that schema."""
    postings = spark.read.schema("piece string, column string, part int, block long, bits long").parquet(f"{path}/postings")
    blocks = spark.read.schema("part int, block long, n long").parquet(f"{path}/blocks")
    return SearchIndex(_stored_rows(spark, path, schema), postings, blocks, tuple(columns))


@dataclass(frozen=True)
class SearchIndex:
    rows: DataFrame
    postings: DataFrame
    blocks: DataFrame
    columns: tuple[str, ...]

    def candidates(self, needle: str) -> DataFrame:
        """part, block, bits of the rows that hold every piece of the text in one column."""
        if len(needle) < PIECE:
            hits = self.postings.filter(F.col("piece").startswith(needle))
        else:
            pieces = sorted({needle[i : i + PIECE] for i in range(len(needle) - PIECE + 1)})
            hits = self.postings.filter(F.col("piece").isin(pieces)).groupBy(*_PLACE, "column").agg(
                F.bit_and("bits").alias("bits"), F.count(F.lit(1)).alias("n")
            ).filter((F.col("n") == len(pieces)) & (F.col("bits") != 0))
        return hits.groupBy(*_PLACE).agg(F.bit_or("bits").alias("bits"))

    def _found(self, query: str, blocks: DataFrame = None) -> DataFrame:
        """Stored rows that hold the text, of some blocks or all."""
        needle = query.strip().lower()
        rows = self.rows
        if needle:
            chosen = self.candidates(needle)
            chosen = chosen if blocks is None else chosen.join(blocks, _PLACE)
            rows = rows.join(chosen, _PLACE).filter(F.getbit("bits", F.col("pos") % BLOCK) == 1)
        elif blocks is not None:
            rows = rows.join(blocks, _PLACE)
        return rows.filter(contains_text([F.col(f"row.`{c}`") for c in self.columns], query))

    def _sizes(self, query: str) -> DataFrame:
        """Matching rows per block; stored where every row matches."""
        if not query.strip():
            return self.blocks
        return self._found(query).groupBy(*_PLACE).agg(F.count(F.lit(1)).alias("n"))

    def search(self, query: str) -> DataFrame:
        """Every row in which any column contains the text, case-insensitively."""
        return self._found(query).select("row.*")

    def total(self, query: str) -> DataFrame:
        return self._sizes(query).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total"))

    def page(self, query: str, offset: int = 0, limit: int = 50) -> DataFrame:
        """One page of the matching rows. Counts per range and per block tell which blocks hold the page;
        only their rows are read again and ranked."""
        check_page(offset, limit)
        sizes = self._sizes(query)
        # One row per range; a window over the blocks of one range; a window over the rows of one block.
        ranges = sizes.groupBy("part").agg(F.sum("n").alias("all")).withColumn("before", _before("all", order="part"))
        held = ranges.filter(_within(F.col("before"), F.col("all"), offset, limit)).select("part", "before")
        blocks = sizes.join(held, "part").withColumn("first", F.col("before") + _before("n", "part", order="block"))
        blocks = blocks.filter(_within(F.col("first"), F.col("n"), offset, limit)).select(*_PLACE, "first")
        rank = F.col("first") + F.row_number().over(Window.partitionBy(*_PLACE).orderBy("pos")) - 1
        page = self._found(query, blocks).withColumn("rank", rank).filter(F.col("rank").between(offset, offset + limit - 1))
        return page.orderBy("rank").select("row.*")
