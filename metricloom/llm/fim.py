"""Fill-in-the-middle rewriting over a piecewise-linear learned rank index.

A text is cut into units (runs of ASCII letters, every other character by itself). Its boundary
offsets, in code points, are a rising sequence over the ranks 0 to n; cutting a text before unit r
needs the r-th of them. Instead of the offsets the index keeps, per text,

* knots (rank, offset): straight segments between them, each within ``ERROR`` characters of every
  boundary that it spans, fitted by halving all segments of a batch that miss the bound, level by
  level, so that a text of n units needs at most log2(n) passes;
* one signed byte per boundary: what its segment's prediction misses.

A lookup finds the segment by binary search over the knots, predicts in whole numbers and adds the
residual, which is exact. ``index`` returns that stored form as a table, ``offsets`` looks ranks up in
it, ``rewrite`` fits and looks up in one pass, ``restore`` rebuilds the texts from the output alone.

Work is per row, without a shuffle; a batch is handled in slices of bounded bytes, a longer text by
itself. Defined cases: a null text is empty, an empty text has no units and stays plain; a null
identifier hashes as the empty string; repeated rows come out alike; an empty table gives an empty
result; of other columns, whatever their names, nothing is read.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metricloom.llm.store import fresh
from metricloom.llm.tokens import pieces

ERROR = 127
PREFIX, SUFFIX, MIDDLE = MARKS = ("<P>", "<S>", "<M>")
#: Per cent of texts that stay plain, and of the others those with the suffix first.
PLAIN_SHARE, SPM_SHARE = 10, 20

_BYTES = np.arange(256)
_LETTER = ((_BYTES | 32) >= 0x61) & ((_BYTES | 32) <= 0x7A) & (_BYTES < 0x80)
_BEGINS = (_BYTES & 0xC0) != 0x80


@dataclass
class Boundaries:
    """Unit boundaries of several texts, one after the other; text i owns entries ``first[i]`` to
    ``first[i + 1]``. ``chars`` and ``places`` count code points and bytes from the text's start."""

    first: np.ndarray
    chars: np.ndarray
    places: np.ndarray


def boundaries(texts: pa.Array) -> tuple[Boundaries, np.ndarray, np.ndarray]:
    """The boundaries, the bytes of the texts and where each text begins in them."""
    texts = texts.cast(pa.large_binary()).fill_null(b"")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    starts, letter = _BEGINS[data], _LETTER[data]
    inner = letter.copy()
    inner[1:] &= letter[:-1]
    inner[:1] = False
    inner[offsets[:-1][offsets[:-1] < len(data)]] = False
    unit = np.flatnonzero(starts & ~inner)
    before = np.cumsum(starts, dtype=np.int64)[unit] - 1
    at = np.searchsorted(unit, offsets)
    sizes = np.diff(at)
    # Each text's units begin at its boundaries 0 to n - 1; its end is boundary n.
    ends = np.concatenate([np.cumsum(starts, dtype=np.int64), [0]])[offsets[1:] - 1] if len(data) else np.zeros(len(sizes), np.int64)
    ends = np.where(offsets[1:] > 0, ends, 0)
    first = at + np.arange(len(at))
    chars, places = np.empty(first[-1], np.int64), np.empty(first[-1], np.int64)
    owner = np.repeat(np.arange(len(sizes)), sizes)
    chars[np.arange(len(unit)) + owner], places[np.arange(len(unit)) + owner] = before, unit
    chars[first[1:] - 1], places[first[1:] - 1] = ends, offsets[1:]
    began = np.concatenate([[0], ends[:-1]])
    count = np.diff(first)
    chars -= np.repeat(began, count)
    places -= np.repeat(offsets[:-1], count)
    return Boundaries(first, chars, places), data, offsets


def _line(at: np.ndarray, x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray) -> np.ndarray:
    return y0 + (at - x0) * (y1 - y0) // np.maximum(x1 - x0, 1)


@dataclass
class RankIndex:
    """``knots``: places of the knots among all boundaries, sorted; ``values``: their offsets;
    ``residuals``: what the prediction misses at each boundary; ``first``: as in ``Boundaries``."""

    first: np.ndarray
    knots: np.ndarray
    values: np.ndarray
    residuals: np.ndarray

    @staticmethod
    def fit(first: np.ndarray, values: np.ndarray, error: int = ERROR) -> "RankIndex":
        begin, end = first[:-1], first[1:] - 1
        knot = np.zeros(len(values), bool)
        knot[begin], knot[end] = True, True
        open_begin, open_end = begin[end > begin], end[end > begin]
        while len(open_begin):
            sizes = open_end - open_begin
            at = np.arange(sizes.sum()) + np.repeat(open_begin - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes)
            x0, x1 = np.repeat(open_begin, sizes), np.repeat(open_end, sizes)
            missed = np.abs(values[at] - _line(at, x0, values[x0], x1, values[x1]))
            worst = np.maximum.reduceat(missed, np.concatenate([[0], np.cumsum(sizes)[:-1]]))
            bad = worst > error
            middle = (open_begin[bad] + open_end[bad]) // 2
            knot[middle] = True
            open_begin, open_end = np.concatenate([open_begin[bad], middle]), np.concatenate([middle, open_end[bad]])
        knots = np.flatnonzero(knot)
        index = RankIndex(first, knots, values[knots], np.zeros(len(values), np.int8))
        index.residuals = (values - index.predict(np.arange(len(values)))).astype(np.int8)
        return index

    def predict(self, at: np.ndarray) -> np.ndarray:
        """The offsets that the segments give for places among all boundaries."""
        segment = np.searchsorted(self.knots, at, "right") - 1
        after = np.minimum(segment + 1, len(self.knots) - 1)
        # The last knot of a text is exact; the segment that would lead to the next text is not used.
        exact = self.knots[segment] == at
        return np.where(exact, self.values[segment], _line(at, self.knots[segment], self.values[segment], self.knots[after], self.values[after]))

    def lookup(self, text: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Exact offset of a boundary of a text: prediction and stored residual."""
        at = self.first[text] + rank
        return self.predict(at) + self.residuals[at]


INDEX = "n_units long, knot_ranks array<long>, knot_offsets array<long>, residuals binary"


def _lists(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values, pa.int64()))


def _stored(index: RankIndex) -> list[pa.Array]:
    bounds = np.searchsorted(index.knots, index.first)
    ranks = index.knots - np.repeat(index.first[:-1], np.diff(bounds))
    raw = pa.Array.from_buffers(pa.binary(), len(index.first) - 1, [None, pa.py_buffer(index.first.astype(np.int32)), pa.py_buffer(index.residuals)])
    return [pa.array(np.diff(index.first) - 1), _lists(ranks, bounds), _lists(index.values, bounds), raw]


def index(docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), error: int = ERROR) -> DataFrame:
    """The stored index: the ``keep`` columns, ``n_units, knot_ranks, knot_offsets, residuals``."""
    if not 0 <= error <= 127:
        raise ValueError("a residual is one signed byte")
    [own] = fresh(docs.select(*keep), "text")
    rows = docs.select(*keep, F.col(text).alias(own))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, own):
            found, _, _ = boundaries(part.column(own))
            columns = [part.column(c) for c in keep] + _stored(RankIndex.fit(found.first, found.chars, error))
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "n_units", "knot_ranks", "knot_offsets", "residuals"])

    return rows.mapInArrow(run, f"{_kinds(rows, keep)}, {INDEX}")


def _kinds(rows: DataFrame, names) -> str:
    return ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in names)


def offset_at(rank: Column, knot_ranks: Column, knot_offsets: Column, residuals: Column) -> Column:
    """Exact offset of boundary ``rank`` from the stored index, with built-in functions; null beyond
    the text."""
    place = F.size(F.filter(knot_ranks, lambda k: k <= rank))
    x0, y0 = F.get(knot_ranks, place - 1), F.get(knot_offsets, place - 1)
    x1, y1 = F.get(knot_ranks, place), F.get(knot_offsets, place)
    step = F.floor((rank - x0) * (y1 - y0) / (x1 - x0)).cast("long")
    signed = F.conv(F.hex(F.substring(residuals, F.least(rank, F.length(residuals) - 1).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    return F.when((rank >= 0) & (rank < F.length(residuals)), y0 + F.coalesce(step, F.lit(0)) + F.when(signed > 127, signed - 256).otherwise(signed))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """Four unsigned 32-bit numbers per identifier: the leading hexadecimal groups of a SHA-256."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def rewrite(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", seed: int = 1) -> DataFrame:
    """One row per input row: ``doc_id, n, form, prefix_chars, middle_chars, output``."""
    own = F.coalesce(F.col(text), F.lit(""))
    h = draws(F.col(doc_id), seed)
    marked = F.lit(False)
    for mark in MARKS:
        marked = marked | F.contains(own, F.lit(mark))
    plain = (own == "") | marked | (h[2] % 100 >= 100 - PLAIN_SHARE)
    form = F.when(plain, "plain").when(h[3] % 100 < SPM_SHARE, "spm").otherwise("psm")
    rows = docs.select(F.col(doc_id).alias("doc_id"), own.alias("text"), form.alias("form"), h[0].alias("cut_a"), h[1].alias("cut_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in pieces(batches, "text"):
            found, data, offsets = boundaries(part.column("text"))
            n = np.diff(found.first) - 1
            each = np.arange(part.num_rows)
            a, b = (part.column(c).to_numpy() % (n + 1) for c in ("cut_a", "cut_b"))
            ranks = np.minimum(a, b), np.maximum(a, b)
            by_char, by_byte = RankIndex.fit(found.first, found.chars), RankIndex.fit(found.first, found.places)
            chars, places = ([index.lookup(each, r) for r in ranks] for index in (by_char, by_byte))
            outputs = []
            raw, forms = data.tobytes(), part.column("form").to_pylist()
            for i, kind in enumerate(forms):
                lo, hi = int(offsets[i]), int(offsets[i + 1])
                p, m = lo + int(places[0][i]), lo + int(places[1][i])
                prefix, middle, suffix = raw[lo:p], raw[p:m], raw[m:hi]
                outputs.append(
                    raw[lo:hi] if kind == "plain"
                    else b"".join([b"<P>", prefix, b"<S>", suffix, b"<M>", middle]) if kind == "psm"
                    else b"".join([b"<S>", suffix, b"<P>", prefix, b"<M>", middle])
                )
            shown = np.array([f == "plain" for f in forms], bool)
            columns = [part.column("doc_id"), pa.array(n), part.column("form"), pa.array(chars[0], mask=shown), pa.array(chars[1] - chars[0], mask=shown)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(outputs, pa.binary()).cast(pa.string())], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, n long, form string, prefix_chars long, middle_chars long, output string")


def restore(form: Column, output: Column) -> Column:
    """The exact text, from form and output alone: no marker can occur in a part, and no end of one
    marker begins another, so the three markers are found where they were put."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    psm = F.concat(F.get(part, F.lit(1)), F.get(part, F.lit(3)), F.get(part, F.lit(2)))
    spm = F.concat(F.get(part, F.lit(2)), F.get(part, F.lit(3)), F.get(part, F.lit(1)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def digest(rewritten: DataFrame) -> DataFrame:
    hashed = [F.sha2(c, 256).alias(n) for c, n in ((F.col("output"), "output_sha256"), (restore(F.col("form"), F.col("output")), "restored_sha256"))]
    return rewritten.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *hashed)
