"""Transcripts to canonical turns: a hidden Markov model over line features, decoded by Viterbi.

Hidden states say who speaks and whether the line opens a turn, goes on or is blank. Transition and emission rates come
from counts over transcripts whose roles are known. Decoding is exact for a conversation of any length
without gathering it anywhere: a run of lines is a max-plus matrix (best score from each state before
it to each state at its end), matrices of neighbouring runs multiply, and once the states at the ends of
a long run are known, those inside follow from its parts. Runs of lines are built level by level, a few
hundred parts in a group, and resolved from the top down.

Input is ``conv_id, line_no, line``; ``line_no`` orders the lines. Runs are cut by the count of lines in
the sorted order, so that equal, negative or far-apart numbers make no run longer or levels more.

Defined cases: a null line is empty; a null conversation is one of its own; a null line number counts
as 0; numbers below 0 come before it; equal line numbers are ordered by text; an empty table gives an
empty result.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from metricloom.llm.store import written
from metricloom.llm.weak import let

ROLES = ("system", "user", "assistant")
#: State 0 stands before the first line; then the opening, the further and the blank lines of each role.
STATES = ["start", *[f"{r}-{k}" for r in ROLES for k in ("open", "more", "gap")]]
N = len(STATES)
#: Spellings of speaker markers.
MARKERS = {
    "system": ("system", "sys", "instruction", "context"),
    "user": ("user", "human", "question", "q", "customer", "me"),
    "assistant": ("assistant", "ai", "bot", "answer", "a", "model", "agent"),
}
_NAMES = "|".join(sorted((x for m in MARKERS.values() for x in m), key=lambda x: (-len(x), x)))
MARKER = rf"(?i)^\s*(?:#{{1,4}}\s*({_NAMES})\b\s*:?|<\|({_NAMES})\|>|\[({_NAMES})\]\s*:?|\*\*({_NAMES})\s*:?\*\*\s*:?|({_NAMES})\s*:)\s*"
PARTS, FLOOR = 256, 0.5
#: Bits of ``monotonically_increasing_id`` that count the rows of a partition; those above name it.
ROW_BITS = 33


def _marked(line: Column) -> Column:
    name = F.lower(F.concat(*[F.coalesce(F.regexp_extract(line, MARKER, k), F.lit("")) for k in range(1, 6)]))
    return F.coalesce(*[F.when(name.isin(*m), r) for r, m in MARKERS.items()], F.when(line.rlike(r"^\s*[A-Z][\w .-]{0,24}:\s"), "other").otherwise("none"))


def features(lines: DataFrame) -> DataFrame:
    """Adds ``seen``: marker, end of line, length, form (as text values)."""
    x = F.coalesce(F.col("line"), F.lit(""))
    n = F.length(x)
    ending = F.when(F.trim(x) == "", "blank").when(x.rlike(r"\?\s*$"), "question").when(x.rlike(r"[.!:;]\s*$"), "stop").otherwise("open")
    size = F.concat(F.lit("n"), F.when(n == 0, 0).otherwise(F.least(F.lit(9), F.floor(F.log2(n.cast("double") + 1)))).cast("int").cast("string"))
    form = F.when(x.rlike(r"^\s*(?:[-*•]|[0-9]+[.)])\s"), "item").when(x.rlike(r"^(?:```|\s{4}|\t)"), "code").when(x.rlike(r"^\s*\p{Lu}"), "capital").otherwise("other")
    return lines.withColumn("seen", F.array(_marked(x), ending, size, form))


def fit(known: DataFrame) -> dict:
    """Log rates from lines with ``conv_id, line_no, line, state``. Counts of neighbouring states need
    the state of the line before, which each line carries as ``before`` (null for a first line)."""
    moves = {(r["b"], r["state"]): r["n"] for r in known.groupBy(F.coalesce("before", F.lit("start")).alias("b"), "state").agg(F.count(F.lit(1)).alias("n")).collect()}
    seen = features(known).select("state", F.posexplode("seen").alias("k", "value")).groupBy("state", "k", "value").agg(F.count(F.lit(1)).alias("n")).collect()
    # Values per feature are few and fixed, and so are these counts.
    values = {k: sorted({r["value"] for r in seen if r["k"] == k}) for k in range(4)}
    count = {(r["state"], r["k"], r["value"]): r["n"] for r in seen}
    move = np.full((N, N), -math.inf)
    for i, b in enumerate(STATES):
        allowed = [j for j, s in enumerate(STATES) if j and (s.endswith("open") or s.split("-")[0] == b.split("-")[0])]
        total = sum(moves.get((b, STATES[j]), 0) + FLOOR for j in allowed)
        for j in allowed:
            move[i, j] = math.log((moves.get((b, STATES[j]), 0) + FLOOR) / total)
    rate = {}
    for j, s in enumerate(STATES):
        for k in range(4):
            total = sum(count.get((s, k, v), 0) for v in values[k]) + FLOOR * (len(values[k]) + 1)
            rate[j, k, None] = math.log(FLOOR / total)
            for v in values[k]:
                rate[j, k, v] = math.log((count.get((s, k, v), 0) + FLOOR) / total)
    return {"move": move.tolist(), "rate": rate}


def _line_matrix(model: dict):
    move, rate = np.array(model["move"]), model["rate"]
    cache: dict[tuple, np.ndarray] = {}

    def matrix(seen: list[str]) -> np.ndarray:
        key = tuple(seen)
        if key not in cache:
            cache[key] = move + np.array([-math.inf, *[sum(rate.get((j, k, v), rate[j, k, None]) for k, v in enumerate(key)) for j in range(1, N)]])
        return cache[key]

    return matrix


def _parts(table: pa.Table, matrix) -> list[np.ndarray]:
    """Matrices of a group's parts in order: of lines by their features, of runs as they are stored."""
    if matrix:
        return [matrix(s) for s in table["seen"].to_pylist()]
    return [np.array(m).reshape(N, N) for m in table["m"].to_pylist()]


def _multiply(matrix, keys: list[str]):
    def run(table: pa.Table) -> pa.Table:
        best = None
        for m in _parts(table.sort_by("at"), matrix):
            best = m if best is None else (best[:, :, None] + m[None]).max(1)
        return table.slice(0, 1).select(keys).append_column("m", pa.array([best.ravel().tolist()], pa.list_(pa.float64())))

    return run


def _resolve(matrix, keep: list[str]):
    """Ends of the parts of a run whose entering and last state are known."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("at")
        enter, last = table["enter"][0].as_py(), table["last"][0].as_py()
        score, back = np.full(N, -math.inf), []
        score[enter] = 0.0
        for m in _parts(table, matrix):
            step = score[:, None] + m
            back.append(step.argmax(0))
            score = step.max(0)
        ends = [last]
        for from_ in back[:0:-1]:
            ends.append(int(from_[ends[-1]]))
        ends.reverse()
        out = table.select(keep)
        return out.append_column("enter", pa.array([enter, *ends[:-1]], pa.int32())).append_column("last", pa.array(ends, pa.int32()))

    return run


def _cut(lines: DataFrame, size: int) -> DataFrame:
    """The lines in the order of conversation, number and text: ``part`` is a range of this order, ``at``
    the place in it, ``run`` a stretch of at most ``size`` neighbouring places of one part. Identical lines
    are told apart by where they were read, so that no range is held together by ties."""
    own = lines.select("conv_id", F.coalesce(F.col("line_no").cast("long"), F.lit(0)).alias("line_no"), F.coalesce("line", F.lit("")).alias("line"), F.monotonically_increasing_id().alias("tie"))
    order = ["conv_id", "line_no", "line", "tie"]
    own = features(own.repartitionByRange(*order).sortWithinPartitions(*order).drop("tie").withColumn("at", F.monotonically_increasing_id()))
    row = F.col("at").bitwiseAND((1 << ROW_BITS) - 1)
    return written(own.withColumn("part", F.shiftright("at", ROW_BITS)).withColumn("run", F.floor(row / F.lit(size)).cast("long")), "lines")


def _same(a: DataFrame, b: DataFrame, *names: tuple[str, str]) -> Column:
    same = a["conv_id"].eqNullSafe(b["c_"])
    for x, y in names:
        same = same & (a[x] == b[y])
    return same


def _earlier(sums: DataFrame, amount: str) -> DataFrame:
    """``c_, p_, earlier``: what the parts of a conversation before this one add up to. A conversation
    has one row here per part."""
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(F.col("conv_id").alias("c_"), F.col("part").alias("p_"), F.coalesce(F.sum(amount).over(before), F.lit(0)).alias("earlier"))


def decode(lines: DataFrame, model: dict, span: int = PARTS) -> DataFrame:
    """Adds ``state`` to lines of ``conv_id, line_no, line``, with ``part, run, at`` of :func:`_cut`. A run
    has at most ``span`` lines, and never more than ``PARTS``."""
    conv = lines.schema["conv_id"].dataType.simpleString()
    matrix = _line_matrix(model)
    own = _cut(lines, min(span, PARTS))
    keys = ["conv_id", "part", "run"]
    first = written(own.select(*keys, "at", "seen").groupBy(*keys).applyInArrow(_multiply(matrix, keys), f"conv_id {conv}, part long, run long, m array<double>"), "first-runs")
    # The runs of a conversation within a part follow each other, and so they are numbered from 0 on.
    held = first.groupBy("conv_id", "part").agg(F.min("run").alias("low"), (F.max("run") - F.min("run") + 1).alias("runs"))
    earlier = _earlier(held, "runs").join(held.select(F.col("conv_id").alias("d_"), F.col("part").alias("q_"), "low"), F.col("c_").eqNullSafe(F.col("d_")) & (F.col("p_") == F.col("q_")))
    numbered = first.join(earlier, _same(first, earlier, ("part", "p_"))).select(*keys, (F.col("earlier") + F.col("run") - F.col("low")).alias("nth"), "m")
    numbered = written(numbered, "numbered-runs")
    level = numbered.select("conv_id", F.col("nth").alias("run"), "m")
    levels = []
    # Runs of runs, until every conversation is one: as many rounds as the longest has digits.
    while (level.agg(F.max("run").alias("most")).first()["most"] or 0) > 0:
        parts = level.select("conv_id", F.col("run").alias("at"), F.floor(F.col("run") / PARTS).cast("long").alias("run"), "m")
        levels.append(parts)
        level = written(parts.groupBy("conv_id", "run").applyInArrow(_multiply(None, ["conv_id", "run"]), f"conv_id {conv}, run long, m array<double>"), "runs")
    # Row 0 of the matrix: from before the first line. Of equal scores the first state counts.
    from_start = F.slice("m", 1, N)
    known = level.select("conv_id", "run", F.lit(0).alias("enter"), (F.array_position(from_start, F.array_max(from_start)) - 1).cast("int").alias("last"))
    renamed = lambda k: k.select(F.col("conv_id").alias("c_"), F.col("run").alias("r_"), "enter", "last")
    for parts in reversed(levels):
        above = renamed(known)
        inner = parts.join(above, _same(parts, above, ("run", "r_"))).drop("c_", "r_")
        found = inner.groupBy("conv_id", "run").applyInArrow(_resolve(None, ["conv_id", "at"]), f"conv_id {conv}, at long, enter int, last int")
        known = written(found.withColumnRenamed("at", "run"), "ends")
    above = renamed(known)
    ends = numbered.join(above, _same(numbered, above, ("nth", "r_"))).select(F.col("conv_id").alias("c_"), F.col("part").alias("p_"), F.col("run").alias("r_"), "enter", "last")
    inner = own.join(ends, _same(own, ends, ("part", "p_"), ("run", "r_"))).drop("c_", "p_", "r_")
    kept = [*keys, "at", "line_no", "line"]
    found = inner.groupBy(*keys).applyInArrow(_resolve(matrix, kept), f"conv_id {conv}, part long, run long, at long, line_no long, line string, enter int, last int")
    names = F.array(*[F.lit(s) for s in STATES])
    return found.select(*kept, F.get(names, F.col("last")).alias("state"))


def turns(decoded: DataFrame) -> DataFrame:
    """``conv_id, turn_no, first_line, role, text, rendered`` of each recovered turn. Turns are counted
    within runs, and runs are added up within parts and parts within conversations, so that a long
    conversation is never one task's work."""
    opens = F.col("state").endswith("-open").cast("long")
    within = Window.partitionBy("conv_id", "part", "run").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    numbered = written(decoded.withColumn("nth", F.sum(opens).over(within)), "numbered")
    sums = numbered.groupBy("conv_id", "part", "run").agg(F.max("nth").alias("turns"))
    before = Window.partitionBy("conv_id", "part").orderBy("run").rowsBetween(Window.unboundedPreceding, -1)
    sums = written(sums.withColumn("inside", F.coalesce(F.sum("turns").over(before), F.lit(0))), "turn-counts")
    earlier = _earlier(sums.groupBy("conv_id", "part").agg(F.sum("turns").alias("turns")), "turns")
    sums = sums.join(earlier, _same(sums, earlier, ("part", "p_"))).select("c_", "p_", F.col("run").alias("r_"), (F.col("earlier") + F.col("inside")).alias("earlier"))
    placed = numbered.join(sums, _same(numbered, sums, ("part", "p_"), ("run", "r_"))).withColumn("turn_no", F.col("earlier") + F.col("nth") - 1)
    bare = F.when(F.col("state").endswith("-open"), F.regexp_replace("line", MARKER, "")).otherwise(F.col("line"))
    ordered = F.sort_array(F.collect_list(F.struct("at", bare.alias("text"))))
    out = placed.groupBy("conv_id", "turn_no").agg(F.min("line_no").alias("first_line"), F.min_by(F.substring_index("state", "-", 1), "at").alias("role"), F.regexp_replace(F.array_join(F.transform(ordered, lambda r: r["text"]), "\n"), r"\n+$", "").alias("text"))
    return out.withColumn("rendered", F.concat(F.lit("<|"), "role", F.lit("|>\n"), F.trim("text"), F.lit("\n<|end|>\n")))


#: Line numbers of a transcript made from turns: the turn times this, plus the line within the turn.
TURN_LINES = 1 << 32
STYLES = (("{}: ", ("System", "User", "Assistant")), ("### {}: ", ("Instruction", "Human", "AI")), ("[{}] ", ("system", "customer", "agent")), ("{}: ", ("Context", "Q", "A")))


def flatten(conversations: DataFrame) -> DataFrame:
    """Transcript lines of turns ``conv_id, turn, role, text``, with the true ``state`` and that of the
    line ``before``. Conversations differ in the style of their markers, about an eighth of the turns
    after the first has none, and an empty line ends each turn."""
    style = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(len(STYLES)))
    marker = F.coalesce(*[F.when((style == k) & (F.col("role") == r), F.lit(form.format(name))) for k, (form, names) in enumerate(STYLES) for r, name in zip(ROLES, names, strict=True)], F.lit(""))
    bare = (F.pmod(F.crc32(F.concat_ws(":", "conv_id", "turn").cast("binary")), F.lit(8)) == 0) & (F.col("turn") > 0)
    role = F.when(F.col("role").isin(*ROLES), F.col("role")).otherwise("user")
    own = conversations.select("conv_id", F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"), role.alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    own = own.withColumn("marked", F.concat(F.when(bare, "").otherwise(marker), "text", F.lit("\n")))
    # The role before is the neighbour's, found by equality of conversation and turn.
    prior = own.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("prior")).groupBy("conv_id", "turn").agg(F.min("prior").alias("prior"))
    prior = prior.select(F.col("conv_id").alias("c_"), F.col("turn").alias("t_"), "prior")
    own = own.join(prior, own["conv_id"].eqNullSafe(prior["c_"]) & (own["turn"] == prior["t_"]), "left")
    kind = lambda x, k: F.when(k == 0, "-open").when(F.trim(x) == "", "-gap").otherwise("-more")
    each = let(F.split("marked", "\n", -1), lambda all_: F.transform(all_, lambda x, k: F.struct(x.alias("line"), kind(x, k).alias("kind"), kind(F.get(all_, k - 1), k - 1).alias("kind_before"))))
    rows = own.select("conv_id", "turn", "role", "prior", F.posexplode(each).alias("k", "x"))
    before = F.when(F.col("k") > 0, F.concat("role", "x.kind_before")).otherwise(F.concat("prior", F.lit("-gap")))
    return rows.select("conv_id", (F.col("turn") * TURN_LINES + F.col("k")).alias("line_no"), "x.line", F.concat("role", "x.kind").alias("state"), before.alias("before"))


def learn(lines: DataFrame) -> dict:
    """Rates from the three quarters of the conversations that are not held out."""
    taught = F.pmod(F.crc32(F.coalesce(F.col("conv_id").cast("string"), F.lit("")).cast("binary")), F.lit(4)) != 2
    return fit(lines.filter(taught))
