"""Dated notes: scope over the subject tree, join to periods, versioned changes."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.periods import annotation_key, chart_period_key
from .lineage import cut_lineage


def ancestors(subjects: DataFrame) -> DataFrame:
    """(id, ancestor) pairs, the subject itself included; parents named by id or by name.

    One hop is a lookup table (child id, parent id). Hops are joined until no new pair appears,
    which is the depth of the tree, or the length of a cycle of parents.
    """
    by_id = subjects.select(F.col("id").alias("_ref"), F.col("id").alias("parent_id"), F.lit(1).alias("_by"))
    by_name = subjects.select(F.col("name").alias("_ref"), F.col("id").alias("parent_id"), F.lit(2).alias("_by"))
    targets = by_id.unionByName(by_name).groupBy("_ref").agg(F.min_by("parent_id", "_by").alias("parent_id"))
    hop = subjects.filter("parent is not null").select("id", F.col("parent").alias("_ref")).join(targets, "_ref").select("id", "parent_id")
    reached = subjects.select("id", F.col("id").alias("ancestor"))
    frontier = reached
    closure = reached
    step = cut_lineage(hop.select(F.col("id").alias("ancestor"), "parent_id"))
    while True:
        reached = frontier.join(step, "ancestor").select("id", F.col("parent_id").alias("ancestor")).distinct()
        frontier = cut_lineage(reached.join(closure, ["id", "ancestor"], "left_anti"))
        if frontier.isEmpty():
            return closure
        closure = closure.unionByName(frontier)


def annotation_scope(subjects: DataFrame) -> DataFrame:
    """Scopes whose notes a subject shows: '*', itself and its ancestors.

    Notes on a group are shown everywhere; ``annotations_for`` files them under '*', so no
    product of subjects and groups is needed.
    """
    everyone = subjects.select("id", F.lit("*").alias("scope"))
    tree = ancestors(subjects).select("id", F.col("ancestor").alias("scope"))
    return everyone.unionByName(tree).distinct()


def _filed(notes: DataFrame, subjects: DataFrame) -> DataFrame:
    groups = subjects.filter("type = 'group'").select(F.col("id").alias("subject"), F.lit(True).alias("_group"))
    return notes.join(groups, "subject", "left").withColumn(
        "scope", F.when(F.col("_group"), F.lit("*")).otherwise(F.col("subject"))
    )


def annotations_for(notes: DataFrame, subjects: DataFrame) -> DataFrame:
    """Notes next to every subject that shows them."""
    scope = annotation_scope(subjects).withColumnRenamed("id", "subject_id")
    return _filed(notes, subjects).join(scope, "scope").select(
        "subject_id", F.col("id").alias("note_id"), "date", "subject", "text"
    )


def annotate_subject_periods(notes: DataFrame, subjects: DataFrame, periods: DataFrame, grain: str) -> DataFrame:
    """First note and number of further notes of every (subject_id, period).

    Notes are reduced to one row per scope and period key before they meet the subjects, so
    global notes are not multiplied by the number of subjects.
    """
    keyed = _filed(notes, subjects).withColumn("_key", annotation_key(F.col("date"), grain)).filter("_key is not null")
    first = F.struct("date", "text", F.col("id").alias("note_id"))
    reduced = keyed.groupBy("scope", "_key").agg(F.min(first).alias("_first"), F.count(F.lit(1)).alias("_n"))
    scope = annotation_scope(subjects).withColumnRenamed("id", "subject_id")
    found = reduced.join(scope, "scope").groupBy("subject_id", "_key").agg(
        F.min("_first").alias("_first"), (F.sum("_n") - 1).alias("more")
    )
    wanted = periods.withColumn("_key", chart_period_key(F.col("period"), grain)).filter("_key is not null")
    return wanted.join(found, ["subject_id", "_key"]).select(*periods.columns, "_first.date", "_first.text", "more")


def annotate_periods(notes: DataFrame, periods: DataFrame, grain: str, by=("subject_id",)) -> DataFrame:
    """First note of every chart period (by date, then text) and the number of further ones.

    The first note is a top-1 window filter, the number a plain count: the notes of one
    period are never gathered.
    """
    by = list(by)
    keyed = notes.withColumn("_key", annotation_key(F.col("date"), grain)).filter("_key is not null")
    wanted = periods.withColumn("_key", chart_period_key(F.col("period"), grain)).filter("_key is not null")
    w = Window.partitionBy(*by, "_key").orderBy("date", "text", "note_id")
    first = keyed.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= 1).select(*by, "_key", "date", "text")
    counted = keyed.groupBy(*by, "_key").agg((F.count(F.lit(1)) - 1).alias("more"))
    return wanted.join(first, by + ["_key"]).join(counted, by + ["_key"]).select(*periods.columns, "date", "text", "more")


def note_problem(date: Column, subject: Column, text: Column) -> Column:
    """NULL for an acceptable note, else what is wrong with it."""
    body = F.trim(text)
    day_ok = date.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_date(date, "yyyy-MM-dd").isNotNull()
    return (
        F.when(~F.coalesce(day_ok, F.lit(False)), "date")
        .when(~F.coalesce(F.length(subject).between(1, 200), F.lit(False)), "subject")
        .when(~F.coalesce(F.length(text).between(1, 80) & (body != ""), F.lit(False)), "length")
        .when(body.rlike(r"[\x00-\x1f\x7f]"), "control character")
    )


#: State of a note that does not exist, beside the versions of those that do.
_ABSENT = -(1 << 62)


def _effect(action: str, expected: int, wrong: bool) -> tuple[int, int] | None:
    """The one state that a change acts on and what it makes of it; None where it can act on none."""
    if action == "add":
        return None if wrong else (_ABSENT, 1)
    if expected is None or (wrong and action != "delete"):
        return None
    return expected, _ABSENT if action == "delete" else expected + 1


def _rows(batches):
    for batch in batches:
        yield from zip(*[batch.column(c).to_pylist() for c in ("_pid", "id", "ord", "action", "expected_version", "_wrong", "_version")], strict=True)


def _maps(batches):
    """The changes at the edges of each part, composed: (part, note, first state, states, results)."""
    import pyarrow as pa

    def composed(key, held, effects):
        # From the last change back: what acts on a must end where b, which it makes of a, ends.
        ends = {}
        for effect in reversed(effects):
            if effect is not None:
                ends[effect[0]] = ends.get(effect[1], effect[1])
        return *key, held, sorted(ends), [ends[k] for k in sorted(ends)]

    def of_parts():
        key, held, effects, first = None, None, [], True
        for pid, note, _, action, expected, wrong, version in _rows(batches):
            if key != (pid, note):
                if key is not None and (first or pid != key[0]):
                    yield composed(key, held, effects)
                first = key is None or pid != key[0]
                key, held, effects = (pid, note), _ABSENT if version is None else version, []
            effects.append(_effect(action, expected, wrong))
        if key is not None:
            yield composed(key, held, effects)

    for row in of_parts():
        yield pa.RecordBatch.from_pylist([dict(zip(("_pid", "id", "held", "states", "ends"), row, strict=True))], schema=pa.schema(
            [("_pid", pa.int32()), ("id", pa.string()), ("held", pa.int64()), ("states", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]))


def _walk(batches):
    """States that meet the parts of a note, one part after the other."""
    import bisect

    import pyarrow as pa

    note, state, out = None, None, []
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in ("_pid", "id", "held", "states", "ends")}
            if row["id"] != note:
                note, state = row["id"], row["held"]
            out.append((row["_pid"], note, state))
            at = bisect.bisect_left(row["states"], state)
            if at < len(row["states"]) and row["states"][at] == state:
                state = row["ends"][at]
    yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), pa.array([r[1] for r in out], pa.string()), pa.array([r[2] for r in out], pa.int64())], names=["_pid", "id", "state"])


def _judged(met: dict):
    def run(batches):
        import pyarrow as pa

        here, state = None, None
        for batch in batches:
            status, made = [], []
            for pid, note, _, action, expected, wrong, version in _rows([batch]):
                if here != (pid, note):
                    here = (pid, note)
                    state = met.get(here, _ABSENT if version is None else version)
                there = state != _ABSENT
                if action == "add":
                    code = 409 if there else 422 if wrong else 200
                else:
                    code = 404 if not there else 409 if expected != state else 422 if wrong and action != "delete" else 200
                status.append(code)
                made.append((state if there else 0) + 1 if code == 200 else None)
                if code == 200:
                    state = _effect(action, expected, wrong)[1]
            columns = [batch.column(c) for c in ("id", "ord", "action", "date", "subject", "text")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(status, pa.int32()), pa.array(made, pa.int32())], names=["id", "ord", "action", "date", "subject", "text", "status", "new_version"])

    return run


def apply_changes(current: DataFrame, changes: DataFrame, subjects: DataFrame):
    """Apply add / update / delete to versioned notes in the order of ``ord``.

    Every change meets the state that the accepted ones before it left, so a later change of the same
    note counts when the first failed or when it expects the version the first made. A change acts on
    one state only (no note, or one version), which makes runs of changes easy to compose:

    1. changes are cut by ranges of (note, ord) into parts, so a note with a third of all changes lies
       in many parts, and lie in order there;
    2. the run at each edge of a part is composed to one table of states and results, and these are
       walked note by note: two rows per part, streamed;
    3. each part is judged from the states that meet it.

    Three passes, however many changes a note has. Returns (new state, one status row per change).
    """
    allowed = subjects.select(F.col("id").alias("subject"), F.lit(True).alias("_ok"))
    bad = note_problem(F.col("date"), F.col("subject"), F.col("text")).isNotNull() | (F.col("_ok").isNull() & (F.col("subject") != "*"))
    wrong = F.coalesce((F.col("action") != "delete") & bad, F.lit(False))
    state = current.select("id", "date", "subject", "text", "version")
    told = changes.join(allowed, "subject", "left").join(state.select("id", F.col("version").cast("long").alias("_version")), "id", "left")
    told = told.select("id", F.col("ord").cast("long").alias("ord"), "action", F.col("expected_version").cast("long").alias("expected_version"), "date", "subject", F.trim("text").alias("text"), wrong.alias("_wrong"), "_version")
    parts = cut_lineage(told.repartitionByRange("id", "ord").sortWithinPartitions("id", "ord").withColumn("_pid", F.spark_partition_id()))
    edges = parts.mapInArrow(_maps, "_pid int, id string, held long, states array<long>, ends array<long>")
    walked = edges.repartition("id").sortWithinPartitions("id", "_pid").mapInArrow(_walk, "_pid int, id string, state long")
    # Two rows per part.
    met = {(r["_pid"], r["id"]): r["state"] for r in walked.collect()}
    schema = "id string, ord long, action string, date string, subject string, text string, status int, new_version int"
    judged = cut_lineage(parts.mapInArrow(_judged(met), schema))
    last = judged.filter("status = 200").groupBy("id").agg(F.max_by(F.struct("action", "date", "subject", "text", F.col("new_version").alias("version")), "ord").alias("n"))
    joined = state.join(last, "id", "full").filter("n is null or n.action <> 'delete'")
    edited = F.col("n").isNotNull()
    made = joined.select("id", *[F.when(edited, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c) for c in ("date", "subject", "text", "version")])
    return made, judged.select("id", "ord", "action", "status", "new_version")
