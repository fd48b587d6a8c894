import numpy as np
import pytest

from metricloom.llm import transcript


def viterbi(model, seen):
    matrix = transcript._line_matrix(model)
    score = np.full(transcript.N, -np.inf)
    score[0], back = 0.0, []
    for s in seen:
        step = score[:, None] + matrix(s)
        back.append(step.argmax(0))
        score = step.max(0)
    path = [int(score.argmax())]
    for b in back[:0:-1]:
        path.append(int(b[path[-1]]))
    return [transcript.STATES[k] for k in reversed(path)]


@pytest.fixture(scope="module")
def talk(spark):
    return transcript.flatten(spark.read.parquet("/root/testdata/sf0.1/conversations.parquet")).cache()


def test_held_out_turns_return(spark, talk):
    span = transcript.PARTS * transcript.TURN_LINES
    got = transcript.turns(transcript.decode(talk.select("conv_id", "line_no", "line"), transcript.learn(talk), span)).toPandas()
    import zlib

    truth = spark.read.parquet("/root/testdata/sf0.1/conversations.parquet").toPandas()
    truth = truth[[zlib.crc32(str(c).encode()) % 4 == 2 for c in truth["conv_id"]]]
    found = {(c, f // transcript.TURN_LINES): (r, t) for c, f, r, t in zip(got["conv_id"], got["first_line"], got["role"], got["text"], strict=True)}
    right = sum(found.get((c, t)) == (r, x) for c, t, r, x in zip(truth["conv_id"], truth["turn"], truth["role"], truth["text"], strict=True))
    print("turns returned exactly", right / len(truth))
    assert right / len(truth) > 0.93
    assert got["rendered"].str.match(r"(?s)<\|(system|user|assistant)\|>\n.*\n<\|end\|>\n$").all()


def test_cut_decoding_equals_plain_viterbi(spark, talk, monkeypatch):
    model = transcript.learn(talk)
    long = [(7, i, r["line"]) for i, r in enumerate(talk.select("line").orderBy("conv_id", "line_no").limit(1200).collect())]
    rows = long + [(8, 0, "User: hi"), (8, 5, None), (8, 9, "A: x"), (None, 0, "Human: a"), (None, None, "b?"), (9, 3, "")]
    lines = spark.createDataFrame(rows, "conv_id long, line_no long, line string").repartition(4)
    monkeypatch.setattr(transcript, "PARTS", 7)
    got = transcript.decode(lines, model, 7).collect()
    assert len(got) == len(rows)
    seen = {(r["conv_id"], r["line_no"] or 0, r["line"] or ""): r["seen"] for r in transcript.features(lines).collect()}
    for conv in (7, 8, 9, None):
        own = sorted((r["line_no"], r["line"], r["state"]) for r in got if r["conv_id"] == conv)
        assert [s for _, _, s in own] == viterbi(model, [seen[conv, n, x] for n, x, _ in own])
    assert transcript.turns(transcript.decode(lines, model, 7)).agg({"turn_no": "count"}).first()[0] > 100


def test_no_lines(spark, talk):
    none = talk.limit(0).select("conv_id", "line_no", "line")
    assert transcript.turns(transcript.decode(none, transcript.learn(talk))).count() == 0
    assert transcript.flatten(spark.createDataFrame([(1, None, None, None), (None, 0, "odd", "x\ny")], "conv_id long, turn long, role string, text string")).count() == 5


def score(model, seen, states):
    matrix, at = transcript._line_matrix(model), [0, *map(transcript.STATES.index, states)]
    return sum(matrix(s)[a, b] for s, a, b in zip(seen, at, at[1:], strict=False))


def test_runs_are_bounded_whatever_the_line_numbers(spark, talk, monkeypatch):
    """Repeated and negative numbers: no run is longer than PARTS, and decoding ends and stays exact."""
    model = transcript.learn(talk)
    rows = [(None, i % 3 - 1, x) for i, x in enumerate(["User: hi", "A: x", "", "b?", "more", "User: hi"] * 20)] + [(1, -1, "User: a"), (1, -(1 << 40), "b")]
    lines = spark.createDataFrame(rows, "conv_id long, line_no long, line string").repartition(5)
    monkeypatch.setattr(transcript, "PARTS", 7)
    decoded = transcript.decode(lines, model).cache()
    assert decoded.groupBy("conv_id", "part", "run").count().agg({"count": "max"}).first()[0] <= 7
    seen = {(r["conv_id"], r["line_no"], r["line"]): r["seen"] for r in transcript.features(lines).collect()}
    for conv in (None, 1):
        own = sorted((r for r in decoded.collect() if r["conv_id"] == conv), key=lambda r: r["at"])
        assert [(r["line_no"], r["line"]) for r in own] == sorted((n, x) for c, n, x in rows if c == conv)
        # Alike lines have several best paths, so the path's score is compared.
        each = [seen[conv, r["line_no"], r["line"]] for r in own]
        assert np.isclose(score(model, each, [r["state"] for r in own]), score(model, each, viterbi(model, each)))
    got = transcript.turns(decoded).filter("conv_id is null").collect()
    opened = decoded.filter("conv_id is null and endswith(state, '-open')").count()
    assert sorted(r["turn_no"] for r in got) == list(range(opened))
