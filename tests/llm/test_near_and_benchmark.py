import random

import brute
import numpy as np
import pytest

from metricloom.llm import decontaminate, hyperminhash


def nulls_first(rows):
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, str(r)))


@pytest.fixture(scope="module")
def copies(spark):
    """A large group of near copies with many different edits, small sets, repeats and odd texts."""
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows = []
    for i in range(220):
        w = list(base)
        for _ in range(rng.choice([0, 1, 3, 6, 8, 10, 12])):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        rows.append((1000 + i, " ".join(w)))
    rows += [(i, t) for i, t in enumerate([None, "", " \n", "One", "one", "one two", "One Two three", "a b c d e f", "a b c d e f g", "f e d c b a", "é à", "É à"])]
    rows += [(500 + i, " ".join(rng.choice(vocabulary[:30]) for _ in range(rng.randint(2, 12)))) for i in range(150)]
    rows += [(700 + i, " ".join(vocabulary[i : i + 60])) for i in range(0, 60, 3)]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(5)


@pytest.mark.parametrize("name", ["copies", "given"])
def test_classes_equal_all_pairs(request, name):
    docs = request.getfixturevalue(name)
    want = brute.near_classes([(r["doc_id"], r["text"]) for r in docs.collect()])
    rows = hyperminhash.group(docs).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_one_of_each_class_stays(spark, copies, odd):
    kept = hyperminhash.keep_one(copies)
    want = {i for i, (_, low) in brute.near_classes([(r["doc_id"], r["text"]) for r in copies.collect()]).items() if i == low}
    assert kept.columns == copies.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(want)
    assert sorted(hyperminhash.keep_one(odd).toPandas()["doc_id"].value_counts().unique()) == [1]


def test_estimate_corrects_chance_agreement():
    rng = np.random.default_rng(5)
    values = np.unique(rng.integers(0, 2**63, 9000).astype(np.uint64))
    a, b = values[:5000], values[1000:6000]
    sketch = [hyperminhash.registers(np.sort(x), np.array([0, len(x)])).reshape(1, -1) for x in (a, b)]
    assert abs(hyperminhash.estimate(*sketch, np.array([5000.0]), np.array([5000.0]))[0] - 4000 / 6000) < 0.12


ITEMS = [(1, "the quick brown fox jumps over the lazy dog and then some more words"), (2, "Short ITEM, here"), (3, None), (4, "--"), (5, "übung macht den meister"), (2, "Short ITEM, here")]


def test_hits_equal_plain_search(spark, odd):
    texts = [
        (100, "x The quick, brown fox jumps over the lazy dog and then some more words y short item here short item here"), (101, "the quick brown fox jumps over the lazy cat and then"),
        (102, "Übung macht den meister übung macht den meister"), (103, "short item"), (104, "here short item here"), (105, "übung MACHT den meister"),
    ]
    docs = odd.select("doc_id", "text").union(spark.createDataFrame(texts, "doc_id long, text string"))
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.digest(decontaminate.search(decontaminate.build(docs), decontaminate.windows(items))).collect()
    assert nulls_first(map(tuple, got)) == nulls_first(brute.contaminated([(r[0], r[1]) for r in docs.collect()], ITEMS))


def test_hits_in_given_documents(spark, given, monkeypatch):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    want = nulls_first(brute.contaminated([(r["doc_id"], r["text"]) for r in given.collect()], [(r["item_id"], r["text"]) for r in items.collect()]))
    index = decontaminate.build(given)
    assert nulls_first(map(tuple, decontaminate.digest(decontaminate.search(index, decontaminate.windows(items))).collect())) == want
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 60_000)
    assert nulls_first(map(tuple, decontaminate.digest(decontaminate.search(index, decontaminate.windows(items))).collect())) == want


def test_proximity_and_spans(spark):
    docs = spark.createDataFrame([(1, "a b alpha beta gamma delta c"), (2, "alpha beta inserted gamma delta"), (3, "alpha x x x x beta gamma delta")], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma delta")], "item_id long, text string")
    rows = {r["doc_id"]: r for r in decontaminate.search(decontaminate.build(docs), decontaminate.windows(items), slack=1).collect()}
    assert rows[1]["items"] == ["9"] and rows[1]["spans"] == [[2, 6]] and rows[2]["items"] == [] and rows[2]["near"] == ["9"] and rows[3]["near"] == []


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 100])
def test_ranges_do_not_depend_on_the_blocks(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([(1, "a b c d e f x g h i y")], "doc_id long, text string")
    items = spark.createDataFrame([(1, "a b c d"), (2, "c d e"), (3, "f"), (4, "g h"), (5, "h i")], "item_id long, text string")
    row = decontaminate.search(decontaminate.build(docs), decontaminate.windows(items)).first()
    assert row["spans"] == [[0, 6], [7, 10]] and row["n_hit"] == 9


def test_tables_without_rows(spark, empty, given):
    items = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    assert hyperminhash.group(empty).count() == 0 and hyperminhash.keep_one(empty).count() == 0
    assert decontaminate.keep_clean(empty, items).count() == 0
    assert decontaminate.keep_clean(given, items.limit(0)).count() == given.count()


@pytest.mark.parametrize("most", [decontaminate.BROADCAST_BYTES, 100])
def test_items_without_identifier(spark, monkeypatch, most):
    """They count as one item and hit like others; the hash leaves them out."""
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most)
    docs = spark.createDataFrame([(1, "alpha beta gamma x delta y"), (2, "delta"), (3, "none")], "doc_id long, text string")
    items = spark.createDataFrame([(None, "alpha beta gamma"), (None, "delta"), ("q", "gamma x"), ("", "y")], "item_id string, text string")
    got = {r["doc_id"]: r for r in decontaminate.digest(decontaminate.search(decontaminate.build(docs), decontaminate.windows(items), slack=1)).collect()}
    assert [(got[i]["n_hit"], got[i]["n_items"]) for i in (1, 2, 3)] == [(6, 3), (1, 1), (0, 0)]
    assert got[1]["items_sha256"] == brute.sha(["", "q"]) and got[2]["items_sha256"] == brute.sha([])
    assert [r["doc_id"] for r in decontaminate.keep_clean(docs, items).collect()] == [3]
