import brute

from metricloom.llm import mixing


def plain_targets(sizes, weights=(1, 2, 3)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full, left = {}, set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in full]
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 3 * sizes[s]]
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s], left = 3.0 * sizes[s], left - 3 * sizes[s]
            full.add(s)


def check(docs, shards=1):
    rows = docs.collect()
    got = mixing.mix(docs).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["size"]) for r in got) == sorted((r["doc_id"] is None, r["doc_id"] or 0, len(brute.WORD.findall(r["text"] or ""))) for r in rows)
    sizes = {}
    for r in rows:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(brute.WORD.findall(r["text"] or ""))
    want = plain_targets(sizes)
    source = {r["doc_id"]: r["source"] for r in rows}
    taken = dict.fromkeys(sizes, 0)
    for r in got:
        s = source[r["doc_id"]]
        assert abs(r["target"] - want[s]) < 1e-6 * max(1, want[s]) and r["source_size"] == sizes[s] and 0 <= r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    for s in sizes:
        assert abs(taken[s] - want[s]) <= mixing.BLOCK * (1 + shards), (s, taken[s], want[s])
    assert sorted(map(str, mixing.mix(docs.repartition(7)).collect())) == sorted(map(str, got))


def test_targets_and_quotas(given, odd):
    check(given)
    check(odd)


def test_many_shards(given, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    check(given, shards=120)


def test_shards_in_levels(spark, given, monkeypatch):
    """Three levels of groups of at most 4; no quota exceeds three times its shard."""
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    monkeypatch.setattr(mixing, "FANOUT", 4)
    check(given, shards=400)
    rows = [(s, h, 160 + 16 * h) for s in ("a", None) for h in range(50)]
    sizes = sum(r[2] for r in rows) // 2
    parts = spark.createDataFrame([(*r, sizes, 1000) for r in rows], "source string, shard long, shard_size long, source_size long, source_quota long")
    got = mixing.shard_quotas(parts, 50).collect()
    assert len(got) == 100 and sum(r["quota"] for r in got if r["source"] is None) == 1000
    assert all(abs(r["quota"] - 1000 * r["shard_size"] / sizes) < 3 for r in got)


def test_rows_without_identifier_are_spread(spark, given, monkeypatch):
    monkeypatch.setattr(mixing, "SHARD_WORDS", 4000)
    from pyspark.sql import functions as F

    bare = given.withColumn("doc_id", F.when(F.col("doc_id") % 3 > 0, F.col("doc_id"))).withColumn("source", F.lit("one"))
    key = F.conv(F.substring(mixing._key("doc_id", "text"), 1, 8), 16, 10).cast("long")
    sizes = sorted(r["count"] for r in bare.groupBy(F.pmod(key, F.lit(20))).count().collect())
    assert len(sizes) == 20 and sizes[-1] < 2 * sizes[10]


def test_seats_go_to_the_highest_quotients(spark):
    rows = [(i, float(w)) for i, w in enumerate([1, 7, 7, 40, 333, 2, 0, 90, 15])]
    df = spark.createDataFrame(rows, "source int, w double")
    from pyspark.sql import functions as F

    for seats in (0, 1, 3, 10, 57, 400):
        got = {r["source"]: r["quota"] for r in mixing.apportion(df, [], ["source"], F.col("w"), F.lit(495.0), F.lit(seats), F.lit(10**9)).collect()}
        want = dict.fromkeys(got, 0)
        for _ in range(seats):
            want[max((w / (2 * want[i] + 1), -i) for i, w in rows)[1] * -1] += 1
        assert got == want


def test_table_without_rows(empty):
    assert mixing.mix(empty).count() == 0
