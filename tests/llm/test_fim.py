import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from metricloom.llm import fim

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]")


def plain_version(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc_id, n, "plain", None, None, text
    if h[3] % 100 < 20:
        return doc_id, n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc_id, n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def by_text(rows):
    return sorted(map(tuple, rows), key=lambda r: (r[0] is None, r[0] or 0, str(r)))


def test_rewriting_and_restoring_equal_a_plain_version(spark, odd, given):
    marked = spark.createDataFrame([(i, t) for i, t in enumerate(["x <P> y", "<S>", "a <M", "<" * 40 + " end <", "S>M> text <P", "long " * 60000 + "語" * 5000] * 9)], "doc_id long, text string")
    for docs in (odd, marked, given):
        rows = docs.select("doc_id", "text").collect()
        made = fim.rewrite(docs)
        got = made.withColumn("back", fim.restore(F.col("form"), F.col("output"))).collect()
        assert by_text(r[:6] for r in got) == by_text(plain_version(*r) for r in rows)
        assert sorted(r["back"] for r in got) == sorted(r["text"] or "" for r in rows)
        assert {r["form"] for r in got} >= {"plain", "psm"}


def test_stored_index_gives_every_boundary(spark, odd):
    clash = odd.withColumnRenamed("source", "residuals").withColumnRenamed("lang", "form")
    for error in (0, 3, 127):
        stored = fim.index(clash, keep=("doc_id", "text"), error=error)
        ranks = stored.select("*", F.explode(F.sequence(F.lit(0), F.col("n_units").cast("int"), F.lit(1))).alias("r"))
        ranks = ranks.filter("r < 700 or r > n_units - 50").select("text", "r", "n_units", fim.offset_at(F.col("r").cast("long"), F.col("knot_ranks"), F.col("knot_offsets"), F.col("residuals")).alias("at"))
        cuts = {}
        for row in ranks.collect():
            text = row["text"] or ""
            ends = cuts.setdefault(text, np.cumsum([0, *map(len, UNIT.findall(text))]))
            assert row["n_units"] == len(ends) - 1 and row["at"] == ends[row["r"]], (text[:40], row)


def test_segments_keep_their_bound_and_are_few():
    rng = np.random.default_rng(1)
    texts = ["".join(rng.choice(list("ab ,.é"), 5000)), "a" * 3000 + "." * 3000, "", "x", ". " * 9000]
    found, _, _ = fim.boundaries(pa.array(texts))
    index = fim.RankIndex.fit(found.first, found.chars)
    each = np.repeat(np.arange(len(texts)), np.diff(found.first))
    rank = np.arange(len(each)) - found.first[each]
    assert np.abs(found.chars - index.predict(np.arange(len(each)))).max() <= fim.ERROR
    assert (index.lookup(each, rank) == found.chars).all()
    assert len(index.knots) < 40


def test_empty_table_and_clashing_columns(spark, empty, odd):
    assert fim.digest(fim.rewrite(empty)).count() == 0 and fim.index(empty).count() == 0
    clash = odd.withColumnRenamed("lang", "output").withColumnRenamed("source", "cut_a")
    assert fim.digest(fim.rewrite(clash)).count() == odd.count()
