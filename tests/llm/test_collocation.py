import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from metricloom.llm import collocation

WORD = re.compile("[^\x20\x09]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain_version(rows, least=10):
    counts, n = {}, Counter()
    for text, lang in rows:
        own = counts.setdefault("und" if lang is None else lang, Counter())
        for piece in re.split("[.,;:!?\x0a-\x0d]", lower(text)):
            w = WORD.findall(piece)
            n["und" if lang is None else lang] += len(w)
            for k in (1, 2, 3):
                own.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        kept = []
        for p, a in found.items():
            if any(len(q) > len(p) and p in (q[:2], q[1:]) and 100 * b >= 50 * a for q, b in found.items() if len(q) == 3 and len(p) == 2):
                continue
            s, _, left, right = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            kept.append((lang, " ".join(p), a, left, right, n[lang], s))
        kept.sort(key=lambda r: (-r[6], -r[2], r[1].encode()))
        out += [(r[0], i + 1, *r[1:]) for i, r in enumerate(kept[:2000])]
    return sorted(out)


@pytest.fixture(scope="module")
def phrased(spark):
    rng = random.Random(11)
    words = [f"w{i}" for i in range(12)] + ["Über", "語", "The", "THE", "x" * 3000]
    rows = [("".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(rng.randint(0, 120))), rng.choice(["en", "de", None, "und"])) for _ in range(120)]
    rows += [(None, "en"), ("", None), (" . ,\n", "fr"), ("a b c " * 400, "it"), ("a b c " * 400, "it"), ("new york city " * 9, "one"), ("new york, " * 5, "one")]
    return spark.createDataFrame(rows, "text string, lang string").repartition(4)


def test_phrases_equal_a_plain_version(phrased):
    want = plain_version([tuple(r) for r in phrased.collect()])
    for burst, room in ((20_000, 600_000), (3, 40)):
        assert sorted(map(tuple, collocation.top(collocation.phrases(phrased, burst=burst, room=room)).collect())) == want
    assert {r[0] for r in want} >= {"en", "de", "und", "it"} and any(r[2].count(" ") == 2 for r in want)


def test_trie_bursts_spills_and_merges():
    rng = np.random.default_rng(2)
    want, runs, trie = Counter(), [], collocation.HatTrie(burst=8, room=300)
    for _ in range(20):
        a, b, c = rng.zipf(1.4, 400) % 50 + 1, rng.integers(1, 2**31, 400) % 9 + 1, rng.integers(0, 4, 400)
        want.update(zip(a.tolist(), b.tolist(), c.tolist(), strict=True))
        trie.add(a, (b << 32) | c)
        assert trie.size == sum(map(trie._weight, trie.root.values()))
        if trie.size > trie.room:
            assert any(not isinstance(x, Counter) for x in trie.root.values())
            before = dict(trie.root)
            runs.append(trie.spill(100))
            taken = set(np.unique(runs[-1][0]).tolist())
            assert trie.size <= 100 and set(trie.root) == set(before) - taken
    runs.append(trie.spill())
    assert trie.size == 0 and not trie.root
    for first, rest, _ in runs:
        assert (np.diff(first) >= 0).all() and (np.diff(rest)[np.diff(first) == 0] > 0).all()
    got = collocation.merged(runs, 5).to_pylist()
    pairs = Counter()
    for (x, y, _), n in want.items():
        pairs[x, y] += n
    assert {(r["w1"], r["w2"]): r["f"] for r in got if r["w3"] is None} == {k: n for k, n in pairs.items() if n >= 5}
    assert {(r["w1"], r["w2"], r["w3"]): r["f"] for r in got if r["w3"] is not None} == {k: n for k, n in want.items() if n >= 5 and k[2]}


def test_score_is_exact_beyond_64_bits(spark):
    rows = [(10**15 + 7, 10**15 + 9, 10**15 + 1021), (3, 10, 7), (10**10 - 1, 10**10, 10**10), (10, 10, 10)]
    got = spark.createDataFrame(rows, "a long, l long, r long").select(collocation.score(F.col("a"), F.col("l"), F.col("r")))
    assert [r[0] for r in got.collect()] == [10**6 * a * a // (b * c) for a, b, c in rows]


def test_empty_table_and_clashing_columns(spark, empty, odd):
    assert collocation.top(collocation.phrases(empty)).count() == 0
    clash = odd.withColumnRenamed("source", "word").withColumnRenamed("n_chars", "block")
    assert sorted(map(tuple, collocation.top(collocation.phrases(clash)).collect())) == plain_version([(r["text"], r["lang"]) for r in odd.collect()])
