import os
import shutil
import subprocess
import sys
import tempfile

import brute
import pytest

import corpus_pipeline
from metricloom.llm import quality, secrets

FOLDER = "/root/testdata/sf0.001"


def test_stages_equal_plain_steps(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    good = {r["doc_id"] for r in quality.judge(docs).filter("kept").select("doc_id").collect()}
    left = [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] in good]
    first = {i for i, (_, low) in brute.near_classes(left).items() if i == low}
    left = [(i, t) for i, t in left if i in first]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    hit = {d for d, _, n, *_ in brute.contaminated(left, items) if n}
    want = first - hit
    got = corpus_pipeline.run(spark, FOLDER).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(want)
    masked = secrets.mask(docs.filter(docs["doc_id"].isin(list(want))))
    assert {r["doc_id"]: r["size"] for r in got} == {r["doc_id"]: len(brute.WORD.findall(r["text"] or "")) for r in masked.collect()}
    assert all(0 <= r["taken"] <= 3 * r["size"] for r in got)
    assert hit and len(want) < docs.count()


def test_stages_keep_columns_and_bear_odd_rows(spark, odd, empty):
    for docs in (odd, empty):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, FOLDER)
            assert docs.columns == odd.columns
        assert set(corpus_pipeline.STAGES[-1][1](spark, docs, FOLDER).columns) >= {"doc_id", "size", "target", "taken"}


@pytest.mark.parametrize("left", [True, False])
def test_entry_works_with_and_without_the_package(left):
    """Without this package and the pipeline the other queries are still there."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    with tempfile.TemporaryDirectory() as copy:
        shutil.copytree(f"{root}/metricloom", f"{copy}/metricloom", ignore=None if left else shutil.ignore_patterns("llm"))
        for name in ["__spark_entry__.py", *(["corpus_pipeline.py"] if left else [])]:
            shutil.copy(f"{root}/{name}", copy)
        code = "import __spark_entry__ as e; q = e.queries(); print(len(q), 'pipeline' in q, any(k.startswith('op1_') for k in q))"
        said = subprocess.run([sys.executable, "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, check=True)
    count, *found = said.stdout.split()[-3:]
    assert int(count) > 100 and found == [str(left)] * 2
