import importlib
import re

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from sphaera.llm import decontaminate, neardup, pii, toxicity
from sphaera.llm.common import materialise, read_table

SF = "/root/testdata/sf0.001"


def test_names():
    names = [re.match(r"op(\d+)_", k) for k in entry.queries()]
    assert {int(m[1]) for m in names if m} == set(range(1, 11)) and "pipeline" in entry.queries()


def test_stages_take_effect(spark, odd):
    docs = read_table(spark, SF, "documents")
    steps = []
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = materialise(stage(spark, now, SF), name)
        steps.append(now)
        if name != "encoding":
            assert now.columns == docs.columns
    assert steps[0].count() <= docs.count() and steps[-1].count() == steps[-2].count()
    assert neardup.near_duplicates(steps[1], 5, 80).where("NOT kept").count() == 0
    assert decontaminate.contaminated(steps[2], read_table(spark, SF, "benchmark")).count() == 0
    assert pii.digest(pii.detect(steps[3])).where("n_email + n_ip + n_phone > 0").count() == 0
    assert toxicity.reject(odd, read_table(spark, SF, "labels")).columns == odd.columns


def test_whole_run_of_odd_and_empty_tables(spark, odd, empty, tmp_path):
    """Null ids and texts, repeated rows, extra columns with names the stages use, and no rows at all."""
    for name, table in (("odd", odd), ("empty", empty)):
        at = str(tmp_path / name)
        table.withColumnsRenamed({"uid": "_row", "word": "component_id"}).write.parquet(f"{at}/documents.parquet")
        for other in ("benchmark", "labels"):
            read_table(spark, SF, other).write.parquet(f"{at}/{other}.parquet")
        out = corpus_pipeline.run(spark, at).collect()
        texts = {r["text"] for r in table.collect()}
        assert len(out) == (table.count() - 1 if texts else 0)  # one of two ids with the same text goes
    kept = [r["doc_id"] for r in out]
    assert kept == []


@pytest.mark.parametrize("module", ["sphaera", "sphaera.registry"])
def test_library_does_not_import_this_package(module):
    import subprocess
    import sys

    code = f"import {module}, sys; assert not any(m.startswith('sphaera.llm') for m in sys.modules)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=str(importlib.import_module("pathlib").Path(entry.__file__).parent))
