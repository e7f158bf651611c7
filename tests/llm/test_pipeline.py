"""The pipeline against brute force, stage by stage, and the entry module without the optional parts."""

import os
import shutil
import subprocess
import sys
from collections import Counter, defaultdict

import pytest
from test_llm_operators import CLASHES, SCHEMA, SF, awkward, brute_fingerprint, brute_groups, lower, targets

import corpus_pipeline
from branchwise.llm import toxicity
from branchwise.llm.tokens import Encoder, default_vocabulary
from branchwise.session import ship_package, stored

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables not present")
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))


def test_stages(spark):
    ship_package(spark)
    docs = spark.createDataFrame([r + ("x",) * len(CLASHES) for r in awkward()], SCHEMA).repartition(3)
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        after = stored(stage(spark, before, SF), f"test-{k}")
        a, b = before.collect(), after.collect()
        if k < 4:
            assert after.columns == docs.columns
        if k == 0:
            bad = {r.doc_id for r in toxicity.severity(before, labels).where("rejected").collect()}
            assert Counter(map(tuple, b)) == Counter(tuple(r) for r in a if r.doc_id not in bad)
        elif k == 1:
            best = {}
            for r in a:
                best.setdefault(lower(r.text), []).append(r.doc_id)
            want = Counter(max((i for i in ids if i is not None), default=None) for ids in best.values())
            assert Counter(r.doc_id for r in b) == want and Counter(lower(r.text) for r in b) == Counter(best.keys())
        elif k == 2:
            fps = [brute_fingerprint(r.text) for r in a]
            assert Counter(r.doc_id for r in b) == Counter(set(brute_groups(fps, [r.doc_id for r in a])))
        elif k == 3:
            sizes, words = defaultdict(int), defaultdict(int)
            for r in a:
                sizes[r.source] += len((r.text or "").encode().split())
            for r in b:
                words[r.source] += len(r.text.encode().split())
            assert all(abs(words[s] - t) <= 0.5 + 1e-6 for s, t in targets(sizes).items())
            whole = {(r.doc_id, r.text) for r in a}
            assert sum((r.doc_id, r.text) not in whole for r in b) <= len(sizes)
        else:
            enc = Encoder(default_vocabulary())
            n = sum(len(x) // 2 + 1 for x in enc.encode([r.text for r in a]))
            assert sum(r.length for r in b) == n and max(r.offset + r.length for r in b) <= 1024
        before = after


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_run_on_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_entry_without_the_optional_parts(tmp_path):
    shutil.copytree(f"{ROOT}/branchwise", tmp_path / "branchwise", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{ROOT}/__spark_entry__.py", tmp_path)
    (tmp_path / "branchwise" / "llm" / "__pycache__").mkdir(parents=True)  # what a deletion may leave
    code = "import __spark_entry__ as e; q, s = e.queries(), e.oracle_sql(); print(len(q), any(k.startswith('op') for k in q), set(s) <= set(q))"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    got = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, capture_output=True, text=True, check=True)
    n, llm, covered = got.stdout.split()[-3:]
    assert int(n) > 100 and llm == "False" and covered == "True"
