import importlib.util
import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
if importlib.util.find_spec("corpus_pipeline") is None:
    pytest.skip("corpus_pipeline.py is not here", allow_module_level=True)

import corpus_pipeline  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

from genoframe.llm import secrets  # noqa: E402
from test_packing import check  # noqa: E402
from test_resemblance import plain_groups  # noqa: E402


def test_stages_against_brute_force(spark, sf, tmp_path):
    """Each stage on its predecessor's result, written and read again, held to plain Python."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = {r["doc_id"]: r for r in docs.collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality classifier", "SimHash near-dedup", "secret scans", "packing"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, sf)
        out.write.parquet(str(tmp_path / str(k)))
        kept = spark.read.parquet(str(tmp_path / str(k)))
        rows = kept.collect()
        if k < 3:
            assert sorted(kept.columns) == sorted(docs.columns)
            after = {r["doc_id"]: r for r in rows}
        if k == 0:
            clean = [d for d, x in labels.items() if x["quality"] == 1]
            assert sum(d in after for d in clean) > 0.97 * len(clean)
        elif k == 1:
            assert set(after) == {d for d, _ in plain_groups([(d, r["text"]) for d, r in before.items()])} and all(after[d] == before[d] for d in after)
        elif k == 2:
            assert set(after) == set(before)
            for d, r in after.items():
                assert not secrets.base_spans(r["text"]) and r["n_chars"] == len(r["text"]) or r["text"] == before[d]["text"]
        else:
            check(rows, {d: r["text"] for d, r in before.items()})
            break
        docs, before = kept, after
    assert sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) == sorted(map(tuple, rows))


@pytest.mark.parametrize("with_pipeline", [True, False])
def test_entry_works_without_this_subpackage(tmp_path, with_pipeline):
    """The rest imports and lists its queries when the llm folder is gone, whether or not corpus_pipeline.py is."""
    package = tmp_path / "genoframe"
    package.mkdir()
    for child in (ROOT / "genoframe").iterdir():
        if child.name not in ("llm", "__pycache__"):
            os.symlink(child, package / child.name)
    for name in ("__spark_entry__.py", *(["corpus_pipeline.py"] if with_pipeline else [])):
        (tmp_path / name).write_text((ROOT / name).read_text())
    code = "import __spark_entry__ as e; q = e.queries(); assert q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, check=True, timeout=120)


def test_stages_take_empty_tables_null_keys_and_clashing_names(spark, sf, tmp_path):
    """No rows stay no rows through all stages; rows of a null or repeated key go through as any other; columns that stages use inside are just columns."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    more = docs.limit(40).withColumn("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("doc_id")).when(F.col("doc_id") % 3 == 1, F.lit(7)))
    odd = more.unionByName(more.limit(5)).unionByName(docs.limit(1).withColumn("text", F.lit(None).cast("string")))
    for name in ("h1", "h2", "id", "row", "keep", "posting", "tokens", "cluster"):
        odd = odd.withColumn(name, F.lit("clash"))
    for k, given in enumerate((docs.where("false"), odd)):
        given.write.parquet(str(tmp_path / f"in{k}"))
        now = spark.read.parquet(str(tmp_path / f"in{k}"))
        for j, (_, stage) in enumerate(corpus_pipeline.STAGES):
            before = now
            stage(spark, now, sf).write.parquet(str(tmp_path / f"out{k}{j}"))
            now = spark.read.parquet(str(tmp_path / f"out{k}{j}"))
            if j < 3:
                assert now.columns == before.columns and (k or now.count() == 0)
                assert not k or 0 < now.count() <= before.count()
        assert (now.count() == 0) == (k == 0)
        if k:
            tokens = now.groupBy("doc_id").agg(F.sum("length")).count()
            assert tokens == before.select("doc_id").distinct().count()


def test_all_eleven_are_registered():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__

    names = __spark_entry__.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
