"""The pipeline's stages on small tables, beside brute force, and the registered queries."""

import collections
import re
import shutil
import sys
from pathlib import Path

import duckdb
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2]))

import __spark_entry__ as entry
import corpus_pipeline
from rainshade.llm import queries
from tools.check import compare

DATA = Path("/root/testdata/sf0.001")
WHITE = re.compile(r"[\x20\x09-\x0D]")
needs_data = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def test_registered():
    names = entry.queries()
    assert [n for n in names if re.match(r"op\d+_", n)] == list(queries.QUERIES) and "pipeline" in names
    assert sorted(int(n[2:].split("_")[0]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.ORACLES) <= set(queries.QUERIES)


@needs_data
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for table in ("documents", "pages", "benchmark"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    out = compare(name, queries.QUERIES[name](spark, str(DATA)), con, queries.ORACLES[name])
    assert out.startswith("ok"), out


@needs_data
def test_stages(spark):
    docs, counts = spark.read.parquet(f"{DATA}/documents.parquet"), []
    columns, texts = docs.columns, {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: (r["quality"], r["toxic"]) for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r["doc_id"] for r in docs.collect()}
        docs = corpus_pipeline.stored(stage(spark, docs, str(DATA)))
        kept = {r["doc_id"] for r in docs.collect()}
        counts.append(len(kept))
        if i < 4:
            assert docs.columns == columns and kept <= before and docs.count() == len(kept)
        if i == 0:
            clean = [d for d in before if labels.get(d) == (1, 0)]
            assert sum(d in kept for d in clean) >= 0.97 * len(clean)
            assert not any(d in kept for d in before if labels.get(d, (1, 0))[0] == 0)
        elif i == 1:
            groups = collections.defaultdict(list)
            for d in before:
                groups[WHITE.sub("", texts[d] or "")].append(d)
            assert kept == {min(g, key=lambda d: (-len(texts[d] or ""), d)) for g in groups.values()}
        elif i == 4:
            assert kept == before
    assert len(counts) == 5 and counts[3] < counts[2]


def odd_tables(spark, folder, docs):
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(i, i % 2, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")


def test_run_over_odd_and_empty_tables(spark, tmp_path, docs, empty):
    odd_tables(spark, tmp_path / "odd", docs)
    pieces = corpus_pipeline.run(spark, str(tmp_path / "odd"))
    assert pieces.columns[:3] == ["doc_id", "start", "length"] and pieces.count() > 0
    odd_tables(spark, tmp_path / "none", empty)
    assert corpus_pipeline.run(spark, str(tmp_path / "none")).count() == 0


def test_stages_keep_columns_of_any_name(spark, tmp_path, docs):
    odd_tables(spark, tmp_path / "odd", docs)
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:4]:
        frame = corpus_pipeline.stored(stage(spark, frame, str(tmp_path / "odd")))
        assert frame.columns == docs.columns
        assert frame.select("_tokens", "_version", "_quality", "_mix", "_cell").distinct().collect() == [(77, "v", 3, 4, "c")]


def test_the_rest_works_without_the_text_package(tmp_path):
    import subprocess
    root = Path(__file__).resolve().parents[2]
    for part in ("rainshade", "tools"):
        shutil.copytree(root / part, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 180 and 'pipeline' not in q and set(e.oracle_sql()) <= set(q); print('fine')"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=120)
    assert out.stdout.strip().endswith("fine"), out.stderr
