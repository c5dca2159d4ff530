from __future__ import annotations

import pytest

from colloquy.plans import catalog
from tests.oracle import connect, same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_equals_its_sql(spark, name):
    same(catalog.QUERIES[name](spark, SF).toPandas(), connect(SF).sql(catalog.ORACLE[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE)))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 20


def test_searches_ask_with_every_fiftieth_id(spark):
    ids = {r.vec_id for r in spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id % 50 = 0").select("vec_id").collect()}
    for name in ("knn_topk", "maxpool_rank", "hybrid_rank"):
        assert {r.query_id for r in catalog.QUERIES[name](spark, SF).select("query_id").distinct().collect()} == ids


def test_every_print_is_tried(spark):
    n = spark.read.parquet(f"{SF}/embeddings.parquet").count()
    assert catalog.QUERIES["identify_open_set"](spark, SF).count() == n // 2
    assert catalog.QUERIES["raised_bars"](spark, SF).count() == n


def test_word_distance_of_all_turns_equals_brute_force(spark):
    from colloquy.plans import fixtures

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            left, row = row, [i]
            for j, y in enumerate(b, 1):
                row.append(min(left[j] + 1, row[-1] + 1, left[j - 1] + (x != y)))
        return row[-1]

    want = {r.pair_id: (len(r.ref_tokens), distance(r.ref_tokens, r.hyp_tokens)) for r in fixtures.tokens(spark, SF).collect()}
    got = {r.pair_id: (r.n_ref, r.distance) for r in catalog.QUERIES["wer_distance"](spark, SF).collect()}
    assert got == want and len(got) == spark.read.parquet(f"{SF}/conversations.parquet").count()


def test_every_band_of_deletion_runs_occurs(spark):
    assert {r.band for r in catalog.QUERIES["deletion_run_bands"](spark, SF).collect()} == {"1", "2-4", "5-9", "10+"}


def test_everything_imports_without_a_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], check=True)
