"""A sample of the queries against their SQL twins at sf0.001; the driver compares all at sf0.01."""

import duckdb
import pytest

from genoweave.plans import catalogue

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = ["variant_marginals", "pair_counts_rd", "hypergeom_tail", "variant_gene_interval_join", "fdr_dominance_counts", "qc_maf", "pheno_perm_cluster", "carry_forward_reason", "src_whitespace_tokens"]


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", NAMES)
def test_twin(spark, duck, sf, name):
    got = catalogue.QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    twin = duck.sql(catalogue.SQL[name])
    assert sorted(twin.columns) == columns
    key = lambda rows: sorted(tuple("" if v is None else f"{float(v):.5f}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert key(got.select(*columns).collect()) == key(twin.project(", ".join(f'"{c}"' for c in columns)).fetchall())


def test_every_twin_has_a_query():
    assert set(catalogue.SQL) <= set(catalogue.QUERIES)
    assert len(catalogue.QUERIES) > 100


def test_entry(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark)
    assert set(rows.columns) == {"u", "v", "g11", "x11"} and rows.count() > 0
