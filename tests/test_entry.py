import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from edgeloom.queries import QUERIES, SQL

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def same(spark, sf_dir, make, sql):
    got = make(spark, sf_dir).toPandas()
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    want = con.execute(sql).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = lambda d: d[columns].sort_values(columns).reset_index(drop=True)
    pd.testing.assert_frame_equal(order(got), order(want), check_dtype=False)


@pytest.mark.parametrize("name", ["a01_graph_merge", "a01_external_and", "p06_nodes", "p11_slice_edges", "g02_reachable", "g05_cycles", "r02_denylist", "r06_first_layer_wins", "r08_diagram", "m14_lcom4", "m19_normalized_distance", "j11_impl_association", "k05_mermaid_lines", "j02_longest_prefix", "j05_candidate_cardinality", "p14_two_captures", "f04_unicode_class", "m14_lcom1", "f01_normalize_identifier"])
def test_query_equals_its_sql(spark, sf_dir, name):
    same(spark, sf_dir, QUERIES[name], SQL[name])


def test_every_query_of_the_catalogue_has_sql():
    assert set(QUERIES) == set(SQL)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_flagship(spark):
    assert entry.entry(spark).columns == ["source", "target", "external", "import_kinds"]
