import os

import pytest
from compare import TABLES, assert_same, connect

from pairforge.plans import registry

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_matches_sql(spark, con, name):
    assert_same(registry.QUERIES[name](spark, SF), con, registry.ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_query_without_sql_gives_the_same_rows_twice(spark, name):
    one, two = (sorted(map(repr, registry.QUERIES[name](spark, SF).collect())) for _ in range(2))
    assert one == two


def test_every_sql_has_a_query():
    assert set(registry.ORACLE) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", ["bootstrap_ci", "paired_bootstrap"])
def test_bootstraps_draw_the_stated_resamples(spark, name):
    # resamples of one class only don't count
    assert 4500 < registry.QUERIES[name](spark, SF).first().valid <= 5000


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["left", "right", "group_size", "overlap"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="module")
def halves(tmp_path_factory):
    """Tables in which a supplier's share, 41 of 640 lines, is a half in the seventh place; 80 others share a lot with it each."""
    out = tmp_path_factory.mktemp("halves")
    for name in set(TABLES) - {"supplier", "part", "lineitem"}:
        (out / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    made = connect(SF)
    # supplier 0 has lines 0 to 639 on parts of their own, 41 of brand 0 and at most 40 of each other brand
    made.sql(f"copy (select i::bigint as s_suppkey, 'S' || i as s_name, (i % 25)::int as s_nationkey, i * 300.0::double as s_acctbal from range(81) r(i)) to '{out}/supplier.parquet'")
    made.sql(f"copy (select i::bigint as p_partkey, 'part ' || i as p_name, 'B' || case when i < 41 then 0 else 1 + i % 20 end as p_brand, 'T' || i % 7 as p_type, (i % 50)::int as p_size, 1.0::double as p_retailprice from range(640) r(i)) to '{out}/part.parquet'")
    made.sql(f"""copy (select i::bigint as l_orderkey, (i % 640)::bigint as l_partkey, greatest(0, i - 639)::bigint as l_suppkey, 1::int as l_linenumber, (1 + i % 640 % 50)::double as l_quantity, (1000 + i * 37 % 9973)::double as l_extendedprice,
        (i % 11 / 100)::double as l_discount, 0.01::double as l_tax, ['A', 'N', 'R'][i % 3 + 1] as l_returnflag, 'F' as l_linestatus, timestamp '1995-01-01' as l_shipdate from range(720) r(i)) to '{out}/lineitem.parquet'""")
    return str(out)


@pytest.mark.parametrize("name", ["candidate_queue", "candidate_rank"])
def test_ranks_match_sql_where_shares_end_in_a_half(spark, halves, name):
    found = registry.QUERIES[name](spark, halves)
    assert found.count() >= 80
    assert_same(found, connect(halves), registry.ORACLE[name])
