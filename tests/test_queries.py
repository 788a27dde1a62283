import pytest

from flowloom.plans.oracles import ORACLES
from flowloom.plans.queries import QUERIES
from tests.oracle import same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, small, name):
    same(QUERIES[name](spark, small), ORACLES[name], small)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_query_without_sql_has_rows(spark, small, name):
    rows = QUERIES[name](spark, small)
    assert len(rows.columns) == len(set(rows.columns))
    assert rows.count() > 0


def test_flows_are_created_anew_after_eviction(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["flow_create"](spark, sf)
    same(rows, ORACLES["flow_create"], sf)
    assert rows.count() > rows.select("flow_id").distinct().count()


@pytest.mark.parametrize("name", ["filter_dns_bpf", "filter_traffic_bpf", "project_ports_ips", "decode_frames"])
def test_the_data_meet_each_rule_both_ways(spark, name):
    small = "/root/testdata/sf0.01"
    rows, all_rows = QUERIES[name](spark, small), QUERIES["direction_host"](spark, small).count()
    if name.startswith("filter"):
        assert 0 < rows.count() < all_rows
    elif name == "decode_frames":
        assert {(r.is_ipv4, r.proto) for r in rows.collect()} == {(v, p) for v in (True, False) for p in (6, 17)}
    else:
        assert {r.is_local for r in rows.collect()} == {True, False} and rows.where("seq > 4294966000").count() and rows.where("is_tcp and seq < 1000").count()
