from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[2] / "tools"))
DATA = Path("/root/testdata/sf0.001")

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")


def _queries():
    from sparkledger.llm.queries import R

    return R


def test_records_of_both_kinds_ranked_by_the_model(spark, tmp_path):
    """award_detail contradicts two sources that agree: the fixed order takes its values, the model doesn't."""
    for name, key in (("ref_recipients", "uei"), ("ref_agencies", "agency_id")):
        rows = [(3 * i + k, f"{key}{i}", f"{'wrong' if s == 'award_detail' else 'right'} {i}", None, s, None) for i in range(40) for k, s in enumerate(("award_detail", "transaction", "none"))]
        spark.createDataFrame(rows, f"row_id long, {key} string, name string, parent_uei string, source string, observed_on date").write.parquet(f"{tmp_path}/{name}.parquet")
    got = _queries().queries["p5_records"](spark, str(tmp_path)).collect()
    assert {(r["entity_kind"], r["entity_id"]): r["name"] for r in got} == {(k, f"{key}{i}"): f"right {i}" for k, key in (("recipient", "uei"), ("agency", "agency_id")) for i in range(40)}
    assert all(r["parent_uei"] is None and r["parent_uei_row_id"] == 0 and r["parent_uei_values"] == [] for r in got)


@pytest.mark.parametrize("name", list(_queries().queries))
def test_query(spark, name):
    from compare import compare, views

    r = _queries()
    said = compare(spark, views(str(DATA)), name, r.queries[name], r.oracles.get(name), str(DATA))
    assert "DIFFERS" not in said, said
