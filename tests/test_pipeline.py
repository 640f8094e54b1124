"""End to end: files to a published set, sessions, index; failures leave nothing behind."""

from __future__ import annotations

import csv
from datetime import date
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sparkledger.operators import query as q
from sparkledger.operators import semantic
from sparkledger.plans import materialize as m
from sparkledger.plans.dataset import ProcurementSession, StaleSelection
from sparkledger.plans.semantic_index import IndexError_, SemanticIndex, build_index
from sparkledger.sources import published
from sparkledger.sources.columns import PROJECTED
from sparkledger.sources.projected import header, load_projected, require_columns
from sparkledger.streaming.arrivals import append_arrivals

BASE = {"contract_transaction_unique_key": "TXN_1", "contract_award_unique_key": "AWD_1", "action_date": "2025-01-15", "federal_action_obligation": "1.00", "transaction_number": "0"}


def write(path, rows, columns=(*PROJECTED, "extra")):
    with open(path, "w", newline="") as f:
        w = csv.DictWriter(f, columns, restval="")
        w.writeheader()
        w.writerows([{**BASE, **r} for r in rows])
    return path


def fixture_rows():
    """Awards of the query fixture: two by Alpha, one by Beta, one sparse by Gamma."""
    alpha = {"recipient_uei": "UEI_ALPHA", "recipient_name": "Alpha Corp", "awarding_agency_code": "097", "awarding_agency_name": "Defense", "awarding_sub_agency_code": "1700", "awarding_sub_agency_name": "Navy", "awarding_office_code": "N00024", "naics_code": "541330", "naics_description": "Engineering", "product_or_service_code": "R425", "product_or_service_code_description": "Support", "recipient_country_code": "USA", "recipient_state_code": "VA", "recipient_city_name": "Arlington"}
    fund = {"funding_agency_code": "097", "funding_sub_agency_code": "1700", "funding_office_code": "N00024"}
    money = lambda x: dict.fromkeys(("total_dollars_obligated", "current_total_value_of_award", "potential_total_value_of_award"), x)
    at = lambda state, city: {"primary_place_of_performance_country_code": "USA", "primary_place_of_performance_state_code": state, "primary_place_of_performance_city_name": city}
    row = lambda t, a, day, amount, *more: {"contract_transaction_unique_key": t, "contract_award_unique_key": a, "action_date": day, "federal_action_obligation": amount, "award_id_piid": f"PIID-{a}", **{k: v for x in more for k, v in x.items()}}
    beta = {**alpha, "recipient_uei": "UEI_BETA", "recipient_name": "Beta LLC", "awarding_sub_agency_code": "5700", "awarding_office_code": "W15P7T", "naics_code": "336411", "naics_description": "", "product_or_service_code": "1510", "recipient_city_name": "Reston"}
    return [
        row("T1A", "A1", "2025-01-10", "100.00", alpha, fund, money("150"), at("VA", "Arlington"), {"transaction_description": "radar  repair"}),
        row("T1B", "A1", "2025-02-10", "50.00", alpha, fund, money("150"), at("VA", "Arlington"), {"transaction_description": "Radar repair"}),
        row("T2", "A2", "2025-01-15", "200.00", beta, fund, money("200"), at("MD", "Bethesda")),
        row("T3A", "A3", "2025-01-20", "75.00", alpha, money("75"), at("CA", "San Diego")),
        row("T3B", "A3", "2025-01-21", "", {**alpha, "recipient_name": ""}, money("75"), at("CA", "San Diego")),
        row("T4", "A4", "2025-01-12", "", {"recipient_uei": "UEI_GAMMA", "recipient_name": "Gamma Inc"}, at("TX", "Austin")),
    ]


@pytest.fixture(scope="module")
def root(spark, tmp_path_factory):
    r = tmp_path_factory.mktemp("root")
    done = m.materialize(spark, [write(r / "a.csv", fixture_rows())], r)
    assert (done.published, done.valid, done.invalid) == (True, 6, 0)
    return r


@pytest.fixture(scope="module")
def session(spark, root):
    with ProcurementSession.open(spark, root) as s:
        yield s


def test_header_contract(tmp_path):
    with pytest.raises(ValueError, match="no header"):
        header(write_empty(tmp_path / "e.csv"))
    with pytest.raises(ValueError, match="twice"):
        require_columns("f", [*PROJECTED, PROJECTED[0]])
    with pytest.raises(ValueError, match="missing: potential"):
        require_columns("f", [c for c in PROJECTED if not c.startswith("potential")])


def write_empty(p):
    p.write_text("")
    return p


def test_load_keeps_order_and_line_breaks(spark, tmp_path):
    a = write(tmp_path / "a.csv", [{"transaction_description": 'two\nlines, "quoted"'}, {"contract_transaction_unique_key": "T2"}])
    b = write(tmp_path / "b.csv", [{"contract_transaction_unique_key": "T3"}], tuple(reversed(PROJECTED)))
    rows = load_projected(spark, [a, b]).orderBy("_load_seq").collect()
    assert [r["contract_transaction_unique_key"] for r in rows] == ["TXN_1", "T2", "T3"]
    assert rows[0]["transaction_description"] == 'two\nlines, "quoted"'
    odd = [write(tmp_path / n, [{"contract_transaction_unique_key": f"{n}{k}"} for k in range(3)]) for n in ("z 1.csv", "a+b%41é.csv", "m#.csv")]
    many = load_projected(spark, [*odd, a, b])
    got = many.orderBy("_load_seq").collect()
    assert [r["contract_transaction_unique_key"] for r in got] == [f"{p.name}{k}" for p in odd for k in range(3)] + ["TXN_1", "T2", "T3"]
    assert [(r["_input_index"], r["_source_path"]) for r in got[::3]] == [(0, str(odd[0])), (1, str(odd[1])), (2, str(odd[2])), (3, str(a))]
    assert str(many._jdf.queryExecution().optimizedPlan()).count("Relation") == 2  # one per header, not per file
    with pytest.raises(ValueError, match="twice"):
        load_projected(spark, [a, a])
    with pytest.raises(FileNotFoundError):
        load_projected(spark, [tmp_path / "none.csv"])
    with pytest.raises(ValueError):
        load_projected(spark, [])


def test_rejects_copies_and_collisions(spark, tmp_path):
    a = write(tmp_path / "a.csv", [{}, {"contract_transaction_unique_key": "T2", "federal_action_obligation": "not-a-number"}, {"contract_transaction_unique_key": " "}])
    b = write(tmp_path / "b.csv", [{}, {"contract_transaction_unique_key": "T5"}, {"contract_transaction_unique_key": "T5", "transaction_description": "other"}])
    done = m.materialize(spark, [a, b], tmp_path, run_id="20260101T000000Z_abcdef")
    assert (done.rows_in, done.invalid, done.collision, done.collapsed, done.valid, done.published) == (6, 2, 2, 1, 1, False)
    assert published.read_current(tmp_path) is None
    bad = spark.read.parquet(str(done.path / "rejects.parquet"))
    assert {r[0] for r in bad.select("reject_reason").collect()} == {"malformed:federal_action_obligation", "missing_required:contract_transaction_unique_key", "identity_collision"}
    with pytest.raises(ValueError, match="already"):
        m.materialize(spark, [a, b], tmp_path, run_id="20260101T000000Z_abcdef")
    assert m.materialize(spark, [a, b], tmp_path, allow_rejects=True).published


def test_failed_write_leaves_no_trace(spark, tmp_path, monkeypatch):
    a = write(tmp_path / "a.csv", [{}])
    monkeypatch.setitem(published.FILES, "ref_idvs", "refs/\0bad.parquet")
    with pytest.raises(Exception):  # noqa: B017
        m.materialize(spark, [a], tmp_path, run_id="20260102T000000Z_abcdef")
    assert spark.read.parquet(str(tmp_path / "staging" / "20260102T000000Z_abcdef")).count() == 1  # kept for inspection
    assert not [p for p in (tmp_path / "sets").iterdir()] and published.read_current(tmp_path) is None


def test_integrity_failure_writes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(m, "messages", lambda _: ["pk:x=1"])
    with pytest.raises(m.IntegrityError, match="pk:x=1"):
        m.materialize(spark, [write(tmp_path / "a.csv", [{}])], tmp_path)
    assert not [*(tmp_path / "sets").iterdir()] and published.read_current(tmp_path) is None


def test_open_errors(spark, tmp_path):
    with pytest.raises(published.NoCurrentSet):
        ProcurementSession.open(spark, tmp_path)
    (tmp_path / "CURRENT").write_text("nonsense")
    with pytest.raises(published.DatasetError):
        ProcurementSession.open(spark, tmp_path)
    (tmp_path / "CURRENT").write_text("20260101T000000Z_abcdef")
    with pytest.raises(published.NoCurrentSet):
        ProcurementSession.open(spark, tmp_path)
    published.set_path(tmp_path, "20260101T000000Z_abcdef").mkdir(parents=True)
    with pytest.raises(published.IncompleteSet):
        ProcurementSession.open(spark, tmp_path)


def totals(df, key="award_id"):
    return [(r[key], r["total_obligation"], r["transaction_count"]) for r in df.collect()]


def test_activity(session):
    every = session.resolve()
    assert every.count == 4
    assert totals(session.activity(every, date(2025, 1, 1), date(2025, 1, 31))) == [("A2", Decimal(200), 1), ("A1", Decimal(100), 1), ("A3", Decimal(75), 2)]
    assert totals(session.activity(every, date(2025, 1, 1), date(2025, 12, 31), limit=2)) == [("A2", Decimal(200), 1), ("A1", Decimal(150), 2)]
    assert totals(session.activity(every, date(2025, 1, 1), date(2025, 1, 31), by="recipient"), "recipient_id") == [("UEI_BETA", Decimal(200), 1), ("UEI_ALPHA", Decimal(175), 3)]
    assert session.activity(every, date(2025, 1, 1), date(2025, 1, 31), limit=0).count() == 0
    for bad in ({"limit": -1}, {"by": "office"}):
        with pytest.raises(ValueError):
            session.activity(every, date(2025, 1, 1), date(2025, 1, 31), **bad)
    with pytest.raises(ValueError):
        session.activity(every, date(2025, 2, 1), date(2025, 1, 31))


def test_filters(session):
    ids = lambda **f: session.award_ids(session.resolve(**f))
    assert ids(place=q.PlaceFilter("place_of_performance", state_code="VA")) == {"A1"}
    assert ids(place=q.PlaceFilter("recipient", state_code="VA")) == {"A1", "A2", "A3"}
    assert ids(place=q.PlaceFilter("place_of_performance", city_name=" BETHESDA ")) == {"A2"}
    assert ids(recipient_ids=[]) == frozenset() and ids(recipient_ids=["UEI_ALPHA"], naics_ids=["NAICS:541330"]) == {"A1", "A3"}
    assert ids(award_ids=[f"X{i}" for i in range(400)] + ["A4"]) == {"A4"}
    for bad in (q.PlaceFilter("awarding", state_code="VA"), q.PlaceFilter("recipient")):
        with pytest.raises(ValueError):
            session.resolve(bad)
    assert session.select(["A1", "A1", "NOPE"]).count == 2


def test_traverse(session):
    got = [(r["entity_kind"], r["role"], r["agency_tier"], r["entity_id"]) for r in session.traverse(session.select(["A1"])).collect()]
    kinds = [k for k, *_ in got]
    assert kinds == sorted(kinds, key=q.ENTITY_KINDS.index)
    assert [x for x in got if x[0] == "agency"] == [("agency", "awarding", "toptier", "toptier:097"), ("agency", "awarding", "subtier", "subtier:1700"), ("agency", "funding", "toptier", "toptier:097"), ("agency", "funding", "subtier", "subtier:1700")]
    label = {r["entity_id"]: r["label"] for r in session.traverse(session.select(["A2"]), ["classification"]).collect()}
    assert label["NAICS:336411"] == "336411"
    assert session.traverse(session.resolve(), []).count() == 0
    with pytest.raises(ValueError):
        session.traverse(session.resolve(), ["planet"])


def test_stale_selections(spark, root, session):
    other = ProcurementSession.open(spark, root)
    s = other.resolve()
    with pytest.raises(StaleSelection):
        session.cards(s)
    other.close()
    with pytest.raises(StaleSelection):
        other.award_ids(s)


def test_empty_selections_run_no_job(session):
    none = session.resolve(psc_ids=[])
    for df in (session.activity(none, date(2025, 1, 1), date(2025, 1, 2)), session.traverse(none), session.cards(none)):
        assert "LocalRelation <empty>" in df._jdf.queryExecution().optimizedPlan().toString() and df.collect() == []
    with pytest.raises(ValueError):
        session.activity(none, date(2025, 1, 2), date(2025, 1, 1))


def test_semantic_index(session):
    embedder = semantic.hashed_embedder(64)
    info = build_index(session, embedder, 64, "hash")
    assert info.documents == 3  # A4 says nothing about its work
    with pytest.raises(IndexError_):
        build_index(session, embedder, 64, "hash")
    build_index(session, embedder, 64, "hash", force=True)
    with pytest.raises(IndexError_):
        SemanticIndex.open(session, embedder, 64, "another")
    index = SemanticIndex.open(session, embedder, 64, "hash")
    hits = index.search("radar repair", 2).collect()
    assert hits[0]["award_id"] == "A1" and "- Radar repair" in hits[0]["text"] and "radar  repair" not in hits[0]["text"]
    assert [r["award_id"] for r in index.search("radar repair", 5, candidates=session.select(["A2", "A4"]).award_ids).collect()] == ["A2"]
    assert index.counts() == {"indexed": 3, "candidates": 3} and index.counts(session.select(["A2", "A4"]).award_ids) == {"indexed": 3, "candidates": 1}
    assert [(r["award_id"], r["row_index"]) for r in index.docs.orderBy("row_index").collect()] == [("A1", 0), ("A2", 1), ("A3", 2)]
    assert semantic.misnumbered(index.docs.withColumn("row_index", F.expr("row_index + if(award_id = 'A2', 1, 0)"))).count() == 1
    for bad in ("  ", ""):
        with pytest.raises(ValueError):
            index.search(bad)
    with pytest.raises(ValueError):
        index.search("x", 0)


def test_arrivals_are_appended_once(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    write(inbox / "a.csv", [{}, {"action_date": "soon"}], PROJECTED)
    for _ in range(2):
        append_arrivals(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    assert {(str(r["sound"]).lower() == "true", r["reject_reason"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {(True, None), (False, "malformed:action_date")}
    write(inbox / "b.csv", [{"contract_transaction_unique_key": "T9"}], PROJECTED)
    append_arrivals(spark, str(inbox), str(tmp_path / "out"), str(tmp_path / "chk")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


class Details:
    calls = 0

    def detail(self, source_id):
        self.calls += 1
        return {"total_obligation": 10, "base_exercised_options": "20.00", "base_and_all_options": 30.5, "date_signed": "2024-02-03"}


def test_evidence_and_enrichment(session):
    from sparkledger.plans.enrichment import enrich, evict
    from sparkledger.plans.evidence import EvidenceSession

    e = EvidenceSession(session)
    r = e.resolve(preview=2, recipient_ids=["UEI_ALPHA"])
    assert r["count"] == 2 and [c["award_id"] for c in r["preview"]] == ["A1", "A3"] and set(e.cards) == {"A1", "A3"}
    assert e.traverse(r["selection"], limit=1)["truncated"]
    (kept,) = e.traversals  # whole, though the view shows one
    assert kept["selection"] == r["selection"] and kept["entities"].count() > 1
    assert [c["award_id"] for c in e.evidence(award_ids=["A4", "NO", "A1"])["cards"]] == ["A4", "A1"]
    for bad in ({}, {"ref": r["selection"], "award_ids": []}, {"award_ids": [str(i) for i in range(51)]}):
        with pytest.raises(ValueError):
            e.evidence(**bad)
    with pytest.raises(KeyError):
        e.aggregate("sel_x", date(2025, 1, 1), date(2025, 1, 1))
    d = Details()
    row, hit = enrich(session, "awards", "A4", d)
    assert (row["snapshot_status"], row["date_signed"], hit) == ("not_observed", date(2024, 2, 3), False)
    assert enrich(session, "awards", "A4", d)[1] and d.calls == 1 and evict(session.root, "awards", "A4")
    with pytest.raises(KeyError):
        enrich(session, "awards", "NO", d)


def test_sets_on_a_hadoop_file_system(spark, tmp_path):
    """The same pipeline through Spark's file systems: published, pinned, indexed, replaced."""
    from sparkledger.sources.files import HadoopPath, shared

    root = f"file://{tmp_path}/out"
    a = write(tmp_path / "a.csv", [{"transaction_description": "Radar repair"}])
    done = m.materialize(spark, [a], root)
    assert done.published and isinstance(done.path, HadoopPath) and not (shared(spark, root) / "staging" / done.run_id).exists()
    again = m.materialize(spark, [a], root)
    assert published.read_current(shared(spark, root)) == again.run_id != done.run_id
    with ProcurementSession.open(spark, root) as s:
        embedder = semantic.hashed_embedder(64)
        assert s.run_id == again.run_id and build_index(s, embedder, 64, "hash").documents == build_index(s, embedder, 64, "hash", force=True).documents == 1
        assert SemanticIndex.open(s, embedder, 64, "hash").counts()["indexed"] == 1
    with pytest.raises(published.NoCurrentSet):
        ProcurementSession.open(spark, f"file://{tmp_path}/nowhere")
    p = shared(spark, root) / "x.txt"
    p.write_text("grüße")
    assert p.read_text() == "grüße" and p.is_file() and p.parent.is_dir() and (p.name, str(p.with_name("y"))) == ("x.txt", f"{root}/y")
    with pytest.raises(OSError):
        p.rename(p)
    p.unlink()
    with pytest.raises(FileNotFoundError):
        p.unlink()
