"""Details of single awards and vehicles: fetched, cached and laid over the own values."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import UTC, datetime
from decimal import Decimal
from pathlib import Path
from typing import Any

from pyspark.sql import functions as F

from sparkledger.operators.query import overlay_idvs, overlay_money
from sparkledger.plans.dataset import ProcurementSession
from sparkledger.plans.ingest import write_json
from sparkledger.sources.remote import Details


def _path(root: Path, kind: str, identity: str) -> Path:
    if not identity or "/" in identity or identity.startswith("."):
        raise ValueError(f"no identity: {identity!r}")
    return root / "enrichment" / kind / f"{identity}.json"


def _text(v: object) -> str | None:
    """A value as text; numbers without exponent; true and false are no values."""
    if v is None or isinstance(v, bool):
        return None
    out = format(Decimal(str(v)), "f") if isinstance(v, (int, float, Decimal)) else str(v).strip()
    return out or None


def award_fields(payload: Mapping[str, Any]) -> dict[str, str | None]:
    return {"total_obligation": _text(payload.get("total_obligation")), "current_value": _text(payload.get("base_exercised_options")), "potential_value": _text(payload.get("base_and_all_options")), "date_signed": (_text(payload.get("date_signed")) or "")[:10] or None}


def idv_fields(payload: Mapping[str, Any]) -> dict[str, str | None]:
    return {"type_code": _text(payload.get("type")), "type_label": _text(payload.get("type_description"))}


def cached(path: Path, identity: str) -> dict[str, Any] | None:
    """The cached document of this identity; one that can't be read, or is of another, is none."""
    try:
        doc = json.loads(path.read_text())
    except (OSError, ValueError):
        return None
    return doc if isinstance(doc, dict) and doc.get("source_id") == identity else None


def evict(root: str | Path, kind: str, identity: str) -> bool:
    p = _path(Path(root), kind, identity)
    there = p.is_file()
    p.unlink(missing_ok=True)
    return there


def enrich(session: ProcurementSession, kind: str, identity: str, service: Details, refresh: bool = False) -> tuple[dict[str, Any], bool]:
    """The row of an award (kind awards) or vehicle (kind idvs) with its details laid over, and whether these were cached.

    The published tables stay as they are. An identity that the set lacks is an error.
    """
    table, key = {"awards": ("award_record", "award_id"), "idvs": ("ref_idvs", "idv_id")}[kind]
    own = session.tables[table].where(F.col(key) == identity).limit(1)
    if own.isEmpty():
        raise KeyError(f"{identity} is not in the set")
    path = _path(session.root, kind, identity)
    doc = None if refresh else cached(path, identity)
    hit = doc is not None
    if doc is None:
        payload = service.detail(identity)
        doc = {"source_id": identity, "retrieved_at": datetime.now(UTC).isoformat(), "selected": award_fields(payload) if kind == "awards" else idv_fields(payload), "payload": payload}
        write_json(path, doc)
    selected = doc["selected"]
    details = own.sparkSession.createDataFrame([(identity, *selected.values())], ", ".join(f"{c} string" for c in (key, *selected)))
    row = (overlay_money if kind == "awards" else overlay_idvs)(own, details).first()
    return row.asDict(), hit
