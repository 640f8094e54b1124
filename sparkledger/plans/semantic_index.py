"""The index of award documents: built aside, checked, then swapped in."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame

from sparkledger.operators import semantic
from sparkledger.plans.dataset import ProcurementSession
from sparkledger.sources.files import SharedPath, place, remove


class IndexError_(RuntimeError):
    """The index is missing, unsound or of another model."""


@dataclass(frozen=True)
class IndexInfo:
    """What an index was made of; a search must use the same model."""

    run_id: str
    model_id: str
    revision: str
    dim: int
    metric: str
    query_prefix: str
    documents: int


def folder(root: str | SharedPath, run_id: str) -> SharedPath:
    return place(root) / "semantic" / run_id


def build_index(session: ProcurementSession, embedder: semantic.Embedder, dim: int, model_id: str, revision: str = "1", force: bool = False, budget: int = semantic.TEXT_BUDGET) -> IndexInfo:
    """Write documents with their vectors; an index that is there is replaced only by ``force``."""
    target = folder(session.root, session.run_id)
    if target.exists() and not force:
        raise IndexError_(f"{target} is there already")
    tmp, old = target.with_name(f".tmp-{target.name}"), target.with_name(f".old-{target.name}")
    for p in (tmp, old):
        remove(p)
    try:
        docs = semantic.row_numbers(semantic.embed(semantic.documents(session.tables, budget), embedder, dim))
        docs.write.parquet(str(tmp / "documents.parquet"))
        n = check_index(docs.sparkSession.read.parquet(str(tmp / "documents.parquet")), dim)
        info = IndexInfo(session.run_id, model_id, revision, dim, "cosine", semantic.QUERY_PREFIX, n)
        (tmp / "metadata.json").write_text(json.dumps(asdict(info), indent=2, sort_keys=True))
        if target.exists():
            target.rename(old)
        try:
            tmp.rename(target)
        except BaseException:
            if old.exists():
                old.rename(target)
            raise
    finally:
        remove(tmp)
    remove(old)
    return info


def check_index(index: DataFrame, dim: int) -> int:
    """The number of documents of a sound index, else an error naming each fault."""
    row = semantic.index_faults(index, dim).first().asDict()
    n = row.pop("n_documents")
    faults = [f"{k}={v}" for k, v in row.items() if v]
    if wrong := semantic.misnumbered(index).count():
        faults.append(f"n_misnumbered={wrong}")
    if not n:
        faults.append("it has no document")
    if faults:
        raise IndexError_("; ".join(faults))
    return n


class SemanticIndex:
    """An index opened with the model that it was made with."""

    def __init__(self, docs: DataFrame, info: IndexInfo, embedder: semantic.Embedder) -> None:
        self.docs, self.info, self.embedder = docs, info, embedder

    @classmethod
    def open(cls, session: ProcurementSession, embedder: semantic.Embedder, dim: int, model_id: str, revision: str = "1") -> SemanticIndex:
        where = folder(session.root, session.run_id)
        if not (where / "metadata.json").is_file() or not (where / "documents.parquet").exists():
            raise IndexError_(f"{where} has no index")
        try:
            raw = json.loads((where / "metadata.json").read_text())
            info = IndexInfo(**raw)
        except (ValueError, TypeError) as e:
            raise IndexError_(f"the metadata of {where} can't be read") from e
        numbers_ok = all(isinstance(x, int) and not isinstance(x, bool) for x in (info.dim, info.documents))
        if (info.metric, info.query_prefix) != ("cosine", semantic.QUERY_PREFIX):
            raise IndexError_(f"the index is by {info.metric} with the prefix {info.query_prefix!r}")
        if not numbers_ok or (info.run_id, info.model_id, info.revision, info.dim) != (session.run_id, model_id, revision, dim):
            raise IndexError_(f"the index is for {info.model_id}/{info.revision}, {info.dim} wide, of {info.run_id}")
        tables = next(iter(session.tables.values())).sparkSession
        return cls(tables.read.parquet(str(where / "documents.parquet")), info, embedder)

    def counts(self, candidates: DataFrame | None = None) -> dict[str, int]:
        """How many documents are indexed, and how many of the candidates are among them (all, without any)."""
        if candidates is None:
            return {"indexed": self.info.documents, "candidates": self.info.documents}
        return {"indexed": self.info.documents, "candidates": self.docs.join(candidates.select("award_id").distinct(), "award_id", "left_semi").count()}

    def search(self, text: str, k: int = 50, min_score: float | None = None, candidates: DataFrame | None = None) -> DataFrame:
        """award_id, score, document_id and text of the best documents; the text is fetched for these alone."""
        if not text.strip():
            raise ValueError("the query is blank")
        v = self.embedder([self.info.query_prefix + text])[0]
        norm = float((v * v).sum()) ** 0.5
        if not norm > 1e-8:
            raise ValueError("the query vector is zero or not finite")
        hits = semantic.top_k(self.docs, (v / norm).tolist(), k, min_score=min_score, candidates=candidates)
        return hits.join(self.docs.select("award_id", "document_id", "text"), "award_id").orderBy(hits["score"].desc(), hits["award_id"].asc())
