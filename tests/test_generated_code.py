"""The registered core queries once more in a session of their own with code generation on, as in production; the other tests run without it for speed."""

from __future__ import annotations

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


@pytest.mark.skipif(not DATA.exists(), reason="needs the test tables")
def test_core_queries_with_generated_code():
    sys.path.insert(0, str(ROOT))
    import __spark_entry__ as entry

    names = [n for r in entry._registries() if "llm" not in r.queries[next(iter(r.queries))].__module__ for n in r.queries]
    out = subprocess.run([sys.executable, str(ROOT / "tools" / "compare.py"), "--sf", str(DATA), *names], capture_output=True, text=True, timeout=900, check=True).stdout
    said = [line for line in out.splitlines() if line.split(":")[0] in names]
    assert len(said) == len(names) and not [line for line in said if "DIFFERS" in line or "FAILED" in line]
