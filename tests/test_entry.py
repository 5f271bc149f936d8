import subprocess
import sys
from pathlib import Path

import __spark_entry__ as E

ROOT = Path(__file__).resolve().parent.parent


def test_registry():
    q, o = E.queries(), E.oracle_sql()
    assert {"merge_calls", "consensus_call", "population_call", "differential_sites", "differential_regions", "extract_paired"} <= set(q)
    assert set(o) <= set(q)


def test_entry_runs_without_the_optional_parts(tmp_path):
    for p in ROOT.iterdir():
        if p.name not in ("corpus_pipeline.py", "cytolake", ".git"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "cytolake").mkdir()
    for p in (ROOT / "cytolake").iterdir():
        if p.name != "llm":
            (tmp_path / "cytolake" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); print(len(q), sum(n.startswith('op') for n in q), 'pipeline' in q)"
    out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, capture_output=True, text=True, check=True).stdout.split()
    assert int(out[0]) > 10 and out[1:] == ["0", "False"]
