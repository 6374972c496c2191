"""The driver's contract, with and without the optional subpackage."""

import subprocess
import sys
from pathlib import Path

import pytest

import __spark_entry__ as entry
from tracewell.plans import catalogue

ROOT = Path(__file__).resolve().parents[1]
SF = "/root/testdata/sf0.001"


def test_names_and_columns(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["duplicate_pairs_scored", "near_duplicate_texts", "log_chain", "receipt_summary", "monotone_watermarks", "law_check_reasons", "newest_first_context", "typed_conflicts", "contradiction_suppression", "approved_union", "text_forms", "safe_names", "run_texts", "proposal_errors", "quarantine_rows", "activation_decision", "analyze_commit", "selections", "wording_forms", "json_forms", "log_lines", "context_pack_budget", "canonical_json_hash", "message_forms", "behavior_queries", "host_queries", "free_json_forms", "normalised_output", "unique_appends", "emissions", "chained_merges"])
def test_against_duckdb(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got = catalogue.QUERIES[name](spark, SF)
    cols = sorted(got.columns)
    want = con.sql(catalogue.ORACLE_SQL[name])
    rows = lambda rel, names: sorted(repr([r[names.index(c)] for c in cols]) for r in rel)
    assert sorted(want.columns) == cols
    assert rows(got.collect(), got.columns) == rows(want.fetchall(), want.columns)


def test_imports_without_the_llm_subpackage(tmp_path):
    code = "import sys; sys.modules['tracewell.llm'] = None; import __spark_entry__ as e; assert 'topk_retrieval' in e.queries() and not any(k.startswith('op') for k in e.queries()), e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=ROOT, timeout=60)
