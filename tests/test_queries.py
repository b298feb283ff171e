"""Registered queries against their SQL on the smallest tables.

By default a part of the queries runs; DOCAUDIT_ALL=1 runs all of them.
"""

import os

import pytest

import __spark_entry__ as entry
from compare import compare, duck
from docaudit.plans.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"
SAMPLE = [
    "evidence_audit", "evidence_audit_corpus", "claims_rule_based", "claim_dedupe_best", "segments_overlap",
    "logic_risks", "prior_art", "quality_gate", "top_risks", "sheet_paragraphs", "markdown_sections",
    "section_asof", "preflight_findings", "diff_hunks", "pr_paragraphs", "html_contents", "source_scores",
    "page_layout", "archive_screening", "latex_includes", "session_view", "latest_status", "rate_limit",
    "turn_expansion", "text_hash", "report_html", "analysis_result",
]
NAMES = list(QUERIES) if os.environ.get("DOCAUDIT_ALL") else SAMPLE


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(FOLDER):
        pytest.skip("no test tables")
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    assert compare(spark, con, FOLDER, name, entry.queries()[name], entry.oracle_sql()[name]) is None


def test_every_query_has_sql():
    assert set(QUERIES) <= set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark, con):
    df = entry.entry(spark)
    assert df.columns[:3] == ["doc_id", "claim_id", "severity"] and df.count() > 0
