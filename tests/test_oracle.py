"""Queries against their DuckDB SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from citeloom import registry

SF = "/root/testdata/sf0.001"
#: One of each kind; the driver compares all of them at a larger size.
NAMES = [
    "toa_basic", "toa_checklist_violations", "toa_json", "resolve_groups", "cite_extract_case", "cite_signal", "cite_string_groups", "cite_extract_const", "page_split", "page_straddle", "snippet", "html_anchors", "html_links", "text_clean", "sentence_chunks", "page_span", "find_sentence", "anchor_window",
    "anchor_next_hop", "chain_walk", "chain_terminals", "chain_cycles", "chain_methodology", "chain_report", "chain_forest", "lookup_components", "identity_check", "escalation_first_ok", "lii_status", "lii_section_text", "quote_match", "benchmark_quotes", "label_counts", "triage", "report_markdown", "report_consistency",
    "report_determinism", "critic_flags", "negative_history", "match_ladder", "semantic_scorer_topk", "section_ranges", "section_of_mention", "bare_section", "parenthetical_entries", "mention_flags", "cite_other_types", "cite_journal_components", "cite_rare_families", "cite_repaired_subsection", "cite_labels", "footnote_bodies",
    "resolve_second_pass", "resolve_parallel_reporters", "toa_seven_categories", "sources_by_type", "constitution_text", "text_plausible", "pincite_passages", "passage_window", "verified_suggestions", "other_source_text", "precis_length", "indirect_labels", "task_routes", "fan_out", "hop_relationship", "chain_intake",
    "nearest_location", "json_arrays", "report_json", "report_names",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


def rows(names, found):
    order = [names.index(n) for n in sorted(names)]
    return sorted(repr([r[i] for i in order]) for r in found)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_oracle(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cursor = duck.execute(registry.oracle_sql()[name])
    want = rows([c[0] for c in cursor.description], cursor.fetchall())
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want and want


def test_registry():
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names and {"toa_basic", "chain_walk"} <= names


def test_entry(spark):
    assert entry.entry(spark).columns == ["brief_id", "category", "citation", "pages", "n_mentions", "position"]
