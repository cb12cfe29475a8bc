"""Schemas of the tables that operators exchange, and their closed vocabularies."""

from __future__ import annotations

MENTIONS = (
    "doc_id long, idx int, citation_type string, full_citation string, source_name string, reporter string, volume int, start_page int, pincite array<int>, court string, year int, parenthetical string, subsequent_history string, signal string, "
    "title int, code string, section string, subsection string, rule_set string, rule_number string, author string, work_title string, journal_or_publisher string, url string, source_type string, congress int, number string, "
    "span struct<start:int,end:int>, page int, footnote_id string, resolved_to struct<index:int,full_citation:string>, flags array<string>"
)
LII_REQUESTS = "id string, type string, title string, section string, subsection string"
LII_RESULTS = "id string, status string, url string, anchor string, anchor_matched boolean, section_text string, subsection_text string, retrieved_at timestamp, error string, flags array<string>"
EDGES = "src_opinion long, ord int, cluster_data_id string, href string, dst_opinion long, pincite_page int, text string, offset int, no_link boolean"
OPINIONS = "id long, type string, html_with_citations string, plain_text string, html string, xml_harvard string"
SECTION_PAGES = "url string, http_status int, html string"
TOA = "citation string, category string, pages array<int>, short_forms_found array<string>, flags array<string>"

# Closed vocabularies.
ENUMS = {
    "emitted_type": ("case", "statute", "secondary", "short_case", "id", "supra", "unknown", "other"),
    "component_type": ("case", "statute", "regulation", "rule", "secondary", "constitutional", "legislative"),
    "report_type": ("case", "statute", "regulation", "rule", "constitution", "secondary", "legislative", "other"),
    "authority_level": ("scotus", "circuit", "district", "state-high", "state-app", "agency", "secondary", "other"),
    "lii_status": ("ok", "anchor_not_found", "not_found", "network_error"),
    "sub_opinion": ("010combined", "020lead", "030concurrence", "040dissent"),
    "pagination_mode": ("reporter", "slip_only", "none"),
    "signal": ("none", "see", "see-also", "cf", "but-see", "but-cf", "accord", "contra", "compare", "string-cite-member", "see-eg", "see-generally"),
    "support": ("Strong", "Adequate", "Weak", "Misleading", "Unable"),
    "issue": ("misquote", "mischaracterization", "wrong-pincite", "denominator-error", "posture-error", "holding-inversion", "misspelling", "citation-form", "strategic-omission", "framing-inversion", "doctrinal-fit", "weight-concern"),
    "critic": ("agrees", "partial", "disagrees", "not-dispatched", "unavailable"),
    "negative_treatment": ("overruled", "abrogated", "limited"),
    "relationship": ("seed", "quoting", "paraphrasing", "holding"),
    "drift": ("broadens", "narrows", "rephrases"),
    "next_hop": ("pincite_anchor", "fanout_fallback", "terminal"),
    "document_format": ("docx", "pdf", "md", "txt"),
    "legislative_source": ("congressional_record", "committee_report", "hearing", "markup", "amendment"),
}
