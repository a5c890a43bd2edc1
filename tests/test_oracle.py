"""Registered queries against their SQL on the smallest tables."""

import os

import pytest

SF = "/root/testdata/sf0.001"
TABLES = "documents benchmark labels conversations pages embeddings events".split()
SOME = [
    "T01_strip_markdown", "T02_clean_academic", "T03_split_references", "T06_clean_wikitext", "T08_title_key", "T12_fnv1a32", "K03_split_sentences", "K04_after_marks", "K06_retrieval_tokens",
    "K07_ngram_diversity", "K09_chunks", "K17_terms", "K19_entities", "L02_detect_language", "S26_scaffold_dispersion", "F06_F10_final_score", "S29_reasons", "F11_sentence_explanations",
    "F13_F14_fusion", "F15_answers", "F16_label_pooling", "E01_structure_bullets", "IO16_report", "V01_V11_validate", "V14_support", "M01_M09_summary_scores", "M08_M12_summary", "H01_H03_rules",
    "H04_long_sentences", "H06_sentences_taken_back", "H07_short_sentences_join", "H08_uniform_rhythm", "R01_R04_topic_profile", "R05_context", "R06_queries", "R07_digest", "R09_R12_candidate_scores",
    "R13_R15_shown", "R16_R18_list_counters", "R19_fan_out", "C09_near_pairs", "C09_greedy_dedupe", "C10_two_sided_dedupe", "C12_stratified_split", "C13_sequential_ids", "C14_digest",
    "C17_even_stride", "C18_mixture_plan", "C19_mixture", "X03_auc", "X04_X06_baseline_quantiles", "X05_slices", "X10_X11_rank_quality", "X12_rerank", "X13_threshold_sweep", "A01_A02_agreement",
    "A03_agreement_rate", "A06_review_queue", "A07_candidate_faults", "P01_request_contract", "P02_P07_failures", "P03_score_payload", "P03_material_payload", "P04_fallback", "P05_selected_text",
    "P06_stale_results", "P09_prompts", "IO01_IO04_files", "IO06_tolerant_lines", "IO10_provider_rows", "IO13_first_word_a_slot", "IO15_atom_entries", "IO17_summary_payload", "ST_event_windows",
    "ST_distinct_texts", "SQL_K03_sentences", "SQL_L02_language", "IO11_gated_works", "IO12_as_of_revision", "IO12_sampled_titles", "IO12_sample_counters", "R08_nearest", "R09_R12_passing",
    "ST_event_sessions", "P06_newest_state",
]


def norm(v):
    if v is None or v != v:
        return "null"
    if isinstance(v, float):
        return f"{v:.6g}"
    if isinstance(v, list):
        return str([norm(x) for x in v])
    if hasattr(v, "asDict"):
        return str({k: norm(x) for k, x in v.asDict().items()})
    return str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
@pytest.mark.parametrize("name", SOME)
def test_query_matches_sql(spark, duck, name):
    from glyphmill.plans import registry

    df = registry.QUERIES[name](spark, SF)
    found = duck.execute(registry.ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(tuple(norm(r[names.index(c)]) for c in df.columns) for r in found.fetchall())
    got = sorted(tuple(norm(r[c]) for c in df.columns) for r in df.collect())
    assert got == want
