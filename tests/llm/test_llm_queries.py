"""The registered queries: rows, columns, SQL."""

import pytest
from callsight.llm import queries
from callsight.llm.common import table
from checks import compare

COLUMNS = {
    "op1_decontamination": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op2_url_filter": "page_id host path rule verdict canonical listed",
    "op3_toxicity": "doc_id p_low_quality p_toxic low_quality toxic",
    "op4_shingle_join": "doc_id n_shingles component_id",
    "op5_warc": "page_id payload_bytes payload_digest record_type refers_to",
    "op6_token_counts": "doc_id n_tokens token_score",
    "op7_packing": "doc_id piece start length ids_crc32 sequence_id offset",
    "op8_language_model": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op9_quality_rules": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed class_distance word_distance kept",
    "op10_html_text": "page_id url text n_chars",
    "op11_periodic_runs": "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256",
    "op12_whitening": "vec_id component n deviation whitened explained identity_error",
    "op13_sharding": "doc_id size text_crc32 law shard slot grown_shard",
}


@pytest.mark.parametrize("name", COLUMNS)
def test_query_returns_its_whole_table(spark, sf, name):
    got = queries.QUERIES[name](spark, sf)
    assert sorted(got.columns) == sorted(COLUMNS[name].split())
    ids = [r[0] for r in got.select(COLUMNS[name].split()[0]).collect()]
    source = table(spark, sf, {"doc_id": "documents", "page_id": "pages", "vec_id": "embeddings"}[COLUMNS[name].split()[0]])
    want = [r[0] for r in source.select(COLUMNS[name].split()[0]).collect()]
    assert set(ids) == set(want) and len(ids) >= len(want)
    assert len(ids) == len(want) or name in ("op7_packing", "op12_whitening")


@pytest.mark.parametrize("name", queries.SQL)
def test_query_equals_its_sql(spark, sf, name):
    con = compare.connect(sf)
    got, _, _, verdict = compare.compare(spark, con, sf, name, queries.QUERIES[name], queries.SQL[name])
    assert verdict == "same" and got


def test_all_are_registered():
    import corpus_pipeline
    import __spark_entry__ as entry

    assert {*COLUMNS, "pipeline"} <= set(entry.queries())
    assert set(corpus_pipeline.QUERIES) == {"pipeline"} and set(queries.QUERIES) == set(COLUMNS)
