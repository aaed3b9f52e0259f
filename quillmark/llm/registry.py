"""Queries of the training-data operators, and their SQL where DuckDB can express them."""

from __future__ import annotations

from . import additive_search, bpe, embeddings, packing, pii, quality, ranked_search, runs, secrets, simhash, token_files, url_filter, warc


def queries() -> dict:
    return {
        "op1_collision_counting": embeddings.op1_collision_counting,
        "op2_token_files": token_files.op2_token_files,
        "op3_pii": pii.op3_pii,
        "op4_quality_hosts": quality.op4_quality_hosts,
        "op5_bpe_queries": bpe.op5_bpe_queries,
        "op6_secrets": secrets.op6_secrets,
        "op7_warc_revisits": warc.op7_warc_revisits,
        "op8_url_trie": url_filter.op8_url_trie,
        "op9_simhash_trie": simhash.op9_simhash_trie,
        "op10_vector_packing": packing.op10_vector_packing,
        "op11_periodic_runs": runs.op11_periodic_runs,
        "op12_ranked_search": ranked_search.op12_ranked_search,
        "op13_additive_search": additive_search.op13_additive_search,
    }


def oracle_sql() -> dict:
    return {
        "op1_collision_counting": embeddings.OP1_SQL, "op4_quality_hosts": quality.OP4_SQL, "op7_warc_revisits": warc.OP7_SQL, "op8_url_trie": url_filter.OP8_SQL,
        "op12_ranked_search": ranked_search.OP12_SQL,
    }
