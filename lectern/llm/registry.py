"""Queries of this subpackage and their DuckDB forms, where SQL can express them."""

from __future__ import annotations

from lectern.llm import bpe, covertree, langid, minhash, mixing, quality, quotes, suffixes, urls, warc


def queries() -> dict:
    return {
        "op1_cover_tree": covertree.op1_cover_tree,
        "op2_language_id": langid.op2_language_id,
        "op3_warc_packages": warc.op3_warc_packages,
        "op4_suffix_dedup": suffixes.op4_suffix_dedup,
        "op5_mixing": mixing.op5_mixing,
        "op6_quality_rules": quality.op6_quality_rules,
        "op7_quotation_linking": quotes.op7_quotation_linking,
        "op8_minhash_tensored": minhash.op8_minhash_tensored,
        "op9_bpe_tree": bpe.op9_bpe_tree,
        "op10_url_filter": urls.op10_url_filter,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_quotation_linking": quotes.ORACLE_SQL}
