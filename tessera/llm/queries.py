"""The queries of this subpackage, by name, and their SQL where there is some."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import byte_bpe, decontaminate, language_id, licenses, maxscore, minhash, packing, resampling, secrets, suffix_dedup, token_counts, toxicity, vector_codes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_bpe": byte_bpe.op1_byte_bpe,
    "op2_secrets": secrets.op2_secrets,
    "op3_decontaminate": decontaminate.op3_decontaminate,
    "op4_language_id": language_id.op4_language_id,
    "op5_suffix_dedup": suffix_dedup.op5_suffix_dedup,
    "op6_licenses": licenses.op6_licenses,
    "op7_maxscore": maxscore.op7_maxscore,
    "op8_minhash": minhash.op8_minhash,
    "op9_token_counts": token_counts.op9_token_counts,
    "op10_toxicity": toxicity.op10_toxicity,
    "op11_packing": packing.op11_packing,
    "op12_resampling": resampling.op12_resampling,
    "op13_vector_codes": vector_codes.op13_vector_codes,
}

ORACLE_SQL: dict[str, str] = {"op6_licenses": licenses.sql(), "op7_maxscore": maxscore.OP7_SQL, "op12_resampling": resampling.OP12_SQL, "op13_vector_codes": vector_codes.OP13_SQL}
