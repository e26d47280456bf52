"""The subpackage's queries and their SQL."""

from __future__ import annotations

from texspark.llm import alignment, byte_bpe, collocations, language_id, licenses, mixing, near_duplicates, packing, quality, secret_scan, top_k, toxicity, warc


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_license_scan": licenses.op2_license_scan,
        "op3_language_id": language_id.op3_language_id,
        "op4_top_k": top_k.op4_top_k,
        "op5_near_duplicates": near_duplicates.op5_near_duplicates,
        "op6_warc": warc.op6_warc,
        "op7_quality": quality.op7_quality,
        "op8_secret_scan": secret_scan.op8_secret_scan,
        "op9_mixing": mixing.op9_mixing,
        "op10_toxicity": toxicity.op10_toxicity,
        "op11_collocations": collocations.op11_collocations,
        "op12_byte_bpe": byte_bpe.op12_byte_bpe,
        "op13_alignment": alignment.op13_alignment,
    }


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": licenses.oracle(), "op4_top_k": top_k.oracle(), "op5_near_duplicates": near_duplicates.oracle(), "op6_warc": warc.oracle(), "op7_quality": quality.oracle(), "op9_mixing": mixing.oracle(), "op11_collocations": collocations.oracle()}
