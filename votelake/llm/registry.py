"""Queries and SQL of the training-data operators, by name."""

from __future__ import annotations

import corpus_pipeline

from . import alignment, decontamination, licenses, lines, mixing, pii, quality, sharding, simhash, substrings, token_files, urls, variants


def queries() -> dict:
    return {
        "op1_licenses": licenses.op1_licenses,
        "op2_decontamination": decontamination.op2_decontamination,
        "op3_quality": quality.op3_quality,
        "op4_substrings": substrings.op4_substrings,
        "op5_urls": urls.op5_urls,
        "op6_sharding": sharding.op6_sharding,
        "op7_mixing": mixing.op7_mixing,
        "op8_pii": pii.op8_pii,
        "op9_simhash": simhash.op9_simhash,
        "op10_line_dedup": lines.op10_line_dedup,
        "op11_alignment": alignment.op11_alignment,
        "op12_token_files": token_files.op12_token_files,
        "op13_variants": variants.op13_variants,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict[str, str]:
    return {"op5_urls": urls.SQL, "op10_line_dedup": lines.SQL}
