"""The registered queries of this subpackage, and the SQL for those that SQL can express."""

from __future__ import annotations

from . import bpe, fingerprint, html_text, jaccard_join, language_id, licenses, line_dedup, media, packing, secrets


def queries() -> dict:
    return {
        "op1_jaccard_join": jaccard_join.op1_jaccard_join,
        "op2_line_dedup": line_dedup.op2_line_dedup,
        "op3_packing": packing.op3_packing,
        "op4_byte_bpe": bpe.op4_byte_bpe,
        "op5_language_id": language_id.op5_language_id,
        "op6_secret_scan": secrets.op6_secret_scan,
        "op7_fingerprint": fingerprint.op7_fingerprint,
        "op8_media": media.op8_media,
        "op9_license_scan": licenses.op9_license_scan,
        "op10_html_extraction": html_text.op10_html_extraction,
    }


def oracle_sql() -> dict[str, str]:
    """Only line dedup is plain SQL over whole tables; the others are tested against brute-force versions in tests/llm."""
    return {"op2_line_dedup": line_dedup.ORACLE_SQL}
