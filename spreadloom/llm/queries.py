"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from . import bpe, ctph, fim, langid, linededup, media, minhash, mixing, ngram_lm, simhash, toxicity, variants, warc


def queries() -> dict:
    return {
        "op1_minhash_near_dedup": minhash.op1,
        "op2_warc": warc.op2,
        "op3_media_columns": media.op3,
        "op4_language_id": langid.op4,
        "op5_byte_bpe": bpe.op5,
        "op6_mixing": mixing.op6,
        "op7_line_dedup": linededup.op7,
        "op8_document_fingerprints": ctph.op8,
        "op9_lm_scoring": ngram_lm.op9,
        "op10_toxicity": toxicity.op10,
        "op11_spelling_variants": variants.op11,
        "op12_fill_in_middle": fim.op12,
        "op13_simhash_near_dedup": simhash.op13,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": minhash.SQL, "op2_warc": warc.SQL, "op7_line_dedup": linededup.SQL, "op12_fill_in_middle": fim.SQL}
