"""The queries of this subpackage and their SQL, where SQL can express them."""

from __future__ import annotations

from . import chat, decontamination, lm, neardup, packing, quality, repeats, resampling, secrets, tokencounts, topk, toxicity, warc


def queries() -> dict:
    return {
        "op1_packing": packing.op1_packing,
        "op2_toxicity": toxicity.op2_toxicity,
        "op3_decontamination": decontamination.op3_decontamination,
        "op4_minhash_neardup": neardup.op4_minhash_neardup,
        "op5_secret_scan": secrets.op5_secret_scan,
        "op6_token_counts": tokencounts.op6_token_counts,
        "op7_warc_fixity": warc.op7_warc_fixity,
        "op8_quality": quality.op8_quality,
        "op9_chat_format": chat.op9_chat_format,
        "op10_topk": topk.op10_topk,
        "op11_lm_scoring": lm.op11_lm_scoring,
        "op12_periodic_runs": repeats.op12_periodic_runs,
        "op13_resampling": resampling.op13_resampling,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op7_warc_fixity": warc.OP7_SQL,
        "op9_chat_format": chat.OP9_SQL,
        "op10_topk": topk.OP10_SQL,
    }
