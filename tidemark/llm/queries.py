"""The numbered operators' queries and their SQL, by name."""

from __future__ import annotations

from . import chat, fingerprint, interaction, linededup, lm, mixing, packing, projection, quality, rules, runs, simhash, warc


def queries() -> dict:
    return {
        "op1_warc": warc.query,
        "op2_lm_score": lm.query,
        "op3_chat": chat.query,
        "op4_simhash": simhash.query,
        "op5_quality": quality.query,
        "op6_line_dedup": linededup.query,
        "op7_fingerprints": fingerprint.query,
        "op8_quality_rules": rules.query,
        "rule_ablation": rules.ablation_query,
        "op9_pack": packing.query,
        "op10_mix_sources": mixing.query,
        "op11_periodic_runs": runs.query,
        "op12_embedding_near_dups": projection.query,
        "op13_filter_audit": interaction.query,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": warc.SQL,
        "op3_chat": chat.SQL,
        "op6_line_dedup": linededup.SQL,
        "op8_quality_rules": rules.SQL,
        "rule_ablation": rules.ABLATION_SQL,
        "op10_mix_sources": mixing.SQL,
        "op11_periodic_runs": runs.SQL,
        "op13_filter_audit": interaction.SQL,
    }
