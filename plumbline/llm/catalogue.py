"""Query registry of the training-data operators."""

from __future__ import annotations

from plumbline.llm import bpe, media, mixture, quality, secrets, simhash, sstable, suffixes, toxicity, warc


def queries() -> dict:
    return {
        "op1_suffix_dedup": suffixes.op1_suffix_dedup,
        "op2_simhash": simhash.op2_simhash,
        "op3_mixture": mixture.op3_mixture,
        "op4_bpe_round_trip": bpe.op4_bpe_round_trip,
        "op5_toxicity": toxicity.op5_toxicity,
        "op6_token_sstable": sstable.op6_token_sstable,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_media_chunks": media.op8_media_chunks,
        "op9_quality_rules": quality.op9_quality_rules,
        "op10_warc": warc.op10_warc,
    }


def oracle_sql() -> dict[str, str]:
    """None of these operators has an equivalent in portable SQL; their tests use brute force."""
    return {}
