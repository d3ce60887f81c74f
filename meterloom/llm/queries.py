"""Queries of this subpackage and their SQL twins."""

from __future__ import annotations

from meterloom.llm import byte_bpe, centroid_lang, decontam, kd_shards, license_scan, line_crf, quality_rules, simhash, url_lm, wavelet


def queries():
    return {
        "op1_quality_rules": quality_rules.query,
        "op2_line_crf": line_crf.query,
        "op3_byte_bpe": byte_bpe.query,
        "op4_kd_shards": kd_shards.query,
        "op5_simhash": simhash.query,
        "op6_url_lm": url_lm.query,
        "op7_decontam": decontam.query,
        "op8_license_scan": license_scan.query,
        "op9_centroid_lang": centroid_lang.query,
        "op10_wavelet": wavelet.query,
    }


def oracle_sql():
    return {
        "op1_quality_rules": quality_rules.sql(),
        "op6_url_lm": url_lm.sql(),
        "op8_license_scan": license_scan.sql(),
    }
