"""The registered queries of the text operators, and their SQL."""

from __future__ import annotations

from quarrystat.llm import (audit, chat, decontam, exact, langid, line_dedup, mixing, negatives, quality, rules, simhash, substrings,
                            toxicity)
from quarrystat.llm.common import table


def op1_simhash(spark, sf_dir):
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_decontaminate(spark, sf_dir):
    return decontam.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_mixing(spark, sf_dir):
    return mixing.mix_report(table(spark, sf_dir, "documents"))


def op4_line_dedup(spark, sf_dir):
    return line_dedup.line_digests(table(spark, sf_dir, "documents"))


def op5_chat_format(spark, sf_dir):
    return chat.chat_digests(chat.with_extra(table(spark, sf_dir, "conversations")))


def op6_language(spark, sf_dir):
    return langid.languages(table(spark, sf_dir, "documents"))


def op7_substrings(spark, sf_dir):
    return substrings.substring_digests(table(spark, sf_dir, "documents"))


def op8_rules(spark, sf_dir):
    return rules.rule_report(table(spark, sf_dir, "documents"))


def op9_quality(spark, sf_dir):
    return quality.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_toxicity(spark, sf_dir):
    return toxicity.toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_exact_dedup(spark, sf_dir):
    return exact.exact_copies(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark, sf_dir):
    return audit.filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_hard_negatives(spark, sf_dir):
    return negatives.hard_negatives(table(spark, sf_dir, "embeddings"))


LLM_QUERIES = {f.__name__: f for f in (op1_simhash, op2_decontaminate, op3_mixing, op4_line_dedup, op5_chat_format, op6_language, op7_substrings, op8_rules,
                                       op9_quality, op10_toxicity, op11_exact_dedup, op12_filter_audit, op13_hard_negatives)}
LLM_ORACLES = {"op8_rules": rules.RULES_SQL, "op3_mixing": mixing.MIXING_SQL, "op4_line_dedup": line_dedup.LINE_DEDUP_SQL,
               "op5_chat_format": chat.CHAT_SQL, "op7_substrings": substrings.SUBSTRINGS_SQL, "op11_exact_dedup": exact.EXACT_SQL, "op12_filter_audit": audit.AUDIT_SQL,
               "op13_hard_negatives": negatives.NEGATIVES_SQL}
