"""Queries over the driver's tables, one per operator, and their SQL where SQL can express them."""

from __future__ import annotations

from . import bpe, chat, decontaminate, exact_dedup, html_text, licenses, pii, simhash, substrings, toxicity

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_simhash": simhash.op2_simhash,
    "op3_preferences": chat.op3_preferences,
    "op4_exact_dedup": exact_dedup.op4_exact_dedup,
    "op5_licenses": licenses.op5_licenses,
    "op6_substrings": substrings.op6_substrings,
    "op7_html": html_text.op7_html,
    "op8_pii": pii.op8_pii,
    "pii_base": pii.pii_base,
    "op9_bpe": bpe.op9_bpe,
    "op10_decontaminate": decontaminate.op10_decontaminate,
}
ORACLE_SQL = {
    "op3_preferences": chat.OP3_SQL,
    "op4_exact_dedup": exact_dedup.OP4_SQL,
    "op5_licenses": licenses.OP5_SQL,
    "op6_substrings": substrings.OP6_SQL,
    "pii_base": pii.PII_BASE_SQL,
    "op10_decontaminate": decontaminate.OP10_SQL,
}
