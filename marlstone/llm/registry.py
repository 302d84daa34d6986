"""The queries of this subpackage and, where SQL can express one, its DuckDB oracle."""

from __future__ import annotations

from marlstone.llm import decontamination, htmltext, langid, licences, lloyd, packing, ranking, secrets, sharding, simhash, substrings, tokencounts, topk

QUERIES = {
    "op1_packing": packing.query,
    "op2_substrings": substrings.query,
    "op3_secrets": secrets.query,
    "op4_simhash": simhash.query,
    "op5_licences": licences.query,
    "op6_htmltext": htmltext.query,
    "op7_sharding": sharding.query,
    "op8_decontamination": decontamination.query,
    "op9_topk": topk.query,
    "op10_langid": langid.query,
    "op11_lexical": ranking.query,
    "op12_tokencounts": tokencounts.query,
    "op13_lloyd": lloyd.query,
}
ORACLES: dict[str, str] = {"op5_licences": licences.ORACLE, "op8_decontamination": decontamination.ORACLE, "op9_topk": topk.ORACLE, "op11_lexical": ranking.ORACLE, "op13_lloyd": lloyd.ORACLE}
