"""The queries of this subpackage and, where SQL can express them, the same in DuckDB SQL."""

from . import audit, chat, decontaminate, jaccard, langid, mixing, quantize, secrets, sharding, substrings, topk, toxicity, warc

_MODULES = {
    "op1_langid": langid,
    "op2_chat": chat,
    "op3_mixing": mixing,
    "op4_jaccard": jaccard,
    "op5_toxicity": toxicity,
    "op6_decontamination": decontaminate,
    "op7_warc": warc,
    "op8_topk": topk,
    "op9_secrets": secrets,
    "op10_substrings": substrings,
    "op11_codes": quantize,
    "op12_sharding": sharding,
    "op13_audit": audit,
}

QUERIES = {name: module.query for name, module in _MODULES.items()}
ORACLES = {name: module.SQL for name, module in _MODULES.items() if getattr(module, "SQL", None)}
