"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from importlib import import_module

#: (query, module, function, name of its SQL or None).
_LISTED = (
    ("op1_lm_scoring", "lm_scoring", None),
    ("op2_mixing", "mixing", "OP2_SQL"),
    ("op3_near_dedup", "near_dedup", "OP3_SQL"),
    ("op4_url_filter", "url_filter", "OP4_SQL"),
    ("op5_toxicity", "toxicity", None),
    ("op6_pii", "pii", None),
    ("op7_decontamination", "decontamination", "OP7_SQL"),
    ("op8_topk_search", "topk_search", "OP8_SQL"),
    ("op9_line_dedup", "line_dedup", "OP9_SQL"),
    ("op10_license_scan", "license_scan", None),
    ("op11_token_counts", "token_counts", None),
    ("op12_fill_in_middle", "fill_in_middle", "OP12_SQL"),
    ("op13_merkle_manifest", "merkle", "OP13_SQL"),
)

QUERIES, ORACLE_SQL = {}, {}
for _name, _module, _sql in _LISTED:
    _m = import_module(f".{_module}", __package__)
    QUERIES[_name] = getattr(_m, _name)
    if _sql:
        ORACLE_SQL[_name] = getattr(_m, _sql)
