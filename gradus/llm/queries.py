"""The queries of this subpackage, and their SQL where it can express them."""

from __future__ import annotations

from .decontamination import op12_decontamination, op12_sql
from .embeddings import op2_embeddings, op2_sql
from .lexical_search import op11_search, op11_sql
from .license_scan import op1_license_scan, op1_sql
from .minhash import op8_minhash
from .mixing import op10_mixing, op10_sql
from .packing import op5_packing
from .pii import op3_pii
from .quality import op6_quality
from .resampling import op13_resampling, op13_sql
from .substrings import op9_sql, op9_substrings
from .toxicity import op4_toxicity
from .url_rules import op7_sql, op7_url_rules

QUERIES = {f.__name__: f for f in (op1_license_scan, op2_embeddings, op3_pii, op4_toxicity, op5_packing, op6_quality, op7_url_rules, op8_minhash, op9_substrings, op10_mixing, op11_search, op12_decontamination, op13_resampling)}
ORACLE_SQL = {"op1_license_scan": op1_sql(), "op2_embeddings": op2_sql(), "op7_url_rules": op7_sql(), "op9_substrings": op9_sql(), "op10_mixing": op10_sql(), "op11_search": op11_sql(), "op12_decontamination": op12_sql(), "op13_resampling": op13_sql()}
