"""The registered queries of this subpackage and, where SQL can express one, their SQL."""

from __future__ import annotations

from gridloom.llm import line_dedup, mixing, sharding, sql
from gridloom.llm.classifier import op9_quality_classifier
from gridloom.llm.decontaminate import op2_benchmark_decontamination
from gridloom.llm.line_dedup import op5_line_dedup
from gridloom.llm.mixing import op3_mixing
from gridloom.llm.ngram_join import op4_ngram_jaccard_join
from gridloom.llm.pii import op10_pii
from gridloom.llm.quality_rules import op7_quality_rules
from gridloom.llm.secrets import op6_secret_scans
from gridloom.llm.sharding import op8_sharding
from gridloom.llm.token_count import op1_token_counts

QUERIES = {f.__name__: f for f in (op1_token_counts, op2_benchmark_decontamination, op3_mixing, op4_ngram_jaccard_join, op5_line_dedup, op6_secret_scans, op7_quality_rules, op8_sharding, op9_quality_classifier, op10_pii)}
SQL = {"op3_mixing": mixing.ORACLE, "op5_line_dedup": line_dedup.ORACLE, "op8_sharding": sharding.oracle(), "op6_secret_scans": sql.secret_scans(), "op7_quality_rules": sql.quality(), "op10_pii": sql.private_data()}
