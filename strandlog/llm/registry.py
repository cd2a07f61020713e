"""The queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from .alignment import op11_cross_tokenizer_alignment
from .bpe import op6_byte_level_bpe
from .chat import op7_chat_formatting
from .decontaminate import OP3_SQL, op3_benchmark_decontamination
from .jaccard_join import OP8_SQL, op8_ngram_jaccard_join
from .license_scan import op2_license_scan
from .periodic import op12_periodic_runs
from .quality import op10_quality_classifier
from .quality_rules import OP13_SQL, op13_quality_rules
from .rlz_dedup import OP4_SQL, op4_substring_dedup
from .sketch import op5_document_fingerprints
from .url_filter import op9_url_filter
from .warc import OP1_SQL, op1_warc_derivatives

QUERIES = {
    f.__name__: f
    for f in (
        op1_warc_derivatives,
        op2_license_scan,
        op3_benchmark_decontamination,
        op4_substring_dedup,
        op5_document_fingerprints,
        op6_byte_level_bpe,
        op7_chat_formatting,
        op8_ngram_jaccard_join,
        op9_url_filter,
        op10_quality_classifier,
        op11_cross_tokenizer_alignment,
        op12_periodic_runs,
        op13_quality_rules,
    )
}

ORACLE_SQL: dict[str, str] = {"op1_warc_derivatives": OP1_SQL, "op3_benchmark_decontamination": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op8_ngram_jaccard_join": OP8_SQL, "op13_quality_rules": OP13_SQL}
