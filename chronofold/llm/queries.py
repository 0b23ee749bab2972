"""The registered query of each operator, and its SQL where SQL can express it."""

from __future__ import annotations

from .decontaminate import OP2_SQL, op2_decontaminate
from .line_dedup import OP4_SQL, op4_line_dedup
from .mixing import OP10_SQL, op10_mix_sources
from .near_dup import OP6_SQL, op6_near_duplicates
from .quality import OP9_SQL, op9_quality_cascade
from .secrets import OP7_SQL, op7_secret_scan
from .sharding import op1_hilbert_shards
from .substring_dedup import op8_sentence_spans
from .tokens import op3_token_output
from .toxicity import op5_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_hilbert_shards, op2_decontaminate, op3_token_output, op4_line_dedup, op5_toxicity,
        op6_near_duplicates, op7_secret_scan, op8_sentence_spans, op9_quality_cascade, op10_mix_sources,
    )
}

ORACLE_SQL = {
    "op2_decontaminate": OP2_SQL, "op4_line_dedup": OP4_SQL, "op6_near_duplicates": OP6_SQL, "op7_secret_scan": OP7_SQL,
    "op9_quality_cascade": OP9_SQL, "op10_mix_sources": OP10_SQL,
}
