"""The queries of this subpackage, by name, as ``__spark_entry__`` registers them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import OP6_SQL, op6_simhash_leaks
from .language_id import op1_cross_parsing
from .packing import op7_vector_packing, packed_conversations
from .quality_rules import op2_divergence_rules
from .secret_scan import op9_anchored_secrets
from .simhash_dedup import op5_pigeonring_simhash
from .suffix_lm import op4_unbounded_ngrams
from .token_files import op8_arrow_token_files
from .toxicity import op10_toxic_segments
from .warc import op3_segmented_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_cross_parsing,
        op2_divergence_rules,
        op3_segmented_warc,
        op4_unbounded_ngrams,
        op5_pigeonring_simhash,
        op6_simhash_leaks,
        op7_vector_packing,
        op8_arrow_token_files,
        op9_anchored_secrets,
        op10_toxic_segments,
        packed_conversations,
    )
}

#: Of the others, hashes, models, tokenizers or files are outside DuckDB's reach; tests/llm holds brute-force versions.
ORACLE_SQL: dict[str, str] = {"op6_simhash_leaks": OP6_SQL}
