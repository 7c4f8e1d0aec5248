"""The queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

from .decontaminate import LEAKS_SQL, op3_decontaminate
from .embedding_dedup import NEAR_DUPLICATES_SQL, op2_embedding_dedup
from .jaccard import op4_jaccard_join
from .mixing import mix_sql, op5_mix
from .sharding import op7_kdtree
from .suffix_tree import op10_suffix_tree
from .token_files import op8_token_files
from .tokens import op9_counts
from .toxicity import op6_toxicity
from .warc import ROUND_TRIP_SQL, op1_warc

QUERIES = {
    "op1_warc": op1_warc, "op2_embedding_dedup": op2_embedding_dedup, "op3_decontaminate": op3_decontaminate,
    "op4_jaccard_join": op4_jaccard_join, "op5_mix": op5_mix, "op6_toxicity": op6_toxicity, "op7_kdtree": op7_kdtree,
    "op8_token_files": op8_token_files, "op9_counts": op9_counts, "op10_suffix_tree": op10_suffix_tree
}

ORACLE_SQL = {"op1_warc": ROUND_TRIP_SQL, "op2_embedding_dedup": NEAR_DUPLICATES_SQL, "op3_decontaminate": LEAKS_SQL, "op5_mix": mix_sql()}
