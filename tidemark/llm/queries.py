"""The queries of this subpackage, one for each operator, and their SQL where SQL can express them."""

from tidemark.llm.decontamination import op9_pigeonhole_edit
from tidemark.llm.line_dedup import SQL as LINE_SQL
from tidemark.llm.line_dedup import op2_line_chunks
from tidemark.llm.mixing import op10_temperature_mixing
from tidemark.llm.near_duplicates import op3_signature_trees
from tidemark.llm.private_data import op5_bootstrap
from tidemark.llm.quality import op6_line_field
from tidemark.llm.repair import op1_repair
from tidemark.llm.repeats import op4_index_family
from tidemark.llm.sharding import op8_histogram_sort
from tidemark.llm.token_counts import op7_digest_cache

QUERIES = {
    "op1_repair": op1_repair,
    "op2_line_chunks": op2_line_chunks,
    "op3_signature_trees": op3_signature_trees,
    "op4_index_family": op4_index_family,
    "op5_bootstrap": op5_bootstrap,
    "op6_line_field": op6_line_field,
    "op7_digest_cache": op7_digest_cache,
    "op8_histogram_sort": op8_histogram_sort,
    "op9_pigeonhole_edit": op9_pigeonhole_edit,
    "op10_temperature_mixing": op10_temperature_mixing,
}

ORACLES: dict[str, str] = {"op2_line_chunks": LINE_SQL}
