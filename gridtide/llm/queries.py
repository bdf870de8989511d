"""The registered queries of this folder and their SQL."""

from __future__ import annotations

import corpus_pipeline

from gridtide.llm.decontaminate import OP7_SQL, op7_decontaminate
from gridtide.llm.extract import op9_text_regions
from gridtide.llm.packing import OP6_SQL, op6_length_buckets
from gridtide.llm.parsing import OP3_SQL, op3_prefix_free_parsing
from gridtide.llm.permutation import op10_permutation_index
from gridtide.llm.prefix_join import OP11_SQL, op11_prefix_join
from gridtide.llm.quality import op1_quality_fourier
from gridtide.llm.quotations import OP4_SQL, op4_quotation_links
from gridtide.llm.repair import op12_four_russians
from gridtide.llm.simhash import op2_simhash_golay
from gridtide.llm.token_rows import op8_token_rows
from gridtide.llm.vector_codes import OP13_SQL, op13_vector_codes
from gridtide.llm.warc import OP5_SQL, op5_warc_chain

QUERIES = {
    "op1_quality_fourier": op1_quality_fourier,
    "op2_simhash_golay": op2_simhash_golay,
    "op3_prefix_free_parsing": op3_prefix_free_parsing,
    "op4_quotation_links": op4_quotation_links,
    "op5_warc_chain": op5_warc_chain,
    "op6_length_buckets": op6_length_buckets,
    "op7_decontaminate": op7_decontaminate,
    "op8_token_rows": op8_token_rows,
    "op9_text_regions": op9_text_regions,
    "op10_permutation_index": op10_permutation_index,
    "op11_prefix_join": op11_prefix_join,
    "op12_four_russians": op12_four_russians,
    "op13_vector_codes": op13_vector_codes,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op3_prefix_free_parsing": OP3_SQL,
    "op4_quotation_links": OP4_SQL,
    "op5_warc_chain": OP5_SQL,
    "op6_length_buckets": OP6_SQL,
    "op7_decontaminate": OP7_SQL,
    "op11_prefix_join": OP11_SQL,
    "op13_vector_codes": OP13_SQL,
}
