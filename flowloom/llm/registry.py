"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from flowloom.llm.decontaminate import op8_decontaminate
from flowloom.llm.near_duplicates import op1_ngram_jaccard_join
from flowloom.llm.oracles import OP1_SQL, OP4_SQL, OP8_SQL, OP10_SQL
from flowloom.llm.packing import op3_best_fit_packing
from flowloom.llm.quality import op6_quality_classifier
from flowloom.llm.ranked_search import OP13_SQL, op13_ranked_search
from flowloom.llm.repeats import op10_remove_repeats
from flowloom.llm.secrets import OP5_SQL, op5_secret_scan
from flowloom.llm.simhash import op12_simhash
from flowloom.llm.token_counts import op7_token_counts
from flowloom.llm.url_filter import op4_url_filter
from flowloom.llm.vector_codes import OP11_SQL, op11_vector_codes
from flowloom.llm.vector_search import op9_one_bit_search
from flowloom.llm.warc import OP2_SQL, op2_warc_round_trip

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": op1_ngram_jaccard_join,
    "op2_warc_round_trip": op2_warc_round_trip,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_url_filter": op4_url_filter,
    "op5_secret_scan": op5_secret_scan,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_token_counts": op7_token_counts,
    "op8_decontaminate": op8_decontaminate,
    "op9_one_bit_search": op9_one_bit_search,
    "op10_remove_repeats": op10_remove_repeats,
    "op11_vector_codes": op11_vector_codes,
    "op12_simhash": op12_simhash,
    "op13_ranked_search": op13_ranked_search,
}

ORACLES: dict[str, str] = {
    "op1_ngram_jaccard_join": OP1_SQL,
    "op2_warc_round_trip": OP2_SQL,
    "op4_url_filter": OP4_SQL,
    "op5_secret_scan": OP5_SQL,
    "op8_decontaminate": OP8_SQL,
    "op10_remove_repeats": OP10_SQL,
    "op11_vector_codes": OP11_SQL,
    "op13_ranked_search": OP13_SQL,
}
