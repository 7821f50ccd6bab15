"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from geoloom.llm import lexical, licenses, minhash, mixing, negatives, neighbours, packing, pieces, quality, sharding, suffixes, urls, warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_warc": warc.op1_warc,
    "op2_sentencepiece": pieces.op2_sentencepiece,
    "op3_minhash_dedup": minhash.op3_minhash_dedup,
    "op4_sharding": sharding.op4_sharding,
    "op5_url_filters": urls.op5_url_filters,
    "op6_license_scan": licenses.op6_license_scan,
    "op7_packing": packing.op7_packing,
    "op8_neighbours": neighbours.op8_neighbours,
    "op9_suffix_dedup": suffixes.op9_suffix_dedup,
    "op10_quality_rules": quality.op10_quality_rules,
    "op11_hard_negatives": negatives.op11_hard_negatives,
    "op12_lexical_search": lexical.op12_lexical_search,
    "op13_mixing": mixing.op13_mixing,
}

#: Where SQL cannot express the result (ids of a tokenizer, packing, minimax sharding, a graph's own answers), tests hold
#: the query against brute force.
ORACLES: dict[str, str] = {
    "op1_warc": warc.oracle(),
    "op3_minhash_dedup": minhash.oracle(),
    "op5_url_filters": urls.oracle(),
    "op6_license_scan": licenses.oracle(),
    "op9_suffix_dedup": suffixes.oracle(),
    "op10_quality_rules": quality.oracle(),
    "op11_hard_negatives": negatives.oracle(),
    "op12_lexical_search": lexical.oracle(),
    "op13_mixing": mixing.oracle(),
}
