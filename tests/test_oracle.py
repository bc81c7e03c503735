"""Spark query against its DuckDB oracle on the smallest scale (the gate runs all at sf0.01)."""

import pytest

from tagspace.catalog import ORACLE, QUERIES
from tagspace.plans.compare import compare, duck_connect

SF = "/root/testdata/sf0.001"
NAMES = ["extract_tags", "mask_random", "common_tags", "tag_cooccurrence", "category_distance",
         "tag_distance_matrix", "salience_matrix_rile", "mantel_spearman",
         "twin_distance_matrix", "negative_pairs", "pair_split", "pair_similarity_eval",
         "word_average", "experiment"]


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, name):
    res = compare(spark, SF, QUERIES[name], ORACLE[name], duck_connect(SF))
    assert res["ok"], res
