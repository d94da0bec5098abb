"""Ids that don't fit their width are refused."""

import pytest

from parchment.llm import op05_token_counts
from parchment.llm.op04_packing import tokenizer_path


def test_ids_that_do_not_fit(spark):
    docs = spark.createDataFrame([(1, "several words here")], "doc_id long, text string")
    with pytest.raises(Exception, match="doesn't fit 1 bytes"):
        op05_token_counts.token_files(docs, tokenizer_path(), 0, 1)
    wide = op05_token_counts.counted(docs, end=70_000).collect()
    assert [tuple(r) for r in wide] == [tuple(r) for r in op05_token_counts.counted(docs).collect()]
