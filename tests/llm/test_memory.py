"""Python workers hand free memory back before another stage takes them."""

from urllib.parse import unquote, urlparse

import numpy as np
import psutil
import pyarrow.parquet as pq

from logweave.llm import decontaminate, text


def test_free_pages_of_the_heap_are_returned():
    held = [np.ones(8_000) for _ in range(3_000)]  # 64 KB each, on the heap
    last = held.pop()
    del held
    before = psutil.Process().memory_info().rss
    text.give_back()
    assert before - psutil.Process().memory_info().rss > 100 << 20
    assert last.sum() == 8_000


def test_postings_are_written_in_small_row_groups(spark):
    """A row of the index is as large as a batch of texts; pages and groups do not wait for 100 of them."""
    long = "array_join(transform(sequence(1, 60000), i -> concat(cast(i * 7 + doc_id as string), 'x')), ' ')"
    docs = spark.range(40).selectExpr("id as doc_id").selectExpr("doc_id", f"{long} as text").coalesce(1)
    groups = []
    for path in decontaminate.build_index(docs).inputFiles():
        meta = pq.ParquetFile(unquote(urlparse(path).path)).metadata
        groups += [meta.row_group(k) for k in range(meta.num_row_groups)]
    assert sum(g.num_rows for g in groups) == 40
    assert sum(g.total_byte_size for g in groups) > 32 << 20
    assert max(g.total_byte_size for g in groups) < 24 << 20
