"""Lists of one shingle: rows grow with the entries, not with the pairs, and no link is lost."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from brute import near_components
from weftgraph.llm.ngram_join import Bounds, _pairs, link_documents


@pytest.mark.parametrize("size", [2, 3, 4, 8, 24, 32, 33, 100])
def test_a_list_makes_no_more_rows_than_it_has_entries(size):
    lists = 50
    token, cls = np.repeat(np.arange(lists), size), np.tile(np.arange(size), lists) + 1000 * np.repeat(np.arange(lists), size)
    meta = np.full(lists * size, (100 << 32) + 1)
    batch = pa.RecordBatch.from_arrays([pa.array(v.astype(np.int64)) for v in (token, cls, meta)], ["token", "cls", "meta"])
    made = [out for out in _pairs(Bounds(75))(iter([batch.slice(0, 70), batch.slice(70)]))]
    assert sum(out.num_rows for out in made) <= lists * size
    # every entry of a list takes part, in a pair or as itself
    held = {c for out in made for k in "xy" for c in out.column(k).to_pylist()} - {None}
    assert held == set(cls.tolist())


def test_groups_of_middling_size_keep_all_links(spark):
    """Texts that drift away from their group's first, so that the ends of a group link only through others."""
    rng, texts = random.Random(9), []
    for size in (3, 4, 5, 9, 20, 33):
        words = [f"w{rng.randrange(10**6)}" for _ in range(60)]
        for _ in range(size):
            texts.append(" ".join(words))
            words[rng.randrange(60)] = f"w{rng.randrange(10**6)}"
    docs = list(enumerate(rng.sample(texts, len(texts))))
    found = link_documents(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == near_components(docs)
