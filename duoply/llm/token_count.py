"""Token counts by a compiled finite-state tokenizer (see bpe.py)."""

from __future__ import annotations

import pyarrow.compute as pc
from pyspark.sql import DataFrame

from duoply.llm.bpe import compiled
from duoply.llm.common import by_batch


def count_tokens(docs: DataFrame, path: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(key, n_bytes, n_tokens, over_limit) of every whole text.

    The tokenizer file is compiled in each Python worker; no row moves between
    tasks. A null text counts as the empty one (0 bytes, 0 tokens); repeated
    rows stay; other columns are not read. A text of any length is read in
    slices between pre-tokens, so beside the text itself a worker holds a
    bounded amount; only a single word longer than a slice is walked as a whole,
    byte by byte.
    """

    def run(batch):
        n = compiled(path).counts(batch.column(1).to_pylist())
        return {key: batch.column(0), "n_bytes": pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False), "n_tokens": n, "over_limit": n > limit}

    kind = dict(docs.dtypes)[key]
    return by_batch(docs.select(key, text), run, f"{key} {kind}, n_bytes long, n_tokens long, over_limit boolean")
