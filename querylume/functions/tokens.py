"""Token counters: white space, or a tokenizer's file."""

from __future__ import annotations

import functools
import os
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from querylume.functions.text import word_count


@functools.lru_cache(maxsize=2)  # a worker keeps it from task to task
def _counter(path: str) -> Callable[[list[str]], list[int]]:
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the threads here
    if path.endswith(".tiktoken"):
        import base64

        import tiktoken

        import public_tokenizers

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(path, "rb"))}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(own.encode_ordinary(t)) for t in texts]
    from tokenizers import Tokenizer

    tk = Tokenizer.from_file(path)
    return lambda texts: [len(e.ids) for e in tk.encode_batch_fast(texts, add_special_tokens=False)]


def file_counter(path: str) -> Callable[[Column], Column]:
    """Counts the tokens of a tokenizers or tiktoken file, whose path all workers can read; 0 for null."""

    @F.pandas_udf("int")
    def count(texts: pd.Series) -> pd.Series:
        return pd.Series(_counter(path)(texts.fillna("").tolist()), dtype="int32")

    return count


def best_counter(*paths: str | None) -> Callable[[Column], Column]:
    """The counter of the first file that exists and whose library is at hand, else of words."""
    for path in paths:
        if path and os.path.exists(path):
            try:
                _counter(path)
            except ImportError:
                continue
            return file_counter(path)
    return word_count
