"""Token counts of whole texts by a public tokenizer file."""

import os
from collections.abc import Iterator

import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.json"


def token_count(text: Column, tokenizer: str = TOKENIZER) -> Column:
    """Tokens of each text, special strings counted as ordinary text; null and empty texts have none.

    The file need only be on the driver: it is handed to every executor.
    """
    SparkSession.active().sparkContext.addFile(tokenizer)
    name = os.path.basename(tokenizer)

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(SparkFiles.get(name))  # once a task
        t.encode_special_tokens = True
        for texts in batches:
            yield pd.Series([len(e.ids) for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)], dtype="int64")

    # not deterministic, by name only: else a filter on the count is pushed down and texts are counted twice
    return F.pandas_udf(count, T.LongType()).asNondeterministic()(text)
