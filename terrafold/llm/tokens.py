"""Token counts of texts by a public tokenizer whose file is a parameter."""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terrafold.session import spread_out

TOKENIZER = os.environ.get("TERRAFOLD_TOKENIZER", "/opt/tokenizers/byte_bpe_50k.tiktoken")
# Fixed value: the published pre-tokenisation pattern of this vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_loaded: dict[str, object] = {}


def encoder(path: str = TOKENIZER):
    """The tokenizer, loaded once a worker. Special strings in a text are ordinary text."""
    if path not in _loaded:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _loaded[path] = tiktoken.Encoding(os.path.basename(path), pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _loaded[path]


def token_counts(documents: DataFrame, keep: list[str], path: str = TOKENIZER) -> DataFrame:
    """The columns of `keep` and n_tokens, the tokens of the whole text; null and empty texts have 0."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = encoder(path)
        for b in batches:
            if not len(b):
                continue
            n = [len(enc.encode_ordinary(t)) if isinstance(t, str) and t else 0 for t in b.text]
            yield b[keep].assign(n_tokens=pd.Series(n, index=b.index, dtype="int64"))

    types = dict(documents.dtypes)
    schema = ", ".join([f"`{c}` {types[c]}" for c in keep] + ["n_tokens long"])
    return spread_out(documents.select(*dict.fromkeys([*keep, "text"]))).mapInPandas(count, schema)


def document_sizes(documents: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """doc_id, source (lower case, trimmed), n_tokens: one row a doc_id; of differing rows the longest text counts. Rows without doc_id are left out."""
    d = documents.where(F.col("doc_id").isNotNull()).select("doc_id", F.lower(F.trim("source")).alias("source"), "text")
    t = token_counts(d, ["doc_id", "source"], path)
    return t.groupBy("doc_id").agg(F.max(F.struct("n_tokens", "source")).alias("m")).select("doc_id", F.col("m.source").alias("source"), F.col("m.n_tokens").alias("n_tokens"))
