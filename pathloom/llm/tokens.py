"""Token counts by a public tokenizer whose file lies outside the repository."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_KEPT: dict[tuple[str, str], object] = {}


def _encoder(ranks: str, pattern: str):
    """The encoder, kept for the life of the Python worker."""
    if (ranks, pattern) not in _KEPT:
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _KEPT[ranks, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
    return _KEPT[ranks, pattern]


def count_tokens(encoder, text: str) -> int:
    """The tokens of a whole text.

    The pattern's look-ahead after white space needs stack for each character, so long runs of white space are
    taken out first, exactly as the pattern does it: a run is one piece, without its last character if
    something follows, which then begins the rest. No other piece holds white space but at its start.
    """
    import regex

    text = text.encode("utf-8", "replace").decode("utf-8")  # lone surrogates count as question marks
    total = at = 0
    for run in regex.finditer(r"\p{White_Space}{1000,}", text):
        cut = run.end() - (run.end() < len(text))
        total += len(encoder.encode_ordinary(text[at : run.start()])) + len(encoder._encode_single_piece(text[run.start() : cut]))
        at = cut
    return total + len(encoder.encode_ordinary(text[at:]))


def with_tokens(docs: DataFrame, text: str, name: str = "tokens", ranks: str = DEFAULT_RANKS, pattern: str = PATTERN) -> DataFrame:
    """Adds the number of tokens of each whole text, however long; null and empty texts have 0."""

    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        from pathloom.llm import tokens  # the module's own cache, which lives as long as the Python worker

        encoder = tokens._encoder(ranks, pattern)
        for texts in batches:
            yield pd.Series([tokens.count_tokens(encoder, t) if t else 0 for t in texts], dtype="int64")

    return docs.withColumn(name, F.pandas_udf(count, "bigint")(F.col(text)))
