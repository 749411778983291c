"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: A byte-level BPE vocabulary as ranks; read once on the driver, so the other machines need no file.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's published pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Distinct chunks remembered per task before the memory is emptied.
MEMORY = 200_000


class TokenCounter:
    """Counts tokens; chunks met before are looked up.

    The pre-tokenizer always starts a new piece at a single space between two signs that aren't white space, so the counts
    of the chunks between such spaces add up exactly. Texts with other white space next to a space are encoded whole.
    """

    def __init__(self, ranks: bytes):
        import tiktoken

        table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
        self.encode = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=table, special_tokens={}).encode_ordinary
        self.known: dict[str, int] = {}

    def count(self, text: str) -> int:
        chunks = text.split(" ")
        if any(not c or c[0].isspace() or c[-1].isspace() for c in chunks):
            return len(self.encode(text))
        known, total = self.known, len(self.encode(chunks[0]))
        for c in chunks[1:]:
            n = known.get(c)
            if n is None:
                if len(known) >= MEMORY:
                    known.clear()
                n = known[c] = len(self.encode(" " + c))
            total += n
        return total


def with_token_counts(df: DataFrame, text: str, keep: list[str], vocabulary: str = VOCABULARY) -> DataFrame:
    """(keep..., n_tokens) of each row of ``df``; null texts have 0 tokens, as have empty ones."""
    with open(vocabulary, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    schema = df.select(*keep).schema.add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = TokenCounter(ranks.value)
        for b in batches:
            n = [counter.count(t) if t else 0 for t in b.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(k) for k in keep] + [pa.array(n, pa.int64())], [*keep, "n_tokens"])

    columns = [*keep, *([text] if text not in keep else [])]
    return df.select(*columns).mapInArrow(count, schema)
