"""Text sizes in tokens of a public byte-level BPE vocabulary."""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary lies; every function takes another path.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"

# Fixed value: the vocabulary's word pattern.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def encoder(path: str = VOCABULARY):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_lengths(df: DataFrame, id_cols: list[str], text: str = "text", path: str = VOCABULARY) -> DataFrame:
    """``id_cols`` and tokens of each row's whole text; null and empty texts have none."""
    rows = df.select(*id_cols, F.col(text).alias("_text"))
    kinds = dict(rows.dtypes)

    def count(batches):
        enc = encoder(path)
        for b in batches:
            n = [len(x) for x in enc.encode_ordinary_batch([t or "" for t in b.column("_text").to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in id_cols), pa.array(n, pa.int32())], names=[*id_cols, "tokens"])

    return rows.mapInArrow(count, ", ".join(f"`{c}` {kinds[c]}" for c in id_cols) + ", tokens int")
