"""Public tokenizer files: read on the driver from a path and broadcast to the workers.

Files are of a fixed size, at most ``MAX_BYTES``; nothing of them is kept in
the repository.
"""

from __future__ import annotations

import base64
import os

from pyspark.sql import SparkSession

FOLDER = "/opt/tokenizers"
BYTE_RANKS = f"{FOLDER}/byte_bpe_50k.tiktoken"
MULTI_RANKS = f"{FOLDER}/byte_bpe_multi_50k.tiktoken"
MAX_BYTES = 64 << 20
# pre-tokenizer pattern of the byte-level vocabulary; fixed value that comes with its file
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def shipped(spark: SparkSession, path: str):
    """A broadcast of the file's bytes."""
    size = os.path.getsize(path)
    if size > MAX_BYTES:
        raise ValueError(f"{path}: {size} bytes, a tokenizer file may have {MAX_BYTES}")
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(f.read())


_LOADED: dict[int, object] = {}


def byte_encoding(data: bytes):
    """The byte-level tokenizer of a file of ranks, one per worker process and file."""
    import tiktoken

    key = hash(data)
    if key not in _LOADED:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, data.splitlines())}
        _LOADED[key] = tiktoken.Encoding("bytes", pat_str=BYTE_PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[key]
