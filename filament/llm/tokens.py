"""Token counts and token boundaries under a public tokenizer."""

from __future__ import annotations

import base64
import sys
import types

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F

#: The tokenizer that sizes are counted in; a path to another .tiktoken file may be given instead.
TOKENIZER = "byte_bpe_50k.tiktoken"


def encoder(name: str = TOKENIZER):
    """The tokenizer of a name in the installed collection, or of a path; kept once a worker process."""
    import public_tokenizers
    import tiktoken

    kept = sys.modules.setdefault("_filament_kept", types.ModuleType("_filament_kept")).__dict__
    if name not in kept:
        path = name if "/" in name else public_tokenizers.path(name)
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            sizes[rank] = len(token)
        kept[name] = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), sizes
    return kept[name]


def count_tokens(text: Column, name: str = TOKENIZER) -> Column:
    """Tokens of a whole text; special-token strings are ordinary text; null counts as empty."""

    @F.pandas_udf("bigint")
    def count(texts: pd.Series) -> pd.Series:
        enc, _ = encoder(name)
        return pd.Series([len(enc.encode_ordinary(t)) if t else 0 for t in texts], dtype="int64")

    return count(text)
