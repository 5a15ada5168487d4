"""Vectorised stemming of token arrays.

Tokenising stays JVM-side (:func:`logloom.functions.tokenize.tokenize`); the
token arrays travel to Python in Arrow batches.  A batch's tokens are
dictionary-encoded, its distinct tokens stemmed once each, and the codes
taken back to arrays.  No shuffle is involved.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F
from pyspark.sql import types as T

from logloom.functions.porter import stem
from logloom.session import ship_package
from logloom.functions.tokenize import tokenize, tokenize_py

def _stems(tokens: np.ndarray) -> np.ndarray:
    """Stem of every token (nulls stay), each distinct one computed once."""
    codes, words = pd.factorize(tokens)
    stems = np.array([*(stem(w) for w in words), None], object)
    return stems[codes]  # a null's code is -1: the last entry


def _stem_arrays(tokens: pa.Array) -> pa.Array:
    """Arrow to Arrow: only the distinct tokens of a batch become Python objects."""
    codes = tokens.flatten().dictionary_encode()
    stems = pa.array([stem(w) for w in codes.dictionary.to_pylist()], pa.string()).take(codes.indices)
    ends = np.cumsum(pc.fill_null(pc.list_value_length(tokens), 0).to_numpy(zero_copy_only=False))
    return pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), stems, mask=pc.is_null(tokens))


def _stem_tokens(tokens: pd.Series) -> pd.Series:
    return pd.Series(_stems(tokens.to_numpy(object)), dtype=object)


# Declared non-deterministic only to pin them in the plan: Catalyst would
# otherwise push a search filter (and with it the UDF) below a repartition
# that exists to spread this very work over all cores.
stem_array = F.arrow_udf(_stem_arrays, T.ArrayType(T.StringType())).asNondeterministic()
stem_token = F.pandas_udf(_stem_tokens, T.StringType()).asNondeterministic()


def terms(text: Column | str) -> Column:
    """Text -> stemmed token array, in text order (the search index column)."""
    ship_package()
    return stem_array(tokenize(text))


def stem_column(token: Column | str) -> Column:
    """Stem of a single-token column (vocabulary building)."""
    ship_package()
    return stem_token(F.col(token) if isinstance(token, str) else token)


def query_terms(word: str) -> list[str]:
    """Stemmed tokens of a query word, computed on the driver (tiny input)."""
    return [stem(t) for t in tokenize_py(word)]
