"""Repeated documents: what a document gives depends on nothing but the document, so it is worked out once.

Each different document of an Arrow batch is judged once.  Short ones are remembered by the worker for
later batches, in bounded memory; forgetting only costs time.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache
from typing import Any

import numpy as np
import pyarrow as pa

#: The longest document that is remembered, how many are at once, and for how many schemas.
LONGEST, MOST, SCHEMAS = 1024, 4096, 4
#: Documents that come this often in a batch on average are worth asking for before they are tested in the JVM.
OFTEN = 8


@lru_cache(maxsize=SCHEMAS)
def memory(*use: Any) -> dict:
    """What a worker remembers for one use: a schema, a rule, a model and options."""
    return {}


def recalled(known: dict, document: str | bytes, work: Callable[[], Any], small: Callable[[Any], bool] = lambda _: True) -> Any:
    """``work()``, or its result as remembered; only ``small`` results of short documents are kept."""
    if len(document) > LONGEST:
        return work()
    if document in known:
        return known[document]
    out = work()
    if small(out):
        if len(known) >= MOST:
            known.clear()
        known[document] = out
    return out


def different(documents: pa.Array) -> tuple[pa.Array, np.ndarray, pa.Array]:
    """The different documents, the place where each comes first, and for every row which it is (null for a null)."""
    coded = documents.dictionary_encode()
    first = np.zeros(len(coded.dictionary), np.int64)
    at = coded.indices.to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(coded.indices.is_valid().to_numpy(zero_copy_only=False))[::-1]
    first[at[rows].astype(np.int64)] = rows
    return coded.dictionary, first, coded.indices


def often(documents: pa.Array, values: pa.Array) -> bool:
    return len(values) * OFTEN <= len(documents)
