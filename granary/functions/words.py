"""Terms of whole batches of texts, in Python without a loop over terms."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_TERM_BYTE = np.array([chr(b).isalnum() and b < 128 for b in range(256)])
#: Bytes of other characters stand for a space, so that what lies between terms is valid text too.
_ASCII = bytes(b if b < 128 else 32 for b in range(256))


def terms_of(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """All terms of the texts, as :func:`granary.functions.text.tokens` has them, and where those of each text end; no Python loop over terms."""
    raw = [t.lower().encode() for t in texts]
    joined = b" ".join(raw) + b" "
    bounds = np.cumsum([len(r) + 1 for r in raw])
    edge = np.flatnonzero(np.diff(np.concatenate(([False], _TERM_BYTE[np.frombuffer(joined, np.uint8)])).view(np.int8)))
    start, end = edge[0::2], edge[1::2]
    # Every second stretch between edges is a term.
    cut = np.concatenate(([0], edge)).astype(np.int64)
    every = pa.LargeStringArray.from_buffers(len(cut) - 1, pa.py_buffer(cut), pa.py_buffer(joined.translate(_ASCII)))
    return every.take(pa.array(np.arange(1, len(cut) - 1, 2))), np.searchsorted(start, bounds)
