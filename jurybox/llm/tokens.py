"""Token ids of whole texts, a batch of texts at a time.

Texts are cut at ASCII white space, which no token of the tokenizers handled here crosses,
and the library encodes each distinct run once. Runs seen before are looked up, a batch at a
time, in an Arrow table of bounded size that lives as long as the Python worker.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_RUNS = 1_200_000  # about 50 bytes each
MEMO_CHARS = 64  # longer runs are encoded anew each time
CHUNK_BYTES = 8 << 20  # text handled at once, except for a single longer text


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices start, start + 1, ... of ranges, one range after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.arange(total, dtype=np.int64) + np.repeat(starts - (ends - lengths), lengths)


class Encoder:
    """Encodes string arrays with one tokenizer file."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.lowers = '"type":"Lowercase"' in self.tokenizer.to_str(pretty=False)
        self.special = sorted({t.content[:1] for t in self.tokenizer.get_added_tokens_decoder().values()})
        # Runs met before, where each one's ids start in `store`, how many, and the call that last met it.
        self.known = pa.array([], pa.large_string())
        self.starts = self.sizes = self.last = np.zeros(0, dtype=np.int64)
        self.store = np.zeros(0, dtype=np.int32)
        self.calls = 0

    def _keys(self, runs: pa.Array) -> pa.Array:
        """The same for runs that only differ by case, where the tokenizer drops it."""
        if not self.lowers:
            return runs
        plain = pc.equal(pc.binary_length(runs), pc.cast(pc.utf8_length(runs), pa.int64()))
        for first in self.special:
            plain = pc.and_not(plain, pc.match_substring(runs, first))
        return pc.if_else(plain, pc.ascii_lower(runs), runs)

    def _new_ids(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all runs by the library, one after the other, and how many each has."""
        sizes, ids = np.zeros(len(runs), dtype=np.int64), [np.zeros(0, dtype=np.int32)]
        for at in range(0, len(runs), 50_000):
            found = [e.ids for e in self.tokenizer.encode_batch_fast(runs[at:at + 50_000], add_special_tokens=False)]
            sizes[at:at + len(found)] = list(map(len, found))
            ids.append(np.fromiter(chain.from_iterable(found), dtype=np.int32, count=int(sizes[at:at + len(found)].sum())))
        return np.concatenate(ids), sizes

    def _look_up(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where each distinct key's ids start, how many they are, and the array that holds them."""
        self.calls += 1
        at = pc.index_in(keys, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False)
        new, old = at < 0, at[at >= 0]
        fresh = keys.filter(pa.array(new))
        ids, counts = self._new_ids(fresh.to_pylist())
        store = np.concatenate([self.store, ids])
        begins = len(self.store) + np.cumsum(counts) - counts
        starts, sizes = np.empty(len(keys), dtype=np.int64), np.empty(len(keys), dtype=np.int64)
        starts[~new], sizes[~new], self.last[old] = self.starts[old], self.sizes[old], self.calls
        starts[new], sizes[new] = begins, counts
        short = pc.less_equal(pc.binary_length(fresh), MEMO_CHARS).to_numpy(zero_copy_only=False)
        self.known = pa.concat_arrays([self.known, fresh.filter(pa.array(short))])
        self.starts, self.sizes = np.concatenate([self.starts, begins[short]]), np.concatenate([self.sizes, counts[short]])
        self.last = np.concatenate([self.last, np.full(int(short.sum()), self.calls)])
        self.store = store
        if len(self.known) > MEMO_RUNS:
            self._forget()
        elif not short.all():
            self._keep(np.arange(len(self.known)))
        return starts, sizes, store

    def _forget(self) -> None:
        """Keep the half of the table that was met last."""
        self._keep(np.sort(np.argsort(self.last, kind="stable")[-(MEMO_RUNS // 2):]))

    def _keep(self, rows: np.ndarray) -> None:
        self.known = self.known.take(pa.array(rows))
        self.store = self.store[spread(self.starts[rows], self.sizes[rows])]
        self.sizes, self.last = self.sizes[rows], self.last[rows]
        self.starts = np.cumsum(self.sizes) - self.sizes

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and the n + 1 bounds of each text's ids. Null texts have none."""
        parts = pc.ascii_split_whitespace(texts.cast(pa.large_string()).fill_null(""))
        runs = parts.flatten().dictionary_encode()
        keys = self._keys(runs.dictionary).dictionary_encode()
        starts, sizes, store = self._look_up(keys.dictionary)
        codes = keys.indices.to_numpy(zero_copy_only=False)[runs.indices.to_numpy(zero_copy_only=False)]
        lengths = sizes[codes]
        ids = store[spread(starts[codes], lengths)]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        places = parts.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        return ids, ends[places - places[0]]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker."""
    return Encoder(path)


def chunks(batch: pa.RecordBatch, text: str, limit: int = CHUNK_BYTES):
    """Parts of a batch whose texts have about `limit` bytes together.

    Parts are copies: Arrow's lower-casing takes the offsets of a slice for those of its parent.
    """
    sizes = np.nan_to_num(pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False))
    groups = (np.cumsum(sizes) - sizes) // limit
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1), batch.num_rows]
    for a, b in zip(edges[:-1], edges[1:]):
        if b > a:
            part = batch.slice(a, b - a)
            yield part if part.num_rows == batch.num_rows else part.take(pa.array(np.arange(part.num_rows)))


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same ids with `end_id` after each text's."""
    n = len(bounds) - 1
    out = np.empty(len(ids) + n, dtype=np.int32)
    ends = bounds[1:] + np.arange(n)
    mask = np.ones(len(out), dtype=bool)
    mask[ends] = False
    out[ends] = end_id
    out[mask] = ids
    return out, bounds + np.arange(n + 1)
