"""The spelling tree of operator 10 on one machine, for the tests."""

import numpy as np
import pyarrow as pa

from deliverix.llm.lm_scoring import DEPTH, _entry, symbols
from deliverix.llm.token_tree import find


class SuffixTree:
    """Retained contexts with log10 weights of their parents, and log10 probabilities of their entries."""

    def __init__(self, entries: np.ndarray, n: np.ndarray):
        order = np.argsort(entries)
        self.entry, n = entries[order], n[order].astype(np.float64)
        context = self.entry >> 8
        self.state, first, code = np.unique(context, return_index=True, return_inverse=True)
        total = np.bincount(code, weights=n, minlength=len(self.state))
        kinds = np.bincount(code, minlength=len(self.state))
        self.back = np.log10(kinds / (total + kinds)) if len(self.state) else np.zeros(0)
        p = np.zeros(len(n))
        depth = self.entry >> 48
        for d in range(DEPTH + 1):  # parents before children
            at = np.flatnonzero(depth == d)
            if d == 0:
                parent = np.full(len(at), 1 / 256)
            else:
                c = (self.entry[at] >> 8) & ((1 << 8 * (d - 1)) - 1)
                parent = p[np.searchsorted(self.entry, _entry(d - 1, c, self.entry[at] & 255))]
            p[at] = (n[at] + kinds[code[at]] * parent) / (total[code[at]] + kinds[code[at]])
        self.log_p = np.log10(p)

    def score(self, words: pa.Array) -> np.ndarray:
        """log10 probability of each word (its bytes and the closing blank)."""
        symbol, contexts, longest, size = symbols(words)
        level = np.full(len(symbol), -1)
        for d in range(DEPTH, -1, -1):
            open_ = np.flatnonzero((level < 0) & (longest >= d))
            _, has = find(self.state, (np.int64(d) << 40) | contexts[d][open_])
            level[open_[has]] = d
        out = np.zeros(len(symbol))
        open_ = np.ones(len(symbol), bool)
        for d in range(DEPTH, -1, -1):
            at = np.flatnonzero(open_ & (level >= d))
            k, has = find(self.entry, _entry(d, contexts[d][at], symbol[at]))
            out[at[has]] += self.log_p[k[has]]
            open_[at[has]] = False
            miss = at[~has]
            k, _ = find(self.state, (np.int64(d) << 40) | contexts[d][miss])
            out[miss] += self.back[k]
        out[open_] += np.log10(1 / 256)
        return np.add.reduceat(out, np.cumsum(size) - size) if len(size) else np.zeros(0)
