"""PPM of a small corpus in memory, with tables of all contexts: what the distributed model is held against."""

import numpy as np

from panelith.llm.lm import ORDER

CONTEXT_BITS, SEGMENT = 16, 256


class Trie:
    """Kept nodes per length: sorted codes and counts; ``contexts[k]`` are the kept contexts of k bytes."""

    def __init__(self, total: int, nodes: dict[int, tuple[np.ndarray, np.ndarray]], order: int = ORDER, context_bits: int = CONTEXT_BITS):
        self.total, self.nodes, self.order = total, nodes, order
        least = total >> context_bits
        self.contexts = {0: np.zeros(1, dtype=np.int64)} | {k: nodes[k][0][nodes[k][1] > least] if k in nodes else np.empty(0, dtype=np.int64) for k in range(1, order + 1)}
        # a context needs its shorter one, which counts at least as much up to text starts
        for k in range(2, order + 1):
            c = self.contexts[k]
            self.contexts[k] = c[np.isin(c & ((1 << 8 * (k - 1)) - 1), self.contexts[k - 1])]
        self._tables = None

    def __getstate__(self):
        return self.total, self.nodes, self.order, self.contexts

    def __setstate__(self, state):
        self.total, self.nodes, self.order, self.contexts = state
        self._tables = None

    def tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Column of each byte, cost[state, column] in log10 and the next state; states stand in order of length, then code.

        Bytes without a kept node of their own share the last column and its probability.
        """
        if self._tables is not None:
            return self._tables
        own = self.nodes[1][0] if 1 in self.nodes else np.empty(0, dtype=np.int64)
        width = len(own) + 1
        column = np.full(256, len(own), dtype=np.int64)
        column[own] = np.arange(len(own))
        first = dict(zip(range(self.order + 1), np.cumsum([0] + [len(self.contexts[k]) for k in range(self.order + 1)]).tolist(), strict=False))
        states = sum(len(c) for c in self.contexts.values())
        cost, step = np.empty((states, width), dtype=np.float32), np.zeros((states, width), dtype=np.int32)
        lower = None
        for k in range(self.order + 1):
            ctx = self.contexts[k]
            keep = [np.empty((len(ctx), width)), np.empty(len(ctx)), np.empty((len(ctx), width))]
            for a in range(0, len(ctx), 2048):
                part = slice(a, min(a + 2048, len(ctx)))
                p, *rest = self._order(k, ctx[part], column, width, lower)
                for whole, piece in zip(keep, rest, strict=True):
                    whole[part] = piece
                if width <= 256:
                    p[:, -1] /= 257 - width  # the bytes that share the column
                cost[first[k] + part.start : first[k] + part.stop] = np.log10(np.maximum(p, 1e-300))
                codes = (ctx[part][:, None] << 8) | own[None, :]
                open_ = np.ones(codes.shape, dtype=bool)
                to = step[first[k] + part.start : first[k] + part.stop, :-1]
                for m in range(min(k + 1, self.order), 0, -1):
                    known = self.contexts[m]
                    if len(known):
                        want = codes & ((1 << 8 * m) - 1)
                        pos = np.minimum(np.searchsorted(known, want), len(known) - 1)
                        hit = open_ & (known[pos] == want)
                        to[hit] = first[m] + pos[hit]
                        open_ &= ~hit
            lower = (*keep, ctx)
        self._tables = (column, cost.ravel(), step.ravel())
        return self._tables

    def _order(self, k: int, ctx: np.ndarray, column: np.ndarray, width: int, lower) -> tuple[np.ndarray, ...]:
        """Of contexts of ``k`` bytes: probabilities, kept counts, totals and, for longer contexts, what follows an escape."""
        count = np.zeros((len(ctx), width))
        codes, n = self.nodes.get(k + 1, (np.empty(0, dtype=np.int64),) * 2)
        lo, hi = np.searchsorted(codes >> 8, [ctx[0], ctx[-1] + 1])
        codes, n = codes[lo:hi], n[lo:hi]
        if len(codes):
            parent = np.minimum(np.searchsorted(ctx, codes >> 8), len(ctx) - 1)
            ok = ctx[parent] == codes >> 8
            count[parent[ok], column[codes[ok] & 255]] = n[ok]
        seen = count > 0
        kept, distinct = count.sum(axis=1), seen.sum(axis=1)
        # what the kept continuations don't hold of the total is left to the escape
        total = np.full(len(ctx), float(self.total)) if k == 0 else self.nodes[k][1][np.searchsorted(self.nodes[k][0], ctx)].astype(float)
        total = np.maximum(total, kept)
        if k == 0:
            fallback = np.zeros((1, width))
            fallback[0, -1] = 1.0 if width <= 256 else 0.0  # only bytes without a node are left
        else:
            b_count, b_total, b_fallback, b_ctx = lower
            at = np.searchsorted(b_ctx, ctx & ((1 << 8 * (k - 1)) - 1)) if k > 1 else np.zeros(len(ctx), dtype=np.int64)
            offer = np.where(seen, 0.0, b_count[at])  # the shorter context without the excluded symbols
            held, fresh = offer.sum(axis=1), (offer > 0).sum(axis=1)
            left = np.maximum(b_total[at] - np.where(seen, b_count[at], 0.0).sum(axis=1), held)
            rest = np.where(seen | (offer > 0), 0.0, b_fallback[at])
            mass = rest.sum(axis=1)
            more = np.where(mass > 0, left - held + fresh, 0.0)
            more = np.where((mass > 0) & (held + more <= 0), 1.0, more)
            fallback = offer + rest * (more / np.maximum(mass, 1e-300))[:, None]
            fallback /= np.maximum(fallback.sum(axis=1), 1e-300)[:, None]
        escape = np.where(fallback.sum(axis=1) > 0, total - kept + distinct, 0.0)
        escape = np.where((kept + escape <= 0) & (fallback.sum(axis=1) > 0), 1.0, escape)
        p = (count + fallback * escape[:, None]) / np.maximum(kept + escape, 1e-300)[:, None]
        return p, count, total, fallback


def log10_probabilities(trie: Trie, texts: list[bytes]) -> np.ndarray:
    """log10 of each normalised text's probability; the texts end with the end byte."""
    column, cost, step = trie.tables()
    width, order = len(cost) // (sum(len(c) for c in trie.contexts.values())), trie.order
    lengths = np.array([len(t) for t in texts], dtype=np.int64)
    data = column[np.frombuffer(b"\n" * order + (b"\n" * order).join(texts), dtype=np.uint8)]
    starts = order + np.concatenate([[0], np.cumsum(lengths + order)[:-1]])
    pieces = -(-lengths // SEGMENT)
    owner = np.repeat(np.arange(len(texts)), pieces)
    within = (np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)) * SEGMENT
    begin, todo = starts[owner] + within, np.minimum(SEGMENT, lengths[owner] - within)
    by_length = np.argsort(-todo, kind="stable")
    begin, todo, owner = begin[by_length], todo[by_length], owner[by_length]
    state = np.zeros(len(begin), dtype=np.int64)
    for k in range(order):
        state = step[state * width + data[begin - order + k]].astype(np.int64)
    total = np.zeros(len(begin))
    for k in range(int(todo.max(initial=0))):
        live = int(np.searchsorted(-todo, -k))  # segments longer than k come first
        at = state[:live] * width + data[begin[:live] + k]
        total[:live] += cost[at]
        state[:live] = step[at]
    return np.bincount(owner, weights=total, minlength=len(texts))
