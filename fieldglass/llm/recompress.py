"""Rounds of recompression over many word sequences at once: names for pairs and runs that depend on their surroundings only nearby."""

from __future__ import annotations

import numpy as np

from fieldglass.llm.common import join_hash, mix

#: Farther than any word.
FAR = np.int64(1) << np.int64(40)


def compress(sym: np.ndarray, doc: np.ndarray, lo: np.ndarray, hi: np.ndarray, salt: int) -> tuple[np.ndarray, ...]:
    """One round. A symbol's hash says whether it is a left or a right one; each left one followed by a right one becomes a pair.

    Of what is left over, equal neighbours become runs. A name is the hash of what it stands for, so equal words get equal
    names on all executors without a shared table. [lo, hi) is the stretch of words that a symbol's being there depends on:
    a pair depends on its parts alone, what is left over on its neighbours too.
    """
    n = len(sym)
    if n < 2:
        return sym, doc, np.full(n, -FAR), np.full(n, FAR)
    right = (mix(sym + np.uint64(2 * salt + 1)) & np.uint64(1)).astype(bool)
    next_in = doc[1:] == doc[:-1]
    equal = next_in & (sym[1:] == sym[:-1])
    head, tail = np.zeros(n, bool), np.zeros(n, bool)
    head[:-1] = ~right[:-1] & right[1:] & next_in
    tail[1:] = head[:-1]
    lone = ~(head | tail)
    goes_on = np.zeros(n, bool)
    goes_on[1:] = lone[1:] & lone[:-1] & equal
    at = np.flatnonzero(head | (lone & ~goes_on))
    end = np.append(at[1:], n)
    # The stretch that tells what a symbol's neighbour is; where the neighbour is equal but in a pair, also that pair's other part.
    left_lo, right_hi = np.full(n, -FAR), np.full(n, FAR)
    left_lo[1:][next_in] = lo[:-1][next_in]
    right_hi[:-1][next_in] = hi[1:][next_in]
    twice = equal[1:]
    left_lo[2:][twice] = np.where(next_in[:-1][twice], np.minimum(left_lo[2:][twice], lo[:-2][twice]), -FAR)
    if n > 2:
        twice = equal[:-1]
        right_hi[:-2][twice] = np.where(next_in[1:][twice], np.maximum(right_hi[:-2][twice], hi[2:][twice]), FAR)
    left_lo[1:2][equal[:1]] = -FAR
    right_hi[n - 2 : n - 1][equal[n - 2 : n - 1]] = FAR
    is_pair, last = head[at], end - 1
    pair_at = at[is_pair]
    new = sym[at].copy()
    new[is_pair] = join_hash(sym[pair_at], sym[pair_at + 1], salt)
    run = ~is_pair & (end - at > 1)
    new[run] = join_hash(sym[at[run]], (end - at)[run].astype(np.uint64), salt + 101)
    new_lo = np.where(is_pair, np.minimum(lo[at], lo[last]), np.minimum(lo[at], left_lo[at]))
    new_hi = np.where(is_pair, np.maximum(hi[at], hi[last]), np.maximum(hi[last], right_hi[last]))
    return new, doc[at], new_lo, new_hi


def symbols(words: np.ndarray, doc: np.ndarray, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names after so many rounds, and the stretch [lo, hi) of words that each depends on."""
    at = np.arange(len(words), dtype=np.int64)
    state = (words, doc, at, at + 1)
    for k in range(rounds):
        state = compress(*state, salt=k)
    return state[0], state[2], state[3]
