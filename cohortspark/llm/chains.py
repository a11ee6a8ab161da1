"""Scaled forward and backward recursions over many sequences at once."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Sequences go through the recursions so many symbols at a time.
BATCH_SYMBOLS = 300_000


def in_batches(lengths: np.ndarray, limit: int = BATCH_SYMBOLS) -> Iterator[np.ndarray]:
    """Sequences, longest first, so many that their symbols stay within the limit (or one longer sequence)."""
    order, held, first = np.argsort(-lengths, kind="stable"), 0, 0
    for i, one in enumerate(order):
        if held and held + lengths[one] > limit:
            yield order[first:i]
            held, first = 0, i
        held += int(lengths[one])
    if len(order):
        yield order[first:]


@dataclass
class Pass:
    """Results by symbol are in the order of ``seen``: all first symbols, then all second ones, and so on."""

    likelihood: np.ndarray  # natural logarithm, by sequence
    seen: np.ndarray  # symbol
    of: np.ndarray  # sequence of the symbol
    place: np.ndarray  # position of the symbol in its sequence
    first: int  # so many sequences, so many first symbols
    gamma: np.ndarray | None = None  # probability of each state
    moves: np.ndarray | None = None  # expected moves from state to state, all sequences together


def recursions(
    start: np.ndarray,
    move: np.ndarray,
    table: np.ndarray,
    flat: np.ndarray,
    starts: np.ndarray,
    lengths: np.ndarray,
    backward: bool = False,
) -> Pass:
    """Sequences ``flat[starts : starts + lengths]``, longest first, each of one symbol at least.

    ``table[symbol]`` has a positive weight per state; ``start`` and ``move`` are weights too, probabilities or not.
    """
    longest = int(lengths[0])
    alive = np.searchsorted(-lengths, -np.arange(longest), "left")  # sequences longer than t
    at = np.concatenate([[0], np.cumsum(alive)])
    seen = np.concatenate([flat[starts[: alive[t]] + t] for t in range(longest)])
    out = table[seen]
    alpha, scale = np.empty_like(out), np.empty(len(seen))
    now, ones = np.broadcast_to(start, (alive[0], len(start))), np.ones(len(start))
    for t in range(longest):
        a, b = at[t], at[t + 1]
        now = now * out[a:b] if t == 0 else (now[: b - a] @ move) * out[a:b]
        s = now @ ones  # narrow rows: faster than a sum along them
        now /= s[:, None]
        alpha[a:b], scale[a:b] = now, s
    of = np.concatenate([np.arange(n) for n in alive])
    likelihood = np.bincount(of, weights=np.log(scale), minlength=len(lengths))
    done = Pass(likelihood, seen, of, np.repeat(np.arange(longest), alive), int(alive[0]))
    if backward:
        beta, turned = np.empty_like(out), np.ascontiguousarray(move.T)
        out /= scale[:, None]  # in place: what a symbol passes on backwards is this times beta
        beta[at[-2] :] = 1.0
        for t in range(longest - 2, -1, -1):
            a, b, end = at[t], at[t + 1], at[t + 2]
            out[b:end] *= beta[b:end]
            beta[a + end - b : b] = 1.0  # sequences that end here
            np.matmul(out[b:end], turned, out=beta[a : a + end - b])
        done.gamma = alpha * beta
        head = int(alive[0])
        before = np.arange(head, len(seen)) - np.repeat(alive[:-1], alive[1:])
        done.moves = alpha[before].T @ out[head:] * move
    return done
