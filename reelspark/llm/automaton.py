"""Running one finite automaton over all words of a buffer at once, one byte position a step."""

from __future__ import annotations

import numpy as np

#: So few words are walked one by one.
FEW = 16


def run(table: np.ndarray, width: int, symbols: np.ndarray, starts: np.ndarray, ends: np.ndarray, begin: int) -> tuple[np.ndarray, np.ndarray]:
    """Final states and summed outputs of every word.

    ``table`` is flat, entry ``state * width + symbol`` holds the next state in its low 24 bits and an
    output in its high 8. Words run in order of length, so that those still active are a prefix.
    """
    n = len(starts)
    lens = ends - starts
    order = np.argsort(-lens, kind="stable")
    at = starts[order]
    sizes = lens[order]
    state = np.full(n, begin, dtype=np.int64)
    total = np.zeros(n, dtype=np.int64)
    longest = int(sizes[0]) if n else 0
    # active[j]: how many words have more than j symbols
    active = n - np.cumsum(np.bincount(sizes, minlength=longest + 1))[: longest + 1] if n else []
    for j in range(longest):
        m = int(active[j])
        if m <= FEW and longest - j > 64:  # a few very long words: one by one, as a step over so few does not pay
            plain = memoryview(np.ascontiguousarray(table))
            for i in range(m):
                now, out = int(state[i]), 0
                for lo in range(int(at[i]) + j, int(at[i] + sizes[i]), 1 << 20):
                    for c in symbols[lo : min(lo + (1 << 20), int(at[i] + sizes[i]))].tolist():
                        got = plain[now * width + c]
                        now = got & 0xFFFFFF
                        out += got >> 24
                state[i], total[i] = now, total[i] + out
            break
        got = table[state[:m] * width + symbols[at[:m] + j]]
        state[:m] = got & 0xFFFFFF
        total[:m] += got >> 24
    back_state, back_total = np.empty(n, np.int64), np.empty(n, np.int64)
    back_state[order], back_total[order] = state, total
    return back_state, back_total
