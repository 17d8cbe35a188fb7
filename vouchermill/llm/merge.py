"""Merging sorted runs of byte strings with a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator


def common(a: bytes, b: bytes, at: int) -> int:
    """Length of the common prefix of two strings that agree on their first `at` bytes."""
    end = min(len(a), len(b))
    step = 32
    while at + step <= end and a[at : at + step] == b[at : at + step]:
        at += step
    while step:
        if at + step <= end and a[at : at + step] == b[at : at + step]:
            at += step
        step >>= 1
    return at


class Run:
    """A sorted run: item i is `keys[i]`, then `ties[i]` among equal keys;
    `shared[i]` is the common prefix of keys[i] and keys[i - 1]."""

    def __init__(self, keys: list[bytes], ties: list[bytes], shared: list[int]):
        self.keys, self.ties, self.shared = keys, ties, shared


def merge_runs(runs: list[Run]) -> Iterator[tuple[int, int, int]]:
    """(run, item, prefix shared with the key before) in ascending order of key and tie.

    Every node of the tree holds a loser and the prefix that it shares with the
    last winner. Of two items the one with the longer shared prefix is the
    smaller; only items with equal ones are compared, from there on, so no known
    byte is looked at again.
    """
    width = 1
    while width < len(runs):
        width *= 2
    keys = [r.keys for r in runs]
    at = [0] * len(runs)
    gone = -1
    tree: list[tuple[int, int]] = [(gone, 0)] * width  # (run, shared with the last winner)

    def play(a: tuple[int, int], b: tuple[int, int]):
        """Winner and loser; both prefixes are relative to the last winner, and the loser's becomes relative to the new one."""
        if a[0] == gone or b[0] == gone:
            return (b, a) if a[0] == gone else (a, b)
        if a[1] != b[1]:
            return (a, b) if a[1] > b[1] else (b, a)
        x, y = keys[a[0]][at[a[0]]], keys[b[0]][at[b[0]]]
        n = common(x, y, a[1])
        if n < len(x) and n < len(y):
            first = x[n] < y[n]
        elif len(x) != len(y):
            first = len(x) < len(y)
        else:
            first = (runs[a[0]].ties[at[a[0]]], a[0]) <= (runs[b[0]].ties[at[b[0]]], b[0])
        return (a, (b[0], n)) if first else (b, (a[0], n))

    def build(node: int) -> tuple[int, int]:
        if node >= width:
            r = node - width
            return (r, 0) if r < len(runs) and keys[r] else (gone, 0)
        winner, tree[node] = play(build(2 * node), build(2 * node + 1))
        return winner

    winner = build(1)
    while winner[0] != gone:
        r, shared = winner
        i = at[r]
        yield r, i, shared
        at[r] = i + 1
        now = (r, runs[r].shared[i + 1]) if i + 1 < len(keys[r]) else (gone, 0)
        node = (width + r) >> 1
        while node:
            held = tree[node]
            if held[0] != gone:
                if now[0] == gone or held[1] > now[1]:
                    tree[node], now = now, held
                elif held[1] == now[1]:
                    now, tree[node] = play(now, held)
            node >>= 1
        winner = now
