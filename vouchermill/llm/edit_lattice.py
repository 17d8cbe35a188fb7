"""Cheapest edits that turn a sequence of turns into `(s?(ua)+)?`, by bidirectional Dijkstra.

Nodes of the lattice are (rows done, state); a state tells which roles may come
next. A row is kept, given another role, or deleted; an empty turn may be
inserted anywhere. Labels are (cost, audit), the audit being the initials of the
edits. Two paths of equal cost to one node never have audits of which one begins
with the other (the same rows with the same letters cost the same, and what is
left over are insertions, which cost something), so the least label of a node
stays the least however the path goes on, in both directions.
"""

from __future__ import annotations

import heapq
from typing import NamedTuple

START, SYSTEM, USER, ASSISTANT = range(4)  # after nothing, s, …u, …ua
ACCEPTING = (START, ASSISTANT)
#: state after a role's initial
AFTER = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
#: the only role that a state lets in beside the opening system turn
WANTED = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
# fixed values: costs of the edits, and of leaving a truncated turn
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3


class Item(NamedTuple):
    """A turn by its role's initial, or a number of turns that have to go."""

    initial: str
    truncated: bool
    forced: int = 0


Label = tuple[int, str]


def _steps(item: Item, state: int):
    """Edges over a row: (state after it, cost, letters)."""
    if item.forced:
        yield state, DELETE * item.forced, "D" * item.forced
        return
    extra = TRUNCATED if item.truncated else 0
    kept = AFTER.get((state, item.initial))
    if kept is not None:
        yield kept, extra, "K"
    yield AFTER[state, WANTED[state][0]], REROLE + extra, "R"
    yield state, DELETE, "D"


def _edges(items: tuple[Item, ...], row: int, state: int):
    """(row, state, cost, letters) of all edges out of a node."""
    yield row, AFTER[state, WANTED[state][0]], INSERT, "I"
    if row < len(items):
        for after, cost, letters in _steps(items[row], state):
            yield row + 1, after, cost, letters


def _edges_back(items: tuple[Item, ...], row: int, state: int):
    """(row, state, cost, letters) of all edges into a node."""
    for before in range(4):
        if AFTER[before, WANTED[before][0]] == state:
            yield row, before, INSERT, "I"
        if row:
            for after, cost, letters in _steps(items[row - 1], before):
                if after == state:
                    yield row - 1, before, cost, letters


def cheapest(items: tuple[Item, ...], entry: int = START, exits: tuple[int, ...] = ACCEPTING) -> Label | None:
    """Least (cost, audit) of the paths over all items from a state to one of others.

    Both heaps are ordered by cost and then by rows done: edges that cost nothing
    always pass a row, so a node is taken only when its least label is known. A
    best cost is known once the searches meet; they go on while the two least
    costs still add up to no more than it, which finishes every crossing of that
    cost, and the least concatenated audit among those is taken.
    """
    n = len(items)
    heaps = ([(0, 0, "", 0, entry)], [(0, 0, "", n, x) for x in exits])
    done: tuple[dict, dict] = ({}, {})
    best: Label | None = None

    def met(cost: int, audit: str) -> None:
        nonlocal best
        if best is None or (cost, audit) < best:
            best = (cost, audit)

    while heaps[0] and heaps[1]:
        if best is not None and heaps[0][0][0] + heaps[1][0][0] > best[0]:
            break
        back = heaps[1][0][0] < heaps[0][0][0]
        own, other = (done[1], done[0]) if back else done
        cost, _, audit, row, state = heapq.heappop(heaps[back])
        if (row, state) in own:
            continue
        own[row, state] = cost, audit
        if (row, state) in other:
            beyond = other[row, state]
            met(cost + beyond[0], beyond[1] + audit if back else audit + beyond[1])
        for to, after, price, letters in (_edges_back if back else _edges)(items, row, state):
            new = letters + audit if back else audit + letters
            if (to, after) in other:
                beyond = other[to, after]
                met(cost + price + beyond[0], beyond[1] + new if back else new + beyond[1])
            if (to, after) not in own:
                heapq.heappush(heaps[back], (cost + price, n - to if back else to, new, to, after))
    # a search that ran out has reached the other's beginning
    for x in exits:
        if (n, x) in done[0]:
            met(*done[0][n, x])
    if (0, entry) in done[1]:
        met(*done[1][0, entry])
    return best


class Chain(NamedTuple):
    """The edits of a block and, behind them, those of the blocks that follow."""

    block: int
    entry: int
    audit: str
    rest: "Chain | None"


def chain_less(a: Chain | None, b: Chain | None) -> bool:
    """Whether the audits of one chain, one after another, come before those of the other.

    Chains soon share their later blocks, where nothing needs to be compared."""
    x = y = ""
    while True:
        while not x and not y and a is b:
            return False
        while not x and a is not None:
            x, a = a.audit, a.rest
        while not y and b is not None:
            y, b = b.audit, b.rest
        if not x or not y:
            return not x and bool(y)
        k = min(len(x), len(y))
        if x[:k] != y[:k]:
            return x[:k] < y[:k]
        x, y = x[k:], y[k:]


def prepend(block: int, labels: list[tuple[int, int, int, str]], rest: dict[int, tuple[int, Chain | None]]) -> dict[int, tuple[int, Chain | None]]:
    """Best continuation by state before a block, from those after it; labels are (entry, exit, cost, audit)."""
    best: dict[int, tuple[int, Chain | None]] = {}
    for entry, leave, cost, audit in labels:
        if leave not in rest:
            continue
        total, chain = cost + rest[leave][0], Chain(block, entry, audit, rest[leave][1])
        if entry not in best or total < best[entry][0] or total == best[entry][0] and chain_less(chain, best[entry][1]):
            best[entry] = total, chain
    return best
