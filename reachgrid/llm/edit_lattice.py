"""Least edits that make a sequence of turns a legal conversation.

The lattice has a node for each place between turns and each state of the
grammar ``(s?(ua)+)?``. From a node a turn is kept (0, where the grammar allows
it), given the role that comes next (3) or deleted (4), or an empty turn with
that role is inserted (3); a truncated turn that stays costs 3 more. From one
node every kind of edit leads to one other node, so the letters of a path name
it.

Two searches with a heap each, one from the start and one from the ends, settle
nodes until no cheaper path can exist nor one of equal cost be unseen. Each
label keeps the least path of its cost: backwards the first letter decides,
forwards the letters behind the last common node do, because no path to a node
is the beginning of another one of the same cost. Memory is a few numbers a
node, whatever the length of the audits.
"""

from __future__ import annotations

from functools import lru_cache
from heapq import heappop, heappush

#: Code of a turn: one of these, plus the flags below.
OTHER, SYSTEM, USER, ASSISTANT = range(4)
MUST_GO, TRUNCATED = 4, 8

#: States: at the start, after a system turn, after a user turn, after an assistant turn.
STATES = range(4)
ENDS = (0, 3)
#: State after a kept turn of each kind; -1 where the grammar has none.
STEP = ((-1, 1, 2, -1), (-1, -1, 2, -1), (-1, -1, -1, 3), (-1, -1, 2, -1))
#: State after a turn that is inserted or given another role.
NEXT = (2, 2, 3, 2)
BEFORE_STEP = tuple(tuple(tuple(p for p in STATES if STEP[p][kind] == q) for kind in range(4)) for q in STATES)
BEFORE_NEXT = tuple(tuple(p for p in STATES if NEXT[p] == q) for q in STATES)
INSERT, RENAME, DELETE, TORN = 3, 3, 4, 3
FAR = 1 << 60


def _onward(codes: bytes, node: int):
    """(cost, letter, node) of the edges out of a node."""
    i, q = node >> 2, node & 3
    if i < len(codes):
        code = codes[i]
        if not code & MUST_GO:
            more = TORN if code & TRUNCATED else 0
            kept = STEP[q][code & 3]
            if kept >= 0:
                yield more, "K", node + 4 - q + kept
            yield RENAME + more, "R", node + 4 - q + NEXT[q]
        yield DELETE, "D", node + 4
    yield INSERT, "I", node - q + NEXT[q]


def _back(codes: bytes, node: int):
    """(cost, letter, node) of the edges into a node."""
    i, q = node >> 2, node & 3
    if i:
        code = codes[i - 1]
        base = node - 4 - q
        if not code & MUST_GO:
            more = TORN if code & TRUNCATED else 0
            for p in BEFORE_STEP[q][code & 3]:
                yield more, "K", base + p
            for p in BEFORE_NEXT[q]:
                yield RENAME + more, "R", base + p
        yield DELETE, "D", base + q
    for p in BEFORE_NEXT[q]:
        yield INSERT, "I", node - q + p


class _Side:
    """Labels and heap of one search; *sign* orders nodes of equal cost along its direction."""

    def __init__(self, size: int, starts: list[int], sign: int):
        self.cost = [FAR] * size
        self.via = [-1] * size
        self.letter = [""] * size
        self.depth = [0] * size
        self.settled = bytearray(size)
        self.sign = sign
        self.heap: list[tuple[int, int, int]] = []
        for node in starts:
            self.cost[node] = 0
            heappush(self.heap, (0, sign * (node >> 2), node))

    def top(self) -> int:
        """Least cost of what is not settled."""
        heap = self.heap
        while heap and (self.settled[heap[0][2]] or heap[0][0] > self.cost[heap[0][2]]):
            heappop(heap)
        return heap[0][0] if heap else FAR

    def settle(self) -> int:
        node = heappop(self.heap)[2]
        self.settled[node] = 1
        return node

    def label(self, node: int, cost: int, via: int, letter: str) -> None:
        if cost < self.cost[node]:
            heappush(self.heap, (cost, self.sign * (node >> 2), node))
            self.cost[node] = cost
        self.via[node], self.letter[node], self.depth[node] = via, letter, self.depth[via] + 1

    def path(self, node: int) -> list[str]:
        """Letters from *node* to where the search began."""
        out = []
        while self.via[node] >= 0:
            out.append(self.letter[node])
            node = self.via[node]
        return out


def _earlier(side: _Side, via: int, letter: str, node: int) -> bool:
    """Whether the path by *via* comes before the one that *node* has; both end in *node* at equal cost."""
    a, b = via, side.via[node]
    last_a, last_b = letter, side.letter[node]
    while a != b:
        if side.depth[a] >= side.depth[b]:
            a, last_a = side.via[a], side.letter[a]
        else:
            b, last_b = side.via[b], side.letter[b]
    return last_a < last_b


def search(codes: bytes, start: int, ends: tuple[int, ...]) -> tuple[int, str]:
    """(cost, letters) of the least path from state *start* before the first turn to one of *ends* after the last; of equal ones the ASCII-least."""
    last = len(codes) << 2
    size = last + 4
    goals = [last + q for q in ends]
    fore, rear = _Side(size, [start], 1), _Side(size, goals, -1)
    best = 0 if start in goals else FAR
    while True:
        a, b = fore.top(), rear.top()
        if a == b == FAR or a + b > best:
            break
        if a <= b:
            u = fore.settle()
            for w, letter, v in _onward(codes, u):
                cost = a + w
                if cost < fore.cost[v] or (cost == fore.cost[v] and not fore.settled[v] and v != start and _earlier(fore, u, letter, v)):
                    fore.label(v, cost, u, letter)
                if cost + rear.cost[v] < best:
                    best = cost + rear.cost[v]
        else:
            v = rear.settle()
            for w, letter, u in _back(codes, v):
                cost = b + w
                if cost < rear.cost[u] or (cost == rear.cost[u] and rear.via[u] >= 0 and not rear.settled[u] and letter < rear.letter[u]):
                    rear.label(u, cost, v, letter)
                if cost + fore.cost[u] < best:
                    best = cost + fore.cost[u]
    if best == FAR:
        return FAR, ""
    # Every least path leaves the forward side once: over an edge, or at its end.
    found = []
    for u in range(size):
        if not fore.settled[u] or fore.cost[u] > best:
            continue
        if u in goals and fore.cost[u] == best:
            found.append("".join(reversed(fore.path(u))))
        for w, letter, v in _onward(codes, u):
            if not fore.settled[v] and rear.settled[v] and fore.cost[u] + w + rear.cost[v] == best:
                found.append("".join(reversed(fore.path(u))) + letter + "".join(rear.path(v)))
    return best, min(found)


@lru_cache(maxsize=1 << 14)
def _remembered(codes: bytes) -> tuple[int, str]:
    return search(codes, 0, ENDS)


def least_edits(codes: bytes) -> tuple[int, str]:
    """(cost, audit) of a whole conversation; short ones are remembered."""
    return _remembered(codes) if len(codes) <= 64 else search(codes, 0, ENDS)


def ways(codes: bytes) -> list[tuple[int, int, int, str]]:
    """(state before, state after, cost, letters): the least path between each two states that a path joins."""
    out = []
    for p in STATES:
        for q in STATES:
            cost, letters = search(codes, p, (q,))
            if cost < FAR:
                out.append((p, q, cost, letters))
    return out


def joined(segments: list[list[tuple[int, int, int, str]]]) -> tuple[int, str]:
    """(cost, audit) of a conversation from the :func:`ways` of its consecutive segments.

    Goes from the last segment to the first with one rest for each state, so it
    holds a few times the audit.
    """
    rest: dict[int, tuple[int, str]] = {q: (0, "") for q in ENDS}
    for segment in reversed(segments):
        made: dict[int, tuple[int, str]] = {}
        for p, q, cost, letters in segment:
            if q in rest:
                total = cost + rest[q][0]
                if p not in made or total <= made[p][0]:
                    option = (total, letters + rest[q][1])
                    made[p] = min(made.get(p, option), option)
        rest = made
    return rest[0]


def given_roles(codes: bytes, audit: str) -> list[str | None]:
    """For each edit the role that it gives (R and I), or None (K and D)."""
    out: list[str | None] = []
    state = i = 0
    for letter in audit:
        if letter in "RI":
            state = NEXT[state]
            out.append("user" if state == 2 else "assistant")
        else:
            state = STEP[state][codes[i] & 3] if letter == "K" else state
            out.append(None)
        i += letter != "I"
    return out
