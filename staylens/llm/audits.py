"""The cheapest edits that make a conversation's roles legal, first in ASCII order among equals.

Each row of a conversation is kept (K), reroled to user or assistant (R) or deleted (D), and empty
turns may be inserted anywhere (I); the role initials that result must read ``(s?(ua)+)?``.  The
programme runs over (rows done, state of that pattern).  Its cells hold a cost and the edits so
far, as a node of one tree: edits that begin alike share their nodes.  A node knows its ancestors at
distances 1, 2, 4, ... and a rolling hash of its edits.  Where two ways to a cell cost the same,
the one whose edits come first wins: the longest common prefix is searched by binary lifting on the
hashes, and the next edit decides.  Equal edits are one node, so an equal hash at different nodes is a
collision; then the edits themselves are compared.

After a row's own edit the edits of two states of the same rows never begin one another: both end
in K, R or D and hold equally many of these.  So comparing them at any later time gives
the same order, and a long conversation may be cut into segments: ``segment_costs`` gives a segment's costs from
every state to every state with the order of the edits, ``choose_path`` puts the segments together.
"""

from __future__ import annotations

from functools import cmp_to_key

# States of the pattern (s?(ua)+)? after the initials so far.
EMPTY, SYSTEM, USER, ASSISTANT = range(4)
STATES = 4
#: Costs of the edits, and of a truncated row that is not deleted.
COST = {"K": 0, "R": 1, "D": 2, "I": 5}
TRUNCATED_COST = 5

#: Symbols of rows: 2 * (0 to 3 for a role that begins with s, u, a or otherwise) + truncated; or to be deleted.
INITIALS = {"s": 0, "u": 1, "a": 2}
OTHER, DELETE = 3, 8


def symbol(initial: str, must_go: bool, truncated: bool) -> int:
    return DELETE if must_go else 2 * INITIALS.get(initial, OTHER) + truncated


def turn_after(state: int) -> tuple[str, int]:
    """The role that is due after a state, and the state after it."""
    return ("assistant", ASSISTANT) if state == USER else ("user", USER)


def _inserts(state: int):
    """(state, edits) reached by insertions, each state by the fewest."""
    seen, edits = {state: ""}, ""
    at = state
    for _ in range(2):
        at, edits = turn_after(at)[1], edits + "I"
        seen.setdefault(at, edits)
    return seen.items()


def _moves(sym: int, state: int) -> list[tuple[int, int, str]]:
    """(new state, cost, edits) of the best edits of one row by the new state."""
    best: dict[int, tuple[int, str]] = {}
    for at, before in _inserts(state):
        ways = [("D", at, COST["D"])]
        if sym != DELETE:
            kind, more = sym // 2, TRUNCATED_COST * (sym % 2)
            role, after = turn_after(at)
            ways.append(("R", after, COST["R"] + more))
            if kind == INITIALS["s"] and at == EMPTY:
                ways.append(("K", SYSTEM, more))
            elif kind == INITIALS[role[0]]:
                ways.append(("K", after, more))
        for edit, after, cost in ways:
            way = (cost + COST["I"] * len(before), before + edit)
            best[after] = min(best.get(after, way), way)
    return [(after, *way) for after, way in best.items()]


MOVES = [[_moves(sym, q) for q in range(STATES)] for sym in range(DELETE + 1)]
#: Insertions that end a conversation in each state.
ENDING = {EMPTY: "", SYSTEM: "II", USER: "I", ASSISTANT: ""}


class EditTree:
    """Edit sequences as nodes of a tree: node 0 has none, every other one its parent's and one more."""

    def __init__(self, modulus: int = (1 << 61) - 1):
        self.modulus = modulus
        self.edit, self.depth, self.hash = [""], [0], [0]
        self.up: list[list[int]] = [[]]  # up[x][k]: the ancestor 2**k above x
        self.child: dict[tuple[int, str], int] = {}

    def add(self, parent: int, edit: str) -> int:
        node = self.child.get((parent, edit))
        if node is not None:
            return node
        node = self.child[parent, edit] = len(self.edit)
        self.edit.append(edit)
        self.depth.append(self.depth[parent] + 1)
        self.hash.append((self.hash[parent] * 1_000_003 + ord(edit)) % self.modulus)
        lifts, k = [parent], 0
        while k < len(self.up[lifts[k]]):
            lifts.append(self.up[lifts[k]][k])
            k += 1
        self.up.append(lifts)
        return node

    def extend(self, node: int, edits: str) -> int:
        for e in edits:
            node = self.add(node, e)
        return node

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.edit[node])
            node = self.up[node][0]
        return "".join(reversed(out))

    def ancestor(self, node: int, depth: int) -> int:
        gap = self.depth[node] - depth
        while gap:
            k = gap.bit_length() - 1
            node = self.up[node][k]
            gap -= 1 << k
        return node

    def less(self, x: int, y: int) -> bool:
        """Whether the edits of ``x`` come before those of ``y`` in ASCII order."""
        short = min(self.depth[x], self.depth[y])
        a, b = self.ancestor(x, short), self.ancestor(y, short)
        if a == b:
            return self.depth[x] < self.depth[y]
        up, hashes = self.up, self.hash
        if hashes[a] == hashes[b]:
            return self.text(x) < self.text(y)  # a collision: equal edits would be one node
        for k in range(len(up[a]) - 1, -1, -1):
            if k < len(up[a]) and hashes[up[a][k]] != hashes[up[b][k]]:
                a, b = up[a][k], up[b][k]
        if up[a][0] != up[b][0]:
            return self.text(x) < self.text(y)  # a collision above the first difference
        return self.edit[a] < self.edit[b]


def run(tree: EditTree, symbols: bytes, start: int) -> list[tuple[int, int] | None]:
    """(cost, node) of the best edits of the rows from ``start`` to every state, None where there are none."""
    cells: list[tuple[int, int] | None] = [None] * STATES
    cells[start] = (0, 0)
    for sym in symbols:
        moves = MOVES[sym]
        best: list = [None] * STATES
        for q, cell in enumerate(cells):
            if cell is None:
                continue
            cost, node = cell
            for after, more, edits in moves[q]:
                old, total = best[after], cost + more
                if old is not None and total >= old[0]:
                    if total > old[0]:
                        continue
                    # Two ways from one state differ in this row's edits, others in an earlier edit.
                    if not (edits < old[2] if old[1] == node else tree.less(node, old[1])):
                        continue
                best[after] = (total, node, edits)
        cells = [None if b is None else (b[0], tree.extend(b[1], b[2])) for b in best]
    return cells


def repair(symbols: bytes, tree: EditTree | None = None) -> tuple[int, str]:
    """(cost, edits) of a whole conversation."""
    tree = tree or EditTree()
    best = None
    for q, cell in enumerate(run(tree, symbols, EMPTY)):
        if cell is None:
            continue
        total, node = cell[0] + COST["I"] * len(ENDING[q]), cell[1]
        if best is None or total < best[0] or (total == best[0] and tree.less(node, best[1])):
            best = (total, node, ENDING[q])
    return best[0], tree.text(best[1]) + best[2]


def segment_costs(symbols: bytes) -> tuple[list[int], list[int]]:
    """Costs from each state to each state (-1: none) and the order of the edits among those from one state."""
    tree, costs, order = EditTree(), [], []
    for start in range(STATES):
        cells = run(tree, symbols, start)
        nodes = sorted({c[1] for c in cells if c}, key=cmp_to_key(lambda x, y: -1 if tree.less(x, y) else 1))
        costs += [-1 if c is None else c[0] for c in cells]
        order += [-1 if c is None else nodes.index(c[1]) for c in cells]
    return costs, order


def segment_edits(symbols: bytes, start: int, end: int) -> str:
    tree = EditTree()
    return tree.text(run(tree, symbols, start)[end][1])


def choose_path(segments: list[tuple[list[int], list[int]]]) -> list[int]:
    """States at the borders of a conversation's segments (one more than segments), for its best edits."""
    at = {EMPTY: (0, 0)}  # state -> (cost, place of its edits in the order)
    came = []
    for costs, order in segments:
        ways = {}
        for r in range(STATES):
            found = [(c + costs[STATES * q + r], place, order[STATES * q + r], q)
                     for q, (c, place) in at.items() if costs[STATES * q + r] >= 0]
            if found:
                ways[r] = min(found)
        places = {key: i for i, key in enumerate(sorted({w[1:3] for w in ways.values()}))}
        at = {r: (w[0], places[w[1:3]]) for r, w in ways.items()}
        came.append({r: w[3] for r, w in ways.items()})
    path = [min(at, key=lambda q: (at[q][0] + COST["I"] * len(ENDING[q]), at[q][1]))]
    for back in reversed(came):
        path.append(back[path[-1]])
    return path[::-1]
