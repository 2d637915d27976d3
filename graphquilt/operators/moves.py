"""Moves of nodes between communities inside one task, over arrays.

The links of a block are arrays of ends and weights, its nodes carry a community
and a strength.  All members of a community are in the block, so every gain is
exact.  Nodes move in small lots, each lot seeing what the lots before it did; of
a lot that would not raise the objective as a whole, those that gain most move.
Lower levels are left when few nodes move; the last pass over the nodes of the
block ends when none of them gains by a move.
"""

from __future__ import annotations

import numpy as np

#: A gain relative to a node's strength below which it does not move.
GAIN = 1e-12
#: Lots of a pass; nodes of one lot do not see each other's moves.
LOTS = 32
#: Pulls of nodes are summed in a table where it has at most so many fields a link, else sorted.
DENSE = 4
#: Levels that are moved again later are left when a pass moves one node of so many.
FEW = 1000


class Block:
    """Links ``x, y, w`` between nodes 0 to n - 1 of strength ``k``; ``share`` is the resolution over all strength."""

    def __init__(self, x: np.ndarray, y: np.ndarray, w: np.ndarray, k: np.ndarray, share: float) -> None:
        self.n, self.x, self.y, self.w, self.k, self.share = len(k), x, y, w, k, share
        src = np.concatenate([x, y])
        order = np.argsort(src, kind="stable")
        self.start = np.zeros(self.n + 1, np.int64)
        np.cumsum(np.bincount(src, minlength=self.n), out=self.start[1:])
        self.dst = np.concatenate([y, x])[order]
        self.weight = np.concatenate([w, w])[order]

    def edges(self, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the edges of ``nodes`` and for each the place of its node among them."""
        many = self.start[nodes + 1] - self.start[nodes]
        row = np.repeat(np.arange(len(nodes)), many)
        return np.arange(len(row)) + np.repeat(self.start[nodes] - np.cumsum(many) + many, many), row

    def better(self, nodes: np.ndarray, at: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Those of ``nodes`` that gain by a move, where each gains most (the least such community) and how much."""
        pos, row = self.edges(nodes)
        if not len(pos):
            return nodes[:0], nodes[:0], self.k[:0]
        n = len(mass)
        key = row * n + at[self.dst[pos]]
        if len(nodes) * n <= DENSE * len(pos):
            pull = np.bincount(key, weights=self.weight[pos])
            key = np.flatnonzero(pull)
            pull = pull[key]
        else:
            if len(nodes) * n < 2**62 // len(pos):
                # numbers sort faster than places do, so each carries its place
                key, order = np.divmod(np.sort(key * len(pos) + np.arange(len(pos))), len(pos))
            else:
                order = np.argsort(key)
                key = key[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            pull = np.add.reduceat(self.weight[pos[order]], first)
            key = key[first]
        row, c = np.divmod(key, n)
        k, here = self.k[nodes], at[nodes]
        own = c == here[row]
        stay = np.zeros(len(nodes))
        stay[row[own]] = pull[own]
        stay -= self.share * k * (mass[here] - k)
        gain = np.where(own, -np.inf, pull - self.share * k[row] * mass[c])
        head = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
        best = np.maximum.reduceat(gain, head)
        to = np.minimum.reduceat(np.where(gain == np.repeat(best, np.diff(np.append(head, len(gain)))), c, n), head)
        who = row[head]
        more = best - stay[who]
        moves = more > GAIN * k[who]
        return nodes[who[moves]], to[moves], more[moves]

    def rise(self, who: np.ndarray, to: np.ndarray, at: np.ndarray, mass: np.ndarray) -> float:
        """What the objective gains when all of ``who`` move at once."""
        pos, row = self.edges(who)
        near, old = self.dst[pos], at[who]
        now = at.copy()
        now[who] = to
        # a link between two of them comes from both its ends
        times = np.where(now[near] != at[near], 1.0, 2.0)
        links = (self.weight[pos] * times * ((to[row] == now[near]) * 1.0 - (old[row] == at[near]))).sum()
        c, place = np.unique(np.concatenate([old, to]), return_inverse=True)
        d = np.bincount(place, weights=np.concatenate([-self.k[who], self.k[who]]))
        return links - self.share * (d * (2.0 * mass[c] + d)).sum()

    def settle(self, at: np.ndarray, exact: bool = True) -> tuple[np.ndarray, bool]:
        """Communities when no node gains by a move (unless ``exact``, only few do), and whether any moved."""
        name, moved = np.arange(self.n), False
        mass = np.bincount(at, weights=self.k, minlength=self.n)
        active = np.arange(self.n)
        while True:
            # communities are numbered anew, in order, as many of them have emptied
            left, at = np.unique(at, return_inverse=True)
            name, mass = name[left], mass[left]
            whole, many = len(active) == self.n, 0
            touched = np.zeros(self.n, bool)
            for lot in np.array_split(active, LOTS):
                who, to, more = self.better(lot, at, mass)
                if not len(who):
                    continue
                order = np.argsort(-more, kind="stable")
                # where all together do not gain, those that gain most go first; one alone always does
                while len(order) > 1 and self.rise(who[order], to[order], at, mass) <= GAIN * self.k[who[order]].sum():
                    order = order[: len(order) // 2]
                touched[who] = True
                who, to = who[order], to[order]
                np.subtract.at(mass, at[who], self.k[who])
                np.add.at(mass, to, self.k[who])
                at[who] = to
                many += len(who)
                touched[self.dst[self.edges(who)[0]]] = True
            moved = moved or many > 0
            if many > (0 if exact else self.n // FEW):
                active = np.flatnonzero(touched)
            elif whole or not exact:
                return name[at], moved
            else:
                active = np.arange(self.n)


def fold(b: Block, at: np.ndarray) -> tuple[Block, np.ndarray]:
    """Communities as nodes and the place of each old node among them; links inside stay in the strength."""
    _, place = np.unique(at, return_inverse=True)
    k = np.bincount(place, weights=b.k)
    x, y = place[b.x], place[b.y]
    out = x != y
    key, where = np.unique(np.minimum(x, y)[out] * len(k) + np.maximum(x, y)[out], return_inverse=True)
    w = np.bincount(where, weights=b.w[out], minlength=len(key))
    return Block(key // len(k), key % len(k), w, k, b.share), place


def by_levels(b: Block) -> np.ndarray:
    """Communities of all nodes, level by level until none moves."""
    label = np.arange(b.n)
    while True:
        at, moved = b.settle(np.arange(b.n), exact=False)
        if not moved:
            return label
        b, place = fold(b, at)
        label = place[label]


def connected(b: Block, at: np.ndarray) -> np.ndarray:
    """Communities split into the parts their inner links connect, each named by its least node."""
    inside = at[b.x] == at[b.y]
    x, y, part = b.x[inside], b.y[inside], np.arange(b.n)
    while len(x):
        lo, hi = np.minimum(part[x], part[y]), np.maximum(part[x], part[y])
        np.minimum.at(part, hi, lo)
        while (part[part] != part).any():
            part = part[part]
        apart = part[x] != part[y]
        x, y = x[apart], y[apart]
    return part


def refined(b: Block, _: np.ndarray | None = None) -> np.ndarray:
    """Connected communities of all nodes: level by level from single nodes, then again from the nodes, until none gains by a move."""
    at = connected(b, by_levels(b))
    while True:
        at, moved = b.settle(at)
        part = connected(b, at)
        if not moved and len(np.unique(part)) == len(np.unique(at)):
            return part
        up, place = fold(b, part)
        at = connected(b, by_levels(up)[place])
