"""Online hierarchical clustering of vectors with insertion, rotation, grafting, deletion and flat cuts.

State of one driver (or one key of a stateful stream): it holds distinct signatures, not entities.
"""

from __future__ import annotations

import numpy as np


class Node:
    __slots__ = ("children", "label", "n", "parent", "total")

    def __init__(self, total: np.ndarray, n: int, label=None):
        self.total, self.n, self.label = total, n, label
        self.parent: Node | None = None
        self.children: list[Node] = []

    @property
    def centre(self) -> np.ndarray:
        size = np.linalg.norm(self.total)
        return self.total / size if size else self.total


def similarity(a: Node, b: Node) -> float:
    """Cosine of the two sums."""
    return float(a.centre @ b.centre)


class Tree:
    def __init__(self, rotations: int = 100, grafts: int = 100):
        self.root: Node | None = None
        self.leaves: dict = {}
        self.rotations, self.grafts = rotations, grafts

    def _add(self, node: Node | None, sign: int, other: Node) -> None:
        while node:
            node.total = node.total + sign * other.total
            node.n += sign * other.n
            node = node.parent

    def _join(self, place: Node, node: Node) -> Node:
        """Puts node beside place, below a new parent of both."""
        up = Node(place.total.copy(), place.n)
        up.parent = place.parent
        if up.parent:
            up.parent.children[up.parent.children.index(place)] = up
        else:
            self.root = up
        up.children = [place, node]
        place.parent = node.parent = up
        self._add(up, 1, node)
        return up

    def _cut(self, node: Node) -> None:
        """Takes node out; its sibling moves into the parent's place."""
        up = node.parent
        if up is None:
            self.root = None
            return
        self._add(up, -1, node)
        sibling = next(c for c in up.children if c is not node)
        sibling.parent = up.parent
        if up.parent:
            up.parent.children[up.parent.children.index(up)] = sibling
        else:
            self.root = sibling
        node.parent = None

    def _nearest(self, node: Node, among) -> Node | None:
        others = [x for x in among if x is not node]
        return max(others, key=lambda x: (similarity(x, node), str(x.label)), default=None)

    def insert(self, label, vector: np.ndarray) -> None:
        if label in self.leaves:
            self.delete(label)
        leaf = Node(np.asarray(vector, float), 1, label)
        beside = self._nearest(leaf, self.leaves.values())
        self.leaves[label] = leaf
        if beside is None:
            self.root = leaf
            return
        # rotate: the leaf moves up while the place's sibling is nearer to the place than the leaf is
        for _ in range(self.rotations):
            up = beside.parent
            if up is None or similarity(beside, leaf) >= similarity(beside, next(c for c in up.children if c is not beside)):
                break
            beside = up
        self._graft(self._join(beside, leaf))

    def _graft(self, node: Node | None) -> None:
        """Moves a leaf elsewhere below node's ancestors if it and node prefer each other to their siblings."""
        for _ in range(self.grafts):
            if node is None or node.parent is None:
                return
            below = set(map(id, self._below(node)))
            other = self._nearest(node, [x for x in self.leaves.values() if id(x) not in below])
            if other is not None and other.parent is not None and node.parent is not other.parent:
                sibling = lambda x: next(c for c in x.parent.children if c is not x)
                if similarity(node, other) > max(similarity(node, sibling(node)), similarity(other, sibling(other))):
                    self._cut(other)
                    node = self._join(node, other)
                    continue
            node = node.parent

    def _below(self, node: Node) -> list[Node]:
        out, todo = [], [node]
        while todo:
            x = todo.pop()
            out += [x] if not x.children else []
            todo += x.children
        return out

    def delete(self, label) -> None:
        self._cut(self.leaves.pop(label))

    def flat(self, least: float) -> dict:
        """Labels to cluster numbers: going down, a node is a cluster once its children are at least so similar, or it is a leaf."""
        out: dict = {}
        todo = [self.root] if self.root else []
        k = 0
        while todo:
            x = todo.pop()
            if x.children and similarity(*x.children) < least:
                todo += x.children
            else:
                out |= {leaf.label: k for leaf in self._below(x)}
                k += 1
        return out

    def rows(self) -> list[tuple[int, int | None, object]]:
        """(node, parent, label) of all nodes, parents first."""
        out, todo = [], [(self.root, None)] if self.root else []
        while todo:
            x, up = todo.pop()
            me = len(out)
            out.append((me, up, x.label))
            todo += [(c, me) for c in x.children]
        return out
