"""BK-tree of fingerprints that finds the partners of a new member and verifies them."""

from __future__ import annotations

from collections.abc import Callable


class VerifiedTree:
    """Children are keyed by their integer Hamming distance to the parent. A new member follows only edges within the
    radius; what it meets there is verified unless both are already in one component, and a subtree that lies in the
    member's own component as a whole is skipped."""

    def __init__(self, radius: int, similar: Callable[[int, int], bool]) -> None:
        self.radius, self.similar = radius, similar
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []
        self.uniform: list[bool] = []  # all members of the subtree are in one component
        self.parent: list[int] = []
        self.links: list[tuple[int, int]] = []

    def find(self, i: int) -> int:
        while self.parent[i] != i:
            self.parent[i] = self.parent[self.parent[i]]
            i = self.parent[i]
        return i

    def add(self, value: int) -> None:
        new = len(self.values)
        self.values.append(value)
        self.children.append({})
        self.uniform.append(True)
        self.parent.append(new)
        if not new:
            return
        seen, stack = [], [0]
        while stack:
            node = stack.pop()
            if self.uniform[node] and self.find(node) == self.find(new):
                continue
            seen.append(node)
            d = (self.values[node] ^ value).bit_count()
            if d <= self.radius and self.find(node) != self.find(new) and self.similar(node, new):
                self.links.append((new, node))
                self.parent[max(self.find(node), self.find(new))] = min(self.find(node), self.find(new))
            stack += [c for e, c in self.children[node].items() if abs(e - d) <= self.radius]
        for node in reversed(seen):
            root = self.find(node)
            self.uniform[node] = all(self.uniform[c] and self.find(c) == root for c in self.children[node].values())
        node, path = 0, [0]
        while (d := (self.values[node] ^ value).bit_count()) in self.children[node]:
            node = self.children[node][d]
            path.append(node)
        self.children[node][d] = new
        for node in path:
            self.uniform[node] = self.uniform[node] and self.find(node) == self.find(new)
