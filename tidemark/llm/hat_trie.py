"""A trie over word ids whose leaves are hash containers that burst.

The first words of a phrase lead through a shallow trie of dictionaries; the rest of it is a key in the
container at the end of that path. A container with more than ``burst`` keys becomes a node, and its
keys move one word down. When the trie holds more than ``limit`` keys, whole subtrees leave it as
sorted runs.
"""

from __future__ import annotations

from collections.abc import Iterator

Ids = tuple[int, ...]


class Container(dict):
    """Rest of the phrase -> count."""


class Node(dict):
    """Word id -> subtree; ``here`` counts the phrase that ends at this node."""

    here = 0


class HatTrie:
    def __init__(self, burst: int = 4_096, limit: int = 400_000):
        self.burst, self.limit = burst, limit
        self.root, self.size = Node(), 0

    def add(self, phrase: Ids, n: int) -> None:
        """Count a phrase of one id or more."""
        node, depth = self.root, 0
        while True:
            below = node.get(phrase[depth])
            if below is None:
                below = node[phrase[depth]] = Container()
            depth += 1
            if isinstance(below, Container):
                break
            if depth == len(phrase):
                self.size += not below.here
                below.here += n
                return
            node = below
        rest = phrase[depth:]
        had = below.get(rest)
        below[rest] = n + (had or 0)
        if had is None:
            self.size += 1
            if len(below) > self.burst:
                node[phrase[depth - 1]] = self._burst(below)

    @staticmethod
    def _burst(full: Container) -> Node:
        node = Node()
        for rest, n in full.items():
            if rest:
                node.setdefault(rest[0], Container())[rest[1:]] = n
            else:
                node.here = n
        return node

    def full(self) -> bool:
        return self.size > self.limit

    def spill(self) -> Iterator[tuple[int, list[tuple[Ids, int]]]]:
        """(first id, phrases and counts under it) of every subtree, which thereby leaves the trie."""
        while self.root:
            first, subtree = self.root.popitem()
            yield first, list(_under(subtree, (first,)))
        self.size = 0


def _under(tree: Container | Node, path: Ids) -> Iterator[tuple[Ids, int]]:
    if isinstance(tree, Container):
        for rest, n in tree.items():
            yield path + rest, n
        return
    if tree.here:
        yield path, tree.here
    for word, below in tree.items():
        yield from _under(below, (*path, word))
