"""A compressed radix (Patricia) trie over byte strings with spilling of subtrees."""

from __future__ import annotations

import pickle
import tempfile
from collections.abc import Iterator


class _Node:
    __slots__ = ("label", "children", "owner")

    def __init__(self, label: bytes, owner=None):
        self.label, self.owner = label, owner
        self.children: dict[int, _Node] = {}


def _common(a: bytes, b: bytes, start: int) -> int:
    """Length of the common prefix of ``a`` and of ``b`` from ``start`` on."""
    n = min(len(a), len(b) - start)
    if a[:n] == b[start : start + n]:
        return n
    low, high = 0, n
    while high - low > 1:  # a[:low] is equal, a[:high] is not
        middle = (low + high) // 2
        if a[:middle] == b[start : start + middle]:
            low = middle
        else:
            high = middle
    return low


class OwnerTrie:
    """Maps byte strings to owners, which ``merge(old, new)`` combines.

    ``insert`` walks the edges, compares whole labels and splits an edge at the first
    difference. Labels are the only place where the strings are kept. When they pass
    ``limit`` bytes, the subtrees below the root with most bytes move to temporary files
    of the task (one per first byte); strings that begin with the same byte follow them
    there, and ``items`` builds those subtries one after the other.
    """

    def __init__(self, merge, limit: int = 256 << 20, prefix: bytes = b""):
        self.merge, self.limit, self.prefix = merge, limit, prefix
        self.depth = len(prefix)  # all strings begin with ``prefix``
        self.root = _Node(b"")
        self.held: dict[int, int] = {}  # bytes of labels by the byte after the prefix
        self.total = 0
        self.spilled: dict[int, object] = {}

    def insert(self, key: bytes, owner) -> None:
        if len(key) > self.depth and key[self.depth] in self.spilled:
            pickle.dump((key, owner), self.spilled[key[self.depth]])
            return
        node, at = self.root, self.depth
        while True:
            if at == len(key):
                node.owner = owner if node.owner is None else self.merge(node.owner, owner)
                return
            child = node.children.get(key[at])
            if child is None:
                node.children[key[at]] = _Node(key[at:], owner)
                self._grow(key[self.depth], len(key) - at)
                return
            n = _common(child.label, key, at)
            if n < len(child.label):
                upper = _Node(child.label[:n])
                child.label = child.label[n:]
                upper.children[child.label[0]] = child
                node.children[upper.label[0]] = upper
                child = upper
            node, at = child, at + n

    def _grow(self, first: int, n: int) -> None:
        self.held[first] = self.held.get(first, 0) + n + 200
        self.total += n + 200
        while self.total > self.limit and len(self.held) > 0:
            largest = max(self.held, key=self.held.get)
            file = tempfile.TemporaryFile(prefix="subtrie-")
            for item in self._walk(self.root.children.pop(largest), self.prefix):
                pickle.dump(item, file)
            self.spilled[largest] = file
            self.total -= self.held.pop(largest)

    def _walk(self, top: _Node, prefix: bytes) -> Iterator[tuple[bytes, object]]:
        stack = [(top, prefix)]
        while stack:
            node, before = stack.pop()
            key = before + node.label
            if node.owner is not None:
                yield key, node.owner
            stack.extend((child, key) for child in node.children.values())

    def items(self) -> Iterator[tuple[bytes, object]]:
        """Every string with its owner; empties the trie."""
        yield from self._walk(self.root, self.prefix)
        self.root, self.held, self.total = _Node(b""), {}, 0
        while self.spilled:
            _, file = self.spilled.popitem()
            prefix = None
            for key, _ in _read(file):
                prefix = key if prefix is None else prefix[: _common(prefix, key, 0)]
            below = OwnerTrie(self.merge, self.limit, prefix)
            for key, owner in _read(file):
                below.insert(key, owner)
            file.close()
            yield from below.items()


def _read(file) -> Iterator[tuple[bytes, object]]:
    file.seek(0)
    while True:
        try:
            yield pickle.load(file)
        except EOFError:
            return
