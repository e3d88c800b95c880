"""An adaptive radix tree over byte strings: nodes of 4, 16, 48 or 256 places, with compressed paths."""

from __future__ import annotations

from collections.abc import Iterator

#: Places of a node's layouts.  Up to 16, labels are searched; with 48, a table of 256 bytes names the place; with 256, the byte is the place.
LAYOUTS = (4, 16, 48, 256)


class Node:
    """``path`` is what all keys below share after the label that leads here; ``value`` belongs to the key that ends here."""

    __slots__ = ("path", "value", "places", "labels", "slots")

    def __init__(self, path: bytes, value=None):
        self.path, self.value = path, value
        self.places = LAYOUTS[0]
        self.labels: bytearray | None = bytearray()
        self.slots: list = []

    def child(self, label: int) -> Node | None:
        if self.places <= 16:
            at = self.labels.find(label)
            return self.slots[at] if at >= 0 else None
        if self.places == 48:
            at = self.labels[label]
            return self.slots[at - 1] if at else None
        return self.slots[label]

    def add(self, label: int, node: Node) -> None:
        """A new child, or another one in the place of the child with this label; a full node takes the next layout."""
        if self.places <= 16:
            at = self.labels.find(label)
            if at >= 0:
                self.slots[at] = node
                return
            if len(self.slots) < self.places:
                at = sum(x < label for x in self.labels)
                self.labels.insert(at, label)
                self.slots.insert(at, node)
                return
        elif self.places == 48:
            at = self.labels[label]
            if at:
                self.slots[at - 1] = node
                return
            if len(self.slots) < 48:
                self.slots.append(node)
                self.labels[label] = len(self.slots)
                return
        else:
            self.slots[label] = node
            return
        self._grow()
        self.add(label, node)

    def _grow(self) -> None:
        if self.places == 4:
            self.places = 16
        elif self.places == 16:
            table = bytearray(256)
            for at, label in enumerate(self.labels, 1):
                table[label] = at
            self.places, self.labels = 48, table
        else:
            slots = [None] * 256
            for label, at in enumerate(self.labels):
                if at:
                    slots[label] = self.slots[at - 1]
            self.places, self.labels, self.slots = 256, None, slots

    def children(self) -> list[Node]:
        """Children by rising label."""
        if self.places <= 16:
            return self.slots
        if self.places == 48:
            return [self.slots[at - 1] for at in self.labels if at]
        return [node for node in self.slots if node is not None]


def shared(a: bytes, b: bytes) -> int:
    """Length of the common beginning of two byte strings."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differing = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differing.bit_length() + 7) // 8


class RadixTree:
    """Keys with values; the root's path is always empty."""

    def __init__(self):
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        """Put ``value`` (not None) at ``key``; a value that is there already is replaced."""
        node, at = self.root, 0
        while at < len(key):
            label = key[at]
            below = node.child(label)
            at += 1
            if below is None:
                node.add(label, Node(key[at:], value))
                return
            path = below.path
            if not key.startswith(path, at):
                n = shared(path, key[at : at + len(path)])
                fork = Node(path[:n])
                below.path = path[n + 1 :]
                fork.add(path[n], below)
                node.add(label, fork)
                below = fork
            at += len(below.path)
            node = below
        node.value = value

    def bottom_up(self) -> Iterator[tuple[Node, int, int, bool, bool]]:
        """``(node, where its edge begins, where it ends, leads to the first key, leads to the last key)``, children before parents.

        An edge is the label and the path that lead to a node.  No recursion, so that keys may be long.
        """
        stack = [(self.root, 0, 0, True, True, False)]
        while stack:
            node, begin, end, first, last, done = stack.pop()
            if done:
                yield node, begin, end, first, last
                continue
            stack.append((node, begin, end, first, last, True))
            below = node.children()
            if not below:
                continue
            first &= node.value is None  # a key that ends here comes before all that go on
            top = len(below) - 1
            for i in range(top, -1, -1):
                child = below[i]
                stack.append((child, end, end + 1 + len(child.path), first and i == 0, last and i == top, False))
