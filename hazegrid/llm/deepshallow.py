"""Deep-shallow suffix sorting of byte strings.

Multikey quicksort orders the strings by 8-byte words down to a shallow depth. What still agrees there usually goes on
agreeing for long, so each such group is ordered by a blind trie, which looks only at the bytes where members differ.
"""

from __future__ import annotations

WORD = 8


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x, y = a[:n], b[:n]
    if x == y:
        return n
    differ = int.from_bytes(x, "big") ^ int.from_bytes(y, "big")
    return n - (differ.bit_length() + 7) // 8


class BlindTrie:
    """Patricia trie of strings that share their first ``depth`` bytes. An inner node is [position, {byte: child}]."""

    def __init__(self, strings: list[bytes]):
        self.strings = strings
        self.root: list | None = None

    def add(self, i: int) -> None:
        s = self.strings[i]
        if self.root is None:
            self.root = [-1, [i]]
            return
        node = self.root
        while node[0] >= 0:  # blind: only the branching bytes are read
            at = node[0]
            child = node[1].get(s[at] if at < len(s) else -1)
            node = child if child is not None else next(iter(node[1].values()))
        other = self.strings[node[1][0]]
        shared = common_prefix(s, other)
        if shared == len(s) == len(other):
            node[1].append(i)
            return
        parent, key, node = None, None, self.root
        while 0 <= node[0] < shared:
            parent, key = node, s[node[0]] if node[0] < len(s) else -1
            node = node[1][key]
        mine = s[shared] if shared < len(s) else -1
        if node[0] == shared:
            node[1][mine] = [-1, [i]]
            return
        theirs = other[shared] if shared < len(other) else -1
        split = [shared, {theirs: node, mine: [-1, [i]]}]
        if parent is None:
            self.root = split
        else:
            parent[1][key] = split

    def walk(self, order: list[int], lcp: list[int], before: int) -> None:
        """Append the members in order; ``lcp`` gets what each shares with the one before, ``before`` for the first."""
        stack = [(self.root, before)]
        while stack:
            node, shared = stack.pop()
            if node[0] < 0:
                order += node[1]
                lcp += [shared] + [len(self.strings[node[1][0]])] * (len(node[1]) - 1)
            else:
                keys = sorted(node[1])
                stack += [(node[1][k], node[0]) for k in reversed(keys[1:])]
                stack.append((node[1][keys[0]], shared))


def sort_strings(strings: list[bytes], shallow: int = 2) -> tuple[list[int], list[int]]:
    """(order, lcp): indexes in ascending order and the prefix that each shares with the one before (0 for the first).

    ``shallow`` is the depth of the quicksort in words.
    """
    words: dict[int, list[int]] = {}

    def word(depth: int) -> list[int]:
        if depth not in words:
            lo, hi = depth * WORD, depth * WORD + WORD
            words[depth] = [int.from_bytes(s[lo:hi].ljust(WORD, b"\0"), "big") for s in strings]
        return words[depth]

    order: list[int] = []
    lcp: list[int] = []
    stack = [(list(range(len(strings))), 0)]
    while stack:
        group, depth = stack.pop()
        if not group:
            continue
        if len(group) == 1 or depth == shallow:
            shared = common_prefix(strings[order[-1]], strings[group[0]]) if order else 0
            if len(group) == 1:
                order.append(group[0])
                lcp.append(shared)
                continue
            trie = BlindTrie(strings)
            for i in group:
                trie.add(i)
            at = len(order)
            trie.walk(order, lcp, 0)
            lcp[at] = common_prefix(strings[order[at - 1]], strings[order[at]]) if at else 0
            continue
        key = word(depth)
        pivot = sorted((key[group[0]], key[group[len(group) // 2]], key[group[-1]]))[1]
        less = [i for i in group if key[i] < pivot]
        more = [i for i in group if key[i] > pivot]
        equal = [i for i in group if key[i] == pivot] if len(less) + len(more) < len(group) else []
        stack += [(more, depth), (equal, depth + 1), (less, depth)]
    return order, lcp
