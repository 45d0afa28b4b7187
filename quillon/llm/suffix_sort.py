"""Deep-shallow sorting of fixed-width suffixes."""

from __future__ import annotations

import numpy as np

#: Bytes that multikey quicksort looks at, eight as one character; beyond, blind tries.
SHALLOW = 24


def words_at(flat: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Eight bytes from each start as a number that sorts like them; beyond ``width`` of eight they are zero."""
    got = np.zeros((len(starts), 8), np.uint8)
    got[:, :width] = np.lib.stride_tricks.sliding_window_view(flat, width)[starts]
    return got.view(">u8").ravel().astype(np.uint64)


class BlindTrie:
    """Strings of one width by the bytes at which they branch; the bytes between are compared only once a place is known."""

    def __init__(self, strings: list[bytes]):
        self.strings, self.root = strings, [0]  # a leaf lists the numbers of equal strings, an inner node is (depth, {byte: node})
        for k in range(1, len(strings)):
            self._insert(k)

    def _insert(self, k: int) -> None:
        s = self.strings[k]
        node = self.root
        while isinstance(node, tuple):  # blindly: any branch will do where none fits
            at, edges = node
            node = edges[s[at]] if s[at] in edges else next(iter(edges.values()))
        t = self.strings[node[0]]
        if s == t:
            node.append(k)
            return
        differ = int.from_bytes(s) ^ int.from_bytes(t)
        split = len(s) - (differ.bit_length() + 7) // 8  # the first byte that differs
        above, edge, node = None, None, self.root
        while isinstance(node, tuple) and node[0] < split:
            above, edge, node = node, s[node[0]], node[1][s[node[0]]]
        if isinstance(node, tuple) and node[0] == split:
            node[1][s[split]] = [k]
            return
        fork = (split, {t[split]: node, s[split]: [k]})
        if above is None:
            self.root = fork
        else:
            above[1][edge] = fork

    def order(self) -> list[list[int]]:
        """The strings in order, equal ones in one list."""
        out, todo = [], [self.root]
        while todo:
            node = todo.pop()
            if isinstance(node, tuple):
                todo += [node[1][b] for b in sorted(node[1], reverse=True)]
            else:
                out.append(node)
        return out


def multikey_quicksort(flat: np.ndarray, starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The order of the ``width``-byte strings at ``starts``, and for each place in it the place where its tie begins.

    Ternary: a group of strings that agree so far is parted into those whose
    next character is under, at and over a pivot, the median of three; those at
    it go on to the next character. Eight bytes are one character. All groups
    are parted at the same time, one step per round.
    """
    n = len(starts)
    order, head = np.arange(n), np.zeros(n, np.int64)
    place = np.arange(n) if n > 1 and width else np.zeros(0, np.int64)  # places in groups that are not done
    depth = np.zeros(len(place), np.int64)
    word = words_at(flat, starts, min(8, width)) if len(place) else np.zeros(0, np.uint64)
    while len(place):
        at = head[place]
        begin = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
        size = np.diff(np.append(begin, len(place)))
        a, b, c = word[begin], word[begin + size // 2], word[begin + size - 1]
        pivot = np.repeat(np.maximum(np.minimum(a, b), np.minimum(np.maximum(a, b), c)), size)
        under, level = word < pivot, word == pivot
        n_under, n_level = np.add.reduceat(under, begin, dtype=np.int64), np.add.reduceat(level, begin, dtype=np.int64)
        within = np.arange(len(place)) - np.repeat(begin, size)
        nth_under = np.cumsum(under) - np.repeat(np.cumsum(n_under) - n_under, size)
        nth_level = np.cumsum(level) - np.repeat(np.cumsum(n_level) - n_level, size)
        n_under, n_level = np.repeat(n_under, size), np.repeat(n_level, size)
        to = np.where(under, nth_under - 1, np.where(level, n_under + nth_level - 1, n_under + n_level + within - nth_under - nth_level))
        to += np.repeat(begin, size)
        order[place[to]] = order[place]
        head[place[to]] = at + np.where(under, 0, np.where(level, n_under, n_under + n_level))
        moved = np.empty_like(to)
        moved[to] = np.arange(len(to))
        word, depth, level = word[moved], depth[moved] + 8 * level[moved], level[moved]
        at = head[place]
        new = np.append(True, at[1:] != at[:-1])
        single = new & np.append(new[1:], True)
        on = ~single & (depth < width)
        place, depth, word, level = place[on], depth[on], word[on], level[on]
        for d in range(8, width, 8):
            mine = np.flatnonzero(level & (depth == d))
            if len(mine):
                word[mine] = words_at(flat, starts[order[place[mine]]] + d, min(8, width - d))
    return order, head


def deep_shallow(flat: np.ndarray, starts: np.ndarray, width: int, shallow: int = SHALLOW, body: bytes | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The order of the ``width``-byte strings at ``starts``, and for each place in it whether the string equals the one before.

    Multikey quicksort to ``shallow`` bytes; blind tries order what ties there.
    Whether neighbours are equal is read off that order alone. ``body`` is
    ``flat`` as bytes, where the caller has it.
    """
    n = len(starts)
    order, head = multikey_quicksort(flat, starts, min(shallow, width))
    same = np.append(False, head[1:] == head[:-1]) if n else np.zeros(0, bool)
    if width <= shallow or not same.any():
        return order, same
    body = flat.tobytes() if body is None else body
    begin = np.flatnonzero(~same)
    end = np.append(begin[1:], n)
    tied = end - begin > 1
    for a, b in zip(begin[tied].tolist(), end[tied].tolist()):
        mine = order[a:b]
        groups = BlindTrie([body[s + shallow : s + width] for s in starts[mine].tolist()]).order()
        same[a:b] = True
        if len(groups) == 1:
            same[a] = False
            continue
        order[a:b] = mine[[k for g in groups for k in g]]
        same[a + np.cumsum([0, *map(len, groups[:-1])])] = False
    return order, same
