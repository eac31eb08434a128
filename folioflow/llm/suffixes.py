"""Deep-shallow sorting of byte strings that were cut out around equal passages."""

from __future__ import annotations


def multikey_quicksort(words, groups, depth: int):
    """Order of the rows of `words` (rows x words) within `groups`, by their first `depth`
    words, and the number of the set of rows that are equal so far.

    All sets are parted at once: each takes the current word of its middle row as pivot; rows
    below, equal and above go to three sets, and the equal ones move on to the next word.
    """
    import numpy as np

    n = len(groups)
    order = np.argsort(groups, kind="stable")
    segment = np.cumsum(np.r_[0, np.diff(groups[order]) != 0])
    at = np.zeros(n, dtype=np.int64)  # current word, the same for all rows of a set
    while n:
        starts = np.flatnonzero(np.r_[True, np.diff(segment) != 0])
        sizes = np.diff(np.r_[starts, n])
        going = ((sizes > 1) & (at[starts] < depth))[segment]
        if not going.any():
            break
        word = words[order, np.minimum(at, depth - 1)]
        pivot = word[starts + sizes // 2][segment]
        side = np.where(going, np.sign((word > pivot).astype(np.int8) - (word < pivot)), 0)
        moved = np.argsort(segment * 3 + side + 1, kind="stable")
        order, at = order[moved], np.where(going & (side == 0), at + 1, at)[moved]
        key = (segment * 3 + side + 1)[moved]
        segment = np.cumsum(np.r_[0, np.diff(key) != 0])
    return order, segment


def blind_trie(strings: list[bytes]) -> list[int]:
    """Order of distinct or equal strings of one length.

    Inner nodes hold only the place where the strings below part, and a child for each byte
    there. A string first goes down blindly, by the bytes at those places alone; one comparison
    with the leaf it meets tells where it really parts.
    """
    size = len(strings[0])
    numbers = [int.from_bytes(s, "big") for s in strings]
    root: list = [size, [0]]  # [place, children by byte], or [size, rows of equal strings]

    def common(a: int, b: int) -> int:
        return size - (((numbers[a] ^ numbers[b]).bit_length() + 7) >> 3)

    for row in range(1, len(strings)):
        string, node = strings[row], root
        while node[0] < size:
            children = node[1]
            node = children.get(string[node[0]]) or next(iter(children.values()))
        leaf = node[1][0]
        parts = common(row, leaf)
        if parts == size:
            node[1].append(row)
            continue
        node, above, byte = root, None, 0
        while node[0] < parts:
            byte = string[node[0]]
            above, node = node, node[1][byte]
        new = [size, [row]]
        if node[0] == parts and node[0] < size:
            node[1][string[parts]] = new
            continue
        branch = [parts, {strings[leaf][parts]: node, string[parts]: new}]
        if above is None:
            root = branch
        else:
            above[1][byte] = branch
    order, stack = [], [root]
    while stack:
        place, below = stack.pop()
        if place == size:
            order += below
        else:
            stack += [below[byte] for byte in sorted(below, reverse=True)]
    return order


def deep_shallow(rows, groups, shallow: int = 3):
    """Order of the rows (rows x bytes) within groups, and each row's common prefix with the
    row before it in that order (0 where a group begins)."""
    import numpy as np

    n, width = rows.shape
    padded = np.zeros((n, -(-width // 8) * 8), dtype=np.uint8)
    padded[:, :width] = rows
    words = padded.view(">u8").astype(np.uint64)
    order, segment = multikey_quicksort(words, groups, min(shallow, words.shape[1]))
    starts = np.flatnonzero(np.r_[True, np.diff(segment) != 0])
    for begin, end in zip(starts.tolist(), [*starts[1:].tolist(), n]):
        if end - begin > 1:
            members = order[begin:end]
            order[begin:end] = members[blind_trie([rows[i].tobytes() for i in members])]
    common = np.zeros(n, dtype=np.int64)
    if n > 1:
        differ = rows[order[1:]] != rows[order[:-1]]
        common[1:] = np.where(differ.any(axis=1), differ.argmax(axis=1), width)
        common[1:][np.diff(groups[order]) != 0] = 0
    return order, common
