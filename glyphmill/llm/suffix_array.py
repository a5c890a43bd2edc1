"""Suffix arrays in linear time by grouping suffixes by their Lyndon prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(s: list[int]) -> list[int]:
    """Positions of ``s`` in the order of the suffixes that start there; a proper prefix comes first.

    Grouping: suffixes start in groups by first symbol, each known to begin with one Lyndon word.
    The highest group not yet done, of word u, is taken. For each of its positions the previous
    smaller position is the nearest one to the left in a lower group, found by following the
    pointers of what lies between. A position that is so pointed at c times is followed by c copies
    of u, so its own word v grows to v u^c and it moves to a new group right above its old one; more
    copies make a higher group. When all groups are done, they are in the order of the longest
    Lyndon words that start their suffixes.

    Order inside groups: two suffixes with one such word compare as what follows it. So positions
    are emitted in ascending order: the end first, and each emitted position puts those whose word
    ends there at the next free place of their groups.
    """
    n = len(s)
    if n == 0:
        return []
    first: dict[int, list[int]] = {}
    for i, c in enumerate(s):
        first.setdefault(c, []).append(i)
    members = [first[c] for c in sorted(first)]
    below = list(range(-1, len(members) - 1))
    above = [*range(1, len(members)), -1]
    group = [0] * n
    for g, at in enumerate(members):
        for i in at:
            group[i] = g
    length = [1] * n
    prev = [-1] * n
    done = bytearray(n)
    g = len(members) - 1
    order = []
    while g >= 0:
        at = sorted(p for p in members[g] if group[p] == g)  # without those that have moved up
        if not at:
            g = below[g]
            continue
        counts: dict[int, int] = {}
        for i in at:
            done[i] = 1
            j = i - 1
            while j >= 0 and done[j]:
                j = prev[j]
            k = i - 1
            while k > j and prev[k] != j:  # what was passed points here from now on
                prev[k], k = j, prev[k]
            prev[i] = j
            if j >= 0:
                counts[j] = counts.get(j, 0) + 1
        order.append(at)
        if counts:
            step = length[at[0]]
            split: dict[tuple[int, int], list[int]] = {}
            for p, c in counts.items():
                length[p] += c * step
                split.setdefault((group[p], c), []).append(p)
            for h, c in sorted(split, reverse=True):
                moved = split[h, c]
                # c runs downwards, so each new group goes right above the old one and under those with more copies
                new = len(members)
                members.append(moved)
                for p in moved:
                    group[p] = new
                up = above[h]
                above[h], below[up] = new, new
                above.append(up)
                below.append(h)
        g = below[g]
    # Places: groups upwards, then one position after the other.
    place = [0] * n
    start = 0
    rank = [0] * n
    starts = []
    for r, at in enumerate(reversed(order)):
        starts.append(start)
        start += len(at)
        for i in at:
            rank[i] = r
    children: list[list[int] | None] = [None] * (n + 1)
    for i in range(n):
        e = i + length[i]
        if (c := children[e]) is None:
            children[e] = [i]
        else:
            c.append(i)
    out = place
    for i in children[n] or ():
        r = rank[i]
        out[starts[r]] = i
        starts[r] += 1
    for x in range(n):
        if (c := children[out[x]]) is not None:
            for i in c:
                r = rank[i]
                out[starts[r]] = i
                starts[r] += 1
    return out


def expanded(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The ranges start, start + 1, ... of ``count`` each, one after the other."""
    ends = np.cumsum(count)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(start - (ends - count), count)


def suffix_arrays(s: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The suffix arrays of many strings that stand one after the other in ``s``, as places in ``s``.

    The same construction as ``suffix_array``, one group of every string in each step: members of
    the highest groups find their previous smaller positions together (pointers jump over what is
    done, and halve the way), and new groups are linked in above their old ones. Then one suffix of
    every string is emitted in each step. ``size`` has the strings' lengths, none of them 0. A step
    costs the same whether one string or a thousand take part, so strings should be many and alike
    in length.
    """
    rows = len(size)
    by = np.argsort(-size, kind="stable")  # longest first: those that still take part are the first ones
    origin = (np.cumsum(size) - size)[by]
    size = size[by]
    source = np.cumsum(size) - size
    place = expanded(origin, size)  # in s, of what stands at each place here
    n, row = len(place), np.repeat(np.arange(rows), size)
    cell = np.arange(n) + row + 1  # a cell in front of each string is never done
    first_cell = source + np.arange(rows)
    symbol = np.asarray(s)[place].astype(np.int64)
    order = np.argsort(row * (int(symbol.max()) + 1) + symbol, kind="stable")
    r, c = row[order], symbol[order]
    edge = np.flatnonzero(np.concatenate([[True], (r[1:] != r[:-1]) | (c[1:] != c[:-1])]))
    groups = len(edge)
    # Groups: members (room for those that move later), how many are left, word, neighbours, next free place.
    room = groups + n
    members = np.concatenate([cell[order], np.empty(n, np.int64)])
    g_start, g_count = np.empty(room, np.int64), np.empty(room, np.int64)
    g_start[:groups], g_count[:groups] = edge, np.diff(np.append(edge, n))
    g_left, g_word, g_place = g_count.copy(), np.ones(room, np.int64), np.zeros(room, np.int64)
    below, above = np.full(room + 1, -1), np.full(room + 1, -1)  # the last entry is written to where there is no neighbour
    near = r[edge][1:] == r[edge][:-1]
    below[1:groups][near], above[: groups - 1][near] = np.flatnonzero(near), np.flatnonzero(near) + 1
    group = np.full(n + rows + 1, -1)
    group[cell[order]] = np.repeat(np.arange(groups), g_count[:groups])
    done = np.zeros(n + rows + 1, bool)
    prev = np.arange(-1, n + rows)
    now = np.append(np.flatnonzero(~near), groups - 1)  # the highest group of each string
    free = np.cumsum(size)
    who = np.arange(rows)
    moved_to = n
    while len(who):
        m = g_count[now]
        at = members[expanded(g_start[now], m)]
        mine = np.repeat(np.arange(len(who)), m)
        here = group[at] == now[mine]
        at, mine = at[here], mine[here]
        free[who] -= g_left[now]
        g_place[now] = free[who]
        done[at] = True
        j = at - 1
        live = np.flatnonzero(done[j])
        while len(live):
            a = j[live]
            b = prev[a]
            b = np.where(done[b], prev[b], b)
            prev[a] = j[live] = b
            prev[at[live]] = b
            live = live[done[b]]
        prev[at] = j
        real = group[j] >= 0
        if real.any():
            to, step = j[real], g_word[now][mine[real]]
            o = np.argsort(to, kind="stable")
            to, step = to[o], step[o]
            one = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]]))
            times = np.diff(np.append(one, len(to)))
            to, step, old = to[one], step[one], group[to[one]]
            o = np.lexsort((times, old))
            to, step, old, times = to[o], step[o], old[o], times[o]
            fresh = np.concatenate([[True], (old[1:] != old[:-1]) | (times[1:] != times[:-1])])
            e = np.flatnonzero(fresh)
            new = np.arange(groups, groups + len(e))
            members[moved_to : moved_to + len(to)] = to
            g_start[new], g_count[new] = moved_to + e, np.diff(np.append(e, len(to)))
            g_left[new] = g_count[new]
            h = old[e]
            g_word[new] = g_word[h] + times[e] * step[e]
            group[to] = groups + np.cumsum(fresh) - 1
            head = np.concatenate([[True], h[1:] != h[:-1]])
            tail = np.append(head[1:], True)
            up = above[h]
            below[new], above[new] = np.where(head, h, new - 1), np.where(tail, up, new + 1)
            above[h[head]] = new[head]
            below[up[tail]] = new[tail]  # no neighbour: -1, the last entry
            g_left[h[head]] -= np.add.reduceat(g_count[new], np.flatnonzero(head))
            moved_to += len(to)
            groups += len(e)
        below[-1] = -1
        now = below[now]
        while (empty := (now >= 0) & (g_left[now] == 0)).any():
            now[empty] = below[now[empty]]
        on = now >= 0
        who, now = who[on], now[on]
    # Children of an end: the positions whose words end there.
    end = cell + g_word[group[cell]]
    order = np.argsort(end, kind="stable")
    child = cell[order]
    pointer = np.searchsorted(end[order], np.arange(n + rows + 2))
    out = np.empty(n, np.int64)

    def emit(ends: np.ndarray) -> None:
        low = pointer[ends]
        c = child[expanded(low, pointer[ends + 1] - low)]
        g = group[c]
        out[g_place[g]] = c
        g_place[g] += 1

    emit(first_cell + size + 1)
    takes_part = np.searchsorted(-size, -np.arange(int(size[0])), "left")
    for x in range(int(size[0])):
        emit(out[source[: takes_part[x]] + x])
    flat = np.empty(n + rows + 1, np.int64)
    flat[cell] = place
    result = np.empty(n, np.int64)
    result[place] = flat[out]
    return result
