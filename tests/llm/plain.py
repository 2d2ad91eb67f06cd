"""Plain versions that several tests share."""

from fractions import Fraction


def shingles(text, size):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").translate({c: " " for c in range(9, 14)}).split(" ")
    words = [w for w in words if w]
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


def brute_components(rows, size, part, whole):
    """The smallest id reachable from each id by links between all pairs of sets."""
    sets = {i: shingles(t, size) for i, t in rows}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    pairs = {(a, b) for ids in by.values() for k, a in enumerate(ids) for b in ids[k + 1 :]}
    for a, b in pairs:
        inter = len(sets[a] & sets[b])
        if whole * inter >= part * (len(sets[a]) + len(sets[b]) - inter):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def fill(budget, caps, weights):
    """Shares by raising one level for all children until the budget is used; whole numbers by rounding
    the running total of the children that are not full, in order of name."""
    share, free = dict.fromkeys(caps, Fraction(0)), {k for k in caps if weights[k] and caps[k]}
    left = Fraction(min(budget, sum(caps[k] for k in free)))
    while free and left:
        total = sum(weights[k] for k in free)
        step = min(left / total, min((caps[k] - share[k]) / Fraction(weights[k]) for k in free))
        for k in free:
            share[k] += step * weights[k]
        left -= step * total
        free = {k for k in free if share[k] < caps[k]}
    out, running, given = {}, Fraction(0), 0
    for k in sorted(caps):
        if k in free:
            running += share[k]
            out[k] = int(running) - given
            given = int(running)
        else:
            out[k] = int(share[k])
    return out


def waterfill_tree(supply, budget, weights):
    """Whole shares of leaves (tuples of values by level), down a tree."""
    shares = {(): min(budget, sum(supply.values()))}
    for depth, by in enumerate(weights):
        nxt = {}
        for node, given in shares.items():
            caps = {}
            for leaf, n in supply.items():
                if leaf[:depth] == node:
                    caps[leaf[depth]] = caps.get(leaf[depth], 0) + n
            nxt |= {(*node, k): v for k, v in fill(given, caps, {k: by.get(k, 1) for k in caps}).items()}
        shares = nxt
    return shares
