"""Plain versions of what several tests compare with."""


def brute_near(texts):
    """Component of every document by comparing all pairs of shingle sets."""
    sets, up = {}, {i: i for i in texts}
    for i, text in texts.items():
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    ids = sorted(sets)
    for a, i in enumerate(ids):
        for j in ids[:a]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def fill_targets(sizes, weights=(3, 1, 2), share=1.5, most=2):
    """Targets by dealing the excess again and again."""
    names = sorted(s for s in sizes if s is not None) + ([None] if None in sizes else [])
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, target, free = share * sum(sizes.values()), {}, set(names)
    while free:
        unit = left / sum(w[s] for s in free)
        over = {s for s in free if unit * w[s] > most * sizes[s]}
        if not over:
            return target | {s: unit * w[s] for s in free}
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target
