"""Plain graph helpers for the tests."""


def brute(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        ra, rb = find(a), find(b)
        if ra != rb:
            parent[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in parent}


def random_pairs(rng):
    chain = [f"c{i:03d}" for i in range(60)]
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:]))  # a long chain in random order
    pairs += [("hub", f"h{i}") for i in range(80)] + [("é1", "z"), ("z", "é1")]
    pairs += [(f"r{rng.randint(0, 90)}", f"r{rng.randint(0, 90)}") for _ in range(60)]
    rng.shuffle(pairs)
    return pairs
