"""Groups of near copies of one line: exact components, however large the group."""

import numpy as np
import pytest

WIDTH = 5


def sets(line):
    return {line[i : i + WIDTH] for i in range(len(line) - WIDTH + 1)}


def groups(seed, number, size, words=40, changed=2):
    rng = np.random.default_rng(seed)
    word = lambda: "".join(rng.choice(list("abcdefghiklmnoprstuwy"), rng.integers(2, 9)))
    found = []
    for _ in range(number):
        base = [word() for _ in range(words)]
        for _ in range(size):
            own = list(base)
            for at in rng.choice(words, changed, replace=False):
                own[at] = word()
            found.append(" ".join(own))
    return list(dict.fromkeys(found))


def exact(lines, size):
    """Number of components by all pairs inside each group's run of lines; different groups share nothing."""
    merged = 0
    for start in range(0, len(lines), size):
        own = [sets(x) for x in lines[start : start + size]]
        root = list(range(len(own)))

        def find(k, root=root):
            while root[k] != k:
                root[k] = root[root[k]]
                k = root[k]
            return k

        for a in range(len(own)):
            for b in range(a):
                if find(a) != find(b) and 5 * len(own[a] & own[b]) >= 4 * len(own[a] | own[b]):
                    root[find(a)] = find(b)
        merged += sum(find(k) != k for k in range(len(own)))
    return merged


@pytest.mark.parametrize(("number", "size"), [(8, 30), (5, 60), (2, 400)])
def test_groups_of_near_copies_merge_like_all_pairs(spark, number, size):
    from barloom.llm.line_dedup import components

    lines = groups(size, number, size)
    want = exact(lines, size)
    frame = spark.createDataFrame([(k, x) for k, x in enumerate(lines)], "doc_id long, text string")
    kept = components(frame).filter("keeper").count()
    merges = len(lines) - kept
    assert merges <= want and merges >= 0.99 * want, (merges, want)
