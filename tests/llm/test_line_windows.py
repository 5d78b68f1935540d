"""Bands of a small vocabulary: unrelated lines share few of them, however many lines there are."""

import numpy as np
from test_line_apart import frame_of


def test_unrelated_lines_of_few_syllables_share_few_bands(spark):
    from barloom.llm import line_dedup

    rng = np.random.default_rng(5)
    parts = np.array("an at be ble by ed en er es ha he in ing is ly nd on or ou re st th the ti wh was of to".split())
    word = lambda: "".join(rng.choice(parts, rng.integers(1, 4)))
    lines = list(dict.fromkeys(" ".join(word() for _ in range(40)) for _ in range(3000)))
    shared = line_dedup.shared_bands(line_dedup.line_table(frame_of(spark, lines)))
    assert sum(r.lines for r in shared.collect()) <= 0.1 * len(lines)
