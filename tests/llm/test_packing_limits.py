"""Sequences that another limit than that of tokens ends."""

from collections import defaultdict

import pytest

from quillmark.llm import packing


def test_sequences_ended_by_segments_take_no_padding():
    # Short examples use up 256 segments before 4,096 tokens.
    examples = [(k, 3, None) for k in range(3000)] + [(k, 700 + k % 900, None) for k in range(3000, 3100)]
    use, placed = defaultdict(lambda: [0, 0]), defaultdict(int)
    for k, start, n, sequence, offset in packing.pack(examples):
        assert use[sequence][0] == offset and placed[k] == start
        use[sequence][0] += n
        use[sequence][1] += 1
        placed[k] += n
    assert [placed[k] for k, _, _ in examples] == [n for _, n, _ in examples]
    assert all(n <= 4096 and n & (n - 1) == 0 and segments <= 256 for n, segments in use.values())


@pytest.mark.parametrize("sizes", [[3], [1, 2], [5, 12], list(range(1, 21)), [0, 1, 4096, 9000]])
def test_short_examples_take_no_padding(sizes):
    examples = [(k, sizes[k % len(sizes)], None) for k in range(20_000 // len(sizes))]
    use = defaultdict(int)
    for _, _, n, sequence, _ in packing.pack(examples):
        use[sequence] += n
    tokens = sum(n for _, n, _ in examples)
    positions = sum(n if n & (n - 1) == 0 else 4096 for n in use.values())
    assert sum(use.values()) == tokens and positions == tokens
