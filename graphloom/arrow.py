"""Arrow batches of bounded size."""

from __future__ import annotations

from collections.abc import Iterator


def batches(frames: Iterator, most: int = 8 << 20) -> Iterator:
    """Record batches cut so that each holds few bytes, and one row at least."""
    for batch in frames:
        n = max(1, min(batch.num_rows, int(batch.num_rows * most / max(1, batch.nbytes))))
        for at in range(0, batch.num_rows, n):
            yield batch.slice(at, n)
