"""Flow-space reads: homopolymer runs per flow, and their probabilities."""

from __future__ import annotations

import numpy as np

ORDER = "TGCA"


def to_flows(seq: str, order: str = ORDER) -> list[int]:
    """Run length per flow of the cyclic order; bases that are not in the order end the key."""
    out: list[int] = []
    k = 0
    while k < len(seq):
        if seq[k] not in order:
            break
        while order[len(out) % len(order)] != seq[k]:
            out.append(0)
        n = 1
        while k + n < len(seq) and seq[k + n] == seq[k]:
            n += 1
        out.append(n)
        k += n
    return out


def from_flows(key: list[int], order: str = ORDER) -> str:
    return "".join(order[k % len(order)] * n for k, n in enumerate(key))


def collapse(seq: str, most: int = 12) -> str:
    """Homopolymers longer than ``most`` cut to it."""
    out: list[str] = []
    run = 0
    for k, b in enumerate(seq):
        run = run + 1 if k and seq[k - 1] == b else 1
        if run <= most:
            out.append(b)
    return "".join(out)


def uncollapse(bases: str, reference: str, most: int = 12) -> str:
    """Runs of ``most`` bases get the length of the run at the same place of the reference, if that is longer."""
    runs = [(b, len(s)) for b, s in _runs(bases)]
    ref = [(b, len(s)) for b, s in _runs(reference)]
    return "".join(b * (max(n, ref[k][1]) if n == most and k < len(ref) and ref[k][0] == b else n) for k, (b, n) in enumerate(runs))


def _runs(s: str):
    from itertools import groupby

    return [(b, "".join(g)) for b, g in groupby(s)]


def flow_matrix(key: list[int], quals: list[int], most: int = 12, floor: float = 1e-4) -> np.ndarray:
    """[length, flow] probabilities: the called length has 1 - error, its neighbours share the error."""
    m = np.full((most + 1, len(key)), floor)
    for f, (n, q) in enumerate(zip(key, quals, strict=True)):
        e = max(floor, 10 ** (-q / 10))
        n = min(n, most)
        near = [x for x in (n - 1, n + 1) if 0 <= x <= most]
        for x in near:
            m[x, f] = max(floor, e / len(near))
        m[n, f] = 1 - e
    return m / m.sum(0)


def flow_likelihood(matrix: np.ndarray, hap_key: list[int]) -> float:
    """Best log10 likelihood of a haplotype's flows under the read's matrix over all phases of the flow order (steps of 4)."""
    most, n = matrix.shape[0] - 1, matrix.shape[1]
    best = float("-inf")
    for start in range(0, max(1, len(hap_key) - n + 1), 4):
        part = hap_key[start : start + n]
        z = sum(np.log10(matrix[min(h, most), f]) for f, h in enumerate(part)) + (n - len(part)) * -4.0
        best = max(best, float(z))
    return best
