"""Brute-force references for tests (small inputs, one Python process)."""

from __future__ import annotations


def sequential_admission(requests, stock):
    """Fold requests in ``seq`` order: ``requests`` = [(seq, [(product, qty)])],
    ``stock`` = {product: stock or None}.  Returns {seq: accepted}."""
    left = dict(stock)
    out = {}
    for seq, items in sorted(requests):
        need = {}
        for p, q in items:
            need[p] = need.get(p, 0) + q
        ok = all(left.get(p) is None or left[p] >= q for p, q in need.items())
        if ok:
            for p, q in need.items():
                if left.get(p) is not None:
                    left[p] -= q
        out[seq] = ok
    return out, left
