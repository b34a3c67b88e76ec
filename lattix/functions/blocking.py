"""Shapes of tiles and process grids: arithmetic on the driver, and the matching columns."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def factor(n: int) -> tuple[int, int]:
    """n = p * q with p >= q and both as near to the square root as possible."""
    q = next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)
    return n // q, q


def tile_shape(m: int, n: int, processes: int, policy: str | tuple[int, int] = "square") -> tuple[int, int]:
    """Rows and columns of a tile: one band of rows or columns a process, a grid of processes, or the given shape, clamped to the matrix."""
    if not isinstance(policy, str):
        return min(policy[0], m), min(policy[1], n)
    if policy == "row":
        return -(-m // processes), n
    if policy == "column":
        return m, -(-n // processes)
    p, q = factor(processes)
    if policy == "rect":
        return -(-m // p), -(-n // q)
    if policy == "square":
        side = -(-max(m, n) // max(p, q))
        return min(side, m), min(side, n)
    if policy == "opt":
        if m >= 2 * n:
            return tile_shape(m, n, processes, "row")
        return tile_shape(m, n, processes, "column") if n >= 2 * m else tile_shape(m, n, processes, "rect")
    raise ValueError(policy)


def product_tiles(m: int, n: int, k: int, processes: int) -> tuple[tuple[int, int], tuple[int, int], tuple[int, int]]:
    """Tile shapes of A (m x k), B (k x n) and C (m x n) that line up for a product."""
    tm, tn = tile_shape(m, n, processes, "rect")
    tk = min(k, max(tm, tn))
    return (tm, tk), (tk, tn), (tm, tn)


def tile_owner(i: Column, j: Column, pm: int, pn: int) -> Column:
    """Process of a tile, block-cyclic on a pm x pn grid."""
    return (i % pm) * pn + j % pn


def block_sizes(n: int, blocks: int) -> list[int]:
    """Sizes of blocks: rounded up, the remainder in the last."""
    size = -(-n // blocks)
    return [max(0, min(size, n - k * size)) for k in range(blocks)]


def block_node(block: Column, blocks: int, nodes: int) -> Column:
    return F.floor(block / -(-blocks // nodes))


def array_owner(index: Column, n: int, hosts: int) -> tuple[Column, Column]:
    """Host and place of an element of a block-distributed array."""
    size = -(-n // hosts)
    return F.floor(index / size), index % size
