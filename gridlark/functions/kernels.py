"""Kernels as lists of (dx, dy, weight), built at plan time."""

from __future__ import annotations

Kernel = list[tuple[int, int, float]]


def fixed(weights: list[list[float]], origin: tuple[int, int] | None = None, normalize: bool = False) -> Kernel:
    ox, oy = origin or (len(weights[0]) // 2, len(weights) // 2)
    total = sum(map(sum, weights)) if normalize else 1.0
    return [(x - ox, y - oy, w / total) for y, row in enumerate(weights) for x, w in enumerate(row)]


def rectangle(rx: int, ry: int) -> Kernel:
    return [(x, y, 1.0) for y in range(-ry, ry + 1) for x in range(-rx, rx + 1)]


def square(radius: int) -> Kernel:
    return rectangle(radius, radius)


def circle(radius: float) -> Kernel:
    r = int(radius)
    return [(x, y, 1.0) for x, y, _ in square(r) if x * x + y * y <= radius * radius]


def rotate(kernel: Kernel, quarters: int = 1) -> Kernel:
    """Quarter turns, clockwise with y downwards."""
    for _ in range(quarters % 4):
        kernel = [(-y, x, w) for x, y, w in kernel]
    return kernel
