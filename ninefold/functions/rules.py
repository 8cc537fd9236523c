"""The addressing rules as data, written once and read by the Arrow kernel, the column form and tests."""

from __future__ import annotations

import math

#: The triangle has side W, height H and its barycentre at the origin.
W = math.sqrt(2.0)
H = math.sqrt(6.0) / 2.0
R3 = math.sqrt(3.0)
WX = W * R3 / 3.0
U = W / 6.0
V = H / 9.0

#: The six intersection identities (C2); the first three are of a Λ, the others of a V.
C2 = ("021", "102", "210", "012", "120", "201")
HALF = ("Λ", "V")

#: Sector tests. x, y is the point, dx = R3 * x. The last sector is where no other holds.
SECTORS = {
    "Λ": [(0, "y < 0 AND y <= dx"), (1, "y <= -dx AND y > dx"), (2, None)],
    "V": [(1, "y <= dx AND y < 0"), (2, "y <= -dx AND y > dx"), (0, None)],
}

#: For half and sector, in order, the child identity, its test (the last is the rest),
#: and its shift in units of U and V. wx = WX, h3 = H / 3.
CHILDREN = {
    ("Λ", 0): [("021", "y <= -dx", (0, 2)), ("102", "y <= dx - wx", (-2, 2)), ("201", None, (-1, 1))],
    ("Λ", 1): [("102", "y >= 0", (1, -1)), ("210", "y <= -dx - wx", (2, 2)), ("120", None, (1, 1))],
    ("Λ", 2): [("210", "y <= dx", (-1, -1)), ("021", "y >= h3", (0, -4)), ("012", None, (0, -2))],
    ("V", 0): [("012", "y >= dx", (0, -2)), ("120", "y >= wx - dx", (-2, -2)), ("210", None, (-1, -1))],
    ("V", 1): [("201", "y >= -dx", (-1, 1)), ("012", "y <= -h3", (0, 4)), ("021", None, (0, 2))],
    ("V", 2): [("120", "y <= 0", (1, 1)), ("201", "y >= wx + dx", (2, -2)), ("102", None, (1, -1))],
}

#: Corners of the two triangles, and for each half and sector which of them the sector touches (A),
#: where its long edge leads (B), and the third (C).
CORNERS = {
    "Λ": {"top": (0.0, 2 * H / 3), "right": (W / 2, -H / 3), "left": (-W / 2, -H / 3)},
    "V": {"bottom": (0.0, -2 * H / 3), "right": (W / 2, H / 3), "left": (-W / 2, H / 3)},
}
SECTOR_CORNERS = {
    ("Λ", 0): ("right", "left", "top"), ("Λ", 1): ("left", "top", "right"), ("Λ", 2): ("top", "right", "left"),
    ("V", 0): ("right", "left", "bottom"), ("V", 1): ("bottom", "right", "left"), ("V", 2): ("left", "bottom", "right"),
}
#: Share of the corners A, B, C in the centroid of a half-hexagon.
CENTROID = (16 / 27, 7 / 27, 4 / 27)

MAX_LEVEL = 30


def half_of(code: int) -> str:
    return HALF[code // 3]


def digit(code: int, sector: int) -> int:
    return int(C2[code][sector]) * 3 + sector


def code_of(half: str, digit_: int) -> int:
    """The identity of that half in which the sector of this digit carries it."""
    sector, first = digit_ % 3, digit_ // 3
    return next(k for k in range(6) if half_of(k) == half and int(C2[k][sector]) == first)


def shift(half: str, sector: int, child: str) -> tuple[float, float]:
    a, b = next(s for c, _, s in CHILDREN[half, sector] if c == child)
    return a * U, b * V


def _steps() -> dict[tuple[int, int, str], str]:
    """Half of a digit for the digit that follows it and that one's half, from all steps of a walk."""
    return {
        (digit(code, sector), digit(C2.index(child), below), half_of(C2.index(child))): half_of(code)
        for code in range(6) for sector in range(3) for child, _, _ in CHILDREN[half_of(code), sector] for below in range(3)
    }


PARENT_HALF = _steps()
