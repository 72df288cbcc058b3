"""Byte layouts of graph files. All numbers are little-endian and unsigned.

A file holds V, E, the out-degrees (u32) if it has them, V row pointers, then E edges. The same suffix stands for
different layouts in different tools, so a layout is named; the suffix only chooses a default."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Layout:
    head: int  # bytes of V and of E, and of a pointer
    target: int  # bytes of an edge's other end
    weight: int = 0  # bytes of its weight, after the other end
    by_target: bool = False  # rows are targets and edges name sources; then out-degrees follow the header

    @property
    def edge(self) -> np.dtype:
        return np.dtype([("to", f"<u{self.target}"), *([("weight", f"<u{self.weight}")] if self.weight else [])])

    def pointers_at(self, v: int) -> int:
        return 2 * self.head + (4 * v if self.by_target else 0)

    def edges_at(self, v: int) -> int:
        return self.pointers_at(v) + self.head * v

    def size(self, v: int, e: int) -> int:
        return self.edges_at(v) + self.edge.itemsize * e


#: The formats themselves.
LAYOUTS = {
    "csr32": Layout(4, 4),
    "wcsr32": Layout(4, 4, 4),
    "csr64": Layout(8, 8),
    "wcsr64": Layout(8, 8, 8),
    "csc64": Layout(8, 8, by_target=True),
    "wcsc64": Layout(8, 8, 8, by_target=True),
    "csr64_32": Layout(8, 4),
    "wcsr64_32": Layout(8, 4, 4),
    "csc64_32": Layout(8, 4, by_target=True),
    "csr32_64": Layout(4, 8),
}
SUFFIXES = {".bcsr": "csr32", ".bwcsr": "wcsr32", ".bcsr64": "csr64", ".bwcsr64": "wcsr64", ".lcsr": "csr32_64", ".bcsc": "csc64", ".llbcsc": "csc64", ".toB": "pairs"}


def by_suffix(path: str) -> str:
    """The layout that a suffix usually means; wide rows by source for any other."""
    name = path.rsplit("/", 1)[-1]
    return SUFFIXES.get("." + name.rsplit(".", 1)[-1], "csr64") if "." in name else "csr64"
