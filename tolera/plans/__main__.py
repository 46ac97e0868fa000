"""Reads quantities of interest from standard input, one a line, and shows how they are read.

    python -m tolera.plans [before,after ...]    # pairs: the neighbourhood, one per axis; none for pointwise quantities
"""

from __future__ import annotations

import sys

from tolera.plans import qoi


def show(node: qoi.Node, depth: int = 0) -> str:
    pad = "  " * depth
    if node[0] in ("num", "x", "c"):
        return pad + " ".join(str(v) for v in node)
    return "\n".join([pad + node[0], *[show(n, depth + 1) for n in node[1:]]])


def main(args: list[str], lines=sys.stdin) -> int:  # noqa: ANN001
    around = [tuple(int(v) for v in a.split(",")) for a in args] or None
    wrong = 0
    for line in lines:
        if not line.strip():
            continue
        try:
            print(show(qoi.parse(line.rstrip("\n"), around)))  # type: ignore[arg-type]
        except qoi.QoiError as e:
            wrong += 1
            print(f"error: {e}")
    return 1 if wrong else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
