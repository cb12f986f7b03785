"""``python -m loomtab fromcsv x.csv -- selectgt n 3 -- cut a b -- look``: operators in a row, each after a ``--``.

Arguments are text, or Python literals where they parse as such; ``name=value`` are keywords. Nothing is evaluated.
"""

from __future__ import annotations

import ast
import sys
from typing import Any

import loomtab as lt


def literal(text: str) -> Any:
    try:
        return ast.literal_eval(text)
    except (ValueError, SyntaxError):
        return text


def run(args: list[str]) -> Any:
    """The result of the chain: each step's function gets the table before it as its first argument."""
    steps, out = [[]], None
    for a in args:
        if a == "--":
            steps.append([])
        else:
            steps[-1].append(a)
    for k, (name, *rest) in enumerate(steps):
        if name not in lt.__all__ or not callable(getattr(lt, name)) or name[0].isupper() or name == "PopenSource":
            raise lt.ArgumentError(f"no operator {name!r}")
        values = [literal(x) for x in rest if not x.partition("=")[0].isidentifier() or "=" not in x]
        named = {x.partition("=")[0]: literal(x.partition("=")[2]) for x in rest if "=" in x and x.partition("=")[0].isidentifier()}
        out = getattr(lt, name)(*([out] if k else []), *values, **named)
    return out


def main() -> None:
    if len(sys.argv) < 2:
        sys.exit(__doc__)
    out = run(sys.argv[1:])
    print(lt.look(out) if isinstance(out, lt.Table) else out)


if __name__ == "__main__":
    main()
