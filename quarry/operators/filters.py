"""Structured filters of a file search: kinds, folders, and comparisons written as ``gt:10``."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Most conditions of one sort, and of comparisons the greatest number (fixed values).
MOST, GREATEST = 20, 2**53 - 1
COMPARISON = re.compile(r"(gt|gte|lt|lte):((?:0|[1-9][0-9]*)(?:\.[0-9]{1,3})?)")


def comparisons(column: Column, wanted: Sequence[str], whole: bool = True) -> Column:
    """All of ``wanted`` (``gt``, ``gte``, ``lt`` or ``lte``, a colon, a number without leading or trailing zeros) hold.

    A null column holds none. Anything else, or over 20 different ones, is a
    ValueError.
    """
    out = F.lit(True)
    wanted = list(dict.fromkeys(wanted))
    if len(wanted) > MOST:
        raise ValueError(f"at most {MOST} comparisons")
    for text in wanted:
        found = COMPARISON.fullmatch(text)
        if not found or ("." in text and (whole or text.endswith("0"))) or float(found[2]) > GREATEST:
            raise ValueError(f"invalid comparison: {text!r}")
        amount = F.lit(int(found[2]) if whole else float(found[2]))
        out = out & {"gt": column > amount, "gte": column >= amount, "lt": column < amount, "lte": column <= amount}[found[1]]
    return F.coalesce(out, F.lit(False))


def kind(wanted: str, file_type: Column, mime: Column, filename: Column, mimes: Sequence[str] = (), suffixes: Sequence[str] = ()) -> Column:
    """Files of a kind: by type, or where ``mimes`` or ``suffixes`` describe the kind, by either of these."""
    if not mimes and not suffixes:
        return file_type == wanted
    by_name = [F.lower(filename).endswith(s) for s in suffixes]
    return reduce(lambda a, b: a | b, by_name, F.coalesce(mime.isin(*mimes), F.lit(False)))


def folders(path: Column, wanted: Sequence[str]) -> Column:
    """Files in one of the folders or below it; all if none is named."""
    names = list(dict.fromkeys(w.strip("/") for w in wanted if w.strip("/")))
    return reduce(lambda a, b: a | b, [(path == n) | path.startswith(n + "/") for n in names]) if names else F.lit(True)


def tags(own: Column, wanted: Sequence[str]) -> Column:
    """Files that have each of the tags, in either case; blank ones are ignored."""
    names = list(dict.fromkeys(w.strip().lower() for w in wanted if w.strip()))
    lowered = F.transform(own, lambda t: F.lower(t))
    return F.coalesce(reduce(lambda a, b: a & b, [F.array_contains(lowered, n) for n in names], F.lit(True)), F.lit(False))


def fallback_ladder(terms: Sequence[tuple[str, Sequence[str]]]) -> list[list[str]]:
    """Subsets of required terms (term, aliases) to try when all together find nothing, down to none.

    The term of the most aliases goes first, of equal ones the later.
    """
    order = sorted(range(len(terms)), key=lambda i: (-len(terms[i][1]), -i))
    return [[t for i, (t, _) in enumerate(terms) if i not in order[:n]] for n in range(1, max(1, len(terms)) + 1)]
