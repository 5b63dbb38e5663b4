"""Literal pieces that a pattern cannot match without."""

from __future__ import annotations

from re import IGNORECASE, _constants, _parser, error

_ZERO_WIDTH = {_constants.AT, _constants.ASSERT, _constants.ASSERT_NOT}


def folded(text: str) -> str:
    """As the engine compares letters of either case."""
    return text.replace("İ", "I").upper().lower()


def _best(sets: list) -> frozenset | None:
    """Of some sets, each of which a match has one of, the one whose shortest piece is longest, then the smallest."""
    known = [s for s in sets if s]
    return max(known, key=lambda s: (min(map(len, s)), -len(s)), default=None)


def _needed(tokens) -> frozenset | None:
    sets, run = [], ""

    def close() -> None:
        nonlocal run
        if run:
            sets.append(frozenset((folded(run),)))
        run = ""

    for kind, value in tokens:
        if kind is _constants.LITERAL and value < 128:
            run += chr(value)
        elif kind in _ZERO_WIDTH:
            continue  # it takes no characters, so the literals on its sides are neighbours
        elif kind is _constants.SUBPATTERN and len(value[-1]) and all(k is _constants.LITERAL and v < 128 for k, v in value[-1]):
            run += "".join(chr(v) for _, v in value[-1])
        else:
            close()
            if kind is _constants.SUBPATTERN:
                sets.append(_needed(value[-1]))
            elif kind is _constants.ATOMIC_GROUP:
                sets.append(_needed(value))
            elif kind is _constants.BRANCH:
                each = [_needed(b) for b in value[1]]
                sets.append(frozenset().union(*each) if all(each) else None)
            elif kind in (_constants.MAX_REPEAT, _constants.MIN_REPEAT, _constants.POSSESSIVE_REPEAT) and value[0] > 0:
                sets.append(_needed(value[2]))
    close()
    return _best(sets)


def pieces(pattern: str) -> list[str]:
    """Strings of which every match of the pattern, in either case, has one; none if there is no such set.

    A pattern of a syntax that is not understood here has none, and is held against every text.
    """
    try:
        found = _needed(_parser.parse(pattern, IGNORECASE))
    except (error, RecursionError, OverflowError):
        return []
    return sorted(found or ())
