"""Where the script of a text changes: one rule for written runs, repaired runs and checks.

A text is read as stretches: complex script (a joiner between two of its letters that
aren't Thai is part of the word), white space, punctuation, and the letters of other scripts.
Punctuation is complex only if the nearest letters on both sides that has any are; white space
goes with what is before it, or at the start with the first stretch that isn't white space.
"""

from __future__ import annotations

import re

from ..functions import vocab as V


def _class(*groups) -> str:
    return "".join(f"{re.escape(chr(a))}-{re.escape(chr(b))}" for g in groups for a, b in g)


_COMPLEX = _class(V.COMPLEX_SCRIPT)
_LETTER = f"(?![{_class(V.THAI)}])[{_COMPLEX}]"
_STRETCH = re.compile(
    rf"(?P<complex>(?:[{_COMPLEX}]|(?<={_LETTER})[{V.JOINERS}](?={_LETTER}))+)|(?P<space>\s+)"
    rf"|(?P<mark>[{re.escape(V.PUNCTUATION)}]+)|(?P<other>[^{_COMPLEX}\s{re.escape(V.PUNCTUATION)}]+)"
)
_OTHER = re.compile(rf"[^{_COMPLEX}\s{re.escape(V.PUNCTUATION)}]")
has_complex = re.compile(f"[{_COMPLEX}]").search
has_thai = re.compile(f"[{_class(V.THAI)}]").search
_JOINED = re.compile(f"(?<={_LETTER})[{V.JOINERS}](?={_LETTER})")
_UNSEEN = re.compile(f"[{_class(V.FORMAT, V.NONCHARACTERS)}]")
_FORMAT = re.compile(f"[{_class(V.FORMAT)}]")


def unseen_in(text: str) -> str | None:
    """How an invisible character of a text is named, the five with names of their own first, or None."""
    if not _UNSEEN.search(text):
        return None
    found = _UNSEEN.findall(_JOINED.sub("", text))
    for char, label in V.INVISIBLE.items():
        if char in found:
            return label
    return f"U+{ord(found[0]):04X}, a {'format character' if _FORMAT.match(found[0]) else 'noncharacter'}" if found else None


def stretches(text: str) -> list[tuple[str, str]]:
    """(kind, piece): "complex", "space", "mark" or "other"."""
    return [(m.lastgroup, m[0]) for m in _STRETCH.finditer(text)]


def _letters(text: str) -> list[bool]:
    """Whether each stretch of letters is complex; stretches of one kind that follow each other may count as one."""
    if not has_complex(text):
        return [False] if _OTHER.search(text) else []
    return [k == "complex" for k, _ in stretches(text) if k in ("complex", "other")]


def outer_letters(texts: list[str | None]) -> list[tuple[bool | None, bool | None]]:
    """For each of a paragraph's texts, whether the nearest letter before and after it is complex (None: none there).

    A None among the texts is something that isn't text; letters beyond it don't count.
    """
    kinds = [None if t is None else _letters(t) for t in texts]

    def passed(order) -> list[bool | None]:
        out, near = [None] * len(kinds), None
        for i, own, edge in order:
            out[i] = near
            near = None if own is None else own[edge] if own else near
        return out

    before = passed((i, own, -1) for i, own in enumerate(kinds))
    after = passed((i, kinds[i], 0) for i in range(len(kinds) - 1, -1, -1))
    return list(zip(before, after, strict=True))


def script_pieces(text: str, before: bool | None = None, after: bool | None = None) -> list[tuple[bool, str]]:
    """Text cut where its script changes: (complex, piece); ``before`` and ``after``: whether the letters around it are complex."""
    if not (before or after or has_complex(text)):  # nothing here or around is complex
        return [(False, text)] if text else []
    found = stretches(text)
    letters = [k == "complex" if k in ("complex", "other") else None for k, _ in found]
    ahead, near = [None] * len(found), after
    for i in range(len(found) - 1, -1, -1):
        ahead[i] = near
        near = letters[i] if letters[i] is not None else near
    said: list[bool | None] = []
    near = before
    for (kind, _), own, right in zip(found, letters, ahead, strict=True):
        sides = {near, right} - {None}
        said.append(None if kind == "space" else sides == {True} if kind == "mark" else own)
        near = own if own is not None else near
    now = next((s for s in said if s is not None), False)
    out: list[tuple[bool, list[str]]] = []
    for (_, piece), s in zip(found, said, strict=True):
        now = now if s is None else s
        if not out or out[-1][0] != now:
            out.append((now, []))
        out[-1][1].append(piece)
    return [(script, "".join(pieces)) for script, pieces in out]
