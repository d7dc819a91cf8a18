"""PGN text: game boundaries, tags, movetext tokens and replay."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

from plyforge.rules.board import START, BadFen, IllegalMove, Position

_TAG = re.compile(r"^\[([A-Za-z0-9_+#=:-]+)\s+\"((?:[^\"\\]|\\.)*)\"\s*\]\s*$")
_NAG = {"!": 1, "?": 2, "!!": 3, "??": 4, "!?": 5, "?!": 6}
RESULTS = {"1-0": 1, "0-1": 2, "1/2-1/2": 3, "*": 0}
_TOKEN = re.compile(r"\{[^}]*\}?|;[^\n]*|\(|\)|\$\d+|[^\s{}()$;]+")


def split_games(text: str) -> Iterator[str]:
    """Texts of the games: a tag line at a line's start after move text opens the next game. Tags within comments don't.

    Text without tags is a game too; blank text is none.
    """
    game: list[str] = []
    moves = comment = False
    for line in text.splitlines(keepends=True):
        if not comment and _TAG.match(line.rstrip()):
            if moves:
                yield "".join(game)
                game, moves = [], False
        elif line.strip():
            moves = True
            for c in line:
                comment = c == "{" or (comment and c != "}")
        game.append(line)
    if any(x.strip() for x in game):
        yield "".join(game)


def split_headers(text: str) -> tuple[dict[str, str], str]:
    """(tags by their own names, movetext)."""
    tags, rest = {}, []
    for line in text.splitlines():
        m = _TAG.match(line.strip()) if not rest else None
        if m:
            tags[m[1]] = m[2].replace('\\"', '"').replace("\\\\", "\\")
        elif line.strip() or rest:
            rest.append(line)
    return tags, "\n".join(rest)


@dataclass
class Played:
    move: dict
    nags: list[int] = field(default_factory=list)
    comment: str | None = None


@dataclass
class Replay:
    """positions[0..n], moves[0..n): moves[i] leads from positions[i] to positions[i + 1]. error: the token that stopped it."""

    positions: list[Position]
    moves: list[Played]
    error: str | None = None
    result: str | None = None


def replay(tags: dict[str, str], movetext: str) -> Replay:
    """Play the main line. Variations are skipped, comments and NAGs go to the last move; an illegal move ends the game."""
    low = {k.lower(): v for k, v in tags.items()}
    try:
        pos = Position.from_fen(low.get("fen") or START)
    except (BadFen, ValueError, IndexError):
        return Replay([Position.start()], [], f"bad FEN {low.get('fen')!r}")
    out = Replay([pos], [])
    depth = 0
    for t in _TOKEN.findall(movetext):
        if t == "(":
            depth += 1
        elif t == ")":
            depth = max(0, depth - 1)
        elif depth:
            continue
        elif t[0] == "{":
            if out.moves:
                text = t.strip("{}").strip()
                out.moves[-1].comment = text if out.moves[-1].comment is None else out.moves[-1].comment + " " + text
        elif t[0] == ";":
            continue
        elif t[0] == "$":
            if out.moves:
                out.moves[-1].nags.append(int(t[1:]))
        elif t in RESULTS:
            out.result = t
        else:
            t = re.sub(r"^\d+\.*|^\.+", "", t)
            if not t or t in _NAG:
                if t and out.moves:
                    out.moves[-1].nags.append(_NAG[t])
                continue
            mark = re.search(r"[!?]+$", t)
            try:
                m = pos.parse_san(t)
            except (IllegalMove, ValueError):
                out.error = t
                break
            out.moves.append(Played(pos.describe(m), [_NAG[mark[0]]] if mark and mark[0] in _NAG else []))
            pos = pos.make(m)
            out.positions.append(pos)
    return out
