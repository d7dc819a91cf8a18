import pytest

from plyforge.rules.board import BadFen, IllegalMove, Position, perft
from plyforge.rules.pgn import replay, split_games, split_headers


@pytest.mark.parametrize(
    "fen, counts",
    [
        ("rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1", [20, 400, 8902]),
        ("r3k2r/p1ppqpb1/bn2pnp1/3PN3/1p2P3/2N2Q1p/PPPBBPPP/R3K2R w KQkq - 0 1", [48, 2039]),
        ("8/2p5/3p4/KP5r/1R3p1k/8/4P1P1/8 w - - 0 1", [14, 191, 2812]),
        ("r3k2r/Pppp1ppp/1b3nbN/nP6/BBP1P3/q4N2/Pp1P2PP/R2Q1RK1 w kq - 0 1", [6, 264, 9467]),
    ],
)
def test_perft(fen, counts):
    assert [perft(Position.from_fen(fen), d + 1) for d in range(len(counts))] == counts


def test_fen_round_trip_and_legal_en_passant_only():
    p = Position.start()
    for san in ("e4", "a6", "e5", "d5"):
        p = p.make(p.parse_san(san))
    assert p.epd().split()[3] == "d6"
    assert Position.from_fen(p.fen()).key() == p.key()
    q = Position.start().make(Position.start().parse_san("e4"))
    assert q.epd().split()[3] == "-"  # no pawn can take


@pytest.mark.parametrize("fen", ["", "8/8 w", "9/8/8/8/8/8/8/8 w - -", "x7/8/8/8/8/8/8/8 w - -"])
def test_bad_fen(fen):
    with pytest.raises(BadFen):
        Position.from_fen(fen)


def test_san_disambiguation_and_pins():
    p = Position.from_fen("4k3/8/8/8/1b6/2N5/8/4K1N1 w - - 0 1")
    assert p.san(p.parse_san("Ne2")) == "Ne2"  # the other knight is pinned
    with pytest.raises(IllegalMove):
        p.parse_san("Nd5")
    p = Position.from_fen("4k3/8/8/8/8/8/8/R3K2R w KQ - 0 1")
    assert {p.san(m) for m in p.legal() if m.castle} == {"O-O", "O-O-O"}
    assert p.san(p.parse_san("Rad1")) == "Rd1"


def test_split_games():
    assert list(split_games("")) == []
    assert len(list(split_games("1. e4 e5 *\n"))) == 1
    two = '[White "A"]\n\n1. e4 {a comment\n[Event "no tag"]\n} e5 1-0\n\n[White "B"]\n\n1. d4 *\n'
    got = list(split_games(two))
    assert len(got) == 2 and "".join(got) == two
    assert split_headers(got[1])[0] == {"White": "B"}


def test_replay_details():
    r = replay({}, "1.e4 e5 2. Nf3! $14 {good} (2. f4 exf4) 2...Nc6?? 3. Bb5 *")
    assert [m.move["san"] for m in r.moves] == ["e4", "e5", "Nf3", "Nc6", "Bb5"]
    assert r.moves[2].nags == [1, 14] and r.moves[2].comment == "good" and r.moves[3].nags == [4]
    assert r.error is None and r.result == "*"
    bad = replay({}, "1. e4 e5 2. Ke3 Nc6")
    assert len(bad.moves) == 2 and bad.error == "Ke3"


def test_castling_keeps_both_targets():
    p = Position.from_fen("4k3/8/8/8/8/8/8/4K2R w K - 0 1")
    d = p.describe(p.parse_san("O-O"))
    assert (d["to_sq"], d["to_norm"], d["castle"]) == (7, 6, True)
