"""Game archives: a PGN data source, the games and plies tables, and their Parquet views."""

from __future__ import annotations

import glob
import json
import os
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType, _parse_datatype_string

from plyforge.functions.chess import BOARD, board_columns
from plyforge.rules.pgn import RESULTS, replay, split_games, split_headers

GAMES = "game_id bigint, white string, black string, white_elo int, black_elo int, result int, eco string, date string, year int, month int, day int, event string, site string, round string, deleted boolean, start_fen string, tags map<string,string>, movetext string, ply_count int"
PLY_MOVE = "struct<uci:string,san:string,from_sq:int,to_sq:int,to_norm:int,role:string,white:boolean,capture:boolean,captured:string,promo:string,check:boolean,mate:boolean,castle:boolean,ep:boolean,nags:array<int>,comment:string>"
SPLIT_BYTES = 16 << 20


def _ply_schema() -> str:
    parts, depth, word = [], 0, ""
    for c in BOARD + ",":
        depth += (c == "<") - (c == ">")
        if c == "," and depth == 0:
            name, kind = word.split(":", 1)
            parts.append(f"{name} {kind}")
            word = ""
        else:
            word += c
    return f"game_id bigint, ply int, {', '.join(parts)}, mv {PLY_MOVE}, replay_error string"


PLIES = _ply_schema()


class PgnSplit(InputPartition):
    def __init__(self, path: str, start: int, end: int):
        super().__init__(None)
        self.path, self.start, self.end = path, start, end


def read_split(path: str, start: int, end: int) -> Iterator[tuple[int, str]]:
    """(byte offset, text) of the games that begin in [start, end).

    A split begins at the first tag line after a blank line; the last game is read to its end. A boundary inside a
    comment that looks like a tag block can't be told apart without reading from the file's start, and counts as one.
    """
    size = os.path.getsize(path)
    with open(path, "rb") as f:
        f.seek(start)
        raw = f.read(end - start)
        if end < size:  # on to the next game's start
            tail = b""
            while True:
                more = f.read(1 << 20)
                tail += more
                at = _boundary((raw[-2:] + tail), 1)
                if at >= 0:
                    raw += tail[: at - len(raw[-2:])] if at >= len(raw[-2:]) else b""
                    break
                if not more:
                    raw += tail
                    break
    begin = 0
    if start:
        begin = _boundary(raw, 0)
        if begin < 0 or start + begin >= end:
            return
    text = raw[begin:].decode("utf-8", "replace")
    at = start + begin
    for g in split_games(text):
        if at < end:
            yield at, g
        at += len(g.encode("utf-8", "replace"))


def _boundary(raw: bytes, lo: int) -> int:
    """Offset of the first '[' behind a blank line."""
    best = -1
    for mark in (b"\n\n[", b"\r\n\r\n["):
        i = raw.find(mark, max(0, lo - 1))
        if i >= 0 and (best < 0 or i + len(mark) - 1 < best):
            best = i + len(mark) - 1
    return best


class PgnReader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths = sorted(p for x in options.get("path", "").split(",") for p in (glob.glob(os.path.join(x, "*.pgn")) if os.path.isdir(x) else glob.glob(x)))
        self.size = int(options.get("splitbytes", SPLIT_BYTES))

    def partitions(self):
        return [PgnSplit(p, s, min(s + self.size, os.path.getsize(p))) for p in self.paths for s in range(0, os.path.getsize(p), self.size)] or [PgnSplit("", 0, 0)]

    def read(self, split):
        if split.path:
            for at, g in read_split(split.path, split.start, split.end):
                yield split.path, at, g


class PgnSource(DataSource):
    """spark.read.format("pgn").load(path): (file, byte_offset, text), one row a game."""

    @classmethod
    def name(cls):
        return "pgn"

    def schema(self):
        return "file string, byte_offset bigint, text string"

    def reader(self, schema):
        return PgnReader(self.options)


def _elo(v: str | None) -> int | None:
    return int(v) if v and v.isdigit() and int(v) > 0 else None


def game_row(game_id: int, text: str) -> tuple[dict, dict[str, str], str]:
    tags, moves = split_headers(text)
    low = {k.lower(): v for k, v in tags.items()}
    part = [int(x) if x.isdigit() and int(x) > 0 else None for x in (low.get("date", "").split(".") + ["", "", ""])[:3]]
    end = moves.split()[-1] if moves.split() else ""
    return {
        "game_id": game_id, "white": low.get("white", "?"), "black": low.get("black", "?"), "white_elo": _elo(low.get("whiteelo")), "black_elo": _elo(low.get("blackelo")),
        "result": RESULTS.get(low.get("result", end), 0), "eco": low.get("eco"), "date": low.get("date"), "year": part[0], "month": part[1] if part[0] else None, "day": part[2] if part[0] and part[1] else None,
        "event": low.get("event", "?"), "site": low.get("site", "?"), "round": low.get("round"), "deleted": False, "start_fen": low.get("fen"), "tags": low, "movetext": moves,
    }, low, moves


def _frame(rows: list[dict], schema: StructType) -> pd.DataFrame:
    return pd.DataFrame({f.name: pd.Series([r.get(f.name) for r in rows], dtype="object" if f.dataType.typeName() not in ("boolean",) or not rows else None) for f in schema.fields}, columns=schema.names)


def with_ids(raw: DataFrame) -> DataFrame:
    """(game_id, text): ids count the games in file order without gaps.

    Each file split is numbered by its own rows; splits are joined by their counts, a row a split.
    """
    from pyspark.sql import Window

    numbered = raw.withColumn("pid", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id())
    part = numbered.groupBy("pid").agg(F.count(F.lit(1)).alias("n"))
    base = part.select("pid", (F.sum("n").over(Window.orderBy("pid")) - F.col("n")).alias("base"))
    local = F.col("at").bitwiseAND(F.lit((1 << 33) - 1))  # the row's number in its partition
    return numbered.join(F.broadcast(base), "pid").select((F.col("base") + local).alias("game_id"), "text")


def games_of(texts: DataFrame) -> DataFrame:
    """The games table of (game_id, text)."""
    schema = _parse_datatype_string(GAMES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for i, t in zip(f["game_id"], f["text"], strict=True):
                row, tags, moves = game_row(int(i), t)
                row["ply_count"] = len(replay(tags, moves).moves)
                rows.append(row)
            yield _frame(rows, schema)

    return texts.select("game_id", "text").mapInPandas(run, schema)


def plies_of(texts: DataFrame) -> DataFrame:
    """The plies table of (game_id, text): a row for every position, with the move that led to it."""
    schema = _parse_datatype_string(PLIES)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows: list[dict] = []
            for i, t in zip(f["game_id"], f["text"], strict=True):
                got = replay(*split_headers(t))
                for ply, p in enumerate(got.positions):
                    mv = None if ply == 0 else got.moves[ply - 1].move | {"nags": got.moves[ply - 1].nags, "comment": got.moves[ply - 1].comment}
                    rows.append({"game_id": int(i), "ply": ply, **board_columns(p), "mv": mv, "replay_error": got.error})
                if len(rows) > 2000:
                    yield _frame(rows, schema)
                    rows = []
            yield _frame(rows, schema)

    return texts.select("game_id", "text").mapInPandas(run, schema)


def read_pgn(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(game_id, text) of one file, a folder or a list with commas."""
    spark.dataSource.register(PgnSource)
    return with_ids(spark.read.format("pgn").option("splitBytes", split_bytes).load(path))


def build(spark: SparkSession, path: str, out: str) -> dict:
    """Write games and plies once, sorted within files by game and ply, with a record of the source's size and time."""
    texts = read_pgn(spark, path).persist()
    games_of(texts).repartitionByRange("game_id").sortWithinPartitions("game_id").write.mode("overwrite").parquet(f"{out}/games")
    plies_of(texts).repartitionByRange("game_id").sortWithinPartitions("game_id", "ply").write.mode("overwrite").parquet(f"{out}/plies")
    texts.unpersist()
    meta = stamp(path) | {"games": spark.read.parquet(f"{out}/games").count(), "version": 1}
    with open(os.path.join(out, "_meta.json"), "w") as f:
        json.dump(meta, f)
    return meta


def stamp(path: str) -> dict:
    files = PgnReader({"path": path}).paths
    return {"bytes": sum(os.path.getsize(p) for p in files), "mtime": max((os.path.getmtime(p) for p in files), default=0)}


def status(path: str, out: str) -> str:
    """valid, outdated or missing."""
    meta = os.path.join(out, "_meta.json")
    if not os.path.exists(meta):
        return "missing"
    with open(meta) as f:
        have = json.load(f)
    return "valid" if {k: have.get(k) for k in ("bytes", "mtime")} == stamp(path) and have.get("version") == 1 else "outdated"
