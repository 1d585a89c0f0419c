"""Schemas of match documents, page payloads and the prediction log."""

from __future__ import annotations

PLAYER = (
    "struct<player:string, kills:int, deaths:int, kd:double, plus_minus:string, "
    "damage:int, rating:double>"
)
PLAYER_MAP = (
    "struct<map_number:int, player_name:string, team:string, kills:int, deaths:int, "
    "kd:double, damage:int, rating:double>"
)
MATCH_INFO = (
    "struct<match_id:string, team_a:string, team_b:string, tournament:string, date:string, "
    "url:string, team_a_score:int, team_b_score:int>"
)
MAP_RESULT = "struct<mode:string, map_name:string, team_a_score:int, team_b_score:int>"

DOCUMENT = (
    f"match_info {MATCH_INFO}, map_results array<{MAP_RESULT}>, "
    f"player_stats struct<team_a:array<{PLAYER}>, team_b:array<{PLAYER}>, "
    f"per_map:array<{PLAYER_MAP}>>"
)

PAGE_PAYLOAD = (
    "struct<props:struct<pageProps:struct<initialMatchState:struct<team_1_id:bigint, "
    "team_2_id:bigint, games:array<struct<game_num:int, player_stats:array<struct<"
    "player_tag:string, team_id:bigint, kills:int, deaths:int, damage:int, "
    "bp_rating:double>>>>>>>>"
)

MODELS = ("statistical", "elo", "ml", "ensemble")

PREDICTION_LOG = (
    "match_date date, team_a string, team_b string, "
    + ", ".join(f"{m}_winner string, {m}_score string, {m}_probability double" for m in MODELS)
    + ", ensemble_confidence double, actual_winner string, actual_score string, "
    "prediction_timestamp timestamp, result_timestamp timestamp, notes string"
)
PREDICTION_KEY = ["match_date", "team_a", "team_b"]

TABLE_KEYS = {
    "matches": ["match_id"],
    "map_results": ["match_id", "map_number"],
    "player_match_stats": ["match_id", "player_name"],
    "player_map_stats": ["match_id", "map_number", "player_name"],
    "team_stats": ["team"],
    "team_mode_stats": ["team", "mode"],
    "team_map_mode_stats": ["team", "map_name", "mode"],
    "head_to_head": ["team_1", "team_2"],
    "head_to_head_map_mode": ["team_1", "team_2", "map_name", "mode"],
    "player_stats": ["player_name"],
    "player_mode_stats": ["player_name", "mode"],
    "player_map_mode_stats": ["player_name", "map_name", "mode"],
    "predictions": PREDICTION_KEY,
}
