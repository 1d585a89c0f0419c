"""Online ratings: the league fold as a stateful streaming operator."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from matchlake.operators.ratings import RATED_SCHEMA, LeagueRatings, fold_batch
from matchlake.params import DEFAULTS, ModelParams

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class RatingProcessor(StatefulProcessor):
    """Keeps a league's ratings in map state keyed by (team, roster).

    Rows of a micro-batch are played in (date, id) order. A match older than the last one
    played cannot be inserted afterwards: it goes out with status ``late`` for a rebuild.
    """

    def __init__(self, p: ModelParams = DEFAULTS, id_type: str = "bigint"):
        self.p, self.id_type = p, id_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.board = handle.getMapState(
            "board", "team string, roster_key string", "rating double, matches int, day date"
        )
        self.last = handle.getValueState("last", f"day date, match_id {self.id_type}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values):
        frames = list(rows)
        if not frames:
            return
        batch = pd.concat(frames).sort_values(["match_date", "match_id"], kind="stable")
        late = batch.iloc[0:0]
        if self.last.exists():
            day, match_id = self.last.get()
            old = [
                (d, m) <= (day, match_id)
                for d, m in zip(batch["match_date"], batch["match_id"])
            ]
            late = batch[old]
            batch = batch[[not x for x in old]]
        league = key[0]
        state = {tuple(k): list(v) for k, v in self.board.iterator()}
        fold = LeagueRatings(self.p, state)
        out = fold_batch(batch, {league: fold})
        out["status"] = "rated"
        for team_key in set(zip(out["team_a"], out["key_a"])) | set(
            zip(out["team_b"], out["key_b"])
        ):
            rating, matches, day = fold.board[team_key]
            self.board.updateValue(team_key, (float(rating), int(matches), day))
        if len(batch):
            end = batch.iloc[-1]
            number = str if self.id_type == "string" else int  # the state takes no numpy numbers
            self.last.update((end["match_date"], number(end["match_id"])))
        yield out
        if len(late):
            rest = late[["league_id", "match_id", "match_date", "team_a", "team_b",
                         "key_a", "key_b"]].copy()
            rest["status"] = "late"
            yield rest.reindex(columns=list(out.columns))

    def close(self) -> None:
        pass


def stream_ratings(rows: DataFrame, p: ModelParams = DEFAULTS) -> DataFrame:
    """Rated matches of a stream of rating input rows (see ``rating_input``).

    Ids keep the type of the input: numbers, or the text ids of documents.
    """
    id_type = dict(rows.dtypes)["match_id"]
    rated = RATED_SCHEMA.replace("match_id long", f"match_id {id_type}")
    return rows.groupBy("league_id").transformWithStateInPandas(
        statefulProcessor=RatingProcessor(p, id_type),
        outputStructType=f"{rated}, status string",
        outputMode="Append",
        timeMode="None",
    )
