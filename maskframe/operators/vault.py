"""The vault as a table on shared storage, in parts that can be read, rewritten and dropped alone.

A row lies under ``session_part=…/token_part=…``.  The token part comes from the
token itself, so a lookup reads only the parts that its tokens name.  Spent or
expired tokens leave by a dynamic overwrite of the parts that held them; parts
without a token left are removed, and a session that has parts of its own leaves
without any data being read.  Parts that lose nothing keep their files.

One job at a time may write a table.  A job that dies between two steps has
removed some of the tokens that were to go and no other; running it again
removes the rest.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from maskframe.operators.tokens import DEFAULT_PREFIX, DEFAULT_SUFFIX, TOKEN_PART, token_part, tokens_in
from maskframe.session import materialise, remove_folder

SESSION_PART = "session_part"
PARTS = [SESSION_PART, TOKEN_PART]
_NO_SESSION = "none"


@dataclass(frozen=True)
class Vault:
    """A vault table below ``path``.

    Without ``session_groups`` every session has parts of its own, which suits
    sessions that are jobs, tenants or days.  Many short sessions are better
    dealt into a fixed number of groups; a session then leaves by a rewrite of
    its group.  The number is part of the layout: open a table as it was made.
    """

    path: str
    session_groups: int | None = None

    def session_part(self, session: Column) -> Column:
        """A folder name for a session: a hash, since names may be long or hold any character."""
        if self.session_groups:
            return F.concat(F.lit("g"), F.pmod(F.xxhash64(session), F.lit(self.session_groups)).cast("string"))
        return F.coalesce(F.concat(F.lit("s"), F.substring(F.sha2(session, 256), 1, 32)), F.lit(_NO_SESSION))

    def append(self, rows: DataFrame) -> None:
        """Add the rows of `vault_rows`."""
        self._write(rows.withColumns({
            SESSION_PART: self.session_part(F.col("session_id")), TOKEN_PART: token_part(F.col("token_id"))}), "append")

    def read(self, spark: SparkSession) -> DataFrame:
        """The table with its parts, as `detokenize` takes it."""
        return spark.read.parquet(self.path)

    def spend(self, df: DataFrame, columns: list[str], prefix: str = DEFAULT_PREFIX, suffix: str = DEFAULT_SUFFIX,
              json_columns=(), event_columns=()) -> int:
        """Remove the tokens that occur in ``df``; how many rows left the table."""
        spark = df.sparkSession
        found = tokens_in(df, columns, prefix, suffix, json_columns, event_columns)
        # Tokens alone are kept for the length of the job, no values.
        spent = materialise(df.select(F.explode(F.array_distinct(found)).alias("token_id")).distinct())
        parts = [r.part for r in spent.select(token_part(F.col("token_id")).alias("part")).distinct().collect()]  # at most 101
        held = self.read(spark).filter(F.col(TOKEN_PART).isin(parts)).select(*PARTS, "token_id")
        # Both sides grow with the table: neither is to pass the driver, whatever the planner takes its size for.
        gone = materialise(held.join(spent.hint("merge"), "token_id"))
        tokens = gone.select("token_id").distinct()
        self._keep(spark, self._parts_of(gone), lambda rows: rows.join(tokens.hint("merge"), "token_id", "left_anti"))
        return gone.count()

    def expire(self, spark: SparkSession, session: str | None = None, older_than: Column | None = None,
               ttl_hours: float | None = None) -> None:
        """Remove a session's tokens, and tokens made before a time; a token without a time stays.

        ``session`` and a time together remove what either of them names.
        """
        if session is not None and not self.session_groups:
            part = spark.range(1).select(self.session_part(F.lit(session)).alias("part")).first().part
            remove_folder(spark, f"{self.path}/{SESSION_PART}={part}")
            spark.catalog.refreshByPath(self.path)
            session = None
        gone = F.lit(False)
        if session is not None:
            gone = gone | F.col("session_id").eqNullSafe(F.lit(session))
        if ttl_hours is not None:
            now = spark.range(1).select(F.current_timestamp().alias("now")).first().now  # one time for all steps
            older_than = F.lit(now) - F.make_dt_interval(secs=F.lit(ttl_hours * 3600.0))
        if older_than is not None:
            gone = gone | F.coalesce(F.col("created_ts") < older_than, F.lit(False))
        if session is None and older_than is None:
            return
        rows = self.read(spark)
        if session is not None and older_than is None:
            rows = rows.filter(F.col(SESSION_PART) == self.session_part(F.lit(session)))
        self._keep(spark, self._parts_of(rows.filter(gone)), lambda kept: kept.filter(~gone))

    @staticmethod
    def _parts_of(rows: DataFrame) -> set[tuple[str, str]]:
        """Names of parts, as many as the table has folders at most."""
        return {tuple(r) for r in rows.select(*PARTS).distinct().collect()}

    @staticmethod
    def _inside(parts: Iterable[tuple[str, str]]) -> Column:
        """A condition on folders alone, so that no file of another part is opened."""
        by_session: dict[str, list[str]] = {}
        for session, token in sorted(parts):
            by_session.setdefault(session, []).append(token)
        inside = F.lit(False)
        for session, tokens in by_session.items():
            inside = inside | ((F.col(SESSION_PART) == session) & F.col(TOKEN_PART).isin(tokens))
        return inside

    def _keep(self, spark: SparkSession, parts: set[tuple[str, str]], kept: Callable[[DataFrame], DataFrame]) -> None:
        """Rewrite ``parts`` with the rows that ``kept`` leaves; remove those it leaves empty."""
        if not parts:
            return
        alive = self._parts_of(kept(self.read(spark).filter(self._inside(parts))))
        for session, token in sorted(parts - alive):
            remove_folder(spark, f"{self.path}/{SESSION_PART}={session}/{TOKEN_PART}={token}")
        spark.catalog.refreshByPath(self.path)
        if alive:
            self._write(kept(self.read(spark).filter(self._inside(alive))), "overwrite")

    def _write(self, rows: DataFrame, mode: str) -> None:
        """Rows of a part meet in one file, or in several where adaptive execution finds the part large."""
        spread = rows.hint("rebalance", *(F.col(part) for part in PARTS))
        spread.write.mode(mode).option("partitionOverwriteMode", "dynamic").partitionBy(*PARTS).parquet(self.path)
        rows.sparkSession.catalog.refreshByPath(self.path)
