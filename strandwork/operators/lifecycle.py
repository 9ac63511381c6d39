"""Life of history entries: begun, applied, tested, undone; what comes out of order is refused, what waits too long expires."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Actions and the states they lead from and to; a pending entry lives a day.
ACTIONS = {"begin": (("NONE", "UNDONE", "EXPIRED"), "PENDING"), "finalize": (("PENDING",), "APPLIED"), "pass": (("APPLIED",), "APPLIED"), "fail": (("APPLIED",), "APPLIED"), "undo": (("APPLIED",), "UNDONE")}
TESTS = {"pass": "PASSED", "fail": "FAILED"}
LIFE_MS = 24 * 3600 * 1000
STATE = "status string, test_status string, since long, refused int"
FRESH = ("NONE", "NOT_RUN", None, 0)


def step(state: tuple, at: int, action: str) -> tuple:
    """(status, test_status, since, refused) after an action at a time in ms; the plain form of the rule."""
    status, tests, since, refused = state
    if status == "PENDING" and at - since > LIFE_MS:
        status = "EXPIRED"
    frm, to = ACTIONS.get(action, ((), None))
    if status not in frm:
        return status, tests, since, refused + 1
    if action in TESTS:
        return status, TESTS[action], since, refused
    return to, "NOT_RUN" if action == "begin" else tests, at, refused


def replayed(events: DataFrame, *keys: str, now: Column | None = None) -> DataFrame:
    """(keys..., status, test_status, since, refused) of entries after events(keys..., at, event_id, action), whatever order they come in.

    at is in ms; events of one time go by id. A pending entry that is older than a day at the
    next event, or at `now`, is EXPIRED. Unknown actions and those out of order are refused.
    An entry's events are folded in one row, so an entry should have thousands of them at most.
    """
    of = lambda status, test, since, refused: F.struct(F.lit(status).alias("status") if isinstance(status, str) else status.alias("status"), test.alias("test_status"), since.cast("long").alias("since"), refused.cast("int").alias("refused"))

    def fold(s: Column, e: Column) -> Column:
        late = (s["status"] == "PENDING") & (e["at"] - s["since"] > LIFE_MS)
        status = F.when(late, F.lit("EXPIRED")).otherwise(s["status"])
        out = of(status, s["test_status"], s["since"], s["refused"] + 1)
        for action, (frm, to) in ACTIONS.items():
            fits = (e["action"] == action) & status.isin(*frm)
            tests = F.lit(TESTS[action]) if action in TESTS else F.lit("NOT_RUN") if action == "begin" else s["test_status"]
            out = F.when(fits, of(status if action in TESTS else to, tests, s["since"] if action in TESTS else e["at"], s["refused"])).otherwise(out)
        return out

    rows = F.array_sort(F.collect_list(F.struct("at", "event_id", F.coalesce("action", F.lit("")).alias("action"))))
    first = of("NONE", F.lit("NOT_RUN"), F.lit(None), F.lit(0))
    done = events.groupBy(*keys).agg(F.aggregate(rows, first, fold).alias("s")).select(*keys, "s.*")
    if now is None:
        return done
    return done.withColumn("status", F.when((F.col("status") == "PENDING") & (now - F.col("since") > LIFE_MS), "EXPIRED").otherwise(F.col("status")))
