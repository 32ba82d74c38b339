"""Sessions, history, quotas, caches and limits as batch queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def live_sessions(sessions: DataFrame, users: DataFrame, now: F.Column) -> DataFrame:
    """Sessions that expire after ``now`` with their users."""
    return sessions.where(F.col("expires_at") > now).join(users, "user_id")


def page(checks: DataFrame, user: F.Column, page_no: int, limit: int) -> DataFrame:
    """A page of a user's history, newest first, with totals; limit is held within 1 to 50."""
    limit, page_no = max(1, min(50, limit)), max(1, page_no)
    own = checks.where(F.col("user_id") == user)
    total = own.agg(F.count("*").alias("total"))
    rows = own.orderBy(F.desc("ts"), F.desc("event_id")).offset((page_no - 1) * limit).limit(limit)
    pages = F.ceil(F.col("total") / limit)
    return rows.crossJoin(F.broadcast(total)).withColumn("pages", pages.cast("long")).withColumn("has_next", F.lit(page_no) < pages).withColumn("has_prev", F.lit(page_no > 1))


def usage(checks: DataFrame, free: int = 3) -> DataFrame:
    """Each check with the user's running count and whether a free plan still allows it."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return checks.withColumn("used", F.count("*").over(w)).withColumn("allowed", F.col("used") <= free).withColumn("left", F.greatest(F.lit(free) - F.col("used"), F.lit(0)))


def rate_limits(requests: DataFrame, most: int = 10, period: str = "1 minute", slide: str | None = None) -> DataFrame:
    """Requests of each user and window, and whether they are over the limit."""
    w = F.window("ts", period, slide) if slide else F.window("ts", period)
    g = requests.groupBy(w.alias("w"), "user_id").agg(F.count("*").alias("n"))
    return g.select(F.col("w.start").alias("start"), "user_id", "n", (F.col("n") > most).alias("limited"))


def cache_hits(requests: DataFrame, ttl: int = 3600) -> DataFrame:
    """Each request of a key, and whether it hits: the last one that had to set the key is
    at most ``ttl`` seconds old. Hits don't renew a key.

    Sets are found by walking each key's requests in order, an array of times per key
    and day, as a set can't be told from the gap to the request before.
    """
    g = requests.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t")).groupBy("key").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    start = F.struct(F.lit(None).cast("long").alias("set"), F.lit(0).cast("long").alias("hits"))
    fresh = lambda s, t: s["set"].isNotNull() & (t - s["set"] <= ttl * 1_000_000)
    walked = F.aggregate("ts", start, lambda s, t: F.when(fresh(s, t), F.struct(s["set"].alias("set"), (s["hits"] + 1).alias("hits"))).otherwise(F.struct(t.alias("set"), s["hits"].alias("hits"))))
    return g.select("key", F.size("ts").cast("long").alias("requests"), walked["hits"].alias("hits"))


def lockouts(attempts: DataFrame, most: int = 5, lock_s: int = 900) -> DataFrame:
    """``(key, attempts, refused)``: the first failure opens a window of ``lock_s`` seconds;
    from ``most`` failures on, attempts in it are refused; a success clears it.

    ``attempts`` holds ``key, ts, ok``.
    """
    g = attempts.select("key", F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), "ok").alias("x")).groupBy("key").agg(F.array_sort(F.collect_list("x")).alias("xs"))
    start = F.struct(F.lit(0).cast("long").alias("fails"), F.lit(0).cast("long").alias("since"), F.lit(0).cast("long").alias("refused"))

    def step(s, x):
        old = (s["fails"] > 0) & (x["t"] - s["since"] > lock_s * 1_000_000)
        fails = F.when(old, F.lit(0).cast("long")).otherwise(s["fails"])
        locked = fails >= most
        state = lambda f, since, r: F.struct(f.cast("long").alias("fails"), since.alias("since"), r.alias("refused"))
        return F.when(locked, state(fails, s["since"], s["refused"] + 1)).when(x["ok"], state(F.lit(0), F.lit(0).cast("long"), s["refused"])).otherwise(state(fails + 1, F.when(fails == 0, x["t"]).otherwise(s["since"]), s["refused"]))

    return g.select("key", F.size("xs").cast("long").alias("attempts"), F.aggregate("xs", start, step)["refused"].alias("refused"))


def purged(tokens: DataFrame, now: F.Column, kind: str) -> DataFrame:
    """What the daily purge leaves: of resets those not expired, of verifications also
    those that were never used."""
    gone = F.col("expires_at") < now
    return tokens.where(~gone if kind == "resets" else ~(gone & F.col("used")))


def stats(checks: DataFrame, users: DataFrame) -> DataFrame:
    """One row: numbers of checks and users, and the average of the checks' values."""
    return checks.agg(F.count("*").alias("checks"), F.avg("value").alias("avg_value")).crossJoin(users.agg(F.count("*").alias("users")))
