"""Registration, tokens and updates of account tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from provena.functions import text as tx

EMAIL = r"^[^@\s]+@[^@\s]+\.[^@\s]+$"
LEAST_NAME, LEAST_PASSWORD = 2, 6


def registration_error(name: Column, email: Column, password: Column) -> Column:
    """Why a registration is refused: name, password, email, in this order; null if it isn't."""
    n = lambda c: F.coalesce(F.length(c), F.lit(0))
    bad = ~F.coalesce(tx.strip(email), F.lit("")).rlike(EMAIL)
    return F.when(n(tx.strip(name)) < LEAST_NAME, "name").when(n(password) < LEAST_PASSWORD, "password").when(bad, "email")


def registered(users: DataFrame, requests: DataFrame) -> DataFrame:
    """The new rows of ``users`` (``user_id, name, email``) that valid requests make, with
    trimmed names and lower-case emails; of an email that is taken or asked for twice, the
    taken one stays, else the request with the smallest id."""
    ok = requests.where(registration_error(F.col("name"), F.col("email"), F.col("password")).isNull())
    ok = ok.select("user_id", tx.strip(F.col("name")).alias("name"), F.lower(tx.strip(F.col("email"))).alias("email"))
    ok = ok.join(users.select("email"), "email", "left_anti")
    return ok.groupBy("email").agg(F.min(F.struct("user_id", "name")).alias("x")).select("x.user_id", "x.name", "email")


def valid_tokens(tokens: DataFrame, now: Column) -> DataFrame:
    """Tokens that were not used and expire after ``now``."""
    return tokens.where((F.col("expires_at") > now) & ~F.coalesce("used", F.lit(False)))


def email_status(users: DataFrame, meta: DataFrame) -> DataFrame:
    """``(user_id, email_verified, verified_at)``; a user without a row in ``meta`` isn't verified."""
    yes = F.coalesce("email_verified", F.lit(False))
    return users.select("user_id").join(meta, "user_id", "left").select("user_id", yes.alias("email_verified"), F.when(yes, F.col("verified_at")).alias("verified_at"))


def updated(table: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """``table`` with the columns of ``changes`` set in rows with the same key; other rows and
    columns stay, and keys that the table lacks are ignored."""
    new = [c for c in changes.columns if c != key]
    rows = table.join(changes.select(key, F.lit(True).alias("hit_"), *[F.col(c).alias(c + "_new_") for c in new]), key, "left")
    return rows.select(*[F.when(F.col("hit_"), F.col(c + "_new_")).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in table.columns])
