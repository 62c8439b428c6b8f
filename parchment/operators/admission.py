"""Admission accounting: anchored throttle windows and daily quotas on KST days.

Both are folds over a key's requests in time order, because a denied request changes what
later ones meet. Requests stream sorted through one state a key (``folds``); no key's
requests are gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parchment.functions.text import strip
from parchment.operators.folds import fold, open_quota_step, quota_step, throttle_step

WINDOW_MS, MOST = 60_000, 30
#: Daily characters a client and in all, by endpoint; unknown endpoints get the last.
CLIENT_LIMITS = {"translate": 50_000, "embed": 100_000, "chat": 100_000}
GLOBAL_LIMITS = {"translate": 500_000, "embed": 1_000_000, "chat": 1_000_000}
OTHER_CLIENT, OTHER_GLOBAL = 50_000, 500_000
CHAT_GLOBAL_CAP, CHAT_CLIENT_CAP = 30_000, 5_000
#: Characters of a message after trimming.
MOST_CHARS = {"chat": 2000, "translate": 3000}


def kst_day(ts: Column) -> Column:
    return F.date_format(ts + F.expr("INTERVAL 9 HOURS"), "yyyy-MM-dd")


def kst_seconds_left(ms: Column) -> Column:
    """Whole seconds to the next KST midnight, rounded up."""
    day = 86_400_000
    return F.ceil((day - F.pmod(ms + 9 * 3_600_000, F.lit(day))) / 1000).cast("bigint")


def client_ip(header: Column) -> Column:
    """The rightmost non-empty entry of x-forwarded-for, else ``unknown``."""
    some = F.filter(F.transform(F.split(header, ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.coalesce(F.element_at(F.when(F.size(some) > 0, some), -1), F.lit("unknown"))


def daily_limit(endpoint: Column, everyone: bool = False, limits: dict[str, int] | None = None, other: int | None = None) -> Column:
    """The endpoint's daily characters a client, or of all together; unknown and null endpoints get the last resort."""
    limits = limits or (GLOBAL_LIMITS if everyone else CLIENT_LIMITS)
    other = other or (OTHER_GLOBAL if everyone else OTHER_CLIENT)
    out = F.lit(other)
    for name, n in limits.items():
        out = F.when(endpoint == name, F.lit(n)).otherwise(out)
    return out


def usage_report(used: DataFrame, endpoints: list[str], keys: list[str], limit: Column) -> DataFrame:
    """used (keys, endpoint, used) -> (keys, endpoint, used, most, percent) for each key and each of the endpoints.

    Endpoints that a key never asked have a row of zero. limit: a column of ``endpoint``.
    """
    each = used.select(*keys).distinct().withColumn("endpoint", F.explode(F.array(*map(F.lit, endpoints))))
    all_rows = each.join(used.select(*keys, "endpoint", "used"), [*keys, "endpoint"], "left").withColumn("used", F.coalesce("used", F.lit(0).cast("bigint")))
    return all_rows.withColumn("most", limit.cast("bigint")).withColumn("percent", F.least(F.lit(100.0), F.round(100.0 * F.col("used") / F.col("most"))))


def throttle(requests: DataFrame, key: str = "key", ts: str = "ms", id_col: str = "id", window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """(key, id, denied, retry_after_ms, 0 if not denied): windows start at a key's first request after the last one ran out."""
    out = fold(requests.select(key, ts, id_col), [key], [ts, id_col], [ts], {"denied": "boolean", "retry_after_ms": "bigint"}, throttle_step(window_ms, most))
    return out.select(key, id_col, "denied", "retry_after_ms")


def quota(requests: DataFrame, keys: list[str], limit: Column, ts: str = "ms", id_col: str = "id", chars: str = "chars") -> DataFrame:
    """(keys, id, allowed, used): a request that would pass the limit is denied and costs nothing. limit: a column of keys."""
    rows = requests.select(*keys, ts, id_col, F.col(chars).cast("bigint").alias("chars"), limit.cast("bigint").alias("most"))
    out = fold(rows, keys, [ts, id_col], ["chars", "most"], {"allowed": "boolean", "used": "bigint"}, quota_step)
    return out.select(*keys, id_col, "allowed", "used")


def charged(rows: DataFrame) -> DataFrame:
    """rows (endpoint, day, client, ms, id, outcome, global_chars, global_limit, client_chars, client_limit) with the outcome decided.

    What has an outcome keeps it and costs nothing. The global charge of a day comes first and stays even if the
    client's quota then denies; the second fold depends on the first only through its outcomes, so each is a
    stream over its own keys.
    """
    all_day = fold(rows.withColumn("why", F.lit("global")), ["endpoint", "day"], ["ms", "id"], ["outcome", "global_chars", "global_limit", "why"], {"outcome": "string"}, open_quota_step)
    own = fold(all_day.withColumn("why", F.lit("client")), ["endpoint", "day", "client"], ["ms", "id"], ["outcome", "client_chars", "client_limit", "why"], {"outcome": "string"}, open_quota_step)
    return own.withColumn("outcome", F.coalesce("outcome", F.lit("ok"))).drop("why")


def admission(requests: DataFrame, client_limit: int, global_limit: int) -> DataFrame:
    """requests (endpoint, day, client, ms, id, chars) -> (endpoint, day, id, outcome): both charges."""
    chars = F.col("chars").cast("bigint")
    rows = requests.select("endpoint", "day", "client", "ms", "id", F.lit(None).cast("string").alias("outcome"), chars.alias("global_chars"), chars.alias("client_chars"))
    rows = rows.withColumn("global_limit", F.lit(global_limit).cast("bigint")).withColumn("client_limit", F.lit(client_limit).cast("bigint"))
    return charged(rows).select("endpoint", "day", "id", "outcome")


def is_object(body: Column) -> Column:
    """Whether a text is a JSON object; null if it isn't JSON at all."""
    kind = F.schema_of_variant(F.try_parse_json(body))
    return F.when(F.try_parse_json(body).isNotNull(), kind.startswith("OBJECT"))


def validation(endpoint: Column, body: Column, message: Column) -> Column:
    """The reason for which a request is refused before anything is charged, null if there is none."""
    own = strip(F.coalesce(message, F.lit("")))
    most = F.when(endpoint == "chat", MOST_CHARS["chat"]).otherwise(MOST_CHARS["translate"])
    return F.when(is_object(body).isNull(), "bad_json").when(~is_object(body), "bad_body").when(own == "", "empty").when(F.length(own) > most, "too_long")


def admission_full(requests: DataFrame, client_limit: Column, global_limit: Column, window_ms: int = WINDOW_MS, most: int = MOST) -> DataFrame:
    """requests (endpoint, client, ms, day, id, body, message, suspect, context_chars) -> (endpoint, client, day, id, outcome, retry_after_ms).

    In this order: the client's window at the endpoint, which counts requests whatever becomes of them; validation;
    screening (chat only; ``suspect`` says whether the conversation so far is), which answers without a charge; the endpoint's
    day; the client's day. outcome: throttled, bad_json, bad_body, empty, too_long, screened, global, client or ok. Chat charges the message and
    its context, up to a cap each for both quotas, translation the message.
    """
    chat = F.col("endpoint") == "chat"
    own = F.length(strip(F.coalesce("message", F.lit("")))).cast("bigint")
    n = F.when(chat, own + F.coalesce("context_chars", F.lit(0))).otherwise(own)
    refused = F.coalesce(validation(F.col("endpoint"), F.col("body"), F.col("message")), F.when(chat & F.coalesce("suspect", F.lit(False)), "screened"))
    rows = requests.select(
        "endpoint", "client", "day", "ms", "id", refused.alias("refused"), global_limit.cast("bigint").alias("global_limit"), client_limit.cast("bigint").alias("client_limit"),
        F.when(chat, F.least(n, F.lit(CHAT_GLOBAL_CAP))).otherwise(n).cast("bigint").alias("global_chars"), F.when(chat, F.least(n, F.lit(CHAT_CLIENT_CAP))).otherwise(n).cast("bigint").alias("client_chars"),
    )
    seen = fold(rows, ["endpoint", "client"], ["ms", "id"], ["ms"], {"denied": "boolean", "retry_after_ms": "bigint"}, throttle_step(window_ms, most))
    decided = seen.withColumn("outcome", F.when(F.col("denied"), "throttled").otherwise(F.col("refused"))).drop("denied", "refused")
    return charged(decided).select("endpoint", "client", "day", "id", "outcome", "retry_after_ms")


def usage_level(percent: Column) -> Column:
    """low if at most 15 remain, depleted if none."""
    left = 100 - F.greatest(F.lit(0), F.least(F.lit(100), percent))
    return F.when(left <= 0, "depleted").when(left <= 15, "low").otherwise("ok")


def usage_color(*percents: Column) -> Column:
    """red from 90 percent of the fullest quota, amber from 70."""
    most = F.greatest(*percents) if len(percents) > 1 else percents[0]
    return F.when(most >= 90, "red").when(most >= 70, "amber").otherwise("gray")
