"""View state: clamping, tab movement, visible pages, retry gate, error messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parchment.operators.admission import throttle

RETRY_MS = 60_000

# What a reader sees for an error code (where details are shown they replace or follow the text).
MESSAGES = {
    "TRANSLATE_QUOTA_EXCEEDED": "오늘의 번역 사용 횟수를 초과했습니다. (일일 50회 제한)",
    "RATE_LIMITED": "요청이 너무 많습니다. 잠시 후 다시 시도해주세요.",
    "SERVER_ERROR": "서버 오류",
    "API_ERROR": "API 오류",
    "TIMEOUT": "요청 시간이 초과되었습니다. 다시 시도해주세요.",
    "NETWORK_ERROR": "네트워크 오류가 발생했습니다. 인터넷 연결을 확인해주세요.",
    "ALREADY_KOREAN": "이미 한국어 텍스트입니다. 영어 텍스트를 선택하면 한국어로 번역됩니다.",
}
UNKNOWN = "알 수 없는 오류가 발생했습니다."


def clamp(value: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, value))


def tab_index(key: Column, current: Column, count: Column) -> Column:
    """The tab that a key moves to, around the ends; null for other keys or without tabs."""
    to = F.when(key.isin("ArrowRight", "ArrowDown"), (current + 1) % count).when(key.isin("ArrowLeft", "ArrowUp"), (current - 1 + count) % count).when(key == "Home", 0).when(key == "End", count - 1)
    return F.when(count > 0, to)


def visible_pages(page: Column, n_pages: Column, around: int = 2) -> Column:
    """The pages kept drawn around one, within the document."""
    return F.sequence(F.greatest(page - around, F.lit(1)), F.least(page + around, n_pages))


def retry_gate(refusals: DataFrame, key: str = "key", ms: str = "ms", id_col: str = "id") -> DataFrame:
    """(key, id, retry_at): the first refusal closes a key's gate for a minute, later ones in it change nothing."""
    g = throttle(refusals, key, ms, id_col, RETRY_MS, 0)
    return refusals.select(key, id_col, ms).join(g, [key, id_col]).select(key, id_col, (F.col(ms) + F.col("retry_after_ms")).alias("retry_at"))


def error_message(code: Column, detail: Column) -> Column:
    shown = (F.length(detail) > 0) & detail.isNotNull()
    out = F.when(code == "RATE_LIMITED", F.when(shown, detail).otherwise(MESSAGES["RATE_LIMITED"]))
    out = out.when((code == "SERVER_ERROR") & shown, F.concat(F.lit("서버 오류 ("), detail, F.lit(")"))).when((code == "API_ERROR") & shown, F.concat(F.lit("오류: "), detail))
    for c, text in MESSAGES.items():
        out = out.when(code == c, text)
    return out.otherwise(UNKNOWN)


MODES, TABS = ("scroll", "page"), ("search", "keywords", "chat")


def migrated(saved: DataFrame, state: str = "state") -> DataFrame:
    """saved with (seen, translate, chat, day, mode, tab) from the JSON text of a state; what isn't well typed or known gets its default.

    The daily usage is taken as a whole: both counts numbers and the day a text, or none of it.
    """
    v = F.try_parse_json(state)
    part = lambda path: F.try_variant_get(v, path, "variant")
    kind = lambda path: F.schema_of_variant(part(path))
    number = lambda path: F.coalesce(kind(path).rlike("^(BIGINT|DOUBLE|DECIMAL.*)$"), F.lit(False))
    text = lambda path: F.when(kind(path) == "STRING", F.try_variant_get(v, path, "string"))
    used = number("$.dailyUsage.translate") & number("$.dailyUsage.chat") & text("$.dailyUsage.date").isNotNull()
    count = lambda path: F.when(used, F.try_variant_get(v, path, "double")).otherwise(0.0)
    one_of = lambda path, known: F.when(text(path).isin(*known), text(path)).otherwise(known[0])
    return saved.select(
        "*", F.coalesce(F.when(kind("$.hasSeenTutorial") == "BOOLEAN", F.try_variant_get(v, "$.hasSeenTutorial", "boolean")), F.lit(False)).alias("seen"), count("$.dailyUsage.translate").alias("translate"),
        count("$.dailyUsage.chat").alias("chat"), F.when(used, text("$.dailyUsage.date")).otherwise("").alias("day"), one_of("$.viewerMode", MODES).alias("mode"), one_of("$.sidebarTab", TABS).alias("tab"),
    )
