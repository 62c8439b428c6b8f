"""Prompt-injection and leak screening of messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from parchment.functions import fixed_values as V
from parchment.functions.fold import tables
from parchment.functions.text import strip

BLOCKED = "Sorry, I can only answer questions about this paper."


def compatible(text: Column) -> Column:
    """Compatibility forms replaced, accents left (composed text in, composed text out).

    Only characters with a compatibility mapping change; texts without any go through as they are.
    """
    import unicodedata

    source, target, grow = tables()
    one, to, many = [], [], {}
    for c in [*source, *grow]:
        k = unicodedata.normalize("NFKC", c)
        if k == c:
            continue
        if len(k) == 1:
            one.append(c), to.append(k)
        else:
            many[c] = k
    some = "[" + "".join(sorted(many)) + "]"
    grown = F.create_map(*(F.lit(x) for c, k in many.items() for x in (c, k)))
    by_char = F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(grown, c), c)), "")
    plain = text.rlike(r"^[\x00-\x7F]*$")
    return F.when(plain, text).otherwise(F.translate(F.when(text.rlike(some), by_char).otherwise(text), "".join(one), "".join(to)))


def normalize(text: Column) -> Column:
    """Compatibility forms and invisible characters removed, runs of white space other than line ends made one space."""
    t = F.regexp_replace(compatible(text), "[\\x{200B}-\\x{200F}\\x{2028}-\\x{202F}\\x{FEFF}]", "")
    return strip(F.regexp_replace(t, "[\\s\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{205F}\\x{3000}&&[^\\n]]+", " "))


def injection(text: Column) -> Column:
    """Whether any pattern fits the normalised text. ``.`` stops at line ends."""
    t = normalize(text)
    out = F.lit(False)
    for p in V.EN_INJECTION:
        out = out | t.rlike("(?i)" + p)
    for p in V.KO_INJECTION:
        out = out | t.rlike(p)
    return out


def leak(text: Column) -> Column:
    t = compatible(text)
    out = F.lit(False)
    for p in V.LEAKS:
        out = out | F.contains(t, F.lit(p))
    return out


def screen_conversations(messages: DataFrame) -> DataFrame:
    """(conv_id, flagged): any message of any role."""
    return messages.groupBy("conv_id").agg(F.bool_or(injection(F.coalesce("text", F.lit("")))).alias("flagged"))


def outcomes(messages: DataFrame) -> DataFrame:
    """Each user message with what answers it: blocked, leak (the next reply is replaced) or reply."""
    from pyspark.sql import Window

    text = F.coalesce("text", F.lit(""))
    m = messages.withColumn("inj", injection(text)).withColumn("leaky", leak(text))
    w = Window.partitionBy("conv_id").orderBy("turn")
    seen = F.max("inj").over(w.rowsBetween(Window.unboundedPreceding, 0))
    m = m.withColumn("seen", seen).withColumn("next_role", F.lead("role").over(w)).withColumn("next_leaky", F.lead("leaky").over(w))
    kind = F.when(F.col("seen"), "blocked").when((F.col("next_role") == "assistant") & F.col("next_leaky"), "leak").otherwise("reply")
    return m.filter("role = 'user'").select("conv_id", "turn", kind.alias("outcome"))


def client_history(messages: DataFrame, is_error: str) -> DataFrame:
    """messages (conv_id, turn, role, text, is_error) before the newest of each conversation, without errors; role user or model."""
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id")
    rows = messages.withColumn("newest", F.max("turn").over(w)).filter(F.col("turn") < F.col("newest")).filter(~F.coalesce(is_error, F.lit(False)))
    return rows.withColumn("role", F.when(F.col("role") == "user", "user").otherwise("model")).drop("newest")
