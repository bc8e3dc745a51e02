"""Identities of events by canonical JSON, and fingerprints of price frames by CSV text."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.functions import canonical as N
from panelmill.plans.sql import BARS, with_
from panelmill.sources import bars as B

FORMS = ["spaced", "compact", "escaped", "expression"]
PRICES = ["open", "high", "low", "close", "volume", "amount"]


def canonical_identities(spark, sf_dir):
    """The digest of every event in each of the four JSON forms; equal events have equal identities, whatever the order of their fields."""
    rows = B.table(spark, sf_dir, "events").select("event_id", F.struct("user_id", "event_type", "value", "props", "event_id").alias("e"))
    return rows.select("event_id", *[N.identity(F.col("e"), rows.schema["e"].dataType, form).alias(form) for form in FORMS])


def _event(comma: str, colon: str) -> str:
    text = lambda c: f"""coalesce('"' || replace(replace({c}, '\\', '\\\\'), '"', '\\"') || '"', 'null')"""
    parts = {"event_id": "coalesce(event_id::VARCHAR, 'null')", "event_type": text("event_type"), "props": text("props"), "user_id": "coalesce(user_id::VARCHAR, 'null')", "value": "coalesce(value::VARCHAR, 'null')"}
    return "'{' || " + f" || '{comma}' || ".join(f"""'"{k}"{colon}' || {v}""" for k, v in parts.items()) + " || '}'"


IDENTITY_SQL = f"SELECT event_id, sha256({_event(', ', ': ')}) AS spaced, sha256({_event(',', ':')}) AS compact, sha256({_event(',', ':')}) AS escaped, sha1({_event(', ', ': ')}) AS expression FROM events"


def price_fingerprints(spark, sf_dir):
    """The first 20 hex digits of each instrument's CSV text, dates ascending, numbers with 12 digits.

    A text is one history, bounded by the calendar.
    """
    line = F.concat_ws(",", F.date_format("date", "yyyy-MM-dd"), *[N.general(F.col(c)) for c in PRICES])
    lines = B.daily_bars(spark, sf_dir).groupBy("code").agg(F.sort_array(F.collect_list(F.struct("date", line.alias("line")))).alias("lines"))
    names = ",".join(["date", *PRICES])
    text = F.concat(F.col("code"), F.lit(f":{names}\n{names}\n"), F.array_join(F.transform("lines", lambda x: F.concat(x["line"], F.lit("\n"))), ""))
    return lines.select("code", F.size("lines").cast("bigint").alias("rows"), F.substring(F.sha2(text, 256), 1, 20).alias("fingerprint"))


# printf keeps neither trailing zeros nor a bare point under %g, as C does.
_NAMES = ",".join(["date", *PRICES])
PRICES_SQL = with_(BARS) + f"""SELECT code, count(*) AS rows, substr(sha256(code || ':{_NAMES}' || chr(10) || '{_NAMES}' || chr(10) || string_agg(strftime(date, '%Y-%m-%d') || ',' || {" || ',' || ".join(f"printf('%.12g', {c})" for c in PRICES)} || chr(10), '' ORDER BY date)), 1, 20) AS fingerprint FROM bars GROUP BY code"""

QUERIES = {f.__name__: f for f in (canonical_identities, price_fingerprints)}
ORACLES = {"canonical_identities": IDENTITY_SQL, "price_fingerprints": PRICES_SQL}
