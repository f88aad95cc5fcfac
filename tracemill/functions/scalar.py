"""Scalar functions of trace analysis, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Rewrites of operation names, applied in this order.
REWRITES = (
    (r"/T\d{4}-\d{2}-\d{2}_\d{5,10}", "/{TIME}"),
    (r"/\d{4}-\d{2}-\d{2}_\d{5,10}", "/{TIME2}"),
    (r"/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-99-f]{12}", "/{SAVINGS}"),
    (r"/[a-zA-Z0-9\-_]{39,40}={0,1}/", "/{BASE}/"),
    (r"\-\d{5,9}\-20\d{2}", "-{VIEW}"),
    (r"/\d{6,10}", "/{ACCOUNT}"),
)
#: The others need a hyphen, or 41 characters: texts without either skip their searches, which are most of what spans cost.
SHORT_REWRITES = tuple(r for r in REWRITES if r[1] == "/{ACCOUNT}")
#: Span kinds and the direction of a call.
DIRECTIONS = {"server": "Inbound", "consumer": "Inbound", "client": "Outbound", "producer": "Outbound"}
#: Names of months in labels.
MONTHS = ("Jan", "Febr", "March", "April", "May", "June", "July", "Aug", "Sept", "Oct", "Nov", "Dec")
#: Operations that are plain requests, the root of traces without one, and the mark of a leaf.
CACHED_OPERATIONS = ("GET", "POST", "HEAD", "QUERY")
UNKNOWN_ROOT = "_UNKNOWN_"
LEAF = " *LEAF*"


def unify_operation(op: Column) -> Column:
    """Parameters in an operation's path replaced by their kind."""
    out, short = op, op
    for pattern, name in REWRITES:
        out = F.regexp_replace(out, pattern, name)
    for pattern, name in SHORT_REWRITES:
        short = F.regexp_replace(short, pattern, name)
    return F.when(F.contains(op, F.lit("-")) | (F.length(op) > 40), out).otherwise(short)


def call_direction(kind: Column) -> Column:
    out = F.lit("Unknown")
    for k, v in DIRECTIONS.items():
        out = F.when(kind == k, F.lit(v)).otherwise(out)
    return out


def endpoint_key(s: Column) -> Column:
    return F.translate(s, "/\\;:", "____")


def escape_label(s: Column) -> Column:
    return F.translate(s, " {}()", "_____")


def format_float(x: Column, decimal_comma: bool = True, missing: str = "--") -> Column:
    text = F.format_string("%.6f", x)
    return F.coalesce(F.translate(text, ".", ",") if decimal_comma else text, F.lit(missing))


def truncate_message(msg: Column, most: int = 100) -> Column:
    """Messages of more than `most` bytes cut to as many characters, and marked."""
    return F.when(F.octet_length(msg) > most, F.concat(F.substring(msg, 1, most), F.lit("...TRUNCATED"))).otherwise(msg)


def http_not_ok(code: Column) -> Column:
    return code.isNotNull() & (code != 200)


def call_text(c: Column) -> Column:
    """service/operation, and the direction in brackets unless it is unknown."""
    name = F.concat(c["service"], F.lit("/"), c["operation"])
    return F.when(c["call_direction"] == "Unknown", name).otherwise(F.concat(name, F.lit(" ["), c["call_direction"], F.lit("]")))


def plain_call(c: Column) -> Column:
    """service/operation."""
    return F.concat(c["service"], F.lit("/"), c["operation"])


def chain_key(chain: Column, caching: Column, is_leaf: Column) -> Column:
    return F.concat(F.array_join(F.transform(chain, call_text), " | "), F.lit(" & "), caching, F.lit("& "), F.when(is_leaf, F.lit(LEAF)).otherwise(F.lit("")))


def parse_chain(key: Column) -> Column:
    """struct(chain, caching, is_leaf) of a text that chain_key made."""
    parts = F.split(key, "&")

    def call(x: Column) -> Column:
        x = F.trim(x)
        direction = F.regexp_extract(x, r" \[(\w+)\]$", 1)
        name = F.regexp_replace(x, r" \[\w+\]$", "")
        return F.struct(
            F.regexp_extract(name, r"^([^/]+)/(.+)$", 1).alias("service"), F.regexp_extract(name, r"^([^/]+)/(.+)$", 2).alias("operation"),
            F.when(direction == "", F.lit("Unknown")).otherwise(direction).alias("call_direction"),
        )

    return F.struct(F.transform(F.split(F.get(parts, F.lit(0)), r"\|"), call).alias("chain"), F.trim(F.get(parts, F.lit(1))).alias("caching"), F.contains(F.get(parts, F.lit(2)), F.lit("*LEAF*")).alias("is_leaf"))


def inbound_key(chain: Column) -> Column:
    """The inbound calls of a chain; its first call where there is none."""
    own = F.filter(chain, lambda c: c["call_direction"] == "Inbound")
    plain = lambda c: F.concat(c["service"], F.lit("/"), c["operation"])
    return F.when(F.size(own) > 0, F.array_join(F.transform(own, plain), ", ")).otherwise(plain(F.get(chain, F.lit(0))))


def caching_label(services: list[str], chain: Column) -> Column:
    """The listed services of a chain whose operation isn't a plain request, as " [a, b]"; else empty."""
    hit = F.filter(chain, lambda c: c["service"].isin(services) & ~c["operation"].isin(*CACHED_OPERATIONS))
    return F.when(F.size(hit) > 0, F.concat(F.lit(" ["), F.array_join(F.transform(hit, lambda c: c["service"]), ", "), F.lit("]"))).otherwise(F.lit(""))


def looped(chain: Column) -> Column:
    """Services that come again at a distance of two calls or more, in order of their first appearance."""
    names = F.transform(chain, lambda c: c["service"])
    again = F.filter(names, lambda s, i: F.array_contains(F.slice(names, i + 3, F.greatest(F.size(names), F.lit(1))), s))
    return F.array_distinct(again)


def chain_type(rooted: Column, is_leaf: Column) -> Column:
    return F.when(rooted & is_leaf, "end2end").when(rooted, "partial").when(is_leaf, "unrooted-leaf").otherwise("floating")


def month_label(description: Column, index: Column) -> Column:
    """Month-day (without leading zero) of the first yyyymmdd in a description; else the index."""
    day = F.regexp_extract(description, r"\d{4}(0[1-9]|1[0-2])([0-2]\d|3[01])", 2)
    month = F.regexp_extract(description, r"\d{4}(0[1-9]|1[0-2])([0-2]\d|3[01])", 1)
    name = F.element_at(F.array(*map(F.lit, MONTHS)), F.greatest(F.coalesce(month.try_cast("int"), F.lit(1)), F.lit(1)))
    return F.when(day != "", F.concat(name, F.lit("-"), day.try_cast("int").cast("string"))).otherwise(index.cast("string"))


def string_hash(s: Column) -> Column:
    """16 hexadecimal digits that stand for a text."""
    return F.upper(F.substring(F.md5(s), 1, 16))


DAY_US = 86_400_000_000


def datetime_text(us: Column, offset_minutes: int = 0, millis: bool = False) -> Column:
    """yyyy-mm-dd hh:mm:ss and the fraction, of µs since 1970 moved by an offset from UTC. The session's time zone doesn't matter."""
    x = us + F.lit(60_000_000 * offset_minutes)
    day = F.date_add(F.lit("1970-01-01").cast("date"), F.floor(x / F.lit(DAY_US)).cast("int")).cast("string")
    s = F.pmod(x, F.lit(DAY_US))
    part = lambda unit, of: F.pmod(F.floor(s / F.lit(unit)), F.lit(of))
    rest = F.format_string("%03d", part(1000, 1000)) if millis else F.format_string("%06d", part(1, 1_000_000))
    return F.concat(day, F.format_string(" %02d:%02d:%02d.", part(3_600_000_000, 24), part(60_000_000, 60), part(1_000_000, 60)), rest)


def datetime_micros(text: Column, offset_minutes: int = 0) -> Column:
    """µs since 1970 of a text that datetime_text made with the same offset."""
    number = lambda at, n: F.substring(text, at, n).cast("long")
    days = F.datediff(F.substring(text, 1, 10).cast("date"), F.lit("1970-01-01").cast("date")).cast("long")
    fraction = F.rpad(F.substring(text, 21, 6), 6, "0").cast("long")
    return days * DAY_US + number(12, 2) * 3_600_000_000 + number(15, 2) * 60_000_000 + number(18, 2) * 1_000_000 + fraction - 60_000_000 * offset_minutes
