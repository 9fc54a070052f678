"""Scalar Column functions (kind, sizes, states, argument parsing, urls).

All are built-in expressions: they stay inside whole-stage codegen.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, functions as F

from meshframes.schema import (
    KIND_BINARY,
    KIND_TEXT,
    STATE_LABELS,
    STATE_NAMES,
    TRUE_FLAGS,
    UNKNOWN_STATE,
)

_LOWER = string.ascii_lowercase
_UPPER = string.ascii_uppercase
# Unicode-aware outer whitespace, like Rust's str::trim.
_TRIM_RE = r"(?U)^\s+|\s+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def kind_of(is_text) -> Column:
    """1 for text frames, 2 for binary ones."""
    return F.when(_c(is_text), F.lit(KIND_TEXT)).otherwise(F.lit(KIND_BINARY)).cast("tinyint")


def payload_bytes(payload) -> Column:
    """Payload length in bytes (the envelope is not counted)."""
    return F.octet_length(_c(payload)).cast("long")


def ascii_upper(c) -> Column:
    """Upper-case a-z only (``upper`` would also fold e.g. German sharp s)."""
    return F.translate(_c(c), _LOWER, _UPPER)


def ascii_lower(c) -> Column:
    return F.translate(_c(c), _UPPER, _LOWER)


def unicode_trim(c) -> Column:
    return F.regexp_replace(_c(c), _TRIM_RE, "")


def state_name(code) -> Column:
    """State code 0..7 to its name; any other code reads as disconnected."""
    names = F.create_map(*[x for i, n in enumerate(STATE_NAMES) for x in (F.lit(i), F.lit(n))])
    return F.coalesce(F.element_at(names, _c(code).cast("int")), F.lit(UNKNOWN_STATE))


def state_code(name) -> Column:
    """State name to code; null for a name that is not a state."""
    codes = F.create_map(*[x for i, n in enumerate(STATE_NAMES) for x in (F.lit(n), F.lit(i))])
    return F.element_at(codes, _c(name)).cast("tinyint")


def parse_flag(text) -> Column:
    """Absent is false; trimmed, lower-cased '', 1, true, yes, on are true."""
    return F.coalesce(ascii_lower(unicode_trim(_c(text))).isin(*TRUE_FLAGS), F.lit(False))


def parse_csv_list(text) -> Column:
    """P10: split on commas, trim, drop blanks and repeats (first order kept)."""
    parts = F.transform(F.split(_c(text), ","), lambda x: unicode_trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != F.lit("")))


def effective_window(requested, default_s, max_s, enabled=None) -> Column:
    """Max at least 1; default and requested clamped to 1..max; null when off."""
    mx = F.greatest(_c(max_s).cast("long"), F.lit(1).cast("long"))
    dflt = F.least(F.greatest(_c(default_s).cast("long"), F.lit(1).cast("long")), mx)
    r = _c(requested).cast("long")
    # greatest/least skip nulls, so an absent request must be tested first
    secs = F.when(r.isNull(), dflt).otherwise(F.least(F.greatest(r, F.lit(1).cast("long")), mx))
    return secs if enabled is None else F.when(_c(enabled), secs)


def is_live(state) -> Column:
    """Only 'connected' is live."""
    return F.coalesce(_c(state) == F.lit("connected"), F.lit(False))


def state_label(state) -> Column:
    """Status page label of a state name."""
    expr = _c(state)
    out = None
    for name, label in STATE_LABELS.items():
        out = (F.when(expr == name, F.lit(label)) if out is None else out.when(expr == name, F.lit(label)))
    return out.otherwise(expr)


#: Fixed values of the URL Standard: default ports, and characters that need no percent-encoding in a path, a query and a user name.
DEFAULT_PORTS = {"ws": "80", "wss": "443"}
_PATH_SAFE = r"\x21\x24-\x3b\x3d\x40-\x5d\x5f\x61-\x7a\x7c\x7e"
_QUERY_SAFE = r"\x21\x24-\x26\x28-\x3b\x3d\x3f-\x7e"
_USER_SAFE = r"\x21\x24-\x2e\x30-\x39\x41-\x5a\x5f\x61-\x7a\x7e"
#: Characters that no host may hold once percent-encoding is undone.
_HOST_FORBIDDEN = r"[\x00-\x20\x7f#/<>?@\[\\\]^|%]"
#: scheme, what follows its slashes (authority, rest of the path, query).
_SPECIAL_URL = r"^([A-Za-z][A-Za-z0-9+.\-]*):[/\\]*([^/\\?#]*)([^?#]*)(\?[^#]*)?"
_ONE_DOT = r"^(?i)(\.|%2e)$"
_TWO_DOTS = r"^(?i)(\.|%2e)(\.|%2e)$"
_OUTER_CONTROLS = "^[\x00-\x20]+|[\x00-\x20]+$"


def _let(value: Column, body) -> Column:
    """``body(value)``, with the value computed once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _percent_encoded(text: Column, safe: str) -> Column:
    """Characters outside of ``safe`` as the ``%XX`` of their UTF-8 bytes."""
    one = lambda c: F.when(c.rlike(f"[^{safe}]"), F.regexp_replace(F.hex(F.encode(c, "UTF-8")), "(..)", "%$1")).otherwise(c)
    spelled = F.array_join(F.transform(F.split(text, ""), one), "")
    return F.when(text.rlike(f"[^{safe}]"), spelled).otherwise(text)


def _without_dots(path: Column) -> Column:
    """The path after its first slash without ``.`` and ``..`` segments, as segments."""
    parts = F.split(F.regexp_replace(path, r"^[/\\]", ""), r"[/\\]")
    ends = F.element_at(parts, -1)
    parts = F.when(ends.rlike(_ONE_DOT) | ends.rlike(_TWO_DOTS), F.concat(parts, F.array(F.lit("")))).otherwise(parts)

    def step(done: Column, part: Column) -> Column:
        up = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(part.rlike(_TWO_DOTS), up).when(part.rlike(_ONE_DOT), done).otherwise(F.concat(done, F.array(part)))

    return F.aggregate(parts, F.array().cast("array<string>"), step)


def _ipv4(host: Column) -> Column:
    """A host whose last label is a number, as four decimal numbers; null if it is no address."""
    labels = F.split(F.regexp_replace(host, r"\.$", ""), r"\.")
    number = lambda x: (
        F.when(x.rlike("^0x[0-9a-f]{0,15}$"), F.conv(F.concat(F.lit("0"), F.substring(x, 3, 20)), 16, 10))
        .when(x.rlike("^0[0-7]{1,20}$"), F.conv(x, 8, 10))
        .when(x.rlike("^(0|[1-9][0-9]{0,17})$"), x)
        .cast("long")
    )
    values = F.transform(labels, number)
    n = F.size(labels)
    last = F.element_at(values, -1)
    heads = F.slice(values, F.lit(1), F.greatest(n - 1, F.lit(0)))
    fits = (n <= 4) & F.coalesce(last < F.element_at(F.array(*[F.lit(256**k) for k in (4, 3, 2, 1)]), F.least(n, F.lit(4))), F.lit(False))
    fits = fits & F.forall(heads, lambda v: F.coalesce(v < 256, F.lit(False)))
    weight = lambda i: F.element_at(F.array(*[F.lit(256**k) for k in (3, 2, 1, 0)]), i + 1)
    whole = F.aggregate(F.transform(heads, lambda v, i: v * weight(F.least(i, F.lit(3)))), F.lit(0).cast("long"), lambda a, v: a + v) + last
    return F.when(fits, F.concat_ws(".", *[(F.shiftright(whole, k).bitwiseAND(F.lit(255))).cast("string") for k in (24, 16, 8, 0)]))


def _host(text: Column) -> Column:
    """A host as the URL Standard writes it; null if it is none. Not done: punycode of non-ASCII names, short forms of IPv6."""
    plain = F.when(text.contains("%"), F.try_url_decode(F.replace(text, F.lit("+"), F.lit("%2B")))).otherwise(text)
    six = F.when(text.rlike(r"^\[[0-9A-Fa-f:.]*:[0-9A-Fa-f:.]*\]$"), F.lower(text))

    def named(name: Column) -> Column:
        numeric = name.rlike(r"(^|\.)([0-9]+|0x[0-9a-f]*)\.?$")
        return F.when((name != "") & ~name.rlike(_HOST_FORBIDDEN), F.when(numeric, _ipv4(name)).otherwise(name))

    return F.when(text.startswith("["), six).otherwise(_let(F.lower(plain), named))


def websocket_url(url) -> Column:
    """http(s) -> ws(s), ws/wss kept, anything else null (rejected).

    The url is read as the URL Standard reads it: outer controls and spaces, and tabs and line breaks anywhere, don't
    count; any number of slashes (or backslashes) follows the scheme; scheme and host are lower-cased; a port is a number up to 65535 and dropped
    if it is the scheme's own; ``.`` and ``..`` segments are resolved; characters that may not stand there are percent-encoded.
    Then trailing slashes are cut from the path and ``/ws`` appended, unless the cut path
    already ends in ``/ws`` (then the path is left as it was). The fragment is dropped, the query kept.
    """
    u = F.regexp_replace(F.regexp_replace(_c(url), _OUTER_CONTROLS, ""), "[\t\n\r]", "")
    return _let(u, _as_websocket)


def _as_websocket(u: Column) -> Column:
    scheme = F.lower(F.regexp_extract(u, _SPECIAL_URL, 1))
    new_scheme = F.when(scheme.isin("https", "wss"), F.lit("wss")).when(scheme.isin("http", "ws"), F.lit("ws"))
    query = _let(F.regexp_extract(u, _SPECIAL_URL, 4), lambda q: _percent_encoded(q, _QUERY_SAFE))
    path = _let(F.concat(F.lit("/"), F.array_join(_let(F.regexp_extract(u, _SPECIAL_URL, 3), _without_dots), "/")), lambda p: _percent_encoded(p, _PATH_SAFE))

    def with_ws(p: Column) -> Column:
        return _let(F.regexp_replace(p, "/+$", ""), lambda cut: F.when(cut.endswith("/ws"), p).otherwise(F.concat(cut, F.lit("/ws"))))

    # what is no address makes the whole null
    return _let(new_scheme, lambda s: F.concat(s, F.lit("://"), _let(F.regexp_extract(u, _SPECIAL_URL, 2), lambda a: _authority(a, s)), _let(path, with_ws), query))


def _authority(text: Column, scheme: Column) -> Column:
    """User, host and port as the URL Standard writes them; null if there is no such host or port."""
    users = F.regexp_extract(text, "^(.*)@", 1)
    name = _percent_encoded(F.regexp_extract(users, "(?s)^([^:]*)", 1), _USER_SAFE)
    word = _percent_encoded(F.regexp_extract(users, "(?s)^[^:]*:(.*)$", 1), _USER_SAFE)
    user = _let(F.concat(name, _let(word, lambda w: F.when(w != "", F.concat(F.lit(":"), w)).otherwise(F.lit("")))), lambda x: F.when(x == "", x).otherwise(F.concat(x, F.lit("@"))))
    own = F.when(scheme == "wss", F.lit(DEFAULT_PORTS["wss"])).otherwise(F.lit(DEFAULT_PORTS["ws"]))

    def shown(port: Column) -> Column:
        digits = F.regexp_replace(port, "^0+(?=.)", "")
        ok = port.rlike("^[0-9]*$") & (F.length(digits) <= 5) & (F.coalesce(digits.try_cast("int"), F.lit(0)) <= 65535)
        return F.when(ok, F.when((digits == "") | (digits == own), F.lit("")).otherwise(F.concat(F.lit(":"), digits)))

    def placed(place: Column) -> Column:
        host = _let(F.regexp_extract(place, r"(?s)^(\[[^\]]*\]|[^:]*)", 1), _host)
        return F.concat(host, _let(F.regexp_extract(place, r"(?s)^(?:\[[^\]]*\]|[^:]*):?(.*)$", 1), shown))

    return F.concat(user, _let(F.regexp_replace(text, "(?s)^.*@", ""), placed))
