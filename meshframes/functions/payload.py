"""Payload Column functions: UTF-8 check, strict JSON, encoding, packet metadata.

Spark's JSON readers are lenient where the relay is strict (trailing text after a
document, numbers read as strings), so the checks below test types explicitly.
Everything is a built-in expression; nothing leaves the JVM.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from meshframes.schema import KIND_TEXT

#: Control characters that have no short escape and whose code has a hexadecimal letter.
_LETTERED = (0x0B, 0x0E, 0x0F, *range(0x1A, 0x20))
_JSON_OUTER_WS = r"^[ \t\n\r]+|[ \t\n\r]+$"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def utf8_text(payload) -> Column:
    """Payload bytes as text, or null when they are not valid UTF-8."""
    return F.try_validate_utf8(_c(payload).cast("string"))


def wrap_for_strict_json(text) -> Column:
    """The text parsed as the first element of ``[text, "<md5 of text>"]``.

    ``try_parse_json`` ignores trailing text, so the text is wrapped as the first
    element of an array whose second element is the text's own digest: only a single
    complete document leaves that digest in place as element 1 with nothing after.
    When valid, element 0 is the document itself (one parse serves both).
    """
    t = _c(text)
    return F.try_parse_json(F.concat(F.lit("["), t, F.lit(',"'), F.md5(t), F.lit('"]')))


def strict_json_ok(wrapped, text) -> Column:
    """True iff the wrapped parse shows ``text`` is exactly one JSON document."""
    w = _c(wrapped)
    second = F.try_variant_get(w, "$[1]", "string")
    third = F.try_variant_get(w, "$[2]", "variant")
    return F.coalesce((second == F.md5(_c(text))) & third.isNull(), F.lit(False))


def is_strict_json(text) -> Column:
    """True iff ``text`` is exactly one JSON document (outer whitespace allowed)."""
    return strict_json_ok(wrap_for_strict_json(text), text)


def json_trim(text) -> Column:
    """The text of a JSON document without outer JSON whitespace (kept verbatim)."""
    return F.regexp_replace(_c(text), _JSON_OUTER_WS, "")


def base64_flat(payload) -> Column:
    """Standard base64 on one line (Spark's ``base64`` breaks lines at 76 chars)."""
    return F.regexp_replace(F.base64(_c(payload)), "[\r\n]", "")


def encoding_of(kind, text_ok, json_ok) -> Column:
    """P2: 'json' / 'utf8' for valid-UTF-8 text frames, else 'base64'."""
    is_text = (_c(kind) == F.lit(KIND_TEXT)) & _c(text_ok)
    return F.when(is_text & _c(json_ok), F.lit("json")).when(is_text, F.lit("utf8")).otherwise(F.lit("base64"))


def _obj_or_null(v: Column, probe: Column) -> Column:
    # absent (SQL null), JSON null, or an object (probe = struct cast succeeded)
    return v.isNull() | F.is_variant_null(v) | probe.isNotNull()


def _str_or_null(v: Column) -> Column:
    return v.isNull() | F.schema_of_variant(v).isin("VOID", "STRING")


#: Fixed names on the probed path, with the level at which they stand.
PROBED = (("$", ("data",)), ("$.data", ("hash", "decoded")), ("$.data.decoded", ("header",)), ("$.data.decoded.header", ("payloadTypeName",)))


def repeats_probed_key(text) -> Column:
    """True if an object on the probed path names a probed key twice (then the frame has no metadata).

    Keys are listed level by level only for texts in which a probed name, or an escape that could
    spell one, stands twice."""
    t = _c(text)
    suspect = t.rlike(r'(?s)"(data|hash|decoded|header|payloadTypeName)".*"\1"|\\u00')
    out = F.lit(False)
    for level, names in PROBED:
        inner = t if level == "$" else F.get_json_object(t, level)
        keys = F.coalesce(F.json_object_keys(inner), F.array().cast("array<string>"))
        for name in names:
            out = out | (F.size(keys) - F.size(F.array_remove(keys, name)) > 1)
    # a branch of its own: the keys of other texts are never listed
    return F.when(suspect, F.coalesce(out, F.lit(False))).otherwise(F.lit(False))


def json_string(text) -> Column:
    """A string as a JSON string literal: quote, backslash and control characters escaped (``\\b \\t \\n \\f \\r``,
    else ``\\u`` with lower-case hexadecimal digits), everything else as it is."""
    t = _c(text)
    j = F.to_json(F.array(t))
    # Spark writes hexadecimal letters of escapes in upper case; an escape's backslash stands after an even number of others
    def lowered(x: Column) -> Column:
        for code in _LETTERED:
            x = F.regexp_replace(x, rf"(?<!\\)((?:\\\\)*)\\u{code:04X}", rf"$1\\u{code:04x}")
        return x

    lower = F.get(F.transform(F.array(j), lowered), F.lit(0))  # rarely needed, so kept out of the generated code
    some = t.rlike("[\u000b\u000e\u000f\u001a-\u001f]")
    return F.substring(F.when(some, lower).otherwise(j), F.lit(2), F.length(j) - 2)
