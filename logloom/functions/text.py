"""Tokenizers and tolerant conversions for text log lines (Column -> Column).

Absent values are NULL everywhere: the ``-`` of the text formats, the empty
string, and numbers that could not be measured.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Possessive, unrolled quantifiers: the naive alternation overflows the Java
# stack on fields of a few hundred kilobytes.
_QUOTED_BODY = r'[^"\\]*+(?:\\.[^"\\]*+)*+'
_LB_TOKEN = rf'(?s)"{_QUOTED_BODY}(?:"|\\?$)|[^ ]+'
_LB_QUOTED = rf'(?s)^"({_QUOTED_BODY}\\?)"?$'
_OBJECT_TOKEN = rf'(?s)\[[^\]]*\]|"{_QUOTED_BODY}"|[^ "\[][^ ]*'

# Bracketed host, bracket that never closes, or host before the last colon.
_URL_HOST = r"(?s)^(?:.*?://)?(?:\[([^\]/]*)\][^/]*|(\[[^\]/]*)|((?:[^/\[][^/]*?)?)(?::[^:/]*)?)(?:/.*)?$"

_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})?$"
_CLF_TIME = r"^\d{2}/[A-Z][a-z]{2}/\d{4}:\d{2}:\d{2}:\d{2} [+-]\d{4}$"
_CONTROL = r"[\x00-\x1f\x7f-\x9f]"


def known(c: Column) -> Column:
    """NULL for the empty string and for the ``-`` of the text formats."""
    return F.nullif(F.nullif(c, F.lit("-")), F.lit(""))


def present(c: Column) -> Column:
    """NULL for the empty string."""
    return F.nullif(c, F.lit(""))


def _unescape(c: Column) -> Column:
    return F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"(?s)\\(.)", "$1")).otherwise(c)


def raw_tokens(line: Column) -> Column:
    """Tokens of a load-balancer line with their quotes: :func:`unquoted` strips the ones that are used."""
    return F.regexp_extract_all(line, F.lit(_LB_TOKEN), F.lit(0))


def raw_bracketed_tokens(line: Column) -> Column:
    """Tokens of an object-access line with their quotes and brackets."""
    return F.regexp_extract_all(line, F.lit(_OBJECT_TOKEN), F.lit(0))


def unquoted(t: Column) -> Column:
    """Inner text of a quoted token; an open quote runs to the end of the line."""
    plain = F.substring(t, F.lit(2), F.length(t) - F.when(F.endswith(t, F.lit('"')), 2).otherwise(1))
    escaped = F.regexp_replace(F.regexp_extract(t, _LB_QUOTED, 1), r"(?s)\\(.)", "$1")
    quoted = F.when(F.contains(t, F.lit("\\")), escaped).when(t != '"', plain).otherwise("")
    return F.when(F.startswith(t, F.lit('"')), quoted).otherwise(t)


def unbracketed(t: Column) -> Column:
    """Inner text of a quoted or bracketed token."""
    inner = F.substring(t, F.lit(2), F.length(t) - 2)
    return (
        F.when(F.startswith(t, F.lit('"')), _unescape(inner))
        .when(F.startswith(t, F.lit("[")), inner)
        .otherwise(t)
    )


def quoted_tokens(line: Column) -> Column:
    """Split on spaces; ``"..."`` is one token, ``\\x`` escapes, an open quote runs to the end."""
    return F.transform(raw_tokens(line), unquoted)


def bracketed_tokens(line: Column) -> Column:
    """Split on spaces; ``"..."`` and ``[...]`` are one token each, without their marks."""
    return F.transform(raw_bracketed_tokens(line), unbracketed)


def unterminated(line: Column) -> Column:
    """True when an opening quote or bracket never closes."""
    return F.trim(F.regexp_replace(line, _OBJECT_TOKEN, "")) != ""


def space_tokens(line: Column) -> Column:
    """Split on runs of spaces."""
    return F.split(F.trim(line), " +")


def token(tokens: Column, i: int) -> Column:
    """Token ``i`` (0-based), NULL when missing or ``-``."""
    return known(F.get(tokens, F.lit(i)))


def rfc3339(c: Column) -> Column:
    """Timestamp of an RFC 3339 text, with or without a zone (UTC)."""
    return F.when(F.rlike(c, F.lit(_RFC3339)), F.try_to_timestamp(c))


def clf_time(c: Column) -> Column:
    """Timestamp of a ``06/Feb/2019:00:00:38 +0000`` text."""
    return F.when(
        F.rlike(c, F.lit(_CLF_TIME)), F.try_to_timestamp(c, F.lit("dd/MMM/yyyy:HH:mm:ss Z"))
    )


def epoch_millis(c: Column) -> Column:
    return F.timestamp_millis(c)


def epoch_seconds(c: Column) -> Column:
    return F.timestamp_seconds(c)


def whole(c: Column) -> Column:
    """Long, NULL when the text is not an integer."""
    return c.try_cast("bigint")


def seconds(c: Column) -> Column:
    """Non-negative double; the logs write -1 for a phase they could not measure."""
    v = c.try_cast("double")
    return F.when((v >= 0) & ~F.isnan(v), v)


def millis(c: Column) -> Column:
    """Milliseconds to seconds, NULL when unknown."""
    return seconds(c) / 1000


def port(c: Column) -> Column:
    """Port number 0-65535, else NULL."""
    v = c.try_cast("int")
    return F.when(v.between(0, 65535), v)


def host_port(c: Column) -> tuple[Column, Column]:
    """Split ``ip:port`` or ``[v6]:port`` at the last colon."""
    text = known(c)
    colon = F.contains(text, F.lit(":"))
    host = F.when(F.startswith(text, F.lit("[")), F.regexp_extract(text, r"^\[([^\]]*)", 1)).otherwise(
        F.regexp_replace(text, r"(?s):[^:]*$", "")
    )
    return (
        present(F.when(colon, host).otherwise(text)),
        F.when(colon, present(F.substring_index(text, ":", -1))),
    )


def before_query(c: Column) -> Column:
    """Drop everything from the first ``?`` or ``#``."""
    return F.regexp_replace(c, r"(?s)[?#].*", "")


def request_line(c: Column) -> tuple[Column, Column, Column]:
    """Method, URL and protocol of ``METHOD URL PROTOCOL`` (at most three parts)."""
    parts = F.split(c, " ", 3)
    return (
        token(parts, 0),
        token(parts, 1),
        known(F.trim(F.get(parts, F.lit(2)))),
    )


def url_host(url: Column) -> Column:
    """Lower-case host without port; tolerant of malformed URLs."""
    return present(F.lower(F.regexp_replace(url, _URL_HOST, "$1$2$3")))


def url_path(url: Column) -> Column:
    """Path without query or fragment; NULL when the URL has none."""
    rest = F.regexp_replace(url, r"(?s)^.*?://", "")
    return present(F.regexp_extract(rest, r"(?s)^[^/]*(/[^?#]*)", 1))


def url_scheme(url: Column) -> Column:
    return present(F.lower(F.regexp_extract(url, r"(?s)^(.+?)://", 1)))


def printable(c: Column) -> Column:
    """Control characters become spaces, so log content cannot inject output codes."""
    return F.regexp_replace(c, _CONTROL, " ")


def binary_size(n: Column) -> Column:
    """Byte count with binary units, such as ``1.0 GiB``."""

    def unit(power: int, name: str) -> Column:
        return F.format_string(f"%.1f {name}", F.bround(n.cast("double") / F.lit(float(1 << power)), 1))

    return (
        F.when(n < 1 << 10, F.concat(n.cast("string"), F.lit(" B")))
        .when(n < 1 << 20, unit(10, "KiB"))
        .when(n < 1 << 30, unit(20, "MiB"))
        .when(n < 1 << 40, unit(30, "GiB"))
        .when(n < 1 << 50, unit(40, "TiB"))
        .otherwise(unit(50, "PiB"))
    )


def gibibytes(n: Column) -> Column:
    """Byte count in GiB with one decimal."""
    return F.format_string("%.1f GiB", F.bround(n.cast("double") / F.lit(float(1 << 30)), 1))
