"""Scalar column expressions shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

INT64_MAX = 9223372036854775807

# Normal quantile of the 95 % interval and the sRGB constants.
Z95 = 1.959963984540054
SRGB_KNEE = 0.04045
SRGB_LOW = 12.92
SRGB_OFFSET = 0.055
SRGB_SCALE = 1.055
SRGB_GAMMA = 2.4
SRGB_WEIGHTS = (0.2126, 0.7152, 0.0722)

# Patterns of identifiers, digests, numbers, facts, tags, colours.
IDENTIFIER = r"^[a-z0-9][a-z0-9:._-]{0,127}$"
DIGEST = r"^[0-9a-f]{64}$"
NUMBER = r"-?(?:0|[1-9]\d*)(?:\.\d+)?"
FACT = (
    r"^FACT\[([a-z0-9][a-z0-9._-]{0,63})\|([a-z0-9][a-z0-9._-]{0,63})\]="
    r"(-?(?:0|[1-9]\d*)(?:\.\d+)?) ([a-z][a-z0-9._-]{0,31})$"
)
NUMBER_TOKEN = r"(?U)(?<![\w.-])(-?(?:0|[1-9]\d*)(?:\.\d+)?)(?![\w.-])"
INTEGER_TOKEN = r"(?U)(?<![\w-])(\d+)(?![\w-])"
LANGUAGE_TAG = r"^[a-z]{2,3}(?:-[a-z0-9]{2,8})*$"
HEX_COLOR = r"^#[0-9a-fA-F]{6}$"

# Localized unit phrases accepted after a number.
UNIT_TERMS = {
    "accessible_places": {"en": "accessible places", "es": "plazas accesibles"},
    "beds": {"en": "beds", "es": "camas"},
    "minutes": {"en": "minutes", "es": "minutos"},
    "people": {"en": "people", "es": "personas"},
    "percent": {"en": "percent", "es": "por ciento"},
    "routes": {"en": "routes", "es": "rutas"},
    "shelters": {"en": "shelters", "es": "refugios"},
}


def cents(value: Column) -> Column:
    return F.round(value * 100).cast("long")


def canonical(cols: Sequence[str | Column]) -> Column:
    """JSON text of the columns in name order, nulls kept; keep doubles out of it."""
    return F.to_json(F.struct(*cols), {"ignoreNullFields": "false"})


def seal(cols: Sequence[str | Column]) -> Column:
    return F.sha2(canonical(cols), 256)


def sealed(cols: Sequence[str | Column], digest: str) -> Column:
    """True where the recorded digest is the digest of the other columns."""
    return F.col(digest).eqNullSafe(seal(cols))


def content_address(digest: Column) -> Column:
    return F.concat(F.lit("sha256:"), digest)


def scoped_key(*cols: str) -> Column:
    """Idempotency key bound to its scope columns."""
    return seal(list(cols))


def short_identity(*parts: Column) -> Column:
    """First 24 hex digits of SHA-256 over NUL-joined text."""
    nul = "\0"
    return F.substring(F.sha2(F.concat_ws(nul, *parts), 256), 1, 24)


def int_div(a: Column, b: Column) -> Column:
    return F.call_function("div", a, b)


def ceil_div(a: Column, b: Column) -> Column:
    """Integer ceil for non-negative ``a`` and positive ``b``, without overflow of ``a + b``."""
    return int_div(a, b) + F.when(a % b > 0, 1).otherwise(0)


def normalize_space(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def sorted_unique(array: Column) -> Column:
    return F.array_sort(F.array_distinct(array)) == array


def integer_multiset(text: Column) -> Column:
    """Sorted integers of a text, compared as numbers of any length."""
    tokens = F.regexp_extract_all(text, F.lit(INTEGER_TOKEN), F.lit(1))
    plain = F.transform(tokens, lambda t: F.regexp_replace(t, r"^0+(?=\d)", ""))
    return F.array_sort(plain)


def fact_fields(text: Column) -> dict[str, Column]:
    names = ("subject", "predicate", "value", "unit")
    return {n: F.regexp_extract(text, FACT, i + 1) for i, n in enumerate(names)}


def _linear(channel: Column) -> Column:
    return F.when(channel <= SRGB_KNEE, channel / SRGB_LOW).otherwise(
        F.pow((channel + SRGB_OFFSET) / SRGB_SCALE, F.lit(SRGB_GAMMA))
    )


def luminance(color: Column) -> Column:
    parts = [
        _linear(F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("double") / 255) * w
        for i, w in enumerate(SRGB_WEIGHTS)
    ]
    return parts[0] + parts[1] + parts[2]


def contrast_ratio(foreground: Column, background: Column) -> Column:
    """Contrast of two opaque #RRGGBB colours; NULL where either is malformed."""
    a, b = luminance(foreground), luminance(background)
    ok = foreground.rlike(HEX_COLOR) & background.rlike(HEX_COLOR)
    return F.when(ok, (F.greatest(a, b) + 0.05) / (F.least(a, b) + 0.05))


def url_problem(url: Column, schemes: Sequence[str], hosts: Sequence[str] | Column) -> Column:
    """First reason a URL is refused, NULL when it is accepted."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    user = F.regexp_extract(netloc, r"^(.*)@", 1)
    place = F.regexp_replace(netloc, r"^.*@", "")
    host = F.lower(F.regexp_replace(place, r":[^:\]]*$", ""))
    port = F.regexp_replace(F.regexp_extract(place, r":([^:\]]*)$", 1), r"^0+(?=.)", "")
    number = F.try_to_number(port, F.lit("99999"))
    known = hosts if isinstance(hosts, Column) else host.isin(list(hosts))
    return (
        F.when(url.isNull() | (url == "") | (url != F.trim(url)), "not-canonical-text")
        .when(url.rlike(r"(?U)[\s\x00-\x1f]"), "whitespace-or-control")
        .when(url.contains("\\"), "backslash")
        .when((port != "") & (~port.rlike(r"^\d{1,5}$") | (number > 65535)), "unparsable")
        .when((scheme == "") | (host == ""), "not-absolute")
        .when(~scheme.isin(list(schemes)), "scheme-not-allowed")
        .when(netloc.contains("@"), "embedded-credentials")
        .when(~F.coalesce(known, F.lit(False)), "host-not-allowed")
        .when((port != "") & (number != 443), "non-default-port")
    )


def url_host(url: Column) -> Column:
    netloc = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(netloc, r"^.*@", ""), r":[^:\]]*$", ""))


def utc_time(text: Column) -> Column:
    """UTC second timestamp text to a timestamp, NULL where the text has another form."""
    shape = text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return F.when(shape, F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss'Z'")))


def canonical_base64(text: Column) -> Column:
    return F.coalesce(F.base64(F.try_to_binary(text, F.lit("base64"))) == text, F.lit(False))


def is_fresh(created: Column, until: Column, as_of: Column) -> Column:
    """Existed and not expired at ``as_of``; bounds inclusive, NULL end open."""
    return (created <= as_of) & (until.isNull() | (as_of <= until))


def backoff_ms(retry: Column, base: int, ceiling: int) -> Column:
    """min(base * 2**(retry - 1), ceiling) in integers."""
    shift = F.least(retry - 1, F.lit(62)).cast("int")
    grown = F.try_multiply(F.lit(base).cast("long"), F.call_function("shiftleft", F.lit(1).cast("long"), shift))
    return F.least(F.coalesce(grown, F.lit(ceiling).cast("long")), F.lit(ceiling).cast("long"))
