"""Column expressions for addresses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pressloom.functions import fixed_values as fv


def scheme(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))


def authority(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1)


def host(url: Column) -> Column:
    return F.lower(F.regexp_replace(authority(url), r"^.*@|:[0-9]*$", ""))


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1)


def query(url: Column) -> Column:
    return F.regexp_extract(url, r"\?([^#]*)", 1)


def bare_host(url: Column) -> Column:
    return F.regexp_replace(host(url), r"^www\.", "")


def is_admissible(url: Column) -> Column:
    """http(s), a host, no credentials, no white space, at most 2,000 characters."""
    u = F.trim(F.coalesce(url, F.lit("")))
    return (
        (F.length(u).between(1, fv.MAX_URL))
        & ~u.rlike(r"\s")
        & scheme(u).isin("http", "https")
        & (host(u) != "")
        & ~authority(u).contains("@")
    )


def is_public(url: Column) -> Column:
    """A host other machines can reach: no literals, local names or odd ports."""
    u = F.trim(F.coalesce(url, F.lit("")))
    h = F.regexp_replace(host(u), r"\.$", "")
    port = F.regexp_extract(authority(u), r":([0-9]+)$", 1)
    return (
        scheme(u).isin("http", "https")
        & ~authority(u).contains("@")
        & ~authority(u).contains("[")
        & port.isin("", "80", "443")
        & h.contains(".")
        & ~h.rlike(r"(^localhost$|\.local$|\.internal$)")
        & ~h.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$")
        & ~h.rlike(r"^(0x[0-9a-f]+|[0-9]+)$")
    )


def _encode(value: Column) -> Column:
    encoded = F.url_encode(value)
    return F.replace(F.replace(encoded, F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def canonical(url: Column) -> Column:
    """Ingest form: tracking and blank parameters out, host lower-cased, fragment dropped, the rest re-encoded."""
    u = F.trim(url)
    pairs = F.filter(
        F.split(query(u), "&"),
        lambda p: p.rlike("^[^=]*=.") & ~F.lower(F.substring_index(p, "=", 1)).isin(*fv.INGEST_TRACKING_KEYS),
    )

    def decoded(raw: Column) -> Column:
        return F.coalesce(F.try_url_decode(raw), raw)

    kept = F.transform(
        pairs,
        lambda p: F.concat(
            _encode(decoded(F.substring_index(p, "=", 1))), F.lit("="), _encode(decoded(F.regexp_replace(p, "^[^=]*=", "")))
        ),
    )
    return F.concat(
        scheme(u),
        F.lit("://"),
        F.lower(authority(u)),
        path(u),
        F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise(""),
    )


def lookup_form(url: Column) -> Column:
    """Serving form: any utm_* and three more keys out, fragment dropped, nothing re-encoded."""
    u = F.trim(url)
    kept = F.filter(
        F.split(query(u), "&"),
        lambda p: (p != "")
        & ~F.lower(F.substring_index(p, "=", 1)).rlike("^utm_")
        & ~F.lower(F.substring_index(p, "=", 1)).isin(*fv.LOOKUP_TRACKING_KEYS),
    )
    tail = F.when(F.size(kept) > 0, F.concat(F.lit("?"), F.array_join(kept, "&"))).otherwise("")
    return F.concat(scheme(u), F.lit("://"), F.lower(authority(u)), path(u), tail)


def article_id(url: Column) -> Column:
    return F.substring(F.sha1(canonical(url)), 1, 12)


def url_id(url: Column) -> Column:
    return F.substring(F.sha1(url), 1, 12)


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/$", "")


def outlet_key(url: Column) -> Column:
    """Registrable domain; three labels under suffixes such as com.br."""
    h = host(url)
    labels = F.split(h, r"\.")
    n = F.size(labels)
    last, before = F.try_element_at(labels, F.lit(-1)), F.try_element_at(labels, F.lit(-2))
    keep = F.when((F.length(last) == 2) & before.isin(*fv.PUBLIC_SECOND_LEVELS), 3).otherwise(2)
    return F.when(n <= 2, h).otherwise(F.array_join(F.slice(labels, F.greatest(n - keep + 1, F.lit(1)), keep), "."))
