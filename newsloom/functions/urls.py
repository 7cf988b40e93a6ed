"""URL keys as native column expressions: one regular expression cuts a URL, higher-order functions rebuild it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that only track, in lower case.
TRACKING = (
    "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name utm_reader utm_brand utm_social "
    "utm_social-type utm_swu cmp fbclid gclid dclid gbraid wbraid msclkid twclid igshid mc_cid mc_eid yclid ttclid rdt_cid "
    "ref referrer source src cmpid ito at_medium at_campaign ncid smid partner sh __twitter_impression guccounter spm share_type"
).split()

_PARTS = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(?s:.*))?$"


def _encoded(text: Column) -> Column:
    """Form encoding: letters, digits, _ . - ~ stay, a space becomes +."""
    plain = F.coalesce(F.try_url_decode(text), text)
    return F.replace(F.replace(F.url_encode(plain), F.lit("%7E"), F.lit("~")), F.lit("*"), F.lit("%2A"))


def canonical_url(url: Column) -> Column:
    """The key under which copies of a URL meet; null for null, the trimmed text where there is no host."""
    raw = F.trim(url)
    part = lambda k: F.regexp_extract(raw, _PARTS, k)
    scheme = F.lower(part(1))
    scheme = F.when(scheme.isin("", "http"), "https").otherwise(scheme)
    host = F.regexp_replace(F.lower(part(2)), "^.*@", "")
    host = F.when(scheme == "https", F.regexp_replace(host, ":(?:80|443)$", "")).otherwise(F.regexp_replace(host, ":80$", ""))
    path = F.when(F.length(part(3)) > 1, F.regexp_replace(part(3), "/$", "")).otherwise(part(3))
    fields = F.filter(F.split(part(4), "&"), lambda p: p != "")
    name = lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1))
    value = lambda p: F.when(F.contains(p, F.lit("=")), F.regexp_replace(p, "^[^=]*=", "")).otherwise("")
    kept = F.filter(fields, lambda p: ~F.lower(name(p)).isin(TRACKING))
    query = F.array_join(F.transform(kept, lambda p: F.concat(_encoded(F.substring_index(p, "=", 1)), F.lit("="), _encoded(value(p)))), "&")
    built = F.concat(scheme, F.lit("://"), host, F.when((path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path)).otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query)))
    return F.when(part(2) == "", raw).otherwise(built)


def url_key(url: Column) -> Column:
    """SHA-256 of the canonical form, in hex."""
    return F.sha2(canonical_url(url), 256)


def base_url(url: Column) -> Column:
    return F.nullif(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)", 1), F.lit(""))
