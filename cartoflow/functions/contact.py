"""Phones, mail and web addresses, as Column builders."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def phone_cleaned(phone: Column) -> Column:
    return F.regexp_replace(phone, r"[^\d+]", "")


def phone_e164(phone: Column, country: str = "91") -> Column:
    """Digit rules: ten digits (a leading 0 aside) get the country's code; twelve that start with it a plus."""
    digits = F.regexp_replace(phone, r"\D", "")
    local = F.regexp_replace(digits, r"^0(\d{10})$", "$1")
    return F.when(F.length(local) == 10, F.concat(F.lit(f"+{country}"), local)).when((F.length(digits) == 12) & digits.startswith(country), F.concat(F.lit("+"), digits))


def is_mobile(phone: Column) -> Column:
    """A personal mobile number: +91, then 6 to 9; thirteen characters or more without blanks."""
    plain = F.regexp_replace(phone, " ", "")
    return F.coalesce(plain.rlike(r"^\+91[6-9]") & (F.length(plain) >= 13), F.lit(False))


def phone_check(phone: Column, website: Column) -> Column:
    """struct(valid, line_type, personal_risk): a mobile of a business without a website may be someone's own."""
    valid = F.coalesce(phone.rlike(r"^\+91\d{10}$"), F.lit(False))
    mobile = F.coalesce(phone.rlike(r"^\+91[6-9]\d{9}$"), F.lit(False))
    kind = F.when(~valid, "unknown").when(mobile, "mobile").otherwise("fixed_line")
    return F.struct(valid.alias("valid"), kind.alias("line_type"), (mobile & website.isNull()).alias("personal_risk"))


def domain(url: Column) -> Column:
    host = F.split_part(F.split_part(F.regexp_replace(F.lower(F.trim(url)), r"^[a-z]+://", ""), F.lit("/"), F.lit(1)), F.lit(":"), F.lit(1))
    host = F.regexp_replace(host, r"^www\.", "")
    return F.when(host.contains("."), host)


def email_valid(email: Column) -> Column:
    return F.coalesce(email.rlike(r"^[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}$"), F.lit(False))


def socials(urls: Column) -> Column:
    """URLs by host; of one host the last."""
    host = lambda u: F.regexp_replace(F.try_parse_url(u, F.lit("HOST")), r"www\.", "")
    named = F.filter(urls, lambda u: host(u).isNotNull())
    hosts = F.array_distinct(F.transform(named, host))
    return F.map_from_arrays(hosts, F.transform(hosts, lambda h: F.element_at(F.filter(named, lambda u: host(u) == h), -1)))


def public_url(url: Column) -> Column:
    """Safe to fetch: http(s), not a local or internal name, not a private, loopback, link-local or reserved address."""
    scheme, host = F.lower(F.try_parse_url(url, F.lit("PROTOCOL"))), F.lower(F.try_parse_url(url, F.lit("HOST")))
    named = host.isin("localhost", "metadata.google.internal") | host.endswith(".internal") | host.endswith(".local")
    octets = F.split(host, r"\.")
    a, b = F.try_element_at(octets, F.lit(1)).try_cast("int"), F.try_element_at(octets, F.lit(2)).try_cast("int")
    address = host.rlike(r"^\d{1,3}(\.\d{1,3}){3}$")
    closed = a.isin(0, 10, 127) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254)) | ((a == 100) & b.between(64, 127))
    inner = host.rlike(r"^\[(::1?|f[cd].*|fe[89ab].*)\]$")
    return F.coalesce(scheme.isin("http", "https") & ~named & ~(address & closed) & ~inner, F.lit(False))


def robots_verdict(status: Column, disallowed: Column) -> Column:
    """Whether a fetch is allowed: by the rules where they were read, never after a refusal or a server's failure."""
    return F.when(status.isNull() | (status >= 500), False).when(status.isin(401, 403), False).when(status >= 400, True).otherwise(~F.coalesce(disallowed, F.lit(False)))


def fetch_outcome(status: Column, error: Column) -> Column:
    return (
        F.when(error.isNotNull(), error)
        .when(status == 200, "ok")
        .when(status == 304, "304_not_modified")
        .when(status.isin(401, 403, 429), "blocked_by_site")
        .otherwise(F.concat(F.lit("http_"), status.cast("string")))
    )
