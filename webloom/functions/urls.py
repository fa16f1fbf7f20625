"""URL expressions.  Four different rules of equality exist; each is a function of its own.

normalize: validated start addresses; canonical: discovered links; same_site: host comparison;
grounding_key: tolerant comparison of cited sources.
"""

from __future__ import annotations

import ipaddress
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webloom.constants import DEFAULTS, IGNORED_SEGMENTS, IGNORED_SUFFIXES, KNOWN_SCHEMES, LINK_WEIGHTS
from webloom.functions.text import let, strip

#: Parts of any URI reference, by group: 2 scheme, 4 authority, 5 path, 6 query with ?, 7 query.
REFERENCE = r"^(([^:/?#]+):)?(//([^/?#]*))?([^?#]*)(\?([^#]*))?(#(.*))?"


def part(url: Column, group: int) -> Column:
    return F.regexp_extract(url, REFERENCE, group)


def scheme(url: Column) -> Column:
    return F.lower(part(url, 2))


def authority(url: Column) -> Column:
    return part(url, 4)


def _host_and_port(url: Column) -> Column:
    return F.regexp_replace(authority(url), "^.*@", "")


def host(url: Column) -> Column:
    """Lower-case host; brackets of IPv6 addresses are taken off."""
    place = _host_and_port(url)
    return F.lower(F.when(place.startswith("["), F.regexp_extract(place, r"^\[([^\]]*)\]", 1)).otherwise(F.regexp_extract(place, "^([^:]*)", 1)))


def port(url: Column) -> Column:
    """The port as it is written, empty if there is none."""
    place = _host_and_port(url)
    return F.when(place.startswith("["), F.regexp_extract(place, r"^\[[^\]]*\]:?(.*)$", 1)).otherwise(F.regexp_extract(place, "^[^:]*:(.*)$", 1))


def path(url: Column) -> Column:
    return part(url, 5)


def query(url: Column) -> Column:
    return part(url, 7)


def without_www(name: Column) -> Column:
    return F.regexp_replace(name, r"^www\.", "")


def with_scheme(url: Column) -> Column:
    """A URL without a known scheme gets https; a colon may also be a port's."""
    known = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.\-]*):", 1)).isin(*KNOWN_SCHEMES)
    return F.when(url.startswith("//"), F.concat(F.lit("https:"), url)).when(known, url).otherwise(F.concat(F.lit("https://"), url))


@F.pandas_udf(T.BooleanType())
def _is_private_v6(names: pd.Series) -> pd.Series:
    def private(name: str):
        try:
            ip = ipaddress.ip_address(name)
        except ValueError:
            return None
        return ip.is_loopback or ip.is_private or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified

    return names.map(private, na_action="ignore")


_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"^{_OCTET}(?:\.{_OCTET}){{3}}$"
# IPv4 networks that are not public.
PRIVATE_V4 = r"^(?:0\.|10\.|127\.|169\.254\.|172\.(?:1[6-9]|2[0-9]|3[01])\.|192\.0\.0\.(?!9$|10$)|192\.0\.2\.|192\.168\.|198\.1[89]\.|198\.51\.100\.|203\.0\.113\.|2(?:2[4-9]|[34][0-9]|5[0-5])\.)"
LABEL = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"


def host_error(name: Column, private_v6: Column) -> Column:
    """Why a lower-case host can't be scanned, null if it can; ``private_v6`` says it of an IPv6 literal."""
    private = F.concat(F.lit("'"), name, F.lit("' is a private/loopback address and cannot be scanned."))
    v6 = name.contains(":")
    return (
        F.when(v6, F.when(F.coalesce(private_v6, F.lit(True)), private))
        .when(name.rlike(IPV4), F.when(name.rlike(PRIVATE_V4), private))
        .when(name == "localhost", "'localhost' cannot be scanned.")
        .when(F.length(name) > 253, "Hostname is too long.")
        .when(~name.contains("."), F.concat(F.lit("'"), name, F.lit("' is not a valid domain (missing a top-level domain).")))
        .when(~name.rlike(rf"^{LABEL}(?:\.{LABEL})*$"), F.concat(F.lit("'"), name, F.lit("' contains invalid characters.")))
    )


def _port_is_wrong(text: Column) -> Column:
    return (text != "") & (~text.rlike("^[0-9]+$") | (F.length(F.regexp_replace(text, "^0+", "")) > 5) | (F.try_to_number(F.substring(text, -6, 6), F.lit("999999")) > 65535))


def parts(url: Column) -> Column:
    """``scheme, authority, host, port, path, query`` of a URL."""
    return F.struct(scheme(url).alias("scheme"), authority(url).alias("authority"), host(url).alias("host"), port(url).alias("port"), path(url).alias("path"), query(url).alias("query"))


def _rebuilt(p: Column, shown_path: Column) -> Column:
    number = F.regexp_replace(p["port"], "^0+(?=[0-9])", "")
    usual = ((p["scheme"] == "http") & (number == "80")) | ((p["scheme"] == "https") & (number == "443"))
    return F.concat(
        p["scheme"], F.lit("://"), p["host"], F.when((number == "") | usual, "").otherwise(F.concat(F.lit(":"), number)), shown_path, F.when(p["query"] != "", F.concat(F.lit("?"), p["query"])).otherwise("")
    )


def normalize(raw: Column, longest: int = DEFAULTS["MAX_URL_LENGTH"], ipv6: bool = False) -> Column:
    """``original_url, url, domain, is_valid, error_reason`` of a start address; the first failing rule names the reason.

    Null and blank addresses are invalid.  Default ports, fragments and trailing slashes go;
    the path's case and the query stay.  IPv6 addresses are judged where ``ipv6`` is set, else
    refused.
    """
    stripped = strip(F.coalesce(raw, F.lit("")))
    v6 = _is_private_v6(F.when(host(with_scheme(stripped)).contains(":"), host(with_scheme(stripped)))) if ipv6 else F.lit(True)

    def judged(x: Column) -> Column:
        p = x["p"]
        error = F.coalesce(
            F.when(x["text"] == "", "URL is empty."),
            F.when(F.length(x["text"]) > longest, f"URL exceeds {longest} characters."),
            F.when(~p["scheme"].isin("http", "https"), F.concat(F.lit("Unsupported URL scheme '"), p["scheme"], F.lit("'. Only http/https are allowed."))),
            F.when(p["authority"].contains("@"), "URLs with embedded credentials are not allowed."),
            F.when(p["host"] == "", "URL is missing a host."),
            F.when(_port_is_wrong(p["port"]), "URL has an invalid port."),
            host_error(p["host"], x["v6"]),
        )
        return F.struct(x["text"].alias("text"), p.alias("p"), error.alias("e"))

    def result(x: Column) -> Column:
        ok = x["e"].isNull()
        url = _rebuilt(x["p"], F.regexp_replace(x["p"]["path"], "/+$", ""))
        return F.struct(F.when(ok, url).alias("url"), F.when(ok, x["p"]["host"]).alias("domain"), ok.alias("is_valid"), x["e"].alias("error_reason"))

    found = let(F.struct(stripped.alias("text"), with_scheme(stripped).alias("full"), v6.alias("v6")), lambda x: F.struct(x["text"].alias("text"), parts(x["full"]).alias("p"), x["v6"].alias("v6")))
    made = let(let(found, judged), result)
    return F.struct(raw.alias("original_url"), made["url"].alias("url"), made["domain"].alias("domain"), made["is_valid"].alias("is_valid"), made["error_reason"].alias("error_reason"))


def site(url: Column) -> Column:
    """Lower-case host without www., empty if there is none."""
    return F.coalesce(without_www(host(url)), F.lit(""))


def canonical(url: Column) -> Column:
    """One spelling of a discovered link, null if it isn't http; the root keeps its slash."""

    def spelled(p: Column) -> Column:
        root = F.when(p["path"].isin("", "/"), "/").otherwise(F.regexp_replace(p["path"], "/+$", ""))
        return F.when(p["scheme"].isin("http", "https") & (p["host"] != "") & ~_port_is_wrong(p["port"]), _rebuilt(p, root))

    return let(parts(url), spelled)


def is_supported_href(href: Column) -> Column:
    return F.coalesce((href != "") & ~href.startswith("#") & ~F.lower(href).rlike("^(?:mailto|tel|javascript|data):"), F.lit(False))


def is_irrelevant(url: Column) -> Column:
    """Whether a canonical link names a file or a page that is never crawled."""
    low = F.lower(path(url))
    last = F.regexp_extract(low, "([^/]*)/*$", 1)
    suffix = F.regexp_extract(last, r"^.+\.([^.]+)$", 1)
    return suffix.isin(*IGNORED_SUFFIXES) | F.arrays_overlap(F.split(low, "/"), F.array(*[F.lit(s) for s in IGNORED_SEGMENTS]))


def relevance(url: Column, anchor_text: Column) -> Column:
    """The weight of the heaviest keyword in path and anchor text, 0 if there is none."""
    text = F.translate(F.lower(F.concat(path(url), F.lit(" "), F.coalesce(anchor_text, F.lit("")))), "_ ", "--")
    return F.greatest(F.lit(0), *[F.when(F.contains(text, F.lit(k)), w).otherwise(0) for k, w in LINK_WEIGHTS.items()])


def same_site(candidate: Column, base_domain: Column) -> Column:
    """Whether a URL's host equals the domain but for www.; other subdomains are other sites."""
    domain = normalize(candidate)["domain"]
    return F.coalesce((base_domain != "") & (without_www(domain) == without_www(F.lower(base_domain))), F.lit(False))


def domains_match(a: Column, b: Column) -> Column:
    tidy = lambda c: without_www(F.lower(strip(c)))
    return tidy(a) == tidy(b)


def grounding_key(url: Column) -> Column:
    return F.regexp_replace(F.lower(strip(url)), "/$", "")


def is_absolute(url: Column) -> Column:
    return F.coalesce(scheme(url).isin("http", "https") & (authority(url) != ""), F.lit(False))


def is_homepage(url: Column) -> Column:
    return F.translate(path(url), "/", "") == ""


def http_sources(sources: Column) -> Column:
    """Array entries that are web addresses; null becomes an empty array."""
    return F.filter(F.coalesce(sources, F.array().cast("array<string>")), lambda s: F.coalesce(F.lower(strip(s)).rlike("^https?://"), F.lit(False)))


def resolve(base: str, href: str) -> str | None:
    """RFC 3986 resolution for the HTML pass; null where the reference can't be parsed."""
    try:
        return urljoin(base, href)
    except ValueError:
        return None
