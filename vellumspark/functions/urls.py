"""URLs, paths and archive keys as column expressions."""

from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

ABSOLUTE = r"(?i)^https?://[^/?#\s]+"
# scheme, authority, path with query, fragment
PATH_OF = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"
PARTS = r"^([A-Za-z][A-Za-z0-9+.-]*)://([^/?#]*)([^#]*)(?:#.*)?$"


def absolute(url: Column) -> Column:
    """An http or https URL with a host, else null."""
    return F.when(url.rlike(ABSOLUTE), url)


def host(url: Column) -> Column:
    """Lower-case host without user and port."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))


def surt(url: Column) -> Column:
    """Sort-friendly key: host labels reversed, port, then path and query; no scheme or fragment."""
    authority, rest = F.regexp_extract(url, PARTS, 2), F.regexp_extract(url, PARTS, 3)
    name = F.lower(F.regexp_extract(authority, r"^(?:[^@]*@)?([^:]*)", 1))
    port = F.regexp_extract(authority, r"(:[0-9]+)$", 1)
    rest = F.regexp_replace(rest, r"\?$", "")
    path = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    return F.concat(F.array_join(F.reverse(F.split(name, r"\.")), ","), port, F.lit(")"), path)


def first_party(url: Column, hosts: list[str], primary: str) -> Column:
    """The URL on the primary host over https without fragment, if its host is one of ``hosts``
    and it carries no credentials and no port; else null."""
    authority, rest = F.regexp_extract(url, PARTS, 2), F.regexp_extract(url, PARTS, 3)
    ok = F.lower(F.regexp_extract(url, PARTS, 1)).isin("http", "https") & F.lower(authority).isin(hosts)
    return F.when(ok, F.concat(F.lit(f"https://{primary}"), F.when(rest == "", F.lit("/")).otherwise(rest)))


def observed_safe(url: Column) -> Column:
    """Whether an observed URL is plain http(s): a host, no credentials, no control characters."""
    return F.coalesce(url.rlike(ABSOLUTE) & ~F.regexp_extract(url, PARTS, 2).contains("@") & ~url.rlike(r"[\x00-\x20\x7F\\]") & (F.length(url) <= 8192), F.lit(False))


def cdx_timestamp(stamp: Column) -> Column:
    return F.date_format(stamp, "yyyyMMddHHmmss")


RFC3339 = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:[Zz]|[+-]\d{2}:\d{2})$"


def rfc3339(value: Column) -> Column:
    """A timestamp if the text is RFC 3339 with a zone, else null."""
    return F.when(value.rlike(RFC3339), F.try_to_timestamp(F.upper(value)))


def page_id(url: Column, stamp: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("\n", url, stamp), 256), 1, 16)


def digest_or(digest: Column, entity: Column) -> Column:
    """A record's own digest in lower case, else the sha256 of its entity."""
    return F.coalesce(F.lower(digest), F.concat(F.lit("sha256:"), F.sha2(entity, 256)))


def bare_mime(content_type: Column) -> Column:
    return F.lower(F.trim(F.split_part(content_type, F.lit(";"), F.lit(1))))


def route_path(route: Column) -> Column:
    return F.split_part(route, F.lit("#"), F.lit(1))


def route_fragment(route: Column) -> Column:
    """What follows the first #, null without one."""
    return F.when(route.contains("#"), F.regexp_extract(route, r"(?s)^[^#]*#(.*)$", 1))


def route_valid(route: Column) -> Column:
    """A relative route: no scheme, query, percent sign, backslash, control character or dot part."""
    path = route_path(route)
    return (path != "") & ~path.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:|[?%\\\x00-\x1F\x7F]|^/|(^|/)\.{0,2}(/|$)")


def safe_relative(path: Column) -> Column:
    """A relative POSIX path without empty, dot or dot-dot parts, backslashes and control characters."""
    return F.coalesce((path != "") & ~path.rlike(r"[\\\x00-\x1F\x7F]|^/|(^|/)\.{0,2}(/|$)"), F.lit(False))


def safe_archive_member(path: Column) -> Column:
    """As safe_relative, but a folder's name may end in a slash, and drive letters are refused."""
    return safe_relative(F.regexp_replace(path, "/$", "")) & ~path.rlike(r"^[A-Za-z]:")


def access_id_valid(value: Column) -> Column:
    """tp: identifier with upper-case percent escapes, of at most 2,048 characters."""
    part = r"(?:[A-Za-z0-9._~'-]|%[0-9A-F]{2})+"
    return value.rlike(rf"^tp:{part}/[a-z][a-z0-9_-]*(?:/{part})?$") & (F.length(value) <= 2048)


CAPTURE_ID = r"^(\d{8}T\d{6}Z)-[a-z0-9]+(?:-[a-z0-9]+)*$"


def capture_id_valid(value: Column) -> Column:
    """Timestamp of a real moment, then a suffix."""
    stamp = F.regexp_extract(value, CAPTURE_ID, 1)
    return value.rlike(CAPTURE_ID) & F.try_to_timestamp(F.when(stamp != "", stamp), F.lit("yyyyMMdd'T'HHmmss'Z'")).isNotNull()


def host_valid(value: Column) -> Column:
    label = r"[a-z0-9](?:[a-z0-9-]{0,61}[a-z0-9])?"
    return value.rlike(rf"^{label}(?:\.{label})*$") & (F.length(value) <= 253)


def safe_id(value: Column) -> Column:
    return value.rlike(r"^[a-z0-9](?:[a-z0-9._-]{0,62}[a-z0-9])?$")


def is_warc_name(path: Column) -> Column:
    return F.lower(path).rlike(r"\.warc(\.gz)?$")


def is_transient(name: Column) -> Column:
    return (name == ".DS_Store") | name.rlike(r"[^.].*\.py[co]$")


def media_type(name: Column) -> Column:
    """By ending; longer endings are asked first."""
    # Endings and their media types.
    endings = [(".warc.gz", "application/warc+gzip"), (".gz", "application/gzip"), (".xml", "application/xml"), (".sqlite", "application/vnd.sqlite3"), (".torrent", "application/x-bittorrent")]
    out = None
    for end, kind in endings:
        hit = name.endswith(end)
        out = F.when(hit, kind) if out is None else out.when(hit, kind)
    return out.otherwise("application/octet-stream")


def manifest_path_encoded(path: Column) -> Column:
    for raw, code in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A")):
        path = F.replace(path, F.lit(raw), F.lit(code))
    return path


def manifest_path_decoded(path: Column) -> Column:
    """The path, or null if it has another percent escape."""
    plain = path
    for code, raw in (("%0[Dd]", "\r"), ("%0[Aa]", "\n"), ("%25", "%")):
        plain = F.regexp_replace(plain, code, raw)
    return F.when(~path.rlike(r"%(?!25|0[Dd]|0[Aa])"), plain)


def percent_decoded(path: Column) -> Column:
    """Percent escapes decoded; a plus sign stays one."""
    return F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def file_uri(path: Column, fragment: Column | None = None) -> Column:
    uri = F.concat(F.lit("file://"), path)
    return uri if fragment is None else F.concat(uri, F.coalesce(F.concat(F.lit("#"), fragment), F.lit("")))


@F.pandas_udf(StringType())
def resolved(base: pd.Series, link: pd.Series) -> pd.Series:
    """Links against their base, without fragment; null where that fails."""

    def one(b, x):
        try:
            return None if b is None or x is None else urldefrag(urljoin(b, x))[0]
        except ValueError:
            return None

    return pd.Series([one(b, x) for b, x in zip(base, link)], dtype=object)


@F.pandas_udf(ArrayType(StringType()))
def query_values(url: pd.Series, name: pd.Series) -> pd.Series:
    """All values of a query parameter, in order; repeats show."""
    from urllib.parse import parse_qs, urlsplit

    return pd.Series([None if u is None else parse_qs(urlsplit(u).query, keep_blank_values=True).get(n, []) for u, n in zip(url, name)], dtype=object)
