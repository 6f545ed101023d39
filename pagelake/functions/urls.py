"""URL handling as Column expressions: splitting, resolving, encoding, comparing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagelake.functions.text import as_col, empty_to_null, let, strip

# Schemes whose references may be relative.
RELATIVE_SCHEMES = [
    "ftp", "http", "gopher", "nntp", "imap", "wais", "file", "https", "shttp", "mms",
    "prospero", "rtsp", "rtsps", "rtspu", "sftp", "svn", "svn+ssh", "ws", "wss",
]

_SCHEME = r"^([A-Za-z][A-Za-z0-9+.\-]*):"
_AFTER_SCHEME = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?"


def split_url(url: Column) -> Column:
    """Struct of scheme, netloc, path, query, fragment; absent parts are empty strings."""
    cleaned = F.regexp_replace(F.ltrim(url), r"[\t\r\n]", "")
    return let(
        cleaned,
        lambda u: F.struct(
            F.lower(F.regexp_extract(u, _SCHEME, 1)).alias("scheme"),
            F.regexp_extract(u, _AFTER_SCHEME + r"//([^/?#]*)", 1).alias("netloc"),
            F.regexp_extract(u, _AFTER_SCHEME + r"(?://[^/?#]*)?([^?#]*)", 1).alias("path"),
            F.regexp_extract(u, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(u, r"(?s)^[^#]*#(.*)", 1).alias("fragment"),
        ),
    )


def join_url(scheme: Column, netloc: Column, path: Column, query: Column, fragment: Column) -> Column:
    rooted = F.when((netloc != "") & (path != "") & ~path.startswith("/"), F.concat(F.lit("/"), path))
    return F.concat(
        F.when(scheme != "", F.concat(scheme, F.lit(":"))).otherwise(""),
        F.when(netloc != "", F.concat(F.lit("//"), netloc)).otherwise(""),
        F.coalesce(rooted, path),
        F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""),
        F.when(fragment != "", F.concat(F.lit("#"), fragment)).otherwise(""),
    )


def _walk_segments(segments: Column) -> Column:
    """Apply ``.`` and ``..`` segments from left to right and rebuild the path."""
    resolved = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda done, seg: F.when(seg == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))))
        .when(seg == ".", done)
        .otherwise(F.concat(done, F.array(seg))),
    )
    tail = F.when(F.element_at(segments, -1).isin(".", ".."), F.array(F.lit(""))).otherwise(
        F.array().cast("array<string>")
    )
    path = F.array_join(F.concat(resolved, tail), "/")
    return F.when(path == "", F.lit("/")).otherwise(path)


def _merge_paths(base_path: Column, path: Column) -> Column:
    base_dir = F.regexp_replace(base_path, r"[^/]*$", "")
    parts = F.split(F.concat(base_dir, path), "/")
    count = F.size(parts)
    inner = F.filter(F.slice(parts, 2, F.greatest(count - 2, F.lit(0))), lambda s: s != "")
    joined = F.when(
        count > 1,
        F.concat(F.slice(parts, 1, 1), inner, F.slice(parts, count, 1)),
    ).otherwise(parts)
    segments = F.when(path.startswith("/"), F.split(path, "/")).otherwise(joined)
    return let(segments, _walk_segments)


def resolve_url(base: Column | str, href: Column | str) -> Column:
    """Absolute form of ``href`` seen from ``base`` (RFC 3986); NULL for an empty reference."""
    base, href = as_col(base), as_col(href)

    def merge(pair: Column) -> Column:
        b, r = pair.b, pair.r
        scheme = F.when(r.scheme != "", r.scheme).otherwise(b.scheme)
        netloc_given = r.netloc != ""
        path_given = r.path != ""
        path = (
            F.when(netloc_given, r.path)
            .when(~path_given, b.path)
            .otherwise(_merge_paths(b.path, r.path))
        )
        query = F.when(~netloc_given & ~path_given & (r.query == ""), b.query).otherwise(r.query)
        merged = join_url(
            scheme, F.when(netloc_given, r.netloc).otherwise(b.netloc), path, query, r.fragment
        )
        same_scheme = (scheme == b.scheme) & ((scheme == "") | scheme.isin(RELATIVE_SCHEMES))
        return F.when(same_scheme, merged).otherwise(href)

    # The common reference, "/path" without dot or empty segments, needs no splitting.
    plain = href.rlike(r"^/(?!/)[^?#\s]*$") & ~href.contains("/.")
    origin = F.regexp_extract(base, r"^(https?://[^/?#\s]+)(?=[/?#]|$)", 1)
    pair = F.struct(split_url(base).alias("b"), split_url(href).alias("r"))
    return (
        F.when(href.isNull() | (href == ""), F.lit(None).cast("string"))
        .when(base.isNull() | (base == ""), href)
        .when(plain & (origin != ""), F.concat(origin, href))
        .otherwise(let(pair, merge))
    )


def resolve_or_keep(base: Column, href: Column) -> Column:
    return F.coalesce(resolve_url(base, href), href)


def _percent_encode(text: Column, safe_class: str) -> Column:
    """Percent-encode the UTF-8 bytes of every character outside the safe class."""
    encoded = F.array_join(
        F.transform(
            F.split(text, ""),
            lambda ch: F.when(ch.rlike(f"^[{safe_class}]*$"), ch).otherwise(
                F.regexp_replace(F.hex(F.encode(ch, "UTF-8")), "(..)", "%$1")
            ),
        ),
        "",
    )
    return F.when(text.rlike(f"^[{safe_class}]*$"), text).otherwise(encoded)


# Characters kept as they are in a requested path and query.
_SAFE_PATH = r"A-Za-z0-9_.~/%\-"
_SAFE_QUERY = r"A-Za-z0-9_.~=&%\-"


def request_url(url: Column | str) -> Column:
    """The URL as requested: path and query percent-encoded, fragment untouched."""
    return let(
        split_url(as_col(url)),
        lambda u: join_url(
            u.scheme,
            u.netloc,
            _percent_encode(u.path, _SAFE_PATH),
            _percent_encode(u.query, _SAFE_QUERY),
            u.fragment,
        ),
    )


def comparable_url(value: Column) -> Column:
    """Form used to compare list values: trimmed, https, without trailing slashes."""
    text = strip(value)
    secure = F.when(
        text.startswith("http://"), F.replace(text, F.lit("http://"), F.lit("https://"))
    ).otherwise(text)
    return F.rtrim(secure, F.lit("/"))


def is_script_url(href: Column) -> Column:
    return F.lower(href).startswith("javascript:")


def final_or_requested(final_url: Column, requested_url: Column) -> Column:
    return F.coalesce(empty_to_null(final_url), requested_url)
