"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extensions of binary files.
BINARY_EXTENSIONS = (
    "pdf", "png", "jpg", "jpeg", "gif", "webp", "ico", "svg", "zip", "tar", "gz", "rar", "7z", "doc", "docx", "xls", "xlsx",
    "ppt", "pptx", "mp3", "mp4", "wav", "avi", "mov", "webm", "woff", "woff2", "ttf", "eot", "otf",
)
# Media types by extension.
MEDIA_TYPES = {
    "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg", "gif": "image/gif",
    "webp": "image/webp", "svg": "image/svg+xml", "zip": "application/zip", "tar": "application/x-tar",
    "doc": "application/msword", "mp3": "audio/mpeg", "mp4": "video/mp4", "wav": "audio/x-wav", "html": "text/html",
    "htm": "text/html", "txt": "text/plain", "css": "text/css", "js": "text/javascript", "json": "application/json", "csv": "text/csv",
}
_SPLIT = r"^(?:([A-Za-z][A-Za-z0-9+.-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"


def _part(url: Column, i: int) -> Column:
    return F.regexp_extract(url, _SPLIT, i)


def scheme(url: Column) -> Column:
    return F.lower(_part(url, 1))


def authority(url: Column) -> Column:
    """User, host and port as they stand; empty without '//'."""
    return _part(url, 2)


def path(url: Column) -> Column:
    return _part(url, 3)


def query(url: Column) -> Column:
    return _part(url, 4)


def origin(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), authority(url))


def domain(url: Column) -> Column:
    """The authority, or else the URL itself."""
    return F.when(authority(url) != "", authority(url)).otherwise(url)


def normalize_url(url: Column) -> Column:
    """Without fragment, and without one last '/' unless the path is just that."""
    bare = F.regexp_replace(url, "#.*$", "")
    return F.when(F.endswith(bare, F.lit("/")) & (path(bare) != "/"), F.substring(bare, F.lit(1), F.length(bare) - 1)).otherwise(bare)


def same_domain(a: Column, b: Column) -> Column:
    """equal authorities."""
    return authority(a) == authority(b)


def is_binary(url: Column) -> Column:
    """the path ends with the extension of a binary file."""
    return F.lower(path(url)).rlike(r"\.(" + "|".join(BINARY_EXTENSIONS) + ")$")


def media_type(url: Column) -> Column:
    """By the path's extension."""
    table = F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path(url), r"\.([A-Za-z0-9]+)$", 1))), F.lit("application/octet-stream"))


def _dots(p: Column) -> Column:
    """A path without '.' and '..' segments."""
    parts = F.split(p, "/")
    last = F.element_at(parts, -1)

    def step(done, x):
        return F.when(x == ".", done).when((x == "..") & (F.size(done) > 1), F.slice(done, F.lit(1), F.size(done) - 1)).when(x == "..", done).otherwise(F.concat(done, F.array(x)))

    kept = F.aggregate(parts, F.array().cast("array<string>"), step)
    return F.array_join(F.when(last.isin(".", ".."), F.concat(kept, F.array(F.lit("")))).otherwise(kept), "/")


def resolve(href: Column, base: Column) -> Column:
    """Href against base: scheme, authority, path and query; no fragment.  '#x' gives base."""
    h = F.regexp_replace(href, "#.*$", "")
    tail = lambda u: F.when(query(u) != "", F.concat(F.lit("?"), query(u))).otherwise("")
    folder = F.regexp_replace(path(base), "[^/]*$", "")
    rooted = lambda p, q: F.concat(origin(base), F.when(F.contains(p, F.lit("/.")), _dots(p)).otherwise(p), q)
    return (
        F.when(scheme(h) != "", F.concat(scheme(h), F.lit("://"), authority(h), path(h), tail(h)))
        .when(F.startswith(h, F.lit("//")), F.concat(scheme(base), F.lit(":"), h))
        .when(F.startswith(h, F.lit("/")), rooted(path(h), tail(h)))
        .when(h == "", F.concat(origin(base), path(base), tail(base)))
        .when(F.startswith(h, F.lit("?")), F.concat(origin(base), path(base), h))
        .otherwise(rooted(F.concat(F.when(folder == "", F.lit("/")).otherwise(folder), path(h)), tail(h)))
    )


def is_web(url: Column) -> Column:
    """http or https."""
    return scheme(url).isin("http", "https")


def owner_repo(url: Column) -> Column:
    """The last two parts of the path."""
    parts = F.split(F.regexp_replace(url, "/+$", ""), "/")
    return F.struct(F.try_element_at(parts, F.lit(-2)).alias("owner"), F.try_element_at(parts, F.lit(-1)).alias("repo"))


def looks_like_html(content_type: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("html"))


def looks_like_pdf(content_type: Column, url: Column) -> Column:
    return F.contains(F.lower(content_type), F.lit("pdf")) | F.endswith(F.lower(url), F.lit(".pdf"))


def main_type(content_type: Column) -> Column:
    """What stands before ';'."""
    return F.trim(F.element_at(F.split(content_type, ";"), 1))
