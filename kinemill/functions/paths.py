"""Expressions over file paths and URLs."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
URL_SCHEMES = ["http", "https", "s3", "gs", "gcs", "az", "abfs"]
SENSITIVE_PARAMS = ["token", "access_token", "x-amz-security-token", "sas", "sig"]
DRIVE_HOSTS = ["drive.google.com", "docs.google.com"]
RETRYABLE = [429, 500, 502, 503, 504]
MAX_TAIL = 16


def sanitize(p: Column) -> Column:
    """Forward slashes, none repeated, none at the end; URLs stay as they are."""
    plain = F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "/{2,}", "/")
    return F.when(p.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*://"), p).otherwise(F.when(F.length(plain) > 1, F.regexp_replace(plain, "/$", "")).otherwise(plain))


def parts(p: Column) -> Column:
    """Segments, with "/" first for an absolute path."""
    own = F.filter(F.split(p, "/"), lambda s: s != "")
    return F.when(p.startswith("/"), F.concat(F.array(F.lit("/")), own)).otherwise(own)


def basename(p: Column) -> Column:
    return F.element_at(F.split(p, r"[/\\]"), -1)


def dirname(p: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(p, r"\\", "/"), "/?[^/]*$", "")


def is_url(p: Column) -> Column:
    return F.coalesce(p.rlike(f"(?i)^({'|'.join(URL_SCHEMES)}):"), F.lit(False))


def redact(url: Column) -> Column:
    """User information and the values of sensitive parameters become asterisks."""
    user = F.regexp_replace(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*://)[^/?#@]*@", "$1***:***@")
    return F.regexp_replace(user, rf"(?i)([?&](?:{'|'.join(SENSITIVE_PARAMS)})=)[^&#]*", "$1%2A%2A%2A")


def redact_text(text: Column) -> Column:
    """Error text on one line without user information or sensitive values in its URLs."""
    user = F.regexp_replace(text, rf"(?i)\b((?:{'|'.join(URL_SCHEMES)})://)[^\s\"'<>/?#@]*@", "$1***:***@")
    values = F.regexp_replace(user, rf"(?i)([?&](?:{'|'.join(SENSITIVE_PARAMS)})=)[^&#\s\"'<>]*", "$1%2A%2A%2A")
    return F.trim(F.regexp_replace(values, r"\s*\n\s*", " "))


def drive_id(url: Column) -> Column:
    """File id of a share link: the id parameter, else the /file/d/ path; NULL for folders and other URLs."""
    own = F.try_parse_url(url, F.lit("HOST")).isin(DRIVE_HOSTS)
    path, by_param = F.try_parse_url(url, F.lit("PATH")), F.try_parse_url(url, F.lit("QUERY"), F.lit("id"))
    by_path = F.nullif(F.regexp_extract(path, r"/file/(?:u/\d+/)?d/([^/]+)", 1), F.lit(""))
    return F.when(own & ~F.coalesce(path.rlike(r"(?:drive/)?folders/"), F.lit(False)), F.coalesce(F.nullif(by_param, F.lit("")), by_path))


def retry_after_ms(header: Column) -> Column:
    """Whole seconds only, at most 30 s."""
    return F.when(F.trim(header).rlike(r"^(0|-?[1-9]\d*)$"), F.least(F.trim(header).try_cast("bigint") * 1000, F.lit(30000)))


def backoff_ms(attempt: Column) -> Column:
    return F.least(200 * F.pow(F.lit(2), attempt), F.lit(30000)).cast("bigint")


def retryable(status: Column) -> Column:
    return status.isin(RETRYABLE)


def tail_candidates(p: Column, folder: Column, depth: int = MAX_TAIL) -> Column:
    """The path itself, then its last segments under ``folder``, the longest tail first."""
    own = F.filter(F.split(F.regexp_replace(p, r"\\", "/"), "/"), lambda s: (s != "") & (s != "."))
    n = F.least(F.size(own), F.lit(depth))
    tails = F.transform(F.sequence(n, F.lit(1), F.lit(-1)), lambda k: F.concat(folder, F.lit("/"), F.array_join(F.slice(own, -k, k), "/")))
    return F.array_distinct(F.concat(F.array(sanitize(p)), F.when(n > 0, tails).otherwise(F.array().cast("array<string>"))))


def leaf_suffixes(p: Column) -> Column:
    """(depth, suffix) for every number of trailing segments."""
    own = parts(sanitize(p))
    return F.transform(F.sequence(F.lit(1), F.size(own)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(own, -k, k), "/").alias("suffix")))


def pieces(p: Column) -> Column:
    """root and parts of a path of any platform; the root is ``//`` (a share), a drive, ``/`` or empty."""
    text = F.regexp_replace(p, r"\\", "/")
    root = F.regexp_extract(text, "^(//|[A-Za-z]:/?|/)", 1)
    own = F.filter(F.split(F.substr(text, F.length(root) + 1), "/"), lambda s: (s != "") & (s != "."))
    return F.struct(root.alias("root"), own.alias("parts"))


def spelled(path: Column) -> Column:
    """The text of pieces()."""
    return F.concat(path["root"], F.array_join(path["parts"], "/"))


def _under(folder: Column, parts_: Column) -> Column:
    return F.concat(folder["root"], F.array_join(F.concat(folder["parts"], parts_), "/"))


def _last(parts_: Column, n: Column) -> Column:
    """The last n parts."""
    return F.slice(parts_, F.size(parts_) - n + 1, n)


def anchor(p: Column, folder: Column) -> Column:
    """What stands in ``p`` after the longest tail of ``folder`` that its folders hold, put under ``folder``; else NULL.

    Folders are matched as text between slashes, where the last place counts.
    """
    path, base = pieces(p), pieces(folder)
    n = F.size(path["parts"])
    inner = F.concat(F.lit("/"), F.array_join(F.slice(path["parts"], 1, F.greatest(n - 1, F.lit(0))), "/"), F.lit("/"))
    file = F.element_at(path["parts"], -1)

    def graft(k: Column) -> Column:
        tail = F.concat(F.lit("/"), F.array_join(_last(base["parts"], k), "/"), F.lit("/"))
        after = F.call_function("substring_index", inner, tail, F.lit(-1))
        return F.when(F.contains(inner, tail), F.concat(spelled(base), F.lit("/"), after, file))

    longest = F.least(n - 1, F.size(base["parts"]))
    return F.when(longest > 0, F.get(F.filter(F.transform(F.sequence(F.greatest(longest, F.lit(1)), F.lit(1), F.lit(-1)), graft), lambda c: c.isNotNull()), F.lit(0)))


def candidates(p: Column, folder: Column, depth: int = MAX_TAIL) -> Column:
    """Places where a stored path may lie, best first: itself, under the folder if relative, its anchor, its tails."""
    path, base = pieces(p), pieces(folder)
    n = F.least(F.size(path["parts"]), F.lit(depth))
    tails = F.when(n > 0, F.transform(F.sequence(F.greatest(n, F.lit(1)), F.lit(1), F.lit(-1)), lambda k: _under(base, _last(path["parts"], k)))).otherwise(F.array().cast("array<string>"))
    first = F.array(spelled(path), F.when(path["root"] == "", _under(base, path["parts"])), anchor(p, folder))
    return F.array_distinct(F.filter(F.concat(first, tails), lambda c: c.isNotNull() & (c != "")))


def prefix_swap(stored: Column, found: Column) -> Column:
    """old and new: the leading pieces of either path before what they share at the end."""
    a, b = pieces(stored), pieces(found)
    most = F.least(F.size(a["parts"]), F.size(b["parts"]))
    shared = F.when(most > 0, F.size(F.filter(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), lambda k: _last(a["parts"], k) == _last(b["parts"], k)))).otherwise(0)
    cut = lambda x: F.struct(x["root"].alias("root"), F.slice(x["parts"], 1, F.size(x["parts"]) - shared).alias("parts"))
    return F.struct(cut(a).alias("old"), cut(b).alias("new"))


def apply_swap(p: Column, swap: Column) -> Column:
    """The path with the new prefix if it begins with the old one, else as it is."""
    path, old = pieces(p), swap["old"]
    n = F.size(old["parts"])
    fits = (path["root"] == old["root"]) & (F.slice(path["parts"], 1, n) == old["parts"])
    return F.when(fits, _under(swap["new"], F.slice(path["parts"], n + 1, F.greatest(F.size(path["parts"]) - n, F.lit(0))))).otherwise(spelled(path))


def unique_videos(videos, query: str, path: str = "path"):
    """``videos`` that a path names: by the whole path, else by the base name; an error if several share it."""
    q = F.lit(query)
    same = F.when(sanitize(F.col(path)) == sanitize(q), 1).when(basename(sanitize(F.col(path))) == basename(sanitize(q)), 2)
    ranked = videos.withColumn("tier", same).where("tier is not null")
    best = ranked.where(F.col("tier") == ranked.agg(F.min("tier")).first()[0]) if not ranked.isEmpty() else ranked
    if best.count() > 1:
        raise ValueError(f"{redacted(query)} names several videos")
    return best.drop("tier")


def redacted(text: str) -> str:
    """A path for messages: no user information."""
    return re.sub(r"(://)[^/?#@]*@", r"\1***:***@", text)
