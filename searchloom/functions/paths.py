"""Predicates and projections on source paths, and references to remote pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from searchloom.contracts import EXCLUDED_DIRS, EXCLUDED_FILES


def section_of(path: Column) -> Column:
    return F.split_part(path, F.lit("/"), F.lit(1))


def relative_to(path: Column, root: str) -> Column:
    """path below root, in POSIX form; a path elsewhere stays as it is."""
    base = root.rstrip("/") + "/"
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    return F.when(F.startswith(p, F.lit(base)), F.substring(p, len(base) + 1, 1 << 30)).otherwise(path)


def excluded(path: Column) -> Column:
    """Whether the policy leaves out a relative path: by its name, or by a parent
    that is excluded or starts with a dot."""
    parts = F.split(path, "/")
    parents = F.slice(parts, 1, F.size(parts) - 1)
    return F.element_at(parts, -1).isin(*EXCLUDED_FILES) | F.exists(parents, lambda p: p.isin(*EXCLUDED_DIRS) | F.startswith(p, F.lit(".")))


def index_path(path: Column) -> Column:
    """A stored path in POSIX form; null if absolute, climbing or empty."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    kept = F.filter(F.split(p, "/"), lambda x: ~x.isin("", "."))
    good = (p != "") & ~F.startswith(p, F.lit("/")) & ~F.array_contains(kept, "..")
    return F.when(good, F.when(F.size(kept) == 0, ".").otherwise(F.array_join(kept, "/")))


def safe(path: Column) -> Column:
    """Whether a manifest may name this path: relative, normalised, no climbing,
    no drive, no backslash, no NUL."""
    parts = F.split(path, "/")
    odd = F.exists(parts, lambda x: x.isin("", ".", ".."))
    return F.coalesce((path != "") & ~odd & ~path.rlike(r"^[A-Za-z]:") & ~F.contains(path, F.lit("\\")) & ~F.contains(path, F.lit("\x00")), F.lit(False))


def page_reference(url: Column, origin: str) -> Column:
    """struct(kind, page_id, space_key, title) of a page id or an address at
    origin; kind is id, display, tiny or invalid."""
    u = F.trim(url)
    path, query = F.try_parse_url(u, F.lit("PATH")), F.try_parse_url(u, F.lit("QUERY"))
    here = (F.concat(F.lower(F.try_parse_url(u, F.lit("PROTOCOL"))), F.lit("://"), F.lower(F.try_parse_url(u, F.lit("AUTHORITY")))) == origin)
    ids = F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit(r"(?:^|&)pageId=([^&]*)"), F.lit(1))
    rest = F.regexp_extract(path, r"/display/(.*)$", 1)
    space, title = F.split_part(rest, F.lit("/"), F.lit(1)), F.regexp_extract(rest, r"^[^/]*/(.*)$", 1)
    plain = u.rlike(r"^[0-9]+$")
    view = here & path.rlike(r"/pages/viewpage\.action$")
    shown = here & ~path.rlike(r"/pages/viewpage\.action$") & F.contains(path, F.lit("/display/"))
    tiny = here & path.rlike(r"^[^?]*/x/[^/]+$") & query.isNull()
    kind = F.when(plain, "id").when(view, F.when((F.size(ids) == 1) & ids[0].rlike(r"^[0-9]+$"), "id").otherwise("invalid")).when(shown, F.when((space != "") & (title != ""), "display").otherwise("invalid")).when(tiny, "tiny").otherwise("invalid")
    unplus = lambda c: F.replace(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), F.lit("+"), F.lit(" "))
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "id", F.when(plain, u).otherwise(F.get(ids, F.lit(0)))).alias("page_id"),
        F.when(kind == "display", F.try_url_decode(F.replace(space, F.lit("+"), F.lit("%2B")))).alias("space_key"),
        F.when(kind == "display", unplus(title)).alias("title"),
    )


def staged_name(attachment: Column, name: Column, limit: int = 255) -> Column:
    """A file name for an attachment that any file system takes."""
    s = F.rtrim(F.regexp_replace(name, r'[\x00-\x1f<>:"/\\|?*]', "_"), F.lit(" ."))
    s = F.when(s == "", "attachment").otherwise(s)
    s = F.when(F.lower(F.split_part(s, F.lit("."), F.lit(1))).rlike(r"^(con|prn|aux|nul|com[1-9]|lpt[1-9])$"), F.concat(F.lit("_"), s)).otherwise(s)
    ext = F.regexp_extract(s, r"[^.](\.[^.]+)$", 1)
    room = F.greatest(F.lit(1), F.lit(limit) - F.length(attachment) - 1 - F.length(ext))
    return F.concat(attachment, F.lit("-"), F.substring(F.substring(s, F.lit(1), F.length(s) - F.length(ext)), F.lit(1), room), ext)


def is_diagram(name: Column) -> Column:
    """Whether an attachment is the source of a diagram, by its name."""
    return F.lower(name).rlike(r"\.(drawio|xml)$")


def flatten(path: Column) -> Column:
    """A path as one file name."""
    return F.replace(path, F.lit("/"), F.lit("__"))
