"""Where a note stands: workspaces, areas, sections, archived paths, roles and file names, from its path alone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from notelake.functions.text import segments

#: Roots, reserved names, flat areas, archive sections and folders of other formats.
WORKSPACES, LIFE, KNOWLEDGE, SYSTEM, ARCHIVE, INBOX = "10_Workspaces", "20_Life", "30_Knowledge", "50_System", "90_Archive", "00_Inbox"
CHILDREN = "Workspaces"
INDEX, LOG, WORKSPACE_MANIFEST, AREA_MANIFEST = "index.md", "log.md", "workspace.md", "area.md"
FLAT = (f"{KNOWLEDGE}/Notes", f"{KNOWLEDGE}/Maps")
ARCHIVED = {"Workspaces": WORKSPACES, "Life": LIFE, "Knowledge": KNOWLEDGE, "System": SYSTEM}
FOREIGN = (f"{SYSTEM}/Templates", f"{SYSTEM}/Skills", f"{SYSTEM}/Agents")
INTEGRATIONS = f"{SYSTEM}/Integrations"
#: A workspace and its innermost child: each name is followed by a slash, so files are no workspaces.
_INNERMOST = f"^((?:{WORKSPACES}|{ARCHIVE}/{CHILDREN}|{LIFE}/[^/]+/{CHILDREN})/[^/]+(?:/{CHILDREN}/[^/]+)*)/"


def _found(column: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(column, pattern, 1), F.lit(""))


def name_of(path: Column) -> Column:
    return F.element_at(segments(path), -1)


def directory_of(path: Column) -> Column:
    return F.regexp_extract(path, "^(.*)/[^/]*$", 1)


def workspace_dir(path: Column) -> Column:
    """The innermost workspace that holds the path, archived ones and those of life areas too; null without."""
    return _found(path, _INNERMOST)


def workspace_section(path: Column) -> Column:
    """The folder of the workspace that holds the path; null for its own files and outside."""
    home = workspace_dir(path)
    rest = F.substring(path, F.length(home) + 2, F.length(path))
    return F.when(F.contains(rest, F.lit("/")), F.element_at(segments(rest), 1))


def area_dir(path: Column) -> Column:
    """The life area that holds the path."""
    return _found(path, f"^({LIFE}/[^/]+)/")


def area_content(path: Column) -> Column:
    """Whether a path is an area's own material: not its manifest or reserved files, not one of its workspaces."""
    return area_dir(path).isNotNull() & workspace_dir(path).isNull() & ~name_of(path).isin(AREA_MANIFEST, INDEX, LOG)


def flat_area(path: Column) -> Column:
    """The area without folders that holds the path."""
    return _found(path, f"^({'|'.join(FLAT)})/")


def effective_path(path: Column) -> Column:
    """An archived path as placement judges it: where it came from. Sections that are not known stay."""
    section, rest = F.regexp_extract(path, f"^{ARCHIVE}/([^/]+)/(.+)$", 1), F.regexp_extract(path, f"^{ARCHIVE}/([^/]+)/(.+)$", 2)
    back = F.coalesce(*[F.when(section == k, F.concat(F.lit(f"{v}/"), rest)) for k, v in ARCHIVED.items()])
    return F.coalesce(back, path)


def archived_counterpart(directory: Column) -> Column:
    """Where a workspace's folder stands once it is archived; null outside workspaces."""
    return F.when(F.startswith(directory, F.lit(f"{WORKSPACES}/")), F.concat(F.lit(f"{ARCHIVE}/{CHILDREN}/"), F.substring(directory, len(WORKSPACES) + 2, 1 << 30)))


def is_foreign_format(path: Column) -> Column:
    """Files of other tools; an integration's own note is none, what lies deeper is."""
    home = directory_of(path)
    inside = F.lit(False)
    for folder in FOREIGN:
        inside = inside | (home == folder) | F.startswith(home, F.lit(f"{folder}/"))
    return inside | F.startswith(home, F.lit(f"{INTEGRATIONS}/"))


def role(path: Column) -> Column:
    """root_index, directory_index, directory_log, foreign_format or concept."""
    return (
        F.when(path == INDEX, "root_index")
        .when(name_of(path) == INDEX, "directory_index")
        .when(name_of(path) == LOG, "directory_log")
        .when(is_foreign_format(path), "foreign_format")
        .otherwise("concept")
    )


#: Names that some file systems refuse, and the most bytes of a name.
REFUSED = ("con", "prn", "aux", "nul", *(f"com{n}" for n in range(1, 10)), *(f"lpt{n}" for n in range(1, 10)))


def slug(title: Column) -> Column:
    """A file's stem for a title: words joined by hyphens, fields (a spaced dash) by underscores; null if nothing is left."""
    fields = F.regexp_replace(title, r"\s+(?:[\x{2013}\x{2014}]|-{2,})\s+", "_")
    safe = F.regexp_replace(F.regexp_replace(fields, r'[<>:"/\\|?*\x00-\x1f]', " "), r"[^\p{L}\p{N}_\s.-]", " ")
    joined = F.regexp_replace(F.regexp_replace(F.trim(safe), r"\s+", "-"), "-{2,}", "-")
    clean = F.lower(F.regexp_replace(F.regexp_replace(joined, "[-_]*_[-_]*", "_"), "^[-_.]+|[-_.]+$", ""))
    return F.when(clean.isin(*REFUSED), F.concat(clean, F.lit("-concept"))).when(clean != "", clean)
