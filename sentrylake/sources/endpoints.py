"""Which folders of a workstation a scan means: aliases turned into scopes, and the files of several roots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Aliases of folders of a profile, and what is read where nothing is asked for.
PROFILE_FOLDERS = {"desktop": "Desktop", "documents": "Documents", "downloads": "Downloads"}
SCOPE = "kind string, profile string, path string"


def windows_path(path: str) -> str:
    """With back slashes; a drive alone is its root."""
    turned = path.replace("/", "\\")
    return turned + "\\" if re.fullmatch(r"[A-Za-z]:", turned) else turned


def scopes(paths: list[str], profile: str = "") -> list[tuple[str, str, str]]:
    """(kind, profile, path) of each alias or path, in order, without repeats.

    Kinds: ``folder`` (of one profile, or of all where none is named), ``standard`` (the usual folders of a profile), ``profile``
    (all of it), ``profiles`` (of all users), ``onedrive``, ``drives`` (all fixed ones), ``path`` (absolute), ``relative`` (to the profile).
    """
    profile = profile.strip()
    asked = [p.strip() for p in paths if p.strip()] or list(PROFILE_FOLDERS)
    out = []
    for item in asked:
        alias = item.lower()
        if alias in PROFILE_FOLDERS:
            out.append(("folder", profile, PROFILE_FOLDERS[alias]))
        elif alias == "profile_standard":
            out.append(("standard", profile, ""))
        elif alias == "all":
            out.append(("profile", profile, "") if profile else ("profiles", "", ""))
        elif alias == "all_profiles":
            out.append(("profiles", "", ""))
        elif alias == "onedrive":
            out.append(("onedrive", profile, ""))
        elif alias == "c_drive":
            out.append(("path", "", "C:\\"))
        elif alias == "all_fixed_drives":
            out.append(("drives", "", ""))
        elif re.match(r"[A-Za-z]:[\\/]", item) or item.startswith("\\\\"):
            out.append(("path", "", windows_path(item)))
        elif profile:
            out.append(("relative", profile, item.replace("/", "\\").strip("\\")))
        else:
            out.append(("path", "", "C:\\Users\\" + item.replace("/", "\\").strip("\\")))
    return list(dict.fromkeys(out))


def in_scopes(files: DataFrame, wanted: list[tuple[str, str, str]]) -> DataFrame:
    """The files (path) that lie in any of the scopes of :func:`scopes`; a filter, so it reaches the scan."""
    path = F.lower(F.translate("path", "/", "\\"))
    user = F.regexp_extract(path, r"^[a-z]:\\users\\([^\\]+)\\", 1)
    rest = F.regexp_extract(path, r"^[a-z]:\\users\\[^\\]+\\(.*)$", 1)
    standard = "|".join(f.lower() for f in PROFILE_FOLDERS.values())
    kept = F.lit(False)
    for kind, profile, where in wanted:
        mine = (user == profile.lower()) if profile else (user != "")
        below = where.lower().rstrip("\\") + "\\"
        kept = kept | {
            "folder": mine & rest.startswith(below), "standard": mine & rest.rlike(rf"^(?:{standard})\\"), "profile": mine, "profiles": user != "",
            "onedrive": mine & rest.startswith("onedrive"), "drives": path.rlike(r"^[a-z]:\\"), "path": path.startswith(below), "relative": mine & (rest.startswith(below) | (rest == below[:-1])),
        }[kind]
    return files.where(kept)


def of_workstation(roots: list[DataFrame]) -> DataFrame:
    """The files of several roots of one machine in one table: read as its own, without access lists; a path under two roots once."""
    every = roots[0]
    for more in roots[1:]:
        every = every.unionByName(more, allowMissingColumns=True)
    none = F.array().cast("array<string>")
    return every.dropDuplicates(["path"]).withColumns({"source": F.lit("endpoint-local"), "principals": none, "permissions": none, "has_acl": F.lit(False)})


def with_access(files: DataFrame, lists: DataFrame) -> DataFrame:
    """``files`` with owner, principals, permissions of ``lists`` (path, principals, permissions, owner), joined by path whatever its slashes and case."""
    key = lambda c: F.lower(F.translate(c, "/", "\\"))
    side = lists.select(key("path").alias("key"), "owner", "principals", "permissions").groupBy("key").agg(
        F.max("owner").alias("owner"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("principals")))).alias("principals"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("permissions")))).alias("permissions"),
    )
    kept = [c for c in files.columns if c not in ("owner", "principals", "permissions", "has_acl")]
    joined = files.select(*kept).withColumn("key", key("path")).join(side, "key", "left")
    return joined.withColumn("has_acl", F.col("principals").isNotNull()).drop("key")
