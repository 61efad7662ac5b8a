"""Path predicates P1/P2 and repository locators S11 as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values: folder markers of Ansible files and suffixes of TOSCA files ---
ANSIBLE_FOLDERS = ["playbooks/", "meta/", "tasks/", "handlers/", "roles/"]
TOSCA_SUFFIXES = [".tosca", ".tosca.yaml", ".tosca.yml"]
TOSCA_HEADER = r"\Atosca_definitions_version[ \t\n\r\f]*:[^\n]"
LOCATOR = r"(github|gitlab)\.com/([^/]+)/([^/]+)"


def is_ansible_file(path: Column) -> Column:
    """Non-empty, no ``test/`` anywhere, one of the Ansible folders, ends with ``.yml``."""
    folder = F.lit(False)
    for f in ANSIBLE_FOLDERS:
        folder = folder | path.contains(f)
    ok = (F.length(path) > 0) & ~path.contains("test/") & folder & path.endswith(".yml")
    return F.coalesce(ok, F.lit(False))


def is_tosca_file(path: Column, content: Column | None = None) -> Column:
    """When content is non-empty only the header at offset 0 decides; else the path does."""
    suffix = F.lit(False)
    for s in TOSCA_SUFFIXES:
        suffix = suffix | path.endswith(s)
    by_path = F.coalesce((F.length(path) > 0) & ~path.contains("test") & suffix, F.lit(False))
    if content is None:
        return by_path
    # The header must start the text and carry at least one more character on its line.
    by_content = F.coalesce(content.rlike(TOSCA_HEADER), F.lit(False))
    return F.when(F.length(content) > 0, by_content).otherwise(by_path)


def strip_git_suffix(url: Column) -> Column:
    """Only a trailing ``.git`` is a suffix (the original removed it anywhere)."""
    return F.regexp_replace(url, r"\.git$", "")


def repo_owner(url: Column) -> Column:
    return F.regexp_extract(strip_git_suffix(url), LOCATOR, 2)


def repo_name(url: Column) -> Column:
    return F.regexp_extract(strip_git_suffix(url), LOCATOR, 3)


def is_valid_locator(url: Column) -> Column:
    return F.coalesce(strip_git_suffix(url).rlike(LOCATOR), F.lit(False))


def is_remote(url: Column) -> Column:
    return F.coalesce(url.startswith("git@") | url.startswith("https://"), F.lit(False))
