"""Path, link and name expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def raw_extension(path: Column) -> Column:
    """Last dot and what follows it; empty when the only dots lead the name."""
    return F.regexp_extract(file_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(raw_extension(path))


def directories(path: Column) -> Column:
    parts = F.split(path, "/")
    return F.slice(parts, F.lit(1), F.size(parts) - 1)


def is_hidden(path: Column) -> Column:
    return F.exists(F.split(path, "/"), lambda part: part.startswith("."))


def file_url(path: Column, namespace: Column, host: str = "https://github.com", branch: str = "main") -> Column:
    """The web page of a file. Paths begin with ``owner/repo``; a commit behind it in the namespace is the version shown."""
    repo = F.concat_ws("/", F.slice(F.split(namespace, "/"), 1, 2))
    commit = F.get(F.split(namespace, "/", 3), F.lit(2))
    inner = F.substring(path, F.length(repo) + 2, F.length(path))
    return F.concat(F.lit(host + "/"), repo, F.lit("/blob/"), F.coalesce(commit, F.lit(branch)), F.lit("/"), inner)


def ascii_only(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\x00-\x7F]", "")


def chunk_id(path: Column, start: Column, end: Column) -> Column:
    """Only ASCII is kept of the path; where that drops characters, part of the whole path's hash keeps ids apart."""
    plain = ascii_only(path)
    name = F.when(plain == path, plain).otherwise(F.concat_ws("~", plain, F.substring(F.md5(path), 1, 16)))
    return F.concat_ws("_", name, start.cast("string"), end.cast("string"))


def chunk_content(path: Column, content: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("\n\n", path, F.substring(content, start + 1, end - start))


def namespace_of(repo: Column, commit: Column | None = None) -> Column:
    return repo if commit is None else F.concat_ws("/", repo, commit)


def safe_namespace(namespace: Column) -> Column:
    """For stores that accept only letters, digits, ``_`` and ``-``."""
    return F.regexp_replace(namespace, r"[^a-zA-Z0-9_-]", "_")


def dataset_name(namespace: Column) -> Column:
    return F.replace(namespace, F.lit("/"), F.lit("_"))


def is_repo_id(repo: Column) -> Column:
    return repo.rlike(r"^[^/]+/[^/]+$")


def fix_path(guess: Column, namespace: Column) -> Column:
    """Put back the missing parts of ``owner/repo`` in front of a guessed path."""
    bare = F.regexp_replace(guess, r"^/", "")
    head, second = F.split_part(bare, F.lit("/"), F.lit(1)), F.split_part(bare, F.lit("/"), F.lit(2))
    owner, repo = F.split_part(namespace, F.lit("/"), F.lit(1)), F.split_part(namespace, F.lit("/"), F.lit(2))
    rest = F.when(F.instr(bare, "/") > 0, F.substr(bare, F.instr(bare, "/") + F.lit(1)))
    return (
        F.when((head == owner) & (second == repo), bare)
        .when(head == owner, F.concat_ws("/", owner, repo, rest))
        .when(head == repo, F.concat_ws("/", owner, bare))
        .otherwise(F.concat_ws("/", owner, repo, bare))
    )


def ancestors(path: Column) -> Column:
    """Every prefix of the path, the path itself last."""
    of = lambda parts: F.transform(
        parts,
        lambda name, at: F.struct(
            F.array_join(F.slice(parts, F.lit(1), at + 1), "/").alias("node_path"), at.alias("depth"), name.alias("name")
        ),
    )
    # The one-element array binds the parts, which are cut once.
    return F.get(F.transform(F.array(F.split(path, "/")), of), F.lit(0))


def path_order(path: Column) -> Column:
    """Sort key that orders like the array of path parts."""
    return F.translate(path, "/", "\u0001")
