"""Path expressions.

Every function takes a string column (or column name) and returns a Column, so
path work stays inside the generated code of the stage that needs it.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnOrName = Column | str


def _col(value: ColumnOrName) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _prefix(path: Column, slashes: Column) -> Column:
    """The part of ``path`` before its n-th slash (the whole path if there are fewer)."""
    return F.call_function("substring_index", path, F.lit("/"), slashes)


def base_name(path: ColumnOrName) -> Column:
    """Last path element: trailing slashes go, ``''`` gives ``.`` and ``/`` gives ``/``."""
    path = _col(path)
    trimmed = F.rtrim(path, F.lit("/"))
    return (
        F.when(path == "", F.lit("."))
        .when(trimmed == "", F.lit("/"))
        .otherwise(F.substring_index(trimmed, "/", -1))
    )


def parent_path(path: ColumnOrName) -> Column:
    """Everything before the last slash; ``''`` for a top-level or bare name."""
    path = _col(path)
    name_length = F.length(F.substring_index(path, "/", -1))
    return F.substring(path, F.lit(1), F.greatest(F.length(path) - name_length - 1, F.lit(0)))


def normalize_path(path: ColumnOrName) -> Column:
    """Backslashes become slashes, ``/`` becomes ``''`` and one trailing slash goes."""
    slashed = F.replace(_col(path), F.lit("\\"), F.lit("/"))
    return (
        F.when(slashed == "/", F.lit(""))
        .when(
            (F.length(slashed) > 1) & slashed.endswith("/"),
            F.substring(slashed, F.lit(1), F.length(slashed) - 1),
        )
        .otherwise(slashed)
    )


def path_components(path: ColumnOrName) -> Column:
    """Non-empty elements of the normalised path, as an array."""
    return F.array_remove(F.split(normalize_path(path), "/"), "")


def file_extension(path: ColumnOrName) -> Column:
    """Text after the last dot of the last element, case kept; ``''`` without a dot."""
    last = F.substring_index(_col(path), "/", -1)
    return F.when(F.instr(last, ".") > 0, F.substring_index(last, ".", -1)).otherwise(F.lit(""))


def is_hidden(path: ColumnOrName) -> Column:
    """True if the base name starts with a dot; ``.`` and ``..`` do not count."""
    name = base_name(path)
    return name.startswith(".") & ~name.isin(".", "..")


def is_executable(mode: ColumnOrName) -> Column:
    """True if any of the three execute bits (octal 111) is set."""
    return _col(mode).bitwiseAND(F.lit(0o111)) != 0


def path_under_root(path: ColumnOrName, root: ColumnOrName) -> Column:
    """Path relative to the listing root that produced it (``''`` for the root itself)."""
    path, root = _col(path), _col(root)
    return (
        F.when(path == root, F.lit(""))
        .when(root.isin("", "."), path)
        .when(root == "/", F.substring(path, F.lit(2), F.length(path)))
        .otherwise(F.substring(path, F.length(root) + 2, F.length(path)))
    )


def join_root(root: ColumnOrName, relative: ColumnOrName) -> Column:
    """Inverse of :func:`path_under_root`."""
    root, relative = _col(root), _col(relative)
    return (
        F.when(relative == "", root)
        .when(root.isin("", "."), relative)
        .when(root == "/", F.concat(F.lit("/"), relative))
        .otherwise(F.concat(root, F.lit("/"), relative))
    )


def paths_from_root(path: ColumnOrName, root: ColumnOrName) -> Column:
    """Array of the root, every directory on the way down, and the path itself."""
    root = _col(root)
    relative = path_under_root(path, root)
    steps = F.transform(
        F.sequence(F.lit(1), F.size(F.split(relative, "/"))),
        lambda i: join_root(root, _prefix(relative, i)),
    )
    return F.when(relative == "", F.array(root)).otherwise(F.concat(F.array(root), steps))


def ancestor_keys(path: ColumnOrName) -> Column:
    """Distinct prefixes of the normalised path that end before a slash, and the root ``''``.

    An array usable as equi-join keys: a directory contains the path only if the
    directory's own key is among them.
    """
    path = normalize_path(path)
    slashes = F.size(F.split(path, "/")) - 1
    prefixes = F.transform(F.sequence(F.lit(1), slashes), lambda i: _prefix(path, i))
    return F.when(slashes < 1, F.array(F.lit(""))).otherwise(
        F.array_distinct(F.concat(F.array(F.lit("")), prefixes))
    )


def _clean_elements(path: Column) -> Column:
    """Path elements with ``.`` and empty ones dropped and ``..`` resolved where possible."""
    rooted = path.startswith("/")
    # A leading guard element keeps the accumulator non-empty, so that looking at its
    # last element is always legal; it is cut off at the end.
    guarded = F.aggregate(
        F.split(path, "/"),
        F.array(F.lit("..")),
        lambda done, element: F.when(element.isin("", "."), done)
        .when(element != "..", F.concat(done, F.array(element)))
        .when(F.element_at(done, -1) != "..", F.slice(done, F.lit(1), F.size(done) - 1))
        .when(rooted, done)
        .otherwise(F.concat(done, F.array(element))),
    )
    return F.slice(guarded, F.lit(2), F.size(guarded))


def relative_path(base: ColumnOrName, target: ColumnOrName) -> Column:
    """Path that leads from ``base`` to ``target``, with ``..`` where needed.

    NULL where no such path can be given: one side is absolute and the other is not,
    or ``base`` climbs above where the two meet.
    """
    base, target = _col(base), _col(target)
    base_parts = _clean_elements(base)
    target_parts = _clean_elements(target)
    same = F.zip_with(base_parts, target_parts, lambda b, t: F.coalesce(b == t, F.lit(False)))
    mismatch = F.array_position(same, False)
    shared = F.when(mismatch > 0, (mismatch - 1).cast("int")).otherwise(F.size(same))
    up = F.array_repeat(F.lit(".."), F.size(base_parts) - shared)
    down = F.slice(target_parts, shared + 1, F.size(target_parts))
    impossible = (base.startswith("/") != target.startswith("/")) | F.coalesce(
        F.get(base_parts, shared) == "..", F.lit(False)
    )
    steps = F.array_join(F.concat(up, down), "/")
    return F.when(~impossible, F.when(steps == "", F.lit(".")).otherwise(steps))
