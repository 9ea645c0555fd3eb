"""Match rules: literal paths and extended glob patterns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filecorpus.functions.globs import (
    extended_glob_regex,
    extended_glob_text,
    is_glob,
    plain_glob_regex,
    plain_glob_regex_column,
)
from filecorpus.functions.paths import file_extension

# The characters that are not plain text in a pattern, in a regex class.
_SPECIAL = r"*?\[\]{}\\"


def with_rule_kind(rules: DataFrame) -> DataFrame:
    """Adds ``is_glob``: literal rules can be met by an equi-join, glob rules cannot."""
    return rules.withColumn("is_glob", is_glob(F.col("pattern")))


def _whole(regex: Column) -> Column:
    return F.concat(F.lit(r"\A(?:"), regex, F.lit(r")\z"))


def match_patterns(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """One row ``path, rule_id, pattern`` per file and configured pattern that matches it.

    Rules are numbered from 0. Every pattern becomes a literal regex of the projection,
    compiled once per task; nothing is joined or moved. One regex of all patterns comes
    first, and only paths that it matches are asked which patterns they are.
    """
    path, hits, every = F.col("path"), [], []
    for rule_id, pattern in enumerate(patterns):
        readings = [r for r in (plain_glob_regex(pattern), extended_glob_text(pattern)) if r is not None]
        if readings:
            regex = "|".join(readings)
            every.append(regex)
            rule = F.struct(F.lit(rule_id).cast("bigint").alias("rule_id"), F.lit(pattern).alias("pattern"))
            hits.append(F.when(path.rlike(rf"\A(?:{regex})\z"), rule))
    if not hits:
        return files.select("path", F.lit(0).cast("bigint").alias("rule_id"), F.lit("").alias("pattern")).limit(0)
    some = path.rlike(rf"\A(?:{'|'.join(every)})\z")
    return files.filter(some).select("path", F.inline(F.array_compact(F.array(*hits))))


# Lengths of the pieces of inner literal text by which rules and paths meet.
_GRAMS = (8, 4, 3, 2, 1)


def _factor(pattern: Column) -> Column:
    """The longest literal text of a pattern that every match has, in either reading."""
    texts = F.split(pattern, rf"(?s)\[.*\]|\\.|[{_SPECIAL}]")
    return F.array_max(F.transform(texts, lambda t: F.struct(F.length(t).alias("n"), t.alias("t"))))["t"]


def _anchor(pattern: Column) -> Column:
    """A join key that every path matched by the pattern has, in either reading.

    Text before the first and after the last special character is literal, and so is text
    between them. ``p:`` is the whole path, ``n:`` its last element, ``d:`` a directory it
    lies in, ``g8:`` to ``g1:`` a piece of that many characters inside, ``e:`` its extension, and
    ``*`` says that the pattern has no such part.
    """
    head = F.regexp_extract(pattern, rf"^[^{_SPECIAL}]*", 0)
    tail = F.regexp_extract(pattern, rf"(?s)(?:\\.)?([^{_SPECIAL}]*)\z", 1)
    directory = F.substring(
        head, F.lit(1), F.length(head) - F.length(F.substring_index(head, "/", -1)) - 1
    )
    factor = _factor(pattern)
    grams = [
        (F.length(factor) >= n, F.concat(F.lit(f"g{n}:"), F.substring(factor, 1, n))) for n in _GRAMS
    ]
    key = (
        F.when(head == pattern, F.concat(F.lit("p:"), pattern))
        .when(tail.contains("/"), F.concat(F.lit("n:"), F.substring_index(tail, "/", -1)))
        .when(head.contains("/"), F.concat(F.lit("d:"), directory))
    )
    # Four characters inside tell more than an extension.
    for long_enough, gram in grams[:2]:
        key = key.when(long_enough, gram)
    key = key.when(tail.contains("."), F.concat(F.lit("e:"), F.substring_index(tail, ".", -1)))
    for long_enough, gram in grams[2:]:
        key = key.when(long_enough, gram)
    return key.otherwise(F.lit("*"))


def _keys(path: Column, kinds: Column) -> Column:
    """The keys of a path of those kinds (what comes before the colon) that some rule has."""

    def of(kind: str, keys: Column) -> Column:
        return F.when(F.array_contains(kinds, kind), keys).otherwise(F.array().cast("array<string>"))

    directories = F.transform(
        F.sequence(F.lit(1), F.size(F.split(path, "/"))),
        lambda i: F.concat(F.lit("d:"), F.call_function("substring_index", path, F.lit("/"), i)),
    )


    def grams(n: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(path) - n + 1)
        pieces = F.transform(
            starts, lambda i: F.concat(F.lit(f"g{n}:"), F.substring(path, i, F.lit(n)))
        )
        return of(f"g{n}", F.when(F.length(path) >= n, F.array_distinct(pieces)).otherwise(F.array().cast("array<string>")))

    return F.concat(
        *map(grams, _GRAMS),
        of("*", F.array(F.lit("*"))),
        of("p", F.array(F.concat(F.lit("p:"), path))),
        of("n", F.array(F.concat(F.lit("n:"), F.substring_index(path, "/", -1)))),
        of("e", F.array(F.concat(F.lit("e:"), file_extension(path)))),
        of("d", directories),
    )


def rule_candidates(files: DataFrame, rules: DataFrame, broadcast: bool = True) -> DataFrame:
    """The pairs of a path and a rule that share the rule's key, before any regex is tried."""
    pattern = F.col("pattern")
    # concat_ws leaves out a reading that does not exist.
    regex = F.concat_ws(
        "|",
        plain_glob_regex_column(pattern),
        F.when(is_glob(pattern), extended_glob_regex(pattern)),
    )
    prepared = rules.select(
        "rule_id",
        "pattern",
        _anchor(pattern).alias("key"),
        F.regexp_extract(pattern, rf"^[^{_SPECIAL}]*", 0).alias("_head"),
        F.regexp_extract(pattern, rf"(?s)(?:\\.)?([^{_SPECIAL}]*)\z", 1).alias("_tail"),
        _whole(regex).alias("_regex"),
    ).filter(plain_glob_regex_column(pattern).isNotNull() | is_glob(pattern))
    kinds = prepared.agg(F.collect_set(F.substring_index("key", ":", 1))).scalar()
    keyed = files.select("path", kinds.alias("_kinds"))
    candidates = keyed.select("path", F.explode(_keys(F.col("path"), F.col("_kinds"))).alias("key"))
    return candidates.join(prepared if broadcast else prepared.hint("merge"), "key")


def match_rules(files: DataFrame, rules: DataFrame, broadcast: bool = True) -> DataFrame:
    """One row ``path, rule_id, pattern`` per file and row of ``rules`` that matches it.

    For tables of rules, of any size. Every rule has one join key (see :func:`_anchor`), also
    if its literal text is inside only (``*backup*``), and a path has those of the kinds that
    occur among the rules, which a subquery tells when the query runs; only rules that are all
    wildcards meet every path. Of the candidates, a literal rule needs no more than its key,
    and the regex of another is only tried on paths that begin and end as its pattern does.
    Spark broadcasts the rules if they are small when they have been read; ``broadcast=False``
    shuffles them in any case, and hot keys are then split by adaptive execution.
    """
    matched = rule_candidates(files, rules, broadcast)
    literal = F.startswith("key", F.lit("p:"))
    tried = F.startswith("path", "_head") & F.endswith("path", "_tail") & F.expr("path rlike _regex")
    return matched.filter(literal | tried).select("path", "rule_id", "pattern")
