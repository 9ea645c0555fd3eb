"""Registered queries, each over whole tables and, where SQL can say it, with that SQL.

A query takes (spark, folder of the parquet tables) and returns a DataFrame. The SQL is
DuckDB's and reads views of the same names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filecorpus.functions import paths as P
from filecorpus.functions.content import content_hash, content_prefix, printable_strings
from filecorpus.operators import compare, dedup, filters, rules, tree
from filecorpus.operators.batching import assemble_batches
from filecorpus.operators.seen import SeenKeys
from filecorpus.operators.fingerprint import (
    file_lines,
    fingerprint,
    json_records,
    string_frequency,
    string_rows,
    with_content_hash,
)
from filecorpus.plans.inventory import inventory_of
from filecorpus.schema import FINGERPRINT
from filecorpus.sinks.tables import write_results
from filecorpus.sources.corpora import (
    conversation_files,
    document_files,
    document_tree,
    page_files,
)
from filecorpus.staging import new_folder, stage
from filecorpus.streaming.dedup import write_unique

Query = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    run: Query
    sql: str | None


REGISTRY: dict[str, Registered] = {}

# Batches that documents arrive in, on a stream.
ARRIVALS = 3


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        REGISTRY[name or run.__name__] = Registered(run, sql)
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def documents(spark: SparkSession, folder: str, root: str = "/corpus") -> DataFrame:
    return document_files(table(spark, folder, "documents"), root)


def pages(spark: SparkSession, folder: str) -> DataFrame:
    return page_files(table(spark, folder, "pages"))


def conversations(spark: SparkSession, folder: str) -> DataFrame:
    return conversation_files(table(spark, folder, "conversations"))


# The same adapters in SQL.
FILES = """
files AS (
  SELECT *, parent || '/' || name AS path FROM (
    SELECT doc_id, lang, source, text, '/corpus' AS root,
      CASE WHEN doc_id % 10 = 0 THEN '.' ELSE '' END || doc_id
        || CASE doc_id % 3 WHEN 0 THEN '.txt' WHEN 1 THEN '.log' ELSE '.bin' END AS name,
      '/corpus/' || source || CASE WHEN doc_id % 4 = 0 THEN '' ELSE '/' || lang END AS parent,
      CASE WHEN doc_id % 4 = 0 THEN 1 ELSE 2 END AS depth,
      CASE WHEN doc_id % 13 = 0 THEN 'symlink' ELSE 'file' END AS kind,
      CAST(strlen(text) AS BIGINT) AS size,
      CASE WHEN doc_id % 7 = 0 THEN 493 ELSE 420 END AS mode
    FROM documents))
"""
TREE = f"""{FILES},
dirs AS (
  SELECT DISTINCT unnest(['/corpus', '/corpus/' || source, '/corpus/' || source || '/' || lang])
    AS path FROM documents),
tree AS (
  SELECT path, parent, kind FROM files
  UNION ALL SELECT path, regexp_replace(path, '/[^/]*$', ''), 'dir' FROM dirs)
"""
PAGES = """
pagefiles AS (
  SELECT *, split_part(path, '/', -1) AS last, CAST(strlen(html) AS BIGINT) AS size
  FROM (SELECT page_id, html, regexp_extract(url, '^[^:/]+://([^?#]*)', 1) AS path FROM pages))
"""
RUNS = r"regexp_extract_all({}, '[\x20-\x7E]{{4,}}')"


# ---------------------------------------------------------------- content


def _hash_query(algorithm: str, sql: str | None) -> None:
    @query(sql, name=f"hash_{algorithm}")
    def run(spark: SparkSession, folder: str) -> DataFrame:
        return documents(spark, folder).select(
            "doc_id", content_hash(F.col("content"), algorithm).alias("hash")
        )


for _name in ("md5", "sha1", "sha256"):
    _hash_query(_name, f"SELECT doc_id, {_name}(text) AS hash FROM documents")
_hash_query("sha512", None)


@query(
    f"""SELECT doc_id, CAST(len(list_distinct({RUNS.format("text")})) AS BIGINT) AS n_strings
    FROM documents"""
)
def strings_count(spark: SparkSession, folder: str) -> DataFrame:
    strings = printable_strings(F.col("content"))
    return documents(spark, folder).select(
        "doc_id", F.size(strings).cast("bigint").alias("n_strings")
    )


@query(
    f"""WITH {FILES}, runs AS (
      SELECT path, unnest(r) AS string, unnest(range(len(r))) AS place
      FROM (SELECT path, {RUNS.format("text")} AS r FROM files)),
    firsts AS (SELECT path, string, min(place) AS place FROM runs GROUP BY path, string)
    SELECT path, CAST(row_number() OVER (PARTITION BY path ORDER BY place) - 1 AS INTEGER) AS pos, string
    FROM firsts"""
)
def strings_exploded(spark: SparkSession, folder: str) -> DataFrame:
    return string_rows(documents(spark, folder))


# Every character of n bytes becomes n unprintable ones, so that SQL can cut by bytes.
@query(
    r"""WITH ascii AS (
      SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text,
        '[\x{80}-\x{7FF}]', chr(127) || chr(127), 'g'),
        '[\x{800}-\x{FFFF}]', repeat(chr(127), 3), 'g'),
        '[\x{10000}-\x{10FFFF}]', repeat(chr(127), 4), 'g') AS text FROM documents),
    blocks AS (
      SELECT doc_id, substr(text, CAST(i * 4096 + 1 AS BIGINT), 4096) AS block
      FROM (SELECT doc_id, text, unnest(range(CAST(ceil(length(text) / 4096.0) AS BIGINT))) AS i
            FROM ascii)),
    runs AS (SELECT doc_id, unnest(regexp_extract_all(block, '[\x20-\x7E]{4,}')) AS s FROM blocks)
    SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_strings
    FROM documents LEFT JOIN (SELECT doc_id, count(DISTINCT s) AS n FROM runs GROUP BY 1) USING (doc_id)"""
)
def strings_in_blocks(spark: SparkSession, folder: str) -> DataFrame:
    strings = printable_strings(F.col("content"), block=4096)
    return documents(spark, folder).select(
        "doc_id", F.size(strings).cast("bigint").alias("n_strings")
    )


def _frequency_sql(source: str, text: str) -> str:
    return f"""WITH {source}, runs AS (
      SELECT path, unnest({RUNS.format(text)}) AS string FROM {source.split()[0]})
    SELECT string, count(*) AS occurrences, count(DISTINCT path) AS paths FROM runs GROUP BY 1"""


@query(_frequency_sql(FILES, "text"))
def string_frequency_documents(spark: SparkSession, folder: str) -> DataFrame:
    return string_frequency(documents(spark, folder))


@query(_frequency_sql(PAGES, "html"), name="string_frequency")
def string_frequency_pages(spark: SparkSession, folder: str) -> DataFrame:
    return string_frequency(pages(spark, folder))


@query(
    r"""WITH parts AS (
      SELECT conv_id || '/' || turn AS path,
        string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS lines
      FROM conversations WHERE text <> '')
    SELECT path, CAST(unnest(range(len(lines))) AS INTEGER) AS line_no, unnest(lines) AS line FROM parts""",
    name="file_lines",
)
def lines_of_conversations(spark: SparkSession, folder: str) -> DataFrame:
    return file_lines(conversations(spark, folder))


@query(
    f"""WITH {FILES} SELECT path, least(size, 1024) AS n_bytes,
      md5(array_slice(encode(text), 1, 1024)) AS prefix_hash FROM files""",
    name="content_prefix",
)
def prefix_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    prefix = content_prefix(F.col("content"), 1024)
    return documents(spark, folder).select(
        "path",
        F.octet_length(prefix).cast("bigint").alias("n_bytes"),
        F.md5(prefix).alias("prefix_hash"),
    )


# ---------------------------------------------------------------- fingerprints

SIZE_CAP = 4000
CAPPED = f"""{FILES},
prints AS (
  SELECT *, CASE WHEN size <= {SIZE_CAP} THEN sha256(text) END AS hash,
    CASE WHEN size > {SIZE_CAP} THEN 'file too large (' || size || ' bytes)' END AS error
  FROM files)
"""
# All documents, some of which cannot be read.
FINGERPRINTS = f"""{FILES},
prints AS (
  SELECT *, CASE WHEN doc_id % 17 <> 3 THEN sha256(text) END AS hash,
    CASE WHEN doc_id % 17 = 3 THEN 'open error: no content' END AS error
  FROM files)
"""


def with_unreadable(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as files, of which one in seventeen has no content."""
    readable = F.when(F.col("doc_id") % 17 != 3, F.col("content"))
    return documents(spark, folder).withColumn("content", readable)


@query(
    f"""WITH {CAPPED} SELECT path, name, size, hash, 'sha256' AS hash_algorithm,
      CASE WHEN error IS NULL THEN CAST(len(list_distinct({RUNS.format("text")})) AS INTEGER) END
        AS n_strings, error, mode = 493 AS is_executable FROM prints"""
)
def fingerprint_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints under a size limit, which is the feature shown here."""
    rows = fingerprint(documents(spark, folder), extract_strings=True, max_size=SIZE_CAP)
    return rows.withColumn("n_strings", F.array_size("strings")).select(
        "path", "name", "size", "hash", "hash_algorithm", "n_strings", "error", "is_executable"
    )


@query(
    f"""WITH {FILES} SELECT 'hash error: unsupported hash algorithm: crc32' AS error,
      count(*) AS files, count(*) FILTER (mode = 493) AS executables FROM files"""
)
def unsupported_algorithm(spark: SparkSession, folder: str) -> DataFrame:
    rows = fingerprint(documents(spark, folder), "crc32")
    return rows.groupBy("error").agg(
        F.count(F.lit(1)).alias("files"), F.count_if("is_executable").alias("executables")
    )


PROCESSED = "2024-06-01T12:00:00Z"


@query(
    f"""WITH {FINGERPRINTS}, strings AS (
      SELECT *, list_distinct({RUNS.format("text")}) AS s FROM prints)
    SELECT path,
      '{{"path":"' || path || '","name":"' || name || '","size":' || size || ',"modTime":"'
      || strftime(TIMESTAMP '2024-01-01' + to_seconds(doc_id), '%Y-%m-%dT%H:%M:%SZ')
      || '","hash":"' || coalesce(hash, '') || '","hashAlgorithm":"sha256"'
      || CASE WHEN error IS NULL THEN '' ELSE ',"error":"' || error || '"' END
      || CASE WHEN mode = 493 THEN ',"isExecutable":true' ELSE '' END
      || ',"processedAt":"{PROCESSED}"}}' AS record,
      CASE WHEN error IS NULL THEN CAST(len(s) AS INTEGER) ELSE 0 END AS n_strings,
      CASE WHEN error IS NULL THEN md5(array_to_string(list_sort(s), chr(10))) ELSE md5('') END AS strings_md5
    FROM strings""",
    name="json_records",
)
def records_of_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Records of all documents; their strings, whose order SQL does not keep, are digested."""
    rows = fingerprint(with_unreadable(spark, folder), extract_strings=True)
    # The time of processing differs from run to run, so it is a fixed one here.
    rows = rows.withColumn("processed_at", F.lit(PROCESSED).cast("timestamp"))
    full = json_records(rows, *rows.columns).withColumnRenamed("record", "full")
    found = json_records(full.withColumn("strings", F.lit(None).cast("array<string>")), "path", "full")
    strings = F.coalesce(
        F.from_json("full", "strings array<string>")["strings"], F.array().cast("array<string>")
    )
    return found.select(
        "path",
        "record",
        F.size(strings).alias("n_strings"),
        F.md5(F.array_join(F.sort_array(strings), "\n")).alias("strings_md5"),
    )


@query(
    f"""WITH {FILES} SELECT path, 'sha256:' || sha256(text) AS by_hash, path AS by_path,
      name || '#' || size AS by_name FROM files"""
)
def dedup_keys(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprint(documents(spark, folder)).select(
        "path",
        dedup.dedup_key("hash").alias("by_hash"),
        dedup.dedup_key("path").alias("by_path"),
        dedup.dedup_key("name").alias("by_name"),
    )


# ---------------------------------------------------------------- listing filters


@query(f"WITH {FILES} SELECT path FROM files WHERE depth <= 1")
def filter_depth(spark: SparkSession, folder: str) -> DataFrame:
    return filters.within_depth(documents(spark, folder), 1).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE name NOT LIKE '.%'")
def filter_hidden(spark: SparkSession, folder: str) -> DataFrame:
    return filters.skip_hidden(documents(spark, folder)).select("path")


@query(f"WITH {FILES} SELECT path FROM files WHERE kind = 'file'")
def filter_regular(spark: SparkSession, folder: str) -> DataFrame:
    return filters.regular_files(documents(spark, folder)).select("path")


@query(f"WITH {FILES} SELECT path, size FROM files WHERE size <= 2000")
def filter_size(spark: SparkSession, folder: str) -> DataFrame:
    return filters.max_file_size(documents(spark, folder), 2000).select("path", "size")


@query(f"WITH {FILES} SELECT path FROM files WHERE mode & 73 <> 0")
def filter_exec(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).filter(P.is_executable("mode")).select("path")


# A malformed pattern, a directory by name, a directory by path, two kinds of files.
EXCLUDES = ("*.log", "src1", "/corpus/src[2-4]/[!a-e]*", "/corpus/src5/en", "[bad", "*7?.b?n")


@query(
    rf"""WITH {FILES} SELECT path FROM files
    WHERE NOT regexp_matches(name, '^[^/]*\.log$') AND source <> 'src1'
      AND NOT regexp_matches(path, '^/corpus/src[2-4]/[!a-e]')
      AND NOT starts_with(path, '/corpus/src5/en/')
      AND NOT regexp_matches(name, '^[^/]*7[^/]\.b[^/]n$')"""
)
def exclude_globs(spark: SparkSession, folder: str) -> DataFrame:
    return filters.exclude_globs(documents(spark, folder), EXCLUDES).select("path")


@query(
    f"""WITH {FILES} SELECT path, count(*) AS times FROM (
      SELECT path FROM files UNION ALL
      SELECT path FROM files WHERE starts_with(path, '/corpus/src1/')) GROUP BY 1"""
)
def union_roots(spark: SparkSession, folder: str) -> DataFrame:
    return overlapping(spark, folder).groupBy("path").agg(F.count(F.lit(1)).alias("times"))


def overlapping(spark: SparkSession, folder: str) -> DataFrame:
    """The corpus listed from two roots, one inside the other: a bag union."""
    return filters.below_roots(documents(spark, folder), ["/corpus", "/corpus/src1"])


# ---------------------------------------------------------------- rules

PATTERNS = ("**/en/*.txt", "/corpus/src?/*.log", "/corpus/src1*/**", "*.bin", "/corpus/{a}/x", "**7.txt")


@query(
    rf"""WITH {FILES}, rules(rule_id, pattern, regex) AS (VALUES
      (0, '**/en/*.txt', '.*/en/[^/]*\.txt'), (1, '/corpus/src?/*.log', '/corpus/src[^/]/[^/]*\.log'),
      (2, '/corpus/src1*/**', '/corpus/src1[^/]*/.*'), (3, '*.bin', '[^/]*\.bin'),
      (4, '/corpus/{{a}}/x', '/corpus/\{{a\}}/x'), (5, '**7.txt', '.*7\.txt'))
    SELECT path, CAST(rule_id AS BIGINT) AS rule_id, pattern FROM files, rules
    WHERE regexp_full_match(path, regex)""",
    name="match_rules",
)
def match_configured_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.match_patterns(documents(spark, folder), PATTERNS)


def derived_rules(spark: SparkSession, folder: str) -> DataFrame:
    """A rules table that grows with the corpus: a literal rule for every link, and two
    glob rules for every directory of files."""
    files = documents(spark, folder)
    literal = files.filter("kind = 'symlink'").select(F.col("path").alias("pattern"))
    folders = files.select("parent").distinct()
    globs = folders.select(
        F.explode(
            F.array(
                F.concat("parent", F.lit("/*.txt")), F.concat("parent", F.lit("/**[0-4].log"))
            )
        ).alias("pattern")
    )
    return literal.unionByName(globs).select(F.xxhash64("pattern").alias("rule_id"), "pattern")


DERIVED = f"""{FILES}, rules AS (
  SELECT path AS pattern, false AS is_glob FROM files WHERE kind = 'symlink'
  UNION ALL SELECT DISTINCT parent || '/*.txt', true FROM files
  UNION ALL SELECT DISTINCT parent || '/**[0-4].log', true FROM files)
"""


# In the plain reading "**[0-4].log" stays inside one directory and the brackets are a class.
# The second reading takes the brackets literally, and no path has any.
DERIVED_MATCHES = rf"""WITH {DERIVED}
    SELECT path, pattern FROM files JOIN rules ON NOT is_glob AND path = pattern
    UNION ALL SELECT path, parent || '/*.txt' FROM files WHERE name LIKE '%.txt'
    UNION ALL SELECT path, parent || '/**[0-4].log' FROM files
      WHERE regexp_matches(name, '[0-4]\.log$')"""


@query(DERIVED_MATCHES)
def match_rules_table(spark: SparkSession, folder: str) -> DataFrame:
    matched = rules.match_rules(documents(spark, folder), derived_rules(spark, folder))
    return matched.select("path", "pattern")


@query(DERIVED_MATCHES)
def match_rules_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The same as if the rules were too many to broadcast."""
    matched = rules.match_rules(documents(spark, folder), derived_rules(spark, folder), broadcast=False)
    return matched.select("path", "pattern")


@query(f"WITH {DERIVED} SELECT is_glob, count(*) AS n_rules FROM rules GROUP BY 1")
def rule_kinds(spark: SparkSession, folder: str) -> DataFrame:
    kinds = rules.with_rule_kind(derived_rules(spark, folder))
    return kinds.groupBy("is_glob").agg(F.count(F.lit(1)).alias("n_rules"))


# ---------------------------------------------------------------- duplicates


@query(
    f"""WITH {FILES} SELECT path, sha256(text) AS hash FROM files
    QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY path) = 1"""
)
def dedup_hash(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.deduplicate(fingerprint(documents(spark, folder))).select("path", "hash")


@query(
    f"""WITH {PAGES} SELECT path, md5(html) AS hash FROM pagefiles
    QUALIFY row_number() OVER (PARTITION BY md5(html) ORDER BY path) = 1"""
)
def dedup_hash_pages(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.deduplicate(fingerprint(pages(spark, folder), "md5")).select("path", "hash")


@query(f"WITH {FILES} SELECT path, size FROM files")
def dedup_path(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.deduplicate(fingerprint(overlapping(spark, folder)), "path").select("path", "size")


@query(
    """SELECT conv_id || '/' || turn AS path, CAST(turn AS VARCHAR) AS name,
      CAST(strlen(text) AS BIGINT) AS size FROM conversations
    QUALIFY row_number() OVER (PARTITION BY turn, strlen(text) ORDER BY conv_id || '/' || turn) = 1"""
)
def dedup_name(spark: SparkSession, folder: str) -> DataFrame:
    rows = fingerprint(conversations(spark, folder), "md5")
    return dedup.deduplicate(rows, "name").select("path", "name", "size")


@query(
    f"""WITH {FILES} SELECT path FROM files
    QUALIFY row_number() OVER (PARTITION BY sha1(text) ORDER BY path) = 1"""
)
def dedup_unknown_type(spark: SparkSession, folder: str) -> DataFrame:
    rows = fingerprint(documents(spark, folder), "sha1")
    return dedup.deduplicate(rows, "size").select("path")


@query(
    f"""WITH {FILES}, bag AS (
      SELECT path, text FROM files UNION ALL
      SELECT path, text FROM files WHERE starts_with(path, '/corpus/src1/')),
    groups AS (
      SELECT path, sha256(text) AS hash, min(path) OVER (PARTITION BY sha256(text)) AS kept_path FROM bag)
    SELECT 'sha256:' || hash AS key, path, kept_path,
      CAST(count(*) - CASE WHEN path = kept_path THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM groups GROUP BY hash, path, kept_path
    HAVING count(*) > CASE WHEN path = kept_path THEN 1 ELSE 0 END"""
)
def duplicate_report(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.duplicate_report(fingerprint(overlapping(spark, folder)))


@query(
    f"""WITH {FINGERPRINTS} SELECT count(*) AS total, count(DISTINCT hash) AS unique_files,
      count(*) - count(DISTINCT hash) AS duplicates, count(error) AS errors FROM prints"""
)
def dedup_summary(spark: SparkSession, folder: str) -> DataFrame:
    return dedup.dedup_summary(fingerprint(with_unreadable(spark, folder)))


@query(
    f"""WITH {FILES} SELECT path, sha256(text) AS hash FROM files
    WHERE sha256(text) NOT IN (SELECT sha256(text) FROM files WHERE depth = 1)
    QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY path) = 1"""
)
def dedup_against_seen(spark: SparkSession, folder: str) -> DataFrame:
    rows = fingerprint(documents(spark, folder))
    earlier = fingerprint(documents(spark, folder).filter("depth = 1"))
    seen = dedup.deduplicate(earlier).select(dedup.dedup_key().alias("key"))
    return dedup.unseen(rows, seen).select("path", "hash")


# Which copy comes first in a stream depends on its files, so only the key is compared.
@query("SELECT DISTINCT sha256(text) AS hash, CAST(strlen(text) AS BIGINT) AS size FROM documents")
def incremental_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Documents arrive in several batches; a key of one suppresses those of later ones."""
    arrivals = new_folder(spark, "arrivals")
    docs = table(spark, folder, "documents")
    each = _arrive(docs, arrivals)
    stream = (
        spark.readStream.schema(docs.schema)
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", each)
        .parquet(arrivals)
    )
    output, checkpoint = new_folder(spark, "unique"), new_folder(spark, "dedup-state")
    write_unique(fingerprint(document_files(stream)), output, checkpoint).awaitTermination()
    return spark.read.schema(FINGERPRINT).parquet(output).select("hash", "size")


def _arrive(docs: DataFrame, folder: str) -> int:
    """Write documents as files that make ``ARRIVALS`` batches; how many files are one batch.

    Every task cuts what it reads itself, so there are as many files as the input has splits,
    and no task gets a share of the whole table.
    """
    part = F.pmod(F.hash("doc_id"), F.lit(ARRIVALS)).alias("arrival")
    docs.select("*", part).write.partitionBy("arrival").parquet(folder)
    written = docs.sparkSession.read.schema(docs.schema).option("recursiveFileLookup", "true")
    files = len(written.parquet(folder).inputFiles())
    if not files:
        # An empty table arrives too, as a file without rows.
        docs.limit(0).write.mode("append").parquet(folder)
    return max(1, -(-files // ARRIVALS))


def _arrivals(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The documents as three batches of files that arrive one after the other."""
    docs = table(spark, folder, "documents")
    return [fingerprint(document_files(docs.filter(F.col("doc_id") % 3 == n))) for n in range(3)]


@query(
    f"""WITH {FILES} SELECT path, sha256(text) AS hash, CAST(doc_id % 3 AS INTEGER) AS batch FROM files
    QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id % 3, path) = 1"""
)
def seen_table_batches(spark: SparkSession, folder: str) -> DataFrame:
    """What each batch adds to a table of seen keys."""
    seen = SeenKeys(spark, new_folder(spark, "seen"))
    kept = [
        seen.accept(rows, str(n)).select("path", "hash", F.lit(n).alias("batch"))
        for n, rows in enumerate(_arrivals(spark, folder))
    ]
    return reduce(DataFrame.unionByName, kept)


@query(
    f"""WITH {FILES}, groups AS (
      SELECT path, sha256(text) AS hash, first_value(path) OVER (
        PARTITION BY sha256(text) ORDER BY doc_id % 3, path) AS kept_path FROM files)
    SELECT 'sha256:' || hash AS key, path, kept_path,
      CAST(count(*) - CASE WHEN path = kept_path THEN 1 ELSE 0 END AS BIGINT) AS copies
    FROM groups GROUP BY hash, path, kept_path
    HAVING count(*) > CASE WHEN path = kept_path THEN 1 ELSE 0 END"""
)
def seen_table_suppressed(spark: SparkSession, folder: str) -> DataFrame:
    """What each batch loses to the files of earlier ones and its own."""
    seen = SeenKeys(spark, new_folder(spark, "seen"))
    lost = []
    for n, rows in enumerate(_arrivals(spark, folder)):
        seen.accept(rows, str(n))
        lost.append(stage(seen.suppressed(rows, str(n)), "suppressed"))
    return reduce(DataFrame.unionByName, lost)


@query(
    f"""WITH {FILES} SELECT path, sha256(text) AS hash FROM files
    QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY path) = 1"""
)
def seen_table_reset(spark: SparkSession, folder: str) -> DataFrame:
    """After a reset the documents come as if none had been seen."""
    seen = SeenKeys(spark, new_folder(spark, "seen"))
    for n, rows in enumerate(_arrivals(spark, folder)):
        seen.accept(rows, str(n))
    seen.reset()
    return seen.accept(fingerprint(documents(spark, folder)), "all").select("path", "hash")


@query(
    f"""WITH {FILES}, kept AS (
      SELECT lang FROM files
      QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY path) = 1)
    SELECT lang, count(*) AS unique_documents FROM kept GROUP BY 1"""
)
def unique_by_lang(spark: SparkSession, folder: str) -> DataFrame:
    rows = with_content_hash(documents(spark, folder).select("path", "lang", "content"))
    unique = dedup.first_per_key(rows, F.col("hash"), ["path"])
    return unique.groupBy("lang").agg(F.count(F.lit(1)).alias("unique_documents"))


# ---------------------------------------------------------------- paths and trees


@query(
    rf"""WITH {FILES} SELECT path, name AS base_name, parent AS parent_path,
      regexp_extract(name, '\.([^.]*)$', 1) AS ext, starts_with(name, '.') AS hidden,
      path[9:] AS below_root, path[2:] AS from_slash FROM files"""
)
def path_fields(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "path",
        P.base_name("path").alias("base_name"),
        P.parent_path("path").alias("parent_path"),
        P.file_extension("path").alias("ext"),
        P.is_hidden("path").alias("hidden"),
        P.path_under_root("path", "root").alias("below_root"),
        P.relative_path(F.lit("/"), "path").alias("from_slash"),
    )


@query(
    f"""WITH {PAGES} SELECT path, CASE WHEN path LIKE '%/' THEN path[:-2] ELSE path END AS normalized
    FROM pagefiles"""
)
def path_normalize(spark: SparkSession, folder: str) -> DataFrame:
    windows_style = F.translate("path", "/", "\\")
    return pages(spark, folder).select("path", P.normalize_path(windows_style).alias("normalized"))


@query(
    f"""WITH {FILES} SELECT path, CASE
      WHEN source = 'src7' AND lang = 'en' AND depth = 2 THEN name
      WHEN source = 'src7' AND depth = 2 THEN '../' || lang || '/' || name
      WHEN source = 'src7' THEN '../' || name
      WHEN depth = 2 THEN '../../' || source || '/' || lang || '/' || name
      ELSE '../../' || source || '/' || name END AS relative FROM files"""
)
def relative_paths(spark: SparkSession, folder: str) -> DataFrame:
    base = F.lit("/corpus/src7/./fr/../en/")
    return documents(spark, folder).select("path", P.relative_path(base, "path").alias("relative"))


@query(
    f"""WITH {PAGES}, parts AS (
      SELECT path, list_filter(string_split(path, '/'), lambda x: x <> '') AS p FROM pagefiles)
    SELECT path, CAST(unnest(range(len(p))) AS INTEGER) AS pos, unnest(p) AS component FROM parts"""
)
def path_components(spark: SparkSession, folder: str) -> DataFrame:
    return tree.path_component_rows(pages(spark, folder))


@query(
    f"""WITH {FILES} SELECT parent, count(*) AS files,
      count(*) FILTER (starts_with(name, '.')) AS hidden_files FROM files GROUP BY 1"""
)
def hidden_per_dir(spark: SparkSession, folder: str) -> DataFrame:
    return tree.hidden_per_directory(documents(spark, folder))


@query(
    f"""WITH {FILES}, up AS (
      SELECT size, sha256(text) AS hash, unnest(CASE WHEN depth = 1
        THEN ['/corpus', '/corpus/' || source]
        ELSE ['/corpus', '/corpus/' || source, '/corpus/' || source || '/' || lang] END) AS dir
      FROM files)
    SELECT dir, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes,
      count(DISTINCT hash) AS unique_hashes FROM up GROUP BY 1"""
)
def dir_rollup(spark: SparkSession, folder: str) -> DataFrame:
    return tree.directory_rollup(with_content_hash(documents(spark, folder)))


@query(
    rf"""WITH {FILES} SELECT regexp_extract(name, '\.([^.]*)$', 1) AS ext, count(*) AS files,
      CAST(sum(size) AS BIGINT) AS bytes, count(*) FILTER (mode = 493) AS executables,
      count(*) - count(DISTINCT sha256(text)) AS duplicates FROM files GROUP BY 1"""
)
def ext_profile(spark: SparkSession, folder: str) -> DataFrame:
    return tree.extension_profile(with_content_hash(documents(spark, folder)))


FILES_UNDER = f"""WITH {TREE} SELECT dirs.path AS dir, files.path FROM dirs
    JOIN files ON starts_with(files.path, dirs.path || '/')"""


@query(FILES_UNDER)
def files_under(spark: SparkSession, folder: str) -> DataFrame:
    listing = document_tree(table(spark, folder, "documents"))
    dirs = listing.filter("kind = 'dir'").select(F.col("path").alias("dir"))
    return tree.files_under(listing.filter("kind <> 'dir'"), dirs)


@query(FILES_UNDER)
def files_under_shuffled(spark: SparkSession, folder: str) -> DataFrame:
    """The same as if the directories were too many to broadcast."""
    listing = document_tree(table(spark, folder, "documents"))
    dirs = listing.filter("kind = 'dir'").select(F.col("path").alias("dir"))
    return tree.files_under(listing.filter("kind <> 'dir'"), dirs, 0)


@query(
    f"""WITH {TREE}, wanted AS (
      SELECT DISTINCT '/corpus/' || source || '/' || lang || '/' || name AS path FROM files)
    SELECT path, path IN (SELECT path FROM tree) AS exists FROM wanted"""
)
def paths_exist(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    wanted = document_files(docs).select(
        F.concat_ws("/", F.substring_index("parent", "/", 3), "lang", "name").alias("path")
    )
    return tree.paths_exist(wanted, document_tree(docs))


@query(
    f"""WITH {TREE} SELECT path FROM dirs WHERE path NOT IN (SELECT parent FROM tree)"""
)
def empty_dirs(spark: SparkSession, folder: str) -> DataFrame:
    return tree.empty_directories(document_tree(table(spark, folder, "documents")))


# ---------------------------------------------------------------- comparison


def copied(spark: SparkSession, folder: str) -> DataFrame:
    """A later copy of the corpus: some files gone, some changed, some under a new name."""
    files = documents(spark, folder, "/copy")
    fate = F.col("doc_id") % 5
    content = F.when(fate == 1, F.concat("content", F.lit(b"+"))).otherwise(
        F.col("content")
    )
    renamed = F.concat("path", F.when(fate == 2, F.lit(".new")).otherwise(F.lit("")))
    return files.filter(fate != 0).select(
        "root",
        renamed.alias("path"),
        "kind",
        F.octet_length(content).cast("bigint").alias("size"),
        content.alias("content"),
    )


COPY = f"""{FILES}, later AS (
  SELECT doc_id, kind, replace(path, '/corpus/', '/copy/')
      || CASE WHEN doc_id % 5 = 2 THEN '.new' ELSE '' END AS path,
    text || CASE WHEN doc_id % 5 = 1 THEN '+' ELSE '' END AS text
  FROM files WHERE doc_id % 5 <> 0)
"""


@query(
    f"""WITH {FILES} SELECT path AS path_a, replace(path, '/corpus/', '/copy/') AS path_b,
      CASE WHEN doc_id % 5 IN (1, 3, 4) AND kind = 'file' THEN doc_id % 5 <> 1 END AS equal,
      CASE WHEN doc_id % 5 IN (0, 2)
        THEN 'stat ' || replace(path, '/corpus/', '/copy/') || ': no such file or directory'
        WHEN kind <> 'file' THEN 'not regular files' END AS error FROM files"""
)
def compare_pairs(spark: SparkSession, folder: str) -> DataFrame:
    columns = ["path", "kind", "size", "content"]
    before = documents(spark, folder)
    pairs = before.select(
        F.col("path").alias("path_a"),
        F.concat(F.lit("/copy"), F.substring("path", F.lit(8), F.length("path"))).alias("path_b"),
    )
    files = before.select(columns).unionByName(copied(spark, folder).select(columns))
    return compare.compare_pairs(pairs, files)


@query(
    f"""WITH {FILES}, groups AS (
      SELECT path, min(path) OVER (PARTITION BY sha256(text)) AS keeper_path
      FROM files WHERE kind = 'file')
    SELECT keeper_path, path FROM groups WHERE path <> keeper_path"""
)
def identical_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return compare.identical_files(documents(spark, folder))


@query(
    f"""WITH {COPY}, a AS (SELECT path[9:] AS rel_path, text FROM files),
    b AS (SELECT path[7:] AS rel_path, text FROM later)
    SELECT rel_path, CASE WHEN a.text IS NULL THEN 'added' WHEN b.text IS NULL THEN 'removed'
      WHEN a.text = b.text THEN 'same' ELSE 'changed' END AS status
    FROM a FULL JOIN b USING (rel_path)"""
)
def snapshot_diff(spark: SparkSession, folder: str) -> DataFrame:
    def snapshot(files: DataFrame) -> DataFrame:
        relative = P.path_under_root("path", "root").alias("rel_path")
        return with_content_hash(files.select(relative, "size", "content"))

    return compare.snapshot_diff(
        snapshot(documents(spark, folder)), snapshot(copied(spark, folder))
    )


# ---------------------------------------------------------------- batches and tables (K1, K4)

BATCHES = f"""{FILES}, kept AS (
  SELECT path, size, sha256(text) AS hash FROM files
  QUALIFY row_number() OVER (PARTITION BY sha256(text) ORDER BY path) = 1),
batched AS (
  SELECT *, (row_number() OVER (ORDER BY hash, path) - 1) // 100 AS batch_id FROM kept)
"""


def batches(spark: SparkSession, folder: str) -> DataFrame:
    unique = dedup.deduplicate(fingerprint(documents(spark, folder)))
    return assemble_batches(unique.withColumn("key", dedup.dedup_key()), ["key", "path"])


@query(f"WITH {BATCHES} SELECT batch_id, count(*) AS n_items FROM batched GROUP BY 1")
def batch_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return batches(spark, folder).select("batch_id", "n_items")


@query(
    f"""WITH {BATCHES} SELECT batch_id,
      CAST(row_number() OVER (PARTITION BY batch_id ORDER BY hash, path) - 1 AS INTEGER) AS pos,
      path, size, hash FROM batched"""
)
def batch_payload(spark: SparkSession, folder: str) -> DataFrame:
    items = F.from_json("payload", "array<struct<path:string, size:bigint, hash:string>>")
    rows = batches(spark, folder).select("batch_id", F.posexplode(items).alias("pos", "item"))
    return rows.select("batch_id", "pos", "item.path", "item.size", "item.hash")


@query(f"WITH {FINGERPRINTS} SELECT path, size, hash, error FROM prints")
def results_table(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprints written as a table and read back (K4)."""
    output = new_folder(spark, "results")
    write_results(fingerprint(with_unreadable(spark, folder)), output)
    return spark.read.parquet(output).select("path", "size", "hash", "error")


# ---------------------------------------------------------------- the whole job (Q1)


@query(
    f"""WITH {FINGERPRINTS}, chosen AS (
      SELECT path, hash FROM prints
      WHERE kind = 'file' AND name NOT LIKE '.%' AND name NOT LIKE '%.log' AND depth <= 2)
    SELECT count(*) AS total, count(DISTINCT hash) AS unique_files,
      count(*) - count(DISTINCT hash) AS duplicates, count(*) - count(hash) AS errors,
      CAST(0 AS BIGINT) AS scan_errors, CAST(0 AS BIGINT) AS delivery_errors,
      CAST(ceil(count(DISTINCT hash) / 100.0) AS BIGINT) AS n_batches,
      CAST(count(DISTINCT hash) AS BIGINT) AS n_items FROM chosen"""
)
def scan_summary(spark: SparkSession, folder: str) -> DataFrame:
    """The whole job over documents: filter, fingerprint, remove duplicates, batch, sum up."""
    listing = filters.within_depth(with_unreadable(spark, folder), 2)
    listing = filters.exclude_globs(filters.skip_hidden(listing), ["*.log"])
    found = inventory_of(listing)
    batched = found.batches.agg(
        F.count(F.lit(1)).alias("n_batches"),
        F.coalesce(F.sum(F.size(F.from_json("payload", "array<struct<path:string>>"))), F.lit(0))
        .cast("bigint")
        .alias("n_items"),
    )
    return _beside(found.summary, batched)


def _beside(one: DataFrame, other: DataFrame) -> DataFrame:
    """The columns of two one-row tables in one row."""
    both = one.unionByName(other, allowMissingColumns=True)
    return both.agg(*[F.max(name).alias(name) for name in both.columns])


@query(
    """SELECT min(doc_id) AS kept_id, CAST(count(*) AS BIGINT) AS copies, CAST(strlen(text) AS BIGINT) AS size
    FROM documents GROUP BY text"""
)
def kept_by_sha512(spark: SparkSession, folder: str) -> DataFrame:
    """The document that stays of each group of equal SHA-512, which SQL checks by text."""
    rows = with_content_hash(documents(spark, folder), "sha512")
    return (
        rows.groupBy("hash")
        .agg(
            F.min("doc_id").alias("kept_id"),
            F.count(F.lit(1)).alias("copies"),
            F.max("size").alias("size"),
        )
        .drop("hash")
    )


def queries() -> dict[str, Query]:
    return {name: registered.run for name, registered in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: registered.sql for name, registered in REGISTRY.items() if registered.sql}
