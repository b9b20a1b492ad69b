"""Sources: directory trees and tables as one ``files`` table.

files(scan_id, repository, file_path, language, size, line_count, content)
"""

from __future__ import annotations

import itertools
import os
import re
import tempfile
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from credtrace import share_package
from credtrace.functions import catalog as C

KEY = ["scan_id", "file_path"]


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the one that ``spark.checkpoint.dir`` names; on a single machine without that setting a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", "")
    if not root:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        root = os.path.join(tempfile.gettempdir(), "checkpoints")
    return f"{root.rstrip('/')}/{uuid.uuid4().hex}"


def basename(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"([^/]*)$", 1))


def extension(path: Column) -> Column:
    """Last extension of the base name, lower case, '' for none; leading dots do not start one."""
    return F.lower(F.regexp_extract(path, r"(?:^|/)\.*[^/.][^/]*(\.[^/.]*)$", 1))


def is_supported(path: Column) -> Column:
    return basename(path).isin(C.SPECIAL_NAMES) | extension(path).isin(list(C.LANGUAGES))


def language_of(path: Column) -> Column:
    name = basename(path)
    table = F.create_map(*[F.lit(x) for pair in C.LANGUAGES.items() for x in pair])
    return (F.when(name == "dockerfile", "Dockerfile")
            .when(F.startswith(name, F.lit(".env")), "Environment")
            .when(name == "makefile", "Makefile")
            .otherwise(F.coalesce(F.try_element_at(table, extension(path)), F.lit("Unknown"))))


def in_skipped_directory(path: Column, extra: list[str] = ()) -> Column:
    skip = [d.lower() for d in C.SKIP_DIRECTORIES + list(extra)]
    parts = F.split(F.lower(F.regexp_extract(path, r"^(.*)/[^/]*$", 1)), "/")
    return F.arrays_overlap(parts, F.array(*[F.lit(d) for d in skip]))


def within_size(size: Column, limit: int = C.MAX_FILE_SIZE) -> Column:
    return size.between(1, limit)


def is_binary(content: Column) -> Column:
    return F.contains(F.substring(content, 1, C.BINARY_PROBE_BYTES), F.lit(bytes([0])))


def decode_text(content: Column) -> Column:
    """UTF-8 with bad bytes dropped and line ends normalised to \\n. A real U+FFFD is dropped as well."""
    text = F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))
    return F.regexp_replace(text, "\r\n?", "\n")


def line_count(content: Column) -> Column:
    return F.length(content) - F.length(F.replace(content, F.lit("\n"), F.lit(""))) + 1


def is_minified(content: Column) -> Column:
    n = line_count(content)
    average = (F.length(content) - (n - 1)) / n
    return (n >= C.MINIFIED_MIN_LINES) & (average > C.MINIFIED_AVERAGE)


def passes(max_line_count: int = C.MAX_LINE_COUNT, max_file_size: int = C.MAX_FILE_SIZE) -> Column:
    return (within_size(F.col("size"), max_file_size) & ~is_minified(F.col("content")) & (F.col("line_count") <= max_line_count))


def gate(files: DataFrame, max_line_count: int = C.MAX_LINE_COUNT, max_file_size: int = C.MAX_FILE_SIZE) -> DataFrame:
    """Drop what the scanner does not read: empty, oversized, minified or overlong files.

    For sources of files: what a scan reads from a tree. Text tables are taken as they are.
    """
    return files.filter(passes(max_line_count, max_file_size))


def settled(table: DataFrame) -> DataFrame:
    """Stop later filters from being pushed below the computed columns of ``table`` and evaluating them again."""
    return table.select(F.explode_outer(F.array(F.struct("*"))).alias("row")).select("row.*")


LISTING = "path string, name string, is_dir boolean, size long, error string"
READ_BYTES = 128 << 20
#: Entries of a directory that are handed on together.
ENTRIES = 10000


def is_uri(root: str) -> bool:
    return re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", root) is not None


def _mounted(directory: str) -> Iterator[tuple]:
    with os.scandir(directory) as entries:
        for e in entries:
            yield e.path, e.name, e.is_dir(follow_symlinks=False), 0 if e.is_dir() or not os.path.exists(e.path) else e.stat().st_size, None


def _stored(system: fs.FileSystem, directory: str) -> Iterator[tuple]:
    for e in system.get_file_info(fs.FileSelector(directory)):
        yield e.path, e.base_name, e.type == fs.FileType.Directory, e.size or 0, None


def _lister(root: str):
    """Entries of every directory in a batch, some at a time; a directory that cannot be read gives a row that says why."""
    columns = ["path", "name", "is_dir", "size", "error"]

    def batches_of(batches):
        system = fs.FileSystem.from_uri(root)[0] if is_uri(root) else None
        for batch in batches:
            for directory in batch["path"]:
                entries = _stored(system, directory) if system else _mounted(directory)
                while True:
                    rows, failed = [], None
                    try:
                        rows.extend(itertools.islice(entries, ENTRIES))
                    except OSError as error:
                        failed = (directory, os.path.basename(directory), False, 0, str(error))
                    if rows:
                        yield pd.DataFrame(rows, columns=columns)
                    if failed:
                        yield pd.DataFrame([failed], columns=columns)
                    if failed or len(rows) < ENTRIES:
                        break
    return batches_of


def _reader(root: str):
    """Bytes of every file in a batch, a few files at a time; of a file that cannot be read why."""
    def one(system, path):
        try:
            with (system.open_input_file(path) if system else open(path, "rb")) as f:
                return f.read(), None
        except OSError as error:
            return None, str(error)

    def batches_of(batches):
        system = fs.FileSystem.from_uri(root)[0] if is_uri(root) else None
        for batch in batches:
            for start in range(0, len(batch), 32):
                part = batch.iloc[start:start + 32].copy()
                found = [one(system, path) for path in part["path"]]
                part["content"], part["error"] = [c for c, _ in found], [e for _, e in found]
                yield part[["path", "length", "content", "error"]]
    return batches_of


def _kept(rows: DataFrame, folder: str) -> DataFrame:
    rows.write.parquet(folder)
    return rows.sparkSession.read.schema(rows.schema).parquet(folder)


def _tree(spark: SparkSession, root: str, base: str, skip_dirs: list[str], max_file_size: int) -> DataFrame:
    """(path, length, content, error) of the files of a tree, listed level by level on the executors, mounted or in a store.

    Spark's own reader leaves out names that start with a dot or an underscore, and with them ``.env`` files and
    ``__init__.py``, and lists on the driver. Each round lists one level in parallel, so a directory that holds much of
    the tree does not become one task, and writes it to the shared folder, so that no level is kept in memory or listed twice;
    skipped directories are not entered, and only kept files are read, about READ_BYTES to a partition. What cannot be
    listed or read has a row with its error and no content.
    """
    share_package(spark)
    cores = spark.sparkContext.defaultParallelism
    skip = [d.lower() for d in C.SKIP_DIRECTORIES + list(skip_dirs)]
    frontier, folder, levels = spark.createDataFrame([(base,)], "path string"), shared_folder(spark), 0
    while True:
        level = _kept(frontier.repartition(cores).mapInPandas(_lister(root), LISTING), f"{folder}/level={levels}")
        levels += 1
        frontier = level.filter(F.col("is_dir") & ~F.lower("name").isin(skip)).select("path")
        if frontier.isEmpty():
            break
    listed = spark.read.schema(LISTING).parquet(*[f"{folder}/level={k}" for k in range(levels)])
    kept = listed.filter(F.col("error").isNull() & ~F.col("is_dir") & F.col("size").between(1, max_file_size) & is_supported(F.col("path"))).select(
        "path", F.col("size").alias("length"))
    total = kept.agg(F.sum("length")).first()[0] or 0
    read = kept.repartition(max(cores, -(-total // READ_BYTES))).mapInPandas(_reader(root), "path string, length long, content binary, error string")
    return read.unionByName(listed.filter(F.col("error").isNotNull()).select("path", F.col("size").alias("length"), F.lit(None).cast("binary").alias("content"),
                                                                             "error"))


def scan_tree(spark: SparkSession, root: str, scan_id: str, repository: str, skip_dirs: list[str] = (),
              max_file_size: int = C.MAX_FILE_SIZE, max_line_count: int = C.MAX_LINE_COUNT) -> DataFrame:
    """Every file below ``root`` that is read, and with an ``error`` and no content every one, or directory, that could not be.

    A plain path is a tree that every executor has mounted; a URI is read through Arrow's file systems. Path and size tests run
    before any content is read. The limits hold for this source only: scans take what it gives whole.
    """
    base = (fs.FileSystem.from_uri(root)[1] if is_uri(root) else os.path.abspath(root)).rstrip("/")
    raw = _tree(spark, root, base, list(skip_dirs), max_file_size)
    failed = F.col("error").isNotNull()
    kept = raw.withColumn("file_path", F.substring(F.col("path"), len(base) + 2, 1 << 20)).filter(failed | (
        is_supported(F.col("file_path")) & ~in_skipped_directory(F.col("file_path"), list(skip_dirs)) & ~is_binary(F.col("content"))))
    text = settled(kept.select("file_path", "length", "error", decode_text(F.col("content")).alias("content")))
    return text.select(F.lit(scan_id).alias("scan_id"), F.lit(repository).alias("repository"), "file_path",
                       language_of(F.col("file_path")).alias("language"), F.col("length").alias("size"),
                       line_count(F.col("content")).alias("line_count"), "content", "error").filter(
        failed | passes(max_line_count, max_file_size))


def scan_directory(spark: SparkSession, root: str, scan_id: str, repository: str,
                   skip_dirs: list[str] = (), max_file_size: int = C.MAX_FILE_SIZE,
                   max_line_count: int = C.MAX_LINE_COUNT) -> DataFrame:
    """Every readable source file below ``root`` (see ``scan_tree``)."""
    return scan_tree(spark, root, scan_id, repository, skip_dirs, max_file_size, max_line_count).filter(F.col("error").isNull()).drop("error")


def as_files(table: DataFrame, scan_id: Column, repository: Column, file_path: Column, content: Column) -> DataFrame:
    """Rows of any table as files; text columns are taken whole."""
    return table.select(scan_id.alias("scan_id"), repository.alias("repository"), file_path.alias("file_path"),
                        language_of(file_path).alias("language"),
                        F.octet_length(content).cast("bigint").alias("size"),
                        line_count(content).alias("line_count"), content.alias("content"))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(rows: DataFrame) -> DataFrame:
    """Short rows from which files are rendered, hashed over the shuffle partitions. With a count they stay apart: without one
    adaptive execution would fold them into a single partition, as the rows are short."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), "c_custkey")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return as_files(d, F.lit("documents"), F.col("source"),
                    F.concat(F.lit("doc-"), F.col("doc_id").cast("string")), F.col("text"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "pages")
    return as_files(p, F.lit("pages"), F.regexp_extract("url", r"^[a-z]+://([^/]+)", 1),
                    F.concat(F.lit("page-"), F.col("page_id").cast("string")), F.col("html"))


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    return as_files(c, F.lit("conversations"), F.col("role"),
                    F.format_string("conv-%d-%d", F.col("conv_id"), F.col("turn")), F.col("text"))


def rendered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One source file per customer row, in twelve shapes; one scan per nation."""
    k, h = F.col("c_custkey"), F.md5("c_name")
    u = F.upper(h)
    a, b = F.substring(u, 1, 8), F.substring(u, 9, 8)
    q = F.lit('"')

    def assign(name: str, value: Column, head: str = "", tail: str = "") -> Column:
        return F.concat(F.lit(f"{head}{name} = "), q, value, q, F.lit(tail))

    def file(*lines) -> Column:
        return F.concat_ws("\n", *[F.lit(x) if isinstance(x, str) else x for x in lines])

    host = F.concat(F.lit("h"), F.substring(h, 1, 6), F.lit(".invalid"))
    shapes = [
        ("aws", "py", file(assign("AWS_KEY", F.concat(F.lit("AKIA"), F.substring(u, 1, 16))))),
        ("frag", "py", file(assign("part1", F.lit("AKIA")), assign("part2", a), assign("part3", b),
                            "access_key = part1 + part2 + part3", "auth = access_key", "headers = {",
                            '    "Authorization": auth', "}",
                            'requests.get("https://svc.invalid", headers=headers)')),
        ("alias", "py", file(assign("api_token", h), "alias = api_token", "print(alias)")),
        ("db", "py", file(assign("scheme", F.lit("mongodb+srv")), assign("user", F.lit("svc")),
                          assign("pw", F.substring(h, 1, 12)), assign("host", host), assign("name", F.lit("prod")),
                          'conn = f"{scheme}://{user}:{pw}@{host}/{name}"', "cursor.execute(conn)")),
        ("mixed", "py", file(assign("static_part", F.concat(F.lit("prefix_"), a, F.lit("_"))), "n1 = 1", "n2 = 2",
                             "n3 = 3", "n4 = 4", "n5 = 5", 'dynamic_part = os.environ.get("SUFFIX")',
                             "mixed_key = static_part + dynamic_part")),
        ("client", "js", file(assign("p1", F.lit("AIza"), "const ", ";"), assign("p2", h, "const ", ";"),
                              "const apiKey = p1 + p2;", 'axios.post("https://svc.invalid", apiKey);',
                              "console.log(apiKey);")),
        ("tpl", "js", file(assign("kind", F.lit("Bearer"), "const ", ";"), assign("body", h, "const ", ";"),
                           "const authValue = `${kind} ${body}`;", "const wrapped = authValue;",
                           'fetch("https://svc.invalid", { headers: { "Authorization": wrapped } });')),
        ("conf", "py", file('API_KEY = os.environ.get("API_KEY", "")',
                            'DATABASE_URL = os.environ.get("DATABASE_URL", "")',
                            'SECRET_KEY = os.getenv("SECRET_KEY")')),
        ("place", "py", file('first_key = "your_api_key_here"', 'second_key = "xxxxxxxxxxxxxxxx"',
                             'third_key = "abcabcabcabcabcabc"', 'greeting = "Hello" + " " + "World"')),
        ("test_unit", "py", file(assign("api_key", h))),
        ("b64", "py", file(assign("enc", F.base64(h.cast("binary"))), "dec = base64.b64decode(enc).decode()",
                           "open(dec)")),
        ("collide", "py", file(
            assign("first_db", F.concat(F.lit("mongodb+srv://a:"), a, F.lit("@one.invalid/x"))),
            assign("second_db", F.concat(F.lit("mongodb+srv://b:"), b, F.lit("@two.invalid/y"))))),
    ]
    path = content = None
    for i, (stem, ext, text) in enumerate(shapes):
        p = F.concat(F.lit(f"src/{stem}_"), k.cast("string"), F.lit(f".{ext}"))
        path = F.when(k % 12 == i, p) if path is None else path.when(k % 12 == i, p)
        content = F.when(k % 12 == i, text) if content is None else content.when(k % 12 == i, text)
    # Rows become files a hundred times their size: they are dealt out before, not after.
    customers = dealt(read(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey"))
    nations = read(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    # Nations are a fixed list of 25.
    both = customers.join(F.broadcast(nations), customers.c_nationkey == nations.n_nationkey)
    files = settled(both.select(F.concat(F.lit("scan-"), F.col("n_nationkey").cast("string")).alias("scan_id"),
                                F.col("n_name").alias("repository"), path.alias("file_path"), content.alias("content")))
    return as_files(files, *(F.col(c) for c in ("scan_id", "repository", "file_path", "content")))


def lines(files: DataFrame) -> DataFrame:
    """One row per line, 1-based; a trailing empty piece counts as a line."""
    return files.select(*KEY, F.posexplode(F.split("content", "\n", -1)).alias("p", "line")).select(
        *KEY, (F.col("p") + 1).alias("line_no"), "line")


def file_summary(files: DataFrame) -> DataFrame:
    """Files, lines, bytes and files per language of every scan."""
    per_language = files.groupBy("scan_id", "language").agg(
        F.count("*").alias("n"), F.sum("line_count").alias("lines"), F.sum("size").alias("bytes"))
    return per_language.groupBy("scan_id").agg(
        F.sum("n").alias("total_files"), F.sum("lines").alias("total_lines"), F.sum("bytes").alias("total_bytes"),
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("language", "n")))).alias("languages"))
