"""Scans: text bytes with charset detection, rule packs, JSON lines, adaptive tables, state files, logs, package manifests."""

from __future__ import annotations

import codecs

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DETECTED = T.StructType().add("charset", T.StringType()).add("confidence", T.DoubleType()).add("method", T.StringType()).add("bom", T.IntegerType()).add("alternatives", T.ArrayType(T.StringType())).add("text", T.StringType())
BOMS = [(codecs.BOM_UTF8, "UTF-8"), (codecs.BOM_UTF16_LE, "UTF-16LE"), (codecs.BOM_UTF16_BE, "UTF-16BE")]


def _is_han(c: str) -> bool:
    n = ord(c)
    return 0x4E00 <= n <= 0x9FFF or 0x3400 <= n <= 0x4DBF or 0xF900 <= n <= 0xFAFF or 0x20000 <= n <= 0x323AF or n in (0x3005, 0x3007)


def _shares(text: str) -> tuple[float, float]:
    n = max(1, len(text))
    return sum(map(_is_han, text)) / n, sum(ord(c) < 32 or 127 <= ord(c) < 160 for c in text) / n


def _decode(raw: bytes, charset: str) -> str | None:
    try:
        return raw.decode(charset, "strict")
    except UnicodeDecodeError:
        return None


def detect(raw: bytes) -> dict:
    """Charset of text bytes: a byte order mark, no bytes, ASCII, else the best of the strict decodings.

    NULs at odd offsets mean little-endian ASCII in UTF-16, at even ones big-endian; so UTF-16 without a mark is not
    taken for ASCII, whose bytes never include NUL here. No decoding at all gives confidence 0 and no text.
    """
    for mark, name in BOMS:
        if raw.startswith(mark):
            return {"charset": name, "confidence": 1.0, "method": "BOM", "bom": len(mark), "alternatives": [], "text": _decode(raw[len(mark) :], name)}
    if not raw:
        return {"charset": "UTF-8", "confidence": 0.5, "method": "empty", "bom": 0, "alternatives": [], "text": ""}
    if raw.isascii() and 0 not in raw:
        return {"charset": "UTF-8", "confidence": 1.0, "method": "ascii", "bom": 0, "alternatives": [], "text": raw.decode("ascii")}
    found = []
    # fixed values: the weights below, by which strict decodings are scored and the confidence is taken

    def offer(name: str, charset: str, score) -> None:
        text = _decode(raw, charset)
        if text is not None:
            found.append((min(1.0, max(0.0, score(*_shares(text)))), name, text))

    offer("UTF-8", "utf-8", lambda han, ctrl: 0.5 + min(han, 0.5) if han >= 0.05 else 0.55)
    half = len(raw) // 2
    if len(raw) >= 16:
        even, odd = raw[::2].count(0) / half, raw[1::2].count(0) / half
        if max(even, odd) > 0.3:
            name = "UTF-16LE" if odd >= even else "UTF-16BE"
            offer(name, name, lambda han, ctrl: 0.5 + han * 0.4 + (1 - ctrl) * 0.1)
    wide = "GB18030" if any(0x81 <= a <= 0xFE and 0x30 <= b <= 0x39 for a, b in zip(raw, raw[1:], strict=False)) else "GBK"
    offer(wide, "gb18030", lambda han, ctrl: 0.4 + han * 0.5 + (1 - ctrl) * 0.1)
    if not found:
        return {"charset": "UTF-8", "confidence": 0.0, "method": "none", "bom": 0, "alternatives": [], "text": None}
    found.sort(key=lambda x: -x[0])
    margin = found[0][0] - found[1][0] if len(found) > 1 else 1.0
    sure = min(1.0, max(0.0, found[0][0] * 0.6 + min(1.0, max(0.0, margin)) * 0.4))
    return {"charset": found[0][1], "confidence": sure, "method": "scoring", "bom": 0, "alternatives": [x[1] for x in found[1:]], "text": found[0][2]}


@F.pandas_udf(DETECTED)
def detect_udf(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([detect(b"" if x is None else bytes(x)) for x in content], columns=["charset", "confidence", "method", "bom", "alternatives", "text"])


def import_texts(spark: SparkSession, path: str, pattern: str = "*.txt") -> DataFrame:
    """Text files as sources: book_id, path, length, sha256, charset, confidence, text, and error for those that can't be read.

    The id comes from the content. Files of a folder are read in parallel; each file is one row, so it must fit a task.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return decode_contents(files)


def decode_contents(files: DataFrame) -> DataFrame:
    """``import_texts`` for rows of (path, content)."""
    sha = F.sha2("content", 256)
    rows = files.select("path", F.length("content").alias("length"), sha.alias("sha256"), F.concat(F.lit("book-"), F.left(sha, F.lit(12))).alias("book_id"), detect_udf("content").alias("d"))
    controls = F.regexp_count("d.text", F.lit(r"[\x00-\x08\x0b\x0c\x0e-\x1f]"))
    error = F.when(F.col("d.text").isNull(), "UNDECODABLE").when(controls > F.col("length") / 16, "NOT_TEXT")
    return rows.select("book_id", "path", "length", "sha256", "d.charset", "d.confidence", "d.method", "d.alternatives", error.alias("error"), F.when(error.isNull(), F.col("d.text")).alias("text"))


def fallback_decode(content: Column, charsets: tuple[str, ...] = ("utf-8", "gb18030", "big5")) -> Column:
    """The first charset that decodes without a fault."""

    @F.pandas_udf(T.StringType())
    def read(raw: pd.Series) -> pd.Series:
        return raw.map(lambda x: next((t for c in charsets if (t := _decode(bytes(x), c)) is not None), None) if x is not None else None)

    return read(content)


def rule_pack(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of rules as typed rows."""
    from folio.operators.chapters import typed_rules

    return typed_rules(spark.read.schema("id int, enable boolean, name string, rule string, example string, serialNumber int, replacement string").option("multiLine", "true").json(path))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines by a fixed schema; damaged lines are kept in ``_corrupt_record``."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def adaptive(df: DataFrame, columns: dict[str, tuple[str, object]]) -> DataFrame:
    """The wanted columns by name and type, with a default for those that an older table lacks."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(default)).cast(kind).alias(c) for c, (kind, default) in columns.items()))


def scan_files(spark: SparkSession, path: str, extension: str = "wav") -> DataFrame:
    """path, name and length of a tree's files, sorted; contents are not read. Names that lead out of the tree are left out."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", f"*.{extension}").load(path)
    return files.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), "length").where(~F.col("path").contains("/../")).orderBy("path")


def state_files(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One row for each ``<id>/state.json`` below the path; unreadable ones are left out."""
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(f"{path}/*/state.json")
    return rows.withColumn("run_id", F.regexp_extract(F.input_file_name(), r"([^/]+)/state\.json$", 1))


def manifests(spark: SparkSession, path: str) -> DataFrame:
    """Package manifests with an id and a title, newest first; bad ones are skipped."""
    schema = "book_id string, title string, sha256 string, imported_at long, state string, origin string, version int"
    rows = spark.read.schema(schema).option("multiLine", "true").option("mode", "DROPMALFORMED").json(f"{path}/*/manifest.json")
    return rows.where("book_id is not null and title is not null").orderBy(F.col("imported_at").desc(), "book_id")


def import_packages(files: DataFrame, known: DataFrame) -> DataFrame:
    """Package files (path, content) against known packages (book_id, sha256): NEW, DUPLICATE (same content) or COLLISION (same id, other content)."""
    sha = F.sha2("content", 256)
    rows = files.select("path", sha.alias("sha256"), F.concat(F.lit("book-"), F.left(sha, F.lit(12))).alias("book_id")) if "book_id" not in files.columns else files.select("path", "book_id", sha.alias("sha256"))
    old = known.select("book_id", F.col("sha256").alias("__old"))
    both = rows.join(old, "book_id", "left")
    return both.withColumn("outcome", F.when(F.col("__old").isNull(), "NEW").when(F.col("__old") == F.col("sha256"), "DUPLICATE").otherwise("COLLISION")).drop("__old")


def rebuild_wanted(packages: DataFrame, version: int) -> DataFrame:
    """Generated packages that are ready but of an older version."""
    return packages.where((F.col("state") == "READY") & (F.col("origin") == "GENERATED") & (F.coalesce("version", F.lit(0)) < version))


def log_metrics(spark: SparkSession, path: str, patterns: dict[str, str]) -> DataFrame:
    """One row for each log line that has a metric: file, and the first group of each pattern as a number."""
    lines = spark.read.text(path).select(F.input_file_name().alias("file"), "value")
    found = lines.select("file", *(F.nullif(F.regexp_extract("value", p, 1), F.lit("")).try_cast("double").alias(n) for n, p in patterns.items()))
    return found.where(F.coalesce(*patterns).isNotNull())


def inverted_index(docs: DataFrame, id_col: str, text_col: str, word: str = r"[^\s\p{P}]+") -> DataFrame:
    """token, id, n: the postings of a full-text index."""
    tokens = F.regexp_extract_all(F.lower(F.col(text_col)), F.lit(f"({word})"), F.lit(1))
    return docs.select(id_col, F.explode(tokens).alias("token")).groupBy("token", id_col).agg(F.count("*").alias("n"))


def match_all(index: DataFrame, tokens: list[str], id_col: str) -> DataFrame:
    """Documents that hold every token, with the sum of their counts."""
    wanted = sorted({t.lower() for t in tokens})
    return index.where(F.col("token").isin(*wanted)).groupBy(id_col).agg(F.count("*").alias("k"), F.sum("n").alias("n")).where(F.col("k") == len(wanted)).drop("k")


def match_queries(index: DataFrame, wanted: DataFrame, query_col: str, id_col: str) -> DataFrame:
    """query, id, n (sum of counts) of the documents that hold every token of a query; ``wanted`` has the query's id and its tokens.

    Each query meets the postings of its rarest token first, and only documents found there are asked for its other tokens.
    """
    asked = wanted.select(query_col, "token").distinct()
    sizes = index.join(asked.select("token").distinct(), "token", "left_semi").groupBy("token").agg(F.count("*").alias("__df"))
    rare = asked.join(sizes, "token", "left").groupBy(query_col).agg(F.min_by("token", F.struct(F.coalesce("__df", F.lit(0)), "token")).alias("token"), F.count("*").alias("__k"))
    found = index.select("token", id_col).join(rare, "token").select(query_col, id_col, "__k")
    met = found.join(asked, query_col).join(index.select("token", id_col, "n"), ["token", id_col])
    return met.groupBy(query_col, id_col, "__k").agg(F.count("*").alias("__got"), F.sum("n").alias("n")).where("__got = __k").select(query_col, id_col, "n")


def probe(df: DataFrame) -> DataFrame:
    """Row count of a table that is only read."""
    return df.agg(F.count("*").alias("n_rows"))


def lookup(df: DataFrame, **keys) -> DataFrame:
    """Rows of the given key values; on Parquet the filters reach the scan."""
    for name, value in keys.items():
        df = df.where(F.col(name) == F.lit(value))
    return df


def scope(paragraphs: DataFrame, chapter_id: int | None = None, first: int = 0, last: int | None = None) -> DataFrame:
    """The paragraphs of one chapter, or of an index range (both ends in it)."""
    if chapter_id is not None:
        paragraphs = paragraphs.where(F.col("chapter_id") == chapter_id)
    return paragraphs.where((F.col("paragraph_index") >= first) & (F.lit(last is None) | (F.col("paragraph_index") <= F.lit(last or 0))))
