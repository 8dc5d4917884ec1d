"""Project and conversation files as DataFrames of whole texts."""

from __future__ import annotations

import codecs
import re
from collections.abc import Iterator
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemospark.functions import fixed_values as fv
from mnemospark.functions.columns import quoted


def local_path(uri: Column) -> Column:
    """Readable path of a file URI."""
    bare = F.regexp_replace(uri, r"^file:/+", "/")
    return F.url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))


def whole_texts(spark: SparkSession, root: str) -> DataFrame:
    """(path, relative, content) of every readable text below a folder.

    Spark's reader skips names that start with a dot or an underscore and all below such folders;
    these files are listed on the driver and read in tasks.  Hidden names in ``SKIP_FILENAMES``
    (ignore rules) are no texts.
    """
    rows = spark.read.text(root, wholetext=True, recursiveFileLookup=True)
    path = local_path(F.col("_metadata.file_path"))
    base = root.rstrip("/") + "/"
    found = rows.select(path.alias("path"), F.col("value").alias("content"))
    hidden = hidden_files(spark, root)
    if hidden:
        tasks = min(len(hidden), 4 * spark.sparkContext.defaultParallelism)
        listed = spark.createDataFrame([(uri,) for uri in hidden], "uri string").repartition(tasks)
        read = listed.mapInArrow(read_texts, "uri string, content string")
        found = found.union(read.select(local_path(F.col("uri")), "content"))
    return found.filter(F.is_valid_utf8("content")).select(
        "path", F.substring("path", len(base) + 1, 2**31 - 1).alias("relative"), "content"
    )


def skipped_by_spark(name: str) -> bool:
    """Spark's rule for names that its readers leave out."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def rule_files(spark: SparkSession, root: str) -> list[tuple[str, str]]:
    """(URI, folder below the root) of the files with ignore rules."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(hpath).toUri().getPath().rstrip("/") + "/"
    found, entries = [], fs.listFiles(hpath, True)
    while entries.hasNext():
        uri = entries.next().getPath().toUri()
        folder, _, name = uri.getPath()[len(base) :].rpartition("/")
        if name in RULE_FILES:
            found.append((uri.toString(), folder))
    return found


def hidden_files(spark: SparkSession, root: str) -> list[str]:
    """URIs of the files below a folder that Spark's readers leave out."""
    hpath = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    base = fs.makeQualified(hpath).toUri().getPath().rstrip("/") + "/"
    found, entries = [], fs.listFiles(hpath, True)
    while entries.hasNext():
        uri = entries.next().getPath().toUri()
        parts = uri.getPath()[len(base) :].split("/")
        control = parts[-1] in fv.SKIP_FILENAMES and skipped_by_spark(parts[-1])
        if any(map(skipped_by_spark, parts)) and not control:
            found.append(uri.toString())
    return found


def read_text(uri: str) -> str | None:
    """The text of one file; None, without reading on, where it is not UTF-8."""
    from pyarrow import fs

    if uri.startswith("file:"):
        store, path = fs.LocalFileSystem(), unquote(re.sub("^file:/+", "/", uri))
    else:
        store, path = fs.FileSystem.from_uri(re.sub("^s3[an]:", "s3:", uri))
    decoder, parts = codecs.getincrementaldecoder("utf-8")(), []
    try:
        with store.open_input_stream(path) as stream:
            while block := stream.read(1 << 20):
                parts.append(decoder.decode(block))
        return "".join([*parts, decoder.decode(b"", True)])
    except UnicodeDecodeError:
        return None


def read_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            text = read_text(uri)
            if text is not None:
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([text])], ["uri", "content"])


def name_of(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def extension_of(path: Column) -> Column:
    return F.lower(F.regexp_extract(name_of(path), r".\.([^.]*)$", 1))


def readable(files: DataFrame, skip_names: list[str] = fv.SKIP_FILENAMES) -> DataFrame:
    path = F.col("relative")
    return files.filter(
        extension_of(path).isin(fv.READABLE_EXTENSIONS) & ~name_of(path).isin(skip_names)
    )


def conversations(files: DataFrame, skip_dirs: list[str] = fv.CONVO_SKIP_DIRS) -> DataFrame:
    path = F.col("relative")
    folders = F.slice(F.split(path, "/"), 1, F.size(F.split(path, "/")) - 1)
    skipped = F.arrays_overlap(folders, F.array(*[F.lit(d) for d in skip_dirs]))
    return files.filter(
        extension_of(path).isin(fv.CONVO_EXTENSIONS) & ~path.endswith(".meta.json") & ~skipped
    )


# --------------------------------------------------------------- ignore rules
def ignore_regex(rule: str) -> tuple[str, bool] | None:
    """(regex on the relative path, is negated) of one ignore line."""
    rule = rule.rstrip()
    if not rule or rule.startswith("#"):
        return None
    negated = rule.startswith("!")
    rule = rule[1:] if negated else rule
    anchored = "/" in rule.rstrip("/")
    only_dir = rule.endswith("/")
    body = rule.strip("/")
    regex = re.escape(body)
    for written, meant in (
        (r"\*\*/", "(?:.*/)?"), (r"/\*\*", "/.*"), (r"\*\*", ".*"), (r"\*", "[^/]*"), (r"\?", "[^/]"),
    ):
        regex = regex.replace(written, meant)
    start = "^" if anchored else "^(?:.*/)?"
    return start + regex + ("/.*$" if only_dir else "(?:/.*)?$"), negated


def not_ignored(files: DataFrame, rules: list[str], include: list[str] = ()) -> DataFrame:
    """Drops ignored paths; a later rule overrides an earlier one, ``include`` all."""
    keep = "true"
    for rule in rules:
        parsed = ignore_regex(rule)
        if parsed:
            regex, negated = parsed
            keep = f"IF(relative RLIKE {quoted(regex)}, {str(negated).lower()}, {keep})"
    for path in include:
        clean = path.strip("/")
        keep = f"(relative = {quoted(clean)} OR startswith(relative, {quoted(clean + '/')}) OR {keep})"
    return files.filter(F.expr(keep))


#: Names of files with ignore rules; in one folder the later name goes first.
RULE_FILES = (".gitignore", ".ignore")
_RULES = "array<struct<regex:string,negated:boolean,only_dir:boolean>>"


def parsed_rules(lines: list[str]) -> list[dict]:
    """Rules of one file in their order, as patterns of whole paths below its folder."""
    rules = []
    for line in lines:
        parsed = ignore_regex(line)
        if parsed:
            regex, negated = parsed
            only_dir = regex.endswith("/.*$")
            rules.append({"regex": regex.removesuffix("/.*$" if only_dir else "(?:/.*)?$") + "$", "negated": negated, "only_dir": only_dir})
    return rules


def ignore_rules(spark: SparkSession, root: str, global_rules: list[str] = ()) -> DataFrame:
    """(folder, rank, rules) of every rule file below the root, read in tasks; rank -1 has the rules of no folder."""
    known = spark.createDataFrame([("", -1, parsed_rules(list(global_rules)))], f"folder string, rank int, rules {_RULES}")
    listed = rule_files(spark, root)
    if not listed:
        return known
    places = spark.createDataFrame(listed, "uri string, folder string")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("regex", pa.string()), ("negated", pa.bool_()), ("only_dir", pa.bool_())]))
        for batch in batches:
            uris = batch.column("uri").to_pylist()
            rules = [parsed_rules((read_text(uri) or "").splitlines()) for uri in uris]
            ranks = [RULE_FILES.index(uri.rpartition("/")[2]) for uri in uris]
            yield pa.RecordBatch.from_arrays([batch.column("folder"), pa.array(ranks, pa.int32()), pa.array(rules, kind)], ["folder", "rank", "rules"])

    tasks = min(len(listed), 4 * spark.sparkContext.defaultParallelism)
    return known.union(places.repartition(tasks).mapInArrow(read, f"folder string, rank int, rules {_RULES}"))


def ignored_places(files: DataFrame, rules: DataFrame) -> DataFrame:
    """(place) of the files and folders that rules name.

    Every folder on the way to a file is judged once.  A rule file speaks for what lies below its folder; the
    deepest file with a rule that fits decides, and of its fitting rules the last.
    """
    parts = F.split("relative", "/")
    steps = F.transform(
        F.sequence(F.lit(1), F.size(parts)),
        lambda n: F.struct(F.array_join(F.slice(parts, F.lit(1), n), "/").alias("place"), (n < F.size(parts)).alias("is_dir")),
    )
    places = files.select(F.explode(steps).alias("p")).select("p.*").distinct()
    above = F.split("place", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(above) - 1), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(above, F.lit(1), n), "/").alias("folder")))
    asked = places.select("place", "is_dir", F.explode(folders).alias("f")).select("place", "is_dir", "f.*")
    below = F.when(F.col("folder") == "", F.col("place")).otherwise(F.substring("place", F.length("folder") + 2, F.lit(2**31 - 1)))
    fits = F.filter("rules", lambda r: F.rlike(F.col("below"), r["regex"]) & (~r["only_dir"] | F.col("is_dir")))
    judged = asked.join(rules, "folder").withColumn("below", below).withColumn("last", F.try_element_at(fits, F.lit(-1))).where("last IS NOT NULL")
    verdict = judged.groupBy("place").agg(F.max_by("last.negated", F.struct("depth", "rank")).alias("kept"))
    return verdict.where("NOT kept").select("place")


def not_ignored_below(files: DataFrame, rules: DataFrame, include: list[str] = ()) -> DataFrame:
    """Drops files that rules name or that lie in a folder they name; what is below ``include`` stays.

    A rule that takes a file in again has no effect within a folder that is left out.
    """
    named = ignored_places(files, rules)
    parts = F.split("relative", "/")
    ways = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    forced = F.lit(False)
    for path in include:
        clean = path.strip("/")
        forced = forced | (F.col("relative") == clean) | F.startswith("relative", F.lit(clean + "/"))
    gone = files.where(~forced).select("relative", F.explode(ways).alias("place")).join(named, "place", "left_semi").select("relative").distinct()
    return files.join(gone, "relative", "left_anti").select(*files.columns)


def read_lines(spark: SparkSession, path: str) -> list[str]:
    """Lines of one small control file, such as ignore rules; none if absent."""
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hpath):
        return []
    stream = fs.open(hpath)
    try:
        return jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").splitlines()
    finally:
        stream.close()


# ------------------------------------------------------------ manifests, rooms
def manifest_projects(files: DataFrame) -> DataFrame:
    """Project names stated in package manifests at the top of the tree."""
    found = F.lit(None).cast("array<string>")
    for name, pattern in fv.MANIFEST_PATTERNS:
        names = F.regexp_extract_all("content", F.lit(pattern), F.lit(1))
        found = F.when(F.col("relative") == name, names).otherwise(found)
    rows = files.select(F.explode(found).alias("name"))
    return rows.select(F.trim("name").alias("name")).filter("name <> ''").distinct()


def folder_rooms(files: DataFrame, profile: str = "coding") -> DataFrame:
    """Rooms from folder names: mapped or own names at the top, mapped ones below."""
    parts = F.split("relative", "/")
    folders = files.select(
        F.explode(
            F.transform(
                F.slice(parts, 1, F.least(F.size(parts) - 1, F.lit(2))),
                lambda p, i: F.struct(
                    i.alias("level"), p.alias("folder"), F.get(parts, 0).alias("top")
                ),
            )
        ).alias("f")
    ).select("f.*").distinct()
    named = folders.filter(
        ~F.col("folder").isin(fv.ROOM_SKIP_DIRS) & ~F.col("top").isin(fv.ROOM_SKIP_DIRS)
    )
    key = F.translate(F.lower("folder"), "-", "_")
    cases = " ".join(
        f"WHEN k IN ({', '.join(quoted(w) for w in words)}) THEN {quoted(room)}"
        for room, words in fv.FOLDER_ROOMS[profile].items()
    )
    keyed = named.withColumn("k", key).withColumn("_mapped", F.expr(f"CASE {cases} END"))
    own = F.when(
        (F.col("level") == 0) & (F.octet_length("folder") > 2)
        & F.col("folder").rlike(r"^\p{IsAlphabetic}"),
        F.translate(F.lower("folder"), "- ", "__"),
    )
    rooms = keyed.withColumn("name", F.coalesce("_mapped", own)).filter("name IS NOT NULL")
    return rooms.groupBy("name").agg(
        F.min_by("folder", F.struct("level", "folder")).alias("folder")
    ).select(
        "name", F.concat(F.lit("Files from "), "folder", F.lit("/")).alias("description"),
        F.array("name", F.lower("folder")).alias("keywords"),
    )
