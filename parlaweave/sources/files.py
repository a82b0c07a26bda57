"""Readers and writers of the file formats."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import first_line, second_line_type


def read_corpus(spark: SparkSession, path: str, recursive: bool = True, annotated: bool = False) -> DataFrame:
    """Text files as documents: ``doc_id`` (path), ``base`` (name without ``.txt``), ``text``; annotated ones only if ``annotated``."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=recursive, pathGlobFilter="*.txt")
    name = F.col("_metadata.file_name")
    kept = files if annotated else files.where(~name.endswith(".annotated.txt"))
    return kept.select(F.col("_metadata.file_path").alias("doc_id"), F.regexp_replace(name, r"\.txt$", "").alias("base"), F.col("value").alias("text"))


def read_graph_corpus(spark: SparkSession, path: str) -> DataFrame:
    """All text files of one folder (not of those below), annotated ones too, for a graph: ``graph_id`` (the folder's name), ``doc_id``, ``base``, ``text``.

    The order of a graph's documents is that of ``doc_id``, the path."""
    docs = read_corpus(spark, path, recursive=False, annotated=True)
    return docs.select(F.element_at(F.split("doc_id", "/"), -2).alias("graph_id"), "doc_id", "base", "text")


def count_files(spark: SparkSession, path: str) -> DataFrame:
    """Files a folder: ``folder`` (its last name) and ``files``; only names are listed, no content is read."""
    names = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path")
    return names.groupBy(F.element_at(F.split("path", "/"), -2).alias("folder")).agg(F.count(F.lit(1)).alias("files"))


def read_titles(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``first`` line and ``second`` line's type of every text file: the two kinds of heading that files may have."""
    docs = read_corpus(spark, path)
    return docs.select("doc_id", first_line(F.col("text")).alias("first"), second_line_type(F.col("text")).alias("second"))


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """One code a line; other lines are dropped."""
    return spark.read.text(path).select(F.expr("try_cast(trim(value) as bigint)").alias("codigo")).where("codigo is not null")


def read_typed_codes(spark: SparkSession, path: str) -> DataFrame:
    """Pairs of lines ``TYPE:`` and code; a line left over is dropped."""
    lines = F.split(F.regexp_replace("value", r"\s+$", ""), r"\r?\n")
    whole = spark.read.text(path, wholetext=True).select(lines.alias("l"))
    pairs = whole.where(F.size("l") >= 2).select(F.explode(F.sequence(F.lit(0), F.floor(F.size("l") / 2).cast("int") - 1)).alias("i"), "l")
    return pairs.select(F.regexp_replace(F.trim(F.get("l", F.col("i") * 2)), ":$", "").alias("tipo"), F.expr("try_cast(trim(get(l, i * 2 + 1)) as bigint)").alias("codigo"))


def read_aliases(spark: SparkSession, path: str) -> DataFrame:
    """``alias: canonical`` lines, split at the first colon; lines without one are dropped."""
    line = spark.read.text(path).where("value like '%:%'")
    return line.select(F.trim(F.regexp_extract("value", r"^([^:]*):(.*)$", 1)).alias("alias"), F.trim(F.regexp_extract("value", r"^([^:]*):(.*)$", 2)).alias("canonical")).where("alias <> ''")


def read_counts(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, header=True, schema="Ano int, Contador int, Fonte string, Tipo string")


def read_json_entities(spark: SparkSession, path: str) -> DataFrame:
    """Grouped entities (name -> [[start, end, score], ...]) as rows ``doc_id``, ``name``, ``start``, ``end``, ``score``; broken files give none."""
    whole = spark.read.text(path, wholetext=True, pathGlobFilter="*.json")
    parsed = whole.select(F.col("_metadata.file_path").alias("doc_id"), F.from_json("value", "map<string, array<array<double>>>").alias("m"))
    rows = parsed.select("doc_id", F.explode("m").alias("name", "spots")).select("doc_id", "name", F.explode("spots").alias("s"))
    return rows.select("doc_id", "name", F.get("s", F.lit(0)).cast("int").alias("start"), F.get("s", F.lit(1)).cast("int").alias("end"), F.get("s", F.lit(2)).alias("score"))


def with_alias(names: DataFrame, name: str, aliases: DataFrame) -> DataFrame:
    """Adds ``canonical``: the alias's, or the name itself."""
    return names.join(aliases.select(F.col("alias").alias("_a"), "canonical"), F.col(name) == F.col("_a"), "left").drop("_a").withColumn("canonical", F.coalesce("canonical", F.col(name)))


def entities_json(groups: DataFrame, key: str, name: str) -> DataFrame:
    """One JSON object a document from ``positions``; names by length, longest first, then alphabetically."""
    spot = F.transform("positions", lambda p: F.array(p["start"].cast("double"), p["end"].cast("double"), p["score"]))
    rows = groups.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.length(name)).alias("l"), F.lower(name).alias("low"), F.col(name).alias("name"), spot.alias("spots")))).alias("g"))
    item = F.transform("g", lambda g: F.concat(F.to_json(F.struct(g["name"].alias("k"))), F.lit("\x01"), F.to_json(g["spots"])))
    clean = F.transform(item, lambda s: F.regexp_replace(s, r'^\{"k":(.*)\}\x01', "$1:"))
    return rows.select(key, F.concat(F.lit("{"), F.array_join(clean, ","), F.lit("}")).alias("json"))


def write_table(df: DataFrame, path: str, *by: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).partitionBy(*by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_metrics(metrics: DataFrame, path: str, house: str, stamp: str) -> str:
    """The measures of a house's graphs as CSV under a name with house and time stamp; the path it wrote to."""
    where = f"{path}/metricas_{house}_{stamp}"
    write_csv(metrics.orderBy("graph_id"), where)
    return where


def code_lines(codes: DataFrame) -> DataFrame:
    """Code lists as lines: ``ano`` and ``value``; a type goes on a line of its own, with a colon, before its code."""
    line = F.concat_ws("\n", F.concat("tipo", F.lit(":")), F.col("codigo").cast("string"))
    return codes.where("codigo is not null").select("ano", line.alias("value"))


def write_codes(codes: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder a year of text files; ``append`` adds to what is there."""
    code_lines(codes).write.mode(mode).partitionBy("ano").text(path)


def failed_lines(failed: DataFrame, *keep: str) -> DataFrame:
    """Error lists as lines: type and code written together."""
    return failed.select(*keep, F.concat(F.coalesce("tipo", F.lit("")), F.col("codigo").cast("string")).alias("value"))


def write_documents(docs: DataFrame, path: str, name: str, text: str) -> None:
    """One folder a document, named by ``name``, with one file that holds ``text``; null texts are left out."""
    one = docs.where(F.col(text).isNotNull()).select(F.col(name).alias("document"), F.col(text).alias("value"))
    one.write.mode("overwrite").partitionBy("document").option("lineSep", "\n").text(path)


def text_of_entities(grouped: DataFrame, texts: DataFrame, suffix: str = ".grouped_entities.json") -> DataFrame:
    """Entity files (``path``) with the ``text`` of the document of the same base name, ``status`` ``processed`` or ``skipped`` where there is none.

    ``texts`` has ``file`` (a file name) and ``text``; a name with ``.txt`` goes before the bare one."""
    name = F.element_at(F.split("path", "/"), -1)
    base = F.when(name.endswith(suffix), F.substring(name, F.lit(1), F.length(name) - len(suffix))).otherwise(name)
    known = texts.groupBy("file").agg(F.min("text").alias("text"))
    with_txt, bare = (known.select(F.col("file").alias(f), F.col("text").alias(t)) for f, t in (("_f1", "_t1"), ("_f2", "_t2")))
    out = grouped.withColumn("base", base)
    out = out.join(with_txt, F.concat("base", F.lit(".txt")) == F.col("_f1"), "left").join(bare, F.col("base") == F.col("_f2"), "left")
    return out.select(*[F.col(f"`{c}`") for c in grouped.columns], "base", F.coalesce("_t1", "_t2").alias("text"), F.when(F.coalesce("_f1", "_f2").isNull(), "skipped").otherwise("processed").alias("status"))


def status_counts(files: DataFrame) -> DataFrame:
    """How many files were processed and skipped."""
    return files.groupBy("status").agg(F.count(F.lit(1)).alias("files"))


def gold_positions(entities: DataFrame, key: str, aliases: DataFrame) -> DataFrame:
    """Manual entities (``text``, ``original_start``, ``original_end``) grouped under their canonical names: ``key``, ``name``, ``positions`` with score 1.

    Entities that lack a text or an end are left out; a text without an alias stands for itself."""
    whole = entities.where("text is not null and original_start is not null and original_end is not null")
    named = with_alias(whole.select(key, "text", "original_start", "original_end"), "text", aliases)
    spot = F.struct(F.col("original_start").alias("start"), F.col("original_end").alias("end"), F.lit(1.0).alias("score"))
    return named.groupBy(key, F.col("canonical").alias("name")).agg(F.array_sort(F.collect_set(spot)).alias("positions"))


# What a GEXF document has around its nodes and edges.
GEXF_FRAME = {0: '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://www.gexf.net/1.2draft" version="1.2">\n  <graph mode="static" defaultedgetype="directed">\n    <nodes>', 2: "    </nodes>\n    <edges>", 4: "    </edges>\n  </graph>\n</gexf>"}


def gexf_lines(vertices: DataFrame, edges: DataFrame) -> DataFrame:
    """GEXF documents line by line: ``graph_id``, ``part`` (0 head, 1 nodes, 2 middle, 3 edges, 4 end), ``seq``, ``line``.  Sorted by part and seq they make the file.

    ``vertices`` has ``graph_id``, ``id``, ``label``; ``edges`` has ``graph_id``, ``src``, ``dst`` (labels), ``weight``."""

    def attr(c: Column) -> Column:
        for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("\n", "&#10;")):
            c = F.replace(c, F.lit(a), F.lit(b))
        return c

    node = vertices.select("graph_id", F.lit(1).alias("part"), F.col("id").alias("seq"), F.format_string('      <node id="%d" label="%s" />', F.col("id"), attr(F.col("label"))).alias("line"))
    ends = edges.join(vertices.select("graph_id", F.col("label").alias("src"), F.col("id").alias("a")), ["graph_id", "src"]).join(vertices.select("graph_id", F.col("label").alias("dst"), F.col("id").alias("b")), ["graph_id", "dst"])
    edge = ends.select("graph_id", F.lit(3).alias("part"), (F.col("a") * (1 << 31) + F.col("b")).alias("seq"), F.format_string('      <edge source="%d" target="%d" weight="%d" />', "a", "b", F.col("weight").cast("bigint")).alias("line"))
    parts = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.lit(v).alias("line")) for k, v in GEXF_FRAME.items()]))
    rest = vertices.select("graph_id").distinct().select("graph_id", parts.alias("p")).select("graph_id", "p.part", F.lit(0).cast("bigint").alias("seq"), "p.line")
    return node.unionByName(edge).unionByName(rest)


def write_gexf(vertices: DataFrame, edges: DataFrame, path: str) -> None:
    """One folder a graph with one text file, as the format asks for."""
    lines = gexf_lines(vertices, edges).repartition("graph_id").sortWithinPartitions("graph_id", "part", "seq")
    lines.select("graph_id", F.col("line").alias("value")).write.mode("overwrite").partitionBy("graph_id").option("maxRecordsPerFile", 0).text(path)


def read_gexf(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(vertices ``file``, ``id``, ``label``; edges ``file``, ``src``, ``dst``, ``weight``), a missing weight being 1.  ``path`` may be a glob; the year is the caller's to take from ``file``."""
    node = T.StructType([T.StructField("_id", T.StringType()), T.StructField("_label", T.StringType())])
    edge = T.StructType([T.StructField(c, T.StringType()) for c in ("_source", "_target", "_weight")])
    read = lambda tag, schema: spark.read.format("xml").option("rowTag", tag).schema(schema).load(path)
    v = read("node", node).select(F.input_file_name().alias("file"), F.col("_id").cast("bigint").alias("id"), F.col("_label").alias("label"))
    e = read("edge", edge).select(F.input_file_name().alias("file"), F.col("_source").cast("bigint").alias("src"), F.col("_target").cast("bigint").alias("dst"), F.coalesce(F.col("_weight").cast("double").cast("bigint"), F.lit(1)).alias("weight"))
    return v, e


def year_of_file(c: Column) -> Column:
    """Between the first ``_`` and the next ``.`` of a file name."""
    return F.split_part(F.split_part(F.element_at(F.split(c, "/"), -1), F.lit("_"), F.lit(2)), F.lit("."), F.lit(1))


#: How the fetcher names itself.
USER_AGENT = "Mozilla/5.0 (compatible; transcript-graph)"


def agenda_urls(spark: SparkSession, template: str, first: int, last: int) -> DataFrame:
    """``ano`` and ``url`` of the agenda of each year from ``first`` to ``last``; ``template`` has ``{ano}`` wherever the year goes."""
    return spark.range(first, last + 1).select(F.col("id").cast("int").alias("ano"), F.replace(F.lit(template), F.lit("{ano}"), F.col("id").cast("string")).alias("url"))


def probe_codes(spark: SparkSession, fonte: str, first: int, count: int) -> DataFrame:
    """A dense range of codes to try: ``fonte`` and ``codigo`` from ``first`` on."""
    return spark.range(first, first + count).select(F.lit(fonte).alias("fonte"), F.col("id").alias("codigo"))


def urls_of(codes: DataFrame, template: str) -> DataFrame:
    """``codes`` with ``url``; ``template`` has ``{codigo}``."""
    return codes.withColumn("url", F.replace(F.lit(template), F.lit("{codigo}"), F.col("codigo").cast("string")))


def http_get(url: str, agent: str = USER_AGENT, seconds: float = 30.0) -> tuple[int, str | None]:
    """(status, body) of a page; the body only with status 200.  Status 0: no answer."""
    import urllib.error
    import urllib.request

    try:
        with urllib.request.urlopen(urllib.request.Request(url, headers={"User-Agent": agent}), timeout=seconds) as answer:
            return answer.status, answer.read().decode(answer.headers.get_content_charset() or "utf-8", "replace") if answer.status == 200 else None
    except urllib.error.HTTPError as e:
        return e.code, None
    except OSError:
        return 0, None


def fetch_pages(pages: DataFrame, url: str = "url", fetch: Callable[[str], tuple[int, str | None]] = http_get) -> DataFrame:
    """``pages`` with ``status`` and ``html`` of each ``url``, by a pluggable ``fetch``; the body counts only with status 200, and a null url isn't fetched."""
    columns = pages.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            got = [(None, None) if u is None else fetch(u) for u in pdf[url]]
            yield pdf[columns].assign(status=pd.array([s for s, _ in got], dtype="Int32"), html=[h if s == 200 else None for s, h in got])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema)
    return pages.mapInPandas(run, f"{schema}, status int, html string")
