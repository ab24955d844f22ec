"""Writers: pages with a manifest, link snapshots, regression sets, audit rows, gauges; and blocks of parsed documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_PAGE, _HEADING = re.compile(r"\[page\s+(\d+)\]", re.I), re.compile(r"(#{1,6})\s+(.+)")


def page_records(pages: DataFrame) -> DataFrame:
    """``file, markdown, manifest`` of pages ``(url, host, depth, discovered_from, title, text, fetched_at, status_code, links array<struct<href, anchor>>)``.

    A page's file lies below its host and is named by its address; its manifest line says where it is and where it links to.
    """
    name = F.concat(F.regexp_replace(F.lower("host"), "[^a-z0-9.-]", "_"), F.lit("/"), F.left(F.sha1("url"), F.lit(14)), F.lit(".md"))
    heading = F.when(F.coalesce(F.col("title"), F.lit("")) == "", "Web source").otherwise(F.col("title"))
    body = F.format_string("# %s\n\n- source_url: %s\n- host: %s\n- fetched_at_epoch: %.3f\n- depth: %d\n\n%s\n", heading, "url", "host", "fetched_at", F.col("depth").cast("int"), "text")
    edges = F.transform("links", lambda k: F.struct(k["href"].alias("url"), F.coalesce(k["anchor"], F.lit("")).alias("anchor")))
    line = F.struct(
        "url", name.alias("source_file"), "host", "depth", "discovered_from", "title", "status_code", F.size("links").alias("links_discovered"),
        F.transform("links", lambda k: k["href"]).alias("outgoing_links"), edges.alias("outgoing_edges"),
    )
    return pages.select(name.alias("file"), body.alias("markdown"), F.to_json(line).alias("manifest"))


def write_pages(pages: DataFrame, folder: str) -> None:
    """Markdown as text files dealt by host below ``folder/pages`` and the manifest as JSON lines below ``folder/manifest``, both appended."""
    records = page_records(pages)
    host = F.split_part("file", F.lit("/"), F.lit(1))
    records.select(host.alias("host"), "file", "markdown").write.mode("append").partitionBy("host").json(f"{folder}/pages")
    records.select(F.col("manifest").alias("value")).write.mode("append").text(f"{folder}/manifest")


def link_snapshot(general: DataFrame, topical: DataFrame, hub_auth: DataFrame, anchors: DataFrame) -> DataFrame:
    """One row for each node: ranks, hub and authority by their maxima, and how often each word leads to it."""
    most = general.agg(F.max("rank").alias("mg")).crossJoin(topical.agg(F.max("rank").alias("mt")))
    words = anchors.select("id", F.explode("words").alias("w")).groupBy("id", "w").agg(F.count("*").alias("n"))
    words = words.groupBy("id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("w", "n")))).alias("incoming_anchor_terms"))
    both = general.withColumnRenamed("rank", "g").join(topical.withColumnRenamed("rank", "t"), "id").join(hub_auth, "id").join(words, "id", "left")
    both = both.crossJoin(F.broadcast(most))
    return both.select(
        "id", (F.col("g") / F.col("mg")).alias("global_pagerank_norm"), (F.col("t") / F.col("mt")).alias("topic_pagerank_norm"),
        F.col("authority").alias("hits_authority_norm"), F.col("hub").alias("hits_hub_norm"), "incoming_anchor_terms",
    )


SNAPSHOT = "id string, global_pagerank_norm double, topic_pagerank_norm double, hits_authority_norm double, hits_hub_norm double, incoming_anchor_terms map<string,long>"


def write_snapshot(snapshot: DataFrame, path: str) -> None:
    snapshot.withColumn("id", F.col("id").cast("string")).write.mode("overwrite").json(path)


def read_snapshot(spark, path: str) -> DataFrame:
    """A snapshot as it was written; malformed lines are left out."""
    return spark.read.schema(SNAPSHOT).option("mode", "DROPMALFORMED").json(path)


def regression_set(runs: DataFrame, good: Column) -> DataFrame:
    """JSON lines of the runs that are good enough to be checked against: ``query, expected_answer, domain``, one for each query."""
    kept = runs.where(good).groupBy("query").agg(F.min_by(F.struct("answer", "domain"), "id").alias("r"))
    return kept.select(F.to_json(F.struct("query", F.col("r.answer").alias("expected_answer"), F.col("r.domain").alias("domain"))).alias("value"))


def audit_row(reviews: DataFrame, ai: Column, human: Column, inverted: bool = False) -> DataFrame:
    """``reviews`` as rows of an audit log, with their classification and when they were made, to be appended."""
    from ..operators.relational import deviation

    return reviews.select("*", deviation(ai, human, inverted).alias("classification"), F.current_timestamp().alias("created_at"))


def exposition(gauges: DataFrame, name: Column, value: Column, labels: dict[str, Column], help_text: str = "") -> DataFrame:
    """Gauges in the text format that monitoring reads, one line each, with the lines that explain them before: ``nth, line``."""
    shown = F.concat_ws(",", *(F.concat(F.lit(f'{k}="'), F.regexp_replace(v.cast("string"), r'(["\\])', r"\\$1"), F.lit('"')) for k, v in labels.items()))
    rows = gauges.select(name.alias("n"), F.concat(name, F.lit("{"), shown, F.lit("} "), value.cast("string")).alias("line"))
    heads = rows.select("n").distinct().select("n", F.explode(F.array(F.concat(F.lit("# HELP "), "n", F.lit(f" {help_text}")), F.concat(F.lit("# TYPE "), "n", F.lit(" gauge")))).alias("line"))
    every = heads.withColumn("o", F.lit(0)).unionByName(rows.withColumn("o", F.lit(1)))
    return every.select(F.row_number().over(Window.orderBy("n", "o", "line")).alias("nth"), "line")


def _blocks(text: str) -> list[dict]:
    """Paragraphs of a parsed document with their section and page; headings form a path, [Page n] marks count pages."""
    out: list[dict] = []
    path: list[str] = []
    held: list[str] = []
    page = 1
    for line in [*text.splitlines(), ""]:
        bare = line.strip()
        mark, heading = _PAGE.fullmatch(bare), _HEADING.fullmatch(bare)
        if bare and not mark and not heading:
            held.append(line.rstrip())
            continue
        content = "\n".join(held).strip()
        held.clear()
        if content:
            section = " > ".join(["Documento", *(path or [f"Pagina {page}"])])
            table = sum("|" in row for row in content.split("\n")) >= 2
            out.append({"type": "table" if table else "text", "content": content, "section_path": section, "page": page})
        if mark:
            page = int(mark[1])
        if heading:
            path = [*path[: len(heading[1]) - 1], heading[2].strip()]
    return out


def parsed_blocks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """``doc, nth, type, content, section_path, page`` of parsed documents as Markdown with page marks."""
    kind = docs.schema[doc].dataType.simpleString()
    block = "struct<type:string,content:string,section_path:string,page:int>"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({doc: f[doc], "blocks": [_blocks(t or "") for t in f[text]]})

    long = docs.select(doc, text).mapInPandas(run, f"{doc} {kind}, blocks array<{block}>")
    return long.select(doc, F.posexplode("blocks").alias("nth", "b")).select(doc, "nth", "b.*")


def parse_trace(files: DataFrame, path: str, content: str) -> DataFrame:
    """S3: how each file was read: ``path, parser, chars, pages, ok``."""
    low = F.lower(path)
    parser = F.when(low.endswith(".md"), "markdown").when(low.endswith(".txt"), "text").when(low.endswith(".json"), "layout").otherwise("unsupported")
    pages = F.greatest(F.lit(1), F.regexp_count(content, F.lit(r"(?mi)^\[page\s+\d+\]\s*$")))
    chars = F.length(F.trim(F.coalesce(content, F.lit(""))))
    return files.select(path, parser.alias("parser"), chars.alias("chars"), pages.alias("pages"), ((parser != "unsupported") & (chars > 0)).alias("ok"))


def thesaurus(spark, path: str, per_term: int = 4) -> DataFrame:
    """``term, synonym`` of a JSON object of lists, in lower case, each once, ``per_term`` at most and none equal to its term."""
    whole = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,array<string>>").alias("m"))
    long = whole.select(F.explode("m").alias("term", "all")).select(F.lower(F.trim("term")).alias("term"), F.posexplode("all").alias("nth", "synonym"))
    long = long.select("term", F.lower(F.trim("synonym")).alias("synonym"), "nth").where("synonym != '' and synonym != term")
    once = long.groupBy("term", "synonym").agg(F.min("nth").alias("nth"))
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("term").orderBy("nth", "synonym")))
    return ranked.where(F.col("r") <= per_term).select("term", "synonym")
