"""Blocks of parsed page layouts, from JSON in any of its three shapes, without Python."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = (
    "struct<type:string,block_type:string,category:string,content:string,text:string,page:int,page_no:int,section_path:string,"
    "section:string,heading:string,bbox:array<double>>"
)
PAGE = f"struct<page:int,page_idx:int,para_blocks:array<{BLOCK}>,blocks:array<{BLOCK}>>"
#: Top-level lists of blocks, in the order in which they are looked for; then lists of pages.
LISTS = ("para_blocks", "blocks", "layout_blocks", "elements")
SCHEMA = "struct<" + ",".join([f"{n}:array<{BLOCK}>" for n in LISTS] + [f"pdf_info:array<{PAGE}>", f"pages:array<{PAGE}>"]) + ">"

#: Names of block types and the types that they stand for.
TYPES = {
    "title": "header",
    "heading": "header",
    "header": "header",
    "section_header": "header",
    "table": "table",
    "equation": "formula",
    "formula": "formula",
    "interline_equation": "formula",
    "list": "list",
    "image": "figure",
    "figure": "figure",
}


def block_type(name: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit("paragraph"))


def _paged(pages: Column) -> Column:
    """Blocks of pages in order; a block without a page gets that of its page, by number, index or place."""

    def of(page: Column, i: Column) -> Column:
        number = F.coalesce(F.nullif(page["page"], F.lit(0)), page["page_idx"] + 1, i + 1)
        found = F.coalesce(page["para_blocks"], page["blocks"], F.array().cast(f"array<{BLOCK}>"))
        return F.transform(found, lambda b: b.withField("page", F.coalesce(b["page"], number)))

    return F.flatten(F.transform(pages, of))


def blocks(rows: DataFrame, doc: str, json: str) -> DataFrame:
    """``doc, nth, type, content, section_path, page, bbox`` of each JSON; formulas stand between $$, blocks without content go.

    A null or malformed JSON has no blocks.
    """
    read = rows.select(doc, F.from_json(json, SCHEMA).alias("j"))
    all_ = F.coalesce(*(F.col(f"j.{n}") for n in LISTS), _paged(F.col("j.pdf_info")), _paged(F.col("j.pages")))
    long = read.select(doc, F.posexplode(all_).alias("nth", "b")).where("b is not null")
    page = F.coalesce(F.nullif(F.col("b.page"), F.lit(0)), F.col("b.page_no"), F.lit(1))
    kind = block_type(F.coalesce("b.type", "b.block_type", "b.category"))
    content = F.trim(F.coalesce("b.content", "b.text", F.lit("")))
    section = F.coalesce(*(F.nullif(F.trim(f"b.{n}"), F.lit("")) for n in ("section_path", "section", "heading")), F.concat(F.lit("Documento > Pagina "), page.cast("string")))
    wrapped = F.when((kind == "formula") & ~content.startswith("$$"), F.concat(F.lit("$$"), content, F.lit("$$"))).otherwise(content)
    out = long.select(doc, "nth", kind.alias("type"), wrapped.alias("content"), section.alias("section_path"), page.alias("page"), F.col("b.bbox").alias("bbox"))
    return out.where("content != ''")
