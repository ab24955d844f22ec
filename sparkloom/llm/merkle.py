"""Document fingerprints by Merkle trees over paragraphs and sections, with DataFrame functions alone.

A text is cut, without loss, by what stands at a cut and never by how far it lies from the beginning, so that an edit
changes the pieces that it touches and no others. Paragraphs end at line ends; sections end at blank lines and after lines
whose last sign is a cut sign. The leaves of a paragraph are a few words each and begin at words that begin with a cut
sign; in scripts that know no spaces they end behind cut signs and marks. Cut signs are a fixed share of all code points, by a rule on their
numbers. A leaf's node is its SHA-256, a paragraph's that of its leaves' nodes, a section's that of its paragraphs', the
root's that of the sections'; each level hashes its own prefix, so that no node of one level passes for another's. Equal
roots mean equal texts; where roots differ, the branches whose nodes differ locate all edits. A fingerprint holds the root
and the ``SKETCH`` least of the leaves' nodes: the whole set of a short text, a sample by hash of a long one's. Its length
is thus bounded, and the share of common leaves can be estimated from two fingerprints, with a standard deviation of at
most 0.05, exactly if both texts have few leaves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shuffle_partitions


def cut_signs(first: int, last: int, run: int, share: int) -> str:
    """The inside of a character class: between two code points, every ``share``-th run of ``run`` of them, counted from 0."""
    begins = [c for c in range(first - first % (run * share), last + 1, run * share) if c >= first]
    return "".join(f"\\x{{{c:x}}}" + (f"-\\x{{{min(last, c + run - 1):x}}}" if run > 1 else "") for c in begins)


#: Cut signs: a quarter of the ASCII signs and of letters of scripts with spaces, an eighth of those of scripts without.
ASCII, SPACED = cut_signs(0x21, 0x7E, 1, 4), cut_signs(0x80, 0x2DFF, 8, 4)
UNSPACED = cut_signs(0x0E00, 0x0EFF, 1, 8) + cut_signs(0x1000, 0x109F, 1, 8) + cut_signs(0x1780, 0x17FF, 1, 8) + cut_signs(0x2E80, 0xD7FF, 16, 8)
#: Scripts that know no spaces, by their code points, with the marks that end their clauses.
DENSE = r"\x{e00}-\x{eff}\x{1000}-\x{109f}\x{1780}-\x{17ff}\x{2e80}-\x{d7ff}\x{ff01}\x{ff0c}\x{ff1b}\x{ff1f}"
MARKS = "、。！，；？"
#: Words of a leaf, and signs of a word, where nothing cuts before.
WORDS, LONG = 5, 32
_GUARD = r"(?=[\x00-\x7f])"
SECTION = rf"(?<=\n)(?:(?<=\n\n)|(?:(?<=[{ASCII}]\n)|(?<=[^\x00-\x7f]\n)(?<=[{SPACED}{UNSPACED}]\n))(?!\n))"
_WORD = rf"[^\s{DENSE}]{{1,{LONG}}}+"
LEAF = (
    rf"(?s){_WORD}(?:\s++(?![{ASCII}])(?:{_GUARD}|(?![{SPACED}])){_WORD}){{0,{WORDS - 1}}}+\s*+|\s++"
    rf"|[{DENSE}&&[^{UNSPACED}{MARKS}]]{{1,{LONG}}}+[{UNSPACED}{MARKS}]?|[{UNSPACED}{MARKS}]"
)
#: Leaves that a fingerprint holds, of 32 bits each: 64 + 1 + 512 characters at most.
SKETCH = 96


def paragraphs(text: Column) -> Column:
    """Sections of paragraphs; put together they are the text."""
    return F.transform(F.split(text, SECTION, -1), lambda s: F.split(s, "(?<=\n)", -1))


def leaf_nodes(cut: Column) -> Column:
    """Of every section of every paragraph, its leaves' nodes."""

    def leaves(p: Column) -> Column:
        return F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda g: F.sha2(F.concat(F.lit("leaf:"), g), 256))

    return F.transform(cut, lambda s: F.transform(s, leaves))


def nodes_of(leaves: Column) -> Column:
    """The nodes of paragraphs, by section, from their leaves' nodes."""
    return F.transform(leaves, lambda s: F.transform(s, lambda p: F.sha2(F.concat(F.lit("paragraph:"), F.array_join(p, "")), 256)))


def paragraph_nodes(cut: Column) -> Column:
    """The nodes of paragraphs, by section."""
    return nodes_of(leaf_nodes(cut))


def section_nodes(nodes: Column) -> Column:
    return F.transform(nodes, lambda s: F.sha2(F.concat(F.lit("section:"), F.array_join(s, "")), 256))


def root(sections: Column) -> Column:
    return F.sha2(F.concat(F.lit("root:"), F.array_join(sections, "")), 256)


def sketch(leaves: Column) -> Column:
    """The first 32 bits of the least of a text's leaves' nodes, in order."""
    hashes = F.array_distinct(F.transform(F.flatten(F.flatten(leaves)), lambda g: F.left(g, F.lit(8))))
    return F.slice(F.sort_array(hashes), 1, SKETCH)


def fingerprint(root_node: Column, leaves: Column) -> Column:
    """The root and the sketch, as text."""
    coded = F.base64(F.unhex(F.array_join(leaves, "")))
    return F.concat_ws(":", root_node, F.regexp_replace(coded, "[\r\n]", ""))


def likeness(a: Column, b: Column) -> Column:
    """Twice the number of shared leaves by that of all, from 0 to 1, as the least hashes of both sketches show it."""
    least = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    shared = F.size(F.array_intersect(F.array_intersect(least, a), b))
    return F.coalesce(2.0 * shared / F.nullif(F.size(least) + shared, F.lit(0)), F.lit(1.0))


def first_difference(a: Column, b: Column) -> Column:
    """The place, from 0, of the first node that differs; null if none does."""
    return F.nullif(F.array_position(F.zip_with(a, b, lambda x, y: x.eqNullSafe(y)), False), F.lit(0)) - 1


def differing(a: Column, b: Column) -> Column:
    """All branches whose nodes differ: ``section, paragraphs`` for each section, with places from 0."""

    def places(x: Column, y: Column) -> Column:
        return F.sequence(F.lit(0), F.greatest(F.size(x), F.size(y)) - 1)

    none = F.array().cast("array<string>")

    def section(i: Column) -> Column:
        x, y = F.coalesce(F.get(a, i), none), F.coalesce(F.get(b, i), none)
        unlike = F.when(x == y, F.array().cast("array<int>")).otherwise(F.filter(places(x, y), lambda j: ~F.get(x, j).eqNullSafe(F.get(y, j))))
        return F.struct(i.alias("section"), unlike.alias("paragraphs"))

    return F.filter(F.transform(places(a, b), section), lambda s: F.size(s["paragraphs"]) > 0)


def with_next(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """Each row with the text and ``carry`` columns of the row after it by (id, text), the first after the last.

    Ids of any type that can be ordered are cut into ranges of about equal numbers of rows, a few for each shuffle
    partition, by a sample of ids, and each range is sorted by itself. A range's lower bound is an id that occurs, so
    the rows that follow a range are known by their id alone and are sent to both ranges. Only the bounds reach the
    driver. Null ids stand first. Rows of one id stay together, as ids are to tell rows apart.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    n = min(4 * shuffle_partitions(docs.sparkSession), 4000)
    ids = docs.select(F.struct(F.col(id_col).alias("k")).alias("key"))
    lowest, rows = ids.agg(F.min("key"), F.count("*")).first()
    if lowest is None:
        return docs.select("*", *(F.col(c).alias(f"next_{c}") for c in [text_col, *carry]))
    # about 20 for each range, whatever the number of rows; which ids are drawn decides the ranges' sizes and no result
    drawn = ids.sample(min(1.0, 20 * n / rows), seed=1).collect()
    some = sorted({r.key.k for r in drawn if r.key.k is not None})
    bounds = [lowest.k, *(k for k in some[:: max(1, len(some) // n)] if k != lowest.k)]
    at = F.arrays_zip(F.array(*map(F.lit, bounds)).cast(f"array<{kind}>")).cast(f"array<struct<k:{kind}>>")
    spot = docs.withColumn("__key", F.struct(F.col(id_col).alias("k"))).withColumn("__range", F.lit(0))
    # binary search among the bounds: how many are at or below the key
    step = 1 << (len(bounds).bit_length() - 1)
    while step:
        ahead = F.col("__range") + step
        spot = spot.withColumn(
            "__range", F.when((ahead <= len(bounds)) & (F.element_at(at, F.least(ahead, F.lit(len(bounds)))) <= F.col("__key")), ahead).otherwise(F.col("__range"))
        )
        step >>= 1
    last = len(bounds)
    is_bound = F.element_at(at, F.col("__range")) == F.col("__key")
    copy = F.when(is_bound, F.when(F.col("__range") > 1, F.col("__range") - 1).otherwise(F.lit(last)))
    homes = F.array_compact(F.array(F.struct(F.col("__range").alias("r"), F.lit(0).alias("after")), F.when(copy.isNotNull(), F.struct(copy.alias("r"), F.lit(1).alias("after")))))
    dealt = spot.select(*docs.columns, "__key", F.explode(homes).alias("__home"))
    order = Window.partitionBy("__home.r").orderBy("__home.after", "__key", text_col)
    led = dealt.select("*", *(F.lead(c).over(order).alias(f"next_{c}") for c in [text_col, *carry]))
    return led.where("__home.after = 0").drop("__home", "__key")


def edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprints of every whole text and of its edited text, and how alike fingerprints are.

    The edited text has its last floor(n / 4) characters replaced by the first as many (or all) of the next row's text,
    in the order of (id, text), the first row after the last. Returns ``id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, edit_section, edit_paragraph, edit_branches``; the last three locate the
    first edit (null if there is none) and all branches that differ. A null text counts as empty; null ids stand first;
    repeated rows follow one another; of a single row the next is that row itself; an empty table gives an empty one;
    other columns are ignored.
    """
    own = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    own = own.withColumn("tree", leaf_nodes(paragraphs(F.col("text"))))
    own = own.select("id", "text", sketch(F.col("tree")).alias("leaves"), nodes_of(F.col("tree")).alias("nodes"))
    both = with_next(own, "id", "text", ["leaves"])
    n = F.char_length("text")
    quarter = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - quarter), F.substring("next_text", F.lit(1), quarter))
    both = both.select("id", n.cast("long").alias("n_chars"), "leaves", "next_leaves", "nodes", edited.alias("edited"))
    both = both.withColumn("tree", leaf_nodes(paragraphs(F.col("edited"))))
    both = both.select(
        "id",
        "n_chars",
        F.sha2("edited", 256).alias("edited_sha256"),
        "leaves",
        "next_leaves",
        sketch(F.col("tree")).alias("edited_leaves"),
        "nodes",
        nodes_of(F.col("tree")).alias("edited_nodes"),
    )
    both = both.withColumn("sections", section_nodes(F.col("nodes"))).withColumn("edited_sections", section_nodes(F.col("edited_nodes")))
    both = both.withColumn("edit_branches", differing(F.col("nodes"), F.col("edited_nodes")))
    return both.select(
        F.col("id").alias(id_col),
        "n_chars",
        "edited_sha256",
        fingerprint(root(F.col("sections")), F.col("leaves")).alias("fingerprint"),
        fingerprint(root(F.col("edited_sections")), F.col("edited_leaves")).alias("edited_fingerprint"),
        likeness(F.col("leaves"), F.col("edited_leaves")).alias("near_edited"),
        likeness(F.col("leaves"), F.col("next_leaves")).alias("near_next"),
        F.get("edit_branches", F.lit(0))["section"].cast("long").alias("edit_section"),
        F.get(F.get("edit_branches", F.lit(0))["paragraphs"], F.lit(0)).cast("long").alias("edit_paragraph"),
        "edit_branches",
    )
