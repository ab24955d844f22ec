"""Sources of a catalogue for a question: the best section of each source by shared terms and signed markers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import fold
from ..plans.cut import checkpoint
from .relational import top_per_group

#: Words of a question that asks what to do; markers of sections and what each adds, by the kind of question.
GENERIC_QUESTION = ("datos clave", "escalado", "pasos", "que hacer", "manejo", "acciones", "prioridades")
OPERATIONAL = ("manejo", "prioridad", "prioridades", "abdomen agudo", "exploracion", "reevaluacion", "cirugia", "algoritmo", "escalado")
NOT_OPERATIONAL = (
    "validacion", "riesgos pendientes", "imagen y pronostico", "cambios implementados", "gas portal", "neumatosis gastrica", "courvoisier", "aerobilia", "triada critica",
)
SPECIFIC = (
    "diverticul", "hernia crural", "colecistect", "vesicula en porcelana", "fenobarbital", "colestasis", "incarceracion", "obstruccion intestinal", "perforacion",
)
NEUTRAL = (
    "constantes", "signos de alarma", "exploracion abdominal", "signos peritoneales", "analitica", "imagen", "reevaluacion", "escalado digestivo", "escalado quirurgico",
)
ABDOMINAL_DOMAIN = "gastro_hepato"
ABDOMINAL_QUESTION = ("abdomen", "abdominal", "estomago", "epigastr")
ABDOMINAL = ("abdomen agudo", "cirugia", "exploracion abdominal", "peritone", "obstruccion", "reevaluacion")
#: Sections of fewer characters don't count; longer ones are cut; of a source the first ones are taken.
SHORT_SECTION, LONG_SECTION, MOST_SECTIONS, SNIPPET = 40, 620, 250, 280


def held(text: Column, markers: tuple[str, ...]) -> Column:
    """How many of the markers a folded text holds."""
    return sum((F.contains(text, F.lit(m)).cast("int") for m in markers), F.lit(0))


def terms(text: Column) -> Column:
    """Distinct terms of a folded text."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[a-z0-9]{3,}"), F.lit(0)))


def sections_of(sources: DataFrame, source: str, text: str) -> DataFrame:
    """``source, section, text``: a source's paragraphs with single spaces, those of 40 characters or more, cut at 620, 250 at most."""
    long = sources.select(source, F.posexplode(F.split(text, r"\n\s*\n", -1)).alias("section", "text"))
    clean = long.withColumn("text", F.trim(F.regexp_replace("text", r"\s+", " "))).where(F.length("text") >= SHORT_SECTION)
    first = top_per_group(clean, [source], [F.asc("section")], MOST_SECTIONS, "nth").drop("nth")
    return first.withColumn("text", F.left("text", F.lit(LONG_SECTION)))


def catalogue_sources(questions: DataFrame, matched: DataFrame, catalogue: DataFrame, sections: DataFrame, qid: str, most: int = 3) -> DataFrame:
    """``qid, rank, domain, title, source, snippet, score, type`` of the ``most`` best sources for each question.

    ``questions (qid, text)``; ``matched (qid, nth, domain, label, summary)`` are its domains in order; ``catalogue (domain, nth, title, source)``
    names the domains' sources in order, ``sections (source, section, text)`` their texts. A section scores one for each term that it shares with
    the question. If that asks what to do, it gets 2 for each operational marker and loses 2 for each other one; if, moreover, nothing
    specific is asked, it loses 3 for each specific marker and gets 3 for each neutral one. Questions about the abdomen add 3 for each marker of
    their domain. A source counts by its best section, the first of equals, if that is above 0, and once in each domain. A question without any
    gets its domains' own summaries.

    Markers are counted once for each section. Shared terms come from an index of terms; what markers alone give depends on three flags
    of the question, so that of sections without a shared term only the best of each source and flags is looked at, not all of them.
    """
    low = questions.select(qid, fold(F.coalesce("text", F.lit(""))).alias("low"))
    generic, special = held(F.col("low"), GENERIC_QUESTION) > 0, held(F.col("low"), SPECIFIC) > 0
    asked = low.select(qid, terms(F.col("low")).alias("terms"), generic.alias("generic"), (generic & ~special).alias("open"), (held(F.col("low"), ABDOMINAL_QUESTION) > 0).alias("belly"))
    named = matched.select(qid, F.col("nth").alias("domain_nth"), "domain").join(asked, qid)
    flagged = named.withColumn("belly", F.col("belly") & (F.col("domain") == ABDOMINAL_DOMAIN))
    folded = sections.select("source", "section", "text", fold(F.col("text")).alias("low"))
    marked = checkpoint(
        folded.select(
            "source", "section", "text", terms(F.col("low")).alias("terms"), (2 * held(F.col("low"), OPERATIONAL) - 2 * held(F.col("low"), NOT_OPERATIONAL)).alias("by_generic"),
            (3 * held(F.col("low"), NEUTRAL) - 3 * held(F.col("low"), SPECIFIC)).alias("by_open"), (3 * held(F.col("low"), ABDOMINAL)).alias("by_belly"),
        )
    )

    def markers() -> Column:
        return sum(F.when(F.col(flag), F.col(f"by_{flag}")).otherwise(0) for flag in ("generic", "open", "belly"))

    listed = catalogue.select("domain", "nth", "title", "source")
    wanted = flagged.join(listed.select("domain", "source").distinct(), "domain")
    # sections that share terms
    words = wanted.select(qid, "domain", "source", "generic", "open", "belly", F.explode("terms").alias("term"))
    index = marked.select("source", "section", "by_generic", "by_open", "by_belly", F.explode("terms").alias("term"))
    keys = [qid, "domain", "source", "section"]
    shared = words.join(index, ["source", "term"]).groupBy(*keys).agg(F.count("*").alias("n"), F.first(markers()).alias("m"))
    # for each source and flags, the section that its markers alone put first
    flags = wanted.select("generic", "open", "belly").distinct()
    alone = top_per_group(marked.drop("terms", "text").crossJoin(F.broadcast(flags)).withColumn("m", markers()), ["source", "generic", "open", "belly"], [F.desc("m"), F.asc("section")], 1, "r")
    alone = wanted.join(alone.select("source", "generic", "open", "belly", "section", "m"), ["source", "generic", "open", "belly"])
    both = shared.select(*keys, (F.col("n") + F.col("m")).alias("score")).unionByName(alone.select(*keys, F.col("m").cast("long").alias("score")))
    best = top_per_group(both.where("score > 0"), [qid, "domain", "source"], [F.desc("score"), F.asc("section")], 1, "r").drop("r")
    first = top_per_group(listed, ["domain", "source"], [F.asc("nth")], 1, "r").drop("r")
    scored = best.join(first, ["domain", "source"]).join(matched.select(qid, F.col("nth").alias("domain_nth"), "domain"), [qid, "domain"])
    top = top_per_group(scored, [qid], [F.desc("score"), F.asc("domain_nth"), F.asc("nth")], most)
    texts = marked.select("source", "section", F.left("text", F.lit(SNIPPET)).alias("snippet"))
    out = top.join(texts, ["source", "section"]).select(qid, "rank", "domain", "title", "source", "snippet", "score", F.lit("internal_catalog").alias("type"))
    none = matched.join(top.select(qid).distinct(), qid, "left_anti").withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy("nth"))).where(F.col("rank") <= most)
    own = none.select(qid, "rank", "domain", F.col("label").alias("title"), F.lit("domain_catalog").alias("source"), F.left("summary", F.lit(SNIPPET)).alias("snippet"), F.lit(0).cast("long").alias("score"), F.lit("internal_catalog").alias("type"))
    return out.unionByName(own)
