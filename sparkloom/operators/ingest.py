"""Document ingest: blocks, chunks, questions, quality gate, clean-up and layout."""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import accumulate, groupby

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "Documento"

#: Marks of lines; a heading's and a table's stand at the line's beginning, a check item is a list item as well.
HEADING = re.compile(r"^(#{1,6})\s+(.+)$")
TABLE = re.compile(r"^\|.+\|$")
CHECK = re.compile(r"^\s*[-*+]\s+\[[-xX]\]\s+")
ITEM = re.compile(r"^\s*[-*+]\s+")


def line_kind(line: str) -> str:
    """What a line begins, the first that fits: heading, fence, table, check list, list, paragraph, or nothing."""
    if HEADING.match(line):
        return "section_header"
    if line.strip().startswith("```"):
        return "code_block"
    for kind, mark in (("table", TABLE), ("checklist", CHECK), ("list", ITEM)):
        if mark.match(line):
            return kind
    return "paragraph" if line.strip() else ""


def goes_on(kind: str, line: str) -> bool:
    """Whether a line belongs to the block of this kind before it; lists take indented lines, and plain ones check items as well."""
    if kind in ("checklist", "list") and line.startswith(("    ", "\t")):
        return True
    found = line_kind(line)
    return found == kind and kind != "section_header" or (kind, found) == ("list", "checklist")


def markdown_blocks(text: str) -> list[tuple[str, str, str]]:
    """(type, text, section path) of a Markdown text in order; texts are whole lines as they stand.

    A heading of level n replaces the path from its n-th part on; a fenced block ends with its fence or the text. Check items
    interrupt no paragraph but as items of a list, which do.
    """
    out: list[tuple[str, str, str]] = []
    path = [ROOT]
    kind, lines, fenced = "", [], False

    def flush() -> None:
        if lines:
            out.append((kind, "\n".join(lines), " > ".join(path)))
            lines.clear()

    for line in text.split("\n"):
        if fenced:
            lines.append(line)
            fenced = line_kind(line) != "code_block" and not line.strip().startswith("```")
            continue
        if lines and kind != "code_block" and goes_on(kind, line):
            lines.append(line)
            continue
        flush()
        kind = line_kind(line)
        if kind == "section_header":
            level, title = HEADING.match(line).groups()
            path = [*path[: len(level)], title]
        if kind:
            lines.append(line)
        fenced = kind == "code_block"
    flush()
    return out


def blocks(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """D1 for every document: ``doc, nth, type, content, section_path``. A null text has no blocks."""
    id_type = docs.schema[doc].dataType.simpleString()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(d, i, *b) for d, t in zip(frame[doc], frame[text]) for i, b in enumerate(markdown_blocks(t or ""))]
            yield pd.DataFrame(rows, columns=[doc, "nth", "type", "content", "section_path"])

    return docs.select(doc, text).mapInPandas(run, f"{doc} {id_type}, nth int, type string, content string, section_path string")


def tokens_of(text: str) -> int:
    return max(1, len(text) // 4)


def _packed(units: list[str], budget: int) -> list[str]:
    """Units put together with spaces, as many as a budget allows; one above it stands alone."""
    out: list[list[str]] = []
    used = 0
    for unit in units:
        cost = tokens_of(unit)
        if not out or used + cost > budget:
            out.append([])
            used = 0
        out[-1].append(unit)
        used += cost
    return [" ".join(group) for group in out]


def pieces(text: str, budget: int) -> list[str]:
    """Parts of a text within a budget: of its lines, else of its sentences (which also end at : and ;), else of its words.

    A line or sentence that is too long by itself falls into its words at once. Only a single word can be above the budget.
    """
    if tokens_of(text) <= budget:
        return [text]
    lines = [line.strip() for line in text.splitlines() if line.strip()]
    units = lines if len(lines) > 1 else [x.strip() for x in re.split(r"(?<=[.!?:;])\s+", text) if x.strip()]
    if len(units) < 2:
        return _packed(text.split(), budget) or [text]
    out: list[str] = []
    for long, run in groupby(units, key=lambda u: tokens_of(u) > budget):
        out += [part for unit in run for part in _packed(unit.split(), budget)] if long else _packed(list(run), budget)
    return out


def tail(text: str, budget: int) -> str:
    """The longest run of last words within a budget, but the last word at least if the budget is not 0."""
    words = text.split()
    costs = accumulate(tokens_of(w) for w in reversed(words))
    n = max(1, sum(1 for used in costs if used <= budget))
    return " ".join(words[-n:]) if budget > 0 and words else ""


def pack(parts: list[tuple[str, ...]], size: int = 384, overlap: int = 64, sections: bool = False, bare: bool = False) -> list[tuple[str, str, int, str]]:
    """Greedy chunks (text, section, tokens, type) of blocks (text, section, type).

    Each part costs two more. A chunk ends where the next part would make it larger than ``size``, and its last words begin the next
    one. Section and type are those of its last part; its tokens are estimated from its text. With ``sections`` a chunk also ends
    where the section does, without overlap; with that or ``bare`` headings are no text of their own.
    """
    out: list[tuple[str, str, int, str]] = []
    held: list[str] = []
    used, section, kind = 0, "?", "paragraph"

    def flush(keep: int) -> None:
        nonlocal used
        text = "\n".join(held).strip()
        rest = tail(text, keep)
        held[:] = [rest] if rest else []
        used = tokens_of(rest) + 2 if rest else 0
        if text:
            out.append((text, section, tokens_of(text), kind))

    for part in parts:
        text, where, own = part[0].strip(), part[1], part[2] if len(part) > 2 else "paragraph"
        if not text:
            continue
        heading = own == "section_header" and (sections or bare)
        if sections and held and (heading or where != section):
            flush(0)
        if heading:
            section, kind = where, own
            continue
        for piece in pieces(text, max(32, int(0.9 * size))):
            cost = tokens_of(piece)
            if held and used + cost > size:
                flush(overlap)
            held.append(piece)
            used, section, kind = used + cost + 2, where, own
    flush(0)
    return out


def with_context(text: str, title: str, section: str, limit: int = 180) -> str:
    """A chunk's text behind the title of its document and its section, which take up to ``limit`` characters (40 at least)."""
    head = " | ".join([f"Documento: {title.strip()}"] * bool(title.strip()) + [f"Seccion: {section.strip()}"] * (section.strip() not in ("", "?", ROOT)))
    limit = max(40, limit)
    head = head if len(head) <= limit else head[:limit].rstrip(" |")
    return f"{head}\nContenido: {text}" if head else text


def chunks(
    docs: DataFrame, doc: str, text: str, size: int = 384, overlap: int = 64, title: str | None = None, sections: bool = False, context: bool = False, limit: int = 180
) -> DataFrame:
    """D1, D5-D7 for every document: ``doc, chunk_index, chunk_text, section_path, tokens_count, content_type``.

    ``sections`` keeps chunks within sections; ``context`` puts the document's title (column ``title``) and the section before the text.
    A null text has no chunks, a null title is none.
    """
    id_type = docs.schema[doc].dataType.simpleString()
    rows = docs.select(F.col(doc), F.col(text).alias("__text"), (F.col(title) if title else F.lit("")).cast("string").alias("__title"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for d, t, name in zip(frame[doc], frame["__text"], frame["__title"]):
                parts = [(body, where, kind) for kind, body, where in markdown_blocks(t or "")]
                for i, (body, where, n, kind) in enumerate(pack(parts, size, overlap, sections, context)):
                    whole = with_context(body, name or "", where, limit) if context else body
                    out.append((d, i, whole, where, tokens_of(whole) if context else n, kind))
            yield pd.DataFrame(out, columns=[doc, "chunk_index", "chunk_text", "section_path", "tokens_count", "content_type"])

    return rows.mapInPandas(run, f"{doc} {id_type}, chunk_index int, chunk_text string, section_path string, tokens_count int, content_type string")


def decorate(text: Column, title: Column, section: Column, limit: int = 180) -> Column:
    """The text behind its title and section, which take up to ``limit`` characters."""
    head = F.rtrim(F.left(F.concat_ws(" | ", title, section), F.lit(limit)))
    return F.concat_ws("\n", head, text)


#: Names of content types and what they stand for.
CONTENT_TYPES = {
    "header": "section_header",
    "heading": "section_header",
    "title": "section_header",
    "section_header": "section_header",
    "table": "table",
    "list": "list",
    "bullet": "list",
    "paragraph": "paragraph",
    "text": "paragraph",
    "code": "code_block",
    "code_block": "code_block",
    "checklist": "checklist",
}


def content_type(name: Column) -> Column:
    """The type that a name stands for, else paragraph."""
    table = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(name))), F.lit("paragraph"))


def first_copies(docs: DataFrame, text: str, order: list[Column]) -> DataFrame:
    """The first row of each text by ``order``; hashes, not texts, are shuffled with the order's columns."""
    nth = F.row_number().over(Window.partitionBy("__hash").orderBy(*order))
    return docs.withColumn("__hash", F.sha2(text, 256)).withColumn("__nth", nth).where("__nth = 1").drop("__nth", "__hash")


def quality_gate(chunked: DataFrame, doc: str, chars: Column) -> DataFrame:
    """``doc, n_chunks, total_chars, reasons``: too few chunks, too few characters in all or on average."""
    found = chunked.groupBy(doc).agg(F.count("*").alias("n_chunks"), F.sum(chars).alias("total_chars"), F.avg(chars).alias("mean"))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("n_chunks") < 1, "min_chunks"),
            F.when(F.col("total_chars") < 180, "min_total_chars"),
            F.when(F.col("mean") < 48, "min_avg_chunk_chars"),
        )
    )
    return found.select(doc, "n_chunks", "total_chars", reasons.alias("reasons"))


#: Specialties by parts of a path, in this order, then by parts of a file's name.
PATH_SPECIALTIES = {
    "docs/40_": "pneumology", "docs/41_": "pediatrics_neonatology", "docs/42_": "critical_ops", "docs/43_": "critical_ops", "docs/44_": "pneumology",
    "docs/45_": "medicolegal", "docs/46_": "medicolegal", "docs/47_": "sepsis", "docs/48_": "critical_ops", "docs/49_": "scasest", "docs/50_": "scasest",
    "docs/51_": "scasest", "docs/52_": "scasest", "docs/53_": "critical_ops", "docs/54_": "critical_ops", "docs/55_": "critical_ops",
    "docs/56_": "critical_ops", "docs/57_": "scasest", "docs/58_": "resuscitation", "docs/59_": "resuscitation", "docs/60_": "resuscitation",
    "docs/61_": "resuscitation",
}
NAME_SPECIALTIES = (
    ("sepsis", "sepsis"), ("scasest", "scasest"), ("coronari", "scasest"), ("troponina", "scasest"), ("reanimacion", "resuscitation"),
    ("soporte_vital", "resuscitation"), ("medico_legal", "medicolegal"), ("bioetica", "medicolegal"), ("neurolog", "neurology"),
    ("gastro", "gastro_hepato"), ("hepato", "gastro_hepato"), ("reuma", "rheum_immuno"), ("inmuno", "immunology"), ("psiquiatr", "psychiatry"),
    ("hematolog", "hematology"), ("endocrin", "endocrinology"), ("nefrolog", "nephrology"), ("neumolog", "pneumology"), ("geriatr", "geriatrics"),
    ("oncolog", "oncology"), ("anestesi", "anesthesiology"), ("paliativ", "palliative"), ("urolog", "urology"), ("oftalmolog", "ophthalmology"),
    ("genetic", "genetic_recurrence"), ("genet", "genetic_recurrence"), ("ginecolog", "gynecology_obstetrics"), ("obstetric", "gynecology_obstetrics"),
    ("pediatri", "pediatrics_neonatology"), ("neonat", "pediatrics_neonatology"),
)


def infer(column: Column, rules: list[tuple[str, str]]) -> Column:
    """The label of the first rule whose text the column holds, else null."""
    out = F.lit(None).cast("string")
    for text, label in reversed(rules):
        out = F.when(F.contains(F.lower(column), F.lit(text)), label).otherwise(out)
    return out


def specialty(path: Column) -> Column:
    """By the path, else by the file's name."""
    place = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    name = F.regexp_replace(F.element_at(F.split(place, "/"), -1), "[^a-z0-9_.-]", "")
    return F.coalesce(infer(place, list(PATH_SPECIALTIES.items())), infer(name, list(NAME_SPECIALTIES)))


#: Keywords, words that are no topic, and what a question is asked for.
KEYWORDS = (
    "sepsis", "lactato", "qsofa", "scasest", "troponina", "grace", "ecg", "rcp", "acls", "shock", "reanimacion", "hipotermia", "ictus", "hsa",
    "aspects", "trauma", "abcde", "consentimiento", "bioetica", "anticoagulacion", "antiagregantes", "heparina", "warfarina", "fibrinolisis",
    "intervension", "cateterismos", "paro cardiaco", "asistolia", "fibrilacion", "torsades", "bradicardia", "taquicardia", "arritmia", "sop",
    "sinusitis", "neumonía", "embolia", "hemotorax", "neumotorax", "tension", "taponamiento", "tamponade", "quilotorax", "efusion", "hematoma",
    "edema", "gangrena", "necrosis", "apoptosis",
)
QUESTION_STOP = (
    "para", "como", "desde", "hasta", "entre", "sobre", "donde", "cuando", "porque", "ademas", "segun", "tras", "ante", "con", "sin", "del", "las",
    "los", "una", "uno", "unos", "unas", "este", "esta", "estos", "estas", "que",
)
QUESTION_RULES = (
    (("criterio",), "¿Que criterios de decision se describen en {}?"),
    (("algoritmo", "protocolo"), "¿Que algoritmo o protocolo se recomienda para {}?"),
    (("tratamiento", "manejo"), "¿Que tratamiento o manejo se propone en {}?"),
    (("riesgo", "alerta", "red flag"), "¿Que alertas o factores de riesgo aparecen en {}?"),
    (("diagnostico",), "¿Que enfoque diagnostico se indica en {}?"),
)


def keywords(text: Column, lexicon: tuple[str, ...] = KEYWORDS) -> Column:
    """The lexicon's words that the text holds and comparisons such as GRACE > 140, sorted."""
    hits = F.filter(F.array(*map(F.lit, lexicon)), lambda w: F.contains(F.lower(text), w))
    comparisons = F.regexp_extract_all(text, F.lit(r"\b[A-Z]+\s*(?:[><]=?|=)\s*\d+\b"), F.lit(0))
    return F.array_sort(F.array_distinct(F.concat(hits, comparisons)))


def questions(text: Column, section: Column, most: int = 6) -> Column:
    """D3: two fixed questions on the section's last part, those whose words the text holds, and two on its keywords and first long words."""
    low = F.lower(text)
    topic = F.trim(F.element_at(F.split(F.coalesce(section, F.lit("")), ">"), -1))
    topic = F.left(F.when(topic == "", "este protocolo").otherwise(F.regexp_replace(topic, r"\s+", " ")), F.lit(96))

    def about(template: str, what: Column) -> Column:
        before, _, after = template.partition("{}")
        return F.concat(F.lit(before), what, F.lit(after))

    def holds(words: tuple[str, ...]) -> Column:
        out = F.contains(low, F.lit(words[0]))
        for w in words[1:]:
            out = out | F.contains(low, F.lit(w))
        return out

    words = F.filter(F.regexp_extract_all(low, F.lit(r"[a-zA-Z0-9\-]+"), F.lit(0)), lambda w: (F.length(w) >= 5) & ~w.isin(*QUESTION_STOP))
    first = lambda found: F.array_join(F.slice(found, 1, 2), ", ")
    known, own = keywords(text), F.array_distinct(words)
    asked = [about("¿Cual es el manejo operativo de {}?", topic), about("¿Cuales son los pasos iniciales para {}?", topic)]
    asked += [F.when(holds(w), about(q, topic)) for w, q in QUESTION_RULES]
    asked.append(F.when(F.size(known) > 0, about("¿Que recomendaciones practicas se dan para {}?", first(known))))
    asked.append(F.when(F.size(own) > 0, about("¿Como se integran {} dentro del plan operativo?", first(own))))
    return F.slice(F.array_distinct(F.array_compact(F.array(*asked))), 1, most)


def reading_order(rows: DataFrame, page: str, x0: str, y0: str, nth: str) -> DataFrame:
    """By page, then top, left and given order; a block without a box comes last."""
    far = F.lit(1e9)
    return rows.orderBy(page, F.coalesce(F.col(y0), far), F.coalesce(F.col(x0), far), nth)


def without_repeated_edges(rows: DataFrame, doc: str, page: str, order: str, text: str, least: int = 2, longest: int = 120) -> DataFrame:
    """Blocks without those at a page's edge whose short text stands at the edges of several pages."""
    w = Window.partitionBy(doc, page).orderBy(order)
    back = Window.partitionBy(doc, page).orderBy(F.desc(order))
    edged = rows.withColumn("__edge", (F.row_number().over(w) == 1) | (F.row_number().over(back) == 1))
    often = edged.where("__edge").where(F.length(text) <= longest).groupBy(doc, text).agg(F.count_distinct(page).alias("n")).where(F.col("n") >= least)
    marked = edged.join(often.select(doc, text, F.lit(True).alias("__often")), [doc, text], "left")
    return marked.where(~(F.col("__edge") & F.coalesce("__often", F.lit(False)))).select(*rows.columns)


def sentences(text: Column, least: int = 35, most: int = 5) -> Column:
    """Sentences of at least ``least`` characters, the first ``most``."""
    found = F.filter(F.transform(F.split(text, r"(?<=[.!?;])\s+"), lambda s: F.trim(s)), lambda s: F.length(s) >= least)
    return F.slice(found, 1, most) if most else found


#: Fixed value: where clauses are parted.
CLAUSE_END = r"(?i)[,;]\s+|\s+(?:y|pero|aunque|si|cuando|mientras|porque|debido\s+a|por\s+lo\s+que)\s+"


def discourse_units(text: Column, least: int = 18, most: int = 14) -> Column:
    """Clauses of sentences, the first ``most`` that are not too short."""
    parts = F.flatten(F.transform(F.split(text, r"(?<=[.!?;:])\s+|\n+"), lambda s: F.split(s, CLAUSE_END)))
    return F.slice(F.filter(F.transform(parts, lambda p: F.trim(p)), lambda p: F.length(p) >= least), 1, most)


def kwic(tokens: Column, asked: Column, around: int = 14) -> Column:
    """The tokens about the first one that is asked for; the first tokens where there is none."""
    at = F.array_position(F.transform(tokens, lambda w: F.array_contains(asked, w)), True).cast("int")
    begin = F.greatest(F.lit(1), at - around)
    end = F.when(at > 0, at + around).otherwise(2 * around)
    return F.array_join(F.slice(tokens, F.when(at > 0, begin).otherwise(1), end - F.when(at > 0, begin).otherwise(1) + 1), " ")


#: What an untrusted text may hold, what it signals and what is put in its place.
UNTRUSTED = [
    ("role_tag", r"(?i)</?(?:system|assistant|user)>", ""),
    ("code_fence", r"```", "'''"),
    ("marker", r"(?i)<<<\s*end[^>]*>>>", ""),
    ("override", r"(?i)ignore (?:all )?previous instructions", "[removed]"),
]


def sanitise(text: Column) -> tuple[Column, Column]:
    """The text without role tags, fences and markers, and the signals that it gave."""
    clean = text
    for _, pattern, instead in UNTRUSTED:
        clean = F.regexp_replace(clean, pattern, instead)
    signals = F.array_compact(F.array(*(F.when(F.rlike(text, F.lit(p)), n) for n, p, _ in UNTRUSTED)))
    return clean, signals


def facts(text: Column, terms: list[str], most: int = 16) -> Column:
    """Numbers with units, comparisons and known terms, each once in this order."""
    units = F.regexp_extract_all(F.lower(text), F.lit(r"\d+(?:[.,]\d+)?\s?(?:mg|ml|mmhg|%|kg|h|min)"), F.lit(0))
    compared = F.regexp_extract_all(F.lower(text), F.lit(r"(?:<=|>=|<|>)\s?\d+(?:[.,]\d+)?"), F.lit(0))
    known = F.filter(F.array(*map(F.lit, terms)), lambda w: F.contains(F.lower(text), w))
    return F.slice(F.array_distinct(F.concat(units, compared, known)), 1, most)
