"""Lines and sources that say nothing of a subject, and snippets without them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import bind

#: What marks a line as noise, and how many letters it needs.
NOISE = (
    ".py", "python.exe", "pytest", "uvicorn", "curl ", "/api/v1/", "http://", "https://", "select ", "insert ", "git ", "npm ", "pip ", "endpoint", "workflow", "agent_run",
    "tool_mode", "py_compile", "venv\\", "venv/", "app/", "app\\", "{", "}", "`", "motor operativo", "sistema no tenia", "sistema no tenía", "logica operativa cubierta",
    "lógica operativa cubierta", "validacion -", "validación -", "documento >", "documento:", "seccion:", "sección:", "contenido:",
)
LETTERS = 18
#: What marks sources that are no subject's, and the numbers that the documents of subjects have.
SOURCE_MARKS = (
    "docs/decisions/", "chat_clinico", "frontend_chat", "adaptacion_blueprint", "project_skills", "mcp_", "prometheus", "grafana", "roadmap", "codex_cli", "agent_system",
)
FIRST_NUMBER, LAST_NUMBER = 40, 86
#: Lines that decide whether a chunk is noise.
HEAD = 8

LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]"
DOCS_PATH = r"(?i)\bdocs[\\/][^\s)]+"
FILE_PATH = r"(?i)(?:[A-Za-z]:)?[\\/](?:[^\\/\s]+[\\/])+[^\\/\s]+(?:\.(?:md|txt|pdf))?"


def noisy_line(line: Column) -> Column:
    """Blank, with a mark of noise, or with fewer than 18 letters."""

    def told(low: Column) -> Column:
        marked = F.lit(False)
        for mark in NOISE:
            marked = marked | F.contains(low, F.lit(mark))
        return marked | (F.length(F.regexp_replace(low, r"[^\p{L}]", "")) < LETTERS)

    return bind(F.lower(F.trim(line)), told)


def noisy_source(source: Column, marks: tuple[str, ...] = SOURCE_MARKS) -> Column:
    """A source in a folder of ``marks``, or among numbered documents outside the subjects' numbers; none is no noise."""
    low = F.trim(F.lower(F.translate(F.coalesce(source, F.lit("")), "\\", "/")))
    number = F.regexp_extract(low, r"docs/(\d+)_", 1)
    marked = F.lit(False)
    for mark in marks:
        marked = marked | F.contains(low, F.lit(mark))
    outside = (number != "") & ~F.coalesce(number.try_cast("long"), F.lit(0)).between(FIRST_NUMBER, LAST_NUMBER)
    return marked | outside


def lines_of(text: Column) -> Column:
    """The lines of a text that are not blank."""
    return F.filter(F.split(text, LINE_END, -1), lambda x: F.trim(x) != "")


def drop_noisy(chunks: DataFrame, group: str, text: str, source: str | None = None, marks: tuple[str, ...] = SOURCE_MARKS) -> DataFrame:
    """``chunks`` of each ``group`` without those whose first eight lines are all noise or whose source is; with ``fell_back``.

    Where all chunks of a group would go, all stay and ``fell_back`` is true. A null text is blank, and so noise.
    """
    lines = lines_of(F.coalesce(F.col(text), F.lit("")))
    noise = F.forall(F.slice(lines, 1, HEAD), noisy_line)
    if source is not None:
        noise = noise | noisy_source(F.col(source), marks)
    marked = chunks.withColumn("__noise", noise)
    kept = F.count_if(~F.col("__noise")).over(Window.partitionBy(group))
    return marked.withColumn("fell_back", kept == 0).where("NOT __noise OR fell_back").drop("__noise")


def clean_snippet(text: Column, most: int) -> Column:
    """A text's lines that are no noise, with single spaces, without paths of files, cut at ``most`` characters.

    Lines are taken up until they have ``most`` characters together; if all are noise, the whole text is.
    """
    compact = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    good = F.transform(F.filter(lines_of(text), lambda x: ~noisy_line(x)), compact)

    def take(held: Column, line: Column) -> Column:
        more = F.struct(F.concat(held["lines"], F.array(line)).alias("lines"), (held["n"] + F.length(line)).alias("n"))
        return F.when(held["n"] < most, more).otherwise(held)

    def joined(lines: Column) -> Column:
        none = F.struct(F.array().cast("array<string>").alias("lines"), F.lit(0).alias("n"))
        return F.when(F.size(lines) == 0, compact(text)).otherwise(F.array_join(F.aggregate(lines, none, take)["lines"], " "))

    bare = F.regexp_replace(F.regexp_replace(bind(good, joined), DOCS_PATH, ""), FILE_PATH, "")
    return F.left(F.trim(F.regexp_replace(bare, r"\s{2,}", " ")), F.lit(most))
