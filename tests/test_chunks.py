"""Blocks and chunks, rule by rule."""

import pytest
from pyspark.sql import functions as F

from sparkloom.operators import ingest as I


def kinds(text):
    return [(k, b) for k, b, _ in I.markdown_blocks(text)]


def test_headings_are_whole_lines_at_the_beginning():
    assert I.markdown_blocks("## Title ##  \ntext") == [("section_header", "## Title ##  ", "Documento > Title ##  "), ("paragraph", "text", "Documento > Title ##  ")]
    assert kinds("  # x") == [("paragraph", "  # x")]
    assert kinds("#x\n####### y") == [("paragraph", "#x\n####### y")]
    paths = [p for _, _, p in I.markdown_blocks("# A\n### B\n## C\n# D")]
    assert paths == ["Documento > A", "Documento > A > B", "Documento > A > C", "Documento > D"]


def test_lists_tables_and_fences():
    assert kinds("- a\n    more\n\tmore\n- b\nend") == [("list", "- a\n    more\n\tmore\n- b"), ("paragraph", "end")]
    assert kinds("+ [x] a\n* [-] b\n- c") == [("checklist", "+ [x] a\n* [-] b"), ("list", "- c")]
    assert kinds("- a\n- [x] b") == [("list", "- a\n- [x] b")]
    assert kinds("- [ ] open") == [("list", "- [ ] open")]
    assert kinds("1. one\n2. two") == [("paragraph", "1. one\n2. two")]
    assert kinds("| a |\n| b\n| c |") == [("table", "| a |"), ("paragraph", "| b"), ("table", "| c |")]
    assert kinds("p\n| a |") == [("paragraph", "p"), ("table", "| a |")]
    assert kinds("p\n- a") == [("paragraph", "p"), ("list", "- a")]
    assert kinds("a\n```py\n# no heading\n\n```\nb") == [("paragraph", "a"), ("code_block", "```py\n# no heading\n\n```"), ("paragraph", "b")]
    assert kinds("```\nopen to the end\n") == [("code_block", "```\nopen to the end\n")]
    assert kinds("a\n \n\nb") == [("paragraph", "a"), ("paragraph", "b")] and kinds("") == []


def test_oversize_blocks_fall_into_lines_sentences_and_words():
    assert I.pieces("short\ntext", 32) == ["short\ntext"]
    lines = "\n".join(["a" * 60, "b" * 60, "c" * 60])  # 15 tokens each
    assert I.pieces(lines, 32) == ["a" * 60 + " " + "b" * 60, "c" * 60]  # lines are glued by spaces
    sentences = f"{'a' * 60}: {'b' * 60}; {'c' * 60}. d"
    assert I.pieces(sentences, 32) == [f"{'a' * 60}: {'b' * 60};", f"{'c' * 60}. d"]
    long = "word. " * 40  # a line of 60 tokens beside a short one goes to its words, not to its sentences
    got = I.pieces("first line\n" + long, 32)
    assert got[0] == "first line" and got[1:] == [" ".join(["word."] * 32), " ".join(["word."] * 8)]
    assert I.pieces("x" * 1000, 32) == ["x" * 1000]


def test_overlap_keeps_one_word_at_least():
    assert I.tail("x" * 1000, 64) == "x" * 1000
    assert I.tail("one two three", 2) == "two three" and I.tail("one two", 0) == "" and I.tail("", 5) == ""


def test_chunks_by_hand():
    a, b, c = "a" * 100, "b" * 100, "c " * 10 + "d" * 60
    got = I.pack([(a, "S1", "paragraph"), (b, "S2", "list"), (c, "S3", "table")], size=55, overlap=16)
    # a and b make 25 + 2 + 25 = 52; c would make 54 + 20 > 55
    assert got == [(f"{a}\n{b}", "S2", 50, "list"), (f"{b}\n{c.strip()}", "S3", 45, "table")]
    assert I.pack([("x", "S", "list")]) == [("x", "S", 1, "list")] and I.pack([]) == [] and I.pack([("  ", "S", "list")]) == []
    assert I.pack([("word " * 400, "S", "paragraph")], size=64, overlap=0)[0][0].count("word") == 57


def test_section_boundaries_and_context():
    text = "# A\nfirst\n## B\nsecond\nmore\n\nthird"
    parts = [(b, p, k) for k, b, p in I.markdown_blocks(text)]
    assert [c[:2] for c in I.pack(parts, sections=True)] == [("first", "Documento > A"), ("second\nmore\nthird", "Documento > A > B")]
    assert [c[0] for c in I.pack(parts, bare=True)] == ["first\nsecond\nmore\nthird"]
    assert [c[0] for c in I.pack(parts)] == ["# A\nfirst\n## B\nsecond\nmore\nthird"]
    assert I.with_context("x", "T", "Documento > A") == "Documento: T | Seccion: Documento > A\nContenido: x"
    assert I.with_context("x", " ", "?") == "x" and I.with_context("x", "T", "Documento") == "Documento: T\nContenido: x"
    head = I.with_context("x", "t" * 50, "s" * 50, limit=64).split("\n")[0]
    assert head == f"Documento: {'t' * 50}" and I.with_context("x", "t" * 99, "", limit=1).split("\n")[0] == "Documento: " + "t" * 29


@pytest.mark.parametrize("options", [{}, {"sections": True, "context": True, "title": "name"}])
def test_chunks_of_a_table(spark, options):
    rows = [(1, "# A\n" + "some words here. " * 200, "T", 0), (2, None, "T", 1), (3, "", None, 2), (4, "only", None, 3), (4, "only", None, 3)]
    docs = spark.createDataFrame(rows, "doc long, text string, name string, chunk_index int")
    got = I.chunks(docs, "doc", "text", size=100, overlap=10, **options).orderBy("doc", "chunk_index").collect()
    assert {r["doc"] for r in got} == {1, 4} and [r["chunk_text"].endswith("only") for r in got if r["doc"] == 4] == [True, True]
    assert all(r["tokens_count"] == I.tokens_of(r["chunk_text"]) for r in got)
    if options:
        assert got[0]["chunk_text"].startswith("Documento: T | Seccion: Documento > A\nContenido: some")
    assert I.chunks(docs.limit(0), "doc", "text").select(F.col("doc")).collect() == []
