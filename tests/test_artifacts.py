"""Sections of Markdown against a plain parser."""

import random
import re

from pyspark.sql import functions as F

from wardlight.sources import artifacts as ar


def plain(text):
    """(section_no, level, title, headings, first_line, n_lines, text), line by line with a stack."""
    lines = text.split("\n")
    out, stack, fenced = [[0, 0, None, [], 0]], [], False
    for i, line in enumerate(lines):
        if re.match(r"[ \t]{0,3}(```|~~~)", line):
            fenced = not fenced
        elif not fenced and (m := re.match(r"(#{1,6})[ \t]+(.*?)[ \t]*#*[ \t]*$", line)):
            while stack and stack[-1][0] >= len(m[1]):
                stack.pop()
            stack.append((len(m[1]), m[2]))
            out.append([len(out), len(m[1]), m[2], [t for _, t in stack], i])
    rows = []
    for s, after in zip(out, [*out[1:], None], strict=True):
        own = lines[s[4] : after[4] if after else len(lines)]
        if s[0] or "\n".join(own).strip(" \t\n"):
            rows.append((*s, len(own), "\n".join(own)))
    return rows


def made(r):
    parts = ["text", "", "  ", "# A", "## B b ##", "### C", "###### F", "####### not", "#not", "```", "~~~py", "    ```", "é # x", "## ", "##\tT", "# A", "1. list"]
    return "\n".join(r.choice(parts) for _ in range(r.randrange(25)))


def got(rows):
    return sorted((r["path"], r["section_no"], r["level"], r["title"], r["headings"], r["first_line"], r["n_lines"], r["text"]) for r in rows.collect())


def test_sections(spark):
    r = random.Random(1)
    texts = [made(r) for _ in range(300)] + ["", "\n\n", "# only", "```\n# in\n", "x" * 200_000, "# h\n" * 3000]
    docs = spark.createDataFrame([(f"{i:04}", t, 1) for i, t in enumerate(texts)] + [("null", None, 1), (None, "# x", 1)], "path string, text string, level int")
    want = sorted((f"{i:04}", *row) for i, t in enumerate(texts) for row in plain(t))
    assert got(ar.sections(docs)) == want
    assert ar.sections(docs.limit(0)).collect() == []


def test_files_and_chunks(spark, tmp_path):
    (tmp_path / "a b").mkdir()
    (tmp_path / "a b" / "one.md").write_bytes(b"intro\r\n# A\r\n0123456789\r\n## B\r\nx")
    (tmp_path / "two.txt").write_text("# no")
    files = ar.artifacts(spark, str(tmp_path))
    parts = ar.sections(files)
    assert [(r["level"], r["headings"], r["text"]) for r in parts.orderBy("section_no").collect()] == [(0, [], "intro"), (1, ["A"], "# A\n0123456789"), (2, ["A", "B"], "## B\nx")]
    chunks = ar.section_chunks(parts, 6).orderBy("section_no", "chunk_no").collect()
    assert [r["chunk"] for r in chunks] == ["intro", "# A\n01", "234567", "89", "## B\nx"]
    joined = ar.section_chunks(parts, 6).groupBy("section_no").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_no", "chunk"))), lambda x: x["chunk"]), "").alias("t"))
    assert {r["section_no"]: r["t"] for r in joined.collect()} == {r["section_no"]: r["text"] for r in parts.collect()}
