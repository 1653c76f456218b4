"""Queries of Markdown structure over texts whose parts a customer's orders pick; the SQL lays out what each part holds, written down by hand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import tables
from millrace.plans.registry import query
from millrace.sources.tables import table

#: Each part, its blocks as ``(idx, kind, l0, l1, parent, level, info, closed, list, text)`` and its spans as ``(block, cell, kind, l0, c0, l1, c1, o_l0, o_c0, o_l1, o_c1, text, label)``.
PARTS: list[tuple[str, list[tuple], list[tuple]]] = [
    (
        "- item\n\n  ```bash\n  make `build`\n  ```\n- next",
        [(0, "item", 1, 5, None, None, None, None, 0, "item"), (1, "fence", 3, 5, 0, None, "bash", True, None, "make `build`"), (2, "item", 6, 6, None, None, None, None, 0, "next")],
        [],
    ),
    ("Run `make\nbuild` now.", [(0, "para", 1, 2, None, None, None, None, None, "Run `make\nbuild` now.")], [(0, None, "code", 1, 5, 2, 5, 1, 4, 2, 6, "make build", None)]),
    (
        "See [the guide][g] and [Docs],\n[text][nowhere].\n\n[g]: docs/guide.md \"Guide\"\n[docs]:\n  <docs/index.md>",
        [
            (0, "para", 1, 2, None, None, None, None, None, "See [the guide][g] and [Docs],\n[text][nowhere]."),
            (1, "refdef", 4, 4, None, None, None, None, None, '[g]: docs/guide.md "Guide"'),
            (2, "refdef", 5, 6, None, None, None, None, None, "[docs]:\n<docs/index.md>"),
        ],
        [
            (0, None, "reflink", 1, 16, 1, 17, 1, 4, 1, 18, "docs/guide.md", "the guide"), (0, None, "reflink", 1, 24, 1, 28, 1, 23, 1, 29, "docs/index.md", "Docs"),
            (1, None, "refdef", 4, 5, 4, 18, 4, 0, 4, 26, "docs/guide.md", "g"), (2, None, "refdef", 6, 3, 6, 16, 5, 0, 6, 17, "docs/index.md", "docs"),
        ],
    ),
    (
        "> quoted `q.py`\n> - a\n>   `b\nlazy` c\n> > deep [d](e.md)\n\nout",
        [
            (0, "quote", 1, 5, None, None, None, None, None, ""), (1, "para", 1, 1, 0, None, None, None, None, "quoted `q.py`"), (2, "item", 2, 4, 0, None, None, None, 2, "a\n`b\nlazy` c"),
            (3, "quote", 5, 5, 0, None, None, None, None, ""), (4, "para", 5, 5, 3, None, None, None, None, "deep [d](e.md)"), (5, "para", 7, 7, None, None, None, None, None, "out"),
        ],
        [(1, None, "code", 1, 10, 1, 14, 1, 9, 1, 15, "q.py", None), (2, None, "code", 3, 5, 4, 4, 3, 4, 4, 5, "b lazy", None), (4, None, "link", 5, 13, 5, 17, 5, 9, 5, 18, "e.md", "d")],
    ),
    (
        "| Flag | Meaning |\n| --- | :-: |\n| `a\\|b` | [x](y.md) |",
        [(0, "table_row", 1, 1, None, None, None, None, None, "| Flag | Meaning |"), (1, "table_delim", 2, 2, None, None, None, None, None, "| --- | :-: |"), (2, "table_row", 3, 3, None, None, None, None, None, "| `a\\|b` | [x](y.md) |")],
        [(2, 0, "code", 3, 3, 3, 7, 3, 2, 3, 8, "a|b", None), (2, 1, "link", 3, 15, 3, 19, 3, 11, 3, 20, "y.md", "x")],
    ),
    (
        "<!-- keep: this\n  `x` -->\nText `` a`b `` <!-- m --> and ![l `z`](i.png).",
        [(0, "html", 1, 2, None, None, None, None, None, "<!-- keep: this\n  `x` -->"), (1, "para", 3, 3, None, None, None, None, None, "Text `` a`b `` <!-- m --> and ![l `z`](i.png).")],
        [
            (0, None, "comment", 1, 4, 2, 6, 1, 0, 2, 9, "keep: this\n  `x`", None), (1, None, "code", 3, 8, 3, 11, 3, 5, 3, 14, "a`b", None), (1, None, "comment", 3, 19, 3, 22, 3, 15, 3, 25, "m", None),
            (1, None, "image", 3, 39, 3, 44, 3, 30, 3, 45, "i.png", "l `z`"), (1, None, "code", 3, 35, 3, 36, 3, 34, 3, 37, "z", None),
        ],
    ),
    (
        "1. one\n\n   two <https://x.io/a>\n   - three\n2. four\n* five\n\n      six `s`",
        [
            (0, "item", 1, 4, None, None, None, None, 0, "one"), (1, "para", 3, 3, 0, None, None, None, None, "two <https://x.io/a>"), (2, "item", 4, 4, 0, None, None, None, 2, "three"),
            (3, "item", 5, 5, None, None, None, None, 0, "four"), (4, "item", 6, 8, None, None, None, None, 4, "five"), (5, "code", 8, 8, 4, None, None, None, None, "six `s`"),
        ],
        [(1, None, "autolink", 3, 8, 3, 22, 3, 7, 3, 23, "https://x.io/a", None)],
    ),
    (
        "Title `t`\n=====\n***\n~~~ py\nopen `o`\n\n    still\n~~~\n    plain `p`",
        [(0, "heading", 1, 2, None, 1, None, None, None, "Title `t`"), (1, "fence", 4, 8, None, None, "py", True, None, "open `o`\n\n    still"), (2, "code", 9, 9, None, None, None, None, None, "plain `p`")],
        [(0, None, "code", 1, 7, 1, 8, 1, 6, 1, 9, "t", None)],
    ),
]

#: A part begins with a heading and a blank line and ends with one, so that parts do not run together.
_BEFORE, _AFTER = "# Part\n\n", "\n\n"


def values(rows: list[tuple], names: str) -> str:
    say = lambda v: "NULL" if v is None else str(v) if isinstance(v, bool | int) else "'" + v.replace("'", "''") + "'"
    return f"(VALUES {', '.join('(' + ', '.join(map(say, r)) + ')' for r in rows)}) v({names})"


_SIZES = values([(k, body.count("\n") + 4, len(blocks) + 1) for k, (body, blocks, _) in enumerate(PARTS)], "part, n_lines, n_blocks")
_BLOCKS = values([(k, *b) for k, (_, blocks, _) in enumerate(PARTS) for b in blocks], "part, idx, kind, l0, l1, parent, level, info, closed, list_id, body")
_SPANS = values([(k, *s) for k, (_, _, spans) in enumerate(PARTS) for s in spans], "part, block, cell, kind, l0, c0, l1, c1, o_l0, o_c0, o_l1, o_c1, body, label")
_LAID = f"""
WITH o AS (SELECT o_custkey AS doc, o_orderkey, CAST(o_orderkey // 4 % {len(PARTS)} AS INTEGER) AS part FROM orders), z AS (SELECT * FROM {_SIZES}),
a AS (SELECT doc, part, CAST(coalesce(sum(n_lines) OVER w, 0) AS INTEGER) AS line, CAST(coalesce(sum(n_blocks) OVER w, 0) AS INTEGER) AS b FROM o JOIN z USING (part) WINDOW w AS (PARTITION BY doc ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = F.array(*[F.lit(_BEFORE + body + _AFTER) for body, _, _ in PARTS])
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("doc"), "o_orderkey", F.get(parts, F.expr(f"int(o_orderkey div 4 % {len(PARTS)})")).alias("body"))
    gathered = o.groupBy("doc").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "body"))).alias("x"))
    return gathered.select("doc", F.array_join(F.transform("x", lambda v: v["body"]), "").alias("text"))


@query(f"""{_LAID}
SELECT doc, b AS idx, 'heading' AS kind, line + 1 AS l0, line + 1 AS l1, NULL::INTEGER AS parent, 1 AS level, NULL AS info, NULL::BOOLEAN AS closed, NULL::INTEGER AS list_id, 'Part' AS text FROM a
UNION ALL SELECT doc, b + 1 + idx, kind, line + 2 + l0, line + 2 + l1, b + 1 + parent, level, info, closed, b + 1 + list_id, body FROM a JOIN {_BLOCKS} ON v.part = a.part""")
def markdown_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks in lists, quotes, fences and tables with their containers, lists and lines (SRC18)."""
    return tables.apply(_docs(spark, sf_dir), "md_structure", "text", ["doc"])


@query(f"""{_LAID}
SELECT doc, b + 1 + block AS block, cell, kind, line + 2 + l0 AS l0, c0, line + 2 + l1 AS l1, c1, line + 2 + o_l0 AS o_l0, o_c0, line + 2 + o_l1 AS o_l1, o_c1, body AS text, label FROM a JOIN {_SPANS} ON v.part = a.part
""")
def markdown_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code, links, references, images, bare links and comments with lines and columns, over line ends and in cells (SRC18, SRC33, WIN22)."""
    return tables.apply(_docs(spark, sf_dir), "md_spans", "text", ["doc"])
