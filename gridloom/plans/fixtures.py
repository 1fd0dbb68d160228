"""Drawing tables derived from the star schema by whole-number arithmetic, as SQL that both engines run.

The test tables hold no drawings. These definitions make boxes, names, text lines, segments and logs from ``lineitem`` and ``orders``: pages grow with
the data, a page doesn't. They exercise the operators and say nothing of extraction quality.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

PAGE_W, PAGE_H = 1400, 900

#: Tables by name; {x} stands for the table or earlier fixture x.
FIXTURES = {
    "items": """
        SELECT CAST(floor(l_orderkey / 4.0) AS BIGINT) AS page,
               CAST(row_number() OVER (PARTITION BY CAST(floor(l_orderkey / 4.0) AS BIGINT)
                    ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_discount, l_tax) AS BIGINT) AS ord,
               CAST(l_partkey AS BIGINT) AS part, CAST(l_suppkey AS BIGINT) AS supp, CAST(l_linenumber AS BIGINT) AS line, CAST(l_quantity AS BIGINT) AS qty
        FROM {lineitem}""",
    "boxes": """
        SELECT page, ord, part, supp, x1, y1, x1 + w AS x2, y1 + h AS y2 FROM (
          SELECT page, ord, part, supp, (part * 7 + supp * 13) % 900 AS x1, (part * 11 + line * 97) % 600 AS y1, 40 + qty * 8 AS w, 30 + (supp * line) % 200 AS h
          FROM {items}) b""",
    "pages": f"SELECT DISTINCT page, CAST({PAGE_W} AS BIGINT) AS w, CAST({PAGE_H} AS BIGINT) AS h FROM {{items}}",
    "content": f"SELECT page, 40 + page % 7 AS x1, 30 + page % 5 AS y1, {PAGE_W} - 60 - page % 11 AS x2, {PAGE_H} - 50 - page % 3 AS y2 FROM {{pages}}",
    "older": "SELECT page, ord, x1, y1, x2, y2 FROM {boxes} WHERE ord % 3 = 0",
    "newer": "SELECT page, ord, x1, y1, x2, y2 FROM {boxes} WHERE ord % 3 <> 0",
    "labels_of": """
        SELECT page, ord, part, supp, line,
               concat(CASE supp % 5 WHEN 0 THEN 'E-HV-' WHEN 1 THEN 'HV-' WHEN 2 THEN 'MCC-' WHEN 3 THEN 'E-H-' ELSE 'LP-' END,
                      lpad(concat('', part % 30), 2, '0'), CASE WHEN part % 11 = 0 THEN 'B' ELSE '' END) AS name
        FROM {items}""",
    "names": "SELECT page, min(ord) AS ord, name FROM {labels_of} GROUP BY page, name",
    "lines": """
        SELECT page, ord, content, x1, y1, x1 + 60 + length(content) * 4 AS x2, y1 + 20 AS y2 FROM (
          SELECT page, ord,
                 CASE part % 9 WHEN 0 THEN name WHEN 1 THEN lower(name) WHEN 2 THEN replace(replace(name, '-0', '-'), '-', '')
                   WHEN 3 THEN concat('FROM ', name) WHEN 4 THEN concat(name, ' BUS') WHEN 5 THEN replace(name, '0', 'O')
                   WHEN 6 THEN replace(name, 'V', 'Y') WHEN 7 THEN concat('', part % 900, '/5A') ELSE concat('  NGR-', name, '  ') END AS content,
                 (part * 5 + supp * 3) % 1200 AS x1, (part * 3 + line * 25) % 800 AS y1
          FROM {labels_of}) t""",
    "segments": """
        SELECT page, ord, CASE WHEN part % 2 = 0 THEN 'h' ELSE 'v' END AS axis, (part * 7 + supp) % 880 AS pos, (supp * 31) % 500 AS s0,
               (supp * 31) % 500 + 5 + qty * 15 AS s1
        FROM {items}""",
    "attempts": """
        SELECT page AS panel, ord AS attempt, (part + line) % 5 AS wrong, (part * 7) % 90 AS x1, (part * 5) % 70 AS y1,
               200 + (supp * 11) % 100 AS x2, 150 + (part * 3) % 80 AS y2
        FROM {items}""",
    "step_log": """
        SELECT concat('run', page) AS run_id, part % 5 + 1 AS step, ord AS seq,
               CASE supp % 4 WHEN 0 THEN 'start' WHEN 1 THEN 'complete' WHEN 2 THEN 'fail' ELSE 'start' END AS kind,
               CASE WHEN supp % 4 = 2 THEN concat('code ', part % 7) END AS error, ord * 60 + part % 50 AS secs
        FROM {items}""",
    "runs": """
        SELECT concat('run', o_orderkey) AS run_id, concat('doc', o_custkey % 50) AS pdf_hash, o_orderdate AS created_at,
               CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'waiting_for_human' END AS status,
               o_custkey % 6 AS current_step, o_custkey % 2 = 0 AS regions_confirmed, o_custkey % 3 = 0 AS names_confirmed,
               o_custkey % 5 = 0 AS crops_confirmed, o_custkey % 7 = 0 AS bom_confirmed
        FROM {orders}""",
    "tiles": """
        SELECT page, tile, tile * 300 AS x1, CAST(0 AS BIGINT) AS y1, tile * 300 + 420 AS x2, CAST(900 AS BIGINT) AS y2
        FROM {pages} CROSS JOIN (SELECT CAST(0 AS BIGINT) AS tile UNION ALL SELECT 1 UNION ALL SELECT 2 UNION ALL SELECT 3) t""",
}


def _inlined(sql: str, table) -> str:
    """The SQL with every {x} replaced: fixtures by their own SQL, anything else by ``table(x)``."""
    for name, own in FIXTURES.items():
        if "{" + name + "}" in sql:
            sql = sql.replace("{" + name + "}", f"({_inlined(own, table)})")
    for name in ("lineitem", "orders", "part", "customer", "events"):
        if "{" + name + "}" in sql:
            sql = sql.replace("{" + name + "}", table(name))
    return sql


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.sql(_inlined(FIXTURES[name], lambda t: f"parquet.`{sf_dir}/{t}.parquet`"))


def oracle(sql: str) -> str:
    """An oracle's SQL with the fixtures it names as {x} put in front of it."""
    used: list[str] = []

    def visit(text: str) -> None:
        for name, own in FIXTURES.items():
            if "{" + name + "}" in text and name not in used:
                visit(own)
                used.append(name)

    visit(sql)
    plain = lambda text: _named(text)
    recursive = "RECURSIVE " if sql.lstrip().upper().startswith("WITH RECURSIVE") else ""
    body = sql.lstrip()
    ctes = ", ".join(f"f_{n} AS MATERIALIZED ({plain(FIXTURES[n])})" for n in used)
    if body.upper().startswith("WITH RECURSIVE"):
        body = ", " + body[len("WITH RECURSIVE") :]
    elif body.upper().startswith("WITH"):
        body = ", " + body[len("WITH") :]
    return f"WITH {recursive}{ctes} {plain(body)}"


def _named(text: str) -> str:
    for name in FIXTURES:
        text = text.replace("{" + name + "}", f"f_{name}")
    for name in ("lineitem", "orders", "part", "customer", "events"):
        text = text.replace("{" + name + "}", name)
    return text
