"""Shared views over the input tables.

Each definition is plain SQL that Spark and the checking engine both accept.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()

# Lines that a task of a view joins and aggregates, and the keys of the joins.
LINES_PER_TASK = 250_000
JOIN_KEYS = {"lineitem": "l_orderkey", "orders": "o_orderkey", "customer": "c_custkey", "part": "p_partkey"}

VIEWS: dict[str, str] = {
    "v1": """SELECT c_mktsegment AS cohort, c_custkey AS entity, c_acctbal AS value, c_nationkey AS nation,
             c_name AS name FROM customer""",
    "v2": """SELECT c.c_mktsegment AS cohort, o.o_custkey AS entity, p.p_brand AS feature,
             CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
             FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
             JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
             GROUP BY c.c_mktsegment, o.o_custkey, p.p_brand""",
    "v3": """SELECT c.c_mktsegment AS cohort, o.o_custkey AS entity, o.o_orderkey AS bag,
             CASE o.o_orderstatus WHEN 'F' THEN 'PASS' WHEN 'O' THEN 'WARN' ELSE 'FAILED' END AS status,
             o.o_orderpriority AS priority, o.o_totalprice AS size
             FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "v4": """SELECT r.r_name AS cohort, n.n_nationkey AS entity, s.s_suppkey AS bag,
             l.l_partkey AS x, l.l_orderkey AS y, l.l_linenumber AS line,
             l.l_extendedprice AS score, 1 - 5 * l.l_discount AS occupancy, l.l_quantity AS quantity,
             concat(CAST(l.l_orderkey AS VARCHAR(20)), '-', CAST(l.l_linenumber AS VARCHAR(20)), '-',
                    CAST(l.l_partkey AS VARCHAR(20)), '-', CAST(l.l_suppkey AS VARCHAR(20))) AS item
             FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
             JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "v5": """SELECT concat('G', CAST(vec_id % 2 AS VARCHAR(20))) AS cohort, vec_id % 10 AS entity, vec_id % 50 AS bag,
             vec_id AS item, label, embedding FROM embeddings""",
    "v6": """SELECT c.c_mktsegment AS cohort, c.c_custkey AS entity, c.c_acctbal AS score,
             max(CASE WHEN o.o_orderstatus = 'F' AND o.o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS y
             FROM customer c LEFT JOIN orders o ON c.c_custkey = o.o_custkey
             GROUP BY c.c_mktsegment, c.c_custkey, c.c_acctbal""",
    "v6b": """SELECT d.lang AS cohort, d.doc_id AS entity, l.quality AS y, l.toxic AS toxic,
              CAST(d.n_chars AS DOUBLE) AS score
              FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "v8": """SELECT p_type AS set_name, p_brand AS feature,
             CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*)
               - (SELECT CAST(sum(CAST(p_retailprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) FROM part) AS weight
             FROM part GROUP BY p_type, p_brand""",
    "v9": """SELECT r.r_name AS cohort, s.s_suppkey AS bag, l.l_orderkey AS item, l.l_linenumber % 6 AS type_id,
             l.l_quantity AS box_w, 20 * l.l_tax + 1 AS box_h
             FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
             JOIN nation n ON s.s_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey""",
    "v10": """SELECT l_suppkey AS item, (l_partkey * 7) % 256 AS r, (l_orderkey * 13) % 256 AS g,
              (l_linenumber * 37 + l_partkey) % 256 AS b FROM lineitem""",
    # Site-level measurements, accession plus two residues per feature.
    "v12": """SELECT c.c_mktsegment AS cohort, o.o_custkey AS entity,
              concat('NP_', replace(p.p_brand, 'Brand#', ''), ':s', CAST(p.p_size % 5 + 1 AS VARCHAR(5)), 't', CAST(p.p_size % 3 + 1 AS VARCHAR(5))) AS feature,
              CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value
              FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
              JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
              GROUP BY c.c_mktsegment, o.o_custkey,
              concat('NP_', replace(p.p_brand, 'Brand#', ''), ':s', CAST(p.p_size % 5 + 1 AS VARCHAR(5)), 't', CAST(p.p_size % 3 + 1 AS VARCHAR(5)))""",
    # Observed value with a second measurement of the same cell.
    "v13": """SELECT c.c_mktsegment AS cohort, o.o_custkey AS entity, p.p_brand AS feature,
              CAST(sum(CAST(l.l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS value,
              1000 * CAST(sum(CAST(l.l_quantity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS pred
              FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
              JOIN customer c ON o.o_custkey = c.c_custkey JOIN part p ON l.l_partkey = p.p_partkey
              GROUP BY c.c_mktsegment, o.o_custkey, p.p_brand""",
    # Cluster labels of every entity over eight starts.
    "v14": """SELECT c_mktsegment AS cohort, c_custkey AS entity, 0 AS start, CAST(floor((c_acctbal + 2000 + 0) / 2500) AS INT) % 4 AS label FROM customer 
              UNION ALL SELECT c_mktsegment AS cohort, c_custkey AS entity, 1 AS start, CAST(floor((c_acctbal + 2000 + 700) / 2500) AS INT) % 4 AS label FROM customer 
              UNION ALL SELECT c_mktsegment AS cohort, c_custkey AS entity, 2 AS start, CAST(floor((c_acctbal + 2000 + 1400) / 2500) AS INT) % 4 AS label FROM customer 
              UNION ALL SELECT c_mktsegment AS cohort, c_custkey AS entity, 3 AS start, CAST(floor((c_acctbal + 2000 + 2100) / 2500) AS INT) % 4 AS label FROM customer 
              UNION ALL SELECT c_mktsegment AS cohort, c_custkey AS entity, 4 AS start, CAST(floor((c_acctbal + 2000 + 2800) / 2500) AS INT) % 4 AS label FROM customer 
              UNION ALL SELECT c_mktsegment AS cohort, c_custkey AS entity, 5 AS start, CAST(floor((c_acctbal + 2000 + 3500) / 2500) AS INT) % 4 AS label FROM customer 
              UNION ALL SELECT c_mktsegment AS cohort, c_custkey AS entity, 6 AS start, CAST(floor((c_acctbal + 2000 + 4200) / 2500) AS INT) % 4 AS label FROM customer 
              UNION ALL SELECT c_mktsegment AS cohort, c_custkey AS entity, 7 AS start, CAST(floor((c_acctbal + 2000 + 4900) / 2500) AS INT) % 4 AS label FROM customer""",
    # Order rows carrying free-text clinical style columns.
    "v11": """SELECT c.c_mktsegment AS cohort, o.o_custkey AS entity, o.o_orderkey AS case_id,
              CASE o.o_orderkey % 9 WHEN 0 THEN ' Stage IIIA ' WHEN 1 THEN 'stage IV' WHEN 2 THEN 'Stage II'
                WHEN 3 THEN 'I' WHEN 4 THEN '0' WHEN 5 THEN 'Unknown' WHEN 6 THEN 'Not Reported' WHEN 7 THEN 'Stage X' END AS stage,
              CASE o.o_orderkey % 7 WHEN 0 THEN 'N0' WHEN 1 THEN 'n1a' WHEN 2 THEN 'NX' WHEN 3 THEN 'N2'
                WHEN 4 THEN ' null ' WHEN 5 THEN 'N0 (i+)' END AS n_stage,
              CASE o.o_orderkey % 5 WHEN 0 THEN 'M0' WHEN 1 THEN 'M1b' WHEN 2 THEN 'MX' WHEN 3 THEN '' END AS m_stage,
              CASE o.o_orderkey % 6 WHEN 0 THEN 'Primary Solid Tumor' WHEN 1 THEN 'Solid Tissue NORMAL' WHEN 2 THEN 'none'
                WHEN 3 THEN ' Metastatic ' WHEN 4 THEN 'primary tumor' END AS sample_type,
              CASE o.o_orderkey % 8 WHEN 0 THEN 'NaN' WHEN 1 THEN 'NA' WHEN 2 THEN '' WHEN 3 THEN 'nan' WHEN 4 THEN 'inf'
                WHEN 5 THEN 'abc' ELSE CAST(CAST(o.o_totalprice AS DECIMAL(18,2)) AS VARCHAR(30)) END AS raw_value,
              CASE o.o_orderkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'female' WHEN 2 THEN 'Not Reported' END AS sex,
              CASE o.o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Not Reported' ELSE 'no' END AS recurrence,
              o.o_orderpriority AS priority, o.o_orderstatus AS status, o.o_totalprice AS price
              FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
}


def _mentions(sql: str, names: list[str]) -> list[str]:
    return [n for n in names if re.search(rf"\b(?:FROM|JOIN)\s+{n}\b", sql, re.I)]


def view_closure(names: list[str]) -> list[str]:
    """Requested views preceded by the views they read."""
    out: list[str] = []

    def visit(n: str) -> None:
        for dep in _mentions(VIEWS[n], list(VIEWS)):
            visit(dep)
        if n not in out:
            out.append(n)

    for n in names:
        visit(n)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(spark: SparkSession, sf_dir: str, used: list[str]) -> dict[str, DataFrame]:
    """Tables of a join of orders and their lines, in as many parts as the lines need.

    The view's aggregate keeps almost a group for each line, so a task's memory
    follows its lines; a session's fixed number of shuffle partitions would let
    it grow with the table.
    """
    if not {"lineitem", "orders"} <= set(used):
        return {}
    parts = -(-table(spark, sf_dir, "lineitem").count() // LINES_PER_TASK)
    if parts <= int(spark.conf.get("spark.sql.shuffle.partitions")):
        return {}
    return {t: table(spark, sf_dir, t).repartition(parts, key) for t, key in JOIN_KEYS.items() if t in used}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared view as a lazy DataFrame."""
    sql = VIEWS[name]
    used = _mentions(sql, TABLES + list(VIEWS))
    args = _spread(spark, sf_dir, used)
    for t in used:
        if t not in args:
            args[t] = table(spark, sf_dir, t) if t in TABLES else view(spark, sf_dir, t)
        sql = re.sub(rf"\b(FROM|JOIN)(\s+){t}\b", rf"\1\2{{{t}}}", sql, flags=re.I)
    return spark.sql(sql, **args)
