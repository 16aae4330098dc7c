"""Stand-in tables: manuscripts, references, votes and claims made from the driver's tables.

Each is one SQL text that Spark and DuckDB both read, so a query and its
oracle begin with the same rows. Spark gets the tables as parameters.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

#: Votes: a claim is an order, a vote a line; confidences are multiples of 1/16, so that sums are exact in any order.
VOTES = """
SELECT l_orderkey AS unit_id,
  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS vote_ord,
  CASE WHEN l_linenumber <= 3 THEN 0 WHEN l_linenumber <= 5 THEN 1 WHEN l_linenumber = 6 THEN 2 ELSE 3 END AS tier,
  CASE WHEN l_quantity >= 49 THEN 'contradicted' WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN 'not_supported'
    WHEN l_returnflag = 'A' AND l_linestatus = 'F' THEN 'partially_supported' WHEN l_returnflag = 'N' AND l_linestatus = 'F' THEN 'cannot_verify'
    ELSE 'supported' END AS verdict,
  CAST(0.5 + (l_partkey % 8) / 16.0 AS DOUBLE) AS confidence,
  concat('reason ', CAST(l_partkey AS STRING)) AS reasoning,
  concat(CASE WHEN l_suppkey % 2 = 0 THEN 'Quote ' ELSE ' quote ' END, CAST(l_suppkey % 5 AS STRING)) AS quote
FROM {lineitem}"""

#: References: one per part, fifty sessions.
REFERENCES = """
SELECT concat('s', CAST(p_partkey % 50 AS STRING)) AS session_id, CAST(floor(p_partkey / 50) AS BIGINT) + 1 AS ref_num,
  concat(upper(substr(split_part(p_name, ' ', 2), 1, 1)), substr(split_part(p_name, ' ', 2), 2)) AS surname,
  concat(p_name, ' ', lower(p_type), ' ', lower(replace(p_brand, '#', ' '))) AS title,
  1990 + p_size % 30 AS year,
  concat('10.', CAST(1000 + p_partkey % 97 AS STRING), '/', replace(p_brand, '#', '.'), '.', CAST(p_partkey AS STRING)) AS doi,
  CASE p_partkey % 7 WHEN 0 THEN 'not_found' WHEN 1 THEN 'api_error' WHEN 2 THEN 'unchecked' ELSE 'found' END AS source_status,
  CASE WHEN p_partkey % 3 = 0 THEN concat('/pdf/', CAST(p_partkey AS STRING), '.pdf') END AS pdf_path,
  CASE WHEN p_partkey % 4 = 0 THEN concat('https://doi.org/', CAST(p_partkey AS STRING)) END AS journal_url,
  CASE p_partkey % 23 WHEN 0 THEN 'retracted' WHEN 1 THEN 'corrected' WHEN 2 THEN 'expression_of_concern' WHEN 3 THEN 'unknown' ELSE 'ok' END AS retraction_status,
  p_partkey
FROM {part}"""

#: Raw reference lines with DOIs, PMIDs and years in the usual forms.
RAW_REFERENCES = f"""
SELECT session_id, ref_num, concat('[', CAST(ref_num AS STRING), '] ', surname, ' A., Brown B., ', title, '. J Test ', CAST(year AS STRING), '; 12:3-4. ',
  CASE CAST(ref_num % 4 AS INT) WHEN 0 THEN concat('doi:', doi, '.') WHEN 1 THEN concat('https://doi.org/', doi, ',') WHEN 2 THEN concat('see ', doi) ELSE concat('PMID: ', CAST(1000000 + p_partkey AS STRING)) END) AS raw_text
FROM ({REFERENCES}) r"""

#: Paragraphs with numbered and author-year citations: one per order.
PARAGRAPHS = """
SELECT concat('s', CAST(o_custkey % 50 AS STRING)) AS session_id, o_orderkey AS para_idx,
  CASE CAST(o_orderkey % 5 AS INT) WHEN 0 THEN 'Introduction' WHEN 1 THEN 'Methods' WHEN 2 THEN 'Results' WHEN 3 THEN 'Discussion' ELSE 'Acknowledgments' END AS section,
  CASE CAST(o_orderkey % 6 AS INT)
    WHEN 0 THEN concat('Growth was ', CAST(o_orderkey % 90 AS STRING), '.5% in the first group [', CAST(1 + o_orderkey % 9 AS STRING), ', ', CAST(3 + o_orderkey % 9 AS STRING), '-', CAST(5 + o_orderkey % 12 AS STRING), ']. However, it has been shown that the dose matters [2].')
    WHEN 1 THEN concat('Earlier work (Ring, ', CAST(1990 + o_orderkey % 30 AS STRING), '; Widget and Bolt, 2001a) used this method. The yield was low (n = 12) in all cases (see Gear et al., ', CAST(1995 + o_orderkey % 20 AS STRING), ').')
    WHEN 2 THEN concat('Bolt et al. (', CAST(1990 + o_orderkey % 30 AS STRING), ') reported that copper is known to bind zinc strongly. Table 2 (Figure 3) lists all values.')
    WHEN 3 THEN 'We performed all steps twice. Several studies have suggested a role for iron in this process, yet none is certain.'
    WHEN 4 THEN concat('The effect was first described in mice, cf. the review [', CAST(2 + o_orderkey % 7 AS STRING), ']. Ring (', CAST(1990 + o_custkey % 30 AS STRING), 'b) found the contrary; see also (Gear, 1999, 2003).')
    ELSE concat('Values of p = 0.0', CAST(1 + o_orderkey % 9 AS STRING), ' were common. Using the protocol of Dr. Smith et al. we saw ', CAST(o_orderkey % 40 AS STRING), '% loss!') END AS text,
  o_orderkey, o_custkey, o_orderstatus, o_orderpriority, o_orderdate
FROM {orders}"""

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def for_duckdb(sql: str) -> str:
    """The same text with table names in place of parameters."""
    return re.sub(r"\{(\w+)\}", r"\1", sql)


def stand_in(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    names = {n for n in re.findall(r"\{(\w+)\}", sql) if n in TABLES}
    return spark.sql(sql, **{n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in names})


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
