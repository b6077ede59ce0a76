"""The jobs as queries: each runs twice into one new folder and gives back what is there after the second run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from jobs import pool_spectra, repeat_atlas
from strandweave.plans.registry import SEQS, circular
from strandweave.session import Scratch

K, WIDTHS = 6, (12, 16, 24)


def job1_pool_spectra(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "job1").root
    for _ in range(2):
        pool_spectra.run(spark, f"{sf_dir}/documents*.parquet", f"{root}/output", f"{root}/checkpoint", K)
    return pool_spectra.read(spark, f"{root}/output")


def job2_repeat_atlas(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = Scratch(spark, "job2").root
    for _ in range(2):
        repeat_atlas.run(spark, f"{sf_dir}/documents.parquet", f"{root}/output", WIDTHS)
    return repeat_atlas.read(spark, f"{root}/output")


SPECTRA_SQL = f"""
WITH s AS MATERIALIZED (SELECT seq_id, source AS pool, s FROM ({SEQS}) WHERE length(s) >= {K}),
o AS ({circular("SELECT * FROM s", K)}),
c AS (SELECT pool, kmer, count(*) AS n, count(DISTINCT seq_id) AS sequences FROM o GROUP BY 1, 2),
p AS (SELECT pool, count(*) AS members FROM s GROUP BY 1)
SELECT c.pool, kmer, n, sequences, sequences = members AS core, substr(kmer, 1, 2) AS prefix FROM c JOIN p ON c.pool IS NOT DISTINCT FROM p.pool
"""


def _width(k: int) -> str:
    return f"""
SELECT q.seq_id, q.source AS pool, CAST(length(q.s) AS BIGINT) AS letters, coalesce(vertices, 0) AS vertices, coalesce(arcs, 0) AS arcs, coalesce(occurrences, 0) AS occurrences,
       coalesce(most, 0) AS most, coalesce(branches, 0) AS branches, coalesce(longest, 0) AS longest, CAST({k} AS INTEGER) AS k
FROM ({SEQS}) q LEFT JOIN (
  SELECT seq_id, count(*) AS vertices, CAST(sum(heads) AS BIGINT) AS arcs, CAST(sum(m) AS BIGINT) AS occurrences, CAST(max(m) AS BIGINT) AS most, CAST(count_if(heads > 1) AS BIGINT) AS branches, CAST(max(span) AS BIGINT) AS longest
  FROM (SELECT seq_id, tail, count(*) AS m, count(DISTINCT head) AS heads, max(span) AS span FROM (
    SELECT seq_id, kmer AS tail, coalesce(lead(kmer) OVER w, first_value(kmer) OVER w) AS head, coalesce(lead(pos) OVER w, first_value(pos) OVER w + n) - pos AS span
    FROM (SELECT seq_id, i AS pos, n, kmer FROM ({circular(f"SELECT seq_id, length(s) AS n, s FROM ({SEQS})", k)}) QUALIFY count(*) OVER (PARTITION BY seq_id, kmer) > 1)
    WINDOW w AS (PARTITION BY seq_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) GROUP BY 1, 2) GROUP BY 1) g ON g.seq_id = q.seq_id
"""


ATLAS_SQL = " UNION ALL ".join(map(_width, WIDTHS))

QUERIES = {"job1_pool_spectra": job1_pool_spectra, "job2_repeat_atlas": job2_repeat_atlas}
ORACLES = {"job1_pool_spectra": SPECTRA_SQL, "job2_repeat_atlas": ATLAS_SQL}
