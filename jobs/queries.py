"""The registered queries of the jobs: each runs its job twice into a new shared folder and returns what is there then."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sitelens.queries import _with
from sitelens.shared import shared_dir

from . import name_candidates, specimen_archive


def job1_specimen_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every record of the given tables with its status, period and zone, as the second of two runs leaves the archive."""
    output = shared_dir(spark, "specimen-archive")
    for _ in range(2):
        out = specimen_archive.run(spark, sf_dir, output)
    return out


def job2_name_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Name candidates of all documents; the second run finds no new file.

    The table is one file or a folder of files; as a pattern a file stream takes both.
    """
    base = shared_dir(spark, "name-candidates")
    for _ in range(2):
        out = name_candidates.run(spark, f"{sf_dir}/documents.parque[t]", f"{base}/output", f"{base}/checkpoint")
    return out


QUERIES = {f.__name__: f for f in (job1_specimen_archive, job2_name_candidates)}
ORACLES = {
    "job1_specimen_archive": _with("en")
    + """SELECT orderkey, line, site, lon, lat, region, taxon_group, bp_upper, bp_lower, d13c_coll AS d13C_coll, d15n_coll AS d15N_coll, cn AS CN, zone,
  CASE WHEN lat IS NULL OR lon IS NULL THEN 'no coordinates'
       WHEN NOT (lon BETWEEN 105 AND 141 AND lat BETWEEN 33 AND 56) THEN 'outside the box'
       WHEN cn IS NOT NULL AND NOT cn BETWEEN 2.9e0 AND 3.6e0 THEN 'C:N out of range'
       WHEN d13c_coll IS NULL OR d15n_coll IS NULL THEN 'no collagen values'
       ELSE 'kept' END AS status, period FROM en""",
    "job2_name_candidates": """WITH mention AS (
  SELECT doc_id, lang, unnest(regexp_extract_all(text, '[\\p{Ll},] (\\p{Lu}\\p{Ll}{3,})', 1)) AS name FROM documents
), by_report AS (
  SELECT lang, nfc_normalize(lower(name)) AS key, doc_id, count(*) AS n, min(name) AS name FROM mention GROUP BY ALL
)
SELECT lang, key, min(name) AS name, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS reports FROM by_report GROUP BY lang, key""",
}
