"""Deterministic stand-ins for the domain tables, derived from the star-schema tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import taxon_group, with_human
from .schema import finalise
from .shared import spread

SITE = """
select s_suppkey as site_id, s_name as site,
       105e0 + cast((s_suppkey * 7919) % 3600 as double) / 100e0 as lon,
       33e0 + cast((s_suppkey * 10473) % 2300 as double) / 100e0 as lat,
       cast(s_nationkey as bigint) as region_id
from supplier
"""

SPECIMEN = """
select cast(l.l_orderkey as bigint) as orderkey, cast(l.l_linenumber as int) as line,
       s.s_name as site,
       case when l.l_partkey % 23 = 0 then null else 105e0 + cast((s.s_suppkey * 7919) % 3600 as double) / 100e0 end as lon,
       case when l.l_partkey % 23 = 0 then null else 33e0 + cast((s.s_suppkey * 10473) % 2300 as double) / 100e0 end as lat,
       n.n_name as region,
       case l.l_orderkey % 7 when 0 then 'Lower Xiajiadian Culture' when 1 then 'Shang Dynasty'
            when 2 then 'Warring States' when 3 then 'Han Dynasty' when 4 then 'Northern Wei'
            when 5 then 'Liao Dynasty' else null end as culture,
       case when l.l_linenumber = 7 then null
            else cast(4100 - ((year(l.l_shipdate) - 1995) * 12 + month(l.l_shipdate) - 1) * 42 as double) end as bp_upper,
       case when l.l_linenumber in (5, 7) then null
            else cast(4000 - ((year(l.l_shipdate) - 1995) * 12 + month(l.l_shipdate) - 1) * 42 as double) end as bp_lower,
       case l.l_partkey % 10 when 0 then 'Human' when 1 then 'Pig' when 2 then 'Wild boar (Sus scrofa)' when 3 then 'Dog'
            when 4 then 'Cattle' when 5 then 'Sheep/Goat' when 6 then 'Horse' when 7 then 'Sika deer'
            when 8 then 'Pheasant' else null end as taxon,
       case when l.l_linenumber = 6 then null else -24e0 + l.l_quantity * 0.3e0 end as d13c_coll,
       case when l.l_linenumber = 6 then null else 4e0 + l.l_discount * 60e0 end as d15n_coll,
       case when l.l_tax = 0 then null else 2.7e0 + l.l_tax * 15e0 end as cn
from lineitem l
join supplier s on l.l_suppkey = s.s_suppkey
join nation n on s.s_nationkey = n.n_nationkey
"""

CELL = """
select r.n as row_id, c.n as col_id,
       105.25e0 + 0.5e0 * c.n as x, 55.75e0 - 0.5e0 * r.n as y,
       cast((r.n * r.n * 31 + c.n * c.n * 17 + r.n * c.n * 13) % 1000 as double) as elev,
       -5e0 + 0.4e0 * r.n + cast((c.n * 7) % 5 as double) as bio1,
       case when (r.n * 7 + c.n * 11) % 19 = 0 then null else cast(400 + (r.n * 37 + c.n * 53) % 700 as double) end as bio12
from (select p_partkey as n from part where p_partkey < 46) r
cross join (select p_partkey as n from part where p_partkey < 72) c
"""

SCORE = """
select c_custkey as id, case when c_mktsegment = 'BUILDING' then 1 else 0 end as label, cast(c_acctbal as double) as score
from customer
"""

#: Apatite measurements of some of the specimens' samples, with repeats and unusable ids.
APATITE = """
select cast(l_orderkey as bigint) * 10 + l_linenumber as ord,
       s_name as site,
       case when l_orderkey % 11 = 0 then 'nan' else concat('S', cast(l_orderkey % 500 as varchar(20))) end as sample_id,
       case when l_partkey % 10 = 0 then 'human' else 'animal' end as grp,
       case when l_linenumber = 2 then null else -15e0 + l_discount * 40e0 end as d13c_ap,
       case when l_tax = 0 then null else -9e0 + l_tax * 20e0 end as d18o_ap
from lineitem join supplier on l_suppkey = s_suppkey
where l_linenumber <= 2
"""

COLLAGEN = """
select cast(l_orderkey as bigint) * 10 + l_linenumber as ord,
       s_name as site,
       case when l_orderkey % 13 = 0 then '' else concat('S', cast(l_orderkey % 500 as varchar(20))) end as sample_id,
       case when l_partkey % 10 = 0 then 'human' else 'animal' end as grp,
       -24e0 + l_quantity * 0.3e0 as d13c_coll
from lineitem join supplier on l_suppkey = s_suppkey
where l_linenumber = 3
"""

ALL = {"fx_site": SITE, "fx_specimen": SPECIMEN, "fx_cell": CELL, "fx_score": SCORE, "fx_apatite": APATITE, "fx_collagen": COLLAGEN}
_TABLES = {"fx_site": ["supplier"], "fx_specimen": ["lineitem", "supplier", "nation"], "fx_cell": ["part"], "fx_score": ["customer"], "fx_apatite": ["lineitem", "supplier"], "fx_collagen": ["lineitem", "supplier"]}


def fixture(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A stand-in by name; base tables are passed by reference, so no view is left behind."""
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in _TABLES[name]}
    used |= {t: spread(df) for t, df in used.items() if t == "lineitem"}  # the others are dimensions
    query = ALL[name]
    import re

    for t in used:
        query = re.sub(rf"\b(from|join) {t}\b", rf"\1 {{{t}}}", query)
    return spark.sql(query, **used)


def specimens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The specimen stand-in in the standard layout."""
    rows = fixture(spark, sf_dir, "fx_specimen").withColumn("group", F.when(F.col("taxon") == "Human", "human").otherwise("animal"))
    rows = rows.withColumn("source", F.when(F.col("orderkey") % 3 == 0, "A").otherwise("B"))
    return finalise(rows.withColumn("taxon_group", with_human(F.col("group"), taxon_group(F.col("taxon")))))
