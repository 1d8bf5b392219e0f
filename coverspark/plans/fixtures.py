"""Pixel, observation and scene tables as views over the given tables; the same SQL runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _cls(k: str) -> str:
    """A skewed land-cover class from a number."""
    steps = [(44, 106), (72, 109), (90, 101), (92, 102), (95, 105), (98, 108), (99, 103)]
    return "case " + " ".join(f"when {k}%100<{b} then {c}" for b, c in steps) + " else 111 end"


_HOLE = "o_orderkey%11=0 or (cast(floor(o_orderkey/100) as int)%20 between 3 and 7 and o_orderkey%20 between 3 and 7)"

PX = f"""select o_orderkey as pix, cast(floor(o_orderkey/100) as int) as row, cast(o_orderkey%100 as int) as col,
 concat('h',cast(cast(floor((o_orderkey%100)/50) as int) as string),'v',cast(cast(floor(o_orderkey/5000) as int) as string)) as tile,
 case when o_orderkey%17=0 then 0 else 1 end as roi,
 case when o_orderkey%100<30 then 'in' when o_orderkey%100<70 then 'out' end as zone,
 case when o_orderkey%29=0 then 1 else 0 end as urban,
 case when o_orderkey%97=0 then null else {_cls("o_custkey")} end as ref1,
 case when o_orderkey%97=0 then null when o_orderkey%5=0 then {_cls("(o_custkey+50)")} else {_cls("o_custkey")} end as map1,
 case when o_orderkey%97=0 then null when o_orderkey%7=0 then {_cls("(o_custkey+30)")} else {_cls("o_custkey")} end as ref2,
 case when o_orderkey%89=0 then null when o_orderkey%6=0 then {_cls("(o_custkey+30)")} else {_cls("o_custkey")} end as map2,
 cast((o_orderkey*2654435761)%65536 as int) as pixel_qa,
 case when o_orderkey%83=0 then null else cast((o_orderkey*40503)%256 as int) end as sr_aerosol,
 case when {_HOLE} then -1 else cast(floor(o_totalprice) as int)%30*30 end as sos,
 case when {_HOLE} then -1 else cast(floor(o_totalprice/3) as int)%30*30 end as eos,
 case when {_HOLE} then -1 else cast(floor(o_totalprice/7) as int)%400 end as los
from {{orders}}"""

OBS = """select l_orderkey as pix, case l_linenumber when 1 then 'BLUE' when 2 then 'GREEN' when 3 then 'RED' when 4 then 'NIR' when 5 then 'SWIR1' when 6 then 'MIR' else 'NDVI' end as band,
 cast(month(l_shipdate) as int) as month, case when l_quantity<3 then -13000 else cast(floor(l_extendedprice) as int)%10000 end as value from {lineitem}"""

SCENE = """select user_id as site, event_type as band, concat('LANDSAT08.A',cast(year(ts) as string),lpad(cast(dayofyear(ts) as string),3,'0'),'.h019v025.hdf') as path, cast(floor(value*100) as int) as value from {events}"""

CLASS_KEYS = """select * from (values (101,'Agriculture',1,'human'),(102,'Urban',1,'human'),(103,'Water',2,'water'),(104,'Barren land',3,'open'),(105,'Mangrove',4,'forest'),(106,'Evergreen tropical forest',4,'forest'),(107,'Savanna',3,'open'),(108,'Wetland',2,'water'),(109,'Deciduous tropical forest',4,'forest'),(110,'Coastal vegetation',3,'open'),(111,'Oak forest',4,'forest')) as t(lc_key,description,grp_key,grp_desc)"""

PLOTS = """select c_custkey as upmid, c_nationkey as cluster, c_mktsegment as state, case when c_custkey%5=0 then null else c_acctbal end as x from {customer}"""

_SOURCE = {"px": (PX, "orders"), "obs": (OBS, "lineitem"), "scene": (SCENE, "events"), "plots": (PLOTS, "customer")}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name == "keys":
        return spark.sql(CLASS_KEYS)
    sql, table = _SOURCE[name]
    return spark.sql(sql, **{table: spark.read.parquet(f"{sf_dir}/{table}.parquet")})


def ctes(*names: str) -> str:
    """WITH clause of the views for DuckDB."""
    parts = [f"{n} AS ({CLASS_KEYS if n == 'keys' else _SOURCE[n][0].format(**{_SOURCE[n][1]: _SOURCE[n][1]})})" for n in names]
    return "WITH " + ", ".join(parts)
