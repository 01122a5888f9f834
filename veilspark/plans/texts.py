"""Input texts of the registered queries, as SQL that Spark and DuckDB both run.

The tables hold few kinds of personal data, so the other kinds are derived from keys: each
text source has both hits and near misses.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _case(key: str, options: list[str]) -> str:
    return f"CASE {key} % {len(options)} " + " ".join(f"WHEN {i} THEN {o}" for i, o in enumerate(options)) + " END"


def _text(expr: str) -> str:
    return f"CAST({expr} AS STRING)"


_MONTH = "CASE month(o_orderdate) " + " ".join(f"WHEN {i} THEN '{m}'" for i, m in enumerate("January February March April May June July August September October November December".split(), 1)) + " END"
_Y, _M, _D = (_text(f"{f}(o_orderdate)") for f in ("year", "month", "day"))
_HEX = "lower(hex(c_custkey))"

SOURCES = {
    "documents": "SELECT doc_id AS id, text FROM {documents}",
    "ssn": "SELECT c_custkey AS id, 'Employee SSN on file: ' || lpad(" + _text("c_custkey * 37 % 1000") + ", 3, '0') || '-' || lpad(" + _text("c_custkey % 100") + ", 2, '0') || '-' || lpad("
    + _text("c_custkey * 7919 % 10000") + ", 4, '0') || " + _case("c_custkey", ["' or 666-45-6789'", "', é901-45-6789é 1-523-45-6789'", "' 523456789'", "''", "' 000-12-3456 523-45-0000.'"]) + " AS text FROM {customer}",
    "dates": "SELECT o_orderkey AS id, " + _case("o_orderkey", [
        f"'DOB: ' || {_M} || '/' || {_D} || '/' || {_Y}", f"'Registered on ' || {_Y} || '-' || lpad({_M}, 2, '0') || '-' || lpad({_D}, 2, '0') || ' in the system.'",
        f"'Born on ' || {_MONTH} || ' ' || {_D} || ', ' || {_Y} || '.'", f"{_D} || ' ' || substr({_MONTH}, 1, 3) || '. ' || {_Y}", f"'13/45/' || {_Y} || ' and February 30, ' || {_Y} || ', 30 February ' || {_Y}",
        "'Founded 07/04/1785. Delivery 12/31/2099, Sept 5, 1990, 5 Sept. 1990'", f"{_D} || '/' || {_M} || '-' || {_Y} || ' 25/12/1990'", f"{_Y} || '/' || {_M} || '/' || {_D} || ' or ' || upper({_MONTH}) || '  ' || {_D} || ' ' || {_Y}",
    ]) + " AS text FROM {orders}",
    "ipv6": "SELECT c_custkey AS id, " + _case("c_custkey", [
        f"'host 2001:db8::' || {_HEX} || ' and ::1'", f"'é' || 'fe80:0:0:0:' || {_HEX} || ':1:2:3é'", f"'1:2:3:4:5:6:7:8:' || {_HEX}", f"'1::2::' || {_HEX}",
        "'std::vector a::b at 12:30:45 aa:bb:cc:dd:ee:ff'", f"'::ffff:1.2.3.4 1:2:3:4:5:6:7::' || {_HEX}",
    ]) + " AS text FROM {customer}",
    "phones": "SELECT doc_id AS id, text FROM {documents} UNION ALL SELECT -c_custkey AS id, " + _case("c_custkey", [
        "'Call (' || " + _text("200 + c_custkey % 800") + " || ') 555-0132 or +1-415-555-0148'", "'UK office: +44 20 7946 0958.'", "'+' || " + _text("c_custkey * 7919 * 1000003"), "'Server 192.168.1.100 or 999.999.999.999.'",
        "'The meeting is 12-25 at gate 42, ' || " + _text("2000000000 + c_custkey * 104729"), "'call 415-555-0132 2024 now'", "'(415) 555-0132\n(415) 555-0148'",
    ]) + " AS text FROM {customer}",
    "orgs": "SELECT p_partkey AS id, " + _case("p_partkey", [
        "'The contract was signed with Global Dynamics LLC yesterday.'", "'Nora works at ' || upper(substr(p_name, 1, 1)) || substr(p_name, 2) || ' Corp on weekdays.'", "'Étoile Noire Ltd. and acme corp'",
        "'Acme L.L.C. did'", "'Smith & Sons Holdings, O''Neil-Berg, Inc. of ' || p_brand || ' Group'",
    ]) + " AS text FROM {part}",
    "addresses": "SELECT c_custkey AS id, " + _case("c_custkey", [
        "'Please ship to ' || " + _text("c_custkey") + " || ' Main Street, Suite ' || " + _text("c_custkey % 90"), "'Flat no. ' || " + _text("c_custkey % 50") + " || '/A, Gandhi Nagar, Pune ' || " + _text("400000 + c_custkey % 99999"),
        "'Road closed ahead, Sector No. ' || " + _text("c_custkey % 40") + " || ' snow'", "'Invoice 123456 of 11/3, 12 main street'", "'S. No: ' || " + _text("c_custkey") + " || '/2 Étage Marg, 7 Élan Road'",
    ]) + " AS text FROM {customer}",
}
SOURCES["mixed"] = SOURCES["documents"] + "".join(
    f" UNION ALL SELECT {k} * CAST(1000000000 AS BIGINT) + id AS id, text FROM ({SOURCES[n]}) AS t{k}" for k, n in enumerate(("ssn", "dates", "ipv6", "orgs", "addresses"), 1)
)


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Bytes of a table that may be a single row group, which one task reads.
ONE_GROUP = 64 << 20


def spread(df: DataFrame) -> DataFrame:
    """A small table over all cores: a file of one row group is one task, however long the work on a row. Larger tables, which have row groups enough, stay as they are read."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= ONE_GROUP and cores > 1 else df


def spark_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return spark.sql(sql, **{t: spread(load(spark, sf_dir, t)) for t in TABLES if "{" + t + "}" in sql})


def duck_sql(sql: str) -> str:
    return sql.format(**{t: t for t in TABLES})
