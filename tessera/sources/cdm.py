"""Clinical tables as views over the star-schema test tables, in Spark and as the same SQL.

A real data set in the common data model is read by the same names through read_cdm().
"""

from __future__ import annotations

from functools import cached_property

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..shipping import ship
from ..staging import partitions

#: Tables of a clinical data set and of its vocabulary, with the columns that the operators use.
SCHEMAS = {
    "person": "person_id long, year_of_birth int, gender_concept_id int, race_concept_id int",
    "observation_period": "person_id long, start_date date, end_date date",
    "drug_exposure": "person_id long, concept_id long, start_date date, end_date date",
    "condition_occurrence": "person_id long, concept_id long, start_date date, end_date date",
    "procedure_occurrence": "person_id long, concept_id long, start_date date, end_date date",
    "measurement": "person_id long, concept_id long, start_date date, end_date date, value_as_number double, unit_concept_id long, range_low double, range_high double",
    "observation": "person_id long, concept_id long, ts timestamp_ntz, value_as_number double",
    "concept": "concept_id long, concept_name string, domain_id string, vocabulary_id string, concept_class_id string, standard_concept string, invalid_reason string",
    "concept_ancestor": "ancestor_concept_id long, descendant_concept_id long, min_levels_of_separation int",
    "concept_relationship": "concept_id_1 long, concept_id_2 long, relationship_id string",
}

#: The vocabulary is small beside the events and read many times in a query: it is kept, on disk where memory is short. Events are not.
KEPT = StorageLevel.MEMORY_AND_DISK

#: Rows of a large table that one task joins, sorts or groups at most, but for hot keys.
ROWS_A_TASK = 1_000_000

MALE, FEMALE = 8507, 8532
LEAF, BRAND, TYPE, ROOT, CONDITION, MEASURE, PROCEDURE, OBSERVED = 1_000_000, 2_000_000, 3_000_000, 4_000_000, 2_100_000, 2_200_000, 2_300_000, 2_400_000
STATUS_CODE = {"F": 1, "O": 2, "P": 3}
STATUS_UNIT = {"F": 8840, "O": 8753, "P": 9529}
RANGE_LOW, RANGE_HIGH = 50_000.0, 200_000.0
KINDS = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def read_cdm(spark: SparkSession, folder: str, missing_ok: bool = True) -> dict[str, DataFrame]:
    """The data set's tables in folder/<name>.parquet; absent ones are empty frames of their schema if missing_ok."""
    out = {}
    for name, schema in SCHEMAS.items():
        try:
            found = spark.read.parquet(f"{folder}/{name}.parquet")
        except Exception as e:
            if not missing_ok or "PATH_NOT_FOUND" not in str(e):
                raise
            found = spark.createDataFrame([], schema)
        wanted = T._parse_datatype_string(schema)
        out[name] = found.select([F.col(f.name).cast(f.dataType) for f in wanted])
    return out


def register(tables: dict[str, DataFrame], prefix: str = "") -> None:
    """Each table as a temporary view."""
    for name, df in tables.items():
        df.createOrReplaceTempView(prefix + name)


def choice(col, mapping: dict) -> F.Column:
    out = None
    for k, v in mapping.items():
        out = F.when(col == k, v) if out is None else out.when(col == k, v)
    return out


class Cdm:
    """Clinical views over a folder of star-schema tables. Only what a query reads is scanned."""

    def __init__(self, spark: SparkSession, folder: str):
        ship(spark)  # some queries run functions of this package in Python workers
        self.spark, self.folder = spark, folder

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    @cached_property
    def person(self) -> DataFrame:
        k = F.col("c_custkey")
        return self.raw("customer").select(k.alias("person_id"), (1930 + k % 60).cast("int").alias("year_of_birth"), F.when(k % 2 == 0, MALE).otherwise(FEMALE).alias("gender_concept_id"), F.col("c_nationkey").alias("race_concept_id"))

    @cached_property
    def _people_of_orders(self) -> DataFrame:
        return self.raw("orders").select("o_orderkey", F.col("o_custkey").alias("person_id"))

    def tasks(self, name: str) -> int | None:
        """Among how many tasks a table's rows are dealt so that none gets more than ROWS_A_TASK; None where the session's own number is enough. The count comes from the files' footers."""
        wanted = -(-self.raw(name).count() // ROWS_A_TASK)
        return wanted if wanted > partitions(self.spark) else None

    @cached_property
    def _items(self) -> DataFrame:
        items, orders = self.raw("lineitem"), self._people_of_orders
        if (n := self.tasks("lineitem")) is not None:  # the planner would send the orders to every task, or sort more in one the larger the tables are
            items, orders = items.repartition(n, "l_orderkey"), orders.repartition(n, "o_orderkey").hint("merge")
        return items.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))

    @cached_property
    def _drugs(self) -> tuple[F.Column, ...]:
        start = F.col("l_shipdate").cast("date")
        return (LEAF + F.col("l_partkey")).alias("concept_id"), start.alias("start_date"), F.date_add(start, F.col("l_quantity").cast("int")).alias("end_date")

    @cached_property
    def drug_exposure(self) -> DataFrame:
        return self._items.select("person_id", *self._drugs)

    @cached_property
    def item_concepts(self) -> DataFrame:
        """concept_id of drug_exposure and procedure_occurrence: both come from the items, which meet their orders once."""
        return self._items.select(F.explode(F.array(self._drugs[0], self._procedure)).alias("concept_id"))

    def drugs_of(self, concepts: DataFrame) -> DataFrame:
        """drug_exposure of some concepts (concept_id, and what else they have): the other items are left out before they meet their orders."""
        some = self.raw("lineitem").select("l_orderkey", *self._drugs).join(concepts, "concept_id")
        return some.join(self._people_of_orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")

    def drugs_beside(self, people: DataFrame) -> DataFrame:
        """drug_exposure joined with people by person_id: people meet their orders, of which there are fewer, and these the items, so that items move once."""
        orders = self._people_of_orders.join(people, "person_id")
        return self.raw("lineitem").select("l_orderkey", *self._drugs).join(orders, F.col("l_orderkey") == F.col("o_orderkey")).drop("l_orderkey", "o_orderkey")

    @cached_property
    def _procedure(self) -> F.Column:
        return (PROCEDURE + F.ascii("l_returnflag") * 100 + F.ascii("l_linestatus")).cast("long")

    @cached_property
    def procedure_occurrence(self) -> DataFrame:
        day = F.col("l_shipdate").cast("date")
        return self._items.select("person_id", self._procedure.alias("concept_id"), day.alias("start_date"), day.alias("end_date"))

    @cached_property
    def condition_occurrence(self) -> DataFrame:
        day = F.col("o_orderdate").cast("date")
        return self.raw("orders").select(F.col("o_custkey").alias("person_id"), (CONDITION + F.substring("o_orderpriority", 1, 1).cast("long")).alias("concept_id"), day.alias("start_date"), day.alias("end_date"))

    @cached_property
    def measurement(self) -> DataFrame:
        day, status = F.col("o_orderdate").cast("date"), F.col("o_orderstatus")
        return self.raw("orders").select(
            F.col("o_custkey").alias("person_id"), (MEASURE + choice(status, STATUS_CODE)).cast("long").alias("concept_id"), day.alias("start_date"), day.alias("end_date"),
            F.col("o_totalprice").alias("value_as_number"), choice(status, STATUS_UNIT).cast("long").alias("unit_concept_id"), F.lit(RANGE_LOW).alias("range_low"), F.lit(RANGE_HIGH).alias("range_high"),
        )

    @cached_property
    def observation(self) -> DataFrame:
        return self.raw("events").select(F.col("user_id").alias("person_id"), (OBSERVED + choice(F.col("event_type"), KINDS)).cast("long").alias("concept_id"), "ts", F.col("value").alias("value_as_number"))

    @cached_property
    def observation_period(self) -> DataFrame:
        # of an order's items only the first and the last day move
        _, start, end = self._drugs
        items = self.raw("lineitem").select("l_orderkey", start, end).groupBy("l_orderkey").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))
        drugs = items.join(self._people_of_orders, F.col("l_orderkey") == F.col("o_orderkey")).select("person_id", "start_date", "end_date")
        spans = drugs.unionByName(self.condition_occurrence.select("person_id", "start_date", "end_date"))
        return spans.groupBy("person_id").agg(F.min("start_date").alias("start_date"), F.max("end_date").alias("end_date"))

    @cached_property
    def _brand(self) -> F.Column:
        return (BRAND + F.regexp_extract("p_brand", r"(\d+)", 1).cast("long")).alias("brand_id")

    @cached_property
    def _parts(self) -> DataFrame:
        part = self.raw("part")
        types = part.select("p_type").distinct()
        from pyspark.sql import Window

        ranked = types.withColumn("type_id", (TYPE + F.row_number().over(Window.orderBy("p_type"))).cast("long"))  # a handful of types
        return part.join(F.broadcast(ranked), "p_type").select((LEAF + F.col("p_partkey")).alias("leaf_id"), "p_partkey", "p_name", "p_size", "p_brand", self._brand, "p_type", "type_id").persist(KEPT)

    @cached_property
    def concept(self) -> DataFrame:
        p = self._parts
        leaf = p.select(
            F.col("leaf_id").alias("concept_id"), F.col("p_name").alias("concept_name"), F.lit("Drug").alias("domain_id"), F.when(F.col("p_partkey") % 2 == 0, "RxNorm").otherwise("NDC").alias("vocabulary_id"),
            F.lit("Clinical Drug").alias("concept_class_id"), F.when(F.col("p_size") != 2, "S").alias("standard_concept"), F.when(F.col("p_size") == 1, "D").alias("invalid_reason"),
        )

        def level(df: DataFrame, id_: str, name: str, klass: str) -> DataFrame:
            return df.select(F.col(id_).alias("concept_id"), F.col(name).alias("concept_name"), F.lit("Drug").alias("domain_id"), F.lit("RxNorm").alias("vocabulary_id"), F.lit(klass).alias("concept_class_id"), F.lit("S").alias("standard_concept"), F.lit(None).cast("string").alias("invalid_reason"))

        root = self.spark.range(1).select(F.lit(ROOT).cast("long").alias("r"), F.lit("any drug").alias("n"))
        brands = level(p.select("brand_id", "p_brand").distinct(), "brand_id", "p_brand", "Brand Name")
        kinds = level(p.select("type_id", "p_type").distinct(), "type_id", "p_type", "Ingredient")
        return leaf.unionByName(brands).unionByName(kinds).unionByName(level(root, "r", "n", "Class")).persist(KEPT)

    @cached_property
    def is_a(self) -> DataFrame:
        """child, parent: direct edges."""
        p = self._parts
        up = p.select(F.col("leaf_id").alias("child"), F.explode(F.array("brand_id", "type_id")).alias("parent"))
        middle = p.select(F.explode(F.array("brand_id", "type_id")).alias("child")).distinct().select("child", F.lit(ROOT).cast("long").alias("parent"))
        return up.unionByName(middle).persist(KEPT)

    @cached_property
    def concept_ancestor(self) -> DataFrame:
        edges = self.is_a
        rows = [edges.select(F.col("parent").alias("a"), F.col("child").alias("d"), F.lit(1).alias("s"))]
        rows.append(self._parts.select(F.lit(ROOT).cast("long").alias("a"), F.col("leaf_id").alias("d"), F.lit(2).alias("s")))
        rows.append(self.concept.select(F.col("concept_id").alias("a"), F.col("concept_id").alias("d"), F.lit(0).alias("s")))
        return rows[0].unionByName(rows[1]).unionByName(rows[2]).toDF("ancestor_concept_id", "descendant_concept_id", "min_levels_of_separation").persist(KEPT)

    @cached_property
    def concept_relationship(self) -> DataFrame:
        p = self._parts
        good = p.where("p_size not in (1, 2)").groupBy("p_name").agg(F.min("leaf_id").alias("to"))
        maps = p.where("p_size = 2").join(good, "p_name").select(F.col("leaf_id").alias("concept_id_1"), F.col("to").alias("concept_id_2"), F.lit("Maps to").alias("relationship_id"))
        replaced = p.where("p_size = 1").join(good, "p_name").select(F.col("leaf_id").alias("concept_id_1"), F.col("to").alias("concept_id_2"), F.lit("Concept replaced by").alias("relationship_id"))
        direct = self.is_a.select(F.col("child").alias("concept_id_1"), F.col("parent").alias("concept_id_2"), F.lit("Is a").alias("relationship_id"))
        return direct.unionByName(maps).unionByName(replaced).persist(KEPT)

    def events(self, domain: str) -> DataFrame:
        """person_id, concept_id, start_date, end_date and, where the domain has them, value columns."""
        return {"Drug": self.drug_exposure, "Condition": self.condition_occurrence, "Procedure": self.procedure_occurrence, "Measurement": self.measurement}[domain]


def _case(col: str, mapping: dict) -> str:
    return "CASE " + " ".join(f"WHEN {col} = '{k}' THEN {v}" for k, v in mapping.items()) + " END"


SQL = {
    "person": f"SELECT c_custkey AS person_id, CAST(1930 + c_custkey % 60 AS INTEGER) AS year_of_birth, CASE WHEN c_custkey % 2 = 0 THEN {MALE} ELSE {FEMALE} END AS gender_concept_id, c_nationkey AS race_concept_id FROM customer",
    "drug_exposure": f"SELECT o_custkey AS person_id, {LEAF} + l_partkey AS concept_id, CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) + CAST(l_quantity AS INTEGER) AS end_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "procedure_occurrence": f"SELECT o_custkey AS person_id, CAST({PROCEDURE} + ascii(l_returnflag) * 100 + ascii(l_linestatus) AS BIGINT) AS concept_id, CAST(l_shipdate AS DATE) AS start_date, CAST(l_shipdate AS DATE) AS end_date FROM lineitem JOIN orders ON l_orderkey = o_orderkey",
    "condition_occurrence": f"SELECT o_custkey AS person_id, {CONDITION} + CAST(left(o_orderpriority, 1) AS BIGINT) AS concept_id, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) AS end_date FROM orders",
    "measurement": f"SELECT o_custkey AS person_id, CAST({MEASURE} + {_case('o_orderstatus', STATUS_CODE)} AS BIGINT) AS concept_id, CAST(o_orderdate AS DATE) AS start_date, CAST(o_orderdate AS DATE) AS end_date, o_totalprice AS value_as_number, CAST({_case('o_orderstatus', STATUS_UNIT)} AS BIGINT) AS unit_concept_id, {RANGE_LOW}::DOUBLE AS range_low, {RANGE_HIGH}::DOUBLE AS range_high FROM orders",
    "observation": f"SELECT user_id AS person_id, CAST({OBSERVED} + {_case('event_type', KINDS)} AS BIGINT) AS concept_id, ts, value AS value_as_number FROM events",
    "observation_period": "SELECT person_id, min(start_date) AS start_date, max(end_date) AS end_date FROM (SELECT person_id, start_date, end_date FROM drug_exposure UNION ALL SELECT person_id, start_date, end_date FROM condition_occurrence) GROUP BY person_id",
    "parts": f"SELECT {LEAF} + p_partkey AS leaf_id, p_partkey, p_name, p_size, p_brand, {BRAND} + CAST(regexp_extract(p_brand, '(\\d+)', 1) AS BIGINT) AS brand_id, p_type, type_id FROM part JOIN (SELECT p_type, {TYPE} + row_number() OVER (ORDER BY p_type) AS type_id FROM (SELECT DISTINCT p_type FROM part)) USING (p_type)",
    "concept": f"""SELECT leaf_id AS concept_id, p_name AS concept_name, 'Drug' AS domain_id, CASE WHEN p_partkey % 2 = 0 THEN 'RxNorm' ELSE 'NDC' END AS vocabulary_id, 'Clinical Drug' AS concept_class_id, CASE WHEN p_size <> 2 THEN 'S' END AS standard_concept, CASE WHEN p_size = 1 THEN 'D' END AS invalid_reason FROM parts
        UNION ALL SELECT DISTINCT brand_id, p_brand, 'Drug', 'RxNorm', 'Brand Name', 'S', NULL FROM parts UNION ALL SELECT DISTINCT type_id, p_type, 'Drug', 'RxNorm', 'Ingredient', 'S', NULL FROM parts UNION ALL SELECT {ROOT}, 'any drug', 'Drug', 'RxNorm', 'Class', 'S', NULL""",
    "is_a": f"SELECT leaf_id AS child, brand_id AS parent FROM parts UNION ALL SELECT leaf_id, type_id FROM parts UNION ALL SELECT DISTINCT brand_id, {ROOT} FROM parts UNION ALL SELECT DISTINCT type_id, {ROOT} FROM parts",
    "concept_ancestor": f"SELECT parent AS ancestor_concept_id, child AS descendant_concept_id, 1 AS min_levels_of_separation FROM is_a UNION ALL SELECT {ROOT}, leaf_id, 2 FROM parts UNION ALL SELECT concept_id, concept_id, 0 FROM concept",
    "concept_relationship": "SELECT child AS concept_id_1, parent AS concept_id_2, 'Is a' AS relationship_id FROM is_a UNION ALL SELECT p.leaf_id, g.t, CASE WHEN p_size = 2 THEN 'Maps to' ELSE 'Concept replaced by' END FROM parts p JOIN (SELECT p_name, min(leaf_id) AS t FROM parts WHERE p_size NOT IN (1, 2) GROUP BY p_name) g USING (p_name) WHERE p_size IN (1, 2)",
}


def sql(body: str) -> str:
    """body after the views it can name, as one statement (unused ones cost nothing)."""
    views = ", ".join(f"{k} AS ({v})" for k, v in SQL.items())
    body = body.strip()
    return f"WITH {views}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {views} {body}"
