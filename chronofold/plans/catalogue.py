"""The registered queries with their SQL.

SHARED holds queries that both engines run from the same text; PAIRED holds a DataFrame function and the SQL it equals.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions import jsonops, scalar
from chronofold.operators import eventlog as log
from chronofold.operators import relational as rel
from chronofold.plans.builder import Query as Builder
from chronofold.plans.database import Database
from chronofold.plans.sqlfront import Engine
from chronofold.plans.text import hide, words
from chronofold.policy import access, anonymize, builtin, classify, compliance, export, masking
from chronofold.sources.catalog import TABLES, open_catalog, read_table

Q = Callable[[SparkSession, str], DataFrame]

SHARED: dict[str, str] = {
    "flagship": """SELECT c_mktsegment, o_orderpriority, COUNT(*) AS n_orders, COUNT(*) FILTER (WHERE o_orderstatus = 'F') AS n_filled, ROUND(SUM(o_totalprice), 2) AS revenue
        FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 1000 GROUP BY c_mktsegment, o_orderpriority HAVING COUNT(*) > 1 ORDER BY revenue DESC LIMIT 20""",
    "s1_point_lookup": "SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey = 7",
    "s2_range_scan": "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderkey >= 100 AND o_orderkey < 200 AND o_orderstatus <> 'F' ORDER BY o_orderkey DESC",
    "s3_index_scan": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey = 11 AND o_totalprice > 0",
    "s4_table_scan": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 45 AND l_discount < 0.05",
    "s9_stream_length": "SELECT COUNT(*) AS n FROM events",
    "f1_project_reorder": "SELECT c_name, c_custkey FROM customer",
    "f2_alias": "SELECT c_custkey AS id, c_acctbal AS balance FROM customer",
    "f3_qualified": "SELECT customer.c_custkey, customer.c_name FROM customer WHERE customer.c_custkey < 50",
    "f4_scalar_projection": "SELECT c_custkey, UPPER(c_name) AS u, c_name || '-' || c_mktsegment AS j FROM customer",
    "f5_searched_case": "SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN 'debt' WHEN c_acctbal < 1000 THEN 'low' ELSE 'ok' END AS level FROM customer",
    "f6_simple_case": "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 2 ELSE 0 END AS code FROM orders",
    "f7_comparisons": "SELECT o_orderkey FROM orders WHERE o_totalprice >= 1000 AND o_totalprice <= 5000 AND o_orderkey > 3",
    "f8_not_equal": "SELECT o_orderkey FROM orders WHERE o_orderstatus != 'O'",
    "f9_scalar_comparison": "SELECT c_custkey FROM customer WHERE LENGTH(c_name) + 1 > LENGTH(c_mktsegment) * 2",
    "f10_and_or": "SELECT p_partkey FROM part WHERE (p_size < 5 OR p_size > 45) AND (p_retailprice > 1000 OR p_brand = 'Brand#1')",
    "f11_in_list": "SELECT o_orderkey FROM orders WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')",
    "f13_between": "SELECT p_partkey FROM part WHERE p_size BETWEEN 10 AND 20",
    "f14_not_between": "SELECT p_partkey FROM part WHERE p_size NOT BETWEEN 10 AND 20",
    "f15_like": "SELECT p_partkey, p_name FROM part WHERE p_name LIKE '%a%' AND p_type NOT LIKE '_x%'",
    "f16_ilike": "SELECT p_partkey FROM part WHERE p_name ILIKE '%A%' AND p_name NOT ILIKE 'B%'",
    "f17_is_null": "SELECT doc_id FROM documents WHERE lang IS NOT NULL AND (source IS NULL OR doc_id >= 0)",
    "f20_always": "SELECT r_regionkey FROM region WHERE 1 = 1 AND NOT (1 = 2)",
    "f22_column_column": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount > l_tax",
    "j1_inner": "SELECT o_orderkey, c_name FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 5000",
    "j2_left": "SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
    "j3_right": "SELECT o_orderkey, c_custkey FROM orders RIGHT JOIN customer ON o_custkey = c_custkey",
    "j4_full": "SELECT s_suppkey, c_custkey FROM supplier FULL OUTER JOIN customer ON s_suppkey = c_custkey",
    "j5_cross": "SELECT n_name, r_name FROM nation CROSS JOIN region",
    "j6_theta": "SELECT n_nationkey, r_regionkey FROM nation JOIN region ON n_regionkey < r_regionkey",
    "j9_multiway": """SELECT r_name, COUNT(*) AS n, ROUND(SUM(o_totalprice), 2) AS total FROM region JOIN nation ON r_regionkey = n_regionkey
        JOIN customer ON n_nationkey = c_nationkey JOIN orders ON c_custkey = o_custkey GROUP BY r_name""",
    "j10_join_composed": "SELECT c_mktsegment, CASE WHEN o_totalprice > 100000 THEN 'big' ELSE 'small' END AS kind, o_orderkey FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 50 OFFSET 5",
    "j11_semi_in": "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "j13_exists_uncorrelated": "SELECT r_name FROM region WHERE EXISTS (SELECT 1 FROM nation WHERE n_nationkey > 20)",
    "j14_exists_correlated": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "j15_exists_theta": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > c_acctbal * 20)",
    "a1_group_by": "SELECT l_returnflag, l_linestatus, COUNT(*) AS n, ROUND(SUM(l_quantity), 2) AS qty FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "a2_a3_counts": "SELECT COUNT(*) AS n, COUNT(source) AS n_source, COUNT(DISTINCT source) AS n_distinct FROM documents",
    "a4_sum_bigint": "SELECT o_orderstatus, CAST(SUM(o_custkey) AS BIGINT) AS s FROM orders GROUP BY o_orderstatus",
    "a5_avg": "SELECT o_orderpriority, ROUND(AVG(o_totalprice), 4) AS a FROM orders GROUP BY o_orderpriority",
    "a6_min_max": "SELECT c_mktsegment, MIN(c_name) AS lo, MAX(c_name) AS hi, MIN(c_acctbal) AS b FROM customer GROUP BY c_mktsegment",
    "a7_filter": "SELECT l_returnflag, COUNT(*) FILTER (WHERE l_quantity > 25) AS many, ROUND(SUM(l_extendedprice) FILTER (WHERE l_discount > 0.05), 2) AS cut FROM lineitem GROUP BY l_returnflag",
    "a8_empty_global": "SELECT COUNT(*) AS n, CAST(SUM(o_custkey) AS BIGINT) AS s, MIN(o_orderkey) AS lo FROM orders WHERE o_orderkey < 0",
    "a9_having": "SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey HAVING COUNT(*) >= 12 AND MAX(o_totalprice) > 1000",
    "a10_distinct": "SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders",
    "a12_having_global": "SELECT COUNT(*) AS n FROM orders HAVING COUNT(*) > 10",
    "w1_w3_ranks": "SELECT o_orderkey, CAST(ROW_NUMBER() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS rn, CAST(RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS rk, CAST(DENSE_RANK() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority) AS BIGINT) AS dr FROM orders",
    "w4_w5_lag_lead": "SELECT event_id, LAG(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before, LEAD(event_id, 2) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS after2 FROM events",
    "w6_first_value": "SELECT event_id, FIRST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS first_type FROM events",
    "w7_last_value": "SELECT event_id, LAST_VALUE(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS last_type FROM events",
    "l1_l3_order_limit_offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 25 OFFSET 10",
    "l4_top_k": "SELECT l_orderkey, l_linenumber, l_extendedprice FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber LIMIT 10",
    "u1_union_all": "SELECT c_nationkey AS k FROM customer UNION ALL SELECT s_nationkey FROM supplier",
    "u2_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "u3_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "u4_intersect_all": "SELECT c_nationkey AS k FROM customer INTERSECT ALL SELECT s_nationkey FROM supplier",
    "u5_except": "SELECT p_partkey AS k FROM part EXCEPT SELECT l_partkey FROM lineitem WHERE l_quantity > 20",
    "u6_except_all": "SELECT c_nationkey AS k FROM customer EXCEPT ALL SELECT s_nationkey FROM supplier",
    "c1_with": "WITH big AS (SELECT o_custkey, SUM(o_totalprice) AS t FROM orders GROUP BY o_custkey), top AS (SELECT o_custkey FROM big WHERE t > 500000) SELECT c_custkey, c_name FROM customer JOIN top ON c_custkey = o_custkey",
    "c2_recursive_sql": "WITH RECURSIVE t(node) AS (SELECT p_partkey FROM part WHERE p_partkey > 0 AND p_partkey < 3 UNION SELECT p_partkey FROM part JOIN t ON FLOOR(p_partkey / 3) = node WHERE p_partkey > 0), big AS (SELECT node FROM t WHERE node > 4) SELECT node FROM big",
    "c3_derived_table": "SELECT s.seg, s.n FROM (SELECT c_mktsegment AS seg, COUNT(*) AS n FROM customer GROUP BY c_mktsegment) s WHERE s.n > 5",
    "c5_scalar_subquery": "SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT AVG(o_totalprice) * 2 FROM orders)",
    "x1_x3_case_length": "SELECT c_custkey, UPPER(c_name) AS u, LOWER(c_name) AS l, CAST(LENGTH(c_name) AS BIGINT) AS n FROM customer",
    "x5_concat": "SELECT c_custkey, c_name || NULLIF(c_mktsegment, 'BUILDING') AS j FROM customer",
    "x8_abs": "SELECT c_custkey, ABS(c_acctbal) AS a FROM customer",
    "x13_x14_coalesce_nullif": "SELECT c_custkey, COALESCE(NULLIF(c_mktsegment, 'BUILDING'), 'none') AS s FROM customer",
    "x15_cast": "SELECT o_orderkey, CAST(o_orderkey AS VARCHAR(20)) AS t, CAST(CAST(o_custkey AS VARCHAR(20)) AS BIGINT) AS k, CAST(o_custkey AS INT) AS i FROM orders",
}


def _t(*names: str):
    def wrap(f: Callable[..., DataFrame]) -> Q:
        return lambda spark, sf_dir: f(*[read_table(spark, sf_dir, n) for n in names])

    return wrap


def _changes(events: DataFrame) -> DataFrame:
    """events as a change log keyed by user_id, in the order of event_id, the stream's own offset: some insert, update or delete."""
    kind = F.when(F.col("event_id") % 11 == 0, "delete").when(F.col("event_id") % 3 == 0, "insert").otherwise("update")
    return events.select("user_id", F.col("event_id").alias("offset"), "ts", "event_type", "value", "event_id", kind.alias("kind"), (F.col("event_id") % 5 != 1).alias("was_set_event_type"), (F.col("event_id") % 2 == 0).alias("was_set_value"))


CHANGES_SQL = """SELECT *, event_id AS "offset", CASE WHEN event_id % 11 = 0 THEN 'delete' WHEN event_id % 3 = 0 THEN 'insert' ELSE 'update' END AS kind,
  event_id % 5 <> 1 AS set_t, event_id % 2 = 0 AS set_v FROM events"""
FOLD_SQL = """WITH c AS ({changes}), s AS (SELECT *, max(CASE WHEN kind IN ('insert', 'delete') THEN "offset" END) OVER (PARTITION BY user_id) AS start FROM c {where}),
 l AS (SELECT * FROM s WHERE "offset" >= start)
 SELECT user_id, arg_max(event_type, "offset") FILTER (WHERE set_t) AS event_type, arg_max(value, "offset") FILTER (WHERE set_v) AS value FROM l
 GROUP BY user_id HAVING arg_min(kind, "offset") <> 'delete'"""


def _fold(events: DataFrame, upto: int | None = None) -> DataFrame:
    changes = _changes(events)
    changes = changes if upto is None else log.as_of_offset(changes, upto)
    return log.current_view(changes, ["user_id"], ["event_type", "value"])


def _travel(text: str) -> Q:
    """A statement over the versions of the change log, with its commit index."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        changes = _changes(read_table(spark, sf_dir, "events"))
        kept = log.versions(changes, ["user_id"]).select("user_id", "event_type", "value", "_from", "_to")
        commits = log.commit_index(changes.select("offset", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("commit_ns")), [])
        return Engine(spark, open_catalog(spark, sf_dir, "region"), {"profiles": kept}, commits).sql(text)

    return run


VISIBLE_SQL = """WITH c AS ({changes}), v AS (SELECT *, lead("offset", 1, 9223372036854775807) OVER (PARTITION BY user_id ORDER BY "offset") AS nxt FROM c), h AS (SELECT {at} AS h)
 SELECT user_id, event_type FROM v, h WHERE kind <> 'delete' AND "offset" <= h AND h < nxt"""


def _recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read_table(spark, sf_dir, "part")
    edges = part.select(F.col("p_partkey").alias("child"), F.floor(F.col("p_partkey") / 3).cast("long").alias("parent"))
    start = edges.filter("parent = 0 and child > 0").select(F.col("child").alias("node"))
    return rel.fixpoint(start, lambda new: edges.join(new, F.col("parent") == F.col("node")).filter("child > 0").select(F.col("child").alias("node")))


def _database(load: dict[str, list[str]], *statements: str, then: str | None = None, role: str | None = None) -> Q:
    """Statements on a database that starts with whole tables: the rows that then, or the last statement, gives."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        db = Database(spark)
        for name, key in load.items():
            df = read_table(spark, sf_dir, name)
            db.load(name, df, key)
        out = None
        for text in statements:
            out = db.execute(text)
        db.role = role
        return db.sql(then) if then else out

    return run


def _erase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subject erased from all classified tables that have its column, twice: (table_name, kept, erased)."""
    db = Database(spark)
    db.load("customer", read_table(spark, sf_dir, "customer").withColumnRenamed("c_custkey", "subject"), ["subject"])
    db.load("orders", read_table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "subject"), ["o_orderkey"])
    db.load("supplier", read_table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "subject"), ["subject"])
    db.execute("ALTER TABLE customer MODIFY COLUMN c_name SET CLASSIFICATION 'PII'")
    db.execute("ALTER TABLE orders MODIFY COLUMN o_orderstatus SET CLASSIFICATION 'Sensitive'")
    receipts = db.erase("subject", 7).unionByName(db.erase("subject", 7)).groupBy("table_name").agg(F.sum("erased").alias("erased"))
    left = reduce(DataFrame.unionByName, [db.current(t).agg(F.count(F.lit(1)).alias("kept")).withColumn("table_name", F.lit(t)) for t in ("customer", "orders", "supplier")])
    return left.join(receipts, "table_name", "left").select("table_name", "kept", F.coalesce("erased", F.lit(0)).alias("erased"))


CUSTOMER = {"customer": ["c_custkey"]}
ROLE = ("CREATE ROLE clerk", "CREATE USER ann WITH ROLE clerk", "GRANT SELECT (c_custkey, c_name, c_nationkey) ON customer TO clerk", "GRANT SELECT ON orders TO clerk",
        "CREATE MASKING POLICY names STRATEGY TRUNCATE 9 EXEMPT ROLES (auditor)", "ALTER TABLE customer ALTER COLUMN c_name SET MASKING POLICY names")


def _secured(text: str) -> Q:
    """A statement of a role that sees two nations' customers, and not their balances."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        policy = access.AccessPolicy("clerk", ["customer", "orders"], deny_columns=["c_acct*"], row_filters=[("c_nationkey", "IN", [1, 2])])
        return Engine(spark, open_catalog(spark, sf_dir, "customer", "orders", "supplier"), policy=policy).sql(text)

    return run


def _params(spark: SparkSession, sf_dir: str) -> DataFrame:
    engine = Engine(spark, open_catalog(spark, sf_dir, "orders"))
    text, values = Builder("orders").select("o_orderkey", "o_totalprice").where("o_totalprice", "gt", 1000.0).where("o_orderstatus", "eq", "F").order_by("o_orderkey").limit(40).build()
    return engine.sql(text, values)


def _meta(text: str, *names: str) -> Q:
    return lambda spark, sf_dir: Engine(spark, open_catalog(spark, sf_dir, *names)).sql(text)


def _masks(c: DataFrame) -> DataFrame:
    ssn = F.concat(F.lpad(F.pmod("c_custkey", F.lit(899)).cast("string"), 3, "1"), F.lit("-45-"), F.lpad(F.pmod("c_custkey", F.lit(9999)).cast("string"), 4, "0"))
    mail = F.concat(F.lower("c_mktsegment"), F.lit("@example.com"))
    rows = c.select("c_custkey", ssn.alias("ssn"), mail.alias("mail"), F.concat(F.lit("555-123-"), F.lpad(F.pmod("c_custkey", F.lit(9999)).cast("string"), 4, "0")).alias("phone"), "c_name")
    masks = masking.MaskRegistry()
    for name, strategy, argument, column in (("m1", "REDACT_SSN", None, "ssn"), ("m2", "REDACT_EMAIL", None, "mail"), ("m3", "REDACT_PHONE", None, "phone"), ("m4", "TRUNCATE", 6, "c_name")):
        masks.create(name, strategy, argument, exempt=("dpo",))
        masks.attach("people", column, name)
    return masks.secure("people", rows, "analyst")


def _chain(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("offset"), F.lit("0").alias("kind"), F.col("event_type").alias("payload"))
    built = log.build_chain(rows, ["stream_id"])
    return log.broken_links(built, ["stream_id"]).agg(F.count(F.lit(1)).alias("broken")).crossJoin(built.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("hash").alias("hashes")))


def _verified(events: DataFrame) -> DataFrame:
    rows = events.select(F.col("user_id").alias("stream_id"), F.col("event_id").alias("offset"), F.lit("0").alias("kind"), F.col("event_type").alias("payload"))
    return log.verified(log.build_chain(rows, ["stream_id"]), ["stream_id"]).drop("kind")


def _longest_stay(kinds) -> int:
    """The longest run of equal event types: a reducer that keeps state from event to event."""
    longest = n = 0
    last = None
    for kind in kinds:
        n, last = (n + 1 if kind == last else 1), kind
        longest = max(longest, n)
    return longest


def _records(events: DataFrame) -> DataFrame:
    return events.select(F.col("user_id").alias("stream_id"), F.concat(F.lit('a "b" '), "event_type").alias("stream_name"), F.col("event_id").alias("offset"), F.col("props").alias("data"), F.date_format("ts", "yyyy-MM-dd").alias("timestamp"))


def _builtins(customer: DataFrame) -> DataFrame:
    """How each built-in policy decides on requests made from the customers."""
    countries = F.array(*[F.lit(x) for x in ("US", "DE", "AU", "JP")])
    classes = F.array(*[F.lit(x) for x in classify.ACCESS_ORDER])
    requests = customer.select(
        "c_custkey", (F.col("c_custkey") % 4).alias("clearance"), F.when(F.col("c_custkey") % 3 == 0, "Server").otherwise("Sales").alias("department"), F.element_at(classes, (F.col("c_custkey") % 8 + 1).cast("int")).alias("data_class"),
        F.element_at(countries, (F.floor(F.col("c_custkey") / 4) % 4 + 1).cast("int")).alias("country"), (F.col("c_custkey") % 24).alias("hour"), (F.col("c_custkey") % 7).alias("weekday"), (F.col("c_custkey") % 2 == 0).alias("correction_allowed"),
        (F.col("c_custkey") % 9 == 0).alias("legal_hold"), F.when(F.col("c_custkey") % 5 == 0, F.lit(2555)).otherwise(F.lit(30)).alias("retention_days"), F.when(F.col("c_custkey") % 6 == 0, F.array(F.lit("ssn"))).alias("requested_fields"),
    )
    parts = [access.decide(requests, builtin.builtin_policy(p)).select("c_custkey", F.lit(p).alias("policy"), "effect", F.coalesce("matched_rule", F.lit("none")).alias("matched_rule")) for p in builtin.POLICIES]
    return reduce(DataFrame.unionByName, parts)


WINDOW_SQL = """WITH RECURSIVE e AS (SELECT user_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
 w AS (SELECT user_id, i, ts, CASE WHEN 1 >= {limit} THEN NULL ELSE ts END AS start, CASE WHEN 1 >= {limit} THEN 0 ELSE 1 END AS n, 1 AS seen FROM e WHERE i = 1
  UNION ALL SELECT user_id, i, ts, CASE WHEN k >= {limit} THEN NULL ELSE s END, CASE WHEN k >= {limit} THEN 0 ELSE k END, k
  FROM (SELECT e.user_id, e.i, e.ts, CASE WHEN w.start IS NULL OR epoch_us(e.ts) - epoch_us(w.start) > {seconds} * 1000000::BIGINT THEN e.ts ELSE w.start END AS s,
        CASE WHEN w.start IS NULL OR epoch_us(e.ts) - epoch_us(w.start) > {seconds} * 1000000::BIGINT THEN 1 ELSE w.n + 1 END AS k FROM w JOIN e ON e.user_id = w.user_id AND e.i = w.i + 1))
 SELECT user_id, ts, seen::BIGINT AS count FROM w WHERE seen >= {limit}"""


def _abac(o: DataFrame) -> DataFrame:
    kinds = F.element_at(F.array(*[F.lit(x) for x in classify.ACCESS_ORDER]), (F.col("o_orderkey") % 8 + 1).cast("int"))
    requests = o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "admin").otherwise("user").alias("role"), kinds.alias("data_class"), F.hour("o_orderdate").alias("hour"), (F.dayofweek("o_orderdate") - 1).alias("weekday"))
    rules = [access.Rule("admin", "Allow", 10, [access.condition("role", "admin")]), access.Rule("phi", "Deny", 20, [~access.condition("class_at_most", "Sensitive")]), access.Rule("public", "Allow", 1, [access.condition("class_at_most", "Deidentified"), ~access.condition("business_hours")])]
    return access.decide(requests, rules).select("o_orderkey", "effect", F.coalesce("matched_rule", F.lit("none")).alias("matched_rule"))


CLASSES_SQL = "['Public', 'Deidentified', 'Confidential', 'Financial', 'PII', 'PCI', 'Sensitive', 'PHI']"

EMAIL_SQL = r"regexp_matches(text, '(^|\s)[^\s@]+@\S*\.\S{2,}|(^|\s)[^\s@]+@\S{2,}\.\S*|(^|\s)[^\s@]+@\S\.\S')"
VERDICT_SQL = f"""WITH m AS (SELECT doc_id, {" + ".join(f"contains(lower(text), '{t}')::INT" for t in classify.MEDICAL_TERMS)} AS med, {" + ".join(f"contains(lower(text), '{t}')::INT" for t in classify.FINANCIAL_TERMS)} AS fin,
  regexp_matches(text, '[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}') AS ssn, regexp_matches(text, '[0-9](?:[ -]*[0-9]){{12}}') AS card, {EMAIL_SQL} AS mail FROM documents),
 p AS (SELECT *, list_filter([CASE WHEN ssn THEN 'ssn_pattern' END, CASE WHEN card THEN 'credit_card_pattern' END, CASE WHEN mail THEN 'email_pattern' END,
  CASE WHEN med >= 2 THEN 'medical_terms(' || med || ')' END, CASE WHEN fin >= 2 THEN 'financial_terms(' || fin || ')' END], lambda x: x IS NOT NULL) AS found FROM m)
 SELECT doc_id, CASE WHEN med >= 2 THEN 'PHI' WHEN card THEN 'PCI' WHEN fin >= 2 THEN 'Financial' WHEN ssn OR mail THEN 'PII' ELSE 'Confidential' END AS data_class,
  CASE WHEN len(found) = 0 THEN 0.6 ELSE round(0.7 + least(len(found) * 0.05, 0.2), 4) END::DOUBLE AS confidence, array_to_string(found, ',') AS patterns FROM p"""

#: Conditions of the built-in policies' first and second rules over the requests that _builtins makes.
_EU, _HOURS = "c_custkey // 4 % 4 = 1", "c_custkey % 24 BETWEEN 9 AND 16 AND c_custkey % 7 NOT IN (0, 6)"
_US, _AU = "c_custkey // 4 % 4 = 0", "c_custkey // 4 % 4 = 2"
BUILTIN_CASES = {
    "hipaa": [("hipaa-phi-access", "Allow", f"c_custkey % 4 >= 2 AND {_HOURS}"), ("hipaa-non-phi-access", "Allow", "c_custkey % 8 <= 2")],
    "fedramp": [("fedramp-us-only", "Deny", f"NOT {_US}"), ("fedramp-allow-us", "Allow", _US)],
    "pci": [("pci-server-access", "Allow", "c_custkey % 4 >= 2 AND c_custkey % 3 = 0"), ("pci-non-pci-access", "Allow", "c_custkey % 8 <= 2")],
    "hitech": [("hitech-phi-minimum-necessary", "Allow", f"c_custkey % 4 >= 2 AND {_HOURS} AND c_custkey % 6 <> 0"), ("hitech-non-phi-access", "Allow", "c_custkey % 8 <= 2")],
    "cfr21_part11": [("cfr21-electronic-records", "Allow", "c_custkey % 4 = 3"), ("cfr21-read-access", "Allow", "c_custkey % 4 >= 2")],
    "sox": [("sox-financial-access", "Allow", "c_custkey % 4 >= 2 AND c_custkey % 5 = 0"), ("sox-non-financial-access", "Allow", "c_custkey % 8 <= 2")],
    "glba": [("glba-financial-us-only", "Allow", f"c_custkey % 4 >= 2 AND {_US}"), ("glba-non-financial-access", "Allow", "c_custkey % 8 <= 2")],
    "ccpa": [("ccpa-pii-access", "Allow", "c_custkey % 4 >= 1 AND c_custkey % 2 = 0"), ("ccpa-non-pii-access", "Allow", "c_custkey % 8 <= 2")],
    "ferpa": [("ferpa-student-data", "Allow", f"c_custkey % 4 >= 2 AND {_HOURS}"), ("ferpa-non-pii-access", "Allow", "c_custkey % 8 <= 2")],
    "nist_800_53": [("nist-sensitive-us-only", "Allow", f"c_custkey % 4 >= 2 AND {_US}"), ("nist-public-access", "Allow", "c_custkey % 8 = 0")],
    "cmmc": [("cmmc-controlled-us-only", "Allow", f"c_custkey % 4 >= 2 AND {_US}"), ("cmmc-public-access", "Allow", "c_custkey % 8 = 0")],
    "legal": [("legal-hold-block-deletion", "Deny", "c_custkey % 9 = 0"), ("legal-confidential-access", "Allow", "c_custkey % 4 >= 2")],
    "nis2": [("nis2-eu-access", "Allow", _EU)],
    "dora": [("dora-financial-eu-only", "Allow", f"c_custkey % 4 >= 2 AND {_EU}"), ("dora-non-financial-eu", "Allow", _EU)],
    "eidas": [("eidas-qualified-signatures", "Allow", _EU), ("eidas-basic-eu-access", "Allow", _EU)],
    "gdpr": [("gdpr-pii-access", "Allow", f"c_custkey % 4 >= 1 AND {_EU} AND c_custkey % 2 = 0"), ("gdpr-non-pii-eu", "Allow", _EU)],
    "iso27001": [("iso27001-confidential-access", "Allow", f"c_custkey % 4 >= 2 AND {_HOURS}"), ("iso27001-public-access", "Allow", "c_custkey % 8 = 0")],
    "aus_privacy": [("aus-privacy-pii-access", "Allow", f"c_custkey % 4 >= 1 AND {_AU} AND c_custkey % 2 = 0"), ("aus-privacy-non-pii", "Allow", _AU)],
    "apra_cps234": [("apra-financial-au-only", "Allow", f"c_custkey % 4 >= 2 AND {_AU}"), ("apra-non-financial-au", "Allow", _AU)],
}


def _cases(rules: list[tuple[str, str, str]], at: int, otherwise: str) -> str:
    return "CASE " + " ".join(f"WHEN {r[2]} THEN '{r[at]}'" for r in rules) + f" ELSE '{otherwise}' END"


BUILTIN_SQL = " UNION ALL ".join(f"SELECT c_custkey, '{p}' AS policy, {_cases(r, 1, 'Deny')} AS effect, {_cases(r, 0, 'none')} AS matched_rule FROM customer" for p, r in BUILTIN_CASES.items())

PAIRED: dict[str, tuple[Q, str | None]] = {
    "f12_not_in_null_tolerant": (_t("orders")(lambda o: o.filter(rel.not_in_list(F.col("o_orderstatus"), ["F", None])).select("o_orderkey")), "SELECT o_orderkey FROM orders WHERE o_orderstatus IS NOT NULL AND o_orderstatus <> 'F'"),
    "f21_parameters": (_params, "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 40"),
    "j7_using": (_t("customer", "supplier")(lambda c, s: rel.join_using(c.select(F.col("c_nationkey").alias("k"), "c_custkey"), s.select(F.col("s_nationkey").alias("k"), "s_suppkey"), ["k"])), "SELECT c_nationkey AS k, c_custkey, s_nationkey AS k_right, s_suppkey FROM customer JOIN supplier ON c_nationkey = s_nationkey"),
    "j12_anti_not_in": (_t("customer", "orders")(lambda c, o: rel.anti_not_in(c, "c_custkey", o.filter("o_totalprice > 50000"), "o_custkey").select("c_custkey")), "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 50000)"),
    "c2_recursive": (_recursive, "WITH RECURSIVE t(node) AS (SELECT p_partkey FROM part WHERE p_partkey // 3 = 0 AND p_partkey > 0 UNION SELECT p_partkey FROM part JOIN t ON p_partkey // 3 = node WHERE p_partkey > 0) SELECT node FROM t"),
    "x4_trim": (_t("documents")(lambda d: d.select("doc_id", F.md5(scalar.trim_space(F.concat(F.lit("\t \n"), F.col("text"), F.lit(" \r\n")))).alias("t"))), r"SELECT doc_id, md5(regexp_replace(chr(9) || ' ' || chr(10) || text || ' ' || chr(13) || chr(10), '^\s+|\s+$', '', 'g')) AS t FROM documents"),
    "x7_substring": (_t("part")(lambda p: p.select("p_partkey", *[scalar.substring_clip(F.col("p_name"), s, n).alias(f"s{i}") for i, (s, n) in enumerate([(2, 3), (0, 3), (-1, 3), (3, 100)])])), "SELECT p_partkey, substring(p_name, 2, 3) AS s0, substring(p_name, 1, 2) AS s1, substring(p_name, 1, 1) AS s2, substring(p_name, 3, 100) AS s3 FROM part"),
    "x9_x10_round": (_t("part")(lambda p: p.select("p_partkey", F.round("p_retailprice").alias("r0"), F.round("p_retailprice", 1).alias("r1"))), "SELECT p_partkey, round(p_retailprice) AS r0, round(p_retailprice, 1) AS r1 FROM part"),
    "x11_x12_ceil_floor": (_t("customer")(lambda c: c.select("c_custkey", scalar.ceil_keep(F.col("c_acctbal")).alias("c"), scalar.floor_keep(F.col("c_acctbal")).alias("f"))), "SELECT c_custkey, ceil(c_acctbal) AS c, floor(c_acctbal) AS f FROM customer"),
    "x15e_number_to_text": (_t("lineitem")(lambda l: l.select("l_orderkey", "l_linenumber", scalar.number_to_text(F.col("l_quantity")).alias("t"))), "SELECT l_orderkey, l_linenumber, CAST(CAST(l_quantity AS BIGINT) AS VARCHAR) AS t FROM lineitem"),
    "x16_mod": (_t("orders")(lambda o: o.select("o_orderkey", scalar.mod_null(F.col("o_custkey"), F.col("o_orderkey") % 4).alias("m"))), "SELECT o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_custkey % (o_orderkey % 4) END AS m FROM orders"),
    "x18_sqrt": (_t("part")(lambda p: p.select("p_partkey", F.round(scalar.sqrt_checked(F.col("p_retailprice")), 6).alias("s"))), "SELECT p_partkey, round(sqrt(p_retailprice), 6) AS s FROM part"),
    "x19_extract": (_t("events")(lambda e: e.select("event_id", *[scalar.extract(f, F.col("ts")).alias(f.lower()) for f in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DOW", "DOY", "QUARTER", "WEEK", "EPOCH", "MICROSECOND", "MILLISECOND")])),
        "SELECT event_id, " + ", ".join(f"CAST(extract({f} FROM ts) AS BIGINT) AS {f.lower()}" for f in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND", "DOW", "DOY", "QUARTER", "WEEK")) + ", epoch_us(ts) // 1000000 AS epoch, epoch_us(ts) % 1000000 AS microsecond, (epoch_us(ts) % 1000000) // 1000 AS millisecond FROM events"),
    "x20_date_trunc": (_t("orders")(lambda o: o.select("o_orderkey", scalar.date_trunc_keep("MONTH", F.col("o_orderdate").cast("date"), True).alias("m"), F.date_format(scalar.date_trunc_keep("HOUR", F.col("o_orderdate").cast("timestamp_ntz"), False), "yyyy-MM-dd HH:mm:ss").alias("h"))), "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS m, strftime(date_trunc('hour', o_orderdate), '%Y-%m-%d %H:%M:%S') AS h FROM orders"),
    "x21_x22_now": (_t("region")(lambda r: r.select("r_regionkey", (F.current_timestamp() >= F.lit("2020-01-01").cast("timestamp")).alias("after"), (F.current_date() >= F.lit("2020-01-01").cast("date")).alias("today"))), "SELECT r_regionkey, now() >= TIMESTAMPTZ '2020-01-01' AS after, current_date >= DATE '2020-01-01' AS today FROM region"),
    "json_get_text": (_t("events")(lambda e: e.select("event_id", jsonops.get_text(F.col("props"), "k").alias("k"))), "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events"),
    "json_contains": (_t("events")(lambda e: e.select("event_id", jsonops.contains(F.concat(F.lit('{"a":{"n":'), (F.col("event_id") % 3).cast("string"), F.lit(',"l":[1,2]}}')), {"a": {"n": 1, "l": [2]}}).alias("c"))), "SELECT event_id, event_id % 3 = 1 AS c FROM events"),
    "s5_time_travel_offset": (_travel("SELECT user_id, event_type FROM profiles AT OFFSET 500"), VISIBLE_SQL.format(changes=CHANGES_SQL, at="500")),
    "s6_as_of_timestamp": (_travel("SELECT user_id, event_type FROM profiles FOR SYSTEM_TIME AS OF '2024-01-15T00:00:00Z'"), VISIBLE_SQL.format(changes=CHANGES_SQL, at="(SELECT max(event_id) FROM events WHERE ts <= TIMESTAMP '2024-01-15')")),
    "s5_join_at_offset": (_travel("SELECT a.user_id, COUNT(*) AS n FROM profiles AT OFFSET 900 a JOIN profiles AT OFFSET 500 b ON a.event_type = b.event_type WHERE a.event_type <> 'AT OFFSET 7' GROUP BY a.user_id"),
        f"""WITH p AS ({VISIBLE_SQL.format(changes=CHANGES_SQL, at="900")}), q AS ({VISIBLE_SQL.format(changes=CHANGES_SQL, at="500")}) SELECT p.user_id, count(*) AS n FROM p JOIN q ON p.event_type = q.event_type GROUP BY p.user_id"""),
    "s7_commit_index": (_t("events")(lambda e: log.commit_index(_changes(e).select("offset", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 600_000_000).cast("long").alias("commit_ns")), [], 1024).select("offset", "commit_ns")),
        """WITH c AS (SELECT event_id AS "offset", row_number() OVER (ORDER BY event_id) AS i, CAST(floor(epoch_us(ts) / 600000000.0) AS BIGINT) AS ns FROM events) SELECT "offset", CAST(max(ns - i) OVER (ORDER BY i ROWS UNBOUNDED PRECEDING) + i AS BIGINT) AS commit_ns FROM c"""),
    "s8_read_events": (_t("events")(lambda e: log.read_from(e.select(F.lit("s").alias("stream_id"), F.col("event_id").alias("offset"), F.col("event_type").alias("payload")), "s", 100, 500).select("offset", "payload")),
        """SELECT "offset", payload FROM (SELECT event_id AS "offset", event_type AS payload, sum(strlen(event_type)) OVER (ORDER BY event_id) AS b FROM events WHERE event_id >= 100) WHERE b <= 500"""),
    "d12_current_view": (_t("events")(_fold), FOLD_SQL.format(changes=CHANGES_SQL, where="")),
    "d12_view_at_offset": (_t("events")(lambda e: _fold(e, 700)), FOLD_SQL.format(changes=CHANGES_SQL, where='WHERE "offset" <= 700')),
    "d13_versions": (_t("events")(lambda e: log.versions(_changes(e), ["user_id"]).select("user_id", "_from", "_to")), f"""SELECT * FROM (SELECT user_id, "offset" AS _from, lead("offset", 1, 9223372036854775807) OVER (PARTITION BY user_id ORDER BY "offset") AS _to, kind FROM ({CHANGES_SQL})) WHERE kind <> 'delete'""".replace("SELECT * FROM (SELECT user_id", "SELECT user_id, _from, _to FROM (SELECT user_id")),
    "d14_compact": (_t("events")(lambda e: log.compact(log.versions(_changes(e), ["user_id"]), 800).select("user_id", "_from")), f"""SELECT user_id, _from FROM (SELECT user_id, "offset" AS _from, lead("offset", 1, 9223372036854775807) OVER (PARTITION BY user_id ORDER BY "offset") AS _to, kind FROM ({CHANGES_SQL})) WHERE kind <> 'delete' AND _to > 800"""),
    "d6_insert": (_database(CUSTOMER, "INSERT INTO customer (c_custkey, c_name, c_nationkey) VALUES (-1, 'It''s new', 3), (-2, NULL, 4)", then="SELECT * FROM customer"),
        "SELECT * FROM customer UNION ALL VALUES (-1, 'It''s new', 3, NULL, NULL), (-2, NULL, 4, NULL, NULL)"),
    "d7_do_nothing": (_database(CUSTOMER, "INSERT INTO customer SELECT c_custkey - 10, 'new', c_nationkey, 0.0, c_mktsegment FROM customer ON CONFLICT (c_custkey) DO NOTHING", then="SELECT c_custkey, c_name, c_acctbal FROM customer"),
        "SELECT c_custkey, c_name, c_acctbal FROM customer UNION ALL SELECT c_custkey - 10, 'new', 0.0 FROM customer WHERE c_custkey - 10 NOT IN (SELECT c_custkey FROM customer)"),
    "d8_do_update": (_database(CUSTOMER, "INSERT INTO customer SELECT c_custkey - 10, 'new', c_nationkey, 7.5, c_mktsegment FROM customer ON CONFLICT (c_custkey) DO UPDATE SET c_name = EXCLUDED.c_name, c_mktsegment = 'moved'", then="SELECT * FROM customer"),
        "SELECT c.c_custkey, CASE WHEN n.k IS NULL THEN c.c_name ELSE 'new' END AS c_name, c.c_nationkey, c.c_acctbal, CASE WHEN n.k IS NULL THEN c.c_mktsegment ELSE 'moved' END AS c_mktsegment FROM customer c LEFT JOIN (SELECT c_custkey - 10 AS k FROM customer) n ON c_custkey = k UNION ALL SELECT c_custkey - 10, 'new', c_nationkey, 7.5, c_mktsegment FROM customer WHERE c_custkey - 10 NOT IN (SELECT c_custkey FROM customer)"),
    "d8_upsert": (_t("customer")(lambda c: rel.upsert(c.select("c_custkey", "c_name", "c_acctbal"), c.select((F.col("c_custkey") + 10).alias("c_custkey"), F.lit("new").alias("c_name"), F.lit(0.0).alias("c_acctbal")), ["c_custkey"], ["c_name"])),
        "SELECT coalesce(c.c_custkey, n.k) AS c_custkey, CASE WHEN n.k IS NOT NULL THEN 'new' ELSE c_name END AS c_name, CASE WHEN c.c_custkey IS NULL THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer c FULL JOIN (SELECT c_custkey + 10 AS k FROM customer) n ON c.c_custkey = n.k"),
    "d9_update": (_database({"orders": ["o_orderkey"]}, "UPDATE orders SET o_orderstatus = 'X', o_totalprice = o_totalprice + 1 WHERE o_orderpriority = '5-LOW' AND o_totalprice > 1000", then="SELECT o_orderkey, o_orderstatus, ROUND(o_totalprice, 2) AS price FROM orders"),
        "SELECT o_orderkey, CASE WHEN u THEN 'X' ELSE o_orderstatus END AS o_orderstatus, round(o_totalprice + CASE WHEN u THEN 1 ELSE 0 END, 2) AS price FROM (SELECT *, o_orderpriority = '5-LOW' AND o_totalprice > 1000 AS u FROM orders)"),
    "d10_delete": (_database({"orders": ["o_orderkey"]}, "DELETE FROM orders WHERE o_orderstatus = 'F'", then="SELECT o_orderkey, o_orderstatus FROM orders"), "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus <> 'F'"),
    "d11_returning": (_database(CUSTOMER, "UPDATE customer SET c_acctbal = 0 WHERE c_acctbal < 0 RETURNING c_custkey, UPPER(c_name) AS n, c_acctbal"), "SELECT c_custkey, upper(c_name) AS n, 0.0 AS c_acctbal FROM customer WHERE c_acctbal < 0"),
    "d11_delete_returning": (_database(CUSTOMER, "DELETE FROM customer WHERE c_mktsegment = 'MACHINERY' RETURNING c_custkey, c_acctbal"), "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment = 'MACHINERY'"),
    "d1_d5_ddl": (_database({"nation": ["n_nationkey"]}, "CREATE TABLE notes (id BIGINT PRIMARY KEY, body TEXT NOT NULL, at TIMESTAMP)", "ALTER TABLE notes ADD COLUMN score DECIMAL(10, 2)", "ALTER TABLE notes DROP COLUMN at", "CREATE INDEX by_body ON notes (body)",
        "CREATE TABLE IF NOT EXISTS notes (x BIGINT PRIMARY KEY)", "INSERT INTO notes VALUES (1, 'a;b -- c', 2.5), (2, 'd', NULL)", "ALTER TABLE notes ADD COLUMN at TEXT", "CREATE TABLE gone (id BIGINT PRIMARY KEY)", "DROP TABLE gone", "DROP TABLE IF EXISTS gone",
        then="SELECT table_name, column_count, primary_key_count, (SELECT COUNT(*) FROM notes WHERE at IS NULL AND score > 2) AS n FROM information_schema.tables"), "SELECT * FROM (VALUES ('nation', 3::BIGINT, 1::BIGINT, 1::BIGINT), ('notes', 4, 1, 1)) t(table_name, column_count, primary_key_count, n)"),
    "d9_at_offset": (_database(CUSTOMER, "UPDATE customer SET c_name = 'later' WHERE c_nationkey < 5", "DELETE FROM customer WHERE c_nationkey = 7", then="SELECT c_custkey, c_name FROM customer AT OFFSET 20"), "SELECT c_custkey, c_name FROM (SELECT *, row_number() OVER (ORDER BY c_custkey) AS n FROM customer) WHERE n <= 21"),
    "d15_replay": (_t("events")(lambda e: log.replay_linear(e, ["user_id"], "event_id", F.when(F.col("event_type") == "purchase", F.col("event_id") % 100), F.when(F.col("event_type") == "error", -1).when(F.col("event_type") != "view", 1))),
        "WITH l AS (SELECT *, max(CASE WHEN event_type = 'purchase' THEN event_id END) OVER (PARTITION BY user_id) AS s FROM events) SELECT user_id, sum(CASE event_type WHEN 'purchase' THEN event_id % 100 WHEN 'error' THEN -1 WHEN 'view' THEN 0 ELSE 1 END)::BIGINT AS state FROM l WHERE s IS NULL OR event_id >= s GROUP BY user_id"),
    "d15_replay_general": (_t("events")(lambda e: log.replay(e.select("user_id", "event_id", "event_type"), ["user_id"], "event_id", lambda p: p.tail(1).assign(n=len(p), longest=_longest_stay(p["event_type"]))[["user_id", "n", "longest"]], "user_id long, n long, longest long")),
        "WITH g AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id) AS g FROM events), r AS (SELECT user_id, count(*) AS k FROM g GROUP BY user_id, event_type, g) SELECT user_id, sum(k)::BIGINT AS n, max(k)::BIGINT AS longest FROM r GROUP BY user_id"),
    "p4_p5_p9_masks": (_t("customer")(lambda c: c.select("c_custkey", masking.redact_card(F.concat(F.lit("4000-0000-0000-"), F.lpad(F.pmod("c_custkey", F.lit(9999)).cast("string"), 4, "0"))).alias("card"), masking.MaskPolicy("c", "REDACT_CUSTOM", "[hidden]").apply(F.col("c_name")).alias("name"), masking.MaskPolicy("n", "NULL").apply(F.col("c_mktsegment")).alias("segment"))),
        "SELECT c_custkey, '****-****-****-' || lpad((c_custkey % 9999)::VARCHAR, 4, '0') AS card, '[hidden]' AS name, NULL::VARCHAR AS segment FROM customer"),
    "p11_mask_through_engine": (_database({**CUSTOMER, "orders": ["o_orderkey"]}, *ROLE, then="SELECT UPPER(c_name) AS n, c_custkey FROM customer WHERE c_name LIKE 'Cust%...'", role="ann"), "SELECT 'CUSTOMER#...' AS n, c_custkey FROM customer"),
    "p20_rbac_cte": (_secured("WITH mine AS (SELECT * FROM customer) SELECT c_custkey, c_mktsegment, n FROM mine JOIN (SELECT o_custkey, COUNT(*) AS n FROM orders GROUP BY o_custkey) o ON o_custkey = c_custkey"),
        "SELECT c_custkey, c_mktsegment, n FROM customer JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey) ON o_custkey = c_custkey WHERE c_nationkey IN (1, 2)"),
    "p20_rbac_set_operation": (_secured("SELECT c_custkey AS k FROM customer UNION ALL SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer)"),
        "WITH c AS (SELECT * FROM customer WHERE c_nationkey IN (1, 2)) SELECT c_custkey AS k FROM c UNION ALL SELECT o_custkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM c)"),
    "p20_rbac_subquery": (_secured("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM customer c WHERE c.c_custkey = o.o_custkey) AND o_totalprice > (SELECT AVG(o_totalprice) FROM orders)"),
        "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_nationkey IN (1, 2)) AND o_totalprice > (SELECT avg(o_totalprice) FROM orders)"),
    "p21_standard_user": (_t("customer")(lambda c: access.standard_policy("user", 3).secure("customer", c.withColumn("tenant_id", F.col("c_nationkey") % 5)).select("c_custkey")), "SELECT c_custkey FROM customer WHERE c_nationkey % 5 = 3"),
    "p23_builtin_policies": (_t("customer")(lambda c: _builtins(c)), BUILTIN_SQL),
    "p34_s15_classification": (_database(CUSTOMER, "ALTER TABLE customer MODIFY COLUMN c_name SET CLASSIFICATION 'PII'", "ALTER TABLE customer MODIFY COLUMN c_acctbal SET CLASSIFICATION 'Financial'", then="SHOW CLASSIFICATIONS FOR customer"), "SELECT * FROM (VALUES ('c_name', 'PII'), ('c_acctbal', 'Financial')) t(column_name, data_class)"),
    "p36_break_glass": (_meta("WITH BREAK_GLASS REASON='on call' SELECT n_nationkey, n_name FROM nation WHERE n_name <> '$5 AT OFFSET 3'", "nation"), "SELECT n_nationkey, n_name FROM nation"),
    "p32_erase_everywhere": (_erase, "SELECT 'customer' AS table_name, count(*) AS kept, 1::BIGINT AS erased FROM customer WHERE c_custkey <> 7 UNION ALL SELECT 'orders', count(*), (SELECT count(*) FROM orders WHERE o_custkey = 7) FROM orders WHERE o_custkey <> 7 UNION ALL SELECT 'supplier', count(*), 0 FROM supplier"),
    "p16_class_of_name": (_t("part")(lambda p: p.select("p_partkey", classify.class_of_name(F.concat_ws("_", "p_type", F.element_at(F.array(*[F.lit(w) for w in ("patient", "payment", "ledger", "genetic", "email", "internal", "blog", "misc")]), (F.col("p_partkey") % 8 + 1).cast("int")))).alias("c"))),
        "SELECT p_partkey, ['PHI', 'PCI', 'Financial', 'Sensitive', 'PII', 'Confidential', 'Public', 'Confidential'][p_partkey % 8 + 1] AS c FROM part"),
    "p16_verdict": (_t("documents")(lambda d: d.select("doc_id", classify.verdict(F.lit("strategy"), F.col("text")).alias("v")).select("doc_id", "v.data_class", F.round("v.confidence", 4).alias("confidence"), F.array_join("v.matched_patterns", ",").alias("patterns"))), VERDICT_SQL),
    "p29_severity": (_t("orders")(lambda o: o.select("o_orderkey", compliance.severity(F.element_at(F.array(*[F.lit(c) for c in classify.ACCESS_ORDER]), (F.col("o_orderkey") % 8 + 1).cast("int")), F.col("o_orderkey") % 3 == 0).alias("s"))),
        f"SELECT o_orderkey, CASE WHEN c IN ('PHI', 'PCI') THEN 'Critical' WHEN c IN ('PII', 'Sensitive') OR o_orderkey % 3 = 0 THEN 'High' WHEN c IN ('Confidential', 'Financial') THEN 'Medium' ELSE 'Low' END AS s FROM (SELECT *, {CLASSES_SQL}[o_orderkey % 8 + 1] AS c FROM orders)"),
    "p29_p33_deadlines": (_t("events")(lambda e: compliance.overdue_notifications(e.select("event_id", F.col("ts").alias("detected_at"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("notified_at")), F.expr("timestamp_ntz'2024-01-20 00:00:00'")).select("event_id", F.lit("breach").alias("kind")).unionByName(
        compliance.overdue_erasures(e.select("event_id", F.col("ts").alias("requested_at"), F.when(F.col("event_id") % 3 == 0, "Complete").when(F.col("event_id") % 3 == 1, "Pending").otherwise("InProgress").alias("status")), F.expr("timestamp_ntz'2024-02-10 00:00:00'")).select("event_id", F.lit("erasure").alias("kind")))),
        "SELECT event_id, 'breach' AS kind FROM events WHERE event_id % 2 = 1 AND TIMESTAMP '2024-01-20' > ts + INTERVAL 72 HOUR UNION ALL SELECT event_id, 'erasure' FROM events WHERE event_id % 3 <> 0 AND TIMESTAMP '2024-02-10' > ts + INTERVAL 30 DAY"),
    "s10_verified_read": (_t("events")(_verified), """SELECT user_id AS stream_id, event_id AS "offset", event_type AS payload FROM events"""),
    "s13_columns": (_meta("SELECT table_name, column_name, data_type, ordinal_position FROM information_schema.columns", "region", "nation"),
        "SELECT * FROM (VALUES ('region', 'r_regionkey', 'INTEGER', 1::BIGINT), ('region', 'r_name', 'TEXT', 2), ('nation', 'n_nationkey', 'INTEGER', 1), ('nation', 'n_name', 'TEXT', 2), ('nation', 'n_regionkey', 'INTEGER', 3)) t(table_name, column_name, data_type, ordinal_position)"),
    "s16_s17_csv": (_t("events")(lambda e: export.as_csv(_records(e))), """SELECT concat_ws(',', user_id, '"a ""b"" ' || event_type || '"', event_id, '"' || replace(props, '"', '""') || '"', strftime(ts, '%Y-%m-%d')) AS line FROM events"""),
    "s16_json": (_t("events")(lambda e: export.as_json(_records(e)).select(F.get_json_object("line", "$.offset").cast("long").alias("event_id"), F.get_json_object("line", "$.stream_name").alias("name"), F.get_json_object("line", "$.data").alias("data"))), """SELECT event_id, 'a "b" ' || event_type AS name, props AS data FROM events"""),
    "s18_tool_export": (_t("customer")(lambda c: export.tool_export("customer", c, compliance.ExportScope({"customer"}, excluded={"c_acctbal"}, transforms={"customer.c_name": lambda x: anonymize.partial_mask(x, 4, 2), "*.c_mktsegment": anonymize.per_char, "*": lambda x: x}), ["c_custkey"], 500)[0]),
        "SELECT c_custkey, left(c_name, 4) || repeat('*', length(c_name) - 6) || right(c_name, 2) AS c_name, c_nationkey, repeat('*', length(c_mktsegment)) AS c_mktsegment FROM customer ORDER BY c_custkey LIMIT 500"),
    "x17_power": (_t("part")(lambda p: p.select("p_partkey", F.round(scalar.power_checked(F.col("p_size").cast("double"), F.lit(2.0)), 6).alias("p"))), "SELECT p_partkey, round(power(p_size, 2), 6) AS p FROM part"),
    "x15b_real_to_int": (_t("customer")(lambda c: c.select("c_custkey", scalar.cast_checked(F.col("c_acctbal"), T.DoubleType(), T.LongType()).alias("i"), scalar.cast_checked(F.col("c_nationkey"), T.IntegerType(), T.DoubleType()).alias("r"))), "SELECT c_custkey, CAST(trunc(c_acctbal) AS BIGINT) AS i, CAST(c_nationkey AS DOUBLE) AS r FROM customer"),
    "x15d_text_boolean": (_t("orders")(lambda o: o.select("o_orderkey", scalar.cast_checked(F.element_at(F.array(*[F.lit(x) for x in ("true", "F", "1", "false", "T", "0")]), (F.col("o_orderkey") % 6 + 1).cast("int")), T.StringType(), T.BooleanType()).alias("b"))), "SELECT o_orderkey, o_orderkey % 6 IN (0, 2, 4) AS b FROM orders"),
    "a4_sum_int": (_t("nation")(lambda n: n.groupBy("n_regionkey").agg(scalar.sum_checked(F.col("n_nationkey"), T.IntegerType()).alias("s"))), "SELECT n_regionkey, CAST(sum(n_nationkey) AS INTEGER) AS s FROM nation GROUP BY n_regionkey"),
    "f18_json_equality": (_t("events")(lambda e: e.filter(jsonops.get_equals(F.col("props"), "k", 29) | (jsonops.get_text(F.col("props"), "k") == "69")).select("event_id")), "SELECT event_id FROM events WHERE json_extract_string(props, '$.k') IN ('29', '69')"),
    "j3_contains_props": (_t("events")(lambda e: e.select("event_id", jsonops.contains(F.col("props"), {"k": 29}).alias("c"))), "SELECT event_id, json_extract_string(props, '$.k') = '29' AS c FROM events"),
    "p1_p8_masks": (_t("customer")(_masks), """SELECT c_custkey, '***-**-' || lpad((c_custkey % 9999)::VARCHAR, 4, '0') AS ssn, substring(lower(c_mktsegment), 1, 1) || '***@example.com' AS mail, '***-***-' || lpad((c_custkey % 9999)::VARCHAR, 4, '0') AS phone, CASE WHEN strlen(c_name) <= 6 THEN c_name ELSE left(c_name, 6) || '...' END AS c_name FROM customer"""),
    "p6_hash": (_t("customer")(lambda c: c.select("c_custkey", masking.hash_hex(F.col("c_name")).alias("h"), masking.tokenize(F.col("c_name")).alias("t"), anonymize.pseudonym(F.col("c_name")).alias("p"))), "SELECT c_custkey, sha256(c_name) AS h, 'tok_' || substring(sha256(c_name), 1, 16) AS t, 'PSEUDO-' || substring(sha256(c_name), 1, 16) AS p FROM customer"),
    "p12_p14_anonymize": (_t("orders")(lambda o: o.select("o_orderkey", anonymize.preserve_suffix(F.col("o_orderpriority"), 3).alias("s"), anonymize.truncate_date(F.col("o_orderdate"), "quarter").alias("q"), anonymize.generalize_age(F.col("o_orderkey") % 100).alias("a"), anonymize.generalize_number(F.col("o_totalprice"), 10000).alias("g"))),
        "SELECT o_orderkey, repeat('*', greatest(length(o_orderpriority) - 3, 0)) || right(o_orderpriority, 3) AS s, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS q, CASE WHEN o_orderkey % 100 >= 90 THEN '90+' ELSE ((o_orderkey % 100) // 5 * 5) || '-' || ((o_orderkey % 100) // 5 * 5 + 4) END AS a, (floor(o_totalprice / 10000)::BIGINT * 10000) || '-' || (floor(o_totalprice / 10000)::BIGINT * 10000 + 9999) AS g FROM orders"),
    "p15_k_anonymity": (_t("customer")(lambda c: anonymize.k_anonymity(c, ["c_mktsegment", "c_nationkey"], 2)), "SELECT coalesce(min(n), 0) AS k, count(*) AS classes, coalesce(min(n), 0) >= 2 AS satisfied FROM (SELECT count(*) AS n FROM customer GROUP BY c_mktsegment, c_nationkey)"),
    "p16_classify": (_t("documents")(lambda d: d.select("doc_id", classify.class_of_content(F.col("text")).alias("c"))),
        "SELECT doc_id, CASE WHEN " + " + ".join(f"contains(lower(text), '{t}')::INT" for t in classify.MEDICAL_TERMS) + " >= 2 THEN 'PHI' WHEN regexp_matches(text, '[0-9](?:[ -]*[0-9]){12}') THEN 'PCI' WHEN " + " + ".join(f"contains(lower(text), '{t}')::INT" for t in classify.FINANCIAL_TERMS) + r" >= 2 THEN 'Financial' WHEN regexp_matches(text, '[0-9]{3}-[0-9]{2}-[0-9]{4}') OR regexp_matches(text, '(^|\s)[^\s@]+@\S*\.\S{2,}|(^|\s)[^\s@]+@\S{2,}\.\S*|(^|\s)[^\s@]+@\S\.\S') THEN 'PII' ELSE 'Public' END AS c FROM documents"),
    "p17_hash_chain": (_t("events")(_chain), """WITH RECURSIVE e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i FROM events),
        c AS (SELECT user_id, i, sha256(repeat('0', 64) || '0' || event_type) AS h FROM e WHERE i = 1 UNION ALL SELECT e.user_id, e.i, sha256(c.h || '0' || e.event_type) FROM c JOIN e ON e.user_id = c.user_id AND e.i = c.i + 1)
        SELECT 0::BIGINT AS broken, count(*) AS n, count(DISTINCT h) AS hashes FROM c"""),
    "p19_row_filters": (_t("customer")(lambda c: access.AccessPolicy("analyst", ["cust*"], deny_columns=["c_acct*"], row_filters=[("c_nationkey", "IN", [1, 2, 3]), ("c_acctbal", ">", 0.0)]).secure("customer", c)), "SELECT c_custkey, c_name, c_nationkey, c_mktsegment FROM customer WHERE c_nationkey IN (1, 2, 3) AND c_acctbal > 0"),
    "p22_abac": (_t("orders")(_abac), f"""SELECT o_orderkey, CASE WHEN l = 7 OR NOT (a OR p) THEN 'Deny' ELSE 'Allow' END AS effect, CASE WHEN l = 7 THEN 'phi' WHEN a THEN 'admin' WHEN p THEN 'public' ELSE 'none' END AS matched_rule
        FROM (SELECT o_orderkey, o_orderkey % 8 AS l, o_orderkey % 3 = 0 AS a, o_orderkey % 8 <= 1 AND NOT (hour(o_orderdate) BETWEEN 9 AND 16 AND dayofweek(o_orderdate) NOT IN (0, 6)) AS p FROM orders)"""),
    "p24_purpose": (_t("orders")(lambda o: o.select("o_orderkey", access.purpose_allowed(F.element_at(F.array(*[F.lit(p) for p in access.PURPOSES]), (F.col("o_orderkey") % 8 + 1).cast("int")), F.element_at(F.array(*[F.lit(c) for c in classify.ACCESS_ORDER]), (F.floor(F.col("o_orderkey") / 8) % 8 + 1).cast("int"))).alias("ok"))),
        f"SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN c NOT IN ('PHI', 'Sensitive', 'PCI', 'Financial', 'Confidential') WHEN 1 THEN c NOT IN ('PHI', 'Sensitive', 'PCI', 'Confidential') WHEN 4 THEN c NOT IN ('PCI', 'Financial', 'Confidential') WHEN 5 THEN c NOT IN ('PCI', 'Financial', 'Confidential') WHEN 6 THEN c NOT IN ('PCI', 'Financial', 'Confidential') ELSE true END AS ok FROM (SELECT o_orderkey, {CLASSES_SQL}[o_orderkey // 8 % 8 + 1] AS c FROM orders)"),
    "p25_consent": (_t("customer", "events")(lambda c, e: access.with_consent(c.select("c_custkey", "c_name"), "c_custkey", e.select(F.col("user_id").alias("subject_id"), F.col("event_type").alias("purpose"), F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("withdrawn_at"), F.lit(None).cast("timestamp_ntz").alias("expires_at")), "purchase", F.expr("timestamp_ntz'2024-06-01 00:00:00'"))), "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND event_id % 2 <> 0)"),
    "p27_retention": (_t("orders")(lambda o: o.select("o_orderkey", compliance.retention_action(F.datediff(F.lit("1999-01-01").cast("date"), F.col("o_orderdate").cast("date")), F.lit(1000), F.lit(500), F.col("o_orderkey") % 7 == 0).alias("action"))),
        "SELECT o_orderkey, CASE WHEN d >= 1000 THEN CASE WHEN o_orderkey % 7 = 0 THEN 'HoldActive' WHEN d < 500 THEN 'Retain' ELSE 'Delete' END WHEN 1000 - d <= 30 THEN 'ExpiringWarning' ELSE 'Retain' END AS action FROM (SELECT o_orderkey, date_diff('day', o_orderdate::DATE, DATE '1999-01-01') AS d FROM orders)"),
    "p28_denied_access": (_t("events")(lambda e: compliance.count_breaches(e, "user_id", "ts", 3, 86400 * 3)), WINDOW_SQL.format(limit=3, seconds=86400 * 3)),
    "p28_query_volume": (_t("events")(lambda e: compliance.query_volume(e, "user_id", "ts", 1, 5.0, 86400 * 6)), WINDOW_SQL.format(limit=5, seconds=86400 * 6)),
    "p28_exfiltration": (_t("orders")(lambda o: compliance.exfiltrations(o.select("o_orderkey", (F.col("o_totalprice") * 500).cast("long").alias("bytes")), "bytes")), "SELECT o_orderkey, CAST(trunc(o_totalprice * 500) AS BIGINT) AS bytes, 104857600 AS threshold FROM orders WHERE CAST(trunc(o_totalprice * 500) AS BIGINT) > 104857600"),
    "p28_escalation": (_t("orders")(lambda o: compliance.escalations(o.select("o_orderkey", F.col("o_orderstatus").alias("from_role"), F.col("o_orderpriority").alias("to_role")))), "SELECT o_orderkey, o_orderstatus AS from_role, o_orderpriority AS to_role, 'PrivilegeEscalation' AS indicator FROM orders"),
    "p28_off_hours": (_t("events")(lambda e: e.filter(compliance.off_hours(F.col("ts"))).select("event_id")), "SELECT event_id FROM events WHERE hour(ts) NOT BETWEEN 9 AND 16"),
    "p28_mass_export": (_t("lineitem")(lambda x: compliance.mass_exports(x.groupBy("l_returnflag", "l_suppkey").agg((F.count(F.lit(1)) * 10).alias("records")), "records")), "SELECT l_returnflag, l_suppkey, count(*) * 10 AS records, 1000 AS threshold FROM lineitem GROUP BY l_returnflag, l_suppkey HAVING count(*) * 10 > 1000"),
    "p30_audit_query": (_t("events")(lambda e: compliance.audit_query(e.select("event_id", F.col("ts").alias("timestamp"), F.col("event_type").alias("action"), F.col("user_id").alias("actor")), action="p", limit=50).select("event_id", "action")), "SELECT event_id, event_type AS action FROM events WHERE starts_with(event_type, 'p') ORDER BY ts, event_id LIMIT 50"),
    "p13_export_scope": (_t("orders")(lambda o: compliance.ExportScope({"orders"}, excluded={"o_totalprice", "o_orderdate"}, positions=("o_orderkey", 10, 500), max_rows=100).apply("orders", o, ["o_orderkey"])), "SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority FROM orders WHERE o_orderkey BETWEEN 10 AND 500 ORDER BY o_orderkey LIMIT 100"),
    "p31_subject_export": (_t("orders", "customer")(lambda o, c: compliance.subject_export({"orders": o.select(F.col("o_custkey").alias("id"), "o_orderkey"), "customer": c.select(F.col("c_custkey").alias("id"), "c_name")}, "id", 7)), """SELECT 'orders' AS table_name, '{"id":' || o_custkey || ',"o_orderkey":' || o_orderkey || '}' AS data FROM orders WHERE o_custkey = 7 UNION ALL SELECT 'customer', '{"id":' || c_custkey || ',"c_name":"' || c_name || '"}' FROM customer WHERE c_custkey = 7"""),
    "p32_erasure": (_t("orders")(lambda o: compliance.erase_subject(o, "o_custkey", 7)[0].select("o_orderkey")), "SELECT o_orderkey FROM orders WHERE o_custkey IS DISTINCT FROM 7"),
    "s12_information_schema": (_meta("SELECT table_name, column_count, primary_key_count FROM information_schema.tables", "region", "nation"), "SELECT * FROM (VALUES ('nation', 3::BIGINT, 1::BIGINT), ('region', 2, 1)) t(table_name, column_count, primary_key_count)"),
    "s14_show_columns": (_meta("SHOW COLUMNS FROM region", "region"), "SELECT * FROM (VALUES ('region', 'r_regionkey', 'INTEGER', 1::BIGINT), ('region', 'r_name', 'TEXT', 2)) t(table_name, column_name, data_type, ordinal_position)"),
}


def _shared(text: str) -> Q:
    names = [t for t in TABLES if t in words(hide(text)[0])]
    return lambda spark, sf_dir: Engine(spark, open_catalog(spark, sf_dir, *names)).sql(text)


QUERIES: dict[str, Q] = {**{n: _shared(t) for n, t in SHARED.items()}, **{n: q for n, (q, _) in PAIRED.items()}}
ORACLE_SQL: dict[str, str] = {**SHARED, **{n: s for n, (_, s) in PAIRED.items() if s}}
