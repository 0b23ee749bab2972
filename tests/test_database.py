"""Statements, roles, time travel, the change log, streaming views and what surrounds them."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.functions import scalar
from chronofold.operators import eventlog as log
from chronofold.operators.relational import fixpoint
from chronofold.plans import text
from chronofold.plans.database import Database
from chronofold.plans.migrations import migrate
from chronofold.plans.rows import rows_as_maps, typed_rows
from chronofold.plans.sqlfront import Engine
from chronofold.policy import access, compliance, export
from chronofold.policy.masking import MaskRegistry
from chronofold.sources.catalog import Catalog, TableDef, type_of
from chronofold.sources.changelog import ChangeLog
from chronofold.storage import numbered
from chronofold.streaming.liveview import LiveView, Subscription
from chronofold.streaming.subscribe import drain, subscribe


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture()
def clinic(spark):
    db = Database(spark)
    db.execute("CREATE TABLE patients (id BIGINT PRIMARY KEY, name TEXT NOT NULL, age INT, ward VARCHAR(20))")
    db.execute("INSERT INTO patients VALUES (1, 'Ann', 30, 'a'), (2, 'O''Neil; -- x', 41, 'b'), (3, 'Cy', NULL, 'a')")
    return db


def test_literals_are_set_aside():
    hidden, kept = text.hide("SELECT '$5 AT OFFSET 3', \"a b\" -- (((\n FROM t /* $9 */ WHERE x = 'it''s \\n'")
    assert "$" not in hidden and "(" not in hidden and text.value(kept[2]) == "it's \\n"
    assert text.show(hidden, kept).endswith("x = 'it\\'s \\\\n'") and "`a b`" in text.show(hidden, kept)
    assert text.split_list("a, f(b, c), d") == ["a", "f(b, c)", "d"]
    for deep in ("SELECT " + "(" * 60 + "1" + ")" * 60, "SELECT " + "NOT " * 101 + "TRUE", "WITH " + ", ".join(f"c{i} AS (SELECT 1)" for i in range(17)) + " SELECT 1"):
        with pytest.raises(ValueError):
            text.check_depth(deep)


def test_changes_are_events(spark, clinic):
    db = clinic
    assert db.execute("SELECT name FROM patients WHERE id = 2").first()[0] == "O'Neil; -- x"
    for bad in ("INSERT INTO patients VALUES (1, 'dup', 1, 'a')", "INSERT INTO patients VALUES (9, NULL, 1, 'a')", "INSERT INTO patients VALUES (8, 'a', 1, 'a'), (8, 'b', 1, 'a')", "INSERT INTO patients (id, nope) VALUES (9, 1)",
                "UPDATE patients SET id = 4", "UPDATE patients SET name = NULL WHERE id = 1", "INSERT INTO nowhere VALUES (1)", "MERGE INTO patients", "INSERT INTO patients VALUES ($1, 'x', 1, 'a')", "INSERT INTO patients VALUES (1, 'x', 1, 'a') ON CONFLICT (name) DO NOTHING"):
        with pytest.raises(ValueError):
            db.execute(bad)
    with pytest.raises(Exception):
        db.execute("INSERT INTO patients VALUES (9, 'x', 'old', 'a')").collect()
    assert db.log.head() == 3
    assert rows(db.execute("UPDATE patients SET age = age + 1, ward = $1 WHERE ward = 'a' RETURNING id, age, ward", ["c"])) == [(1, 31, "c"), (3, None, "c")]
    assert rows(db.execute("DELETE FROM patients WHERE id = $1", [2])) == [(1,)]
    assert rows(db.execute("INSERT INTO patients VALUES (1, 'New', 9, 'z'), (4, 'Di', 5, 'z') ON CONFLICT (id) DO UPDATE SET name = EXCLUDED.name RETURNING id, name, age")) == [(1, "New", 31), (4, "Di", 5)]
    assert rows(db.execute("INSERT INTO patients VALUES (1, 'Never', 9, 'z') ON CONFLICT (id) DO NOTHING")) == [(0,)]
    assert rows(db.sql("SELECT * FROM patients")) == [(1, "New", 31, "c"), (3, "Cy", None, "c"), (4, "Di", 5, "z")]
    assert rows(db.sql("SELECT id FROM patients AT OFFSET 2")) == [(1,), (2,), (3,)] and rows(db.sql("SELECT id, age FROM patients AT OFFSET 3 WHERE id = 1")) == [(1, 31)]
    assert [r["kind"] for r in db.events("patients").orderBy("offset").collect()] == ["insert"] * 3 + ["update"] * 2 + ["delete", "upsert_update", "insert"]
    first = db.log.commits()[0]
    assert db.sql(f"SELECT COUNT(*) AS n FROM patients AS OF '{datetime.fromtimestamp(first.ns / 1e9 + 0.001).astimezone().isoformat()}'").first()[0] >= 3
    with pytest.raises(ValueError):
        db.sql("SELECT * FROM patients AT OFFSET 99")
    again = Database(spark, db.log.root)
    again.catalog.defs["patients"] = db.catalog.defs["patients"]
    assert again.current("patients").count() == 3


def test_schema_changes_and_broadcast_events(spark, clinic):
    db, told = clinic, []
    db.listeners.append(told.append)
    db.execute("ALTER TABLE patients ADD COLUMN score DECIMAL(10, 2)")
    db.execute("UPDATE patients SET score = 2.5 WHERE id = 1")
    db.execute("ALTER TABLE patients DROP COLUMN score")
    db.execute("ALTER TABLE patients ADD COLUMN score TEXT")
    assert rows(db.sql("SELECT id, score FROM patients")) == [(1, None), (2, None), (3, None)]
    db.execute("CREATE INDEX by_ward ON patients (ward, age)")
    assert db.catalog.defs["patients"].indexes == {"by_ward": ["ward", "age"]} and db.catalog.defs["patients"].version == 4
    db.execute("CREATE TABLE other (a BIGINT, b BIGINT, PRIMARY KEY (a, b))")
    db.execute("DROP TABLE other")
    assert [t["event"] for t in told] == ["TableUpdated", "IndexCreated", "TableCreated", "TableDropped"]
    for bad in ("CREATE TABLE patients (id BIGINT PRIMARY KEY)", "DROP TABLE other", "ALTER TABLE patients DROP COLUMN id", "CREATE INDEX by_ward ON patients (ward)", "CREATE TABLE bare (a BIGINT)", "CREATE TABLE odd (a BLURB PRIMARY KEY)", "ALTER TABLE patients DROP COLUMN nope"):
        with pytest.raises(ValueError):
            db.execute(bad)
    db.seal()
    with pytest.raises(PermissionError):
        db.execute("DELETE FROM patients")
    assert db.execute("SELECT COUNT(*) FROM patients").first()[0] == 3
    db.unseal()
    assert rows(db.execute("DELETE FROM patients")) == [(3,)] and db.current("patients").isEmpty()


def test_policy_statements(clinic):
    db = clinic
    for statement in ("CREATE ROLE nurse", "CREATE USER ann WITH ROLE nurse", "GRANT SELECT (id, name, ward) ON patients TO nurse", "CREATE MASKING POLICY short STRATEGY TRUNCATE 2 EXEMPT ROLES (Auditor, chief)",
                      "ALTER TABLE patients ALTER COLUMN name SET MASKING POLICY short", "CREATE MASK wards ON patients.ward USING hash", "ALTER TABLE patients MODIFY COLUMN name SET CLASSIFICATION 'PHI'", "CREATE ROLE auditor", "GRANT SELECT ON patients TO auditor"):
        db.execute(statement)
    assert rows(db.execute("SHOW CLASSIFICATIONS FOR patients")) == [("name", "PHI")]
    db.role = "ann"
    assert {r["n"] for r in db.sql("SELECT UPPER(name) AS n FROM (SELECT * FROM patients) p").collect()} == {"AN...", "CY", "O'..."}
    with pytest.raises(Exception):
        db.sql("SELECT age FROM patients")
    assert db.sql("SELECT ward FROM patients AT OFFSET 0").first()[0] != "a"
    db.role = "auditor"
    assert db.sql("SELECT name, age FROM patients WHERE id = 1").first()[:] == ("Ann", 30)
    db.role = "nobody"
    with pytest.raises(PermissionError):
        db.sql("SELECT 1 FROM patients")
    db.role = None
    for bad in ("CREATE MASKING POLICY x STRATEGY BLUR", "CREATE MASKING POLICY x STRATEGY TRUNCATE", "CREATE MASKING POLICY x STRATEGY HASH 3", "DROP MASKING POLICY short", "CREATE USER bob WITH ROLE nope", "GRANT SELECT ON patients TO nope", "CREATE ROLE nurse", "ALTER TABLE patients ALTER COLUMN name SET MASKING POLICY short"):
        with pytest.raises(ValueError):
            db.execute(bad)
    for statement in ("ALTER TABLE patients ALTER COLUMN name DROP MASKING POLICY", "DROP MASKING POLICY short", "DROP MASK wards"):
        db.execute(statement)
    assert db.sql("SELECT name, ward FROM patients WHERE id = 1").first()[:] == ("Ann", "a")


def test_roles_through_every_reference(spark):
    catalog = Catalog(spark)
    catalog.register("pay", spark.createDataFrame([(1, 10, "x"), (2, 20, "y")], "id long, sum long, note string"))
    catalog.register("secret", spark.createDataFrame([(1,)], "id long"))
    masks = MaskRegistry()
    masks.create("m", "REDACT_CUSTOM", "?")
    masks.attach("pay", "note", "m")
    e = Engine(spark, catalog, policy=access.AccessPolicy("clerk", ["p*"], row_filters=[("sum", "<", 15)], deny_columns=["sum"]), masks=masks)
    assert rows(e.sql("WITH c AS (SELECT * FROM pay) SELECT * FROM c UNION ALL SELECT * FROM pay WHERE id IN (SELECT id FROM pay)")) == [(1, "?"), (1, "?")]
    for refused in ("SELECT * FROM secret", "SELECT id FROM pay WHERE EXISTS (SELECT 1 FROM secret)", "SELECT id FROM pay UNION SELECT id FROM SECRET"):
        with pytest.raises(PermissionError):
            e.sql(refused)
    assert e.sql("SELECT 'secret' AS word FROM pay").first()[0] == "secret"
    assert Engine(spark, catalog).sql("SELECT * FROM secret").count() == 1


def test_travel_without_index_and_odd_names(spark):
    versions = spark.createDataFrame([(i, i, log.FOREVER) for i in range(4)], "id long, _from long, _to long")
    e = Engine(spark, Catalog(spark), {"o": versions, "r": versions})
    assert e.sql("SELECT o.id FROM o AT OFFSET 1").count() == 2 and e.sql("select id from o at offset 1 where 'AT OFFSET 9' <> '$3'").count() == 2
    assert e.sql("SELECT a.id FROM o AT OFFSET 2 a JOIN r AT OFFSET 1 b ON a.id = b.id").count() == 2
    assert e.sql("WITH c AS (SELECT * FROM o) SELECT * FROM c, r AT OFFSET 2").count() == 12
    with pytest.raises(ValueError):
        e.sql("SELECT * FROM o AT OFFSET 7")
    with pytest.raises(ValueError):
        e.sql("SELECT * FROM o AS OF '2024-01-01'")
    kept = e.prepare("SELECT id FROM o WHERE id >= $1")
    assert kept.execute([2]).count() == 2 and kept.execute_at(2, [2]).count() == 1
    tree = e.sql("EXPLAIN SELECT id FROM o WHERE id > 1").first()[0]
    assert tree.startswith("-> ") and "#" not in tree and tree == e.sql("EXPLAIN SELECT id FROM o WHERE id > 1").first()[0] and "\n  -> " in tree


def test_recursion_without_repeats(spark):
    catalog = Catalog(spark)
    catalog.register("edges", spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (9, 8)], "a long, b long"))
    e = Engine(spark, catalog, policy=access.AccessPolicy("clerk", ["edges"], row_filters=[("b", "!=", 4)]))
    assert rows(e.sql("WITH RECURSIVE r(n) AS (SELECT b FROM edges WHERE a = $1 UNION SELECT b FROM edges JOIN r ON a = n) SELECT n FROM r", [1])) == [(1,), (2,), (3,)]
    assert rows(e.sql("WITH RECURSIVE r(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM r WHERE n < 3) SELECT n FROM r")) == [(1,), (2,), (3,)]


def test_recursion_plans_do_not_grow(spark):
    edges = spark.range(1, 3**7).select(F.col("id").alias("child"), F.floor(F.col("id") / 3).cast("long").alias("parent"))
    known = []

    def step(new):
        known.append(len(new._jdf.queryExecution().analyzed().constraints().toString()))
        return edges.join(new, F.col("parent") == F.col("node")).filter("child > 0").select(F.col("child").alias("node"))

    got = fixpoint(edges.filter("parent = 0").select(F.col("child").alias("node")), step)
    assert rows(got) == sorted(((i,) for i in range(1, 3**7)), key=repr)
    assert len(known) == 7 and max(known) <= known[0]
    e = Engine(spark, Catalog(spark))
    typed = e.sql("WITH RECURSIVE r(n, p, q, d) AS (SELECT 1, NULL, array(), make_interval(0, 1) UNION SELECT n + 1, 'x', q || array(n), d FROM r WHERE n < 6) SELECT n, p, q, CAST(d AS STRING) FROM r")
    assert rows(typed) == [(i, "x" if i > 1 else None, [*range(1, i)], "1 months") for i in range(1, 7)]


def test_consent_modes(spark):
    catalog = Catalog(spark)
    catalog.register("notes", spark.createDataFrame([(1, "a")], "id long, body string"))
    consents = spark.createDataFrame([("s1", "Research", None, datetime(2030, 1, 1)), ("s2", "Research", datetime(2020, 1, 1), None)], "subject_id string, purpose string, withdrawn_at timestamp, expires_at timestamp")
    for mode, denied, noted in (("Required", True, 0), ("Optional", False, 1), ("Disabled", False, 0)):
        e = Engine(spark, catalog, consents=consents, consent_mode=mode)
        assert e.query_with_consent("SELECT * FROM notes", "s1", "Research", datetime(2024, 1, 1)).count() == 1
        if denied:
            with pytest.raises(PermissionError):
                e.query_with_consent("SELECT * FROM notes", "s2", "Research", datetime(2024, 1, 1))
        else:
            assert e.query_with_consent("SELECT * FROM notes", "s2", "Research", datetime(2024, 1, 1)).count() == 1
        assert len(e.audit) == noted
    purposes = spark.createDataFrame([("Marketing", "PHI"), ("Research", "PHI"), ("Analytics", "Financial")], "p string, c string")
    got = purposes.select(access.consent_needed(F.col("p")), access.lawful_basis(F.col("p")), access.is_minimal(F.col("p"), F.col("c"))).collect()
    assert [tuple(r) for r in got] == [(True, "Article 6(1)(a) - Consent", False), (True, "Article 6(1)(f) or Article 9(2)(j) - Research", True), (False, "Article 6(1)(f) - Legitimate interest", True)]


def test_change_log_commits_are_exclusive(spark):
    one = ChangeLog(spark)
    two = ChangeLog(spark, one.root)
    events = spark.createDataFrame([(2, "b"), (1, "a")], "k long, v string").select(F.lit("insert").alias("kind"), "k", "v", F.lit(True).alias("was_set_k"), F.lit(True).alias("was_set_v"))
    assert one.append("t", events, ["k"], 0).end == 2
    with pytest.raises(ValueError):
        two.append("t", events, ["k"], 0)
    stale = two.commits
    two.commits = lambda: []  # a writer that hasn't seen the other's commit yet
    with pytest.raises(ValueError, match="another writer"):
        two.append("t", events, ["k"], 0)
    two.commits = stale
    assert rows(two.read("t", T.StructType([T.StructField("k", T.LongType())])).select("offset", "k")) == [(0, 1), (1, 2)]
    two.fs.create(two.path(f"{two.root}/commits/{2:020d}"), False).close()
    with pytest.raises(ValueError):
        one.append("t", events, ["k"])
    assert one.recover() == 1 and one.append("t", events, ["k"]).begin == 2


def test_numbers_run_without_gaps(spark):
    df, n = numbered(spark.range(1000).select((999 - F.col("id")).alias("x")), [F.col("x")], "at", 5)
    assert n == 1000 and df.filter("at <> x + 5").count() == 0


def test_verified_read_from_a_checkpoint(spark):
    events = spark.createDataFrame([("s", i, "0", f"e{i}") for i in range(6)] + [("t", 0, "0", "x")], "stream_id string, offset long, kind string, payload string")
    chain = log.build_chain(events, ["stream_id"])
    checkpoint = chain.filter("stream_id = 's' and offset = 2").select("stream_id", "offset", "hash")
    assert log.verified(chain, ["stream_id"]).count() == 7 and log.verified(chain, ["stream_id"], checkpoint).count() == 4
    early = chain.withColumn("payload", F.when((F.col("stream_id") == "s") & (F.col("offset") == 1), "forged").otherwise(F.col("payload")))
    assert log.verified(early, ["stream_id"], checkpoint).count() == 4
    for bad in ((early, None), (chain.withColumn("hash", F.when(F.col("offset") == 4, "0").otherwise(F.col("hash"))), checkpoint)):
        with pytest.raises(ValueError):
            log.verified(bad[0], ["stream_id"], bad[1])


def test_commit_index_over_blocks(spark):
    times = [5, 5, 5, 3, 9, 9, 1, 20, 20, 2]
    df = spark.createDataFrame(list(enumerate(times)), "offset long, commit_ns long")
    want, last = [], None
    for t in times:
        last = t if last is None or t > last else last + 1
        want.append(last)
    for block in (1, 3, 100):
        assert [r["commit_ns"] for r in log.commit_index(df, [], block).orderBy("offset").collect()] == want


def test_unknown_kinds_and_bad_sums_fail(spark):
    bad = spark.createDataFrame([(1, 0, "rename", "a", True)], "k long, offset long, kind string, v string, was_set_v boolean")
    with pytest.raises(Exception, match="unknown event kind"):
        log.current_view(bad, ["k"], ["v"]).collect()
    big = spark.createDataFrame([(2_000_000_000,), (2_000_000_000,)], "x int")
    with pytest.raises(Exception):
        big.agg(scalar.sum_checked(F.col("x"), T.IntegerType())).collect()
    with pytest.raises(Exception):
        spark.range(1).select(scalar.power_checked(F.lit(-8.0), F.lit(0.5))).collect()
    with pytest.raises(TypeError):
        scalar.cast_checked(F.lit(1), T.DateType(), T.LongType())
    with pytest.raises(Exception):
        spark.range(1).select(F.lit(300).cast("byte")).collect()
    assert type_of("DECIMAL(10, 2)") == T.DecimalType(10, 2) and TableDef("t", T.StructType([])).version == 1


def test_replay_of_counters(spark):
    for events, want in ((["Inc", "Inc", "Dec"], 1), (["Inc", 100, "Dec"], 99), ([7], 7)):
        df = spark.createDataFrame([("s", i, str(e)) for i, e in enumerate(events)], "s string, at long, e string")
        assert log.replay_linear(df, ["s"], "at", F.expr("try_cast(e AS BIGINT)"), F.when(F.col("e") == "Inc", 1).when(F.col("e") == "Dec", -1)).first()["state"] == want


def test_breach_rules(spark):
    df = spark.createDataFrame([("u", s) for s in range(0, 60, 5)], "actor string, s int").select("actor", F.timestamp_seconds("s").alias("ts"))
    assert compliance.query_volume(df, "actor", "ts", 1).count() == 2
    exports = spark.createDataFrame([(1000,), (1001,), (200 << 20,)], "n long")
    assert compliance.mass_exports(exports, "n").count() == 2 and compliance.exfiltrations(exports, "n").count() == 1
    with pytest.raises(Exception):
        compliance.escalations(spark.createDataFrame([("a", "")], "from_role string, to_role string")).collect()
    classes = spark.createDataFrame([("PHI", False), ("Sensitive", False), ("Financial", False), ("Public", True), ("Public", False)], "c string, e boolean")
    assert [r[0] for r in classes.select(compliance.severity(F.col("c"), F.col("e"))).collect()] == ["Critical", "High", "Medium", "High", "Low"]


def test_exports(spark, tmp_path):
    records = spark.createDataFrame([(1, 'a,"b"', 7, '{"x":1}', "2024-01-01T00:00:00Z")], "stream_id long, stream_name string, offset long, data string, timestamp string")
    assert export.as_csv(records).first()[0] == '1,"a,""b""",7,"{""x"":1}",2024-01-01T00:00:00Z'
    export.write_records(records, f"{tmp_path}/csv", "csv")
    export.write_records(records, f"{tmp_path}/json", "json")
    assert spark.read.csv(f"{tmp_path}/csv", header=True, escape='"').first()["data"] == '{"x":1}' and spark.read.json(f"{tmp_path}/json").first()["offset"] == 7
    with pytest.raises(ValueError):
        export.write_records(records.limit(0), f"{tmp_path}/none", "csv")
    df = spark.createDataFrame([(i, f"n{i}", i) for i in range(20)], "id long, name string, at long")
    scope = compliance.ExportScope({"t"}, transforms={"t.name": lambda c: F.lit("x"), "*.at": lambda c: c + 1}, positions=("id", 3, 10))
    out, digest = export.tool_export("t", df, scope, ["id"], 5)
    assert rows(out) == [(i, "x", i + 1) for i in range(3, 8)] and digest == export.tool_export("t", df.repartition(7), scope, ["id"], 5)[1]
    with pytest.raises(PermissionError):
        export.tool_export("u", df, scope, ["id"])


def test_live_view_equals_the_fold(spark, tmp_path):
    schema = T.StructType([T.StructField("k", T.LongType()), T.StructField("v", T.StringType()), T.StructField("n", T.LongType())])
    kinds = ["insert", "update", "delete", "upsert_update"]
    events = [(i, (i * 7) % 5, kinds[(i * 3 + i // 4) % 4], f"v{i}", i, i % 2 == 0, i % 3 == 0) for i in range(40)]
    df = spark.createDataFrame(events, "offset long, k long, kind string, v string, n long, was_set_v boolean, was_set_n boolean")
    view = LiveView(spark, f"{tmp_path}/view", ["k"], schema)
    for i in range(4):
        df.filter(F.col("offset").between(i * 10, i * 10 + 9)).coalesce(1).write.mode("append").parquet(f"{tmp_path}/log")
    drain(subscribe(spark, f"{tmp_path}/log", df.schema, 0, 1), view.fold, f"{tmp_path}/ck")
    assert rows(view.read()) == rows(log.current_view(df, ["k"], ["v", "n"])) and view.versions() == [1, 2, 3, 4]
    view.fold(df.filter("offset >= 30"), 3)
    assert rows(view.read()) == rows(log.current_view(df, ["k"], ["v", "n"]))


def test_subscription_by_credits(spark):
    events = spark.createDataFrame([(i, "x" * (400_000 if i < 6 else 1)) for i in range(200)], "offset long, payload string")
    there = {"log": events}
    s = Subscription(lambda: there["log"], 0)
    assert s.tick() == []
    s.grant(100)
    assert [len(s.tick()) for _ in range(5)] == [2, 2, 64, 32, 0] and s.credits == 0 and s.next_offset == 100
    s.grant(10)
    there["log"] = None
    assert s.tick() == [] and s.closed


def test_migrations(spark):
    db, files = Database(spark), {"0001_a.sql": "CREATE TABLE a (id BIGINT PRIMARY KEY, t TEXT); INSERT INTO a VALUES (1, 'x;y')", "0002_b.sql": "ALTER TABLE a ADD COLUMN n INT"}
    assert migrate(db, files) == ["0001_a.sql", "0002_b.sql"] and migrate(db, files) == []
    assert db.sql("SELECT t, n FROM a").first()[:] == ("x;y", None)
    for bad in ({**files, "0001_a.sql": "CREATE TABLE z (id BIGINT PRIMARY KEY)"}, {"0002_b.sql": files["0002_b.sql"]}, {**files, "0000_early.sql": "SELECT 1"}):
        with pytest.raises(ValueError):
            migrate(db, bad)


def test_typed_rows(spark):
    @dataclass
    class Person:
        id: int
        name: str

    df = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    assert typed_rows(df, Person) == [Person(1, "a"), Person(2, "b")] and rows_as_maps(df)[0] == {"id": 1, "name": "a"}
    with pytest.raises(TypeError):
        typed_rows(df.select("id", F.lit(1).alias("name")), Person)
    with pytest.raises(KeyError):
        typed_rows(df.select("id"), Person)
    with pytest.raises(ValueError):
        rows_as_maps(df, 1)
