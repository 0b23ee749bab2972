"""SQL statements that change tables and policies, over one change log.

Every INSERT, UPDATE and DELETE becomes events of the log; a table is the fold of its events, now or as of an offset.
CREATE, DROP, ALTER, masking policies, roles, users, grants and classifications change the catalog.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from chronofold.operators.eventlog import as_of_offset, current_view
from chronofold.plans.sqlfront import Engine
from chronofold.plans.text import LIT, check_depth, hide, show, split_list, value
from chronofold.policy.access import AccessPolicy
from chronofold.policy.masking import MASKS, MaskRegistry
from chronofold.sources.catalog import Catalog, type_of
from chronofold.sources.changelog import ChangeLog
from chronofold.storage import saved

RETURNING = re.compile(r"\s+RETURNING\s+(.+)$", re.I | re.S)
SENSITIVE = {"PHI", "PII", "Sensitive"}


class Database(Engine):
    """execute() changes, sql() reads. role: the acting role; None is the owner, who sees everything unmasked but what masks hide."""

    def __init__(self, spark: SparkSession, root: str | None = None, role: str | None = None, consents: DataFrame | None = None, consent_mode: str = "Disabled"):
        self.log = ChangeLog(spark, root)
        self.roles: dict[str, AccessPolicy] = {}
        self.users: dict[str, str] = {}
        self.sealed = False
        self.listeners: list[Callable[[dict[str, Any]], None]] = []
        self.role = role
        super().__init__(spark, Catalog(spark), masks=MaskRegistry(), consents=consents, consent_mode=consent_mode)

    # the engine's view of the tables
    def tables(self) -> list[str]:
        return list(self.catalog.defs)

    def _stored(self, table: str) -> DataFrame:
        """Events under the columns' present names."""
        definition = self.catalog.defs[table]
        names = {f.name: definition.stored.get(f.name, f.name) for f in definition.columns}
        events = self.log.read(table, T.StructType([T.StructField(names[f.name], f.dataType) for f in definition.columns]))
        return events.select("offset", "kind", *[F.col(names[c]).alias(c) for c in names], *[F.coalesce(f"was_set_{names[c]}", F.lit(False)).alias(f"was_set_{c}") for c in names])

    def events(self, table: str) -> DataFrame:
        return self._stored(table)

    def _fold(self, table: str, events: DataFrame) -> DataFrame:
        definition = self.catalog.defs[table]
        rest = [c for c in definition.columns.names if c not in definition.primary_key]
        return current_view(events, definition.primary_key, rest).select(*definition.columns.names)

    def current(self, table: str) -> DataFrame:
        return self._fold(table, self._stored(table))

    def as_of(self, table: str, offset: int) -> DataFrame:
        return self._fold(table, as_of_offset(self._stored(table), offset))

    def head(self) -> int | None:
        return self.log.head() - 1 if self.log.head() else None

    def commit_times(self) -> DataFrame:
        return self.log.times()

    def sql(self, text: str, params: list[Any] | None = None) -> DataFrame:
        self.versioned = dict.fromkeys(self.catalog.defs)
        self.policy = None
        if self.role is not None:
            role = self.users.get(self.role, self.role)
            if role not in self.roles:
                raise PermissionError(f"unknown role {role}")
            self.policy = self.roles[role]
        return super().sql(text, params)

    # changes
    def _tell(self, what: str, table: str, **more: Any) -> None:
        for listener in self.listeners:
            listener({"event": what, "table": table, **more})

    def _register(self, name: str, columns: T.StructType, key: list[str], required: list[str]) -> None:
        if not columns.fields:
            raise ValueError("a table needs a column")
        if not key or any(k not in columns.names for k in key):
            raise ValueError("a table needs a primary key of its own columns")
        self.catalog.register(name, self.spark.createDataFrame([], columns), key)
        self.catalog.defs[name].required = [*required, *[k for k in key if k not in required]]
        self.current(name).createOrReplaceTempView(name)
        self._tell("TableCreated", name)

    def load(self, name: str, df: DataFrame, key: list[str]) -> None:
        """A table with the rows of df as its first events."""
        self._register(name, df.schema, key, [])
        self._commit(name, df, "insert")

    def _commit(self, table: str, rows: DataFrame, kind: Any, columns: list[str] | None = None) -> None:
        definition = self.catalog.defs[table]
        names = columns or definition.columns.names
        stored = {c: definition.stored.get(c, c) for c in names}
        events = rows.select(
            (F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), *[F.col(c).alias(stored[c]) for c in names], *[F.lit(True).alias(f"was_set_{stored[c]}") for c in names]
        )
        commit = self.log.append(table, events, [stored[k] for k in definition.primary_key], self.log.head())
        self.current(table).createOrReplaceTempView(table)
        if commit:
            self._tell("TableUpdated", table, begin=commit.begin, end=commit.end)

    def _known(self, table: str) -> str:
        name = next((t for t in self.catalog.defs if t.lower() == table.lower()), None)
        if name is None:
            raise ValueError(f"no table {table}")
        return name

    def _select(self, expressions: str, source: DataFrame, kept: list[str], where: str | None, params: list[Any]) -> DataFrame:
        for n in re.findall(r"\$(\d+)", f"{expressions} {where or ''}"):
            if int(n) == 0 or int(n) > len(params):
                raise ValueError("parameter not found")
        text = f"SELECT {expressions} FROM {{source}}" + (f" WHERE {where}" if where else "")
        return self.spark.sql(show(re.sub(r"\$(\d+)", r":p\1", text), kept), args={f"p{i + 1}": v for i, v in enumerate(params)}, source=source)

    def _insert(self, m: re.Match, kept: list[str], params: list[Any]) -> DataFrame:
        table = self._known(m[1])
        definition = self.catalog.defs[table]
        names = split_list(m[2]) if m[2] else definition.columns.names
        if unknown := [c for c in names if c not in definition.columns.names]:
            raise ValueError(f"no column {unknown[0]} in {table}")
        rest, conflict = m[3].strip(), None
        if c := re.search(r"\s+ON\s+CONFLICT\s*\(([^)]*)\)\s*DO\s+(NOTHING|UPDATE\s+SET\s+(.+))$", rest, re.I | re.S):
            conflict, rest = c, rest[: c.start()]
            if split_list(c[1]) != definition.primary_key:
                raise ValueError("the conflict target must be the primary key")
        for n in re.findall(r"\$(\d+)", rest + (conflict[0] if conflict else "")):
            if int(n) == 0 or int(n) > len(params):
                raise ValueError("parameter not found")
        args = {f"p{i + 1}": v for i, v in enumerate(params)}
        source = self.spark.sql(show(re.sub(r"\$(\d+)", r":p\1", rest), kept), args=args)
        if len(source.columns) != len(names):
            raise ValueError(f"{len(names)} columns but {len(source.columns)} values")
        given = source.toDF(*names)
        new = given.select(*[(F.col(f.name) if f.name in names else F.lit(None)).cast(f.dataType).alias(f.name) for f in definition.columns])
        key = definition.primary_key
        new = saved(new, "insert")
        for c in definition.required:
            if not new.filter(F.col(c).isNull()).isEmpty():
                raise ValueError(f"null in {c}")
        if not new.groupBy(*key).count().filter("count > 1").isEmpty():
            raise ValueError("duplicate key")
        old = self.current(table)
        there = new.join(old, key, "left_semi")
        if conflict is None:
            if not there.isEmpty():
                raise ValueError("duplicate key")
            touched, kind = new, "insert"
        elif conflict[2].upper() == "NOTHING":
            touched, kind = new.join(old, key, "left_anti"), "insert"
        else:
            sets = dict((p.strip() for p in a.split("=", 1)) for a in split_list(conflict[3]))
            if unknown := [c for c in sets if c not in definition.columns.names or c in key]:
                raise ValueError(f"can't set {unknown[0]}")
            renamed = old.select(*[F.col(c).alias(f"_old_{c}") for c in old.columns], F.lit(True).alias("_there"))
            both = new.join(renamed, reduce(lambda a, b: a & b, [F.col(k) == F.col(f"_old_{k}") for k in key]), "left")
            picks = []
            for f in definition.columns:
                if f.name in sets:
                    merged = re.sub(r"\bEXCLUDED\s*\.\s*(\w+)", r"\1", sets[f.name], flags=re.I)
                    picks.append(f"CASE WHEN _there THEN CAST({merged} AS {f.dataType.simpleString()}) ELSE {f.name} END AS {f.name}")
                elif f.name in key:
                    picks.append(f.name)
                else:
                    picks.append(f"CASE WHEN _there THEN _old_{f.name} ELSE {f.name} END AS {f.name}")
            touched = self._select(", ".join([*picks, "CASE WHEN _there THEN 'upsert_update' ELSE 'insert' END AS _kind"]), both, kept, None, params)
            kind = F.col("_kind")
        touched = saved(touched, "upsert")
        self._commit(table, touched, kind)
        return touched.select(*definition.columns.names)

    def _update(self, m: re.Match, kept: list[str], params: list[Any]) -> DataFrame:
        table = self._known(m[1])
        definition = self.catalog.defs[table]
        sets = dict((p.strip() for p in a.split("=", 1)) for a in split_list(m[2]))
        if unknown := [c for c in sets if c not in definition.columns.names or c in definition.primary_key]:
            raise ValueError(f"can't set {unknown[0]}")
        kinds = {f.name: f.dataType.simpleString() for f in definition.columns}
        picks = [f"CAST({sets[c]} AS {kinds[c]}) AS {c}" if c in sets else c for c in definition.columns.names]
        touched = saved(self._select(", ".join(picks), self.current(table), kept, m[3], params), "update")
        for c in definition.required:
            if c in sets and not touched.filter(F.col(c).isNull()).isEmpty():
                raise ValueError(f"null in {c}")
        self._commit(table, touched, "update", [*definition.primary_key, *sets])
        return touched

    def _delete(self, m: re.Match, kept: list[str], params: list[Any]) -> DataFrame:
        table = self._known(m[1])
        touched = saved(self._select("*", self.current(table), kept, m[2], params), "delete")
        self._commit(table, touched, "delete", self.catalog.defs[table].primary_key)
        return touched

    def _create_table(self, m: re.Match, kept: list[str]) -> None:
        if m[2] in self.catalog.defs:
            if m[1]:
                return
            raise ValueError(f"table {m[2]} exists")
        fields, key, required = [], [], []
        for part in split_list(m[3]):
            if k := re.fullmatch(r"PRIMARY\s+KEY\s*\(([^)]*)\)", part, re.I):
                key = split_list(k[1])
                continue
            c = re.fullmatch(r"(\w+)\s+(\w+(?:\s*\([^)]*\))?)((?:\s+(?:NOT\s+NULL|NULL|PRIMARY\s+KEY))*)", part, re.I)
            if not c:
                raise ValueError(f"can't read column {show(part, kept)}")
            fields.append(T.StructField(c[1], type_of(c[2])))
            if re.search(r"PRIMARY", c[3], re.I):
                key.append(c[1])
            if re.search(r"NOT\s+NULL", c[3], re.I):
                required.append(c[1])
        self._register(m[2], T.StructType(fields), key, required)

    def execute(self, text: str, params: list[Any] | None = None) -> DataFrame | None:
        """Run a statement. Changes of rows give what RETURNING asks for, else the number of rows; SELECT and SHOW give rows."""
        hidden, kept = hide(text)
        check_depth(hidden)
        plain, given = hidden.strip().rstrip(";").strip(), params or []
        if re.match(r"(SELECT|WITH|SHOW|EXPLAIN)\b", plain, re.I):
            return self.sql(text, params)
        if self.sealed:
            raise PermissionError("the tenant is sealed")
        for pattern, action in STATEMENTS:
            if m := re.fullmatch(pattern, plain, re.I | re.S):
                action(self, m, kept)
                return None
        back = RETURNING.search(plain)
        body = plain[: back.start()] if back else plain
        for pattern, change in CHANGES:
            if m := re.fullmatch(pattern, body, re.I | re.S):
                touched = change(self, m, kept, given)
                return self._select(back[1], touched, kept, None, given) if back else touched.agg(F.count(F.lit(1)).alias("rows"))
        raise ValueError(f"can't read statement {text[:60]}")

    # catalog statements
    def _drop_table(self, m: re.Match, kept: list[str]) -> None:
        self.catalog.drop(m[2], bool(m[1]))
        self.masks.attached = {at: p for at, p in self.masks.attached.items() if at[0] != m[2]}
        self._tell("TableDropped", m[2])

    def _add_column(self, m: re.Match, kept: list[str]) -> None:
        self.catalog.defs[self._known(m[1])].add_column(m[2], type_of(m[3]))
        self.current(self._known(m[1])).createOrReplaceTempView(m[1])

    def _drop_column(self, m: re.Match, kept: list[str]) -> None:
        table = self._known(m[1])
        if (table, m[2]) in self.masks.attached:
            raise ValueError(f"{m[2]} has a masking policy")
        self.catalog.defs[table].drop_column(m[2])
        self.current(table).createOrReplaceTempView(table)

    def _create_index(self, m: re.Match, kept: list[str]) -> None:
        definition, columns = self.catalog.defs[self._known(m[2])], split_list(m[3])
        if m[1] in definition.indexes or any(c not in definition.columns.names for c in columns):
            raise ValueError(f"index {m[1]} exists, or a column doesn't")
        definition.indexes[m[1]] = columns
        self._tell("IndexCreated", m[2], index=m[1])

    def _classify(self, m: re.Match, kept: list[str]) -> None:
        definition = self.catalog.defs[self._known(m[1])]
        if m[2] not in definition.columns.names:
            raise ValueError(f"no column {m[2]}")
        definition.classes[m[2]] = value(kept[int(m[3])])

    def _create_policy(self, m: re.Match, kept: list[str]) -> None:
        strategy, argument = m[2].upper(), m[3].strip() if m[3] else None
        if strategy not in {*MASKS, "REDACT_CUSTOM", "TRUNCATE"}:
            raise ValueError(f"unknown strategy {strategy}")
        if argument and (a := re.fullmatch(LIT, argument)):
            argument = value(kept[int(a[1])])
        if (argument is None) == (strategy in ("REDACT_CUSTOM", "TRUNCATE")):
            raise ValueError(f"{strategy} takes {'an' if argument is None else 'no'} argument")
        self.masks.create(m[1], strategy, argument, tuple(value(kept[int(r[1:-1])]) if r[0] == "\x01" else r for r in split_list(m[4])) if m[4] else ())

    def _attach(self, m: re.Match, kept: list[str]) -> None:
        table = self._known(m[1])
        if m[2] not in self.catalog.defs[table].columns.names or m[3] not in self.masks.policies:
            raise ValueError(f"no column {m[2]} or no policy {m[3]}")
        self.masks.attach(table, m[2], m[3])

    def _create_mask(self, m: re.Match, kept: list[str]) -> None:
        self.masks.create(m[1], m[4].upper())
        self.masks.attach(self._known(m[2]), m[3], m[1])

    def _drop_mask(self, m: re.Match, kept: list[str]) -> None:
        self.masks.attached = {at: p for at, p in self.masks.attached.items() if p != m[1]}
        self.masks.drop(m[1])

    def _create_role(self, m: re.Match, kept: list[str]) -> None:
        if m[1] in self.roles:
            raise ValueError(f"role {m[1]} exists")
        self.roles[m[1]] = AccessPolicy(m[1])

    def _create_user(self, m: re.Match, kept: list[str]) -> None:
        if m[2] not in self.roles:
            raise ValueError(f"no role {m[2]}")
        self.users[m[1]] = m[2]

    def _grant(self, m: re.Match, kept: list[str]) -> None:
        table, policy = self._known(m[2]), self.roles.get(m[3])
        if policy is None:
            raise ValueError(f"no role {m[3]}")
        policy.allow_tables.append(table)
        if m[1]:
            policy.granted.setdefault(table, set()).update(split_list(m[1]))

    # beyond single statements
    def seal(self) -> None:
        """From now on nothing changes."""
        self.sealed = True

    def unseal(self) -> None:
        self.sealed = False

    def erase(self, column: str, subject: Any) -> DataFrame:
        """Delete the subject's rows from every table that has the column and holds sensitive classes; a receipt for each.

        (table_name, erased, digest): digest over the rows' hashes. A table whose rows are gone already gives 0 rows.
        """
        if self.sealed:
            raise PermissionError("the tenant is sealed")
        receipts = []
        for table, definition in sorted(self.catalog.defs.items()):
            if column not in definition.columns.names or not SENSITIVE & set(definition.classes.values()):
                continue
            mine = saved(self.current(table).filter(F.col(column) == subject), "erase")
            digest = F.sha2(F.concat_ws(",", F.sort_array(F.collect_list(F.sha2(F.to_json(F.struct(*definition.columns.names)), 256)))), 256)
            receipts.append((table, *mine.agg(F.count(F.lit(1)), digest).first()))
            self._commit(table, mine, "delete", definition.primary_key)
        return self.spark.createDataFrame(receipts, "table_name string, erased long, digest string")


NAME = r"([A-Za-z_]\w*)"
STATEMENTS = [
    (rf"CREATE\s+TABLE\s+(IF\s+NOT\s+EXISTS\s+)?{NAME}\s*\((.*)\)", Database._create_table),
    (rf"DROP\s+TABLE\s+(IF\s+EXISTS\s+)?{NAME}", Database._drop_table),
    (rf"ALTER\s+TABLE\s+{NAME}\s+ADD\s+(?:COLUMN\s+)?{NAME}\s+(\w+(?:\s*\([^)]*\))?)", Database._add_column),
    (rf"ALTER\s+TABLE\s+{NAME}\s+DROP\s+(?:COLUMN\s+)?{NAME}", Database._drop_column),
    (rf"CREATE\s+INDEX\s+{NAME}\s+ON\s+{NAME}\s*\(([^)]*)\)", Database._create_index),
    (rf"ALTER\s+TABLE\s+{NAME}\s+MODIFY\s+COLUMN\s+{NAME}\s+SET\s+CLASSIFICATION\s+{LIT}", Database._classify),
    (rf"CREATE\s+MASKING\s+POLICY\s+{NAME}\s+STRATEGY\s+(\w+)(?:\s+(\x01\d+\x01|\d+))?(?:\s+EXEMPT\s+ROLES\s*\(([^)]*)\))?", Database._create_policy),
    (rf"DROP\s+MASKING\s+POLICY\s+{NAME}", lambda db, m, kept: db.masks.drop(m[1])),
    (rf"ALTER\s+TABLE\s+{NAME}\s+ALTER\s+COLUMN\s+{NAME}\s+SET\s+MASKING\s+POLICY\s+{NAME}", Database._attach),
    (rf"ALTER\s+TABLE\s+{NAME}\s+ALTER\s+COLUMN\s+{NAME}\s+DROP\s+MASKING\s+POLICY", lambda db, m, kept: db.masks.detach(db._known(m[1]), m[2])),
    (rf"CREATE\s+MASK\s+{NAME}\s+ON\s+{NAME}\.{NAME}\s+USING\s+(\w+)", Database._create_mask),
    (rf"DROP\s+MASK\s+{NAME}", Database._drop_mask),
    (rf"CREATE\s+ROLE\s+{NAME}", Database._create_role),
    (rf"CREATE\s+USER\s+{NAME}\s+WITH\s+ROLE\s+{NAME}", Database._create_user),
    (rf"GRANT\s+SELECT\s*(?:\(([^)]*)\))?\s+ON\s+(?:TABLE\s+)?{NAME}\s+TO\s+{NAME}", Database._grant),
]
CHANGES = [
    (rf"INSERT\s+INTO\s+{NAME}\s*(?:\(([^)]*)\)\s*)?((?:VALUES|SELECT)\b.*)", Database._insert),
    (rf"UPDATE\s+{NAME}\s+SET\s+(.+?)(?:\s+WHERE\s+(.+))?", Database._update),
    (rf"DELETE\s+FROM\s+{NAME}(?:\s+WHERE\s+(.+))?", Database._delete),
]
