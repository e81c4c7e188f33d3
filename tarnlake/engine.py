"""The engine: SQL statements over a versioned database, with sessions and transactions."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, replace
from urllib.parse import unquote

from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.errors import DialectError, EngineError, QueryError
from tarnlake.operators import changes, maintain, relational
from tarnlake.plans import syntax as S
from tarnlake.plans.compiler import Table, compile_select, row_scope
from tarnlake.plans.parser import parse
from tarnlake.sources.catalog import Catalog, IndexInfo, Snapshot, TableInfo


@dataclass
class Result:
    """Of a query its rows as a lazy DataFrame; of any other statement a message and a row count."""

    df: DataFrame | None = None
    message: str = ""
    row_count: int = 0

    @property
    def columns(self) -> list[str]:
        return self.df.columns if self.df is not None else []

    def rows(self, most: int | None = None) -> list[list]:
        if self.df is None:
            return []
        return [list(r) for r in (self.df if most is None else self.df.limit(most)).collect()]


class Session:
    """Runs statements. In a transaction it reads its base version and its own staged changes only; as a view, a version that it can't change."""

    def __init__(self, engine: Engine) -> None:
        self.engine = engine
        self.base: Snapshot | None = None
        self.staged: Snapshot | None = None
        self.view: Snapshot | None = None
        self.lease = ""

    @property
    def in_transaction(self) -> bool:
        return self.staged is not None

    def snapshot(self) -> Snapshot:
        if self.view is not None:
            return self.view
        return self.staged if self.staged is not None else self.engine.catalog.load()

    def writable(self) -> None:
        if self.view is not None:
            raise QueryError(f"version {self.view.version} is read-only")

    def change(self, base: Snapshot, after: Snapshot) -> None:
        self.writable()
        if self.in_transaction:
            self.staged = after
        else:
            self.engine.catalog.publish(base, after)

    def begin(self) -> Result:
        if self.in_transaction:
            raise QueryError("already in a transaction")
        self.writable()
        catalog = self.engine.catalog
        while True:  # until the version that the lease names is there for certain
            base = catalog.load()
            self.lease = catalog.lease(f"v{base.version}-{uuid.uuid4().hex}")
            if not base.version or base.version in catalog.versions():
                break
            catalog.release(self.lease)
        self.base = self.staged = base
        return Result(message="BEGIN")

    def ended(self) -> tuple[Snapshot, Snapshot]:
        base, staged, self.base, self.staged = self.base, self.staged, None, None
        self.engine.catalog.release(self.lease)
        return base, staged

    def commit(self) -> Result:
        """Publishes a transaction; outside of one all is published already."""
        self.writable()
        if self.in_transaction:
            base, staged = self.ended()
            if staged != base:
                self.engine.catalog.publish(base, staged)
        return Result(message="COMMIT")

    def rollback(self) -> Result:
        if not self.in_transaction:
            raise QueryError("not in a transaction")
        base, staged = self.ended()
        self.engine.catalog.discard({p for t in staged.tables.values() for p in t.parts} - {p for t in base.tables.values() for p in t.parts})
        return Result(message="ROLLBACK")

    def sql(self, text: str) -> Result:
        try:
            return self.run(parse(text))
        except QueryError as e:
            e.sql = e.sql or text
            raise
        except AnalysisException as e:
            raise QueryError(str(e), text) from e

    def run(self, s: S.Statement) -> Result:
        match s:
            case S.Select():
                snapshot = self.snapshot()
                return Result(compile_select(s, lambda n: self.engine.relation(n, snapshot), self.engine.compat, self.engine.spark))
            case S.Transaction(kind):
                self.writable()
                return {"begin": self.begin, "commit": self.commit, "rollback": self.rollback}[kind]()
            case S.CreateTable():
                return self.create_table(s)
            case S.DropTable(name, lenient):
                base = self.snapshot()
                if name.lower() not in base.tables:
                    if lenient:
                        return Result(message=f"Table {name} does not exist")
                    raise QueryError(f"table {name} does not exist")
                self.change(base, base.without_table(name))
                return Result(message=f"Table {name} dropped")
            case S.CreateIndex():
                return self.create_index(s)
            case S.DropIndex(name, lenient):
                base = self.snapshot()
                if name.lower() not in base.indexes:
                    if lenient:
                        return Result(message=f"Index {name} does not exist")
                    raise QueryError(f"index {name} does not exist")
                self.change(base, base.without_index(name))
                return Result(message=f"Index {name} dropped")
            case S.Insert():
                return self.insert(s)
            case S.Update():
                return self.update(s)
            case S.Delete():
                return self.delete(s)
        raise QueryError(f"unsupported statement: {s}")

    # --- definitions

    def create_table(self, s: S.CreateTable) -> Result:
        base = self.snapshot()
        if s.name.lower() in base.tables:
            if s.lenient:
                return Result(message=f"Table {s.name} already exists")
            raise QueryError(f"table {s.name} already exists")
        if len({c.name.lower() for c in s.columns}) < len(s.columns):
            raise QueryError("two columns have one name")
        columns = s.columns
        if self.engine.compat and not any(c.key for c in columns):  # the first column is the key then
            columns = (replace(columns[0], key=True), *columns[1:])
        self.change(base, base.with_table(TableInfo(s.name, columns)))
        return Result(message=f"Table {s.name} created")

    def create_index(self, s: S.CreateIndex) -> Result:
        base = self.snapshot()
        table = self.engine.table_info(s.table, base)
        if s.name.lower() in base.indexes:
            if s.lenient:
                return Result(message=f"Index {s.name} already exists")
            raise QueryError(f"index {s.name} already exists")
        columns = tuple(canonical(table, c).name for c in s.columns)
        index = IndexInfo(s.name, table.name.lower(), columns, s.unique)
        if s.unique:
            check_unique(self.engine.catalog.read(table), index)
        self.change(base, base.with_index(index))
        return Result(message=f"Index {s.name} created on {s.table}({', '.join(s.columns)})")

    # --- row changes

    def insert(self, s: S.Insert) -> Result:
        base = self.snapshot()
        table = self.engine.table_info(s.table, base)
        given = [canonical(table, c) for c in s.columns] or list(table.columns)
        if len({c.name for c in given}) < len(given):
            raise QueryError("a column is given twice")
        rows = []
        for values in s.rows:
            if len(values) != len(given):
                raise QueryError(f"expected {len(given)} values, got {len(values)}")
            row = dict(zip([c.name for c in given], [x.value for x in values], strict=True))
            rows.append(tuple(stored(c, row.get(c.name)) for c in table.columns))
        return Result(message=f"Inserted {len(rows)} row(s)", row_count=self.put(base, table, rows))

    def put(self, base: Snapshot, table: TableInfo, rows: list[tuple]) -> int:
        """Upserts literal rows: the last of a key wins, and only parts that hold one of the keys are rewritten."""
        n = len(rows)
        if table.key:
            at = [c.name for c in table.columns].index(table.key)
            rows = list({r[at]: r for r in rows}.values())
        new = self.engine.spark.createDataFrame(rows, table.schema()).coalesce(1)
        self.write(base, table, new, [r[at] for r in rows] if table.key else None)
        return n

    def upsert(self, name: str, new: DataFrame) -> None:
        """Upserts a DataFrame of any size. Null keys, repeated keys and nulls in columns that must not be null are errors, and nothing is changed then."""
        base = self.snapshot()
        table = self.engine.table_info(name, base)
        new = new.select(*[F.col(c.name).cast(f.dataType).alias(c.name) for c, f in zip(table.columns, table.schema().fields, strict=True)])
        self.write(base, table, new, None)

    def write(self, base: Snapshot, table: TableInfo, new: DataFrame, keys: list | None) -> None:
        """Puts rows in place of those with their keys. keys: those of checked literal rows."""
        self.writable()
        catalog = self.engine.catalog
        added = catalog.write(table, new)
        written = set(added)
        try:
            new = catalog.read(table, added)
            if keys is None:
                check_rows(new, table)
            hits: dict[str, int] = {}
            if table.key and table.parts:
                old = with_files(catalog.read(table))
                matched = old.where(F.col(table.key).isin(keys)) if keys is not None and len(keys) <= 1000 else old.join(new.select(table.key), table.key, "left_semi")
                hits = hits_by_part(matched)
            kept: tuple[str, ...] = ()
            if hits:
                kept = catalog.write(table, catalog.read(table, tuple(hits)).join(new.select(table.key), table.key, "left_anti").select(*[c.name for c in table.columns]))
                written |= set(kept)
            parts = (*[p for p in table.parts if p not in hits], *added, *kept)
            after = replace(table, parts=parts, rows=table.rows - sum(hits.values()) + new.count())
            for i in base.indexes.values():
                if i.unique and i.table == table.name.lower():
                    check_unique(catalog.read(after), i)
            self.change(base, base.with_table(after))
        except BaseException:
            catalog.discard(written)
            raise

    def rewrite(self, base: Snapshot, table: TableInfo, condition, change, changed: set[str] | None = None) -> int:
        """Rewrites the files that hold rows of the condition; the number of those rows. changed: the columns that get new values, or None if rows go."""
        self.writable()
        catalog = self.engine.catalog
        hits = hits_by_part(with_files(catalog.read(table)).where(F.coalesce(condition, F.lit(False))))
        n = sum(hits.values())
        if not n:
            return 0
        written = catalog.write(table, change(catalog.read(table, tuple(hits))))
        try:
            after = replace(table, parts=(*[p for p in table.parts if p not in hits], *written), rows=table.rows if changed is not None else table.rows - n)
            if changed:
                check_rows(catalog.read(after) if table.key in changed else catalog.read(table, written), table, changed)
                for i in base.indexes.values():
                    if i.unique and i.table == table.name.lower() and changed & set(i.columns):
                        check_unique(catalog.read(after), i)
            self.change(base, base.with_table(after))
        except BaseException:
            catalog.discard(set(written))
            raise
        return n

    def update(self, s: S.Update) -> Result:
        base = self.snapshot()
        table = self.engine.table_info(s.table, base)
        scope = row_scope(Table(self.engine.catalog.read(table), table.key), self.engine.compat)
        condition = scope.condition(s.where) if s.where is not None else F.lit(True)
        new = {canonical(table, c).name: scope.value(e).column for c, e in s.changes}
        n = self.rewrite(base, table, condition, lambda df: changes.update(df, new, condition), set(new))
        return Result(message=f"Updated {n} row(s)", row_count=n)

    def delete(self, s: S.Delete) -> Result:
        base = self.snapshot()
        table = self.engine.table_info(s.table, base)
        if s.where is None:
            n = table.rows
            self.change(base, base.with_table(replace(table, parts=(), rows=0)))
        else:
            condition = row_scope(Table(self.engine.catalog.read(table), table.key), self.engine.compat).condition(s.where)
            n = self.rewrite(base, table, condition, lambda df: changes.delete(df, condition))
        return Result(message=f"Deleted {n} row(s)", row_count=n)

    def query(self, text: str) -> list[dict]:
        r = self.sql(text)
        return [x.asDict() for x in r.df.collect()] if r.df is not None else []


def canonical(table: TableInfo, name: str) -> S.ColumnDef:
    found = table.column(name)
    if found is None:
        raise QueryError(f"column {name} does not exist")
    return found


def stored(c: S.ColumnDef, value: object) -> object:
    """A literal as the column's type; what the type can't hold is an error."""
    if value is None:
        if not c.nullable or c.key:
            raise QueryError(f"column {c.name} must not be null")
        return None
    try:
        if c.type == "int":
            if isinstance(value, bool) or isinstance(value, float) and value != int(value):
                raise ValueError
            return int(value)
        if c.type == "float":
            if isinstance(value, bool):
                raise ValueError
            return float(value)
    except ValueError:
        raise QueryError(f"column {c.name} is {c.type}, not {value!r}") from None
    text = str(value).lower() if isinstance(value, bool) else str(value)
    return text.encode() if c.type == "blob" else text


def check_unique(df: DataFrame, index: IndexInfo) -> None:
    """Rows with a null in the index's columns don't count."""
    full = df.select(*index.columns).dropna()
    if full.groupBy(*index.columns).count().where("count > 1").limit(1).count():
        raise QueryError(f"index {index.name} would not be unique")


def check_rows(df: DataFrame, table: TableInfo, columns: set[str] | None = None) -> None:
    """That the columns, or all, hold no null where they must not, and the key no value twice."""
    full = [c.name for c in table.columns if (c.key or not c.nullable) and (columns is None or c.name in columns)]
    if full:
        nulls = df.agg(*[F.count_if(F.col(f"`{c}`").isNull()).alias(c) for c in full]).first()
        for c in full:
            if nulls[c]:
                raise QueryError(f"column {c} must not be null")
    if table.key and (columns is None or table.key in columns) and df.groupBy(table.key).count().where("count > 1").limit(1).count():
        raise QueryError(f"two rows would have one {table.key}")


#: A column name that no statement can write.
FILE = "\0file"


def with_files(df: DataFrame) -> DataFrame:
    """df with the file of each row, named before any join."""
    return df.withColumn(FILE, F.input_file_name())


def hits_by_part(matched: DataFrame) -> dict[str, int]:
    """The number of rows by the file that holds them."""
    found = matched.groupBy(F.col(f"`{FILE}`").alias("file")).agg(F.count(F.lit(1)).alias("n")).collect()
    return {"/".join(unquote(r["file"]).rsplit("/", 2)[1:]): r["n"] for r in found}


class Engine:
    """A database under a folder. mode: ansi (SQL's logic) or compat (looser typing, two-valued logic)."""

    def __init__(self, spark: SparkSession, root: str, mode: str = "ansi") -> None:
        if mode not in ("ansi", "compat"):
            raise EngineError(f"no mode {mode!r}")
        self.spark, self.compat = spark, mode == "compat"
        self.catalog = Catalog(spark, root)
        self.external: dict[str, Table] = {}
        self.session = Session(self)
        self.lock = threading.RLock()

    # --- tables

    def register(self, name: str, df: DataFrame, key: str | None = None) -> None:
        """A read-only table from any DataFrame."""
        self.external[name.lower()] = Table(df, key)

    def table_info(self, name: str, snapshot: Snapshot | None = None) -> TableInfo:
        tables = (snapshot or self.session.snapshot()).tables
        if name.lower() not in tables:
            raise QueryError(f"table {name} does not exist")
        return tables[name.lower()]

    def relation(self, name: str, snapshot: Snapshot) -> Table:
        if name.lower() in snapshot.tables:
            info = snapshot.tables[name.lower()]
            return Table(self.catalog.read(info), info.key)
        if name.lower() in self.external:
            return self.external[name.lower()]
        raise QueryError(f"table {name} does not exist")

    def table(self, name: str, version: int | None = None) -> DataFrame:
        return self.relation(name, self.session.snapshot() if version is None else self.catalog.load(version)).df

    def keyed(self, name: str) -> tuple[DataFrame, str]:
        t = self.relation(name, self.session.snapshot())
        if not t.key:
            raise QueryError(f"table {name} has no key")
        return t.df, t.key

    def scan(self, name: str) -> DataFrame:
        """All rows, in the order of the key."""
        df, key = self.keyed(name)
        return df.orderBy(key)

    def scan_range(self, name: str, low: object = None, high: object = None) -> DataFrame:
        df, key = self.keyed(name)
        return relational.key_range(df, key, low, high).orderBy(key)

    def get(self, name: str, value: object) -> dict | None:
        df, key = self.keyed(name)
        row = relational.point_get(df, key, value).first()
        return row.asDict() if row is not None else None

    def has(self, name: str, value: object) -> bool:
        df, key = self.keyed(name)
        return relational.point_get(df, key, value).limit(1).count() > 0

    def count(self, name: str) -> int:
        return self.table(name).count()

    def scan_index(self, name: str, *values: object) -> DataFrame:
        """The rows whose indexed columns equal the values; the index shapes files, never results."""
        indexes = self.session.snapshot().indexes
        if name.lower() not in indexes:
            raise QueryError(f"index {name} does not exist")
        index = indexes[name.lower()]
        df = self.table(index.table)
        for c, v in zip(index.columns, values, strict=False):
            df = df.where(F.col(c) == F.lit(v))
        return df

    def find_index(self, table: str, column: str) -> str | None:
        return next((i.name for i in self.session.snapshot().indexes.values() if i.table == table.lower() and [c.lower() for c in i.columns] == [column.lower()]), None)

    def put(self, name: str, row: dict) -> None:
        base = self.session.snapshot()
        table = self.table_info(name, base)
        given = {canonical(table, k).name: v for k, v in row.items()}
        self.session.put(base, table, [tuple(stored(c, given.get(c.name)) for c in table.columns)])

    def remove(self, name: str, value: object) -> int:
        base = self.session.snapshot()
        table = self.table_info(name, base)
        condition = F.col(table.key or table.columns[0].name) == F.lit(value)
        return self.session.rewrite(base, table, condition, lambda df: changes.delete(df, condition))

    # --- statements

    def sql(self, text: str) -> Result:
        return self.session.sql(text)

    def query(self, text: str) -> list[dict]:
        return self.session.query(text)

    def new_session(self) -> Session:
        out = Session(self)
        out.view = self.session.view
        return out

    @contextmanager
    def transaction(self) -> Iterator[Session]:
        """A session in a transaction, committed at the end and rolled back by an error."""
        s = self.new_session()
        s.begin()
        try:
            yield s
        except BaseException:
            s.rollback()
            raise
        s.commit()

    # --- maintenance

    def commit(self) -> None:
        self.session.commit()

    flush = commit

    def compact(self) -> str:
        self.session.writable()
        base = self.catalog.load()
        after, tables, parts = maintain.compact(self.catalog, base)
        if not tables:
            return "Nothing to compact"
        self.catalog.publish(base, after)
        return f"Compacted {parts} parts of {tables} table(s)"

    def gc(self, keep: int = 5) -> str:
        self.session.writable()
        versions, parts = maintain.collect_garbage(self.catalog, keep)
        return f"Removed {versions} version(s) and {parts} part(s)"

    def estimate_distinct(self, table: str, *columns: str) -> int:
        """About how many distinct values the columns have together."""
        info = self.table_info(table)
        return maintain.estimate_distinct(self.table(table), *[canonical(info, c).name for c in columns])

    def stats(self) -> dict:
        return maintain.stats(self.catalog, self.session.snapshot())

    def tables(self) -> list[str]:
        return sorted({*self.session.snapshot().tables, *self.external})

    def indexes(self) -> list[dict]:
        found = self.session.snapshot().indexes
        return [{"name": i.name, "table": i.table, "columns": list(i.columns), "unique": i.unique} for _, i in sorted(found.items())]

    def schema(self, name: str) -> dict:
        t = self.table_info(name)
        return {"table": t.name.lower(), "row_count": t.rows, "columns": [{"name": c.name, "type": c.type, "nullable": c.nullable, "primary_key": c.key} for c in t.columns]}

    def manifest(self) -> str:
        return self.session.snapshot().to_json()

    def versions(self) -> list[int]:
        return self.catalog.versions()

    def as_of(self, version: int) -> Engine:
        """A read-only view of a version."""
        out = Engine(self.spark, self.catalog.folder.root, "compat" if self.compat else "ansi")
        out.external = dict(self.external)
        out.session.view = out.catalog.load(version)
        return out

    def benchmark(self, n: int = 1000, table: str = "_benchmark") -> dict:
        """Inserts n rows in one statement, publishes, and reads up to 20 of them by key; seconds of each."""
        self.sql(f'CREATE TABLE IF NOT EXISTS "{table}" (key TEXT PRIMARY KEY, value TEXT)')
        t = [time.time()]
        self.sql(f'INSERT INTO "{table}" VALUES ' + ", ".join(f"('bench-{i:08d}', 'value-{i}')" for i in range(n)))
        t.append(time.time())
        self.commit()
        t.append(time.time())
        gets = min(n, 20)
        found = sum(self.get(table, f"bench-{i * n // gets:08d}") is not None for i in range(gets))
        t.append(time.time())
        return {"inserts": n, "insert_s": t[1] - t[0], "commit_s": t[2] - t[1], "gets": gets, "found": found, "get_s": t[3] - t[2]}

    def health(self) -> bool:
        try:
            return self.spark.range(1).count() == 1
        except PySparkException:
            return False

    def close(self) -> None:
        """Ends an open transaction without publishing it."""
        if self.session.in_transaction:
            self.session.rollback()


__all__ = ["DialectError", "Engine", "EngineError", "QueryError", "Result", "Session"]
