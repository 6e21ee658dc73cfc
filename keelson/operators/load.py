"""Convert staged rows, split good from rejected ones, and write both with exact accounts."""

from __future__ import annotations

import time
import uuid
from dataclasses import dataclass, field
from functools import reduce
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from keelson.functions.convert import parse
from keelson.functions.encode import field as field_text
from keelson.functions.encode import row_bytes, row_text
from keelson.plans.model import Diagnostic, Severity, Status, TablePlan, TableReport

ORDINAL, PROBLEMS, CHANGED = "_row_ordinal", "_problems", "_changed"
NEVER_NULL = "keelson.never_null"  # in a column's metadata


class RejectLimit(RuntimeError):
    """More rows were rejected than the run allows; code names the diagnostic."""

    code = "REJECT_LIMIT"


class StoppedOnReject(RuntimeError):
    code = "CONVERSION_ROW_REJECTED"


class SourceChanged(RuntimeError):
    code = "SOURCE_CHANGED"


def size_problem(rows: DataFrame, most: int, overhead: int = 16) -> Column:
    """row_size where the bytes of a row's values, with an overhead for each, exceed the bound."""
    total = sum((F.coalesce(F.octet_length(F.col(f"`{f.name}`").cast("string" if f.dataType.simpleString() != "binary" else "binary")), F.lit(0)) + overhead for f in rows.schema), F.lit(0))
    return F.when(total > most, F.lit("row_size"))


def converted(rows: DataFrame, table: TablePlan, max_row_bytes: int | None = None) -> DataFrame:
    """One projection: target columns, the array of problems ("column: code", first column first) and the changed columns.

    An _row_ordinal column is kept if there is one, else made.
    """
    kinds = dict(rows.dtypes)
    columns = table.copied
    made = [parse(F.col(f"`{c.source_name}`"), c, kinds[c.source_name]) for c in columns]
    raw = F.struct(*(f"`{c.source_name}`" for c in columns)).alias("_raw")
    ordinal = (F.col(ORDINAL) if ORDINAL in rows.columns else F.monotonically_increasing_id()).alias(ORDINAL)
    large = [] if max_row_bytes is None else [size_problem(rows.select(*(f"`{c.source_name}`" for c in columns)), max_row_bytes).alias("_large")]
    # each problem is used twice below, so it is a column of its own and is worked out once
    first = rows.select(*(x.alias(f"_{part}{i}") for i, m in enumerate(made) for part, x in zip("vpc", m, strict=True)), raw, ordinal, *large)
    none = F.array().cast("array<string>")
    # most rows have nothing to list, and only for the others arrays are looked through
    real = lambda xs: F.when(F.coalesce(*xs).isNotNull(), F.filter(F.array(*xs), lambda x: x.isNotNull())).otherwise(none) if xs else none
    found = [F.col("_large")] if large else []
    found += [F.concat(F.lit(f"{c.target_name}: "), F.col(f"_p{i}")) for i, c in enumerate(columns)]
    changed = [F.when(F.col(f"_c{i}"), F.lit(c.target_name)) for i, c in enumerate(columns) if c.transform]
    values = [F.when(F.col(f"_p{i}").isNull(), F.col(f"_v{i}")).alias(c.target_name) for i, c in enumerate(columns)]
    computed = [F.expr(c.generated_expression).alias(c.target_name) for c in table.columns if not c.copy and c.generated_expression]
    out = first.select(*values, real(found).alias(PROBLEMS), real(changed).alias(CHANGED), ORDINAL, "_raw")
    return out.select("*", *computed) if computed else out


def good(rows: DataFrame, table: TablePlan) -> DataFrame:
    return rows.where(F.size(PROBLEMS) == 0).select(*(f"`{c.target_name}`" for c in table.columns if c.target_name in rows.columns))


def rejects(rows: DataFrame, table: TablePlan) -> DataFrame:
    """Reject records: version, kind, table, locator, raw values as text or hex, and the reason, which is the first problem."""
    raw = rows.schema["_raw"].dataType
    shown = [(F.lower(F.hex(F.col("_raw")[f.name])) if f.dataType.simpleString() == "binary" else F.col("_raw")[f.name].cast("string")).alias(f.name) for f in raw]
    return rows.where(F.size(PROBLEMS) > 0).select(
        F.lit(1).alias("version"), F.lit("conversion").alias("kind"), F.lit(table.id).alias("table_id"),
        F.struct(F.col(ORDINAL).alias("ordinal"), F.lit(None).cast("string").alias("key")).alias("locator"),
        F.struct(*shown).alias("values"), F.col(PROBLEMS)[0].alias("reason"),
    )


def first_wins(rows: DataFrame, keys: list[str], ordinal: str = ORDINAL) -> tuple[DataFrame, DataFrame]:
    """(kept, later duplicates) by a unique key; rows with a null key part are never duplicates.

    The earliest row of a key is found by a combinable minimum, so a hot key doesn't gather in one task.
    """
    known = [F.col(f"`{k}`") for k in keys]
    whole = known[0].isNotNull()
    for k in known[1:]:
        whole = whole & k.isNotNull()
    least = rows.where(whole).groupBy(*known).agg(F.min(ordinal).alias("_first"))
    marked = rows.where(whole).join(least, keys)
    cols = rows.columns
    kept = marked.where(F.col(ordinal) == F.col("_first")).select(*(f"`{c}`" for c in cols)).unionByName(rows.where(~F.coalesce(whole, F.lit(False))))
    return kept, marked.where(F.col(ordinal) != F.col("_first")).select(*(f"`{c}`" for c in cols))


def transformation_counts(rows: DataFrame) -> dict[str, int]:
    return dict(rows.select(F.explode(CHANGED).alias("c")).groupBy("c").count().collect())


@dataclass
class Loaded:
    report: TableReport
    diagnostics: list[Diagnostic]


def path_of(spark: SparkSession, where: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(where)
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def remove(spark: SparkSession, where: str) -> None:
    path, files = path_of(spark, where)
    files.delete(path, True)


def move(spark: SparkSession, source: str, target: str) -> None:
    a, files = path_of(spark, source)
    b, _ = path_of(spark, target)
    files.mkdirs(b.getParent())
    if files.exists(b) or not files.rename(a, b):
        raise OSError(f"{source} can't be moved to {target}")


def publish(spark: SparkSession, staged: str, target: str, mode: str) -> None:
    """Make a staged table the target's by moving it. mode: errorifexists, append, or overwrite, which keeps the old table until the new one is in its place."""
    path, files = path_of(spark, target)
    if mode == "append":
        files.mkdirs(path)
        parts, _ = path_of(spark, staged)
        for part in sorted(f.getPath().getName() for f in files.listStatus(parts)):
            if part.startswith("part-"):  # such names are unique
                move(spark, f"{staged}/{part}", f"{target.rstrip('/')}/{part}")
        return
    old = f"{target.rstrip('/')}.replaced-{uuid.uuid4().hex}"
    there = mode == "overwrite" and files.exists(path)
    if there:
        move(spark, target, old)
    try:
        move(spark, staged, target)
    except Exception:
        if there:
            move(spark, old, target)
        raise
    if there:
        remove(spark, old)


class Accounts:
    """What a pass over converted rows counts while they are written: rows, rejects, bytes, changes, and a checksum of the rejects."""

    def __init__(self, table: TablePlan):
        self.table, self.observed = table, Observation()

    def watch(self, made: DataFrame) -> DataFrame:
        ok = F.size(PROBLEMS) == 0
        size = row_bytes([(F.col(f"`{c.target_name}`"), c.kind) for c in self.table.copied])
        changes = [F.count_if(ok & F.array_contains(CHANGED, c.target_name)).alias(f"changed{i}") for i, c in enumerate(self.table.copied) if c.transform]
        mark = F.shiftrightunsigned(F.xxhash64("_raw"), 20)  # sums of these don't leave a long
        return made.observe(self.observed, F.count("*").alias("total"), F.count_if(~ok).alias("bad"), F.sum(F.when(ok, size)).alias("bytes"), F.sum(F.when(~ok, mark)).alias("mark"), *changes)

    def found(self) -> dict[str, int]:
        return {k: v or 0 for k, v in self.observed.get.items()}

    def transformations(self) -> dict[str, int]:
        found = self.found()
        return {c.target_name: n for i, c in enumerate(self.table.copied) if c.transform and (n := found[f"changed{i}"])}


@dataclass
class Staged:
    """A converted table beside its target, not yet seen there; and its rejects."""

    spark: SparkSession
    table: TablePlan
    target: str
    folder: str
    report: TableReport
    began: float
    bad: int = 0
    total: int = 0
    size: int = 0
    diagnostics: list[Diagnostic] = field(default_factory=list)

    @property
    def rows(self) -> str:
        return f"{self.folder}/rows"

    def discard(self) -> None:
        remove(self.spark, self.folder)

    def publish(self, mode: str, reject_dir: str | None = None) -> Loaded:
        """Reject files first, then the rows; a move that fails leaves the table indeterminate, one that is refused leaves it as it was."""
        r = self.report
        try:
            if mode == "errorifexists" and (known := path_of(self.spark, self.target))[1].exists(known[0]):
                r.status, r.unresolved_rows = Status.FAILED, self.total
                raise FileExistsError(f"{self.table.target_name} exists")
            if self.bad and reject_dir:
                save_rejects(self.spark, self.folder, reject_dir, self.table.id)
            try:
                publish(self.spark, self.rows, self.target, mode)
            except Exception:
                r.status, r.indeterminate_rows, r.rejected_rows = Status.INDETERMINATE, self.total - self.bad, self.bad
                raise
        finally:
            self.discard()
        return self.settled()

    def settled(self) -> Loaded:
        """The accounts of a table whose rows have arrived."""
        r = self.report
        r.committed_rows, r.rejected_rows, r.committed_bytes = self.total - self.bad, self.bad, self.size
        r.status = Status.PARTIAL if self.bad else Status.COMPLETE
        r.copy_elapsed_millis = int((time.time() - self.began) * 1000)
        return Loaded(r, self.diagnostics)


def save_rejects(spark: SparkSession, folder: str, reject_dir: str, table_id: str) -> None:
    """Move the staged records and copy lines to their places."""
    for name in ("jsonl", "copy"):
        path, files = path_of(spark, f"{folder}/{name}")
        if files.exists(path):
            move(spark, f"{folder}/{name}", f"{reject_dir.rstrip('/')}/{table_id}.reject.{name}")


def duplicates(rows: DataFrame, table: TablePlan, keys: list[list[str]], held: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(kept, refused) of converted good rows with an ordinal: the earliest row of each unique key wins, and none whose key the target holds already."""
    kept, refused = rows, None
    for key in keys:
        kept, late = first_wins(kept, key)
        if held is not None:
            theirs = held.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(key)))
            same = reduce(lambda a, b: a & b, (F.col(f"`{k}`") == F.col(f"_k{i}") for i, k in enumerate(key)))
            late = late.unionByName(kept.join(theirs, same, "left_semi"))
            kept = kept.join(theirs, same, "left_anti")
        refused = late if refused is None else refused.unionByName(late)
    return kept, refused


def copy_facts(table: TablePlan) -> dict[str, Column]:
    """What all records of rows that the target's keys refused say alike."""
    return {"version": F.lit(1), "kind": F.lit("copy"), "encoding": F.lit("postgresql_copy_text"), "table_id": F.lit(table.id), "reason": F.lit("unique")}


def copy_rejects(rows: DataFrame, table: TablePlan) -> DataFrame:
    """Rows that the target's keys refused: locator, the line as copy text, and its length."""
    line = row_text([field_text(F.col(f"`{c.target_name}`"), c.kind) for c in table.copied])
    return rows.select(F.struct(F.col(ORDINAL).alias("ordinal"), F.lit(None).cast("string").alias("key")).alias("locator"), line.alias("line"), F.octet_length(line).cast("long").alias("length"))


def stage_table(rows: DataFrame, table: TablePlan, target: str, *, on_row_error: str = "stop", max_rejected: int = 0, max_row_bytes: int | None = None, keys: list[list[str]] | None = None, held: DataFrame | None = None) -> Staged:
    """Convert and write one table beside its target, with its rejects.

    One pass converts, writes the good rows and counts. Only where rows were rejected a second one writes their records, and fails
    if it doesn't meet the same rejects, as then the source has changed. keys: unique keys that the target enforces while it is loaded, and
    held: what it holds already; then rows are staged with their ordinals first, and those that a key refuses are rejects too.
    """
    spark = rows.sparkSession
    report = TableReport(table.id, table.source_name, table.target_schema, table.target_name)
    out = Staged(spark, table, target, f"{target.rstrip('/')}.staging-{uuid.uuid4().hex}", report, time.time())
    try:
        made = converted(rows, table, max_row_bytes)
        accounts = Accounts(table)
        watched = accounts.watch(made)
        names = [c.target_name for c in table.columns if c.target_name in made.columns]
        columns = [F.col(f"`{n}`") for n in names]
        kept = watched.where(F.size(PROBLEMS) == 0)
        if keys:
            kept.select(*columns, ORDINAL).write.parquet(f"{out.folder}/all")
        else:
            _write(kept.select(*columns), table, out.rows)
        found = accounts.found()
        out.total, out.bad, out.size = found["total"], found["bad"], found["bytes"]
        report.rows_read, report.transformations = out.total, accounts.transformations()
        late = lost = 0
        if keys:
            everything = spark.read.parquet(f"{out.folder}/all")
            good_rows, refused = duplicates(everything, table, keys, held)
            copy_rejects(refused, table).write.json(f"{out.folder}/refused")
            # the records' own lengths were written with them, so counts and bytes are those of the file
            lines = spark.read.schema("line string, length long").json(f"{out.folder}/refused")
            late, lost = lines.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
            _write(good_rows.select(*columns), table, out.rows)
            out.size -= lost
        out.bad += late
        if out.bad and on_row_error == "stop":
            raise StoppedOnReject(f"{table.source_name}: {out.bad} rows can't be {'loaded' if late else 'converted'}")
        if out.bad > max_rejected:
            raise RejectLimit(f"{table.source_name}: {out.bad} rejected rows exceed {max_rejected}")
        if out.bad:
            _records(out, made, late, lost, found)
            out.diagnostics.append(Diagnostic("CONVERSION_ROW_REJECTED", table.source_name, f"{out.bad} rows rejected", Severity.WARNING, "copy"))
    except Exception:
        report.status, report.unresolved_rows = Status.FAILED, out.total
        out.discard()
        raise
    return out


def _write(rows: DataFrame, table: TablePlan, where: str) -> None:
    """Rows as Parquet; columns that the plan says are never null say so in their metadata, as files themselves don't keep it."""
    solid = {c.target_name for c in table.columns if not c.nullable}
    marked = [F.col(f"`{n}`").alias(n, metadata={NEVER_NULL: n in solid}) for n in rows.columns]
    rows.select(*marked).write.parquet(where)


#: Refused rows, and bytes of their lines, that one task sorts; and the order of the lines in their file.
RANGE_ROWS, RANGE_BYTES = 200_000, 1 << 26
IN_ORDER = ("locator.ordinal", "line")


def _in_ranges(lines: DataFrame, n_rows: int, n_bytes: int, where: str) -> DataFrame:
    """Lines dealt by _range, a partition for each in their order, so many that a range has a bound; _before is the length of all lines of the ranges before.

    They are written once, as other passes may draw other ranges.
    """
    n = max(1, -(-n_rows // RANGE_ROWS), -(-n_bytes // RANGE_BYTES))
    lines.repartitionByRange(n, IN_ORDER[0]).withColumn("_range", F.spark_partition_id()).write.parquet(where)
    dealt = lines.sparkSession.read.parquet(where)
    ranges, sizes = zip(*sorted(dealt.groupBy("_range").agg(F.sum("length")).collect()), strict=True)  # a row for each range
    before = lines.sparkSession.createDataFrame(list(zip(ranges, accumulate(sizes, initial=0), strict=False)), "_range int, _before long")
    return dealt.join(F.broadcast(before), "_range").repartitionById(ranges[-1] + 1, F.col("_range"))


def join_files(spark: SparkSession, folder: str, target: str) -> None:
    """One file of a folder's part files, in the order of their names. Bytes pass through a small buffer."""
    path, files = path_of(spark, folder)
    out = files.create(path_of(spark, target)[0])
    try:
        for part in sorted(f.getPath().getName() for f in files.listStatus(path)):
            if part.startswith("part-"):
                read = files.open(path_of(spark, f"{folder}/{part}")[0])
                try:
                    spark._jvm.org.apache.hadoop.io.IOUtils.copyBytes(read, out, 1 << 16, False)
                finally:
                    read.close()
    finally:
        out.close()


def _records(out: Staged, made: DataFrame, late: int, size: int, found: dict[str, int]) -> None:
    """Write the records of all rejects; lines of refused rows (late, of so many bytes) go to a file of their own, in the order of their offsets."""
    spark, table = out.spark, out.table
    frames = []
    if found["bad"]:
        again = Accounts(table)
        rejects(again.watch(made), table).write.json(f"{out.folder}/conversion")
        now = again.found()
        if any(now[k] != found[k] for k in ("total", "bad", "mark")):
            raise SourceChanged(f"{table.source_name}: the source has changed between two passes")
        frames.append(spark.read.text(f"{out.folder}/conversion").select("value"))
    if late:
        lines = _in_ranges(spark.read.json(f"{out.folder}/refused"), late, size, f"{out.folder}/ranges")
        record = F.to_json(F.struct("version", "kind", "encoding", "table_id", "locator", "offset", "length", "reason"))
        earlier = F.sum("length").over(Window.partitionBy("_range").orderBy(*IN_ORDER).rowsBetween(Window.unboundedPreceding, -1))
        placed = lines.withColumn("offset", F.col("_before") + F.coalesce(earlier, F.lit(0)))
        frames.append(placed.withColumns(copy_facts(table)).select(record.alias("value")))
        lines.sortWithinPartitions(*IN_ORDER).select(F.expr("substring(line, 1, char_length(line) - 1)").alias("value")).write.text(f"{out.folder}/lines")
        join_files(spark, f"{out.folder}/lines", f"{out.folder}/copy/part-00000.txt")
    both = frames[0] if len(frames) == 1 else frames[0].unionAll(frames[1])
    both.write.text(f"{out.folder}/jsonl")


def load_table(rows: DataFrame, table: TablePlan, target: str, *, reject_dir: str | None = None, save_mode: str = "errorifexists", **options: object) -> Loaded:
    """Stage and publish one table; rejects go to reject_dir as JSON lines, and what a key refused as copy text beside them."""
    return stage_table(rows, table, target, **options).publish(save_mode, reject_dir)
