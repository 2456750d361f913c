"""Frequency of every distinct term: in how many rows and how many records it stands.

Recursive radix spilling. Rows are first reduced to (term, record) by Spark's map-side combining aggregation, so a
term that holds a third of all rows is spread over its records. Each map task then folds its share of the
(term, record) pairs into partial counts with DuckDB, block by block, so that a term leaves a task once.
The partial rows are partitioned by the lowest bits of the term's hash, as many as the size of the input asks for: partition n is radix n, and the exchange writes it to
disk. A task whose radix has more than `leaf_rows` rows or `leaf_bytes` bytes splits it by
the next hash bits into files under the shared folder, again and again, until a leaf fits; DuckDB aggregates each leaf, and may spill itself.
A leaf whose rows all belong to one hash can't be split by bits: it is folded block by block instead.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs, ipc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import trim_any
from ..session import shared_dir

#: Bytes of the input's files that one radix partition is meant for, and the most bits for partitions; the next SPLIT_BITS split a partition.
RADIX_BYTES, MOST_BITS, SPLIT_BITS = 32 << 20, 15, 4
LEAF_ROWS, LEAF_BYTES, BLOCK_ROWS, BLOCK_BYTES = 1_000_000, 64 << 20, 200_000, 32 << 20
_PARTIAL = pa.schema([("h", pa.int64()), ("term", pa.string()), ("n_rows", pa.int64()), ("n_records", pa.int64())])


def clean_term(c):
    """Trimmed of white space of any kind and lower-cased."""
    return F.lower(trim_any(c))


def _fold(con, tables: list[pa.Table]) -> pa.Table:
    """Partial counts added up per term, in DuckDB."""
    block = pa.concat_tables(tables)
    con.register("block", block)
    out = con.sql(
        "SELECT h, term, sum(n_rows)::BIGINT AS n_rows, sum(n_records)::BIGINT AS n_records FROM block GROUP BY h, term"
    ).to_arrow_table()
    con.unregister("block")
    return out.cast(_PARTIAL)


def _connect(spill: str = ""):
    """DuckDB for one task. It spills to the task's own folder where the shared folder is a file system's path; in other storage it has none, and leaves are
    small enough for its memory."""
    import duckdb

    folder = spill.removeprefix("file://") if spill.startswith(("file://", "/")) else ""
    return duckdb.connect(config={"threads": 1, "memory_limit": "512MB", "temp_directory": folder})


def _pre_fold(spill: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Folder(spill) as folder:
            con, held, rows, size = _connect(folder), [], 0, 0
            for b in batches:
                held.append(pa.Table.from_batches([b]).cast(_PARTIAL))
                rows += b.num_rows
                size += b.nbytes
                if rows >= BLOCK_ROWS or size >= BLOCK_BYTES:
                    held = [_fold(con, held)]
                    rows, size = held[0].num_rows, held[0].nbytes
                    if rows >= BLOCK_ROWS // 2 or size >= BLOCK_BYTES // 2:  # mostly distinct terms: pass them on rather than hold them
                        yield from held[0].to_batches()
                        held, rows, size = [], 0, 0
            if held:
                yield from _fold(con, held).to_batches()

    return run


class _Folder:
    """A task's folder below the shared one: made when it is first needed, gone at the end."""

    def __init__(self, shared: str):
        self.at = f"{shared}/lorekeep/radix-{uuid.uuid4().hex}"

    def __enter__(self) -> str:
        return self.at

    def __exit__(self, *_):
        system, root = fs.FileSystem.from_uri(self.at)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class _Radix:
    """One radix partition: rows in memory up to a leaf's rows and bytes, beyond that in files by the next bits of the hash."""

    def __init__(self, con, spill: str, leaf: tuple[int, int], shift: int):
        self.con, self.spill, self.leaf, self.shift = con, spill, leaf, shift
        self.held: list[pa.Table] = []
        self.rows = self.bytes = 0
        self.files: dict[int, tuple[str, ipc.RecordBatchFileWriter]] = {}

    def add(self, t: pa.Table) -> None:
        self.held.append(t)
        self.rows += t.num_rows
        self.bytes += t.nbytes
        if self.rows > self.leaf[0] or self.bytes > self.leaf[1]:
            folded = _fold(self.con, self.held)  # equal terms may make room already
            if (folded.num_rows > self.leaf[0] // 2 or folded.nbytes > self.leaf[1] // 2) and self.shift < 64:
                self._write(folded)
                folded = folded.slice(0, 0)
            self.held, self.rows, self.bytes = [folded], folded.num_rows, folded.nbytes if folded.num_rows else 0

    def _write(self, t: pa.Table) -> None:
        bits = pc.bit_wise_and(pc.shift_right(t["h"], self.shift), (1 << SPLIT_BITS) - 1)
        for k in pc.unique(bits).to_pylist():
            if k not in self.files:
                system, root = fs.FileSystem.from_uri(self.spill)
                system.create_dir(root, recursive=True)
                name = f"{uuid.uuid4().hex}.arrow"
                self.files[k] = (name, ipc.new_file(system.open_output_stream(f"{root}/{name}"), _PARTIAL))
            self.files[k][1].write_table(t.filter(pc.equal(bits, k)))

    def result(self) -> Iterator[pa.Table]:
        if not self.files:
            if self.held:
                yield _fold(self.con, self.held)
            return
        if self.rows:
            self._write(_fold(self.con, self.held))
        self.held, self.rows, self.bytes = [], 0, 0
        system, root = fs.FileSystem.from_uri(self.spill)
        for name, writer in self.files.values():
            writer.close()
        for name, _ in self.files.values():
            part = _Radix(self.con, self.spill, self.leaf, self.shift + SPLIT_BITS)
            with system.open_input_file(f"{root}/{name}") as f:
                reader = ipc.open_file(f)
                for i in range(reader.num_record_batches):
                    part.add(pa.Table.from_batches([reader.get_batch(i)]))
            system.delete_file(f"{root}/{name}")
            yield from part.result()


def _aggregate(shared: str, leaf: tuple[int, int], bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with _Folder(shared) as spill:
            part = _Radix(_connect(spill), spill, leaf, bits)
            for b in batches:
                part.add(pa.Table.from_batches([b]).cast(_PARTIAL))
            for x in part.result():
                yield from x.select(["term", "n_rows", "n_records"]).to_batches()

    return run


def term_counts(rows: DataFrame, term: str, record: str, leaf_rows: int = LEAF_ROWS, leaf_bytes: int = LEAF_BYTES) -> DataFrame:
    """term, n_rows, n_records for every distinct cleaned term of the column `term`.

    Null and blank terms are ignored. A row whose record is null counts in n_rows, not in n_records. Repeated rows
    count as rows and once as a record. An empty table gives no rows; other columns are not read.
    """
    spark = rows.sparkSession
    shared = shared_dir(spark)
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = size // RADIX_BYTES if size < 1 << 60 else int(spark.conf.get("spark.sql.shuffle.partitions"))  # not files: of unknown size
    bits = min(MOST_BITS, (max(spark.sparkContext.defaultParallelism, wanted) - 1).bit_length())
    per_record = (
        rows.select(clean_term(F.col(term)).alias("term"), F.col(record).cast("string").alias("record"))
        .where(F.col("term") != "")
        .groupBy("term", "record")
        .agg(F.count("*").alias("n_rows"))
    )
    partial = per_record.select(F.xxhash64("term").alias("h"), "term", "n_rows", F.col("record").isNotNull().cast("bigint").alias("n_records"))
    partial = partial.mapInArrow(_pre_fold(shared), "h bigint, term string, n_rows bigint, n_records bigint")
    radix = partial.repartitionById(1 << bits, F.col("h").bitwiseAND((1 << bits) - 1).cast("int"))
    return radix.mapInArrow(_aggregate(shared, (leaf_rows, leaf_bytes), bits), "term string, n_rows bigint, n_records bigint")


def tag_frequencies(tags: DataFrame, pages: DataFrame) -> DataFrame:
    """term, n_rows, n_records and mark of every tag. `rare`: on fewer than 3 pages; `common`: on more than
    max(5, floor(N / 20)), N being the rows of `pages`; in between null."""
    most = max(5, pages.count() // 20)
    mark = F.when(F.col("n_records") < 3, "rare").when(F.col("n_records") > most, "common")
    return term_counts(tags, "tag", "doc_id").withColumn("mark", mark)
