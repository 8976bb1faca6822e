"""Exchange of fingerprints between cells of documents.

Texts are dealt by id and text into cells of a few megabytes.  A cell gathers the
distinct fingerprints of its documents into one binary row per bucket of the
fingerprint space; a bucket's task meets those of all cells and answers each
cell.  So a fingerprint costs a few bytes in the shuffle, and one that a third
of all documents share costs one entry per cell, not one per document.

Cells and buckets keep their size, so their numbers grow with the input.  Where
there are more than ROUTES buckets, a cell's rows would come down to a few bytes
each; then it writes one row per route (a range of buckets), and a relay joins the
rows of RELAY_CELLS cells on one route before it cuts them by bucket.
"""

from __future__ import annotations

import contextlib
import tempfile
import threading
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .arrays import give_back

CELL_BYTES = 4 << 20
BUCKET_BYTES = 12 << 20
#: Cells and buckets in one partition of their exchange, and the most partitions of one.
CELLS_EACH, BUCKETS_EACH, MOST_PARTITIONS = 1, 1, 1 << 16
#: The most rows that a cell writes, and how many cells' rows a relay joins.
ROUTES, RELAY_CELLS = 1 << 12, 1 << 10
LOW = np.uint64(0xFFFFFFFF)
#: The driver returns free memory when a step ends, and so many seconds after it last did in a step.
QUIET_S = 20


def dealt(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int, int]:
    """(cell, doc_id, text) of all rows where they lie, and the numbers of cells and buckets for the input's bytes.

    Rows without an id, or of one id, are spread by their texts.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    cells, buckets = -(-total // CELL_BYTES) or 1, -(-total // BUCKET_BYTES) or 1
    return rows.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(cells)).cast("int").alias("cell"), "doc_id", "text"), cells, buckets


def deal(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, int]:
    """dealt rows, parted by cell, and the number of buckets."""
    rows, cells, buckets = dealt(docs, id_col, text_col)
    return by_key(rows, "cell", cells // CELLS_EACH), buckets


def by_key(rows: DataFrame, key: str, partitions: int) -> DataFrame:
    """rows parted by a key, with so many partitions within bounds; grouping by that key moves nothing more."""
    return rows.repartition(min(max(1, partitions), MOST_PARTITIONS), key)


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Bucket (high half) and remainder (low half) of a fingerprint: 32 bits and those of the bucket decide."""
    return ((keys >> np.uint64(32)) % np.uint64(buckets)) << np.uint64(32) | (keys & LOW)


def by_bucket(sorted_short: np.ndarray) -> Iterator[tuple[int, slice]]:
    """Slices of sorted short fingerprints by bucket."""
    high = (sorted_short >> np.uint64(32)).astype(np.int64)
    at = np.flatnonzero(np.diff(high)) + 1
    edges = [0, *at.tolist(), len(high)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(high[a]), slice(a, b)


def group_edges(x: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin in a sorted array."""
    if not len(x):
        return np.empty(0, np.int64)
    return np.concatenate(([0], np.flatnonzero(x[1:] != x[:-1]) + 1))


def count_docs(doc: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys and in how many distinct documents each occurs."""
    order = np.lexsort((doc, key))
    k, d = key[order], doc[order]
    if not len(k):
        return k, np.empty(0, np.int64)
    new_key = np.concatenate(([True], k[1:] != k[:-1]))
    new = new_key | np.concatenate(([True], d[1:] != d[:-1]))
    at = np.flatnonzero(new_key)
    return k[at], np.add.reduceat(new.astype(np.int64), at)


COUNTED = "bucket int, cell int, keys binary, docs binary, cells binary"
SHARED = "cell int, keys binary, df binary"


def binary_rows(schema: list[str], rows: list[tuple]) -> pa.Table:
    """A table of rows; columns named in schema are integers, those with a star before their names binary."""
    return pa.table({c.lstrip("*"): pa.array([r[k] for r in rows], pa.binary() if c[0] == "*" else pa.int32()) for k, c in enumerate(schema)})


def shared(texts: DataFrame, keys_of: Callable[..., tuple[np.ndarray, np.ndarray]], buckets: int, told: DataFrame | None = None, routes: int = ROUTES) -> DataFrame:
    """For each cell, the short fingerprints of its documents that two documents or more have, and in how many they occur.

    keys_of gives (documents' ids, fingerprints) of a cell, from its texts and, if given, from
    what the cell is told.  A 32-bit clash within a
    bucket may add a fingerprint; it never loses one.
    """
    span = -(-buckets // routes)  # buckets of a route

    def gather(table: pa.Table, *heard: pa.Table) -> pa.Table:
        if not table.num_rows:
            return binary_rows(["bucket", "cell", "*keys", "*docs", "*cells"], [])
        doc, key = keys_of(table, *heard)
        key, n = count_docs(doc, short(key, buckets))
        n, cell = n.astype(np.uint32), table["cell"][0].as_py()
        if span == 1:
            out = [(b, cell, (key[s] & LOW).astype(np.uint32).tobytes(), n[s].tobytes(), None) for b, s in by_bucket(key)]
        else:
            route = key >> np.uint64(32)
            route //= np.uint64(span)
            edges = np.append(group_edges(route), len(key)).tolist()
            out = [(int(route[a]), cell, key[a:b].tobytes(), n[a:b].tobytes(), None) for a, b in zip(edges, edges[1:])]
        return binary_rows(["bucket", "cell", "*keys", "*docs", "*cells"], out)

    def relay(table: pa.Table) -> pa.Table:
        parts = [np.frombuffer(x, np.uint64) for x in table["keys"].to_pylist()]
        cell = np.repeat(np.asarray(table["cell"].to_numpy(), np.uint32), [len(x) for x in parts])
        key, n = np.concatenate(parts), joined(table["docs"], np.uint32)
        order = np.argsort(key, kind="stable")
        key, n, cell = key[order], n[order], cell[order]
        out = [(b, int(cell[0]), (key[s] & LOW).astype(np.uint32).tobytes(), n[s].tobytes(), cell[s].tobytes()) for b, s in by_bucket(key)]
        return binary_rows(["bucket", "cell", "*keys", "*docs", "*cells"], out)

    def meet(table: pa.Table) -> pa.Table:
        key, n = joined(table["keys"], np.uint32), joined(table["docs"], np.uint32)
        cell = [np.full(len(k) // 4, c, np.uint32) if own is None else np.frombuffer(own, np.uint32) for k, c, own in zip(*(table[x].to_pylist() for x in ("keys", "cell", "cells")))]
        cell = np.concatenate(cell)
        order = np.argsort(key, kind="stable")
        at = group_edges(key[order])
        total = np.add.reduceat(n[order].astype(np.int64), at) if len(at) else np.empty(0, np.int64)
        several = np.repeat(total > 1, np.diff(np.append(at, len(key))))
        df = np.repeat(np.minimum(total, 2**32 - 1).astype(np.uint32), np.diff(np.append(at, len(key))))[several]
        pick = order[several]
        to = np.argsort(cell[pick], kind="stable")
        cell, key, df = cell[pick][to], key[pick][to].astype(np.uint64) | np.uint64(table["bucket"][0].as_py() << 32), df[to]
        edges = np.append(group_edges(cell), len(cell)).tolist()
        return binary_rows(["cell", "*keys", "*df"], [(int(cell[a]), key[a:b].tobytes(), df[a:b].tobytes()) for a, b in zip(edges, edges[1:])])

    by_cell = texts.groupBy("cell")
    gathered = by_cell.applyInArrow(lambda table: gather(table), COUNTED) if told is None else by_cell.cogroup(told.groupBy("cell")).applyInArrow(lambda table, heard: gather(table, heard), COUNTED)
    if span > 1:
        blocks = gathered.withColumn("block", F.floor(F.col("cell") / RELAY_CELLS).cast("int"))
        gathered = blocks.repartition(min(routes, MOST_PARTITIONS), "bucket", "block").groupBy("bucket", "block").applyInArrow(relay, COUNTED)
    return by_key(gathered, "bucket", buckets // BUCKETS_EACH).groupBy("bucket").applyInArrow(meet, SHARED)


def joined(column: pa.ChunkedArray, kind) -> np.ndarray:
    """All of a binary column as one array."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.empty(0, kind)


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names; where that is unset, one below the warehouse, or on a single machine (local master) a temporary one."""
    context = spark.sparkContext._jsc.sc()
    if context.getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            folder = tempfile.mkdtemp(prefix="checkpoints-") if spark.sparkContext.master.startswith("local") else spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/checkpoints"
        spark.sparkContext.setCheckpointDir(folder)
    return context.getCheckpointDir().get()


def driver_gives_back(spark: SparkSession) -> None:
    """Return the driver's free memory to the system: garbage of its JVM (with it go shuffles and files that nothing refers to), and what its C library and Python keep."""
    java = spark._jvm.java.lang
    java.System.gc()
    with contextlib.suppress(Py4JError, StopIteration):  # other JVMs and C libraries have no such command
        server = java.management.ManagementFactory.getPlatformMBeanServer()
        invoke = next(m for m in java.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        asked = spark.sparkContext._gateway.new_array(java.Object, 4)  # name, command; no arguments
        asked[0], asked[1] = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        invoke.invoke(server, asked)
    give_back()


@contextlib.contextmanager
def quiet_driver(spark: SparkSession) -> Iterator[None]:
    """Within, and at the end, the driver returns its free memory.

    Each task leaves the driver some garbage and each plan's compilation some freed blocks, so a job of
    very many tasks would otherwise make the driver's process as large as its limits let it.
    """
    ended = threading.Event()

    def now_and_then() -> None:
        while not ended.wait(QUIET_S):
            driver_gives_back(spark)

    beside = threading.Thread(target=now_and_then, daemon=True)
    beside.start()
    try:
        yield
    finally:
        ended.set()
        beside.join()
    driver_gives_back(spark)


def settle(df: DataFrame) -> DataFrame:
    """A copy of the rows in the shared folder, which later steps read and lost executors can't take along.

    Spark drops its files when nothing refers to it any more, if spark.cleaner.referenceTracking.cleanCheckpoints is set.
    """
    shared_folder(df.sparkSession)
    with quiet_driver(df.sparkSession):
        return df.checkpoint()


def by_merge(left: DataFrame, right: DataFrame, on, how: str = "inner") -> DataFrame:
    """A join of two tables that grow with the input: neither is ever broadcast, so none passes through the driver."""
    return left.join(right.hint("merge"), on, how)


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a number of each row that a second reading repeats: a fingerprint of its file and place there; other sources are settled first."""
    try:
        at = docs.metadataColumn("_metadata")
        return docs.select("*", F.xxhash64(at["file_path"], at["row_index"]).alias(name))
    except AnalysisException:  # no files
        return settle(docs.withColumn(name, F.monotonically_increasing_id()))
