"""Parts that several operators share."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# A-Z become a-z, all other bytes stay; bytes.split() then cuts at \x20 and \x09-\x0D.
_LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def remainder(column: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; a null id counts as remainder -1."""
    crc = F.crc32(F.col(column).cast("string"))
    return F.coalesce(F.pmod(crc, F.lit(modulus)).cast("int"), F.lit(-1))


def unused(df: DataFrame, name: str) -> str:
    """`name`, lengthened until no column of `df` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def release() -> None:
    """Gives freed memory of this worker back to the system, which allocators keep for later.

    Workers live on between tasks and stages; call it where large arrays have gone.
    """
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def give_back(spark: SparkSession) -> None:
    """Frees what finished steps left in the driver, in its Python and its JVM, and gives it back to the system.

    Python's handles keep plans and broadcasts alive in the JVM, whose heap grows before it collects them, and
    compiling many plans leaves hundreds of MB in its allocator: an operator of many small jobs calls this
    between its parts. Nothing that is still in use is touched.
    """
    gc.collect()
    jvm = spark._jvm
    jvm.System.gc()
    command = spark.sparkContext._gateway.new_array(jvm.Object, 4)  # what `jcmd PID System.trim_native_heap` does
    command[0] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    command[1] = "systemTrimNativeHeap"
    invoke = next(m for m in jvm.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
    try:
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), command)
    except Py4JError:  # another Java
        pass
    release()


@contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Python workers get at most `rows` rows at once from what is run inside, as long as it lasts.

    Executors and workers hold such a batch, in several forms; what is run later has the session's own size again.
    """
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    own = min(rows, int(before)) if int(before) > 0 else rows
    spark.conf.set(name, str(own))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def words(text: str | None) -> list[bytes]:
    """The UTF-8 words of a text with A-Z in lower case; none for null."""
    if not text:
        return []
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


class Numbers(dict):
    """Numbers keys in the order in which they are first looked up."""

    def __missing__(self, key: str) -> int:
        self[key] = number = len(self)
        return number


def mix(values: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor, shift, multiply) of unsigned longs."""
    values = values ^ (values >> np.uint64(31))
    values = values * np.uint64(0x7FB5D329728EA185)
    values = values ^ (values >> np.uint64(27))
    values = values * np.uint64(0x81DADEF4BC2DD44D)
    return values ^ (values >> np.uint64(33))


def text_blocks(texts: Iterable[str | None], symbols: int) -> Iterator[list[str]]:
    """Consecutive texts in lists of about `symbols` characters; null counts as empty."""
    block, held = [], 0
    for text in texts:
        text = text or ""
        block.append(text)
        held += len(text)
        if held >= symbols:
            yield block
            block, held = [], 0
    if block:
        yield block


def expand(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions start, start+1, ... of every slice, one slice after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(total)


def runs(batches: Iterator[pd.DataFrame], keys: list[str], rows: int) -> Iterator[pd.DataFrame]:
    """Frames of whole key groups, about `rows` rows each, from batches sorted by `keys`.

    A task then holds one group and a batch, not its partition.
    """
    held: list[pd.DataFrame] = []
    count = 0
    for batch in batches:
        if not len(batch):
            continue
        held.append(batch)
        count += len(batch)
        if count < rows:
            continue
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        last = frame[keys].iloc[-1]
        same = (frame[keys] == last).all(axis=1).to_numpy()
        cut = len(frame) - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield frame.iloc[:cut].reset_index(drop=True)
        held, count = [frame.iloc[cut:]], len(frame) - cut
    if held:
        frame = pd.concat(held, ignore_index=True) if len(held) > 1 else held[0]
        if len(frame):
            yield frame.reset_index(drop=True)
