"""What a Python worker of the pipeline holds: four of them share an executor's memory with its JVM."""

import subprocess
import sys
import tracemalloc
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from linkgraph.llm import decontam, linededup, neardup, quality
from linkgraph.llm.common import bitmap, maybe_in, packed
from linkgraph.llm.textops import ALNUM, Words, chunks


def peak_mb(work):
    tracemalloc.start()
    try:
        work()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_stages_import_no_pandas():
    top = str(Path(__file__).resolve().parent.parent.parent)
    code = "import sys; from linkgraph.llm import decontam, linededup, mixing, neardup, quality; print('pandas' in sys.modules)"
    done = subprocess.run([sys.executable, "-c", code], cwd=top, capture_output=True, text=True, check=True)
    assert done.stdout.strip() == "False"


@pytest.mark.parametrize("work", [linededup.line_windows, quality._stats, lambda buf, offs: decontam.winnow(Words(buf, offs, ALNUM))])
def test_long_batches_are_worked_off_in_small_runs(work):
    batch = pa.array([f"word{i} of a line\n" * 130 for i in range(4000)])
    assert batch.nbytes > 8e6
    linededup.line_windows(np.zeros(1, np.uint8), np.array([0, 1]))  # tables of powers are made once

    def run():
        for _, _, buf, offs in chunks(batch):
            work(buf, offs)

    assert peak_mb(run) < 16


def test_batches_to_python_are_small(spark):
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes])], ["n"])

    docs = packed(spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.expr("repeat('some words ', 200)").alias("text")), "doc_id", "text")
    sizes = [r["n"] for r in docs.mapInArrow(run, "n bigint").collect()]
    assert sum(sizes) > 8e6 and max(sizes) < 3e6


def test_members_of_a_bitmap(spark):
    ids = spark.range(0, 1000, 3).select(F.col("id").alias("k"))
    may = maybe_in(bitmap(ids, "k", ids.count()), spark)
    found = {r["id"] for r in spark.range(1000).where(may(F.col("id"))).collect()}
    assert found >= set(range(0, 1000, 3)) and len(found) < 500


def posting_lists(rows, lists, i=-1, j=-1, blocks=1):
    r = np.random.default_rng(5)
    n = r.integers(40, 60, rows)
    bits = r.integers(0, 256, (4, 8 * neardup.PARITY), np.uint8)[r.integers(0, 4, rows)]
    bits[np.arange(rows), r.integers(0, 8 * neardup.PARITY, rows)] ^= 1
    cols = {"token": r.integers(0, lists, rows), "id": np.arange(rows), "comp": r.integers(0, rows // 2, rows), "n": n, "place": r.integers(1, 8, rows), "block": r.integers(0, blocks, rows)}
    whole = lambda x: pa.array(np.full(rows, x, np.int32))
    return pa.table({**{c: pa.array(x) for c, x in cols.items()}, "bits": pa.array([x.tobytes() for x in bits], pa.binary()), "i": whole(i), "j": whole(j)})


@pytest.mark.parametrize(("rows", "lists", "i", "j", "blocks", "most"), [(300, 1, -1, -1, 1, 4), (600, 40, -1, -1, 1, 9999), (400, 1, 0, 1, 2, 4), (400, 1, 1, 1, 2, 9999)])
def test_pairs_do_not_depend_on_how_many_meet_at_once(monkeypatch, rows, lists, i, j, blocks, most):
    table = posting_lists(rows, lists, i, j, blocks)
    got = []
    for at_once in (1 << 20, 97):
        monkeypatch.setattr(neardup, "AT_ONCE", at_once)
        got.append(neardup._meet(most)(table))
    assert got[0].equals(got[1]) and got[0].num_rows > 10


@pytest.mark.parametrize(("i", "j", "blocks"), [(-1, -1, 1), (0, 0, 1)])
def test_a_full_block_meets_in_little_memory(i, j, blocks):
    table = posting_lists(neardup.BLOCK, 1, i, j, blocks)
    assert peak_mb(lambda: neardup._meet(neardup.FIRST)(table)) < 40
