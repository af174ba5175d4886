"""Rate of the sequence path on one generated FASTQ file: parts of the file, kernels, distinct hashes. One JSON line.

BENCH_SEQ_GB: bytes of the file (2); BENCH_CPUS: cores (8); BENCH_DIR: where it is written (a temporary folder).
The file holds reads of 150 bases of one random genome, in records of four lines.
"""

from __future__ import annotations

import json
import os
import shutil
import tempfile
import time

import numpy as np
from pyspark.sql import SparkSession

from motifel.operators import extract
from motifel.sources import fastx

READ, GENOME, BLOCK = 150, 20_000_000, 50_000


def write(path: str, n_bytes: int) -> int:
    """Writes reads until the file has n_bytes; returns their number."""
    rng = np.random.default_rng(7)
    genome = np.frombuffer(b"ACGT", np.uint8)[rng.integers(0, 4, GENOME)]
    width, n = 11 + READ + 3 + READ + 1, 0
    with open(path, "wb") as f:
        while n * width < n_bytes:
            rows = np.empty((BLOCK, width), np.uint8)
            digits = np.arange(n, n + BLOCK)[:, None] // 10 ** np.arange(8, -1, -1) % 10
            rows[:, 0], rows[:, 1:10], rows[:, 10] = ord("@"), digits + ord("0"), ord("\n")
            rows[:, 11 : 11 + READ] = genome[rng.integers(0, GENOME - READ, BLOCK)[:, None] + np.arange(READ)]
            rows[:, 11 + READ : 14 + READ] = np.frombuffer(b"\n+\n", np.uint8)
            rows[:, 14 + READ : -1], rows[:, -1] = ord("I"), ord("\n")
            f.write(rows.tobytes())
            n += BLOCK
    return n


def main() -> None:
    size, cpus = float(os.environ.get("BENCH_SEQ_GB", "2")), os.environ.get("BENCH_CPUS", "8")
    folder = tempfile.mkdtemp(prefix="motifel-bench-", dir=os.environ.get("BENCH_DIR"))
    try:
        reads = write(f"{folder}/reads.fastq", int(size * 1e9))
        spark = (
            SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.driver.memory", "12g")
            .config("spark.sql.shuffle.partitions", str(4 * int(cpus))).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
        )
        spark.sparkContext.setLogLevel("ERROR")
        spark.range(1000).selectExpr("sum(id)").collect()  # the session itself is not timed
        began = time.time()
        records = fastx.read_fastx(spark, f"{folder}/reads.fastq")
        distinct = extract.minimizer_hashes(records, [], 31, 19).count()
        took = time.time() - began
        kmers = reads * (READ - 31 + 1)
        print(json.dumps({"metric": "distinct window hashes of a FASTQ file", "value": round(took, 3), "unit": "sec", "gb": size, "kmers": kmers, "distinct": distinct, "million_kmers_a_second": round(kmers / took / 1e6, 2), "cpus": int(cpus)}))
        spark.stop()
    finally:
        shutil.rmtree(folder, ignore_errors=True)


if __name__ == "__main__":
    main()
