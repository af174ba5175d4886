"""Command line: ``python -m motifel.plans.cli -d DIR -o OUT`` builds an index of a folder of sequence files.

Options that steer memory, threads, sorters, temporary files or the shape of a merge tree are
accepted and have no effect: Spark decides those.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from motifel.operators import order
from motifel.plans.index import build_index
from motifel.sources.fastx import list_files


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="motifel", description="Colored minimizer index of a folder of FASTA or FASTQ files.")
    p.add_argument("-d", "--directory")
    p.add_argument("-f", "--filename", help="text file with one path in each line")
    p.add_argument("-o", "--output", default="result")
    p.add_argument("-k", "--kmer-size", type=int, default=31)
    p.add_argument("-m", "--minimizer-size", type=int, default=19)
    p.add_argument("-x", "--max-files", type=int, default=65536)
    p.add_argument("-v", "--verbose", action="store_true")
    p.add_argument("-n", "--keep-minimizer-files", action="store_true", help="also write the sets of single files")
    for short, name, default in (("-u", "tmp-dir", "./"), ("-w", "merge-step", "8"), ("-t", "threads", "4"), ("-a", "sorter-algo", "crumsort"), ("-M", "MB", "1024"), ("-G", "GB", None)):
        p.add_argument(short, f"--{name}", default=default, help="accepted, without effect")
    for short, name in (("-s", "skip-minimizer-step"), ("-N", "keep-merge-files")):
        p.add_argument(short, f"--{name}", action="store_true", help="accepted, without effect")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> dict[str, str]:
    args = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("motifel").getOrCreate()
    if args.filename:
        paths = sorted(r[0] for r in spark.read.text(args.filename).where("length(trim(value)) > 0").collect())[: args.max_files]
    elif args.directory:
        paths = list_files(spark, args.directory, max_files=args.max_files)
    else:
        raise SystemExit("give a directory (-d) or a list of files (-f)")
    if not paths:
        raise SystemExit("no sequence files found")
    index = build_index(spark, paths, args.kmer_size, args.minimizer_size)
    n = index.n_colors
    out = {"dense": f"{args.output}.{n}c", "files": f"{args.output}.files"}
    order.sort_dense(index.dense).write.parquet(out["dense"])
    if index.layout.split:
        out["sparse"] = f"{args.output}_sparse.{n}c"
        order.sort_sparse(index.sparse).write.parquet(out["sparse"])
    index.files.write.parquet(out["files"])
    if args.keep_minimizer_files:
        out["sets"] = f"{args.output}.sets"
        index.pairs.write.partitionBy("color").parquet(out["sets"])
    if args.verbose:
        for name, path in out.items():
            print(f"{name}: {path}")
    return out


if __name__ == "__main__":
    main()
