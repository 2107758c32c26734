"""Command line over files: python -m packsmith COMMAND PATH [--out DIR] [--mode MODE] [--password TEXT].

detect, analyse, bench and certify print a table; pack, unpack, encrypt and decrypt write a Parquet table of packages or contents to --out.
"""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import functions as F

from packsmith.functions.scalars import PRESETS, detect_kind
from packsmith.operators import pack
from packsmith.session import get_spark
from packsmith.sources.items import file_items


def main(args: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="packsmith")
    parser.add_argument("command", choices=["detect", "analyse", "bench", "certify", "pack", "unpack", "encrypt", "decrypt"])
    parser.add_argument("path")
    parser.add_argument("--out")
    parser.add_argument("--mode", choices=list(PRESETS), default="balanced")
    parser.add_argument("--advanced", action="store_true")
    parser.add_argument("--password", default="")
    given = parser.parse_args(args)
    spark = get_spark("packsmith")
    spark.sparkContext.setLogLevel("ERROR")
    files = file_items(spark, given.path)
    named = files.select("item_id", "path", F.col("content").alias("package"))
    if given.command in ("pack", "unpack", "encrypt", "decrypt") and not given.out:
        parser.error("--out is needed")
    if given.command == "detect":
        files.select("path", detect_kind(F.col("path"), F.col("content")).alias("kind"), "length").show(1000, truncate=False)
    elif given.command == "analyse":
        pack.analyse(files).show(1000, truncate=False)
    elif given.command == "bench":
        for row in pack.benchmark_lines(pack.benchmark(files, advanced=given.advanced)).toLocalIterator():
            print(row.line)
    elif given.command == "certify":
        failed = False
        for row in pack.certificate_lines(pack.certify(named)).toLocalIterator():
            print(row.text)
            failed |= row.verdict == "FAIL"
        return 2 if failed else 0
    else:
        out = {"pack": lambda: pack.pack(files, given.mode, advanced=given.advanced), "unpack": lambda: pack.unpack(named), "encrypt": lambda: pack.encrypt(named, given.password), "decrypt": lambda: pack.decrypt(named, given.password)}[given.command]()
        out.write.mode("errorifexists").parquet(given.out)
        if given.command in ("unpack", "pack", "decrypt"):
            return 2 if spark.read.parquet(given.out).where("error_class is not null").limit(1).count() else 0
    return 0


if __name__ == "__main__":
    sys.exit(main())
