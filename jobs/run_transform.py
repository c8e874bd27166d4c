"""Rewrite one column of a table: spark-submit jobs/run_transform.py --file ... --out ..."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from maskwright.functions.standardise import MODES
from maskwright.plans.transform_job import run_transform


def main() -> None:
    parser = argparse.ArgumentParser(description=__doc__)
    # The names of the job's options.
    parser.add_argument("--file", required=True, help="file, folder or glob")
    parser.add_argument("--column", required=True)
    parser.add_argument("--regex", required=True)
    parser.add_argument("--replacement", default="")
    parser.add_argument("--out", required=True, help="folder for output.parquet")
    parser.add_argument("--normalize", default="none", choices=MODES)
    parser.add_argument("--literal", action="store_true", help="take the replacement as it stands")
    parser.add_argument("--suffix", help="kind of the files in a folder: .csv or .parquet")
    parser.add_argument("--schema", help="DDL; saves the inference pass")
    parser.add_argument("--keep-strings", action="store_true")
    parser.add_argument("--single-line", action="store_true", help="no line ends in cells: files split")
    parser.add_argument("--order-by", nargs="*", help="keys for a sorted result")
    parser.add_argument("--spread-bytes", type=int, help="deal the rows of a few large files into partitions of this size")
    args = parser.parse_args()

    spark = SparkSession.builder.appName("rewrite-column").getOrCreate()
    print(
        run_transform(
            spark,
            args.file,
            args.column,
            args.regex,
            args.replacement,
            args.out,
            args.normalize,
            literal=args.literal,
            suffix=args.suffix,
            schema=args.schema,
            keep_strings=args.keep_strings,
            multi_line=not args.single_line,
            order_by=args.order_by,
            spread_bytes=args.spread_bytes,
        )
    )


if __name__ == "__main__":
    main()
