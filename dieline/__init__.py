"""Spark-native analytics for semiconductor test logs: the functions of dieline.api, over files in any store that Spark reads."""

from .api import (
    check, convert, convert_many, convert_partitioned, dashboard, dashboard_dir, dump, info, read_batches, recover_dataset, to_ascii, traceability_page, verify_dataset,
    write_parquet, write_parquet_many, write_parquet_partitioned,
)

__all__ = [
    "check", "convert", "convert_many", "convert_partitioned", "dashboard", "dashboard_dir", "dump", "info", "read_batches", "recover_dataset", "to_ascii",
    "traceability_page", "verify_dataset", "write_parquet", "write_parquet_many", "write_parquet_partitioned",
]
