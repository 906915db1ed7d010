"""Reading and writing behaviour logs and the tables made from them."""

from .files import iter_batches, key_sorted_parquet, read_log_csv, read_parquet, read_table, run_metadata, write_csv, write_parquet
from .logs import log_c, log_d, log_h, log_o, log_raw, log_u

__all__ = [n for n in dir() if not n.startswith("_")]
