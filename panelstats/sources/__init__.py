"""Reading and writing with explicit schemas."""

from .io import (
    literal_table, load_csv, load_labelled, load_ragged, load_table, read_stage, save_csv, save_table,
    write_stage,
)

__all__ = ["literal_table", "load_csv", "load_labelled", "load_ragged", "load_table", "read_stage",
           "save_csv", "save_table", "write_stage"]
