"""Weighted survey and panel analytics as PySpark DataFrame operators."""

import os as _os

for _name in ("OPENBLAS_NUM_THREADS", "OMP_NUM_THREADS", "MKL_NUM_THREADS"):
    _os.environ.setdefault(_name, "1")

__version__ = "0.1.0"
