"""One numeric thread per process.

Spark gives a task one core. A numeric library that starts a thread per core inside every task
oversubscribes the machine, and its threads have been seen to stall in a process that also
drives a JVM.
"""

from __future__ import annotations

import ctypes
import functools
import glob
import os

import numpy as np

_SETTERS = ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_",
            "openblas_set_num_threads")


@functools.lru_cache(maxsize=1)
def single() -> None:
    """Hold numpy's bundled linear algebra to one thread, also where numpy was loaded before."""
    base = os.path.dirname(os.path.dirname(np.__file__))
    for path in glob.glob(os.path.join(base, "numpy.libs", "*openblas*")):
        lib = ctypes.CDLL(path)
        for name in _SETTERS:
            if hasattr(lib, name):
                getattr(lib, name)(ctypes.c_int(1))
                break
