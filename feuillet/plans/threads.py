"""What a Python worker takes of its machine: one thread a task for matrix products, as Spark runs a task on every core already
and waiting threads cost processor time; and no memory that it has freed."""

from __future__ import annotations

import ctypes
import glob
import os


def one_thread() -> None:
    """Make the matrix products of this process run on one thread, where the library can be told so; else nothing happens."""
    try:
        from threadpoolctl import threadpool_limits

        threadpool_limits(1)
        return
    except ImportError:
        pass
    import numpy

    for path in glob.glob(os.path.join(os.path.dirname(os.path.dirname(numpy.__file__)), "numpy.libs", "*openblas*")):
        library = ctypes.CDLL(path)
        for name in ("scipy_openblas_set_num_threads64_", "scipy_openblas_set_num_threads", "openblas_set_num_threads64_", "openblas_set_num_threads"):
            if hasattr(library, name):
                getattr(library, name)(1)
                break


def release_memory() -> None:
    """Give freed memory back to the system, where the C library can; a worker lives on between tasks."""
    import pyarrow

    pyarrow.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except OSError:
        pass
