"""Operators for training-data pipelines. Python workers that import them give back large blocks of memory at once.

glibc and Arrow's own pool keep freed memory for later; with several workers beside each executor that adds up.
"""

import contextlib
import ctypes

import pyarrow as pa

M_TRIM_THRESHOLD, M_MMAP_THRESHOLD = -1, -3

with contextlib.suppress(OSError, AttributeError):  # other C libraries have no mallopt
    ctypes.CDLL(None).mallopt(M_MMAP_THRESHOLD, 4 << 20)
    ctypes.CDLL(None).mallopt(M_TRIM_THRESHOLD, 8 << 20)
pa.set_memory_pool(pa.system_memory_pool())
