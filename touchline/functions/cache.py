"""Reuse of Column expression lists within one SparkContext.

Building a Column is a round trip to the JVM per function call; the feature
blocks build several hundred expressions, which costs seconds of driver time
per query.  Unresolved expressions do not depend on a plan, so each list is
built once per SparkContext and reused by every query of that context.
"""

from __future__ import annotations

import functools

from pyspark import SparkContext


def per_context(fn):
    cache: dict = {}

    @functools.wraps(fn)
    def wrapper(*args):
        sc = SparkContext._active_spark_context
        key = (id(sc), args)
        hit = cache.get(key)
        if hit is None and any(k[0] != id(sc) for k in cache):
            cache.clear()  # lists of a context that has ended
        if hit is None or hit[0] is not sc:
            hit = cache[key] = (sc, fn(*args))
        return hit[1]

    return wrapper
