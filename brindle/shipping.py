"""Functions that travel inside the task, so that executors need no copy of this package."""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def by_value(name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[name])


by_value(__name__)
