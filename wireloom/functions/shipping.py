"""Python helpers that run inside tasks travel with the job.

Registered modules are pickled by value, so executors need no copy of this
package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle


def ship(module_name: str) -> None:
    cloudpickle.register_pickle_by_value(sys.modules[module_name])
