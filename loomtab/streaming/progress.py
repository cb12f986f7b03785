"""Progress of a query: a listener on Spark's query executions reports observed row counts."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import Observation
from pyspark.sql import functions as F

from ..core import Table


def reporting(t: Table, batchsize: int, say: Callable[[str], None]) -> Table:
    """``t``, observed; when an action has run it, its rows, seconds and rate are told (Spark's UI shows it while it runs)."""
    seen, began = Observation(), time.time()
    out = Table(t.frame.observe(seen, F.count(F.lit(1)).alias("rows")))

    def wait() -> None:
        n = seen.get["rows"]
        s = time.time() - began
        say(f"{n} rows in {s:.2f}s ({n / s if s else 0:.0f} row/s); batch size {batchsize}")

    threading.Thread(target=wait, daemon=True).start()
    return out
