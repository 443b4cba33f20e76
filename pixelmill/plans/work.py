"""Work counters, and a clock that is a function of them alone: two runs of a request read the same value.

On a cluster counts come from observed metrics (:func:`pixelmill.plans.transform.work`) or aggregates and are added on the
driver; the clock prices them like the plan does.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pixelmill.errors import BudgetError, RangeError
from pixelmill.plans import cost

# Counters in their order.
COUNTERS = (
    "source_samples", "decoded_samples", "blocks", "transforms", "transform_samples", "macroblocks", "filtered", "resampled", "encoded", "passes", "scans_skipped", "entropy_bytes", "encode_probes",
    "alpha_dropped", "decode_micros",
)


class Work:
    """Fifteen counters, the formats that price them, and a limit."""

    def __init__(self):
        self.reset()
        self.limit, self._read, self._write = 0, cost.Source("unknown"), ("unknown", {})

    def reset(self) -> None:
        self.counts, self.base = dict.fromkeys(COUNTERS, 0), dict.fromkeys(COUNTERS, 0)

    def read(self, name: str) -> int:
        """A counter's value; 0 for an unknown one."""
        return self.counts.get(name, 0)

    def add(self, name: str, amount: int) -> None:
        """Unknown counters are ignored, like reading them."""
        if name in self.counts:
            self.counts[name] += amount

    def merge(self, counts: Mapping[str, int]) -> None:
        """Add counts that executors observed."""
        for name, amount in counts.items():
            self.add(name, amount)

    def count_alpha(self, pixels: DataFrame, partial_only: bool = False) -> int:
        """Count pixels whose alpha an encoder cannot keep: those below 255, or the ones between only."""
        lost = (F.col("a") < 255) & (F.col("a") >= int(partial_only))
        self.add("alpha_dropped", n := pixels.where(lost).count())
        return n

    def begin_decode(self, source: cost.Source) -> None:
        self._read = source

    def begin_encode(self, fmt: str, **options) -> None:
        self._write = fmt, options

    def charge_decode(self, width: int, height: int, region: tuple[int, int, int, int] | None = None, den: int = 1, fast: bool = False) -> None:
        """The sample term of a read; its bytes are charged as they are counted."""
        source = cost.Source(self._read.format, 0, 1, self._read.progressive, self._read.lossless)
        self.add("decode_micros", cost.decode_cost(source, width, height, region, den, fast))

    def set_limit(self, micros: int) -> None:
        """Count from here on; 0 takes the limit away and counts from the reset."""
        if micros < 0:
            raise RangeError("limit")
        self.limit, self.base = micros, dict(self.counts) if micros else dict.fromkeys(COUNTERS, 0)

    def clock_us(self) -> int:
        """Microseconds of the work since the limit was set, or since the reset."""
        n = {k: self.counts[k] - self.base[k] for k in COUNTERS}
        late = int(self._read.progressive and self._read.format == "jpeg")
        total = n["decode_micros"] + n["entropy_bytes"] * cost.READ_BYTES.get(self._read.format, (0, 0))[late] // 1_000_000
        if n["resampled"] != n["decoded_samples"]:  # as many samples as were read are a copy
            total += n["resampled"] * cost.SAMPLE["box"] // 1_000_000
        if n["passes"] > 1:
            total += n["resampled"] * (n["passes"] - 1) * cost.NEIGHBORHOOD // 1_000_000
        fmt, options = self._write
        return min((1 << 32) - 1, total + cost.encode_price(fmt, n["encoded"], 1, **options))

    def over_limit(self) -> bool:
        return bool(self.limit) and self.clock_us() > self.limit

    def check(self) -> None:
        if self.over_limit():
            raise BudgetError(f"{self.clock_us()} of {self.limit} us")
