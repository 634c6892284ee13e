"""Plan building blocks that several operators share."""

from tessera.plans.along import HALO, RANGE, Along
from tessera.plans.components import connected_components
from tessera.plans.partials import array_sums
from tessera.plans.prefix import running_total
from tessera.plans.ranges import in_ranges, totals_before
from tessera.plans.workspace import dealt, materialise, settled, small_batches, sorted_run

__all__ = ["HALO", "RANGE", "Along", "array_sums", "connected_components", "dealt", "in_ranges", "materialise", "running_total", "settled", "small_batches", "sorted_run", "totals_before"]
