"""Batch arithmetic of a training configuration; training itself is out of scope."""

from __future__ import annotations


def batch_plan(global_batch: int, most_per_device: int, devices: int) -> tuple[int, int]:
    """(rows per device, steps gathered before an update), the first as large as allowed. Raises where they don't make up the whole batch."""
    devices = max(1, devices)
    per_device = min(most_per_device, global_batch // devices)
    if per_device < 1:
        raise ValueError("a device would get no rows")
    steps, left = divmod(global_batch, per_device * devices)
    if left or steps < 1:
        raise ValueError(f"a batch of {global_batch} can't be dealt to {devices} devices by {per_device}")
    return per_device, steps
