"""What the corpus operators share with the library: scratch tables, checked broadcasts, components."""

from __future__ import annotations

from ..operators.graph import components, extend_components
from ..plans.scratch import BROADCAST_BYTES, Scratch, known_size, shared_dir, size_of, small_side

__all__ = ["BROADCAST_BYTES", "WORD", "Scratch", "components", "extend_components", "known_size", "shared_dir", "size_of", "small_side"]

#: Words are runs of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
